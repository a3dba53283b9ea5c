"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

#: White space of the word contract: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 256
RUN = 1 << 22  # bytes of text that a worker takes at once
#: ASCII punctuation, which words are stripped of where copies may be punctuated otherwise.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet (names compare without case in Spark)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def plain_words(text: str) -> list[bytes]:
    """The words of a text in lower case and without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column, null as empty, a few hundred at a time."""
    for at in range(0, len(column), SLICE):
        for text in column.slice(at, SLICE).to_pylist():
            yield text or ""


def runs_of(column: pa.Array, most: int = RUN) -> Iterator[pa.Array]:
    """An Arrow column of strings in runs of about so many bytes; a longer text is a run of its own or the last of one."""
    stops = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = stops[start - 1] if start else 0
        stop = int(np.searchsorted(stops, before + most)) + 1
        yield column.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns what Arrow and the C library hold of freed memory. Workers outlive their tasks, Spark takes them by turns, and each would
    keep the most that it ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def struct_column(fn: Callable[[str], tuple], schema: StructType):
    """An Arrow UDF that applies ``fn`` to each text and returns its tuple as a struct.

    It is marked nondeterministic so that Catalyst evaluates it once even where a filter and a projection both use it.
    """
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(column: pa.Array) -> pa.Array:
        rows = [fn(text) for text in texts_of(column)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    return F.arrow_udf(run, schema).asNondeterministic()


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
