"""Token counts by a map-side two-tier lookup (operator 3).

Tier one is a compact table of the most frequent units (a unit is one run of white space with what follows it, whole pre-tokens)
and their token counts, made from a count over all texts and broadcast. Tier two is each worker's cache of the units that the
table misses, filled by the library. No unit is ever shuffled: each task counts its own units, keeps at most ``ENTRIES`` of them,
and these summaries are merged in a tree to one of the same bound.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside texts are handled as the library does by
default; nothing is truncated, and a very long text is counted whole; repeated rows are counted row by row; an empty table gives no
rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from meterloom.llm.bpe import Encoder, split_units, vocabulary_path, worker_encoder
from meterloom.llm.common import give_back, runs_of, texts_of

ENTRIES = 32_768  # of the broadcast table and of each summary
FAN_IN = 32
OVER = 512

SUMMARY = StructType([StructField("part", IntegerType()), StructField("units", BinaryType())])
COUNTS = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])


def _pack(counts: Counter, entries: int) -> bytes:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries]
    return pickle.dumps(top)


def frequent_units(docs: DataFrame, entries: int = ENTRIES) -> list[str]:
    """The units with the largest counts over all texts. The bound on summaries may misjudge rare ones; that costs time, not truth."""

    def summarise(batches):
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(split_units(text)[1:-1])
                if len(counts) > 16 * entries:
                    counts = Counter(dict(counts.most_common(4 * entries)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([_pack(counts, entries)], pa.binary())], names=["part", "units"])

    def merge(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for packed in table.column("units"):
            counts.update(dict(pickle.loads(packed.as_py())))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "units": pa.array([_pack(counts, entries)], pa.binary())})

    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    found = texts.mapInArrow(summarise, SUMMARY)
    while parts > 1:
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        found = found.withColumn("part", group).groupBy("part").applyInArrow(merge, SUMMARY)
        parts = -(-parts // FAN_IN)
    merged: Counter = Counter()
    for row in found.collect():  # one bounded summary
        merged.update(dict(pickle.loads(row["units"])))
    return [u for u, _ in merged.most_common(entries) if u and not u[-1].isspace()]


class LengthsEncoder(Encoder):
    """Its values are numbers of ids."""

    def joined(self, values: list[int], places: np.ndarray, firsts: np.ndarray) -> list[int]:
        return np.add.reduceat(np.array(values, np.int64)[places], firsts).tolist()


def annotate(docs: DataFrame, name: str, vocabulary: str | None = None, entries: int = ENTRIES) -> DataFrame:
    """Adds a struct column ``name`` with n_bytes and n_tokens of each row's text."""
    path = vocabulary or vocabulary_path()
    units = frequent_units(docs, entries)
    table = docs.sparkSession.sparkContext.broadcast((units, bytes(min(255, n) for n in LengthsEncoder(path, len, sum).values(units))))
    key = (path, uuid.uuid4().hex)

    def make() -> Encoder:
        names, lengths = table.value
        known = {u: n for u, n in zip(names, lengths, strict=True) if u and n < 255}
        return LengthsEncoder(path, len, sum, known)

    def count(column: pa.Array) -> pa.Array:
        encoder = worker_encoder(key, make)
        tokens = [n for texts in runs_of(column) for n in encoder.encode(texts)]
        give_back()
        return pa.StructArray.from_arrays([pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), pa.array(tokens, pa.int64())], names=["n_bytes", "n_tokens"])

    return docs.withColumn(name, F.arrow_udf(count, COUNTS).asNondeterministic()(F.col("text")))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per row of ``docs``."""
    counted = annotate(docs.select("doc_id", "text"), "c", vocabulary)
    return counted.select("doc_id", "c.*").withColumn("over_limit", F.col("n_tokens") > limit)
