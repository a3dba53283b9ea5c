"""A content-addressed store of token ids (operator 8).

Format, all tables Parquet with zstd, under one folder:
  kind=chunk   digest, width, ids      unique stretches of ids, little-endian, ``width`` bytes an id, addressed by BLAKE2b-128
  recipes      part, doc_id, row, n_tokens, chunks (digests in order), root    a document as a list of chunks; ascending doc_id over the parts
  manifest     part, n_docs, n_tokens, first_doc, last_doc, root    each part's place and the Merkle root over its documents' roots
  head         n_parts, n_docs, n_tokens, root    of the store, the root over its parts' roots

Ids are cut where a rolling hash of the last 16 of them has its low bits zero, so equal passages give equal chunks wherever they
stand. One shuffle brings equal chunks together: a task sends each chunk's ids once, however often it met it, and a document's
recipe goes elsewhere by its own row number, so a chunk that a third of all documents hold is no hot key in writing.

Reading recomputes each chunk's digest and its CRC from the stored ids; documents are put together from these by the algebra of
CRC-32. Recipes are checked against the manifest, the manifest against the head, chunks and documents against their recipes; a chunk,
recipe or manifest row that is missing or changed raises.

Defined results: a null or empty text holds the end id alone; repeated rows are documents of their own, in the order of doc_id
(null first), then row; an empty table gives an empty store; very long texts are whole documents of many chunks; other columns are
neither read nor kept.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from functools import cache
from itertools import pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from meterloom.llm.bpe import LATEST, Encoder, vocabulary_path, worker_encoder
from meterloom.llm.common import give_back, runs_of
from meterloom.session import scratch_path

END_ID = 0
CUT_BITS = 9  # a chunk has 512 ids on average
CHUNK_LEAST, CHUNK_MOST = 64, 4096
SEEN = 1 << 18  # digests that a task remembers
WORDS = 1 << 15  # units that the library's model takes in one call, at most
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Text of letters alone that Python and the library agree on.
LETTERS = "^[" + "".join(c for c in map(chr, range(ord(LATEST) + 1)) if c.isalpha()) + "]+$"

CUT = StructType([StructField("kind", StringType()), StructField("dest", BinaryType()), StructField("width", IntegerType()), StructField("ids", BinaryType()), StructField("doc_id", LongType()), StructField("row", LongType()), StructField("n_tokens", LongType()), StructField("chunks", ArrayType(BinaryType())), StructField("root", BinaryType())])
MANIFEST = StructType([StructField("part", IntegerType()), StructField("n_docs", LongType()), StructField("n_tokens", LongType()), StructField("first_doc", LongType()), StructField("last_doc", LongType()), StructField("root", BinaryType())])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """A Merkle root of leaves that come one by one; keeps one node for each level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for k, other in enumerate(self.levels):
            if other is None:
                self.levels[k] = node
                return
            self.levels[k], node = None, digest(other + node)
        self.levels.append(node)

    def root(self) -> bytes:
        top = None
        for node in self.levels:
            top = node if top is None else top if node is None else digest(node + top)
        return top or digest(b"")


def merkle(leaves) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _marks(ids: np.ndarray) -> np.ndarray:
    """The places after which the rolling hash of the last 16 ids has its low bits zero."""
    rolling, power = ids.astype(np.uint64) * MULTIPLIER + np.uint64(1), int(MULTIPLIER)
    for step in (1, 2, 4, 8):  # a window of 16 by doubling
        ahead = rolling.copy()
        ahead[step:] += rolling[:-step] * np.uint64(power)
        rolling, power = ahead, power * power % (1 << 64)
    mixed = (rolling ^ (rolling >> np.uint64(29))) * MULTIPLIER
    return np.flatnonzero((mixed >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1


def cuts(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Where the chunks of each document end, counted from its start. ``ids`` holds documents of these sizes one after another: no
    chunk is shorter than CHUNK_LEAST, so windows that reach back into the document before cut nothing."""
    marks = _marks(ids)
    starts = np.cumsum([0, *sizes])
    first = np.searchsorted(marks, starts, "right").tolist()
    marks = marks.tolist()
    out, start = [], 0
    for k, size in enumerate(sizes):
        ends, last = [], 0
        for mark in marks[first[k] : first[k + 1]]:
            at = mark - start
            while at - last > CHUNK_MOST:
                last += CHUNK_MOST
                ends.append(last)
            if at - last >= CHUNK_LEAST:
                ends.append(at)
                last = at
        while size - last > CHUNK_MOST:
            last += CHUNK_MOST
            ends.append(last)
        if last < size:
            ends.append(size)
        out.append(ends)
        start += size
    return out


def _cut_documents(path: str, end_id: int, remembered: int | None = None):
    def run(batches):
        from pyspark import TaskContext

        encoder = worker_encoder((path, "ids", end_id, remembered), lambda: IdsEncoder(path, end_id, remembered))
        width = encoder.width
        row, seen = TaskContext.get().partitionId() << 40, set()
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in runs_of(batch.column(1)):
                out = []
                streams = [stream + end for stream in encoder.encode(texts)]
                ids = np.frombuffer(b"".join(streams), f"<u{width}")
                sizes = [len(stream) // width for stream in streams]
                for stream, size, ends in zip(streams, sizes, cuts(ids, sizes), strict=True):
                    digests, last = [], 0
                    for stop in ends:
                        data = stream[last * width : stop * width]
                        digests.append(key := digest(data))
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            out.append(("chunk", key, width, data, None, None, None, None, None))
                        last = stop
                    out.append(("recipe", row.to_bytes(8, "big"), width, None, next(doc_ids), row, size, digests, merkle(digests)))
                    row += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT_TYPES, strict=True)], names=CUT.names)
        del seen
        batch = texts = out = streams = ids = columns = None
        give_back()

    return run


class IdsEncoder(Encoder):
    """Its values are ids as bytes, ``width`` bytes an id; low byte first on all platforms that Spark runs on.

    What it remembers are Arrow arrays, not Python's objects: units without the punctuation that ends them, and their ids. Arrow finds
    those of a run that are new, and the library's model takes those of letters alone many at a time.
    """

    def __init__(self, path: str, end_id: int, remembered: int | None = None):
        tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        code = "H" if self.width == 2 else "I"
        super().__init__(tokenizer, lambda ids: array(code, ids).tobytes(), b"".join, remembered=remembered)
        self.lines = Tokenizer(tokenizer.model)  # takes a pre-token a line
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[k for token, k in vocabulary.items() if token[0] == self.space]] = True
        self.stems, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def looked_up(self, units: pa.Array) -> pa.Array:
        """Of a unit that ends in ASCII punctuation after a letter or digit, the ids of what stands before it and those of the punctuation."""
        stems = pc.ascii_rtrim(units, characters=punctuation)
        lasts = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        parted = np.array([c.isalnum() and c <= LATEST for c in lasts.dictionary.to_pylist()], bool)[lasts.indices.to_numpy()]
        parted &= pc.not_equal(pc.binary_length(stems), pc.binary_length(units)).to_numpy(zero_copy_only=False)
        values = self.remember(pc.if_else(pa.array(parted), stems, units))
        if not parted.any():
            return values
        with_tail = pa.array(parted)
        tails = _after(units.filter(with_tail), stems.filter(with_tail)).dictionary_encode()
        found = pa.array([self.tail(t.decode()) for t in tails.dictionary.to_pylist()], pa.large_binary()).take(tails.indices)
        empty = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(values, pc.replace_with_mask(pa.repeat(empty, len(values)), with_tail, found), empty)

    def remember(self, stems: pa.Array) -> pa.Array:
        """The ids of each of these; those of this run are remembered, and what was before, while there is room."""
        before = len(self.stems)
        both = pa.concat_arrays([self.stems, stems]).dictionary_encode()  # what is remembered comes first, each once
        places, new = both.indices[before:], both.dictionary[before:]
        ids = pa.concat_arrays([self.ids, self.new_ids(new)])
        found = ids.take(places)
        if len(ids) <= 2 * self.remembered:
            self.stems, self.ids = both.dictionary, ids
        else:
            kept = pc.unique(places)[: self.remembered]
            self.stems, self.ids = both.dictionary.take(kept), ids.take(kept)
        return found

    def new_ids(self, units: pa.Array) -> pa.Array:
        if len(units) > WORDS:
            return pa.concat_arrays([self.new_ids(units[at : at + WORDS]) for at in range(0, len(units), WORDS)])
        letters = pc.match_substring_regex(units, LETTERS)
        rest = pa.array([self.made(unit) for unit in units.filter(pc.invert(letters)).to_pylist()], pa.large_binary())
        return pc.replace_with_mask(pc.replace_with_mask(pa.repeat(pa.scalar(b"", pa.large_binary()), len(units)), letters, self.of_letters(units.filter(letters))), pc.invert(letters), rest)

    def of_letters(self, words: pa.Array) -> pa.Array:
        """The ids of units of letters alone: each is one pre-token with the space before it. No byte within is a space, so a token that
        begins with one begins a unit."""
        if not len(words):
            return pa.array([], pa.large_binary())
        lines = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n ", pa.large_string()))[0].as_py()
        lines = lines.replace(" ", self.space) if lines.isascii() else lines.encode().decode("latin-1").translate(self.letters | {0x0A: "\n"})
        ids = np.array(self.lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, f"<u{self.width}")
        bounds = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])

    def with_more(self, values: pa.Array, more: list[bytes]) -> pa.Array:
        return pa.concat_arrays([values, pa.array(more, pa.large_binary())])

    def joined(self, values: pa.Array, places: np.ndarray, firsts: np.ndarray) -> list[bytes]:
        _, offsets, data = values.take(pa.array(places)).buffers()
        bounds = np.frombuffer(offsets, np.int64, len(places) + 1)[[*firsts, len(places)]].tolist()
        ids = memoryview(data or b"")
        return [ids[a:b].tobytes() for a, b in pairwise(bounds)]


def _after(whole: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows in each string its head there."""
    _, offsets, data = whole.buffers()
    stops = np.frombuffer(offsets, np.int64)[whole.offset + 1 : whole.offset + len(whole) + 1]
    sizes = (pc.binary_length(whole).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(stops - bounds[1:], sizes) + np.arange(bounds[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(bounds), pa.py_buffer(np.frombuffer(data, np.uint8)[places])])


_CUT_TYPES = [pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary()]


def _manifest(batches):
    part = n_docs = n_tokens = first = last = None
    tree = Merkle()
    for batch in batches:
        parts, docs, tokens, roots = (batch.column(k).to_pylist() for k in range(4))
        for p, doc_id, n, root in zip(parts, docs, tokens, roots, strict=True):
            if part is None:
                part, n_docs, n_tokens, first = p, 0, 0, doc_id
            n_docs, n_tokens, last = n_docs + 1, n_tokens + n, doc_id
            tree.add(root)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, n_docs, n_tokens, first, last, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=MANIFEST.names)


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, remembered: int | None = None) -> str:
    """Writes the documents (doc_id, text) to a store in ``folder``, which driver and executors share."""
    spark = docs.sparkSession
    cutting = _cut_documents(vocabulary or vocabulary_path(), end_id, remembered)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cutting, CUT)
    one = F.row_number().over(Window.partitionBy("dest", "kind").orderBy("width"))
    pieces.withColumn("n", one).where("n = 1").drop("n").write.partitionBy("kind").option("compression", "zstd").parquet(folder)

    recipes = _read(spark, f"{folder}/kind=recipe", "doc_id long, row long, n_tokens long, chunks array<binary>, root binary")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "row", "n_tokens", "chunks", "root").write.option("compression", "zstd").parquet(f"{folder}/recipes")

    _listed(spark.read.parquet(f"{folder}/recipes")).write.option("compression", "zstd").parquet(f"{folder}/manifest")
    spark.createDataFrame([_head(spark.read.parquet(f"{folder}/manifest"))], "n_parts long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{folder}/head")
    return folder


def _listed(recipes: DataFrame) -> DataFrame:
    """The manifest that the recipes should have."""
    listed = recipes.select("part", "doc_id", "n_tokens", "root", "row").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "row")
    return listed.mapInArrow(_manifests, MANIFEST)


def _head(manifest: DataFrame) -> tuple:
    """What the head says of a manifest: a row for each part of the store, however many documents that has."""
    parts = manifest.select("n_docs", "n_tokens", "root").orderBy("part").collect() if manifest.columns else []
    return len(parts), sum(p["n_docs"] for p in parts), sum(p["n_tokens"] for p in parts), bytearray(merkle(bytes(p["root"]) for p in parts))


def _manifests(batches):
    """As _manifest, where one task may hold several parts, each in one stretch."""
    held, part = [], None
    for batch in batches:
        start = 0
        parts = batch.column(0).to_numpy()
        turns = [*(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for stop in turns:
            if stop > start:
                if part is not None and parts[start] != part:
                    yield from _manifest(held)
                    held = []
                part = parts[start]
                held.append(batch.slice(start, stop - start))
                start = stop
    yield from _manifest(held)


def _read(spark, path: str, schema: str) -> DataFrame:
    """A table of the store; of no documents there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


# CRC-32 as polynomials over GF(2), the lowest power in the highest bit
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 n."""
    if n_bytes not in _shifts:
        out, square, n = 0x80000000, 0x00800000, n_bytes
        while n:
            if n & 1:
                out = _times(out, square)
            square, n = _times(square, square), n >> 1
        _shifts[n_bytes] = out
    return _shifts[n_bytes]


@cache
def _powers(level: int) -> np.ndarray:
    """x to the power 8 k 256^level for each k below 256."""
    out, base = [0x80000000], _shift(1 << 8 * level)
    while len(out) < 256:
        out.append(_times(out[-1], base))
    return np.array(out, np.uint32)


def _times_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, one = np.zeros(len(a), np.uint32), np.uint32(1)
    for k in range(31, -1, -1):
        out ^= b * (a >> np.uint32(k) & one)
        b = (b >> one) ^ (np.uint32(POLYNOMIAL) * (b & one))
    return out


def joined_crcs(crcs: np.ndarray, n_bytes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The CRC-32 of stretches that follow each other from that of each; a new whole begins at each of ``firsts``."""
    stops = np.cumsum(n_bytes)
    behind = np.repeat(stops[np.append(firsts[1:], len(stops)) - 1], np.diff(np.append(firsts, len(stops)))) - stops
    out, level = crcs.astype(np.uint32), 0
    while behind.any():
        more = np.flatnonzero(behind & 255)
        out[more] = _times_each(out[more], _powers(level)[behind[more] & 255])
        behind, level = behind >> 8, level + 1
    return np.bitwise_xor.reduceat(out, firsts)


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two stretches from those of each."""
    return int(joined_crcs(np.array([first, second]), np.array([0, second_bytes]), np.array([0]))[0])


ASSEMBLED = pa.struct([("n", pa.int64()), ("crc", pa.int64()), ("root", pa.binary())])


def _chunk_facts(batches):
    for batch in batches:
        keys, crcs, sizes = [], [], []
        for key, width, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if digest(data) != key:
                raise ValueError(f"chunk {key.hex()} does not match its address")
            ids = np.frombuffer(data, f"<u{width}").astype("<u4")
            keys.append(key)
            crcs.append(zlib.crc32(ids.tobytes()))
            sizes.append(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "crc", "n"])


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("crc", LongType()), StructField("root", BinaryType())]))
def _assembled(column: pa.Array) -> pa.Array:
    counts = pc.list_value_length(column).to_numpy()
    if not len(counts):
        return pa.array([], ASSEMBLED)
    digests, crcs, sizes = pc.list_flatten(column).flatten()[1:]
    sizes, digests, firsts = sizes.to_numpy(), digests.to_pylist(), np.cumsum(counts, dtype=np.int64) - counts
    roots = [merkle(digests[a:b]) for a, b in pairwise([*firsts.tolist(), len(digests)])]
    whole = joined_crcs(crcs.to_numpy(), 4 * sizes, firsts)
    return pa.StructArray.from_arrays([pa.array(np.add.reduceat(sizes, firsts)), pa.array(whole.astype(np.int64)), pa.array(roots, pa.binary())], fields=list(ASSEMBLED))


def check_manifest(spark, folder: str) -> None:
    """Raises where the recipes are not those that the manifest, or the manifest not the one that the head tells of."""
    stored = spark.read.parquet(f"{folder}/manifest")
    head = spark.read.parquet(f"{folder}/head").first()
    if head is None or tuple(head) != _head(stored):
        raise ValueError("the manifest is not the one that the head of the store tells of")
    found = _listed(spark.read.parquet(f"{folder}/recipes"))
    told = lambda df, name: df.select("part", F.struct(*MANIFEST.names).alias(name))
    both = told(stored, "a").join(told(found, "b"), "part", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    if broken := both.select("part").take(1):
        raise ValueError(f"the recipes of part {broken[0][0]} are not those that the manifest tells of")


def read_store(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a store.

    Everything is checked on the way: the recipes against manifest and head at once, and, as rows are made, that each chunk is there
    and has its address and that each document is as long, and has the root, that its recipe says. What does not hold raises.
    """
    check_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    facts = _read(spark, f"{folder}/kind=chunk", "dest binary, width int, ids binary").mapInArrow(_chunk_facts, "digest binary, crc long, n long")
    used = recipes.select("row", F.posexplode("chunks").alias("k", "digest"))
    lost = F.raise_error(F.concat(F.lit("no chunk has the address "), F.lower(F.hex("digest"))))
    # of a chunk in very many documents the rows to be joined are split by AQE: its facts are one row
    pieces = used.join(facts, "digest", "left").withColumn("n", F.when(F.col("n").isNull(), lost).otherwise(F.col("n")))
    built = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "crc", "n"))).alias("pieces")).select(F.col("row").alias("of"), _assembled("pieces").alias("got"))

    manifest = spark.read.parquet(f"{folder}/manifest")
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.select(F.col("part").alias("of_part"), base.alias("base"))
    here = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "doc_id", "row", "n_tokens", "root").withColumn("ahead", F.coalesce(F.sum("n_tokens").over(here), F.lit(0)))
    placed = placed.join(bases, placed.part == bases.of_part)
    sound = (F.col("got.n") == F.col("n_tokens")) & (F.col("got.root") == F.col("root"))
    broken = F.raise_error(F.concat(F.lit("the chunks of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" are not those of its recipe")))
    whole = F.when(sound, F.col("n_tokens")).otherwise(broken)
    return placed.join(built, placed.row == built.of, "left").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), whole.alias("n_tokens"), F.col("got.crc").alias("ids_crc32"))


def stored(docs: DataFrame, vocabulary: str | None = None, remembered: int | None = None) -> DataFrame:
    """Writes ``docs`` to a store in the shared folder and reads it back. ``remembered``: how many units a worker keeps, where memory is
    short; what it forgets costs time only."""
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, scratch_path(spark, "idstore"), vocabulary, remembered=remembered))
