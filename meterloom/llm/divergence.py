"""Source divergence audit by systolic rotation (operator 12).

How far every source's vocabulary lies from every other source's of its language, and which terms set it apart from its language.

Terms are counted once per task before anything is shuffled. A language's kept terms are dealt into shards by hash, so that a tile (a
language's shard) has about ``TILE`` counts whatever the corpus. In a tile the groups are cut into blocks of ``GROUPS``; a block stays
where it is and other blocks' compressed vectors come to it in the rounds of a round-robin tournament: in each round every block meets one
other, one of the two travels, and the meeting evaluates both directions. A task holds one resident and one visitor at a time. Terms are
ranked by a heap for each group and tile, of which the last ranking sees ``TOP`` rows at most. Pair sums over tiles are a Spark aggregate.

Whole numbers throughout: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q); p is at most 10^9 + 1, so both fit 64 bits,
and only the product 10^9 (count + 1) is taken in decimals.

Defined results: null text, lang or source is ''; a group without kept terms still has the p of a count of 0 for each term of its language;
a language without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs; every row is a document, so
repeated rows count each time; texts are read whole, whatever their length; ties are ranked by the item's UTF-8 bytes; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import SLICE
from meterloom.session import cut

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
TILE = 1 << 19  # counts of a tile, about
GROUPS = 8  # groups of a block
ENTRIES = 200_000  # counts that a task gathers before it hands them on

#: A-Z in lower case; every other byte below 0x80 that is no letter parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
CHUNKS = "kind string, lang string, shard long, block int, blocks int, terms int, names array<string>, base array<long>, sizes array<int>, body binary, source string, item string, value long"
MEETINGS = "lang string, source string, item string, value long"
_CHUNKS = pa.schema(
    [("kind", pa.string()), ("lang", pa.string()), ("shard", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("terms", pa.int32()), ("names", pa.list_(pa.string()))]
    + [("base", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
)
_MEETINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term and group, as far as this task sees them; the empty term says that a group occurs."""
    seen: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            n[b""] += 0
            names = list(n)
            yield pa.RecordBatch.from_arrays([_strings([lang] * len(names)), _strings([source] * len(names)), _strings(names), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in names], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        columns = [batch.column(c).cast(pa.binary()) for c in ("lang", "source", "text")]
        for at in range(0, batch.num_rows, SLICE):
            for lang, source, text in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True):
                words = terms_of(text or b"")
                n, docs = seen.setdefault((lang or b"", source or b""), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held >= ENTRIES:
                    yield from told()
                    seen.clear()
                    held = 0
    yield from told()


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, total, opens: what each group has of each kept term of its language; total is the language's, opens is true in
    one row of a term. Each group has a row of the empty term besides."""
    named = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    counts = named.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("in_docs"), (F.min("source").over(term) == F.col("source")).alias("opens"))
    return summed.where((F.col("in_docs") >= LEAST_DOCS) | (F.col("term") == "")).drop("in_docs")


def groups_of(kept: DataFrame, tile: int = TILE, groups: int = GROUPS) -> DataFrame:
    """One row per group: its N, its language's N and V, its block, and how many blocks and shards the language has."""
    is_term = F.col("term") != ""
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum((is_term & F.col("opens")).cast("long")).alias("opened"), F.sum(is_term.cast("long")).alias("counts"))
    lang = Window.partitionBy("lang")
    return found.select(
        "lang", "source", "own",
        F.sum("own").over(lang).alias("whole"),
        F.sum("opened").over(lang).alias("v"),
        F.expr(f"cast((row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {groups} AS int)").alias("block"),
        F.expr(f"cast((count(*) OVER (PARTITION BY lang) + {groups - 1}) div {groups} AS int)").alias("blocks"),
        F.greatest(F.lit(1), F.expr(f"(sum(counts) OVER (PARTITION BY lang) + {tile - 1}) div {tile}")).alias("shards"),
    )


def _p(count: str, of: str):
    """1 + floor(SCALE (count + 1) / of); 1 where a language has no terms."""
    return F.expr(f"if({of} = 0, 1L, 1L + (cast({SCALE} AS decimal(20,0)) * cast({count} + 1 AS decimal(20,0))) div cast({of} AS decimal(20,0)))")


class _Tile:
    """The rows of one tile, in the order of their terms: first those of the empty term, which name the groups."""

    def __init__(self, lang: str, shard: int):
        self.lang, self.shard, self.terms = lang, shard, 0
        self.groups: list[tuple[int, bytes, int, int]] = []  # block, name, p of a count of 0, blocks
        self.rows: dict[bytes, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        self.names: list[pa.Array] = []
        self.last = None

    def add(self, batch: pa.RecordBatch) -> None:
        term, p = batch.column("term"), batch.column("p").to_numpy(zero_copy_only=False)
        source = batch.column("source").cast(pa.binary()).dictionary_encode()
        sources, code = source.dictionary.to_pylist(), source.indices.to_numpy()
        marks = pc.equal(term, "").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(marks):
            self.groups.append((batch.column("block")[i].as_py(), sources[code[i]], int(p[i]), batch.column("blocks")[i].as_py()))
        real = np.flatnonzero(~marks)
        if not len(real):
            return
        term, p, code = term.take(pa.array(real)), p[real], code[real]
        value = batch.column("value").to_numpy(zero_copy_only=False)[real]
        new = np.ones(len(real), bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, len(real) - 1)).to_numpy(zero_copy_only=False)
        new[0] = term[0].as_py() != self.last
        self.last = term[-1].as_py()
        ids = np.cumsum(new) - 1 + self.terms
        self.terms += int(new.sum())
        self.names.append(term.filter(pa.array(new)))
        for k in np.unique(code):
            own = code == k
            self.rows[sources[k]].append((ids[own].astype(np.int32), p[own].astype(np.int64), value[own].astype(np.int64)))

    def told(self, top: int) -> Iterator[dict]:
        names = pa.chunked_array(self.names, pa.string()) if self.names else pa.chunked_array([], pa.string())
        blocks = defaultdict(list)
        for block, name, base, n_blocks in self.groups:
            parts = self.rows.pop(name, [])
            ids, p, value = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in range(3))
            blocks[block, n_blocks].append((name, base, ids, p))
            above = np.flatnonzero(value >= 0)
            for lost, item in heapq.nsmallest(top, zip((-value[above]).tolist(), ids[above].tolist(), strict=True)):
                yield {"kind": "term", "lang": self.lang, "source": name.decode("utf-8", "surrogateescape"), "item": names[item].as_py(), "value": -lost}
        for (block, n_blocks), found in sorted(blocks.items()):
            ids = [np.diff(x[2], prepend=0).astype("<i4").tobytes() for x in found]
            body = zlib.compress(b"".join(ids + [x[3].astype("<i4").tobytes() for x in found]), 1)
            names_of = [x[0].decode("utf-8", "surrogateescape") for x in found]
            yield {"kind": "chunk", "lang": self.lang, "shard": self.shard, "block": block, "blocks": n_blocks, "terms": self.terms, "names": names_of, "base": [x[1] for x in found], "sizes": [len(x[2]) for x in found], "body": body}


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted batch that agree in their keys."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in keys:
        column = batch.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
    edges = [*np.flatnonzero(new).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        yield tuple(batch.column(c)[a].as_py() for c in keys), batch.slice(a, b - a)


def _chunked(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key = None, None
        for batch in batches:
            for here, rows in _runs(batch, ("lang", "shard")):
                if here != key:
                    if tile:
                        yield from told(tile)
                    tile, key = _Tile(*here), here
                tile.add(rows)
        if tile:
            yield from told(tile)

    def told(tile: _Tile) -> Iterator[pa.RecordBatch]:
        held = []
        for row in tile.told(top):
            held.append(row)
            if len(held) >= 2000 or row["kind"] == "chunk":
                yield pa.RecordBatch.from_pylist(held, _CHUNKS)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _CHUNKS)

    return run


def chunks_and_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Rows of kind chunk, the compressed vectors of a block in a tile, and of kind term, the best terms of a group in a tile."""
    of = groups.select("lang", "source", "block", "blocks", "shards", "v", F.expr("own + v").alias("of"), F.expr("whole + v").alias("of_whole"))
    counted = kept.where("term <> ''").join(of, ["lang", "source"]).withColumn("p", _p("n", "of")).withColumn("q", _p("total", "of_whole"))
    rows = counted.select("lang", F.expr("pmod(xxhash64(term), shards)").alias("shard"), "term", "source", "block", "blocks", "p", F.expr("if(p > q, ((p - q) * (p - q)) div q, -1L)").alias("value"))
    marks = of.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit("").alias("term"), "source", "block", "blocks", _p("0", "of").alias("p"), F.lit(-1).cast("long").alias("value"))
    dealt = rows.unionByName(marks).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term", "source")
    return dealt.mapInArrow(_chunked(top), CHUNKS)


def travels(chunks: DataFrame) -> DataFrame:
    """Adds home and round: each block at home in round -1, and the rounds in which it travels to another's home.

    With an even number t of places, place b meets (2 round - b) mod (t - 1) in each of t - 1 rounds, and the last place where that is b
    itself. Of two that meet the lower one travels in even rounds, so homes have equally many visits. A place over the blocks is a bye.
    """
    places = F.col("blocks") + F.col("blocks") % 2
    met = F.pmod(2 * F.col("round") - F.col("block"), places - 1)
    other = F.when(F.col("block") == places - 1, F.col("round")).when(met == F.col("block"), places - 1).otherwise(met)
    rounds = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), places - 2)).otherwise(F.array().cast("array<int>"))
    lower_travels = F.col("round") % 2 == 0
    away = chunks.withColumn("round", F.explode(rounds)).withColumn("home", other.cast("int")).where((F.col("home") < F.col("blocks")) & ((F.col("block") < F.col("home")) == lower_travels))
    at_home = chunks.withColumn("round", F.lit(-1)).withColumn("home", F.col("block"))
    return at_home.unionByName(away)


def _far(p, q):
    return (p - q) * (p - q) // q


class _Vectors:
    """A block's vectors, unpacked: ids and p of each group."""

    def __init__(self, row: dict):
        self.terms, self.names, self.base = row["terms"], row["names"], row["base"]
        ends = np.cumsum(row["sizes"])
        body = np.frombuffer(zlib.decompress(row["body"]), "<i4")
        n = int(ends[-1]) if len(ends) else 0
        self.ids = [np.cumsum(x) for x in np.split(body[:n].astype(np.int64), ends[:-1])]
        self.p = [x.astype(np.int64) for x in np.split(body[n:], ends[:-1])]

    def spread(self) -> None:
        """As rows over all terms of the tile, for a resident that visitors' ids are looked up in."""
        self.whole = [np.full(self.terms, base, np.int64) for base in self.base]
        self.has = [np.zeros(self.terms, bool) for _ in self.base]
        for k, ids in enumerate(self.ids):
            self.whole[k][ids] = self.p[k]
            self.has[k][ids] = True


def _meeting(home: _Vectors, i: int, away: _Vectors, j: int) -> tuple[int, int]:
    """The sums of f over the tile's terms: of home's group against away's, and of away's against home's."""
    p, q = home.whole[i][away.ids[j]], away.p[j]
    both = home.has[i][away.ids[j]]
    base_i, base_j, own, shared = home.base[i], away.base[j], home.p[i], p[both]
    neither = home.terms - len(own) - len(q) + len(shared)
    there = int(_far(p, q).sum() + _far(own, base_j).sum() - _far(shared, base_j).sum()) + neither * _far(base_i, base_j)
    back = int(_far(q, p).sum() + _far(base_j, own).sum() - _far(base_j, shared).sum()) + neither * _far(base_j, base_i)
    return there, back


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    home = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            met = _Vectors(row)
            if row["round"] < 0:
                home = met
                home.spread()
                pairs = [(i, j) for i in range(len(home.names)) for j in range(i)]
            else:
                pairs = [(i, j) for i in range(len(home.names)) for j in range(len(met.names))]
            out = []
            for i, j in pairs:
                there, back = _meeting(home, i, met, j)
                out += [(row["lang"], home.names[i], met.names[j], there), (row["lang"], met.names[j], home.names[i], back)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MEETINGS, strict=True)], schema=_MEETINGS)


def audit(docs: DataFrame, top: int = TOP, tile: int = TILE, groups: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the language, part ``term`` the first ``top`` terms."""
    kept = cut(kept_counts(docs), "kept")
    found = cut(groups_of(kept, tile, groups), "groups")
    parts = cut(chunks_and_terms(kept, found, top), "chunks")
    moved = travels(parts.where("kind = 'chunk'").select("lang", "shard", "block", "blocks", "terms", "names", "base", "sizes", "body"))
    met = moved.repartition("lang", "shard", "home").sortWithinPartitions("lang", "shard", "home", "round").mapInArrow(_meet, MEETINGS)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = parts.where("kind = 'term'").select("lang", "source", "item", "value", F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", "part", "item", "value", place.alias("rank")).unionByName(terms.select("lang", "source", "part", "item", "value", place.alias("rank")).where(F.col("rank") <= top))
    return ranked
