"""Benchmark decontamination by rare seeds and local alignment (operator 5).

1. Texts are read once against the benchmark's seeds; where a text holds enough of an item's, the passage around them is set aside,
   one row per item and place. This is the join of passages to items: the items are sent to the readers in slices of at most
   ``SLICE_WORDS`` words each, however large the benchmark is.
2. Every passage is aligned with the item's words by Smith-Waterman; the score over that of a verbatim copy tells verbatim, edited and
   paraphrased copies from chance. Of an item with more than ``RARE`` passages, equal ones are aligned once.

Seeds are pairs of words with at most one word between, in the item and in the text. They leave no copy out: an alignment of m matches
and e errors that scores half of the L matches of a verbatim copy has 2 m - e >= L, so at least L / 2 - 1 of its m - 1 steps from match
to match hold one error at most, and it spans no more than 2 L words. Of the item's L - 1 places for such a step the commonest are
left out, as many as still leave ``SEEDS`` of the steps to be found, so rare pairs alone decide. Items of one or two words are found by
single words.

Words are lower-cased and stripped of ASCII punctuation; seeds do not cross texts.

Defined results: null or empty texts hold nothing; an item without words is never found; repeated rows are each reported; an empty benchmark or table gives no rows; other columns are neither
read nor changed. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from meterloom.llm.common import SLICE, free_name
from meterloom.llm.common import plain_words as words
from meterloom.session import cut

SEEDS = 3  # to be found of an item
RARE = 1000
LEAST_SCORE = 0.5  # of a verbatim copy's score
SLICE_WORDS = 1 << 21  # benchmark words sent to the readers at once
MATCH, MISMATCH, GAP = 2, -1, -1
BASE = np.uint64(0x9E3779B97F4A7C15)

HIT = StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("passage", StringType())])
HITS = ArrayType(HIT)
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("passage", pa.string())]))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """Hashes of words, equal within one process: an index is built where it is used."""
    return np.fromiter(map(hash, found), np.int64, len(found)).astype(np.uint64)


def _pairs(hashes: np.ndarray, gap: int) -> np.ndarray:
    """The hash of each word with the one ``gap`` words on; of single words where it is 0."""
    mixed = hashes[: len(hashes) - gap] * BASE + (hashes[gap:] if gap else np.uint64(1))
    return (mixed ^ (mixed >> np.uint64(29))) * BASE


class Index:
    """The seeds of a slice of the benchmark. Built in each worker from the items' texts."""

    def __init__(self, items: list[tuple[int, str]]):
        held = [(item_id, found) for item_id, text in items if (found := words(text or ""))]
        self.ids = [item_id for item_id, _ in held]
        self.lengths = np.array([len(found) for _, found in held], np.int64)
        self.need = np.clip((self.lengths + 1) // 2 - 1, 1, SEEDS)
        told = []  # (seed, item, place in the item)
        for k, (_, found) in enumerate(held):
            hashes = word_hashes(found)
            for gap in (1, 2) if len(found) > 2 else (0,):
                seeds = _pairs(hashes, gap)
                told.append((seeds, np.full(len(seeds), k), np.arange(len(seeds))))
        seed, item, place = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
        _, which, often = np.unique(seed, return_inverse=True, return_counts=True)
        # of each item's places the commonest are left out
        first = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        common = np.bincount(first[item] + place, often[which], first[-1])
        keep = np.ones(first[-1], bool)
        for k, length in enumerate(self.lengths.tolist()):
            spare = (length + 1) // 2 - 1 - int(self.need[k])
            if spare > 0:
                keep[first[k] + np.argsort(-common[first[k] : first[k] + length - 1], kind="stable")[:spare]] = False
        kept = keep[first[item] + place]
        entries = np.unique(np.stack([seed[kept].view(np.int64), item[kept]]), axis=1)  # a seed twice in an item is one entry
        order = np.argsort(entries[0].view(np.uint64), kind="stable")
        seed, self.item = entries[0].view(np.uint64)[order], entries[1][order]
        self.seeds, self.first, self.n = np.unique(seed, return_index=True, return_counts=True)
        self.gaps = sorted({gap for length in self.lengths.tolist() for gap in ((1, 2) if length > 2 else (0,))})
        self.may = np.zeros(1 << 22, bool)
        self.may[self.seeds >> np.uint64(42)] = True

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Of each text, (item, first word, passage) of each place where it holds enough of an item's seeds close together."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        split = [words(text) for text in texts]
        if not len(self.seeds):
            return out
        hashes = word_hashes([w for found in split for w in found])
        sizes = np.array([len(found) for found in split], np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        items, at = [], []
        for gap in self.gaps:
            if len(hashes) > gap:
                seeds = _pairs(hashes, gap)
                k = np.flatnonzero(self.may[seeds >> np.uint64(42)] & (text_of[: len(seeds)] == text_of[gap:]))
                to = np.minimum(np.searchsorted(self.seeds, seeds[k]), len(self.seeds) - 1)
                same = self.seeds[to] == seeds[k]
                k, to = k[same], to[same]
                n = self.n[to]
                at.append(np.repeat(k, n))
                items.append(self.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[to], n)])
        if not at:
            return out
        both = np.unique(np.concatenate(items) * (len(hashes) + 1) + np.concatenate(at))  # by item, then by word
        item, at = both // (len(hashes) + 1), both % (len(hashes) + 1)
        start = np.flatnonzero(np.arange(len(item)) + self.need[item] <= len(item))
        last = start + self.need[item[start]] - 1
        close = (item[last] == item[start]) & (text_of[at[last]] == text_of[at[start]]) & (at[last] - at[start] < 2 * self.lengths[item[start]])
        begun = np.cumsum(sizes) - sizes
        now: list[int] | None = None

        def end() -> None:
            k, a, b = now
            reach, text = 2 * int(self.lengths[k]), int(text_of[a])
            a, b = max(0, a - int(begun[text]) - reach), b - int(begun[text]) + reach
            out[text].append((self.ids[k], a, b" ".join(split[text][a:b]).decode("utf-8", "surrogatepass")))

        for k, a, b in zip(item[start[close]].tolist(), at[start[close]].tolist(), at[last[close]].tolist(), strict=True):
            if now and now[0] == k and text_of[now[1]] == text_of[a] and a - now[2] <= 2 * int(self.lengths[k]):
                now[2] = b
            else:
                if now:
                    end()
                now = [k, a, b]
        if now:
            end()
        return out


def align(item: list[bytes], passage: list[bytes]) -> float:
    """The Smith-Waterman score of the best local alignment of words, over that of a verbatim copy. Gaps cost a word each, so a row
    of the table is one running maximum over the row before."""
    if not item or not passage:
        return 0.0
    known: dict[bytes, int] = {}
    a = [known.setdefault(w, len(known)) for w in item]
    b = np.array([known.get(w, -1) for w in passage])
    slope = -GAP * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for word in a:
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best / (MATCH * len(a))


def _slices(benchmark: DataFrame):
    """The benchmark's items in slices of bounded size, one after another."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = row["text"] or ""
        if held and size + len(text) > SLICE_WORDS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def _passages(docs: DataFrame, items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    held: dict[str, Index] = {}

    def find(column: pa.Array) -> pa.Array:
        index = held.get("index") or held.setdefault("index", Index(sent.value))
        rows = []
        for at in range(0, len(column), SLICE):
            found = index.hits([text or "" for text in column.slice(at, SLICE).to_pylist()])
            rows += [[{"item_id": i, "start": s, "passage": p} for i, s, p in hits] for hits in found]
        return pa.array(rows, _HIT)

    found = docs.withColumn("hits", F.arrow_udf(find, HITS).asNondeterministic()(F.col("text")))
    return found.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode("hits").alias("h")).select("doc_id", "text_hash", "h.*")


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start, passage: places in texts that share seeds with an item, written."""
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    parts = [_passages(told, items) for items in _slices(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType([StructField("doc_id", LongType()), StructField("text_hash", LongType()), *HIT.fields]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return cut(whole, "passages")


@F.arrow_udf(DoubleType())
def _score(items: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for at in range(0, len(items), 256):
        out += [align(words(i or ""), (p or "").encode("utf-8", "surrogatepass").split()) for i, p in zip(items.slice(at, 256).to_pylist(), found.slice(at, 256).to_pylist(), strict=True)]
    return pa.array(out, pa.float64())


def aligned(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The passages, each with its score."""
    items = benchmark.select(F.col("item_id").cast("long").alias("of_item"), F.col("text").alias("item"))
    # the item's row is found by its id alone; of items that share an id, the first text by order stands
    items = items.groupBy("of_item").agg(F.min("item").alias("item"))

    def scored(some: DataFrame) -> DataFrame:
        return some.join(items, F.col("item_id") == F.col("of_item")).withColumn("score", _score("item", "passage")).drop("of_item", "item")

    hot = cut(found.groupBy("item_id").count().where(F.col("count") > RARE).select("item_id"), "hot")
    if hot.isEmpty():
        return scored(found)
    shared = found.join(hot, "item_id", "left_semi")
    once = scored(shared.select("item_id", "passage").distinct())
    return scored(found.join(hot, "item_id", "left_anti")).unionByName(shared.join(once, ["item_id", "passage"]))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), score: each item's best place in each document that holds a copy of it. ``least`` is
    LEAST_SCORE or more, for which the seeds are made."""
    scored = aligned(passages(docs, benchmark), benchmark).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "item_id").orderBy(F.desc("score"), "start"))
    return scored.withColumn("k", best).where("k = 1").select("doc_id", "text_hash", "item_id", "start", "score")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no copy of an item."""
    names = {c: free_name(docs, f"leak_{c}") for c in ("doc_id", "text_hash")}
    own = free_name(docs, "own_hash")
    leaks = cut(matches(docs, benchmark, **how).select(*(F.col(c).alias(x) for c, x in names.items())).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & (F.col(own) == F.col(names["text_hash"]))
    return docs.withColumn(own, F.xxhash64("text")).join(leaks, same, "left_anti").select(*docs.columns)
