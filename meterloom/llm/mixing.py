"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Points of the golden-ratio sequence are mapped through the sources' cumulative weights, so that every stretch of slots holds each
source in its share. Slots are ranked within their source, the source's documents are shuffled by a hash and cut into blocks of
equal numbers of words, and the k-th slot of a source takes its k-th block, starting again when the blocks run out.

A document's place in its source is a prefix sum over hash buckets, and a slot's rank one over stretches of slots: no source,
however large, is sorted or counted by one task. Sources are one row each; they are joined by way of a written table, so Spark
broadcasts them only where that table is small.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a source of size 0 has
target 0; repeated rows are documents of their own; an empty table gives no rows; other columns are neither read nor changed. The
schedule depends on the seed and the rows alone, so a second run agrees with the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import WORD, free_name
from meterloom.session import cut

WEIGHTS = (5, 2, 1)
CAP = 3
SLOTS = 1 << 20  # slots of a schedule, about; a block is the total over this many
LEAST_BLOCKS = 256  # of a source, so that a small one is met closely too
BUCKETS = 1 << 12  # hash buckets in which a source's documents are placed
STRETCH = 1 << 16  # slots that are ranked together
CELLS = 1 << 12
GOLDEN = 0.6180339887498949


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each source.

    Weights repeat over the sources by code point, null last. Targets share all sizes by weight; one that would pass ``cap`` times
    its source's size stops there and the others share the rest, which is the level at which a pool under these lids stands.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_lid = Window.orderBy(F.col("lid") / F.col("weight"), "rank")
    before = by_lid.rowsBetween(Window.unboundedPreceding, -1)
    after = by_lid.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("lid", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(whole))
    left = F.col("total") - F.coalesce(F.sum("lid").over(before), F.lit(0))
    stopped = ranked.withColumn("stops", F.col("lid").cast("double") * F.sum("weight").over(after) <= left.cast("double") * F.col("weight"))
    free = F.when(~F.col("stops"), F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("lid"))).over(whole), F.lit(0))
    level = rest.cast("double") / F.sum(free).over(whole)
    target = F.when(F.col("stops"), F.col("lid").cast("double")).otherwise(level * F.col("weight"))
    return stopped.select("source", F.col("rank").alias("s"), "source_size", target.alias("target"), "total")


def _planned(sources: DataFrame, slots: int) -> DataFrame:
    """Adds to each source its number of blocks, its share of the slots, as a stretch of [0, 1), and the number of all slots."""
    block = F.greatest(F.lit(1), F.ceil(F.col("total") / slots))
    n_blocks = F.greatest(F.ceil(F.col("source_size") / block), F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))).cast("long")
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    up_to = F.sum("wanted").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("wanted").over(Window.partitionBy())
    return sources.withColumn("n_blocks", n_blocks).withColumn("wanted", wanted).withColumn("all", whole).withColumn("hi", up_to / F.col("all")).withColumn("lo", (up_to - F.col("wanted")) / F.col("all")).withColumn("n_slots", F.round("all").cast("long"))


def schedule(sources: DataFrame, n_slots: int, cap: int = CAP) -> DataFrame:
    """slot, s, block, epoch: what each slot of the mix takes. ``sources`` as from _planned, written."""
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = sources.where("wanted > 0").select("s", "lo", "hi", "n_blocks", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN) + 0.5
    slots = sources.sparkSession.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", cell(F.col("u")))
    last = F.col("hi") > 1 - 1e-12
    placed = slots.join(spans, "cell").where((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | last)).withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    here = Window.partitionBy("s", "stretch").orderBy("slot")
    ahead = Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("s", "stretch").count().withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    ranked = placed.withColumn("k", F.row_number().over(here) - 1).join(counts, ["s", "stretch"]).withColumn("k", F.col("k") + F.col("ahead"))
    taken = ranked.where(F.col("k") < cap * F.col("n_blocks"))  # a slot or two past the lid, by discrepancy
    return taken.select("slot", "s", (F.col("k") % F.col("n_blocks")).alias("block"), F.floor(F.col("k") / F.col("n_blocks")).alias("epoch"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, slots: int = SLOTS, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash, one row per row of ``docs``."""
    told = F.xxhash64("text")
    sized = cut(docs.select("doc_id", "source", words("text").alias("size"), told.alias("text_hash"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "sized")
    sources = cut(_planned(targets(sized, weights, cap), slots), "sources")
    n_slots = sources.agg(F.max("n_slots")).first()[0] or 0

    times = schedule(sources, n_slots, cap).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))

    docs_of = sized.join(sources.select(F.col("source").alias("of"), "s", "source_size", "target", "n_blocks"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bucket = F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1)
    docs_of = docs_of.withColumn("bucket", bucket)
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs_of.groupBy("s", "bucket").agg(F.sum("size").alias("sum")).withColumn("ahead", F.coalesce(F.sum("sum").over(ahead), F.lit(0))).drop("sum")
    first = (F.coalesce(F.sum("size").over(here), F.lit(0)) + F.col("ahead")).alias("first")
    placed = docs_of.join(sums, ["s", "bucket"]).select("doc_id", "source", "size", "source_size", "target", "text_hash", "s", "n_blocks", first)

    block_of = lambda word: F.expr(f"(({word} + 1) * n_blocks - 1) div source_size")
    edge = lambda block: F.expr(f"({block}) * source_size div n_blocks")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("first"), block_of("first + size - 1"))))
    inside = F.least(F.col("first") + F.col("size"), edge("block + 1")) - F.greatest(F.col("first"), edge("block"))
    keys = ["doc_id", "source", "size", "source_size", "target", "text_hash"]
    counted = pieces.withColumn("inside", inside).join(times, ["s", "block"], "left").groupBy(*keys, "s", "first").agg(F.sum(F.col("inside") * F.coalesce("times", F.lit(0))).alias("taken"))
    nothing = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return counted.select(*keys, "taken").unionByName(nothing)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix, each with all its columns, as often as the mix takes it, rounded: only the document at which a source's
    last pass ends is taken in part. Rows alike in id, source and text share what they take."""
    took = mix(docs, **how).groupBy("doc_id", "source", "text_hash").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("copies"))
    names = {c: free_name(docs, f"mix_{c}") for c in ("doc_id", "source", "text_hash", "copies")}
    took = took.where("copies > 0").select(*(F.col(c).alias(n) for c, n in names.items()))
    hashed = docs.withColumn(free_name(docs, "own_hash"), F.xxhash64("text"))
    own = hashed.columns[-1]
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(own) == F.col(names["text_hash"]))
    n = free_name(docs, "copy_number")
    return hashed.join(took, same).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*docs.columns)
