"""Steps as a stream with bounded state: offers of a step are merged in state, and a step leaves the state with the horizon.

The watermark stands the horizon behind the newest step, and a step's own time is part of its state's key, so state holds the steps of the
horizon and no others, whatever is offered; what is offered later than that is dropped by the stream, as the store keeps no such step.
Offers of a step name the same time: a call is made once, and only what is known of it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meterloom.operators import etl
from meterloom.schema import STEP_KINDS, STEP_OUTCOMES
from meterloom.streaming.store import STEP, Store

HORIZON = "30 days"
LANDED = StructType([*STEP.fields, StructField("seq", LongType())])
LAST = ("outcome", "target_ref", "tokens", "ordinal", "model")


def merged(offers: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """tool, timeline, dedupe_key and what is known of each step: the last offer by ``seq`` decides, unknown kinds and outcomes are refused.
    ``offers`` is a stream; the result gives a step anew whenever an offer changes it (update mode)."""
    sound = offers.where(F.col("kind").isin(*STEP_KINDS) & F.col("outcome").isin(*STEP_OUTCOMES) & F.col("ts").isNotNull())
    timed = sound.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{horizon} 1 second")  # what is just as old still counts
    keys = ["tool", "timeline", "dedupe_key"]
    last = [F.max_by(c, "seq").alias(c) for c in LAST]
    first = [F.min_by(c, "seq").alias(c) for c in ("session_id", "member", "kind")]
    return timed.groupBy("at", *keys).agg(*last, *first, F.max("seq").alias("seq"))


def stream_steps(spark: SparkSession, landing: str, store: Store, horizon: str = HORIZON, files: int = 1000) -> None:
    """Reads the step offers that have landed since the last run, JSON lines, into the store's steps, and stops."""
    read = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(landing)

    def write(batch: DataFrame, n: int) -> None:
        base = store.newest()
        rows = batch.withColumn("ts", F.col("at").cast("timestamp_ntz")).select(*STEP.names, F.struct(F.col("seq").alias("batch"), F.lit(n).cast("long").alias("n")).alias("seq"))
        kept = rows.persist()
        try:
            if not kept.isEmpty():
                store.change(base, append={"steps": kept})  # a replayed batch offers what is there
        finally:
            kept.unpersist()

    query = merged(read, horizon).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{store.path}/checkpoint-steps").trigger(availableNow=True).start()
    query.awaitTermination()


def kept_steps(steps: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Steps no older than the horizon before the newest of them."""
    newest = steps.agg((F.max("ts") - F.expr(f"interval {horizon}")).alias("_since"))
    return steps.join(F.broadcast(newest), F.col("ts") >= F.col("_since")).drop("_since")  # one row


def prune(store: Store, now: str, days: int):
    """Forgets the store's steps that lie behind the horizon; 0 days keeps all."""
    base = store.newest()
    if not days or not base.tables.get("steps"):
        return base
    return store.change(base, replace={"steps": etl.within_horizon(store.table("steps", base), now, days)})
