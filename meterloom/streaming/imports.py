"""Importing usage records from a landing folder, each input once (logs: see ``growing``).

Every micro-batch appends what it read under its own number and overwrites that on a replay, so a run that stops anywhere resumes
without loss or repetition. Offers of one (tool, dedupe_key) are merged when the store is read, by the rules of ``etl.restate``: the
vendor's counts can only grow, what is derived is as last derived. Rows are kept by hash buckets of their key, so a merge, or a
``compact`` of the store, moves no row between buckets.

Defined results: a record that is refused goes to the quarantine with its reason and never to the store; a line that is no record is
quarantined as malformed; an empty landing folder changes nothing; repeated offers change nothing but what they restate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meterloom.operators import etl
from meterloom.schema import USAGE

BUCKETS = 64
FILES = 1000  # of a micro-batch
BROKEN = "_broken"
LANDED = StructType([*USAGE.fields, StructField(BROKEN, StringType())])
SEQ = "struct<batch:long,at:timestamp,n:long>"


def merge_batch(records: DataFrame, batch: int, store: str, now: str) -> None:
    """Appends the sound records of a batch to the store and the others to its quarantine. ``records`` may have the columns ``_broken``
    (the text of what could not be read) and ``_at`` (when it arrived)."""
    named = set(records.columns)
    rows = records if BROKEN in named else records.withColumn(BROKEN, F.lit(None).cast("string"))
    rows = rows if "_at" in named else rows.withColumn("_at", F.lit(None).cast("timestamp"))
    empty = {f.name: F.coalesce(F.col(f.name), F.lit("" if f.dataType.typeName() == "string" else 0).cast(f.dataType)) for f in USAGE.fields if f.name != "ts"}
    rows = rows.withColumns(empty)
    lacking = F.when(F.col(BROKEN).isNotNull() | F.col("ts").isNull(), "malformed")
    seq = F.struct(F.lit(batch).cast("long").alias("batch"), F.col("_at").alias("at"), F.monotonically_increasing_id().alias("n"))
    judged = rows.withColumn("reason", F.coalesce(lacking, etl.reject_reason(now))).withColumn("seq", seq)
    judged.persist()
    try:
        bucket = F.pmod(F.xxhash64("tool", "dedupe_key"), F.lit(BUCKETS)).alias("bucket")
        sound = judged.where("reason IS NULL").select(*USAGE.names, "seq", F.lit(batch).alias("batch"), bucket)
        # only this batch's own folders are written over, so a replay leaves others alone
        sound.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{store}/usage")
        refused = judged.where("reason IS NOT NULL").select(*USAGE.names, BROKEN, "reason", F.lit(batch).alias("batch"))
        refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/quarantine")
    finally:
        judged.unpersist()


def import_pushed(spark: SparkSession, landing: str, store: str, now: str, files: int = FILES) -> None:
    """Reads what has landed since the last run, JSON lines of records, and stops."""
    read = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", BROKEN).json(landing)
    _run(read.withColumn("_at", F.col("_metadata.file_modification_time")), store, lambda batch, n: merge_batch(batch, n, store, now), "pushed")


def _run(read: DataFrame, store: str, merge: Callable[[DataFrame, int], None], name: str) -> None:
    query = read.writeStream.foreachBatch(merge).option("checkpointLocation", f"{store}/checkpoint-{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def usage(spark: SparkSession, store: str) -> DataFrame:
    """The records of a store, one of each (tool, dedupe_key)."""
    return etl.restate(offers(spark, store), offers(spark, store).limit(0))


def offers(spark: SparkSession, store: str) -> DataFrame:
    found = spark.read.parquet(f"{store}/usage")
    return found.drop("batch", "bucket")


def quarantine(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/quarantine")


def compact(spark: SparkSession, store: str, into: str) -> str:
    """A new store with one offer of each key, as good as all that were made; the batches of the old one stay numbered below the next."""
    first = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("n"))
    bucket = F.pmod(F.xxhash64("tool", "dedupe_key"), F.lit(BUCKETS)).alias("bucket")
    usage(spark, store).select(*USAGE.names, first.alias("seq"), F.lit(-1).alias("batch"), bucket).repartition("bucket").write.partitionBy("batch", "bucket").parquet(f"{into}/usage")
    return into


def usage_daily_stream(spark: SparkSession, landing: str, late: str = "3 days") -> DataFrame:
    """day, tool and sums of the records that land, as a stream that gives a day once no more of it can come; later records are
    dropped. An addition: the batch reports are by stored records and take in what comes late."""
    read = spark.readStream.schema(USAGE).json(landing).withColumn("at", F.col("ts").cast("timestamp"))
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "lines_added")]
    daily = read.withWatermark("at", late).groupBy(F.window("at", "1 day"), "tool").agg(F.count(F.lit(1)).alias("records"), *sums)
    return daily.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tool", "records", *(c for c in daily.columns if c not in ("window", "tool", "records")))
