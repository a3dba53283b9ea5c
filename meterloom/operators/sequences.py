"""Step sequences: scope, repeated edits, what follows a failure, and how sequences end. All windows are partitioned by sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("session_id", "member", "timeline")
AFTER = 10  # step positions after a failure that count as its aftermath
OPEN_SECONDS = 3600  # a sequence whose last step is so close to the newest may still run
LEAST_EDITS, LEAST_SEQUENCES = 10, 7


def scoped(steps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Steps with the scope and project of their sequence, and their position in it from 1."""
    about = sessions.select("session_id", "member", "entrypoint", "project")
    scope = F.when(F.col("timeline") != "", "subagent").when(F.col("entrypoint") == "cli", "interactive").when(F.col("entrypoint").isin("sdk-py", "sdk-cli"), "programmatic").otherwise("unstated")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("ordinal", "dedupe_key"))
    return steps.join(about, ["session_id", "member"], "left").withColumn("scope", scope).withColumn("project", F.coalesce("project", F.lit(""))).withColumn("pos", place).drop("entrypoint")


def scopes(steps: DataFrame, sessions: DataFrame) -> DataFrame:
    return scoped(steps, sessions).groupBy("scope").agg(F.countDistinct(F.struct(*KEY)).alias("n_sequences"), F.count(F.lit(1)).alias("n_steps"))


def repeat_edits(steps: DataFrame) -> DataFrame:
    """Of each sequence its edits with a target, those that went back to a file after a command ran, and edits without a target."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    same = Window.partitionBy(*KEY, "kind", "target_ref").orderBy("pos")
    commands = F.sum((F.col("kind") == "command").cast("long")).over(order)
    aimed = (F.col("kind") == "edit") & (F.col("target_ref") > 0)
    marked = steps.withColumn("commands", commands).withColumn("before", F.lag("commands").over(same))
    count = lambda c: F.sum(c.cast("long"))
    return marked.groupBy(*KEY, "project").agg(count(aimed).alias("edits"), count(aimed & F.coalesce(F.col("commands") > F.col("before"), F.lit(False))).alias("repeats"), count((F.col("kind") == "edit") & (F.col("target_ref") == 0)).alias("untargeted"))


def deviation(values: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """One row: n, median, sigma of a column. Sigma is the median absolute deviation over 0.6745, else the mean one times 1.253314;
    ``whole`` cuts the median to an integer first."""
    middle = values.agg(F.count(F.lit(1)).alias("n"), F.percentile(column, 0.5).alias("median")).withColumn("median", F.floor("median").cast("double") if whole else F.col("median")).withColumn("one", F.lit(1))
    apart = values.withColumn("one", F.lit(1)).join(middle, "one").withColumn("apart", F.abs(F.col(column) - F.col("median")))
    sigma = F.when(F.percentile("apart", 0.5) > 0, F.percentile("apart", 0.5) / 0.6745).otherwise(F.avg("apart") * 1.253314)
    return apart.agg(F.max("n").alias("n"), F.max("median").alias("median"), sigma.alias("sigma"))


def edit_loops(repeats: DataFrame) -> DataFrame:
    """Sequences whose repeat rate stands above the window's own spread; no verdict without a spread that a sequence could exceed."""
    judged = repeats.where(F.col("edits") >= LEAST_EDITS).withColumn("rate", F.col("repeats") / F.col("edits"))
    spread = deviation(judged, "rate").withColumn("floor", F.col("median") + 3.5 * F.col("sigma")).withColumn("one", F.lit(1))
    top = judged.agg(F.max((F.col("edits") - 1) / F.col("edits")).alias("reachable")).withColumn("one", F.lit(1))
    line = spread.join(top, "one").withColumn("can", (F.col("n") >= LEAST_SEQUENCES) & (F.col("sigma") > 0))
    line = line.withColumn("unreachable", F.col("can") & (F.col("floor") >= F.col("reachable"))).withColumn("spread", F.col("can") & ~F.col("unreachable"))
    out = judged.withColumn("one", F.lit(1)).join(line, "one").where(F.col("spread") & (F.col("rate") > F.col("floor"))).agg(F.count(F.lit(1)).alias("outliers"), F.coalesce(F.sum("edits"), F.lit(0)).alias("outlier_edits")).withColumn("one", F.lit(1))
    whole = repeats.agg(*(F.sum(c).alias(c) for c in ("edits", "repeats", "untargeted")), F.sum(((F.col("edits") < LEAST_EDITS) & (F.col("edits") + F.col("untargeted") > 0)).cast("long")).alias("thin")).withColumn("one", F.lit(1))
    return whole.join(line.select("one", F.col("n").alias("judged"), F.round("floor", 6).alias("floor"), F.col("spread").cast("int").alias("spread"), F.col("unreachable").cast("int").alias("unreachable")), "one").join(out, "one").drop("one").withColumn("repeat_rate", F.round(F.when(F.col("edits") == 0, 0.0).otherwise(F.col("repeats") / F.col("edits")), 6))


def aftermath_steps(steps: DataFrame) -> DataFrame:
    """Steps with whether an assistant turn follows a failure closely, and whether context was lost before."""
    earlier = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("outcome").isin("error", "denied")
    lost = F.col("kind") == "compaction"
    last = F.max(F.when(failed | lost, F.col("pos"))).over(earlier)
    return steps.withColumn("failed", failed & ~lost).withColumn("after", F.coalesce(F.col("pos") - last <= AFTER, F.lit(False))).withColumn("compacted", F.coalesce(F.max(lost).over(earlier), F.lit(False)))


def aftermath(steps: DataFrame) -> DataFrame:
    turn = F.col("kind") == "assistant"
    count = lambda c: F.sum(c.cast("long"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    out = aftermath_steps(steps).agg(F.count(F.lit(1)).alias("n_steps"), count(turn).alias("turns"), some(turn).alias("tokens"), count(turn & F.col("after")).alias("after_turns"), some(turn & F.col("after")).alias("after_tokens"), count(F.col("failed")).alias("failures"), count(F.col("kind") == "compaction").alias("compactions"), count(F.col("compacted")).alias("steps_after_compaction"))
    rated = (F.col("after_turns") > 0) & (F.col("tokens") > 0)
    return out.withColumn("cost_ratio", F.round(F.when(rated, F.col("after_tokens") / F.col("after_turns") / (F.col("tokens") / F.col("turns"))), 6))


def endings(steps: DataFrame, newest: DataFrame) -> DataFrame:
    """How sequences end. ``newest`` has the newest time of the whole set, not of the scope alone."""
    last = steps.groupBy(*KEY).agg(F.max(F.struct("pos", "ts", "outcome")).alias("last")).select("last.*").withColumn("one", F.lit(1))
    joined = last.join(newest.select(F.max("ts").alias("newest")).withColumn("one", F.lit(1)), "one")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    still = seconds("ts") >= seconds("newest") - OPEN_SECONDS
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return joined.agg(F.count(F.lit(1)).alias("n_sequences"), count(still).alias("open"), count(~still & F.col("outcome").isin("error", "denied")).alias("abandoned"))
