"""The day-grain cube, sessions and the other fixed aggregates over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.pricing import cost, priced, tokens
from meterloom.schema import DIMS, SUMS

GAP_SECONDS = 1800  # longest pause that still counts as work
SMALL_TURN = 300


def window(usage: DataFrame, since: str) -> DataFrame:
    """A lower bound only: the window has no upper end."""
    return usage.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


def labelled(usage: DataFrame, labels: DataFrame) -> DataFrame:
    joined = usage.join(labels, ["session_id", "member"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("task", "outcome", "difficulty")})


def with_label(usage: DataFrame, labels: DataFrame, task: str = "", outcome: str = "", difficulty: str = "") -> DataFrame:
    """The rows whose session has these labels; an empty one means any."""
    for column, value in (("task", task), ("outcome", outcome), ("difficulty", difficulty)):
        if value:
            labels = labels.where(F.col(column) == value)
    return usage.join(labels, ["session_id", "member"], "left_semi") if task or outcome or difficulty else usage


def cube(usage: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return usage.groupBy(*DIMS, *more).agg(*(F.sum(c).alias(c) for c in SUMS))


def priced_cube(usage: DataFrame, prices: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The cube with tokens, cost (null if unpriced) and unpriced tokens of each row."""
    rows = priced(cube(usage, more), prices).withColumn("tokens", tokens()).withColumn("cost", cost())
    return rows.withColumn("unpriced_tokens", F.when(F.col("cost").isNull(), F.col("tokens")).otherwise(F.lit(0)))


def active_minutes(usage: DataFrame) -> DataFrame:
    """session_id, member, active_minutes: pauses between turns up to the longest allowed. Sessions have thousands of turns at most,
    and the window's partitions are sessions."""
    turns = usage.where("granularity = 'turn'").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("session_id", "member").orderBy("at"))
    kept = turns.withColumn("gap", gap).where(F.col("gap") <= GAP_SECONDS)
    return kept.groupBy("session_id", "member").agg((F.sum("gap") / 60).alias("active_minutes"))


def sessions(usage: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    turn = F.col("granularity") == "turn"
    rows = usage.groupBy("session_id", "member").agg(
        *(F.max(c).alias(c) for c in ("project", "tool", "model", "entrypoint")), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(turn, 1).otherwise(0)).alias("turns"), F.sum("output_tokens").alias("output_tokens"),
        F.coalesce(F.max(F.when(turn, F.col("cache_read_tokens") + F.col("input_tokens"))), F.lit(0)).alias("peak_context"),
        F.sum("edits").alias("edits"), F.sum("compactions").alias("compactions"),
    )
    rows = rows.join(active_minutes(usage), ["session_id", "member"], "left").withColumn("active_minutes", F.coalesce("active_minutes", F.lit(0.0)))
    return labelled(rows, labels) if labels is not None else rows


def delegation(usage: DataFrame, narrowed: DataFrame | None = None) -> DataFrame:
    """Tokens of sub-agents and of all. If any row of the window bears the sidechain mark, marks tell; else the keys of aggregates do."""
    marked = usage.agg(F.coalesce(F.max("sidechain"), F.lit(0)).alias("marked"))
    by_key = (F.col("tool") == "claude-code") & (F.col("dedupe_key").startswith("agent:") | F.col("dedupe_key").contains(":agent:"))
    sums = (usage if narrowed is None else narrowed).agg(
        F.coalesce(F.sum(F.when(F.col("sidechain") == 1, tokens())), F.lit(0)).alias("by_mark"),
        F.coalesce(F.sum(F.when(by_key, tokens())), F.lit(0)).alias("by_key"),
        F.coalesce(F.sum(tokens()), F.lit(0)).alias("total_tokens"),
    )
    one = F.lit(1).alias("one")
    both = sums.select("*", one).join(marked.select("*", one), "one")  # one row beside one row
    return both.select(F.when(F.col("marked") == 1, F.col("by_mark")).otherwise(F.col("by_key")).alias("subagent_tokens"), "total_tokens")


def attribution(usage: DataFrame, by: str) -> DataFrame:
    return usage.where(F.col(by) != "").groupBy(F.col(by).alias("name")).agg(F.sum(tokens()).alias("tokens"), F.sum("lines_added").alias("lines_added"), F.count(F.lit(1)).alias("n_records"), F.countDistinct("session_id").alias("n_sessions"))


def turn_sizing(usage: DataFrame, small: int = SMALL_TURN) -> DataFrame:
    said = F.col("output_tokens") > 0
    return usage.where("granularity = 'turn'").groupBy("model").agg(F.sum(F.when(said, 1).otherwise(0)).alias("turns"), F.sum(F.when(said & (F.col("output_tokens") < small), 1).otherwise(0)).alias("small_turns"))


def cache_misses(usage: DataFrame) -> DataFrame:
    return usage.where("cache_miss_reason <> ''").groupBy("tool", "cache_miss_reason").agg(F.count(F.lit(1)).alias("n"))


def subpaths(usage: DataFrame, project: str) -> DataFrame:
    return usage.where(F.col("project") == project).groupBy("subpath").agg(F.sum("lines_added").alias("lines_added"), F.countDistinct("session_id").alias("n_sessions"))


def session_signals(usage: DataFrame) -> DataFrame:
    return usage.select("session_id", "member", "git_branch", "skill", "agent", "entrypoint").distinct()


def latest_session(usage: DataFrame, project: str = "") -> DataFrame:
    rows = usage.where(F.col("project") == project) if project else usage
    return rows.groupBy("session_id", "member").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "session_id", "member").limit(1)


def matching_sessions(usage: DataFrame, prefix: str) -> DataFrame:
    return usage.where(F.col("session_id").startswith(prefix)).select("session_id", "member").distinct()


def history(usage: DataFrame) -> DataFrame:
    """When each tool's records begin and end, and how many there are."""
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("history_start"), F.max("ts").alias("newest"))


def step_horizon(steps: DataFrame) -> DataFrame:
    return steps.agg(F.count(F.lit(1)).alias("n_steps"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
