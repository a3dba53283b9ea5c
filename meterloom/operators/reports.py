"""Reports over the priced cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.schema import CAPABILITY, answering

REPORT_DIMS = ("day", "project", "tool", "model", "entrypoint", "task", "outcome", "difficulty")
LINE_TOOLS = answering("lines_added", "lines_removed")
REWORK_TOOLS = answering("rework_lines")
ACTIVITY_TOOLS = answering("lines_added", "lines_removed", "edits", "tool_calls", "rework_lines")


def dimension(by: str) -> Column:
    """A report's group; ``member`` is refused: reports are not about persons."""
    if by not in REPORT_DIMS:
        raise ValueError(f"reports are by one of {', '.join(REPORT_DIMS)}, not by {by}")
    return F.when(F.col(by) == "", "unlabeled").otherwise(F.col(by)) if by in ("task", "outcome", "difficulty") else F.col(by)


def report(cube: DataFrame, by: str) -> DataFrame:
    """Tokens, cost and cache use of each group; by day, the cube's rows as they are."""
    numbers = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "lines_added", "tokens", "unpriced_tokens")
    rows = cube.withColumn("name", dimension(by))
    if by == "day":
        out = rows.select("name", "tool", "model", "project", "entrypoint", "member", "granularity", *numbers, "cost")
    else:
        kinds = F.countDistinct("granularity")
        out = rows.groupBy("name").agg(F.when(kinds > 1, "mixed").otherwise(F.max("granularity")).alias("granularity"), *(F.sum(c).alias(c) for c in numbers), F.sum("cost").alias("cost"))
    fresh = F.col("input_tokens") + F.col("cache_read_tokens")
    return out.withColumn("cache_eff", F.round(F.when(fresh != 0, F.col("cache_read_tokens") / fresh), 6)).withColumn("cost", F.round("cost", 9))


def with_total(rows: DataFrame) -> DataFrame:
    """A report's rows by a group, blank names as (unknown), and one of all of them, TOTAL. Its cost is that of the priced rows alone, as
    every row's is; unpriced_tokens says what that leaves out."""
    sums = [c for c, kind in rows.dtypes if kind == "bigint"]
    fresh = F.col("input_tokens") + F.col("cache_read_tokens")
    kinds = F.countDistinct("granularity")
    total = rows.agg(F.when(kinds > 1, "mixed").otherwise(F.max("granularity")).alias("granularity"), *(F.sum(c).alias(c) for c in sums), F.round(F.sum("cost"), 9).alias("cost")).where("granularity IS NOT NULL")
    total = total.withColumn("name", F.lit("TOTAL")).withColumn("cache_eff", F.round(F.when(fresh != 0, F.col("cache_read_tokens") / fresh), 6))
    named = rows.withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", "(unknown)").otherwise(F.col("name")))
    return named.unionByName(total.select(*rows.columns))


def per_100_lines(cost: Column, lines: Column) -> Column:
    return F.when(lines != 0, cost / (lines / 100))


def effectiveness(cube: DataFrame, by: str) -> DataFrame:
    """What each group's spend turned into; the ratio only where its tools record lines."""
    capable = F.col("tool").isin(LINE_TOOLS)
    out = cube.withColumn("name", dimension(by)).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("lines_added", "lines_removed", "edits", "tool_calls", "rejected", "tokens", "unpriced_tokens")), F.sum("cost").alias("cost"), F.max(F.when(F.col("cost").isNull(), 1).otherwise(0)).alias("has_unpriced"), F.max(capable.cast("int")).alias("line_capable"))
    ratio = F.when(F.col("line_capable") == 1, per_100_lines(F.col("cost"), F.col("lines_added")))
    return out.withColumn("cost_per_100_lines", F.round(ratio, 6)).withColumn("cost", F.round("cost", 9))


def movers(cube: DataFrame, by: str, recent: str, prior: str) -> DataFrame:
    """Each group's change from the days from ``prior`` to those from ``recent``, the largest first; a side that is missing is zero."""
    now = F.col("day") >= recent
    then = (F.col("day") >= prior) & ~now
    side = lambda when, c, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    out = cube.where(F.col("day") >= prior).withColumn("name", dimension("project" if by == "day" else by)).groupBy("name").agg(side(now, "cost", "cost_now"), side(then, "cost", "cost_prior"), side(now, "lines_added", "lines_now"), side(then, "lines_added", "lines_prior"), side(now, "tokens", "tokens_now"), side(then, "tokens", "tokens_prior"), side(now, "unpriced_tokens", "unpriced_now"), side(then, "unpriced_tokens", "unpriced_prior"))
    return out.select("name", F.round(F.col("cost_now") - F.col("cost_prior"), 9).alias("delta_cost"), (F.col("lines_now") - F.col("lines_prior")).alias("delta_lines"), F.round("cost_now", 9).alias("cost_now"), F.round("cost_prior", 9).alias("cost_prior"), "lines_now", "lines_prior", "tokens_now", "tokens_prior", "unpriced_now", "unpriced_prior").orderBy(F.abs("delta_cost").desc(), "name")


def _stats(rows: DataFrame, by: str) -> DataFrame:
    out = rows.groupBy(F.col(by).alias("name")).agg(F.sum("lines_added").alias("lines_added"), F.max("day").alias("last_active"), F.sum("cost").alias("cost"), F.max(F.when(F.col("cost").isNull(), 1).otherwise(0)).alias("has_unpriced"))
    return out.withColumn("cost_per_100_lines", F.round(per_100_lines(F.col("cost"), F.col("lines_added")), 6)).withColumn("cost", F.round("cost", 9))


def hot(cube: DataFrame, recent: str, top: int = 5) -> DataFrame:
    """The named projects that cost most lately; unknown cost last."""
    return _stats(cube.where((F.col("day") >= recent) & (F.col("project") != "")), "project").orderBy(F.desc(F.coalesce("cost", F.lit(-1.0))), "name").limit(top)


def going_stale(cube: DataFrame, recent: str, top: int = 5) -> DataFrame:
    named = cube.where("project <> ''")
    lately = named.where(F.col("day") >= recent).select("project").distinct()
    return _stats(named.where(F.col("day") < recent).join(lately, "project", "left_anti"), "project").orderBy(F.desc(F.coalesce("cost", F.lit(-1.0))), "name").limit(top)


def dormant_tools(cube: DataFrame, recent: str) -> DataFrame:
    lately = cube.where(F.col("day") >= recent).select("tool").distinct()
    return _stats(cube.where(F.col("day") < recent).join(lately, "tool", "left_anti"), "tool")


def inventory(cube: DataFrame) -> DataFrame:
    named = F.when(F.col("project") != "", F.col("project"))
    lines = F.col("tool").isin(LINE_TOOLS)
    return cube.agg(F.countDistinct(named).alias("projects"), F.countDistinct("model").alias("models"), F.countDistinct("tool").alias("tools"), F.countDistinct("entrypoint").alias("entrypoints"), F.countDistinct("day").alias("days"), F.sum("lines_added").alias("lines_added"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"), F.sum(lines.cast("int")).alias("line_capable_rows"), F.sum(F.when(lines, F.col("tokens")).otherwise(0)).alias("line_capable_tokens"), F.sum((F.col("project") == "").cast("int")).alias("unattributed"), F.sum(F.col("cost").isNull().cast("int")).alias("unpriced_rows"), F.sum("unpriced_tokens").alias("unpriced_tokens"))


def churn(cube: DataFrame) -> DataFrame:
    rows = cube.where(F.col("tool").isin(REWORK_TOOLS)).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("rework_lines"), F.lit(0)).alias("rework_lines"))
    rate = F.when(F.col("lines_added") == 0, 0.0).otherwise(F.col("rework_lines") / F.col("lines_added"))
    return rows.withColumn("rework_rate", F.round(rate, 6)).withColumn("exceeds", (F.col("rework_lines") > F.col("lines_added")).cast("int"))


def unpriced_models(cube: DataFrame) -> DataFrame:
    return cube.where("cost is null").groupBy("model").agg(F.sum("tokens").alias("tokens"))


def check(cube: DataFrame, max_tokens: int, max_cost: float) -> DataFrame:
    """The budget gate: a cost limit also fails where any usage has no price, since the sum is then a lower bound only."""
    out = cube.agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"), F.sum("unpriced_tokens").alias("unpriced_tokens"))
    return out.withColumn("tokens_breach", (F.col("tokens") > max_tokens).cast("int")).withColumn("cost_breach", ((F.col("cost") > max_cost) | (F.col("unpriced_tokens") > 0)).cast("int"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Medians and shares, each over the sessions whose tool records it."""
    has = {s: F.col("tool").isin(answering(s)) for s in ("turns", "active_minutes", "edits", "compactions")}
    among = lambda s, c: F.when(has[s], c)
    share = lambda s, c: F.coalesce(F.avg(among(s, (F.col(c) > 0).cast("double"))), F.lit(0.0))
    whole = lambda s, c, p: F.round(F.percentile(among(s, F.col(c)) if s else F.col(c), p)).cast("long")
    out = sessions.agg(F.count(F.lit(1)).alias("n_sessions"), *(F.sum(v.cast("int")).alias(f"with_{k}") for k, v in has.items()), whole("turns", "turns", 0.5).alias("median_turns"), whole("turns", "turns", 0.9).alias("p90_turns"), whole(None, "output_tokens", 0.5).alias("median_output"), whole("turns", "peak_context", 0.5).alias("median_peak_context"), F.round(F.percentile(among("active_minutes", F.col("active_minutes")), 0.5), 6).alias("median_active_minutes"), F.round(share("edits", "edits"), 6).alias("code_share"), F.round(share("compactions", "compactions"), 6).alias("compaction_rate"), F.countDistinct(F.to_date("first_ts")).alias("active_days"))
    return out.withColumn("sessions_per_day", F.round(F.col("n_sessions") / F.col("active_days"), 6))


def signal_coverage(cube: DataFrame) -> DataFrame:
    """For each signal, the share of tokens from tools that record it."""
    capable = cube.sparkSession.createDataFrame(CAPABILITY, "tool string, signal string")
    by_tool = cube.groupBy("tool").agg(F.sum("tokens").alias("tokens"))
    signals = capable.select("signal").distinct()
    whole = by_tool.agg(F.sum("tokens").alias("total_tokens"))
    own = capable.join(by_tool, "tool").groupBy("signal").agg(F.sum("tokens").alias("own_tokens"))
    out = signals.join(own, "signal", "left").select("signal", F.coalesce("own_tokens", F.lit(0)).alias("capable_tokens"), F.lit(1).alias("one"))
    out = out.join(whole.withColumn("one", F.lit(1)), "one").drop("one")
    full = F.when(F.col("capable_tokens") == 0, "none").when(F.col("capable_tokens") == F.col("total_tokens"), "full").otherwise("partial")
    return out.withColumn("support", full)


def team(cube: DataFrame, sessions: DataFrame) -> DataFrame:
    by_member = cube.groupBy("member").agg(F.sum("lines_added").alias("lines_added"), F.round(F.sum("cost"), 9).alias("cost"), F.max(F.col("cost").isNull().cast("int")).alias("has_unpriced"))
    return by_member.join(sessions.groupBy("member").agg(F.count(F.lit(1)).alias("n_sessions")), "member", "full_outer")


def tokens_per_day(cube: DataFrame) -> DataFrame:
    return cube.groupBy("day").agg(F.sum("tokens").alias("tokens"))


def totals_by(cube: DataFrame, by: str) -> DataFrame:
    """The prepared view of models or projects: tokens, their share, lines, cost."""
    whole = cube.agg(F.sum("tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    out = cube.groupBy(F.col(by).alias("name")).agg(F.sum("tokens").alias("tokens"), F.sum("lines_added").alias("lines_added"), F.round(F.sum("cost"), 9).alias("cost")).withColumn("one", F.lit(1))
    return out.join(whole, "one").select("name", "tokens", "lines_added", "cost", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("token_share"))


def tool_shares(cube: DataFrame) -> DataFrame:
    """Shares behind every confidence: activity, priced, turn."""
    total = F.sum("tokens")
    part = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0))
    turn, session = part(F.col("granularity") == "turn"), part(F.col("granularity") == "session")
    return cube.agg(F.round(part(F.col("tool").isin(ACTIVITY_TOOLS)) / total, 6).alias("activity_share"), F.round(part(F.col("cost").isNotNull()) / total, 6).alias("priced_share"), F.round(F.when((turn > 0) & (session > 0), turn / (turn + session)).otherwise(1.0), 6).alias("turn_share"))
