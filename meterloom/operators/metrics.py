"""The 21 metrics: one row each, with figures, verdict (good, watch or neutral), purity, the samples it rests on and the share of the
window it covers. A metric whose window cannot support a verdict is neutral with a purity of 0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators import facts, reports, sequences
from meterloom.operators.pricing import PREMIUM, cost, priced
from meterloom.schema import answering

WORK_HOURS = (8, 18)
MARATHON = 90
MONEY = ("cost", "monthly", "premium_cost", "savings", "multiple")  # rounded to where prices end, others to six places
PLAN = 200.0  # dollars a month that usage is compared with


def share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def among(*signals: str) -> Column:
    return F.col("tool").isin(answering(*signals))


def part(c: Column, of: str | Column = "tokens") -> Column:
    return F.coalesce(F.sum(F.when(c, F.col(of) if isinstance(of, str) else of)), F.lit(0))


def beside(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    for b in others:
        a = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    return a


def verdict(row: DataFrame, known: Column, good: Column, purity: Column, samples: Column, covering: Column | None = None) -> DataFrame:
    """Adds read, purity, samples and covering, and rounds every double."""
    known = F.coalesce(known, F.lit(False))
    out = row.withColumn("read", F.when(~known, "neutral").when(good, "good").otherwise("watch")).withColumn("purity", F.when(known, clamp(purity)).otherwise(0.5)).withColumn("samples", samples.cast("long")).withColumn("covering", F.lit(1.0) if covering is None else covering)
    return out.select(*(F.round(c, 9 if c in MONEY else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def trend(cube: DataFrame, recent: str, prior: str) -> DataFrame:
    now = F.col("day") >= recent
    row = cube.agg(part(now, "lines_added").alias("recent_lines"), part((F.col("day") >= prior) & ~now, "lines_added").alias("prior_lines"))
    return row.withColumn("wow", F.when(F.col("prior_lines") > 0, (F.col("recent_lines") - F.col("prior_lines")) / F.col("prior_lines")))


def trend_purity() -> Column:
    return F.coalesce(clamp(F.lit(0.5) + F.col("wow") / 2), F.lit(0.5))


def adoption(x, w) -> DataFrame:
    named = F.when(F.col("project") != "", F.col("project"))
    use = x.cube.agg(F.countDistinct("day").alias("days"), F.countDistinct(named).alias("projects"))
    stale = reports.going_stale(x.cube, w.recent, 1 << 30).agg(F.count(F.lit(1)).alias("dormant_projects"))
    idle = reports.dormant_tools(x.cube, w.recent).agg(F.count(F.lit(1)).alias("dormant_tools"))
    row = beside(x.sessions.agg(F.count(F.lit(1)).alias("n_sessions")), use, stale, idle, trend(x.cube, w.recent, w.prior)).withColumn("sessions_per_day", share(F.col("n_sessions"), F.col("days")))
    good = (F.coalesce("wow", F.lit(0.0)) > 0) | ((F.col("projects") > 1) & (F.col("n_sessions") >= 3))
    return verdict(row, F.col("n_sessions") > 0, good, (clamp(F.col("projects") / 5) + trend_purity()) / 2, F.col("days"))


def burn_anomaly(x, w) -> DataFrame:
    days = reports.tokens_per_day(x.cube)
    spread = sequences.deviation(days, "tokens", whole=True)
    spikes = beside(days, spread).where((F.col("sigma") > 0) & ((F.col("tokens") - F.col("median")) / F.col("sigma") > 3.5)).agg(F.count(F.lit(1)).alias("spikes"))
    row = beside(spread.select(F.col("n").alias("days"), F.col("median").cast("long").alias("median_tokens"), "sigma"), spikes)
    return verdict(row, F.col("days") >= 7, F.col("spikes") == 0, 1 - share(F.col("spikes"), F.col("days")), F.col("days"))


def cache_hygiene(x, w) -> DataFrame:
    hour = among("cache_write_1h")
    row = x.cube.agg(F.sum("cache_read_tokens").alias("cache_read"), F.sum("input_tokens").alias("fresh"), part(hour, "cache_write_1h").alias("hour_writes"), part(hour, "cache_write_tokens").alias("writes"), F.countDistinct("day").alias("days"))
    row = row.withColumn("reuse", share(F.col("cache_read"), F.col("cache_read") + F.col("fresh"))).withColumn("hour_share", share(F.col("hour_writes"), F.col("writes")))
    top = facts.cache_misses(x.usage).groupBy("cache_miss_reason").agg(F.sum("n").alias("n")).agg(F.min(F.struct(-F.col("n"), "cache_miss_reason")).alias("t")).select(F.coalesce("t.cache_miss_reason", F.lit("")).alias("top_miss"))
    return verdict(beside(row, top), F.col("cache_read") + F.col("fresh") > 0, F.col("reuse") >= 0.5, F.col("reuse"), F.col("days"))


def concentration(x, w) -> DataFrame:
    lines = among("lines_added", "lines_removed")
    projects = x.cube.where("project <> ''").groupBy("project").agg(F.sum("tokens").alias("tokens"), F.sum("lines_added").alias("lines"), part(lines).alias("line_tokens"))
    whole = projects.agg(F.sum("tokens").alias("all_tokens"), F.sum("lines").alias("all_lines"), F.count(F.lit(1)).alias("n"))
    by_size = Window.orderBy("tokens", "project")  # projects are few: one row each
    shares = beside(projects, whole).withColumn("share", share(F.col("tokens"), F.col("all_tokens"))).withColumn("gap", F.col("share") - share(F.col("lines"), F.col("all_lines"))).withColumn("rank", F.row_number().over(by_size))
    seen = (F.col("share") >= 0.05) & (F.col("line_tokens") > 0)
    row = shares.agg(F.count(F.lit(1)).alias("projects"), F.max("share").alias("top1"), F.sum(F.when(F.col("rank") > F.col("n") - 3, F.col("share"))).alias("top3"), (2 * F.sum(F.col("rank") * F.col("share")) / (F.max("n") * F.sum("share")) - (F.max("n") + 1) / F.max("n")).alias("gini"), F.max(F.when(seen, F.col("gap"))).alias("gap"))
    return verdict(row, (F.col("projects") >= 2) & F.col("gap").isNotNull(), F.col("gap") <= 0.2, 1 - F.col("gap"), F.col("projects"))


def context(x, w) -> DataFrame:
    row = reports.session_stats(x.sessions).select("n_sessions", F.col("with_compactions").alias("capable"), "median_turns", "median_peak_context", "median_active_minutes", "compaction_rate", "code_share")
    code = x.sessions.where(among("edits") & among("active_minutes") & (F.col("edits") > 0)).agg(F.percentile("active_minutes", 0.5).alias("code_active_minutes"))
    return verdict(beside(row, code), F.col("capable") >= 3, F.col("compaction_rate") <= 0.2, 1 - F.col("compaction_rate"), F.col("capable"), share(F.col("capable"), F.col("n_sessions")))


def coverage(x, w) -> DataFrame:
    row = beside(reports.tool_shares(x.cube), x.cube.agg(F.countDistinct("day").alias("days"))).withColumn("cost_only_share", 1 - F.col("activity_share"))
    return verdict(row, F.col("days") > 0, (F.col("activity_share") >= 0.8) & (F.col("priced_share") >= 0.8), F.least("activity_share", "priced_share"), F.col("days"))


def edit_loops(x, w) -> DataFrame:
    steps = sequences.scoped(x.steps, x.sessions).where("scope = 'interactive'")
    row = sequences.edit_loops(sequences.repeat_edits(steps))
    return verdict(row, F.col("spread") == 1, F.col("outliers") == 0, 1 - share(F.col("outlier_edits"), F.col("edits")), F.col("judged"))


CLASSIFIED = ("tool_reads", "tool_searches", "tool_commands", "tool_writes", "tool_other")


def _classified() -> Column:
    total = F.lit(0)
    for c in CLASSIFIED:
        total = total + F.col(c)
    return total


def explore_produce(x, w) -> DataFrame:
    row = x.cube.where(among("tool_calls")).agg(F.coalesce(F.sum(_classified()), F.lit(0)).alias("classified"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("tool_writes"), F.lit(0)).alias("writes"), F.coalesce(F.sum(F.col("tool_reads") + F.col("tool_searches")), F.lit(0)).alias("looks"))
    row = row.withColumn("produce", share(F.col("writes"), F.col("classified"))).withColumn("explore", share(F.col("looks"), F.col("classified"))).withColumn("looks_per_write", F.when(F.col("writes") > 0, F.col("looks") / F.col("writes")))
    return verdict(row, F.col("classified") >= 50, F.col("produce") >= 0.05, F.col("produce") / 0.25, F.col("classified"), share(F.col("classified"), F.col("calls")))


def friction(x, w) -> DataFrame:
    rows = x.cube.withColumn("classified", _classified())
    fails, refuses = among("tool_errors"), among("rejected")
    row = rows.agg(part(fails & (F.col("classified") > 0), "tool_calls").alias("observed"), part(fails & (F.col("classified") > 0), "tool_errors").alias("errors"), part(fails, "tool_calls").alias("calls"), part(refuses, "rejected").alias("rejected"), part(refuses, "tool_calls").alias("refusable"))
    row = row.withColumn("error_rate", share(F.col("errors"), F.col("observed"))).withColumn("rejection_rate", share(F.col("rejected"), F.col("refusable")))
    return verdict(row, (F.col("observed") >= 30) & (F.col("errors") <= F.col("observed")), F.col("error_rate") <= 0.15, 1 - F.col("error_rate") / 0.33, F.col("observed"), share(F.col("observed"), F.col("calls")))


def intent(x, w) -> DataFrame:
    row = x.sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum((F.col("task") != "").cast("long")).alias("labelled"), F.sum((F.col("outcome") != "").cast("long")).alias("with_outcome"))
    classes = x.sessions.where("task <> ''").groupBy("task").count().where("count >= 3").agg(F.count(F.lit(1)).alias("classes"))
    return verdict(beside(row, classes), F.col("classes") >= 2, F.lit(True), share(F.col("labelled"), F.col("n_sessions")), F.col("n_sessions"))


def _tiers(x) -> DataFrame:
    tier = F.when(F.col("p_out").isNull(), "unpriced").when(F.col("p_out") >= PREMIUM, "premium").otherwise("cheaper")
    return x.cube.withColumn("tier", tier)


def model_fit(x, w) -> DataFrame:
    rows = _tiers(x)
    of = lambda t, c="tokens": part(F.col("tier") == t, c)
    row = rows.agg(of("premium").alias("premium_tokens"), of("cheaper").alias("cheaper_tokens"), of("unpriced").alias("unpriced"), F.sum("tokens").alias("tokens"), of("premium", "lines_added").alias("premium_lines"), of("cheaper", "lines_added").alias("cheaper_lines"), of("premium", "cost").alias("premium_cost"), F.countDistinct("day").alias("days"))
    mass = rows.where("tier = 'premium'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h")))
    others = rows.where("tier = 'cheaper'").select("p_in", "p_out", "p_write", "p_write_1h", "p_read").distinct()
    cheapest = beside(others, mass).agg(F.min(cost()).alias("cheapest"))
    row = beside(row, cheapest).withColumn("savings", F.when(F.col("premium_cost") > F.col("cheapest"), F.col("premium_cost") - F.col("cheapest")).otherwise(0.0)).drop("cheapest")
    row = row.withColumn("premium_share", share(F.col("premium_tokens"), F.col("premium_tokens") + F.col("cheaper_tokens"))).withColumn("unpriced_share", share(F.col("unpriced"), F.col("tokens")))
    row = row.withColumn("premium_lines_per_million", share(F.col("premium_lines") * F.lit(1e6), F.col("premium_tokens"))).withColumn("cheaper_lines_per_million", share(F.col("cheaper_lines") * F.lit(1e6), F.col("cheaper_tokens")))
    return verdict(row, F.col("tokens") > 0, (F.col("unpriced_share") <= 0.5) & (F.col("premium_share") <= 0.8), 1 - F.col("premium_share"), F.col("days"))


def model_right_sizing(x, w) -> DataFrame:
    turns = priced(facts.turn_sizing(x.usage), x.prices)
    row = turns.where(F.col("p_out") >= PREMIUM).agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("small_turns"), F.lit(0)).alias("small_turns")).withColumn("small_share", share(F.col("small_turns"), F.col("turns")))
    return verdict(row, F.col("turns") >= 20, F.col("small_share") < 0.4, 1 - F.col("small_share"), F.col("turns"))


def reasoning_share(x, w) -> DataFrame:
    says = among("reasoning")
    row = x.cube.agg(part(says, "reasoning_tokens").alias("reasoning"), part(says, "output_tokens").alias("output"), F.sum("output_tokens").alias("all_output"), F.countDistinct("day").alias("days")).withColumn("reasoning_share", share(F.col("reasoning"), F.col("output")))
    return verdict(row, F.col("output") > 0, F.col("reasoning_share") < 0.3, 1 - F.col("reasoning_share"), F.col("days"), share(F.col("output"), F.col("all_output")))


def recovery(x, w) -> DataFrame:
    steps = sequences.scoped(x.steps, x.sessions).where("scope = 'interactive'")
    row = beside(sequences.aftermath(steps), sequences.endings(steps, x.steps)).withColumn("abandoned_share", share(F.col("abandoned"), F.col("n_sequences") - F.col("open")))
    return verdict(row, (F.col("after_turns") >= 30) & F.col("cost_ratio").isNotNull(), F.col("cost_ratio") < 1.5, 1 - (F.col("cost_ratio") - 1), F.col("n_sequences"))


def rework(x, w) -> DataFrame:
    churn = reports.churn(x.cube).select("lines_added", "rework_lines", F.col("tokens").alias("capable_tokens"))
    refuses = among("rejected")
    row = beside(churn, x.cube.agg(part(refuses, "rejected").alias("rejected"), part(refuses, "tool_calls").alias("calls"), F.sum("tokens").alias("tokens"), F.countDistinct("day").alias("days")))
    row = row.withColumn("churn_rate", F.when((F.col("lines_added") > 0) & (F.col("rework_lines") <= F.col("lines_added")), F.col("rework_lines") / F.col("lines_added"))).withColumn("rejection_rate", F.when(F.col("calls") > 0, F.col("rejected") / F.col("calls")))
    bad = (F.coalesce("churn_rate", F.lit(0.0)) > 0.15) | (F.coalesce("rejection_rate", F.lit(0.0)) > 0.15)
    both = F.col("churn_rate").isNotNull() & F.col("rejection_rate").isNotNull()
    mean = F.coalesce((F.col("churn_rate") + F.col("rejection_rate")) / 2, "churn_rate", "rejection_rate")
    return verdict(row, bad | both, ~bad, 1 - mean, F.col("days"), share(F.col("capable_tokens"), F.col("tokens")))


def rhythm(x, w) -> DataFrame:
    hour, weekend = F.hour("first_ts"), F.dayofweek("first_ts").isin(1, 7)
    off = weekend | ~hour.between(WORK_HOURS[0], WORK_HOURS[1] - 1)
    paced = among("active_minutes")
    count = lambda c: F.sum(c.cast("long"))
    row = x.sessions.agg(F.count(F.lit(1)).alias("timed"), count(paced).alias("paced"), count(off).alias("off"), count(weekend).alias("weekend"), count(hour < 8).alias("night"), count((hour >= 8) & (hour < 12)).alias("morning"), count((hour >= 12) & (hour < 18)).alias("afternoon"), count(hour >= 18).alias("evening"), F.percentile(F.when(paced, F.col("active_minutes")), 0.95).alias("p95_active"), count(paced & (F.col("active_minutes") >= MARATHON)).alias("marathons"))
    row = row.withColumn("off_share", share(F.col("off"), F.col("timed"))).withColumn("weekend_share", share(F.col("weekend"), F.col("timed"))).withColumn("marathon_share", share(F.col("marathons"), F.col("paced")))
    return verdict(row, (F.col("timed") >= 5) & (F.col("paced") >= 5), (F.col("off_share") <= 0.25) & (F.col("marathon_share") <= 0.15), 1 - (F.col("off_share") + F.col("marathon_share")) / 2, F.col("timed"), share(F.col("paced"), F.col("timed")))


def session_taxonomy(x, w) -> DataFrame:
    own = among("edits")
    count = lambda c: F.sum((own & c).cast("long"))
    row = x.sessions.agg(F.count(F.lit(1)).alias("n_sessions"), count(F.lit(True)).alias("capable"), count(F.col("edits") == 0).alias("conversational"), count(F.col("edits").between(1, 10)).alias("light"), count(F.col("edits") > 10).alias("heavy"))
    row = row.withColumn("editing_share", share(F.col("light") + F.col("heavy"), F.col("capable"))).withColumn("lead", F.when(F.col("conversational") * 2 > F.col("capable"), "chat-led").when((F.col("light") + F.col("heavy")) * 2 > F.col("capable"), "edit-led").otherwise("mixed"))
    return verdict(row, F.col("capable") >= 5, F.lit(True), F.col("editing_share"), F.col("capable"), share(F.col("capable"), F.col("n_sessions")))


def skill_economics(x, w) -> DataFrame:
    both = [facts.attribution(x.usage, by).agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("basis"), F.coalesce(F.max("tokens"), F.lit(0)).alias("top")).withColumn("kind", F.lit(by)) for by in ("skill", "agent")]
    rows = both[0].unionByName(both[1]).where("labels >= 2").withColumn("top_share", share(F.col("top"), F.col("basis")))
    row = rows.agg(F.max(F.struct("top_share", "kind", "labels", "basis")).alias("m")).select(F.coalesce("m.top_share", F.lit(0.0)).alias("top_share"), F.coalesce("m.kind", F.lit("")).alias("kind"), F.coalesce("m.labels", F.lit(0)).alias("labels"), F.coalesce("m.basis", F.lit(0)).alias("basis"))
    row = beside(row, x.cube.agg(F.sum("tokens").alias("tokens")))
    return verdict(row, F.col("basis") >= 100_000, F.col("top_share") <= 0.5, 1 - F.col("top_share"), F.col("labels"), share(F.col("basis"), F.col("tokens")))


def subscription_fit(x, w) -> DataFrame:
    row = x.cube.agg(F.sum("cost").alias("cost"), F.min("day").alias("first_day"), F.countDistinct("day").alias("days"))
    start = F.greatest(F.to_date("first_day"), F.to_date(F.lit(w.since)))
    row = row.withColumn("span_days", F.greatest(F.datediff(F.to_date(F.lit(w.now)), start) + F.when(F.col("first_day") > w.since[:10], 1).otherwise(0), F.lit(1)).cast("double"))
    row = row.withColumn("monthly", F.col("cost") / F.col("span_days") * 30).withColumn("multiple", F.col("monthly") / PLAN).drop("first_day")
    return verdict(row, F.col("cost").isNotNull(), F.col("multiple") >= 1, F.col("multiple") / 2, F.col("days"))


def throughput(x, w) -> DataFrame:
    row = beside(x.cube.agg(F.sum("lines_added").alias("lines"), F.countDistinct("day").alias("days"), F.sum(among("lines_added", "lines_removed").cast("long")).alias("capable_rows")), trend(x.cube, w.recent, w.prior)).withColumn("lines_per_day", share(F.col("lines"), F.col("days")))
    return verdict(row, F.col("capable_rows") > 0, (F.coalesce("wow", F.lit(0.0)) > 0) & (F.col("recent_lines") >= 20), trend_purity(), F.col("days"))


def turn_efficiency(x, w) -> DataFrame:
    own = among("edits") & among("turns")
    code = own & (F.col("edits") > 0)
    count = lambda c: F.sum(c.cast("long"))
    row = x.sessions.agg(F.count(F.lit(1)).alias("n_sessions"), count(own).alias("capable"), count(code).alias("code_sessions"), count(code & (F.col("turns") <= 2)).alias("one_shot"), F.percentile(F.when(code, F.col("turns")), 0.5).alias("median_turns"), F.percentile(F.when(own & (F.col("turns") > 0), F.col("output_tokens") / F.col("turns")), 0.5).alias("median_output_per_turn")).withColumn("one_shot_rate", share(F.col("one_shot"), F.col("code_sessions")))
    return verdict(row, F.col("code_sessions") >= 5, F.col("one_shot_rate") >= 0.25, F.col("one_shot_rate"), F.col("code_sessions"), share(F.col("capable"), F.col("n_sessions")))


METRICS = {f.__name__: f for f in (adoption, burn_anomaly, cache_hygiene, concentration, context, coverage, edit_loops, explore_produce, friction, intent, model_fit, model_right_sizing, reasoning_share, recovery, rework, rhythm, session_taxonomy, skill_economics, subscription_fit, throughput, turn_efficiency)}


def evidence(row: DataFrame) -> DataFrame:
    """A metric's confidence: its samples and the share it covers, with the shares that any figure rests on."""
    weakest = F.least("covering", "activity_share", "priced_share", "turn_share")
    label = F.when((F.col("samples") <= 0) | (F.col("covering") <= 0), "insufficient").when(F.col("samples") < 3, "low").when(weakest >= 0.8, "high").when(weakest >= 0.5, "medium").otherwise("low")
    return row.withColumn("confidence", label).withColumn("weakest", F.round(weakest, 6))


def verdicts(x, w) -> DataFrame:
    """metric, read, purity, samples, covering, confidence, weakest of every metric. Each is one row by then."""
    shares = reports.tool_shares(x.cube)
    rows = None
    for name, metric in METRICS.items():
        row = metric(x, w).select(F.lit(name).alias("metric"), "read", F.col("purity").cast("double"), "samples", F.col("covering").cast("double"))
        rows = row if rows is None else rows.unionByName(row)
    return evidence(beside(rows, shares)).select("metric", "read", "purity", "samples", "covering", "confidence", "weakest")


def ranking(found: DataFrame, top: int = 3) -> DataFrame:
    """The verdicts to look at first: watch with evidence; never a score."""
    grade = F.when(F.col("confidence") == "high", 2).otherwise(1)
    weak = F.when(F.col("weakest") >= 0.8, 1.0).otherwise(F.col("weakest"))
    return found.where("read = 'watch' AND confidence IN ('high', 'medium')").orderBy(grade.desc(), F.desc("covering"), weak.desc(), "metric").limit(top)
