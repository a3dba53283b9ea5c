"""What the store holds and how far it can be trusted: provenance, freshness, unpriced share, stale captures, coverage by traces; the
status line; and the shape that a share card shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.pricing import cost, priced, tokens
from meterloom.schema import answering

CEILING = 0.05  # unpriced share of tokens above which the price table is to be refreshed

#: What each metric is about; those not named are about activity.
OUTPUT_METRICS = ("concentration", "rework", "throughput")
LAYERS = ("activity", "output", "outcome", "impact")

#: The ends of the axes of a share card, the fact that places it, and by what that is scaled.
AXES = (("thrifty", "premium", "premium", 1.0), ("talks", "edits", "editing", 1.0), ("solo", "delegates", "delegation", 1.0), ("day", "night", "off_hours", 1.0), ("first try", "reworks", "rework", 4.0))

#: Kinds of users, the first that fits: fact, comparison, bound in percent (or a count), and a second condition or none.
ARCHETYPES = (
    ("The Delegator", "delegation >= 0.25"), ("The Conductor", "conversational >= 0.80"), ("The Operator", "commands >= 0.45"), ("The Night Shift", "off_hours >= 0.60"),
    ("The Refiner", "rework >= 0.12"), ("The Cartographer", "conversational >= 0.60 AND coalesce(commands, 1.0) < 0.30"), ("The Sprinter", "sessions_per_day >= 40"),
    ("The Economist", "premium <= 0.55"), ("The Marathoner", "compaction >= 0.10"), ("The Archivist", "cache_read >= 0.98"), ("The Newcomer", "sessions < 25"), ("The Builder", "true"),
)


def layer(metric: Column) -> Column:
    return F.when(metric.isin(*OUTPUT_METRICS), "output").otherwise("activity")


def insufficient_reason(covering: Column, samples: Column, recorded: Column, unit: Column) -> Column:
    """Why a metric has no evidence; null where it has. What a source records but no stored row shows was stored by an older build."""
    none = covering <= 0
    return F.when(none & F.coalesce(recorded, F.lit(False)), "re-read").when(none, "unanswerable").when(samples <= 0, F.when(unit != "", F.concat(F.lit("0 "), unit)).otherwise("no stated basis"))


def stale_captures(cube: DataFrame, signals: dict[str, str]) -> DataFrame:
    """signal, covering, reason: of each signal (and the column that shows it) the share of tokens whose tools record it and have shown
    it at all, and why there is none."""
    rows = []
    for signal, column in signals.items():
        capable = F.col("tool").isin(*answering(signal))
        shown = cube.groupBy("tool").agg(F.sum("tokens").alias("tokens"), F.sum(column).alias("shown"))
        able = F.coalesce(F.sum(F.when(capable, F.col("tokens"))), F.lit(0))
        covered = F.coalesce(F.sum(F.when(capable & (F.col("shown") > 0), F.col("tokens"))), F.lit(0))
        rows.append(shown.agg(F.lit(signal).alias("signal"), F.round(covered / F.sum("tokens"), 6).alias("covering"), (able > 0).alias("recorded")))
    found = reduce(DataFrame.unionByName, rows)
    return found.withColumn("reason", F.coalesce(insufficient_reason(F.col("covering"), F.lit(1), F.col("recorded"), F.lit("")), F.lit("")))


def trace_coverage(steps: DataFrame, scoped: DataFrame, now: str, since: str) -> DataFrame:
    """n_sequences, excluded_share, covered, covering: interactive sequences, the share of steps outside them, of the window's whole
    days those that steps reach back to, and what a metric over sequences covers by both."""
    at = lambda s: F.unix_timestamp(F.lit(s).cast("timestamp"))
    kept = scoped.agg(F.countDistinct(F.when(F.col("scope") == "interactive", F.struct("session_id", "member", "timeline"))).alias("n_sequences"), (1 - F.avg((F.col("scope") == "interactive").cast("double"))).alias("excluded_share"))
    oldest = steps.agg(F.unix_timestamp(F.min("ts").cast("timestamp")).alias("oldest"))
    days = F.floor((at(now) - at(since)) / 86400)
    missing = F.floor((F.col("oldest") - at(since)) / 86400)
    covered = F.when((days <= 0) | (missing <= 0) | F.col("oldest").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (days - missing) / days)))
    row = kept.crossJoin(oldest).withColumn("covered", covered)  # one row each
    return row.select("n_sequences", F.round("excluded_share", 6).alias("excluded_share"), F.round("covered", 6).alias("covered"), F.round((1 - F.col("excluded_share")) * F.col("covered"), 6).alias("covering"))


def provenance(state: DataFrame) -> DataFrame:
    """newest, build: when inputs (version, ingested_at) were last read, and by which build, or by how many."""
    row = state.agg(F.max("ingested_at").alias("newest"), F.countDistinct("version").alias("n"), F.min("version").alias("one"))
    mixed = F.concat(F.lit("mixed ("), F.col("n").cast("string"), F.lit(" builds)"))
    return row.select("newest", F.when(F.col("n") == 0, "").when(F.col("n") == 1, F.col("one")).otherwise(mixed).alias("build"))


def record_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """tool, dedupe_key, tokens, cost of each record; the cost is null where its model has no price."""
    return priced(usage, prices).select("tool", "dedupe_key", tokens().alias("tokens"), F.round(cost(), 9).alias("cost"))


def answered_by(usage: DataFrame, *signals: str) -> DataFrame:
    """The rows of tools that record all of these signals."""
    return usage.where(F.col("tool").isin(*answering(*signals)))


def zero_token(usage: DataFrame) -> DataFrame:
    """Records without any token: what a broken reader leaves."""
    return usage.where(tokens() + F.col("reasoning_tokens") == 0)


def doctor(usage: DataFrame, steps: DataFrame, cube: DataFrame, now: str, ceiling: float = CEILING) -> DataFrame:
    """One row of what a check-up looks at: how much is stored, since when, how fresh, how much of it has no price and whether that
    is over the ceiling, how long the tool that prunes its own logs has been kept, how far steps go back."""
    days = lambda c: F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))) / 86400)
    stored = usage.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("tool").alias("tools"), F.countDistinct("session_id", "member").alias("sessions"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), days(F.min(F.when(F.col("tool") == "claude-code", F.col("ts")))).alias("kept_days"))
    kept = steps.agg(F.count(F.lit(1)).alias("steps"), days(F.min("ts")).alias("step_days"))
    money = cube.agg(F.count_if(F.col("cost").isNull()).alias("unpriced_rows"), F.countDistinct(F.when(F.col("unpriced_tokens") > 0, F.col("model"))).alias("unpriced_models"), F.round(F.sum("unpriced_tokens") / F.sum("tokens"), 6).alias("unpriced_share"))
    return stored.crossJoin(kept).crossJoin(money).withColumn("over_ceiling", F.col("unpriced_share") > ceiling)  # one row each


def status_line(usage: DataFrame, prices: DataFrame, now: str, plan: float = 0.0) -> DataFrame:
    """One row: today's tokens and lines, whether any of today's tools records lines, the month's cost to date and its multiple of the
    plan, and the minutes since the newest record."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = priced(usage.where(F.col("ts") <= at), prices).withColumn("cost", cost())
    today, month = F.col("ts") >= F.date_trunc("day", at), F.col("ts") >= F.date_trunc("month", at)
    total = lambda when, c: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    lined = F.col("tool").isin(*answering("lines_added"))
    minutes = F.floor((F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 60)
    row = rows.agg(total(today, tokens()).alias("tokens"), total(today, F.col("lines_added")).alias("lines"), F.coalesce(F.max(F.when(today, lined)), F.lit(False)).alias("line_capable"), F.round(total(month, F.col("cost")), 9).alias("month_cost"), minutes.alias("age_minutes"))
    return row.withColumn("of_plan", F.when(F.lit(plan) > 0, F.round(F.col("month_cost") / plan, 6)))


def shape_facts(fit: DataFrame, taxonomy: DataFrame, rhythm: DataFrame, rework: DataFrame, cache: DataFrame, context: DataFrame, adoption: DataFrame, cube: DataFrame, delegated: DataFrame) -> DataFrame:
    """One row of shares that a share card is drawn from, out of the metrics' rows; null where a metric has none."""
    calls = cube.agg(F.sum("tool_commands").alias("n_commands"), F.sum(F.col("tool_reads") + F.col("tool_searches") + F.col("tool_commands") + F.col("tool_writes") + F.col("tool_other")).alias("n_calls"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    parts = [
        fit.select(F.col("premium_share").alias("premium")), taxonomy.select(share("conversational", "capable").alias("conversational")), rhythm.select(F.col("off_share").alias("off_hours")),
        rework.select(F.col("churn_rate").alias("rework")), cache.select(F.col("reuse").alias("cache_read")), context.select(F.col("compaction_rate").alias("compaction")),
        adoption.select(F.col("n_sessions").alias("sessions"), "sessions_per_day"), calls.select(share("n_commands", "n_calls").alias("commands")), delegated.select(F.col("share").alias("delegation")),
    ]
    return reduce(DataFrame.crossJoin, parts).withColumn("editing", 1 - F.col("conversational"))  # one row each


def axes(facts: DataFrame) -> DataFrame:
    """left, right, place: where between its ends each axis stands, held off the very ends; axes without a fact are left out."""
    told = [F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col(fact) * by)).alias("place"), F.col(fact).alias("fact")) for left, right, fact, by in AXES]
    return facts.select(F.explode(F.array(*told)).alias("a")).where("a.fact IS NOT NULL").select("a.left", "a.right", F.round("a.place", 6).alias("place"))


def archetype(facts: DataFrame) -> DataFrame:
    """name, place: the first kind that fits, and its number."""
    name = reduce(lambda out, x: F.when(F.expr(x[1]), x[0]).otherwise(out), reversed(ARCHETYPES[:-1]), F.lit(ARCHETYPES[-1][0]))
    names = F.array(*(F.lit(n) for n, _ in ARCHETYPES))
    return facts.select(name.alias("name")).withColumn("place", F.array_position(names, F.col("name")).cast("int"))


#: The figures that may open a share card, each with its family and the threshold that it has to clear, in the order in which
#: a tie is decided. Shares are in percent.
HOOKS = (
    ("scale", "tokens", 1e9), ("scale", "sessions_per_day", 20.0), ("scale", "lines", 50_000.0), ("scale", "tool_calls", 20_000.0),
    ("counterintuition", "conversational", 70.0), ("counterintuition", "commands", 40.0), ("counterintuition", "delegation", 10.0), ("counterintuition", "models", 5.0),
    ("money", "cost", 1000.0), ("money", "plan", 1.0), ("human", "off_hours", 45.0), ("human", "weekend", 20.0),
    ("self-critical", "rework", 3.0), ("self-critical", "premium", 80.0), ("self-critical", "rejections", 100.0), ("craft", "cache_read", 95.0),
)
PERCENT = ("conversational", "commands", "delegation", "off_hours", "weekend", "rework", "premium", "cache_read")
FRESH_DAYS = 7  # fixed value: less history than this is a first run


def hook_counts(cube: DataFrame, sessions: DataFrame, usage: DataFrame, now: str, plan_cost: float = 0.0) -> DataFrame:
    """One row of the counts that a share card may open with; null where no source in the window records them."""
    able = lambda signal: F.col("tool").isin(*answering(signal))
    recorded = lambda signal, c: F.sum(F.when(able(signal), F.col(c))).alias(c)
    classes = F.col("tool_reads") + F.col("tool_searches") + F.col("tool_commands") + F.col("tool_writes") + F.col("tool_other")
    sums = cube.agg(
        F.sum("tokens").alias("tokens"), recorded("lines_added", "lines_added").alias("lines"), F.sum(F.when(able("tool_calls"), classes)).alias("tool_calls"),
        recorded("rejected", "rejected").alias("rejections"), F.sum("cost").alias("cost"), F.countDistinct(F.when((F.col("tokens") > 0) & (F.col("model") != ""), F.col("model"))).alias("models"),
    )
    weekend = sessions.agg(F.avg(F.dayofweek("first_ts").isin(1, 7).cast("double")).alias("weekend"))
    history = usage.agg(((F.unix_seconds(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))) / 86400).alias("history_days"))
    return sums.crossJoin(weekend).crossJoin(history).withColumn("plan", F.when(F.lit(plan_cost > 0) & F.col("cost").isNotNull(), 1.0))  # one row each


def hook(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """family, figure, value, threshold, clearance of the figure that clears its threshold by most, on a scale of logarithms that counts and
    shares have in common. Without one the card opens with totals, and within the first days of a history with that. Figures alone: no
    project, path, session or member has a column here."""
    row = facts.crossJoin(counts)
    value = lambda figure: (F.col(figure) * (100 if figure in PERCENT else 1)).cast("double")
    told = [F.struct(F.lit(k).alias("place"), F.lit(family).alias("family"), F.lit(figure).alias("figure"), value(figure).alias("value"), F.lit(threshold).alias("threshold")) for k, (family, figure, threshold) in enumerate(HOOKS)]
    each = row.select("history_days", F.explode(F.array(*told)).alias("h")).select("history_days", "h.*").withColumn("clearance", F.when(F.col("value") > F.col("threshold"), F.log(F.col("value") / F.col("threshold"))))
    best = each.agg(F.max("history_days").alias("days"), F.max_by(F.struct("family", "figure", "value", "threshold", "clearance"), F.when(F.col("clearance").isNotNull(), F.struct("clearance", -F.col("place")))).alias("b"))
    fresh = (F.col("days") > 0) & (F.col("days") < FRESH_DAYS)
    six = lambda c: F.round(f"b.{c}", 6).alias(c)
    return best.select(F.coalesce("b.family", F.lit("universal")).alias("family"), F.coalesce("b.figure", F.when(fresh, "first days").otherwise("totals")).alias("figure"), six("value"), six("threshold"), six("clearance"))
