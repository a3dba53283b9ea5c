"""Rules over verdicts that gate a run: conditions on a metric's verdict, each raising alerts of one severity.

A rule is held against the verdicts' columns before it runs. One that cannot be read, that is no condition, that is badly named or that
raises more alerts than ``MOST`` is refused as a whole, and a refused rule is itself an error: a gate that could not be evaluated is not
one that passed. Alerts are never thinned out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The severities, of which the last breaches, and the bounds of a rule's texts and alerts.
SEVERITIES = ("info", "warn", "error")
LONGEST = {"name": 64, "message": 400}
MOST = 50
COULD_NOT_RUN = "could not run: "


class Rule(NamedTuple):
    name: str
    severity: str
    where: str
    message: str


def refusal(rule: Rule, verdicts: DataFrame) -> str:
    """Why a rule cannot run on such verdicts; empty if it can."""
    if rule.severity not in SEVERITIES:
        return f"severity {rule.severity!r} is not one of {', '.join(SEVERITIES)}"
    for what, most in LONGEST.items():
        said = getattr(rule, what)
        if not said.strip() or len(said) > most or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in said):
            return f"{what} is empty, longer than {most} characters or holds control characters"
    try:
        (kind,) = verdicts.limit(0).select(F.expr(rule.where).alias("x")).dtypes
    except PySparkException as e:
        return f"condition {e.getCondition() or type(e).__name__}"
    return "" if kind[1] == "boolean" else f"condition is {kind[1]}"


def alerts(verdicts: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, severity, message, metric: what the rules raise; a rule that cannot run raises one error, without a metric."""
    spark, raised = verdicts.sparkSession, None
    broken = [(r.name[: LONGEST["name"]] or "?", "error", COULD_NOT_RUN + why, "") for r in rules if (why := refusal(r, verdicts))]
    out = spark.createDataFrame(broken, "rule string, severity string, message string, metric string")
    for r in rules:
        if not refusal(r, verdicts):
            told = (F.lit(x).alias(n) for n, x in (("rule", r.name), ("severity", r.severity), ("message", r.message)))
            found = verdicts.where(F.expr(r.where)).select(*told, "metric")
            raised = found if raised is None else raised.unionByName(found)
    if raised is None:
        return out
    counted = raised.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rule")))
    flood = counted.where(F.col("n") > MOST).select("rule", F.lit("error").alias("severity"), F.lit(f"{COULD_NOT_RUN}more than {MOST} alerts").alias("message"), F.lit("").alias("metric")).distinct()
    return out.unionByName(counted.where(F.col("n") <= MOST).drop("n")).unionByName(flood)


def gate(raised: DataFrame) -> DataFrame:
    """One row: alerts by severity, rules that could not run, and whether the run breaches."""
    many = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = [many(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return raised.agg(*counts, many(F.col("message").startswith(COULD_NOT_RUN)).alias("refused")).withColumn("breached", F.col("error") > 0)
