"""Every query of the engine by name, with the SQL that a second engine answers it with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators import facts, metrics, pricing, reports, sequences
from meterloom.plans import cases, health, logs, metric_oracles, oracles, stores
from meterloom.plans.bridge import NOW, PRIOR, RECENT, SINCE, fact
from meterloom.session import cut


class Bounds(NamedTuple):
    """The window that metrics look at; never the wall clock."""

    now: str = NOW
    since: str = SINCE
    recent: str = RECENT
    prior: str = PRIOR


class Facts:
    """The fact tables of one data folder, lazily; ``cube`` and ``sessions`` are what most questions rest on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.bounds = spark, sf_dir, Bounds()

    def read(self, name: str) -> DataFrame:
        return fact(self.spark, self.sf_dir, name)

    @property
    def usage(self) -> DataFrame:
        return facts.window(self.read("usage_record"), SINCE)

    @property
    def labels(self) -> DataFrame:
        return self.read("session_label")

    @property
    def steps(self) -> DataFrame:
        return self.read("session_step")

    @property
    def prices(self) -> DataFrame:
        return pricing.prices(self.spark)

    @property
    def cube(self) -> DataFrame:
        return facts.priced_cube(self.usage, self.prices)

    @property
    def labelled_cube(self) -> DataFrame:
        return facts.priced_cube(facts.labelled(self.usage, self.labels), self.prices, ("task", "outcome", "difficulty"))

    @property
    def sessions(self) -> DataFrame:
        return facts.sessions(self.usage, self.labels)


class Written(Facts):
    """Facts for questions that ask many others: each fact table is made once and written."""

    @cached_property
    def usage(self) -> DataFrame:
        return cut(super().usage, "usage")

    @cached_property
    def labels(self) -> DataFrame:
        return cut(super().labels, "labels")

    @cached_property
    def steps(self) -> DataFrame:
        return cut(super().steps, "steps")

    @cached_property
    def cube(self) -> DataFrame:
        return cut(super().cube, "cube")

    @cached_property
    def sessions(self) -> DataFrame:
        return cut(super().sessions, "sessions")


def _top_project(x: Facts) -> DataFrame:
    """The drill into the project with most lines: its effectiveness by tool."""
    cube = x.cube
    top = cube.where("project <> ''").groupBy("project").agg(F.sum("lines_added").alias("lines")).orderBy(F.desc("lines"), "project").limit(1)
    return reports.effectiveness(cube.join(top.select("project"), "project", "left_semi"), "tool")


def _core() -> dict[str, Callable[[Facts], DataFrame]]:
    six = lambda df, c: df.withColumn(c, F.round(c, 6))
    out = {
        "usage_cube": lambda x: facts.cube(x.usage),
        "usage_by_label": lambda x: facts.cube(facts.labelled(x.usage, x.labels), ("task", "outcome", "difficulty")),
        "label_filter_usage": lambda x: facts.cube(facts.with_label(x.usage, x.labels, task="bugfix")),
        "sessions": lambda x: six(x.sessions, "active_minutes"),
        "active_minutes": lambda x: six(facts.active_minutes(x.usage), "active_minutes"),
        "delegation": lambda x: facts.delegation(x.usage),
        "attribution_skill": lambda x: facts.attribution(x.usage, "skill"),
        "attribution_agent": lambda x: facts.attribution(x.usage, "agent"),
        "turn_sizing": lambda x: facts.turn_sizing(x.usage),
        "cache_misses": lambda x: facts.cache_misses(x.usage),
        "subpaths": lambda x: facts.subpaths(x.usage, "proj-1"),
        "session_signals": lambda x: facts.session_signals(x.usage),
        "session_latest": lambda x: facts.latest_session(x.usage),
        "session_prefix": lambda x: facts.matching_sessions(x.usage, "s1"),
        "history": lambda x: facts.history(x.read("usage_record")),
        "step_horizon": lambda x: facts.step_horizon(x.steps),
        "movers_project": lambda x: reports.movers(x.cube, "project", RECENT, PRIOR),
        "movers_tool": lambda x: reports.movers(x.cube, "tool", RECENT, PRIOR),
        "insights_hot": lambda x: reports.hot(x.cube, RECENT),
        "insights_going_stale": lambda x: reports.going_stale(x.cube, RECENT),
        "insights_dormant_tools": lambda x: reports.dormant_tools(x.cube, RECENT),
        "inventory": lambda x: reports.inventory(x.cube),
        "churn": lambda x: reports.churn(x.cube),
        "unpriced_models": lambda x: reports.unpriced_models(x.cube),
        "check_totals": lambda x: reports.check(x.cube, 1_000_000, 1_000_000.0),
        "session_stats": lambda x: reports.session_stats(x.sessions),
        "signal_coverage": lambda x: reports.signal_coverage(x.cube),
        "team": lambda x: reports.team(x.cube, x.sessions),
        "tokens_per_day": lambda x: reports.tokens_per_day(x.cube),
        "tool_shares": lambda x: reports.tool_shares(x.cube),
        "totals_by_model": lambda x: reports.totals_by(x.cube, "model"),
        "totals_by_project": lambda x: reports.totals_by(x.cube, "project"),
        "price_normalise": lambda x: x.read("usage_record").select("model").distinct().withColumn("plain_model", pricing.normalized(F.col("model"))),
        "drill_project": _top_project,
    }
    out["report_total"] = lambda x: reports.with_total(reports.report(x.cube, "entrypoint")).select("name", "granularity", "tokens", "unpriced_tokens", "cost", "cache_eff")
    for by in ("day", "project", "tool", "model", "entrypoint"):
        out[f"report_by_{by}"] = lambda x, by=by: reports.report(x.cube, by)
        out[f"effectiveness_by_{by}"] = lambda x, by=by: reports.effectiveness(x.cube, by)
    for by in ("task", "outcome", "difficulty"):
        out[f"report_by_{by}"] = lambda x, by=by: reports.report(x.labelled_cube, by)
    return out


def _sequences() -> dict[str, Callable[[Facts], DataFrame]]:
    def interactive(x: Facts) -> DataFrame:
        return sequences.scoped(x.steps, x.sessions).where("scope = 'interactive'")

    return {
        "repeat_edits": lambda x: sequences.repeat_edits(interactive(x)),
        "edit_loop_outliers": lambda x: sequences.edit_loops(sequences.repeat_edits(interactive(x))),
        "aftermath": lambda x: sequences.aftermath(interactive(x)),
        "sequence_endings": lambda x: sequences.endings(interactive(x), x.steps),
        "sequence_scope": lambda x: sequences.scopes(x.steps, x.sessions),
    }


def _metrics() -> dict[str, Callable[[Facts], DataFrame]]:
    out = {f"metric_{name}": lambda x, metric=metric: metric(x, Bounds()) for name, metric in metrics.METRICS.items()}
    out["confidence_axes"] = lambda x: metrics.verdicts(x, x.bounds)
    out["ranking"] = lambda x: metrics.ranking(metrics.verdicts(x, x.bounds))
    return out


#: Queries that put many metrics together.
MANY = frozenset(["confidence_axes", "ranking", "share_axes", "share_archetype", "share_hook", "rule_alerts"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    kind = lambda name: Written if name in MANY else Facts
    return {name: lambda spark, sf_dir, ask=ask, facts=kind(name): ask(facts(spark, sf_dir)) for name, ask in (_core() | _sequences() | _metrics() | cases.queries() | logs.queries() | health.queries() | stores.queries()).items()}


def oracle_sql() -> dict[str, str]:
    return oracles.core() | metric_oracles.metrics() | cases.oracle_sql() | logs.oracle_sql() | health.oracle_sql() | stores.oracle_sql()
