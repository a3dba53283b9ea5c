"""Rules over verdicts, and steps as a stream, by cases whose answer is known."""

import json

import pytest

from meterloom.operators.rules import Rule, alerts, gate, refusal
from meterloom.streaming import steps as streamed
from meterloom.streaming import store as stores

VERDICTS = "metric string, read string, samples long, covering double, confidence string"
ROWS = [("rework", "watch", 9, 0.9, "high"), ("intent", "watch", 1, 0.2, "low"), ("rhythm", "good", 40, 1.0, "high"), ("recovery", None, None, None, None)]


def test_rules_raise_alerts(spark):
    found = spark.createDataFrame(ROWS, VERDICTS)
    rules = [Rule("watched", "error", "read = 'watch' AND confidence = 'high'", "look"), Rule("thin", "warn", "samples < 3", "few"), Rule("quiet", "info", "covering > 2", "-")]
    got = sorted(tuple(x) for x in alerts(found, rules).collect())
    assert got == [("thin", "warn", "few", "intent"), ("watched", "error", "look", "rework")]
    assert tuple(gate(alerts(found, rules)).first()) == (0, 1, 1, 0, True)
    assert tuple(gate(alerts(found, rules[1:])).first()) == (0, 1, 0, 0, False)
    assert tuple(gate(alerts(found, [])).first()) == (0, 0, 0, 0, False)


@pytest.mark.parametrize("rule", [
    Rule("a", "fatal", "true", "m"), Rule("", "warn", "true", "m"), Rule("x" * 65, "warn", "true", "m"), Rule("a\n", "warn", "true", "m"), Rule("a", "warn", "true", " "), Rule("a", "warn", "true", "m" * 401),
    Rule("a", "warn", "unheard_of > 1", "m"), Rule("a", "warn", "samples +", "m"), Rule("a", "warn", "samples", "m"), Rule("a", "info", "sum(samples) > 1 OR nothing()", "m"),
])
def test_a_rule_that_cannot_run_fails_the_gate(spark, rule):
    found = spark.createDataFrame(ROWS, VERDICTS)
    assert refusal(rule, found)
    (one,) = alerts(found, [rule]).collect()
    assert one.severity == "error" and one.message.startswith("could not run: ") and one.metric == ""
    assert gate(alerts(found, [rule, Rule("fine", "info", "true", "m")])).first().breached


def test_a_rule_that_raises_too_much_is_refused_whole(spark):
    found = spark.createDataFrame([(f"m{k}", "watch", k, 1.0, "high") for k in range(60)], VERDICTS)
    rules = [Rule("all", "info", "true", "m"), Rule("fifty", "info", "samples < 50", "m")]
    got = alerts(found, rules).collect()
    assert [x.message for x in got if x.rule == "all"] == ["could not run: more than 50 alerts"]
    assert sum(x.rule == "fifty" for x in got) == 50


def step(key, ts, seq, **more):
    return json.dumps({"tool": "t", "timeline": "", "dedupe_key": key, "session_id": "s", "kind": "command", "outcome": "", "ts": ts, "ordinal": 1, "tokens": 0, "target_ref": 0, "seq": seq} | more)


def test_steps_are_merged_in_state_and_leave_it(spark, tmp_path):
    landing, store = tmp_path / "landing", stores.Store(spark, str(tmp_path / "store"))
    landing.mkdir()

    def land(name, *lines):
        (landing / name).write_text("\n".join(lines) + "\n")
        streamed.stream_steps(spark, str(landing), store)
        return {x.dedupe_key: (x.outcome, x.tokens) for x in stores.steps(store).collect()}

    assert land("a.json", step("1", "2026-05-01T10:00:00", 1), step("2", "2026-05-02T10:00:00", 1), step("3", "2026-05-02T11:00:00", 1, kind="dance"), step("4", "2026-05-02T12:00:00", 1, outcome="great")) == {"1": ("", 0), "2": ("", 0)}
    assert land("b.json", step("1", "2026-05-01T10:00:00", 3, outcome="error", tokens=7), step("1", "2026-05-01T10:00:00", 2, outcome="ok", tokens=9))["1"] == ("error", 7)
    # an older offer that comes later changes nothing, as state remembers the newer one
    assert land("c.json", step("1", "2026-05-01T10:00:00", 1, outcome="ok"), step("9", "2026-06-20T00:00:00", 1))["1"] == ("error", 7)
    # the horizon has passed what is offered now
    got = land("d.json", step("2", "2026-05-02T10:00:00", 5, outcome="ok"), step("0", "2026-05-03T00:00:00", 5), step("8", "2026-06-01T00:00:00", 1))
    assert got["2"] == ("", 0) and "0" not in got and "8" in got
    assert {x.dedupe_key for x in streamed.kept_steps(stores.steps(store)).collect()} == {"8", "9"}
    streamed.prune(store, "2026-06-25 00:00:00", 30)
    assert {x.dedupe_key for x in stores.steps(store).collect()} == {"8", "9"}


FACTS = "sessions_per_day double, conversational double, commands double, delegation double, off_hours double, rework double, premium double, cache_read double"
COUNTS = "tokens long, lines long, tool_calls long, rejections long, cost double, models long, weekend double, history_days double, plan double"


@pytest.mark.parametrize(("facts", "counts", "wanted"), [
    ((1.0, 0.5, 0.1, 0.01, 0.1, 0.01, 0.1, 0.1), (10**9, 50_000, None, 100, None, 5, 0.2, 90.0, 1.0), ("universal", "totals", None)),  # at a threshold none is cleared
    ((None,) * 8, (5, None, None, None, None, 1, None, 2.0, None), ("universal", "first days", None)),
    ((40.0, 0.9, 0.1, 0.2, 0.9, 0.06, 0.1, 0.1), (2 * 10**9, 1, 1, 1, 1.0, 1, 0.1, 90.0, None), ("scale", "tokens", 2e9)),  # ties go to the first
    ((40.0, 0.9, 0.1, 0.31, 0.9, 0.06, 0.1, 0.1), (2 * 10**9, 1, 1, 1, 1.0, 1, 0.1, 90.0, None), ("counterintuition", "delegation", 31.0)),
])
def test_the_opening_figure_clears_its_threshold_by_most(spark, facts, counts, wanted):
    from meterloom.operators import health

    got = health.hook(spark.createDataFrame([facts], FACTS), spark.createDataFrame([counts], COUNTS))
    assert got.columns == ["family", "figure", "value", "threshold", "clearance"]
    assert tuple(got.select("family", "figure", "value").first()) == wanted


def test_a_digest_compares_stored_runs(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "store"))
    values = lambda **v: spark.createDataFrame(list(v.items()), "metric string, value double")
    assert stores.digest(store, "7d").collect() == []
    stores.snapshot(store, "7d", "2026-07-01 00:00:00", values(a=1.0, b=2.0))
    assert sorted(tuple(x) for x in stores.digest(store, "7d").collect()) == [("a", 1.0, None, None), ("b", 2.0, None, None)]
    stores.snapshot(store, "7d", "2026-07-03 00:00:00", values(a=4.0, c=5.0))
    stores.snapshot(store, "30d", "2026-07-04 00:00:00", values(a=100.0))
    assert sorted(tuple(x) for x in stores.digest(store, "7d").collect()) == [("a", 4.0, 1.0, 3.0), ("b", None, 2.0, None), ("c", 5.0, None, None)]
    stores.clear(store)
    assert stores.digest(store, "7d").collect() == []


def test_windows_by_name():
    from meterloom.functions import windows

    assert windows.since("7d", "2026-07-20 15:30:00") == "2026-07-13 15:30:00"
    # 2 * 7 whole days, the later seven from the 14th to today
    assert windows.compared("7d", "2026-07-20 15:30:00") == ("2026-07-07 00:00:00", "2026-07-14")
    assert windows.compared("1d", "2026-03-01 00:00:00") == ("2026-02-28 00:00:00", "2026-03-01")
    for wrong in ("", "7", "7h", "d", "0d", "-3d", "7 d", "7d\n"):
        with pytest.raises(ValueError, match="window"):
            windows.days_of(wrong)


def test_reports_have_a_total_and_a_name_for_nameless_groups(spark):
    from meterloom.operators import reports

    rows = spark.createDataFrame([("", "turn", 3, 1, 10, 0, 1.5, 0.25), ("cli", "turn", 1, 3, 20, 20, None, 0.75)], "name string, granularity string, input_tokens long, cache_read_tokens long, tokens long, unpriced_tokens long, cost double, cache_eff double")
    got = {x.name: tuple(x)[1:] for x in reports.with_total(rows).collect()}
    assert got == {"(unknown)": ("turn", 3, 1, 10, 0, 1.5, 0.25), "cli": ("turn", 1, 3, 20, 20, None, 0.75), "TOTAL": ("turn", 4, 4, 30, 20, 1.5, 0.5)}
    assert reports.with_total(rows.limit(0)).collect() == []
