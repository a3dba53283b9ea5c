"""Surfaces by cases with known answers: exports, reconciliation, validation, kinds of files, pseudonyms, restated signals."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meterloom.functions import amounts
from meterloom.operators import etl, surfaces
from meterloom.schema import USAGE
from meterloom.sources import exports


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.mark.parametrize(
    ("said", "day"),
    [
        ("2026-07-01", "2026-07-01"), (" 2026-07-01 ", "2026-07-01"), ("2026-07-01T23:30:00Z", "2026-07-01"), ("2026-07-01T23:30:00-04:00", "2026-07-02"),
        ("2026-07-01T10:00:00", "2026-07-01"), ("2026-07-01 10:00:00", "2026-07-01"), ("2026-07-01 10:00", "2026-07-01"), ("2026/07/01", "2026-07-01"),
        ("01.07.2026", None), ("", None), ("yesterday", None), ("2026-13-01", None),
    ],
)
def test_days(spark, said, day):
    assert table(spark, "x string", (said,)).select(amounts.day_of(F.col("x"))).first()[0] == day


def test_money_and_counts(spark):
    money = {"$1,234.50": 1234.5, "(12.00)": -12.0, "12 USD": 12.0, " 0 ": 0.0, "-3.5": -3.5, "": None, "free": None, "($1,000)": -1000.0, "1e3": 1000.0}
    got = table(spark, "x string", *((x,) for x in money)).select("x", amounts.money(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in got} == money
    counts = {"1,234": 1234, "12.0": 12, "12.5": None, "": None, "many": None, "9 000": 9000}
    got = table(spark, "x string", *((x,) for x in counts)).select("x", amounts.whole(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in got} == counts


def test_exports_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Usage Date,Model-Name,"Amount USD",Total Tokens,Note\n2026-07-01,"m, one","$1,000.50","1,000",x\nbad,m,1,,\n2026-07-02,,oops,,\n2026-07-03\n')
    rows = exports.read_export(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in exports.sound(rows).collect()] == [("2026-07-01", "m, one", 1000.5, 1000, None)]
    assert tuple(exports.skipped(rows).first()) == (4, 3)
    (tmp_path / "b.json").write_text('[{"date": "2026-07-01", "spend": 1.5, "currency": "usd"}, {"date": "2026-07-02", "spend": "(2)", "sku": " M "}]')
    assert [tuple(r) for r in exports.read_export(spark, str(tmp_path / "b.json")).orderBy("day").collect()] == [("2026-07-01", "", 1.5, None, "USD"), ("2026-07-02", "M", -2.0, None, None)]
    (tmp_path / "c.csv").write_text("when,paid\n2026-07-01,3\n")
    with pytest.raises(ValueError, match="no column is read as day"):
        exports.read_export(spark, str(tmp_path / "c.csv"))
    mapped = exports.parse_map("day=when, cost=paid")
    assert exports.sound(exports.read_export(spark, str(tmp_path / "c.csv"), mapped)).first().cost == 3
    for wrong in ("day", "=x", "year=x"):
        with pytest.raises(ValueError):
            exports.parse_map(wrong)


def reconciled(spark, export, estimate, first="2026-07-01", last="2026-07-31"):
    billed = table(spark, "day string, model string, cost double", *export)
    ours = table(spark, "day string, model string, cost double, tokens long", *estimate)
    return surfaces.reconcile(billed, ours, first, last).first()


def test_named_causes_leave_the_rest_unexplained(spark):
    ours = [("2026-07-01", "claude-a", 10.0, 100), ("2026-07-01", "mystery", None, 50), ("2026-07-02", "local-only", 2.0, 100)]
    r = reconciled(spark, [("2026-07-01", "CLAUDE-A ", 12.0), ("2026-07-02", "web-only", 3.0)], ours)
    assert (r.billed, r.estimated, r.delta) == (15.0, 12.0, 3.0)
    assert (r.extrapolated, r.upper) == (3.0, 15.0) and r.in_band  # 50 tokens at 12 / 200
    assert (r.only_billed, r.only_estimated, r.unexplained) == (3.0, 2.0, -1.0)
    assert (r.unpriced_tokens, r.unpriced_rows, r.shared_models) == (50, 1, 1)


def test_models_are_not_matched_by_guesswork(spark):
    ours = [("2026-07-01", "claude-a", 10.0, 100)]
    for model in ("API usage", ""):
        r = reconciled(spark, [("2026-07-01", model, 12.0)], ours)
        assert (r.only_billed, r.only_estimated, r.unexplained, r.shared_models) == (0.0, 0.0, 2.0, 0)


def test_days_of_one_side_are_left_out_and_told(spark):
    ours = [("2026-06-30", "m", 1.0, 1), ("2026-07-01", "m", 10.0, 100), ("2026-07-02", "m", 4.0, 40), ("2026-07-09", "m", 5.0, 50)]
    r = reconciled(spark, [("2026-06-30", "m", 9.0), ("2026-07-01", "m", 10.0), ("2026-07-03", "m", 1.0)], ours)
    assert (r.billed, r.estimated) == (11.0, 14.0)  # the second stands in the export's span, unbilled
    assert (r.overlap_days, r.export_only_days, r.window_only_days, r.billed_outside, r.estimated_outside) == (3, 1, 2, 9.0, 6.0)
    assert reconciled(spark, [], ours).overlap_days == 0


def record(**changed):
    row = {f.name: {"string": "", "bigint": 0}.get(f.dataType.simpleString()) for f in USAGE.fields}
    import datetime

    return row | {"tool": "claude-code", "session_id": "s", "granularity": "turn", "dedupe_key": "k", "ts": datetime.datetime(2026, 7, 1)} | changed


@pytest.mark.parametrize(
    ("changed", "reason"),
    [
        ({}, None), ({"session_id": ""}, None), ({"member": "any thing"}, None), ({"tool": "plugin:my-tool"}, None), ({"cache_miss_reason": "tools_changed"}, None),
        ({"dedupe_key": ""}, "dedupe_key"), ({"project": "é" * 257}, "length"), ({"project": "é" * 256}, None), ({"cache_miss_reason": "Tools"}, "cache_miss_reason"),
        ({"cache_miss_reason": "x\n"}, "cache_miss_reason"), ({"tool": "plugin:"}, "tool"), ({"tool": "plugin:Big"}, "tool"), ({"tool": ""}, "tool"), ({"granularity": "day"}, "granularity"),
        ({"tool_errors": -1}, "count"), ({"compactions": 1_000_000_001}, "count"), ({"rework_lines": 1_000_000_000}, None), ({"cache_write_1h": 2, "cache_write_tokens": 1}, "cache_write_1h"),
        ({"reasoning_tokens": 2, "output_tokens": 1}, "reasoning"), ({"sidechain": 2}, "sidechain"), ({"sidechain": -1}, "count"),
        ({"tool_calls": 3, "tool_reads": 1}, "purposes"), ({"tool_calls": 3, "tool_reads": 1, "tool_other": 2}, None), ({"tool_calls": 3}, None),
    ],
)
def test_records_are_refused_for_a_reason(spark, changed, reason):
    df = spark.createDataFrame([record(**changed)], USAGE)
    assert df.select(etl.reject_reason("2026-07-02 00:00:00")).first()[0] == reason


def test_times_out_of_range_are_refused(spark):
    import datetime

    times = {datetime.datetime(2019, 12, 31, 23, 59, 59): "timestamp", datetime.datetime(2020, 1, 1): None, datetime.datetime(2026, 7, 4): None, datetime.datetime(2026, 7, 4, 0, 0, 1): "timestamp"}
    df = spark.createDataFrame([record(ts=t) for t in times], USAGE).select("ts", etl.reject_reason("2026-07-02 00:00:00").alias("r"))
    assert {r.ts: r.r for r in df.collect()} == times


def test_signals_are_filled_in_once(spark):
    stored = spark.createDataFrame([record(dedupe_key="a"), record(dedupe_key="b", skill="own"), record(dedupe_key="c")], USAGE)
    offered = [record(dedupe_key="a") | {"seq": 1}, record(dedupe_key="a", tool_reads=2, agent="x", input_tokens=9) | {"seq": 2}, record(dedupe_key="a", tool_reads=7) | {"seq": 3}, record(dedupe_key="b", tool_reads=5) | {"seq": 1}, record(dedupe_key="new", tool_reads=5) | {"seq": 1}]
    offered = spark.createDataFrame(offered, StructType([*USAGE.fields, StructField("seq", LongType())]))
    got = {r.dedupe_key: (r.tool_reads, r.skill, r.agent, r.input_tokens) for r in etl.restate_signals(stored, offered).collect()}
    assert got == {"a": (2, "", "x", 0), "b": (0, "own", "", 0), "c": (0, "", "", 0)}


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("vendor/x/x_test.go", "generated"), ("go.sum", "generated"), ("a/b.pb.go", "generated"), ("web/app.min.js", "generated"), ("Cargo.lock", "generated"),
        ("pkg/a_test.go", "test"), ("testdata/a.json", "test"), ("ui/a.spec.ts", "test"), ("test_a.py", "test"), ("docs/a.go", "docs"), ("README.md", "docs"), ("LICENSE", "docs"),
        ("a/Dockerfile", "config"), (".github/workflows/x.yml", "config"), (".gitignore", "config"), ("go.mod", "config"), ("src/main.RS", "source"), ("a.go", "source"), ("bin/tool", "other"), ("a.png", "other"),
    ],
)
def test_kinds_of_files(spark, path, kind):
    assert table(spark, "p string", (path,)).select(surfaces.path_kind(F.col("p"))).first()[0] == kind


def test_changed_files_of_commits(spark):
    log = ["commit:c1", "", "3\t1\tsrc/{old => new}/a.go", "-\t-\timg.png", "commit:c2", "2\t0\tx.py => docs/y.md", "5\t5\tsrc/{ => sub}/b_test.go"]
    lines = table(spark, "file string, seq int, line string", *(("f", k, x) for k, x in enumerate(log)))
    assert sorted(map(tuple, surfaces.numstat(lines).collect()), key=str) == sorted([("c1", "src/new/a.go", 3, 1), ("c1", "img.png", None, None), ("c2", "docs/y.md", 2, 0), ("c2", "src/sub/b_test.go", 5, 5)], key=str)
    got = {(r.commit, r.kind): (r.files, r.added, r.removed) for r in surfaces.categories(surfaces.numstat(lines)).collect()}
    assert got == {("c1", "source"): (1, 3, 1), ("c1", "other"): (1, 0, 0), ("c2", "docs"): (1, 2, 0), ("c2", "test"): (1, 5, 5)}


def test_pseudonyms_are_keyed_hashes(spark):
    for secret in (b"k" * 32, b"long" * 30):
        names = ["alice", "é", "", None]
        got = [r[0] for r in table(spark, "n string", *((n,) for n in names)).select(surfaces.pseudonym("member", F.col("n"), secret)).collect()]
        want = ["member-" + hmac.new(secret, f"member:{n}".encode(), hashlib.sha256).hexdigest()[:10] if n else "unknown" for n in names]
        assert got == want
