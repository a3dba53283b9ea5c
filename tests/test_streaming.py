"""The streaming import: it resumes, restates, quarantines, and repeats nothing."""

import json

from meterloom.streaming import imports

NOW = "2026-07-20 00:00:00"


def offer(key, tool="codex", **more):
    return {"tool": tool, "session_id": "s", "granularity": "turn", "ts": "2026-07-01T10:00:00", "dedupe_key": key, "model": "m"} | more


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def stored(spark, store):
    return {r.dedupe_key: r.asDict() for r in imports.usage(spark, store).collect()}


def test_pushed_records_resume_and_restate(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    land(landing, "a.json", offer("1", input_tokens=10, edits=1), offer("2", input_tokens=5), offer("", input_tokens=1), "no record", offer("3", reasoning_tokens=2, output_tokens=1))
    imports.import_pushed(spark, str(landing), store, NOW)
    assert {k: v["input_tokens"] for k, v in stored(spark, store).items()} == {"1": 10, "2": 5}
    assert sorted(r.reason for r in imports.quarantine(spark, store).collect()) == ["dedupe_key", "malformed", "reasoning"]

    imports.import_pushed(spark, str(landing), store, NOW)  # nothing has landed
    assert len(stored(spark, store)) == 2 and imports.offers(spark, store).count() == 2

    land(landing, "b.json", offer("1", input_tokens=7, edits=4, model="other"), offer("4", model=""), offer("1", tool="cline"))
    imports.import_pushed(spark, str(landing), store, NOW)
    got = {(r.tool, r.dedupe_key): r for r in imports.usage(spark, store).collect()}
    assert set(got) == {("codex", "1"), ("codex", "2"), ("codex", "4"), ("cline", "1")}
    one = got["codex", "1"]
    assert (one.input_tokens, one.edits, one.model) == (10, 4, "m")  # counts grow, activity is as last derived, what it is about stays

    again = spark.createDataFrame([], imports.USAGE)
    imports.merge_batch(again, 7, store, NOW)
    assert imports.offers(spark, store).count() == 5
    kept = imports.usage(spark, imports.compact(spark, store, str(tmp_path / "compact")))
    assert sorted(map(str, kept.collect())) == sorted(map(str, got.values()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    land(tmp_path / "landing", "a.json", *(offer(str(k), input_tokens=k) for k in range(20)))
    batch = spark.read.schema(imports.LANDED).json(str(tmp_path / "landing"))
    for number in (0, 1, 1, 0):
        imports.merge_batch(batch, number, store, NOW)
    assert imports.offers(spark, store).count() == 40 and len(stored(spark, store)) == 20


def test_days_are_given_once_they_are_over(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "a.json", offer("1", input_tokens=3), offer("2", input_tokens=4), offer("3", ts="2026-07-09T00:00:00", input_tokens=1))
    stream = imports.usage_daily_stream(spark, str(landing))
    run = stream.writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.day, r.tool, r.records, r.input_tokens) for r in spark.table("daily").collect()] == [("2026-07-01", "codex", 2, 7)]
