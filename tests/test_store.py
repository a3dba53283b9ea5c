"""The store of generations, whole pushes, and logs that grow, are cut short or rotated."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meterloom.schema import USAGE
from meterloom.sources import assistants, transcripts
from meterloom.streaming import growing
from meterloom.streaming import store as stores

NOW = "2026-07-20 00:00:00"


def reply(n, mid=None, **more):
    use = {"input_tokens": n, "output_tokens": 1}
    return {"type": "assistant", "uuid": f"u{n}", "sessionId": "s", "timestamp": "2026-07-01T10:00:00Z", "message": {"model": "m", "id": mid or f"r{n}", "usage": use, "content": [{"type": "tool_use", "id": f"t{n}", "name": "Edit", "input": {"file_path": "a.py"}}]}, **more}


def edit(n, added, removed, wrong=False):
    content = [{"type": "tool_result", "tool_use_id": f"t{n}", "is_error": wrong}]
    return {"type": "user", "uuid": f"e{n}", "sessionId": "s", "timestamp": "2026-07-01T10:00:01Z", "message": {"content": content}, "toolUseResult": {"filePath": "a.py", "structuredPatch": [{"lines": ["+x"] * added + ["-y"] * removed}]}}


def text(*lines):
    return "".join(json.dumps(x) + "\n" for x in lines)


def plain(df, drop=()):
    return sorted(map(str, df.select(*(c for c in df.columns if c not in drop)).collect()))


def same_as_one_read(spark, store, folder):
    files = [str(p) for p in folder.rglob("*.jsonl")]
    whole = transcripts.records(spark, files).select(*USAGE.names)
    got, want = plain(stores.usage(store)), plain(whole)
    assert [x for x in got if x not in want] == [x for x in want if x not in got]
    assert got == want
    told = transcripts.steps(spark, files).drop("file")
    assert plain(stores.steps(store).drop("tool", "member").select(*told.columns)) == plain(told)


@pytest.mark.parametrize("split", [64 << 20, 50])
def test_logs_grow(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(growing, "SPLIT", split)
    folder = tmp_path / "logs"
    (folder / "sub").mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "sub" / "b.jsonl"
    a.write_text(text(reply(1, cwd="/w/proj", gitBranch="x"), edit(1, 5, 0)))
    b.write_text("{broken\n\n" + text(reply(50)) + "é" * 3000 + "\r\n")
    store = stores.Store(spark, str(tmp_path / "store"))
    first = growing.import_growing(store, str(folder))
    assert first.number == 1
    same_as_one_read(spark, store, folder)
    assert growing.import_growing(store, str(folder)) == first  # nothing is new

    # what a parser carries over the end of the last run: where work is done, the response that goes on, lines to be undone, ids seen before
    line = text(edit(2, 1, 1))
    with a.open("a") as f:
        f.write(text(reply(2, "r1"), reply(2, "r1"), edit(1, 5, 0), edit(3, 0, 3, True), reply(4)) + line[:40])
    (folder / "c.jsonl").write_text(text(reply(70)))
    growing.import_growing(stores.Store(spark, store.path), str(folder))
    with a.open("a") as f:
        f.write(line[40:] + text({"uuid": "c", "subtype": "compact_boundary", "sessionId": "s", "timestamp": "2026-07-01T10:00:05Z"}))
    growing.import_growing(stores.Store(spark, store.path), str(folder))
    same_as_one_read(spark, store, folder)
    assert [x.rework_lines for x in stores.usage(store).where("dedupe_key IN ('r1', 'r4')").orderBy("dedupe_key").collect()] == [3, 1]

    before = stores.usage(store).count()
    growing.compact_log_tables(store)
    stores.compact(store)
    assert len(store.newest().tables["usage"]) == len(store.newest().tables[f"facts-{growing.TOOL}"]) == 1
    same_as_one_read(spark, store, folder)
    with b.open("a") as f:
        f.write(text(edit(50, 2, 2)))
    growing.import_growing(store, str(folder))
    same_as_one_read(spark, store, folder)
    assert stores.usage(store).count() == before


def test_only_what_was_added_is_read(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "a.jsonl"
    log.write_text(text(*(reply(n) for n in range(200))))
    store = stores.Store(spark, str(tmp_path / "store"))
    growing.import_growing(store, str(folder))
    was = log.stat().st_size
    # were old lines read again, this one would be seen
    whole = log.read_text()
    log.write_text(whole[: was // 2] + whole[was // 2 :].replace('"input_tokens": 150', '"input_tokens": 999') + text(reply(300)))
    growing.import_growing(store, str(folder))
    got = {x.dedupe_key: x.input_tokens for x in stores.usage(store).collect()}
    assert got["r150"] == 150 and got["r300"] == 300 and len(got) == 201
    place = store.table(f"positions-{growing.TOOL}", schema=spark.createDataFrame([], growing.POSITION).schema).orderBy("seq").collect()
    assert [x.offset for x in place] == [was, log.stat().st_size]


def test_logs_that_are_cut_short_or_rotated(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_text(text(*(reply(n) for n in range(9))))
    b.write_text(text(reply(20), reply(21)))
    store = stores.Store(spark, str(tmp_path / "store"))
    growing.import_growing(store, str(folder))
    a.write_text(text(reply(1), edit(1, 2, 0)))  # shorter than what was read
    b.write_text(text(*(reply(n) for n in range(30, 40))))  # longer, but another log
    growing.import_growing(store, str(folder))
    got = {x.dedupe_key: x.lines_added for x in stores.usage(store).collect()}
    assert set(got) == {f"r{n}" for n in (*range(9), 20, 21, *range(30, 40))}
    assert got["r1"] == 2
    with a.open("a") as f:
        f.write(text(reply(60)))
    growing.import_growing(store, str(folder))
    assert stores.usage(store).where("dedupe_key = 'r60'").count() == 1


def offers(spark, *keys, **more):
    rows = [{"tool": "codex", "session_id": f"s{k}", "granularity": "turn", "dedupe_key": k, "model": "m", "input_tokens": 5} | more for k in keys]
    said = [(json.dumps({"ts": "2026-07-01T10:00:00"} | r),) for r in rows]
    return spark.createDataFrame(said, "value string").select(F.from_json("value", USAGE).alias("r")).select("r.*").na.fill("").na.fill(0)


class Died(Exception):
    pass


@pytest.mark.parametrize("dies_at", ["first table", "second table", "before the manifest", "in the manifest"])
def test_a_run_that_dies_leaves_a_whole_generation(spark, tmp_path, monkeypatch, dies_at):
    store = stores.Store(spark, str(tmp_path / "store"))
    base = store.newest()
    old = store.change(base, append={"usage": stores.offered(offers(spark, "1"), base), "labels": spark.createDataFrame([("s1", "", "bugfix", "", "")], stores.TABLES["labels"])})
    seen, write = [], stores.Store._write

    def dying(self, name, df):
        seen.append(name)
        if dies_at == ("first table", "second table", "")[len(seen) - 1]:
            raise Died
        return write(self, name, df)

    def unpublished(self, base, tables):
        if dies_at == "in the manifest":
            (tmp_path / "store" / "generations" / f"{base.number + 1:012}.json").write_text('{"number": 2, "tab')
        raise Died

    with monkeypatch.context() as m:
        m.setattr(stores.Store, "_write", dying)
        if "manifest" in dies_at:
            m.setattr(stores.Store, "_publish", unpublished)
        with pytest.raises(Died):
            stores.clear(store)
    again = stores.Store(spark, store.path)
    assert again.newest() == old
    assert stores.usage(again).count() == again.table("labels").count() == 1
    new = stores.clear(again)
    assert new.number > old.number and stores.usage(again).count() == again.table("labels").count() == 0
    assert stores.usage(again, old).count() == 1  # readers of the old generation go on with it


def test_one_of_two_runs_is_overtaken(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "store"))
    base = store.newest()
    store.change(base, append={"usage": stores.offered(offers(spark, "1"), base)})
    with pytest.raises(stores.Overtaken):
        store.change(base, append={"usage": stores.offered(offers(spark, "2"), base)})
    assert [x.dedupe_key for x in stores.usage(store).collect()] == ["1"]
    gone = store.sweep(older_than=-5)
    assert len(gone) == 1 and stores.usage(store).count() == 1
    assert store.sweep(older_than=-5) == []


@pytest.mark.parametrize(("before", "tool", "read_again"), [("", "", True), ("", "claude-code", True), ("", "codex", False), ("2027-01-01 00:00:00", "", False)])
def test_clear_forgets_positions_only_where_it_is_not_by_time(spark, tmp_path, before, tool, read_again):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text(text(reply(1)))
    store = stores.Store(spark, str(tmp_path / "store"))
    growing.import_growing(store, str(folder))
    stores.snapshot(store, "7d", NOW, spark.createDataFrame([("cost", "1.5")], "metric string, value string"))
    base = stores.clear(store, before, tool)
    assert "snapshots" not in base.tables
    there = 0 if not tool or tool == "claude-code" else 1
    assert stores.usage(store).count() == stores.steps(store).where("kind = 'assistant'").count() == there
    growing.import_growing(store, str(folder))
    assert stores.usage(store).count() == (1 if read_again else there)


def test_snapshots_of_twelve_runs_stay(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "store"))
    values = lambda k: spark.createDataFrame([("cost", k), ("lines", 1)], "metric string, value long")
    stores.snapshot(store, "30d", NOW, values(99))
    for day in range(1, 14):
        stores.snapshot(store, "7d", f"2026-07-{day:02} 00:00:00", values(day))
    stores.snapshot(store, "7d", "2026-07-13 00:00:00", values(77))
    rows = store.table("snapshots").where("metric = 'cost'").orderBy("window", "taken").collect()
    assert [x.value for x in rows] == ["99", *map(str, range(2, 13)), "77"]


def test_a_push_is_taken_or_refused_as_a_whole(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "store"))
    bad = offers(spark, "1", "2").unionByName(offers(spark, "3", reasoning_tokens=9))
    base, refused = stores.push(store, bad, "p1", "ann", NOW)
    assert refused == 1 and stores.usage(store).count() == 0
    assert [(x.dedupe_key, x.reason, x.push) for x in store.table("refused").collect()] == [("3", "reasoning", "p1")]
    stores.push(store, offers(spark, "1", "2"), "p2", "ann", NOW)
    last, _ = stores.push(store, offers(spark, "1"), "p3", "bob", NOW)
    assert sorted(x.dedupe_key for x in stores.usage(store).collect()) == ["ann:1", "ann:2", "bob:1"]
    assert stores.push(store, offers(spark, "1", "2"), "p2", "ann", NOW) == (last, 0)
    newer, _ = stores.push(store, offers(spark, "2", input_tokens=8, edits=2), "p4", "ann", NOW)
    assert newer.number == last.number + 1
    assert [(x.input_tokens, x.edits, x.member) for x in stores.usage(store).where("dedupe_key = 'ann:2'").collect()] == [(8, 2, "ann")]
    broken = offers(spark, "9").withColumn("raw", F.lit("{"))
    assert stores.push(store, broken, "p5", "ann", NOW)[1] == 1
    for member in ("", "a:b", "x" * 65):
        with pytest.raises(ValueError, match="member"):
            stores.push(store, bad, "p", member, NOW)


def test_empty_folders_and_stores(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    store = stores.Store(spark, str(tmp_path / "store"))
    assert growing.import_growing(store, str(folder)).number == 0
    assert stores.usage(store).count() == stores.steps(store).count() == 0
    assert stores.compact(store).number == growing.compact_log_tables(store).number == 0
    (folder / "empty.jsonl").write_text("")
    growing.import_growing(store, str(folder))
    assert stores.usage(store).count() == 0
    os.utime(folder / "empty.jsonl", (1, 1))
    growing.import_growing(store, str(folder))
    assert stores.usage(store).count() == 0


def test_other_formats_read_a_file_again_when_it_changes(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    line = lambda s, n: {"sessionId": s, "timestamp": "2026-07-01T10:00:00Z", "model": "m", "tokens": {"input": n, "output": 1, "total": n + 1}}
    (folder / "a.jsonl").write_text(text(line("s1", 5), line("s1", 6)))
    store = stores.Store(spark, str(tmp_path / "store"))
    first = growing.import_changed(store, str(folder), "gemini-cli", assistants.gemini, NOW)
    assert growing.import_changed(store, str(folder), "gemini-cli", assistants.gemini, NOW) == first
    with (folder / "a.jsonl").open("a") as f:
        f.write(text(line("s1", 9)))
    (folder / "b.jsonl").write_text(text(line("s2", 7)))
    growing.import_changed(store, str(folder), "gemini-cli", assistants.gemini, NOW, files=1)
    assert sorted(x.input_tokens for x in stores.usage(store).collect()) == [5, 6, 7, 9]
    last = store.newest()
    assert growing.import_changed(store, str(folder), "gemini-cli", assistants.gemini, NOW) == last
    assert growing.import_changed(store, str(folder), "gemini-cli", assistants.gemini, NOW, build="next").number == last.number + 1  # another build reads all once
    assert stores.usage(store).count() == 4


def test_what_turns_out_empty_makes_no_generation(spark, tmp_path):
    from meterloom.streaming import store as stores

    store = stores.Store(spark, str(tmp_path / "empty"))
    none = spark.createDataFrame([], stores.OFFER)
    assert store.change(store.newest(), append={"usage": none}, unless_empty=True) == store.newest()
    assert store.newest().number == 0 and not store.sweep(0)


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(8):
        (folder / f"{k}.jsonl").write_text(text(reply(k)))
    growing.import_growing(stores.Store(spark, str(tmp_path / "store")), str(folder))
    sizes = [(str(p), 0, p.stat().st_size, 0) for p in folder.iterdir()]
    changed = spark.createDataFrame(sizes, "file string, epoch long, size long, start long")
    out = str(tmp_path / "out")
    growing.added_lines(changed).withColumn("task", F.spark_partition_id()).write.parquet(out)
    assert spark.read.parquet(out).select("task").distinct().count() == 8


def test_an_import_makes_anew_only_what_new_lines_add_to(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "a.jsonl"
    log.write_text(text(*(reply(n) for n in range(20))))
    store = stores.Store(spark, str(tmp_path / "store"))
    growing.import_growing(store, str(folder))
    with log.open("a") as f:
        f.write(text(edit(19, 4, 0), edit(3, 0, 1, True), reply(20)))
    growing.import_growing(store, str(folder))
    # the last response has new lines, a call of an older one a result, and one response is new
    offers = lambda table: store.table(table).groupBy("seq.batch").count().orderBy("batch").collect()
    assert [tuple(x) for x in offers("usage")] == [(1, 20), (2, 2)]
    assert [tuple(x) for x in offers("steps")] == [(1, 40), (2, 4)]
    same_as_one_read(spark, store, folder)


def _said(rng, name, k):
    """Any line, which may go on with, answer, repeat or undo what any line before it said."""
    past = lambda: rng.randrange(max(0, k - 30), k + 1)
    about = {"uuid": f"{name}{past() if rng.random() < 0.15 else k}", "sessionId": name, "timestamp": f"2026-07-01T10:{k // 60:02}:{k % 60:02}Z"}
    about |= {c: f"{v}{rng.randrange(3)}" for c, v in (("cwd", "/w/p"), ("gitBranch", "b"), ("agentId", "g")) if rng.random() < 0.2}
    kind = rng.choice(["reply"] * 4 + ["result"] * 3 + ["edit"] * 2 + ["denial", "compaction", "agent", "stub", "broken", "blank"])
    if kind == "reply":
        tools = [{"type": "tool_use", "id": f"{name}t{k}-{i}" if rng.random() < 0.7 else "", "name": rng.choice(["Edit", "Bash", "Read"]), "input": {"file_path": f"src/{rng.randrange(9)}.py"} if rng.random() < 0.7 else {}} for i in range(rng.randrange(3))]
        use = {"input_tokens": rng.randrange(99), "output_tokens": rng.randrange(99)}
        return about | {"type": "assistant", "attributionSkill": rng.choice(["", "s1"]), "message": {"model": "m", "id": f"{name}r{past() if rng.random() < 0.4 else k}", "usage": use, "content": tools, "stop_reason": rng.choice([None, "end_turn", "max_tokens"])}}
    results = [{"type": "tool_result", "tool_use_id": f"{name}t{past()}-{rng.randrange(2)}", "is_error": rng.random() < 0.5} for _ in range(rng.randrange(1, 3))]
    if kind == "edit":
        return about | {"type": "user", "message": {"content": results}, "toolUseResult": {"filePath": f"src/{rng.randrange(4)}.py", "structuredPatch": [{"lines": ["+x"] * rng.randrange(6) + ["-y"] * rng.randrange(6)}]}}
    if kind in ("agent", "stub"):
        done = {"usage": {"input_tokens": rng.randrange(50)}, "toolStats": {"linesAdded": 2, "linesRemoved": 1}} if kind == "agent" else {}
        return about | {"type": "user", "toolUseResult": {"agentId": f"{name}a{rng.randrange(3)}", "resolvedModel": "n"} | done}
    more = {"denial": {"toolDenialKind": "user"}, "compaction": {"subtype": "compact_boundary"}}.get(kind, {})
    return {"broken": "{", "blank": ""}.get(kind, about | {"type": "user", "message": {"content": results}} | more)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_log_in_any_parts_is_as_read_at_once(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(transcripts, "STRETCH_BYTES", 11)
    rng = random.Random(seed)
    folder = tmp_path / "logs"
    folder.mkdir()
    logs = {}
    for name in "ab":
        lines = (_said(rng, name, k) for k in range(150))
        logs[name] = "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines).encode()
    ends = {name: [*sorted(rng.randrange(len(log)) for _ in range(2)), len(log)] for name, log in logs.items()}
    store = stores.Store(spark, str(tmp_path / "store"))
    for part in range(3):
        for name, log in logs.items():
            (folder / f"{name}.jsonl").write_bytes(log[: ends[name][part]])
        growing.import_growing(store, str(folder))
    same_as_one_read(spark, store, folder)
