"""Log formats: small files of our own, one for each rule that a format has."""

import json
import re

from meterloom.sources import assistants, transcripts


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def rows(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [r[k] for k in keys or ("dedupe_key",)])


def test_messages_with_tokens(spark, tmp_path):
    path = put(tmp_path / "g.jsonl", [
        {"sessionId": "s1", "timestamp": "2025-05-01T10:00:00.9Z", "model": "m", "tokens": {"input": 100, "output": 10, "cached": 30, "thoughts": 5, "tool": 2, "total": 147}},
        "not json",
        {"timestamp": "2025-05-01T10:01:00Z", "model": "m", "tokens": {"input": 0, "output": 0, "total": 0}},
        {"timestamp": "2025-05-01T10:02:00Z", "model": "m", "tokens": {"input": 10, "output": 1, "cached": 99, "total": 11}},
    ])
    a, b = rows(assistants.gemini(spark, path))
    assert (a["session_id"], a["input_tokens"], a["cache_read_tokens"], a["output_tokens"], a["reasoning_tokens"]) == ("s1", 70, 30, 17, 5)
    assert (b["session_id"], b["input_tokens"], b["cache_read_tokens"]) == ("s1", 0, 10)
    assert str(a["ts"]) == "2025-05-01 10:00:00" and a["dedupe_key"].endswith(":s1:0") and b["dedupe_key"].endswith(":s1:1")


def test_session_totals(spark, tmp_path):
    one = lambda n, i, o: {"requests": {"count": n}, "usage": {"reasoningTokens": 99}, "tokenDetails": {"input": {"tokenCount": i}, "output": {"tokenCount": o}, "cache_read": {"tokenCount": 3}, "cache_write": {"tokenCount": 4}}}
    path = put(tmp_path / "c.jsonl", [
        {"type": "session.start", "timestamp": "2025-05-01T10:00:00Z", "data": {"sessionId": "s2", "context": {"cwd": "/home/x/repo"}}},
        {"type": "session.shutdown", "timestamp": "2025-05-01T11:00:00Z", "data": {"codeChanges": {"linesAdded": 7, "linesRemoved": 2}, "modelMetrics": {"b": one(2, 5, 6), "a": one(2, 8, 9), "c": one(1, -1, 0)}}},
    ])
    a, b, c = rows(assistants.copilot(spark, path), "model")
    assert (a["model"], a["lines_added"], b["lines_added"]) == ("a", 7, 0)
    assert (a["input_tokens"], a["reasoning_tokens"], c["input_tokens"], c["reasoning_tokens"]) == (8, 9, 0, 0)
    assert a["granularity"] == "session" and a["project"] == "repo" and a["dedupe_key"] == "s2:a"


def test_task_messages(spark, tmp_path):
    ask = lambda ts, **t: {"type": "say", "say": "api_req_started", "ts": ts, "text": json.dumps(t)}
    put(tmp_path / "t1" / "ui_messages.json", [json.dumps([ask(1000, tokensIn=5, tokensOut=1), ask(500, tokensIn=1, tokensOut=1), ask(3000, tokensIn=0, tokensOut=0), {"type": "say", "say": "text", "ts": 1, "text": "x"}, ask(9000, tokensIn=2, tokensOut=3, cacheReads=4, cacheWrites=5)])])
    put(tmp_path / "t1" / "task_metadata.json", [json.dumps({"model_usage": [{"ts": 8000, "model_id": "late"}, {"ts": 900, "model_id": "early"}]})])
    a, b, c = rows(assistants.cline(spark, str(tmp_path)))
    assert [x["model"] for x in (a, b, c)] == ["early", "early", "late"]
    assert (c["cache_read_tokens"], c["cache_write_tokens"], c["dedupe_key"]) == (4, 5, "t1:2")


def test_rollouts(spark, tmp_path):
    msg = lambda **p: {"type": "event_msg", "timestamp": "2025-05-01T10:00:00Z", "payload": p}
    used = lambda i, c, o, r: msg(type="token_count", info={"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}})
    call = lambda name, **k: {"type": "response_item", "timestamp": "2025-05-01T10:00:00Z", "payload": {"type": "function_call", "name": name, **k}}
    diff = "--- a\n+++ b\n@@ -1 +1 @@\n-old\n+new\n+++ kept\n"
    path = put(tmp_path / "r.jsonl", [
        {"type": "session_meta", "timestamp": "2025-05-01T10:00:00Z", "payload": {"id": "s3", "cwd": "/w/p", "model": "m0"}},
        {"type": "turn_context", "payload": {"model": "m1"}},
        call("shell"), msg(type="patch_apply_end", success=True, changes={"f": {"type": "add", "content": "1\n2\n3"}}),
        used(100, 40, 10, 4), used(100, 40, 10, 4),
        call("shell", status="failed"), msg(type="patch_apply_end", success=False, changes={}), msg(type="patch_apply_end", success=True, changes={"f": {"type": "update", "unified_diff": diff}}),
        used(150, 60, 15, 9), {"type": "compacted"}, call("apply_patch"),
    ])
    a, b = rows(assistants.codex(spark, path))
    assert (a["session_id"], a["model"], a["project"]) == ("s3", "m1", "p")
    assert (a["input_tokens"], a["cache_read_tokens"], a["output_tokens"], a["reasoning_tokens"]) == (60, 40, 10, 4)
    assert (a["lines_added"], a["edits"], a["tool_calls"], a["tool_commands"], a["tool_writes"]) == (3, 1, 2, 1, 1)
    assert (b["input_tokens"], b["cache_read_tokens"], b["output_tokens"], b["reasoning_tokens"]) == (30, 20, 5, 5)
    # the trailing call is the last record's, and of its own flush: the patches before it stay writes
    assert (b["lines_added"], b["lines_removed"], b["rework_lines"], b["edits"], b["tool_errors"], b["compactions"]) == (2, 1, 1, 1, 2, 1)
    assert (b["tool_commands"], b["tool_writes"], b["tool_calls"]) == (1, 3, 4)


def transcript(tmp_path):
    use = lambda i, o, w=0, h=0: {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": w, "cache_read_input_tokens": 1, "cache_creation": {"ephemeral_1h_input_tokens": h}}
    said = lambda uuid, mid, u, *blocks, **k: {"type": "assistant", "uuid": uuid, "sessionId": "s4", "timestamp": "2025-05-01T10:00:00Z", "message": {"model": "m", "id": mid, "usage": u, "content": list(blocks)}, **k}
    tool = lambda i, name, **k: {"type": "tool_use", "id": i, "name": name, "input": k}
    back = lambda uuid, i, err=False, **k: {"type": "user", "uuid": uuid, "sessionId": "s4", "timestamp": "2025-05-01T10:00:01Z", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": err}]}, **k}
    return put(tmp_path / "t.jsonl", [
        said("u1", "r1", use(5, 1, 9, 4), tool("t1", "Read"), cwd="/w/proj", gitBranch="feat/x", entrypoint="cli"),
        said("u2", "r1", use(5, 8, 9, 20), tool("t2", "Edit", file_path="a.py"), attributionSkill="review"),
        said("u2", "r1", use(5, 8, 9, 4), tool("t2", "Edit", file_path="a.py")),
        back("u3", "t1", True), "{broken",
        back("u4", "t2", toolUseResult={"filePath": "a.py", "structuredPatch": [{"lines": ["+1", "+2", "-0", " c"]}]}),
        back("u5", "t9", True, toolDenialKind="user"),
        {"uuid": "u6", "subtype": "compact_boundary", "timestamp": "2025-05-01T10:00:02Z", "sessionId": "s4"}, {"uuid": "u7", "isCompactSummary": True},
        said("u8", "", use(2, 2), tool("t3", "Bash")),
        back("u9", "t3", toolUseResult={"filePath": "a.py", "type": "create", "structuredPatch": [], "content": "x\ny"}),
        back("u10", "t3", toolUseResult={"filePath": "a.py", "structuredPatch": [{"lines": ["-1", "-2", "-3"]}]}),
        {"uuid": "u11", "type": "user", "sessionId": "s4", "timestamp": "2025-05-01T10:00:03Z", "toolUseResult": {"agentId": "z", "agentType": "explore", "resolvedModel": "m2", "usage": use(7, 7), "toolStats": {"linesAdded": 3, "linesRemoved": 1}}},
        {"uuid": "u12", "type": "user", "toolUseResult": {"agentId": "z"}},
    ])


def test_transcripts(spark, tmp_path):
    path = transcript(tmp_path)
    agent, r1, u8 = rows(transcripts.records(spark, path))
    assert (agent["dedupe_key"], agent["granularity"], agent["sidechain"], agent["lines_added"], agent["agent"]) == ("agent:z", "session", 1, 3, "explore")
    assert (r1["input_tokens"], r1["output_tokens"], r1["cache_write_tokens"], r1["cache_write_1h"]) == (5, 8, 9, 9)
    assert (r1["tool_calls"], r1["tool_reads"], r1["tool_writes"], r1["edits"], r1["tool_errors"], r1["rejected"], r1["compactions"]) == (2, 1, 1, 1, 1, 1, 1)
    assert (r1["lines_added"], r1["lines_removed"], r1["rework_lines"], r1["skill"], r1["project"], r1["git_branch"]) == (2, 1, 0, "review", "proj", "feat/x")
    assert (u8["dedupe_key"], u8["lines_added"], u8["lines_removed"], u8["rework_lines"], u8["entrypoint"]) == ("u8", 2, 3, 3, "cli")


def test_covered_agents_and_steps(spark, tmp_path):
    path = transcript(tmp_path)
    covered = spark.createDataFrame([("z",)], "agent_id string")
    assert [r["dedupe_key"] for r in rows(transcripts.records(spark, path, covered))] == ["r1", "u8"]
    got = [(r["kind"], r["outcome"]) for r in rows(transcripts.steps(spark, path), "ordinal")]
    assert got == [("assistant", ""), ("read", "error"), ("edit", "ok"), ("compaction", ""), ("assistant", ""), ("command", "ok")]


def test_task_folders_are_listed_with_what_lies_below_them(spark, tmp_path):
    for task, n in (("a", 3), ("b", 5)):
        put(tmp_path / f"said/{task}/m.json", [json.dumps([{"type": "say", "say": "api_req_started", "ts": 1746093600000, "text": json.dumps({"tokensIn": n, "tokensOut": 1})}])])
        put(tmp_path / f"used/{task}/d.json", [{"model_usage": [{"ts": 1746093600000, "model_id": f"m-{task}"}]}])
    got = rows(assistants.cline(spark, str(tmp_path), "said", "used"))
    assert [(r["session_id"], r["model"], r["input_tokens"]) for r in got] == [("a", "m-a", 3), ("b", "m-b", 5)]


def test_no_task_holds_a_whole_transcript(spark, tmp_path, monkeypatch):
    path = transcript(tmp_path)
    wanted = rows(transcripts.records(spark, path)), rows(transcripts.steps(spark, path), "ordinal")
    found = transcripts.read(spark, path)
    for bits in (0, 1, 2):
        monkeypatch.setattr(transcripts, "STRETCH_LINES", bits)
        assert (rows(transcripts.records(spark, path)), rows(transcripts.steps(spark, path), "ordinal")) == wanted
        told = transcripts.shaped(found)
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "[file#" in plan and not re.search(r"Window [^\n]*\], \[file#\d+\], \[at#", plan)


def test_steps_name_their_targets(spark, tmp_path):
    said = lambda uuid, *tools, **k: {"type": "assistant", "uuid": uuid, "sessionId": "s", "timestamp": "2025-05-01T10:00:00Z", "message": {"model": "m", "id": f"r-{uuid}", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 6}, "content": list(tools), "stop_reason": k.pop("stop", None)}, **k}
    tool = lambda i, name, **k: {"type": "tool_use", "id": i, "name": name, "input": k}
    back = lambda uuid, i, err, **k: {"type": "user", "uuid": uuid, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": err}]}, **k}
    path = put(tmp_path / "t.jsonl", [
        said("1", tool("a", "Read", file_path="src/x.py"), cwd="/w/p", stop="end_turn"),
        said("2", tool("b", "Edit", file_path="/w/p/src/../src/x.py"), tool("c", "NotebookEdit", notebook_path="C:\\w\\n.ipynb"), tool("", "Bash"), tool("", "Grep"), stop="max_tokens"),
        back("3", "b", True), back("4", "b", False), back("5", "c", True, toolDenialKind="user"), back("6", "zz", False),
        said("7", tool("d", "Write", file_path="C:/w/n.ipynb"), tool("e", "Read", file_path="//host/w/p"), tool("f", "Read", file_path="/host/w/p"), stop="tool_use"),
        {"uuid": "8", "subtype": "compact_boundary", "sessionId": "s", "timestamp": "2025-05-01T10:00:02Z"}, {"uuid": "9", "isCompactSummary": True},
    ])
    got = [(r["dedupe_key"], r["kind"], r["outcome"], r["tokens"], r["target_ref"], r["ordinal"]) for r in rows(transcripts.steps(spark, path), "ordinal")]
    assert got == [
        ("r-1", "assistant", "ok", 18, 0, 1), ("a", "read", "", 0, 1, 2),
        ("r-2", "assistant", "truncated", 18, 0, 3), ("b", "edit", "ok", 0, 1, 4), ("c", "edit", "denied", 0, 2, 5), ("r-2:0", "command", "", 0, 0, 6), ("r-2:1", "search", "", 0, 0, 7),
        ("r-7", "assistant", "", 18, 0, 8), ("d", "edit", "", 0, 2, 9), ("e", "read", "", 0, 3, 10), ("f", "read", "", 0, 4, 11), ("8:compaction", "compaction", "", 0, 0, 12),
    ]


def test_paths_are_cleaned(spark):
    from pyspark.sql import functions as F

    from meterloom.functions.logs import clean

    cases = {"/a/./b//c/..": "/a/b", "a/../..": "..", "/..": "/", "": ".", ".": ".", "/": "/", "a/b/../../c/": "c", "../a": "../a", "/a/../../b": "/b"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", clean(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == cases
