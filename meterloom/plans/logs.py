"""Queries over logs: the usage that ``events`` stands for is written as log files of each tool's own format, read back by the parsers
and compared with the same usage in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.plans.oracles import PRELUDE
from meterloom.session import scratch_path
from meterloom.sources import assistants, transcripts

BUCKETS = 64  # files of a format that holds many sessions a file
EDITED = ("lines_added", "lines_removed", "edits")
PURPOSES = ("tool_calls", "tool_reads", "tool_searches", "tool_commands", "tool_writes", "tool_other")


def usage(x, tool: str) -> DataFrame:
    # a record's lines are many, so few splits of the given table are dealt to all cores first
    rows = x.read("usage_record").where(F.col("tool") == tool).repartition(4 * x.spark.sparkContext.defaultParallelism, "dedupe_key")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumns({"e": F.substring("dedupe_key", 2, 20).cast("long"), "at": stamp, "bucket": (F.substring("session_id", 2, 20).cast("long") % BUCKETS).cast("string")})


def said(**fields) -> Column:
    """A line of JSON; fields without a value are left out."""
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def folder() -> Column:
    """Where a project's work is done; what has no project is done at the root."""
    return F.when(F.col("project") != "", F.concat(F.lit("/w/"), F.col("project"))).otherwise("/")


def written(lines: DataFrame, x, name: str, by: str = "bucket", order: tuple[str, ...] = ("e", "k")) -> str:
    """Writes the lines (``by``, the order's columns, value) as text, one folder for each ``by``, in order."""
    path = scratch_path(x.spark, name)
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, "value").write.partitionBy(by).text(path)
    return path


def exploded(rows: DataFrame, *lines: Column) -> DataFrame:
    """Every line of a row, with its place ``k``; null ones are left out."""
    return rows.select("bucket", "e", F.posexplode(F.flatten(F.array(*lines))).alias("k", "value")).where("value IS NOT NULL")


def times(n: str | Column, line: Column) -> Column:
    n = (F.col(n) if isinstance(n, str) else n).cast("int")
    return F.array_repeat(F.when(n > 0, line), n)  # a line that no record has is not made


def gemini(x) -> DataFrame:
    rows = usage(x, "gemini-cli")
    total = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("output_tokens")
    tokens = F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("input"), (F.col("output_tokens") - F.col("reasoning_tokens")).alias("output"), F.col("cache_read_tokens").alias("cached"), F.col("reasoning_tokens").alias("thoughts"), F.lit(0).alias("tool"), total.alias("total"))
    note = said(sessionId=F.col("session_id"), type="note")
    lines = exploded(rows, F.array(note, F.lit("{broken"), said(sessionId=F.col("session_id"), timestamp=F.col("at"), model=F.col("model"), tokens=tokens)))
    return assistants.gemini(x.spark, f"{written(lines, x, 'gemini')}/*").select(*GEMINI)


GEMINI = ("session_id", "ts", "model", "input_tokens", "cache_read_tokens", "output_tokens", "reasoning_tokens", "granularity")


def copilot(x) -> DataFrame:
    rows = usage(x, "copilot-cli")
    n = lambda c: F.struct(F.sum(c).alias("tokenCount"))
    detail = F.struct(n("input_tokens").alias("input"), n("cache_read_tokens").alias("cache_read"), n("cache_write_tokens").alias("cache_write"), n("output_tokens").alias("output"))
    metric = F.struct(F.struct(F.count(F.lit(1)).alias("count")).alias("requests"), F.struct(F.sum("reasoning_tokens").alias("reasoningTokens")).alias("usage"), detail.alias("tokenDetails"))
    models = rows.groupBy("session_id", "model").agg(metric.alias("metric"), F.max("project").alias("project"), F.sum("lines_added").alias("added"), F.min("at").alias("at"))
    whole = models.groupBy("session_id").agg(F.min("at").alias("at"), F.max("project").alias("project"), F.map_from_entries(F.collect_list(F.struct("model", "metric"))).alias("metrics"), F.sum("added").alias("added"))
    start = said(type="session.start", timestamp=F.col("at"), data=F.struct(F.col("session_id").alias("sessionId"), F.struct(folder().alias("cwd")).alias("context")))
    stop = said(type="session.shutdown", timestamp=F.col("at"), data=F.struct(F.struct(F.col("added").alias("linesAdded"), F.lit(0).alias("linesRemoved")).alias("codeChanges"), F.col("metrics").alias("modelMetrics")))
    lines = whole.select(F.col("session_id").alias("s"), F.posexplode(F.array(start, stop)).alias("k", "value"))
    return assistants.copilot(x.spark, f"{written(lines, x, 'copilot', 's', ('k',))}/*").select(*COPILOT)


COPILOT = ("session_id", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "lines_added", "granularity")


def cline(x) -> DataFrame:
    rows = usage(x, "cline").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")) + F.col("e") % 1000)
    told = said(tokensIn=F.col("input_tokens"), tokensOut=F.col("output_tokens"), cacheWrites=F.col("cache_write_tokens"), cacheReads=F.col("cache_read_tokens"))
    message = F.struct(F.lit("say").alias("type"), F.lit("api_req_started").alias("say"), told.alias("text"), F.col("ms").alias("ts"))
    use = F.struct(F.col("ms").alias("ts"), F.col("model").alias("model_id"))
    tasks = rows.groupBy(F.col("session_id").alias("task")).agg(F.to_json(F.sort_array(F.collect_list(message))).alias("messages"), F.to_json(F.struct(F.sort_array(F.collect_list(use)).alias("model_usage"))).alias("metadata"))
    kinds = tasks.select("task", F.explode(F.create_map(F.lit("messages"), "messages", F.lit("metadata"), "metadata")).alias("kind", "value"))
    path = scratch_path(x.spark, "cline")
    # by task, as each has a folder of its own, whose files no two tasks share
    kinds.repartition(4 * x.spark.sparkContext.defaultParallelism, "task").write.partitionBy("kind", "task").text(path)
    return assistants.cline(x.spark, path, "kind=messages", "kind=metadata").select(*CLINE)


CLINE = ("session_id", "ts", "model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "granularity")


def codex(x) -> DataFrame:
    rows = usage(x, "codex")
    ahead = Window.partitionBy("bucket").orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    total = F.struct(F.sum(F.col("input_tokens") + F.col("cache_read_tokens")).over(ahead).alias("input_tokens"), F.sum("cache_read_tokens").over(ahead).alias("cached_input_tokens"), F.sum("output_tokens").over(ahead).alias("output_tokens"), F.sum("reasoning_tokens").over(ahead).alias("reasoning_output_tokens"))
    line = lambda kind, **payload: said(type=kind, timestamp=F.col("at"), payload=F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in payload.items())))
    call = lambda name: line("response_item", type="function_call", name=name)
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n"), F.repeat(F.lit("-old\n"), F.col("lines_removed").cast("int")), F.repeat(F.lit("+new\n"), F.col("lines_added").cast("int")))
    change = F.create_map(F.concat(F.lit("f"), F.col("e").cast("string")), F.struct(F.lit("update").alias("type"), diff.alias("unified_diff")))
    lines = exploded(
        rows.withColumn("total", total),
        F.array(line("session_meta", id=F.col("session_id"), cwd=folder()), line("turn_context", model=F.col("model"))),
        times("tool_reads", call("read_file")), times("tool_searches", call("grep")), times("tool_commands", call("shell")), times("tool_writes", call("apply_patch")), times("tool_other", call("plan")),
        times("edits", line("event_msg", type="patch_apply_end", success=True, changes=change)), times("compactions", said(type="compacted", timestamp=F.col("at"))),
        F.array(line("event_msg", type="token_count", info=F.struct(F.col("total").alias("total_token_usage"))), F.lit("not json")),
    )
    return assistants.codex(x.spark, f"{written(lines, x, 'codex')}/*").select(*CODEX)


CODEX = ("session_id", "ts", "model", "project", "input_tokens", "cache_read_tokens", "output_tokens", "reasoning_tokens", *EDITED, *PURPOSES, "compactions", "granularity")


def transcript_lines(x) -> DataFrame:
    rows = usage(x, "claude-code")
    uuid = lambda kind: F.concat(F.lit(kind), F.col("e").cast("string"))
    block = lambda name, k: F.struct(F.lit("tool_use").alias("type"), F.lit(name).alias("name"), F.concat(uuid("t"), F.lit(f"-{k}-"), F.lit(name)).alias("id"))
    blocks = F.flatten(F.array(*(times(n, block(name, 0)) for n, name in (("tool_reads", "Read"), ("tool_searches", "Grep"), ("tool_commands", "Bash"), ("tool_writes", "Edit"), ("tool_other", "Task")))))
    output = lambda n: F.struct(F.col("input_tokens"), n.alias("output_tokens"), F.col("cache_write_tokens").alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.struct(F.col("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    miss = F.when(F.col("cache_miss_reason") != "", F.struct(F.struct(F.col("cache_miss_reason").alias("type")).alias("cache_miss_reason")))
    about = {"sessionId": F.col("session_id"), "timestamp": F.col("at"), "cwd": folder()}
    own = about | {"gitBranch": F.col("git_branch"), "entrypoint": F.col("entrypoint"), "isSidechain": F.col("sidechain") == 1, "attributionSkill": F.col("skill"), "attributionAgent": F.col("agent")}
    reply = lambda kind, n, content, stop: said(type="assistant", uuid=uuid(kind), **own, message=F.struct(F.col("model"), F.col("dedupe_key").alias("id"), output(n).alias("usage"), content.alias("content"), F.lit(stop).alias("stop_reason"), miss.alias("diagnostics")))
    result = lambda wrong: F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(uuid("t"), F.lit("-0-Bash")).alias("tool_use_id"), F.lit(wrong).alias("is_error"))).alias("content"))
    patch = F.struct(F.concat(F.lit("f"), F.col("e").cast("string")).alias("filePath"), F.array(F.struct(F.concat(F.array_repeat(F.lit("-old"), F.col("lines_removed").cast("int")), F.array_repeat(F.lit("+new"), F.col("lines_added").cast("int"))).alias("lines"))).alias("structuredPatch"))
    return exploded(
        rows,
        F.array(reply("a", F.lit(1), F.slice(blocks, 1, 1), None), reply("b", F.col("output_tokens"), F.slice(blocks, 2, 99), "end_turn"), reply("b", F.col("output_tokens"), F.slice(blocks, 2, 99), "end_turn")),
        times("tool_errors", said(type="user", uuid=uuid("r"), **about, message=result(True))),
        times("rejected", said(type="user", uuid=uuid("d"), **about, toolDenialKind="user")),
        times("compactions", said(type="system", uuid=uuid("c"), **about, subtype="compact_boundary")),
        times("edits", said(type="user", uuid=uuid("p"), **about, toolUseResult=patch)),
        F.array(F.lit("{broken")),
    )


def transcript(x) -> str:
    return f"{written(transcript_lines(x), x, 'transcript')}/*"


CLAUDE = (
    "session_id", "ts", "model", "project", "dedupe_key", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h",
    *PURPOSES, *EDITED, "tool_errors", "rejected", "compactions", "sidechain", "skill", "agent", "cache_miss_reason", "granularity",
)


def claude(x) -> DataFrame:
    return transcripts.records(x.spark, transcript(x)).select(*CLAUDE)


def claude_steps(x) -> DataFrame:
    steps = transcripts.steps(x.spark, transcript(x))
    return steps.groupBy("session_id", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def skipped(x) -> DataFrame:
    """How many lines of the transcripts could not be read."""
    from meterloom.sources import lines

    read = lines.parsed(lines.read_lines(x.spark, transcript(x)), transcripts.LINE)
    return lines.skipped(read).agg(F.count(F.lit(1)).alias("files"), F.sum("skipped").alias("skipped"))


def queries() -> dict[str, Callable]:
    return {"src_gemini": gemini, "src_copilot": copilot, "src_cline": cline, "src_codex": codex, "src_claude": claude, "src_claude_steps": claude_steps, "src_skipped_lines": skipped}


def oracle_sql() -> dict[str, str]:
    plain = lambda tool, columns: f" SELECT {', '.join(columns)} FROM usage_record WHERE tool = '{tool}'"
    sums = ", ".join(f"sum({c})::bigint AS {c}" for c in COPILOT[3:8])
    top = "row_number() OVER (PARTITION BY session_id ORDER BY n DESC, model) = 1"
    steps = ", ".join(f"('{kind}', '{column}')" for kind, column in (("read", "tool_reads"), ("search", "tool_searches"), ("command", "tool_commands"), ("edit", "tool_writes"), ("other", "tool_other")))
    out = {
        "src_gemini": plain("gemini-cli", GEMINI),
        "src_codex": plain("codex", CODEX),
        "src_claude": plain("claude-code", CLAUDE),
        "src_cline": plain("cline", CLINE),
        "src_copilot": f""", g AS (SELECT session_id, model, count(*) AS n, {sums}, sum(lines_added)::bigint AS added, min(ts) AS ts FROM usage_record WHERE tool = 'copilot-cli' GROUP BY ALL)
          SELECT session_id, min(ts) OVER (PARTITION BY session_id) AS ts, model, {', '.join(COPILOT[3:8])},
                 CASE WHEN {top} THEN sum(added) OVER (PARTITION BY session_id)::bigint ELSE 0 END AS lines_added, 'session' AS granularity FROM g""",
        "src_claude_steps": f""", c AS (SELECT * FROM usage_record WHERE tool = 'claude-code'), kinds(kind, col) AS (VALUES {steps}),
          s AS (
            SELECT session_id, 'assistant' AS kind, 'ok' AS outcome, ts, 1 AS n FROM c UNION ALL SELECT session_id, 'compaction', '', ts, compactions FROM c
            UNION ALL SELECT session_id, kind, CASE WHEN kind = 'command' AND tool_errors > 0 THEN 'error' ELSE '' END, ts,
              CASE col WHEN 'tool_reads' THEN tool_reads WHEN 'tool_searches' THEN tool_searches WHEN 'tool_commands' THEN tool_commands WHEN 'tool_writes' THEN tool_writes ELSE tool_other END FROM c, kinds)
          SELECT session_id, kind, outcome, sum(n)::bigint AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s WHERE n > 0 GROUP BY ALL""",
        "src_skipped_lines": f" SELECT count(DISTINCT cast(substr(session_id, 2) AS bigint) % {BUCKETS}) AS files, count(*) AS skipped FROM usage_record WHERE tool = 'claude-code'",
    }
    return {k: PRELUDE.rstrip() + v for k, v in out.items()}
