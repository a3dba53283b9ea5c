"""Four log formats of AI coding tools as usage records: message logs with tokens, session totals, task messages and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.logs import basename, content_lines, count, seconds, text
from meterloom.operators import etl
from meterloom.sources.lines import as_usage, fingerprint, parsed, purpose, read_lines

GEMINI = "sessionId string, timestamp string, model string, tokens struct<input:long,output:long,cached:long,thoughts:long,tool:long,total:long>"
COPILOT = "type string, timestamp string, data struct<sessionId:string, context:struct<cwd:string>, codeChanges:struct<linesAdded:long,linesRemoved:long>, modelMetrics:map<string,struct<requests:struct<count:long>,usage:struct<reasoningTokens:long>,tokenDetails:struct<input:struct<tokenCount:long>,cache_read:struct<tokenCount:long>,cache_write:struct<tokenCount:long>,output:struct<tokenCount:long>>>>>"
CLINE = "array<struct<type:string,say:string,text:string,ts:long>>"
CLINE_INFO = "tokensIn long, tokensOut long, cacheWrites long, cacheReads long"
CODEX = "type string, timestamp string, payload string"
CODEX_PAYLOAD = "type string, id string, timestamp string, model string, cwd string, name string, status string, success boolean, info struct<total_token_usage:struct<input_tokens:long,cached_input_tokens:long,output_tokens:long,reasoning_output_tokens:long>>, changes map<string,struct<type:string,unified_diff:string,content:string>>"


def _order():
    return Window.partitionBy("file").orderBy("line")


def _so_far(c):
    return F.last(c, ignorenulls=True).over(etl.upto("file", "line"))


def gemini(spark: SparkSession, path: str) -> DataFrame:
    """One record a message with tokens: output takes in tool and thought tokens, input leaves out what came from the cache."""
    lines = parsed(read_lines(spark, path), GEMINI)
    t = lambda c: F.coalesce(F.col(f"j.tokens.{c}"), F.lit(0))
    said = lines.where("j IS NOT NULL").withColumn("session_id", text(_so_far(F.when(F.col("j.sessionId") != "", F.col("j.sessionId")))))
    rows = said.where((t("total") != 0) | (t("input") != 0) | (t("output") != 0)).withColumn("n", F.row_number().over(_order()) - 1)
    output = count(t("output")) + count(t("tool")) + count(t("thoughts"))
    cached = F.least(count(t("cached")), count(t("input")))
    rows = rows.join(fingerprint(lines), "file").select("session_id", seconds("j.timestamp").alias("ts"), text("j.model").alias("model"), (count(t("input")) - cached).alias("input_tokens"), cached.alias("cache_read_tokens"), output.alias("output_tokens"), F.least(count(t("thoughts")), output).alias("reasoning_tokens"), F.concat_ws(":", "fp", "session_id", F.col("n").cast("string")).alias("dedupe_key"), F.lit("turn").alias("granularity"))
    return as_usage(rows, "gemini-cli")


def copilot(spark: SparkSession, path: str) -> DataFrame:
    """A session's totals, one record a model; its changed lines go to the model with most requests, the first by name of equals."""
    lines = parsed(read_lines(spark, path), COPILOT).where("j IS NOT NULL")
    last = lambda kind: F.max_by("j", F.when(F.col("j.type") == kind, F.col("line")))
    files = lines.groupBy("file").agg(last("session.start").alias("a"), last("session.shutdown").alias("z"))
    first = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.when(F.col(b) != "", F.col(b)))
    about = files.select("file", first("a.data.sessionId", "z.data.sessionId").alias("session_id"), F.coalesce(seconds("a.timestamp"), seconds("z.timestamp")).alias("ts"), text("a.data.context.cwd").alias("cwd"), "z.data.codeChanges", F.explode("z.data.modelMetrics").alias("model", "m")).where("session_id IS NOT NULL AND ts IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.coalesce("m.requests.count", F.lit(0)).desc(), "model"))
    n = lambda c: count(f"m.tokenDetails.{c}.tokenCount")
    lines_of = lambda c: F.when(F.col("place") == 1, count(f"codeChanges.{c}")).otherwise(0)
    rows = about.withColumn("place", place).select("session_id", "ts", "model", n("input").alias("input_tokens"), n("output").alias("output_tokens"), n("cache_read").alias("cache_read_tokens"), n("cache_write").alias("cache_write_tokens"), F.least(count("m.usage.reasoningTokens"), n("output")).alias("reasoning_tokens"), lines_of("linesAdded").alias("lines_added"), lines_of("linesRemoved").alias("lines_removed"), F.concat_ws(":", "session_id", "model").alias("dedupe_key"), basename(F.col("cwd")).alias("project"), F.lit("session").alias("granularity"))
    return as_usage(rows, "copilot-cli")


def cline(spark: SparkSession, folder: str, messages: str = "*/ui_messages.json", metadata: str = "*/task_metadata.json") -> DataFrame:
    """Requests of each task's messages; a request's model is that of the last use at or before it, else of the first. A task is the
    folder that its files lie in. ``messages`` and ``metadata`` are patterns of files, or of folders that are listed, by many tasks, with
    all that lies below them."""
    task = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -2), "^[a-z]+=", "")
    read = lambda files: spark.read.option("recursiveFileLookup", "true").text(f"{folder}/{files}", wholetext=True).select(task.alias("session_id"), "value")
    messages = read(messages).select("session_id", F.posexplode(F.from_json("value", CLINE)).alias("line", "m"))
    asked = messages.where("m.type = 'say' AND m.say = 'api_req_started' AND m.text <> ''").withColumn("i", F.from_json("m.text", CLINE_INFO)).where("coalesce(i.tokensIn, 0) <> 0 OR coalesce(i.tokensOut, 0) <> 0")
    rows = asked.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("line")) - 1).select("session_id", F.col("m.ts").alias("at"), count("i.tokensIn").alias("input_tokens"), count("i.tokensOut").alias("output_tokens"), count("i.cacheWrites").alias("cache_write_tokens"), count("i.cacheReads").alias("cache_read_tokens"), F.concat_ws(":", "session_id", F.col("n").cast("string")).alias("dedupe_key"))
    uses = read(metadata).select("session_id", F.explode(F.from_json("value", "model_usage array<struct<ts:long,model_id:string>>")["model_usage"]).alias("u")).select("session_id", F.col("u.ts").alias("at"), F.col("u.model_id").alias("model"))
    named = etl.as_of(rows, uses, "session_id", "at", "model").withColumn("ts", F.date_trunc("second", F.timestamp_millis("at")).cast("timestamp_ntz")).withColumn("granularity", F.lit("turn"))
    return as_usage(named, "cline")


def _diff_lines(diff, sign: str):
    rows = F.split(diff, "\n")
    hunk = F.coalesce(F.array_min(F.filter(F.transform(rows, lambda x, i: F.when(x.startswith("@@"), i)), lambda i: i.isNotNull())), F.size(rows))
    return F.size(F.filter(rows, lambda x, i: x.startswith(sign) & ~((i < hunk) & x.startswith(sign * 3 + " "))))


def codex(spark: SparkSession, path: str) -> DataFrame:
    """Rollouts: cumulative counters as increments; activity goes to the next record, what trails to the last."""
    lines = parsed(read_lines(spark, path), CODEX)
    rows = lines.where("j IS NOT NULL").select("file", "line", F.col("j.type").alias("type"), F.col("j.timestamp").alias("at"), F.from_json("j.payload", CODEX_PAYLOAD).alias("p"))
    meta = F.col("type") == "session_meta"
    rows = rows.withColumns({
        "session_id": text(_so_far(F.when(meta, F.col("p.id")))),
        "ts": _so_far(F.coalesce(F.when(meta, seconds("p.timestamp")), seconds("at"))),
        "model": text(F.coalesce(_so_far(F.when((F.col("type") == "turn_context") & (F.col("p.model") != ""), F.col("p.model"))), F.first(F.when(meta & (F.col("p.model") != ""), F.col("p.model")), ignorenulls=True).over(etl.upto("file", "line")))),
        "cwd": text(_so_far(F.when(meta & (F.col("p.cwd") != ""), F.col("p.cwd")))),
        "event": F.when(F.col("type") == "event_msg", F.col("p.type")).otherwise(F.col("type")),
    })
    total = "p.info.total_token_usage"
    n = lambda c: F.coalesce(F.col(f"{total}.{c}"), F.lit(0))
    counted = rows.where("event = 'token_count' AND p.info IS NOT NULL").select("file", "line", "session_id", "ts", "model", "cwd", n("input_tokens").alias("i"), n("cached_input_tokens").alias("c"), n("output_tokens").alias("o"), n("reasoning_output_tokens").alias("r"))
    order = _order()
    reasoned = F.greatest(F.col("r") - F.lag("r", 1, 0).over(order), F.lit(0))
    grown = etl.deltas(counted.withColumn("dr", reasoned), ["i", "c", "o"]).withColumn("turn", F.row_number().over(order) - 1)
    cached = F.least("d_c", "d_i")

    emitted = rows.join(grown.select("file", "line", F.lit(1).alias("emits")), ["file", "line"], "left")
    before = F.coalesce(F.sum("emits").over(etl.upto("file", "line", -1)), F.lit(0))
    placed = emitted.withColumn("before", before).withColumn("n_turns", F.sum("emits").over(Window.partitionBy("file"))).where("n_turns IS NOT NULL")
    call = (F.col("event") == "response_item") & F.col("p.type").isin("function_call", "custom_tool_call")
    patch = F.col("event") == "patch_apply_end"
    kind = purpose(F.coalesce("p.name", F.lit("")))
    ok = F.coalesce("p.success", F.lit(False))
    num = lambda c: F.sum(F.when(c, 1).otherwise(0))

    changes = placed.where(patch & ok).select("file", "line", "before", "n_turns", F.explode("p.changes").alias("path", "change"))
    body = lambda kind: F.when(F.col("change.type") == kind, content_lines(F.col("change.content"))).otherwise(0)
    edited = ~F.coalesce(F.col("change.type"), F.lit("")).isin("add", "delete")
    lines_in = lambda kind, sign: F.when(edited, _diff_lines(F.coalesce("change.unified_diff", F.lit("")), sign)).otherwise(body(kind))
    changes = etl.rework(changes.withColumn("added", lines_in("add", "+").cast("long")).withColumn("removed", lines_in("delete", "-").cast("long")), ["file", "path"], "line")
    changed = changes.groupBy("file", "before").agg(F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.sum("rework").alias("rework_lines"))

    done = placed.where(call | patch | (F.col("type") == "compacted")).groupBy("file", "before", "n_turns").agg(*(num(call & (kind == k)).alias(k) for k in ("reads", "searches", "commands", "writes", "other")), num(patch).alias("patches"), num(patch & ok).alias("edits"), (num(patch & ~ok) + num(call & F.col("p.status").isin("failed", "incomplete"))).alias("tool_errors"), num(F.col("type") == "compacted").alias("compactions"))
    done = done.join(changed, ["file", "before"], "left").withColumn("patches", F.when(F.col("writes") > 0, 0).otherwise(F.col("patches"))).withColumn("writes", F.col("writes") + F.col("patches"))
    done = done.withColumn("turn", F.least("before", F.col("n_turns") - 1)).groupBy("file", "turn").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("reads", "searches", "commands", "writes", "other", "edits", "tool_errors", "compactions", "lines_added", "lines_removed", "rework_lines")))
    calls = F.col("reads") + F.col("searches") + F.col("commands") + F.col("writes") + F.col("other")
    joined = grown.join(done, ["file", "turn"], "left").join(fingerprint(lines), "file")
    out = joined.select("session_id", "ts", "model", basename(F.col("cwd")).alias("project"), (F.col("d_i") - cached).alias("input_tokens"), cached.alias("cache_read_tokens"), F.col("d_o").alias("output_tokens"), F.least("dr", "d_o").alias("reasoning_tokens"), F.concat_ws(":", "fp", "session_id", F.col("turn").cast("string")).alias("dedupe_key"), F.lit("turn").alias("granularity"), "lines_added", "lines_removed", "rework_lines", "edits", "tool_errors", "compactions", calls.alias("tool_calls"), F.col("reads").alias("tool_reads"), F.col("searches").alias("tool_searches"), F.col("commands").alias("tool_commands"), F.col("writes").alias("tool_writes"), F.col("other").alias("tool_other"))
    return as_usage(out, "codex")
