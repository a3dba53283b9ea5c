"""Transcripts that write one API response over many lines, with sub-agents, as usage records and steps.

A log is read and parsed once: ``facts`` turns each line into the few values that records and steps rest on, and needs no other line for
it. What lines say about each other (what holds until it is said anew, repeats, which response a result belongs to) are windows over
stretches of a file's facts, so that a task's memory does not grow with a file. An import keeps facts, so that it parses no line twice
however often a log grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.logs import basename, content_lines, count, seconds, target_key, text, token
from meterloom.operators import etl
from meterloom.session import cut
from meterloom.sources.lines import STEP_OF, as_usage, placed_lines, purpose

TOKENS = (
    "input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long,"
    "cache_creation:struct<ephemeral_5m_input_tokens:long,ephemeral_1h_input_tokens:long>"
)
BLOCK = "struct<type:string,name:string,id:string,tool_use_id:string,is_error:boolean,input:struct<file_path:string,notebook_path:string>>"
RESULT = (
    f"struct<agentId:string,agentType:string,resolvedModel:string,usage:struct<{TOKENS}>,toolStats:struct<linesAdded:long,linesRemoved:long>,"
    "filePath:string,type:string,content:string,structuredPatch:array<struct<lines:array<string>>>>"
)
MESSAGE = (
    f"struct<model:string,id:string,content:array<{BLOCK}>,usage:struct<{TOKENS}>,stop_reason:string,"
    "diagnostics:struct<cache_miss_reason:struct<type:string>>>"
)
LINE = (
    "type string, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, entrypoint string, toolDenialKind string, "
    "isSidechain boolean, agentId string, attributionSkill string, attributionAgent string, isCompactSummary boolean, subtype string, "
    f"message {MESSAGE}, toolUseResult {RESULT}"
)
EDITS = ("Edit", "Write", "NotebookEdit", "MultiEdit")
PURPOSES = ("reads", "searches", "commands", "writes", "other")
SAID = ("cwd", "branch", "entry", "agent_id")
COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h")
#: What is carried on from line to line: what ``SAID`` holds, the last response, and whether context was lost since.
CARRIED = (*(f"past_{c}" for c in SAID), "past_key", "past_lost")
#: The order of a file's lines: where a split of the file begins, and the place in it.
ORDER = ["at", "n"]
#: Powers of two: the bytes (of lines placed by their byte) and lines (placed by their number) of a stretch of a file.
STRETCH_BYTES, STRETCH_LINES = 24, 15
STRETCH = ["byte_stretch", "line_stretch"]
#: What a response's stop says of it.
STOPS = {"end_turn": "ok", "stop_sequence": "ok", "max_tokens": "truncated"}


def _tokens(u: str) -> Column:
    write = count(f"{u}.cache_creation_input_tokens")
    values = (
        count(f"{u}.input_tokens"), count(f"{u}.output_tokens"), count(f"{u}.cache_read_input_tokens"), write,
        F.least(count(f"{u}.cache_creation.ephemeral_1h_input_tokens"), write),
    )
    return F.struct(*(v.alias(c) for c, v in zip(COUNTS, values, strict=True)))


def facts(lines: DataFrame, *kept: str) -> DataFrame:
    """What each line (file, at, n, raw) says, line by line, and the columns that are to be kept. A line that is no JSON object says nothing; it is not filtered out, as a
    condition on what was parsed would be pushed below the parse and parse each line once more."""
    rows = lines.withColumn("j", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", LINE)))
    blocks = F.coalesce("j.message.content", F.array().cast(f"array<{BLOCK}>"))
    used = F.filter(blocks, lambda b: b["type"] == "tool_use")
    tool = lambda b: F.struct(
        F.coalesce(b["name"], F.lit("")).alias("name"), F.coalesce(b["id"], F.lit("")).alias("id"),
        F.coalesce(F.when(b["input"]["file_path"] != "", b["input"]["file_path"]), b["input"]["notebook_path"], F.lit("")).alias("path"),
    )
    result = lambda b: F.struct(F.coalesce(b["tool_use_id"], F.lit("")).alias("id"), F.coalesce(b["is_error"], F.lit(False)).alias("wrong"))
    key = F.when(text("j.message.id") != "", F.col("j.message.id")).otherwise(text("j.uuid"))
    marks = F.coalesce("j.isCompactSummary", F.lit(False)) | (text("j.subtype") == "compact_boundary")
    agent = text("j.toolUseResult.agentId") != ""
    patch = F.col("j.toolUseResult.structuredPatch")
    kind = (
        F.when(text("j.toolDenialKind") != "", "denial").when(marks, "compaction")
        .when(agent & F.col("j.toolUseResult.usage").isNotNull(), "agent").when(agent, "stub").when(patch.isNotNull(), "edit")
        .when((F.col("j.type") == "assistant") & (text("j.message.model") != "") & (key != ""), "assistant").otherwise("none")
    )
    none = F.array().cast("array<string>")
    signs = lambda sign: F.aggregate(
        F.transform(patch, lambda h: F.size(F.filter(F.coalesce(h["lines"], none), lambda x: x.startswith(sign)))), F.lit(0), lambda a, b: a + b
    )
    created = (F.col("j.toolUseResult.type") == "create") & (F.size(patch) == 0) & (text("j.toolUseResult.content") != "")
    change = F.struct(
        text("j.toolUseResult.filePath").alias("path"),
        F.when(created, content_lines(F.col("j.toolUseResult.content"))).otherwise(signs("+")).cast("long").alias("added"),
        F.when(created, 0).otherwise(signs("-")).cast("long").alias("removed"),
    )
    made = F.struct(
        F.col("j.toolUseResult.agentId").alias("id"), text("j.toolUseResult.agentType").alias("type"), text("j.toolUseResult.resolvedModel").alias("model"),
        _tokens("j.toolUseResult.usage").alias("tokens"), count("j.toolUseResult.toolStats.linesAdded").alias("added"),
        count("j.toolUseResult.toolStats.linesRemoved").alias("removed"),
    )
    return rows.select(
        *kept, "file", *ORDER, kind.alias("kind"), key.alias("key"), text("j.uuid").alias("uuid"), text("j.sessionId").alias("session_id"), seconds("j.timestamp").alias("ts"),
        text("j.cwd").alias("cwd"), text("j.gitBranch").alias("branch"), text("j.entrypoint").alias("entry"), text("j.agentId").alias("agent_id"),
        F.coalesce("j.isSidechain", F.lit(False)).alias("sidechain"), text("j.attributionSkill").alias("skill"), text("j.attributionAgent").alias("agent"),
        token(text("j.message.diagnostics.cache_miss_reason.type")).alias("miss"), text("j.message.model").alias("model"), text("j.message.stop_reason").alias("stop"),
        _tokens("j.message.usage").alias("tokens"), F.transform(used, tool).alias("tools"),
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), result).alias("results"),
        F.when(kind == "edit", change).alias("change"), F.when(kind == "agent", made).alias("made"),
    )


def _stretched(found: DataFrame) -> DataFrame:
    """Adds which stretch of its file a line lies in. Stretches follow each other as the lines do and are of bounded length."""
    return found.withColumns({"byte_stretch": F.shiftright("at", STRETCH_BYTES), "line_stretch": F.shiftright("n", STRETCH_LINES)})


def told_so_far(found: DataFrame, earlier: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Facts with what holds until it is said anew carried on, with the response that a line belongs to (``owner``) and the one before
    it (``before``), where a loss of context starts, whether the last thing that counts was one (``lost``), and whether a line was read
    before (``again``). No task holds a whole file: windows are over stretches of files, to which what was said before them is brought.
    Files of which more was found before go on where they stood: ``earlier`` (file, ``CARRIED``) has what they said last, ``seen``
    (file, uuid) lines that were read then. ``found`` is read twice, so it should be a written table."""
    is_response, kind = F.col("kind") == "assistant", F.col("kind")
    lost = F.when(~F.col("again") & (kind != "denial"), kind == "compaction")
    answered = F.when(~F.col("again") & is_response, F.col("key"))
    told = {c: F.when(F.col(c) != "", F.col(c)) for c in SAID}

    def marked(lines: DataFrame) -> DataFrame:
        repeat = etl.repeated(line=ORDER)
        if seen is None:
            return _stretched(lines).withColumn("again", repeat)
        known = seen.where("uuid <> ''").select("file", "uuid", F.lit(True).alias("_seen")).distinct()
        return _stretched(lines).join(known, ["file", "uuid"], "left").withColumn("again", repeat | F.col("_seen").isNotNull()).drop("_seen")

    # what says nothing to any line, as a broken one, is not moved
    silent = (kind == "none") & (F.concat("uuid", *SAID) == "") & (F.size("results") == 0)
    found = found.where(~silent)
    narrow = marked(found.select("file", *ORDER, "kind", "key", "uuid", *SAID))
    values = dict(zip(CARRIED, (*told.values(), answered, lost), strict=True))
    lines = etl.carried(marked(found), narrow, values, STRETCH, ORDER, earlier=earlier)
    here, ahead = (etl.upto(["file", *STRETCH], ORDER, last) for last in (0, -1))
    so_far = lambda c, over, past: F.coalesce(F.last(c, ignorenulls=True).over(over), F.col(past))
    starts = (kind == "compaction") & ~F.coalesce(so_far(lost, ahead, "past_lost"), F.lit(False))
    return lines.withColumns(
        {c: F.coalesce(so_far(v, here, f"past_{c}"), F.lit("")) for c, v in told.items()}
        | {"owner": so_far(answered, here, "past_key"), "before": so_far(answered, ahead, "past_key"), "starts": starts, "lost": so_far(lost, here, "past_lost")}
    ).drop(*CARRIED)


def shaped(found: DataFrame) -> DataFrame:
    """Facts without lines read before, each with what ``told_so_far`` says of it."""
    return told_so_far(found).where("NOT again")


def links(lines: DataFrame) -> Column:
    """By what lines of a file add to the same records and steps or are the same line, as numbers: lines that have none in common (of
    ``lines`` after ``told_so_far``; before it, a line lacks that of the response it belongs to) say nothing of each other."""
    known = set(lines.columns)
    named = lambda kind, value: F.when(value != "", F.xxhash64(F.lit(kind), F.col("file"), value))
    either = lambda c: F.col(c) if c in known else F.lit(None).cast("string")
    own = F.coalesce(F.when(F.col("kind") == "assistant", F.col("key")), either("owner"))
    one = F.array(named("line", F.col("uuid")), named("key", own), named("key", either("before")), named("key", F.concat(F.lit("agent:"), "made.id")))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: named("id", x["id"])), F.array().cast("array<long>"))
    return F.array_compact(F.concat(one, ids("tools"), ids("results")))


def reworked(lines: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """The edits of shaped lines, which are few of them: path, lines added, removed, and removed of those added before (``rework``).
    ``budgets`` (file, path, added) has what earlier edits of a file's path added and none undid."""
    kept = [c for c in ("epoch", "past") if c in lines.columns]
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    edits = lines.where("kind = 'edit' AND owner IS NOT NULL").select(*kept, "file", *ORDER, "owner", text("change.path").alias("path"), number("change.added").alias("added"), number("change.removed").alias("removed"))
    if budgets is not None:
        first = budgets.select("file", "path", "added", F.lit(0).cast("long").alias("removed"), *(F.lit(-1).cast("long").alias(c) for c in ORDER))
        edits = edits.unionByName(first, allowMissingColumns=True)
    return etl.rework(edits, ["file", "path"], ORDER).where(F.col("at") >= 0)


def _how_many(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda v: v == value)).cast("long")


def records_of(found: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Usage records of facts: one a response, and one a completed sub-agent whose own transcript is not among ``covered`` (agent_id)."""
    return recorded(shaped(found), covered=covered)


def _fresh(lines: DataFrame) -> DataFrame:
    return lines if "fresh" in lines.columns else lines.withColumn("fresh", F.lit(True))


def recorded(lines: DataFrame, changes: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """The records of shaped lines and their edits (``reworked``; without them rework is worked out among the lines, if it is asked
    for); where ``fresh`` tells new lines from those read before, the records that a fresh one adds to."""
    # lists are counted before rows are moved
    errors = F.when(F.col("kind") != "denial", F.size(F.filter("results", lambda r: r["wrong"]))).otherwise(0)
    edits = F.size(F.filter("tools", lambda t: t["name"].isin(*EDITS)))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    listed = _fresh(lines).withColumns({"errors": errors.cast("long"), "edits": edits.cast("long"), "purposes": F.transform("tools", lambda t: purpose(t["name"])), "added": number("change.added"), "removed": number("change.removed"), "path": F.when(F.col("owner").isNotNull(), F.col("change.path"))})
    listed = listed.where(F.col("kind").isin("assistant", "denial", "compaction", "edit", "agent") | (F.col("errors") > 0))  # others add nothing
    rows = listed.withColumns({f"n_{k}": _how_many(F.col("purposes"), k) for k in PURPOSES}).drop("tools", "results", "purposes", "change", "links", *STRETCH)
    own = F.struct(F.coalesce(F.when(F.col("kind") == "assistant", F.col("key")), F.col("owner")).alias("key"), F.lit("own").alias("part"))
    earlier = F.struct(F.col("before").alias("key"), F.lit("errors").alias("part"))
    agent = F.struct(F.concat(F.lit("agent:"), "made.id").alias("key"), F.lit("agent").alias("part"))
    undone = F.struct(F.col("owner").alias("key"), F.lit("rework").alias("part"))
    # nearly all lines belong to one record; a response's own results are the one before's, and a sub-agent's report is a record besides
    parts = F.concat(F.array(own), F.when(F.col("errors") > 0, F.array(earlier)).otherwise(F.array()), F.when(F.col("kind") == "agent", F.array(agent)).otherwise(F.array()))
    if changes is None:
        rows = etl.rework(rows.withColumn("alone", etl.alone(F.col("path").isNotNull(), ORDER)), ["file", "path", "alone"], ORDER)
    dealt = rows.withColumn("to", F.explode(parts)).where("to.key IS NOT NULL")
    if changes is not None:
        dealt = dealt.unionByName(_fresh(changes).select("file", "fresh", undone.alias("to"), "rework"), allowMissingColumns=True)
    line, part = F.struct(*ORDER), F.col("to.part")
    mine = (part == "own") & (F.col("kind") == "assistant")
    besides = part == "own"
    is_agent = part == "agent"
    about = F.struct("session_id", "ts", "model", "cwd", "branch", "entry", "sidechain")
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(mine & (F.col(c) != ""), line)), F.lit("")).alias(c)
    summed = lambda value, where: F.coalesce(F.sum(F.when(where, value)), F.lit(0))
    merged = dealt.groupBy("file", F.col("to.key").alias("dedupe_key"), is_agent.alias("is_agent")).agg(
        F.min_by(about, F.when(mine | is_agent, line)).alias("a"),
        F.min_by("made", F.when(is_agent, line)).alias("made"),
        *(F.max(F.when(mine, F.col(f"tokens.{c}")).when(is_agent, F.col(f"made.tokens.{c}"))).alias(c) for c in COUNTS),
        *(summed(F.col(f"n_{k}"), mine).alias(f"tool_{k}") for k in PURPOSES),
        summed(F.col("edits"), mine).alias("edits"), *(first(c) for c in ("skill", "agent", "miss")),
        summed(F.col("errors"), part == "errors").alias("tool_errors"),
        summed(F.lit(1), besides & (F.col("kind") == "denial")).alias("rejected"),
        summed(F.lit(1), besides & F.col("starts")).alias("compactions"),
        *(summed(F.col(c), besides & (F.col("kind") == "edit")).alias(name) for c, name in (("added", "lines_added"), ("removed", "lines_removed"))),
        summed(F.col("rework"), (besides & (F.col("kind") == "edit")) if changes is None else part == "rework").alias("rework_lines"), F.max("fresh").alias("fresh"),
    ).where("a IS NOT NULL AND fresh")
    either = lambda agents, responses: F.when(F.col("is_agent"), agents).otherwise(responses)
    whole = merged.select(
        "dedupe_key", "is_agent", "a.session_id", "a.ts", either(F.col("made.model"), F.col("a.model")).alias("model"), basename(F.col("a.cwd")).alias("project"), F.col("a.cwd").alias("cwd"),
        F.col("a.branch").alias("git_branch"), F.col("a.entry").alias("entrypoint"), either(F.lit("session"), F.lit("turn")).alias("granularity"), *COUNTS,
        reduce(lambda x, y: x + y, (F.col(f"tool_{k}") for k in PURPOSES)).alias("tool_calls"), *(f"tool_{k}" for k in PURPOSES), "edits", "tool_errors", "rejected", "compactions",
        either(F.col("made.added"), F.col("lines_added")).alias("lines_added"), either(F.col("made.removed"), F.col("lines_removed")).alias("lines_removed"), "rework_lines",
        either(F.lit(True), F.col("a.sidechain")).cast("long").alias("sidechain"), "skill", either(F.col("made.type"), F.col("agent")).alias("agent"), F.col("miss").alias("cache_miss_reason"),
    )
    if covered is not None:
        gone = covered.select(F.concat(F.lit("agent:"), "agent_id").alias("dedupe_key"), F.lit(True).alias("is_agent")).distinct()
        whole = whole.join(gone, ["dedupe_key", "is_agent"], "left_anti")
    return whole


def steps_of(found: DataFrame) -> DataFrame:
    """session_id, timeline, ordinal, ts, kind, outcome, dedupe_key, model, tokens, target_ref: responses, their tool calls and lost
    contexts in order. A call's outcome is that of the last result that names it, a response's what its first telling stop says; a target
    is a number for a file's path, in the order in which the transcript first names them, 0 for none."""
    return stepped(shaped(found)).select("file", "session_id", "timeline", "ordinal", "ts", "kind", "outcome", "dedupe_key", "model", "tokens", "target_ref")


def stepped(lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The steps of shaped lines, each with its place (file, ``ORDER``, k), ``target`` and ``fresh``. Where ``fresh`` tells new lines from
    those read before, the steps of new ones and those that a new one says something of; ``places`` (file, ``ORDER``, k, ordinal, target,
    target_ref) has the steps of all lines read before."""
    is_response = F.col("kind") == "assistant"
    rows = _fresh(lines).where(is_response | (F.size("results") > 0) | F.col("starts"))
    response = Window.partitionBy("file", "key", etl.alone(is_response, ORDER))
    mine = lambda value: F.when(is_response, value)
    line = F.struct(*ORDER)
    tokens = reduce(lambda x, y: x + y, (F.max(mine(F.col(f"tokens.{c}"))).over(response) for c in COUNTS[:4]))
    outcome = F.create_map(*(F.lit(x) for kv in STOPS.items() for x in kv))[F.col("stop")]
    opens = is_response & (line == F.min(mine(line)).over(response))
    settled = F.coalesce(F.min_by(outcome, F.when(is_response & outcome.isNotNull(), line)).over(response), F.lit(""))
    rows = rows.withColumns({"opens": opens, "settled": settled, "all_tokens": tokens, "touched": F.max("fresh").over(response)})
    # calls without an id are numbered within their response
    unnamed = lambda tools: F.size(F.filter(tools, lambda t: t["id"] == ""))
    ahead = response.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("unnamed", F.coalesce(F.sum(mine(unnamed(F.col("tools")))).over(ahead), F.lit(0)))
    kept = [c for c in ("epoch", "past") if c in lines.columns]
    name = F.create_map(*(F.lit(x) for kv in STEP_OF.items() for x in kv))
    about = "k int, id string, kind string, outcome string, path string, result boolean, number long"
    item = lambda k, id_, kind, said, path, result=False, number=F.lit(0): F.struct(
        F.lit(k).cast("int").alias("k") if isinstance(k, int) else k.cast("int").alias("k"), id_.alias("id"), kind.alias("kind"), said.alias("outcome"), path.alias("path"), F.lit(result).alias("result"), number.cast("long").alias("number")
    )
    nothing, no_item = F.lit(""), F.array().cast(f"array<struct<{about.replace(' ', ':').replace(',:', ',')}>>")
    turn = F.when(F.col("opens"), F.array(item(0, F.col("key"), F.lit("assistant"), F.col("settled"), nothing))).otherwise(no_item)
    calls = F.when(is_response, F.transform("tools", lambda t, k: item(k + 1, t["id"], F.coalesce(name[purpose(t["name"])], F.lit("other")), nothing, t["path"], number=F.when(t["id"] == "", F.col("unnamed") + unnamed(F.slice("tools", 1, k)))))).otherwise(no_item)
    told = lambda r: F.when(F.col("kind") == "denial", "denied").when(r["wrong"], "error").otherwise("ok")
    results = F.transform(F.filter("results", lambda r: r["id"] != ""), lambda r: item(0, r["id"], nothing, told(r), nothing, True))
    lost = F.when(F.col("starts") & F.col("owner").isNotNull() & (F.col("uuid") != ""), F.array(item(0, F.concat("uuid", F.lit(":compaction")), F.lit("compaction"), nothing, nothing))).otherwise(no_item)
    items = rows.select(*kept, "file", *STRETCH, *ORDER, "fresh", "touched", "key", "session_id", "agent_id", "ts", "model", "cwd", "all_tokens", F.explode(F.concat(turn, calls, results, lost)).alias("x")).select("*", "x.*").drop("x")
    of_id = Window.partitionBy("file", "id", etl.alone(F.col("id") != "", [*ORDER, "k"]))
    answer = F.max(F.when(F.col("result"), F.struct(*ORDER, "outcome"))).over(of_id)
    is_call = ~F.col("kind").isin("assistant", "compaction")
    settled = F.when(is_call & (F.col("id") != ""), F.coalesce(F.col("answer.outcome"), nothing)).otherwise(F.col("outcome"))
    # of a response that a new line goes on with, and a call that a new result names, all lines are here
    told_of = F.when(F.col("kind") == "assistant", F.col("touched")).when(is_call & (F.col("id") != ""), F.max("fresh").over(of_id)).otherwise(F.col("fresh"))
    every = items.withColumns({"answer": answer, "touched": F.col("fresh") | told_of}).where("NOT result").withColumn("outcome", settled)
    key = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat_ws(":", "key", F.col("number").cast("string")))
    target = F.when(F.col("path") != "", target_key(F.col("path"), F.col("cwd")))
    named = every.withColumn("dedupe_key", key).where("touched").withColumn("target", F.when(target != "", target))
    model = F.when(F.col("kind") != "compaction", F.col("model")).otherwise("")
    tokens = F.when(F.col("kind") == "assistant", F.col("all_tokens")).otherwise(0)
    listed = cut(named.select(*kept, "file", *STRETCH, *ORDER, "k", "fresh", "session_id", F.col("agent_id").alias("timeline"), "ts", "kind", "outcome", "dedupe_key", model.alias("model"), tokens.alias("tokens"), "target"), "steps")
    new = listed.where("fresh")
    # a file's different targets, and how many steps lie before a stretch, are few rows
    met = new.where("target IS NOT NULL").groupBy("file", "target").agg(F.min(F.struct(*ORDER, "k")).alias("met"))
    met = met.withColumns({"known": F.lit(None).cast("long"), "top": F.lit(0).cast("long")}) if places is None else _met_before(met, places)
    rank = F.dense_rank().over(Window.partitionBy("file", F.col("known").isNull()).orderBy("met")).cast("long")
    refs = met.select("file", "target", F.coalesce("known", F.col("top") + rank).alias("target_ref"))
    placed = new.where("target IS NOT NULL").join(refs, ["file", "target"]).unionByName(new.where("target IS NULL").withColumn("target_ref", F.lit(0).cast("long")))
    held = new.groupBy("file", *STRETCH).agg(F.count(F.lit(1)).alias("held"))
    past = held.select("file", *STRETCH, F.coalesce(F.sum("held").over(etl.upto("file", STRETCH, -1)), F.lit(0)).alias("held_before"))
    if places is not None:
        last = places.groupBy("file").agg(F.max("ordinal").alias("last"))
        past = past.join(last, "file", "left").select("file", *STRETCH, (F.col("held_before") + F.coalesce("last", F.lit(0))).alias("held_before"))
    here = Window.partitionBy("file", *STRETCH).orderBy(*ORDER, "k")
    ordinal = (F.col("held_before") + F.row_number().over(here)).alias("ordinal")
    columns = [*kept, "file", *ORDER, "k", "fresh", "target", "session_id", "timeline", "ts", "kind", "outcome", "dedupe_key", "model", "tokens", "target_ref"]
    steps = placed.join(past.hint("shuffle_hash"), ["file", *STRETCH]).select(*columns, ordinal)
    if places is None:
        return steps
    again = listed.where("NOT fresh").join(places.select("file", *ORDER, "k", "ordinal", "target_ref"), ["file", *ORDER, "k"])
    return steps.unionByName(again.select(*columns, "ordinal"))


def _met_before(met: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the number that a target has in its file by what was read before (``known``), and the highest one there (``top``)."""
    known = places.where("target IS NOT NULL").groupBy("file", "target").agg(F.min("target_ref").alias("known"))
    top = known.groupBy("file").agg(F.max("known").alias("top"))
    return met.join(known, ["file", "target"], "left").join(top, "file", "left").na.fill(0, ["top"])


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return cut(facts(placed_lines(spark, path)), "facts")


def records(spark: SparkSession, path: str | list[str], covered: DataFrame | None = None) -> DataFrame:
    return as_usage(records_of(read(spark, path), covered), "claude-code")


def steps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return steps_of(read(spark, path))
