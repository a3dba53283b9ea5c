"""Queries that exercise the ETL operators and surfaces on lines, offers and snapshots made from ``events``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators import etl, facts, reports, surfaces
from meterloom.plans.bridge import NOW, RECENT
from meterloom.plans.oracles import PRELUDE

COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
RULES = [
    ("git_branch", r"^feat/", "task", "feature"),
    ("git_branch", r"^fix/", "task", "bugfix"),
    ("git_branch", r"^docs/", "task", "docs"),
    ("skill", r"^docs$", "task", "docs"),
    ("skill", r"^review$", "difficulty", "high"),
]


def queries() -> dict[str, Callable]:
    lines = lambda x, *cols: x.read("event_lines").selectExpr("s AS file", "e AS line", *cols)

    def offers(x) -> tuple[DataFrame, DataFrame]:
        usage = x.read("usage_record").withColumn("e", F.substring("dedupe_key", 2, 20).cast("long"))
        stored = usage.where("e % 3 <> 0").withColumn("seq", F.lit(0).cast("long"))
        more = {c: F.col(c) + F.col("e") % 7 - 3 for c in COUNTS}
        offered = usage.where("e % 2 = 0").withColumn("seq", F.lit(1).cast("long")).withColumns(more).withColumn("edits", F.col("edits") + F.col("e") % 2 + 1).withColumn("model", F.when(F.col("e") % 5 == 0, "").otherwise("renamed"))
        return stored, offered

    def dedupe_insert(x):
        stored, offered = offers(x)
        return etl.insert_absent(stored, offered).select("tool", "dedupe_key", "seq", *COUNTS)

    def restate_activity(x):
        stored, offered = offers(x)
        return etl.restate(stored, offered).select("tool", "dedupe_key", *COUNTS, "edits", "granularity", "sidechain", "skill", "session_id", "ts", "model")

    def step_upsert(x):
        steps = x.steps.withColumn("e", F.substring("dedupe_key", 2, 20).cast("long"))
        stored = steps.where("e % 3 <> 0").withColumn("seq", F.lit(0))
        offered = steps.where("e % 2 = 0").withColumn("seq", F.lit(1)).withColumn("outcome", F.when(F.col("e") % 7 == 0, "unheard-of").otherwise("ok")).withColumn("tokens", F.col("tokens") + 1)
        return etl.upsert_steps(stored.drop("e"), offered.drop("e"), ("assistant", "read", "command", "edit"), ("", "ok", "error", "denied", "truncated")).select("tool", "timeline", "dedupe_key", "outcome", "target_ref", "tokens", "ordinal", "kind")

    def superseded(x):
        records = x.read("usage_record").withColumn("e", F.substring("dedupe_key", 2, 20).cast("long")).where("agent <> ''").withColumn("dedupe_key", F.concat(F.lit("agent:"), (F.col("e") % 50).cast("string")))
        covered = records.where("e % 50 < 20").selectExpr("cast(e % 50 as string) AS agent_id").distinct()
        return etl.superseded(records, covered).select("dedupe_key", "e")

    def inputs(x) -> tuple[DataFrame, DataFrame]:
        found = lines(x, "concat('f', e % 400) AS path", "v AS size", "e AS mtime").groupBy("path").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime")).withColumn("version", F.lit("b1"))
        n = F.substring("path", 2, 9).cast("int")
        state = found.where(n % 3 != 0).withColumn("version", F.when(n % 5 == 0, "b0").otherwise(F.col("version"))).withColumn("mtime", F.col("mtime") + (n % 7 == 0).cast("int"))
        return found, state.unionByName(found.where(n < 10).withColumn("path", F.concat(F.lit("gone"), "path")))

    def clear_labels(x):
        records = x.usage
        kept = etl.clear(records, before="2024-01-20 00:00:00", tool="claude-code")
        return etl.clear_labels(x.labels, records, kept).select("session_id", "member", "task")

    def runs(x) -> DataFrame:
        days = x.read("usage_record").groupBy("tool", "day").agg(F.countDistinct("session_id").alias("discovered"), F.countDistinct("project").alias("parsed"), F.count(F.lit(1)).alias("records"), F.sum((F.col("edits") > 0).cast("long")).alias("skipped"), F.sum((F.col("lines_added") == 0).cast("long")).alias("zero_tokens"))
        late = F.col("day") == "2024-01-30"
        shrunk = F.when(late & (F.col("tool") == "codex"), 0).otherwise(F.col("discovered") * 10)
        return days.select("tool", F.col("day").alias("seq"), shrunk.alias("discovered"), (F.col("parsed") * 5).alias("parsed"), F.when(late & (F.col("tool") == "cline"), 0).otherwise(F.col("records")).alias("records"), (F.col("skipped") * 20).alias("skipped"), "zero_tokens")

    def snapshots(x) -> tuple[DataFrame, DataFrame]:
        side = lambda c: x.cube.where(c).groupBy(F.concat_ws("/", "tool", "project").alias("name")).agg(F.sum("tokens").alias("amount"))
        return side(F.col("day") < RECENT), side((F.col("day") >= RECENT) & (F.col("project") != "proj-1"))

    def verdicts(x) -> DataFrame:
        side = lambda c: x.cube.where(c).groupBy(F.col("project").alias("metric")).agg(F.sum("tokens").alias("t")).select("metric", F.when(F.col("t") % 2 == 0, "good").otherwise("watch").alias("read"))
        return surfaces.verdict_changes(side(F.col("day") < RECENT), side((F.col("day") >= RECENT) & (F.col("project") != "proj-1")))

    def billing(x) -> tuple[DataFrame, DataFrame, str, str]:
        estimate = x.cube.select("day", "model", "cost", "tokens")
        billed = x.cube.where("day >= '2024-01-05' AND day <> '2024-01-10' AND model <> 'gpt-5.1'")
        export = billed.groupBy("day", F.concat(F.lit(" "), F.upper("model")).alias("model")).agg((F.sum("tokens") / 1_000_000).alias("cost"))
        more = export.where("model = ' GEMINI-2.5-PRO'").withColumn("model", F.lit("vendor-extra"))
        return export.unionByName(more), estimate, "2024-01-03", "2024-01-28"

    def survived(x) -> DataFrame:
        rows = lines(x, "v", "k")
        blame = rows.where("k <> 'error'").selectExpr("concat('p', v % 30) AS path", "cast(line % 97 as string) AS commit")
        commits = rows.groupBy(F.expr("cast(line % 101 as string)").alias("commit")).agg(F.sum(F.col("v") % 40).alias("added")).withColumn("merge", F.col("commit").cast("int") % 10 == 0)
        return surfaces.survival(blame, commits).withColumn("rate", F.round("rate", 6))

    def validated(x) -> DataFrame:
        rows = x.read("usage_record").withColumn("e", F.substring("dedupe_key", 2, 20).cast("long"))
        wrong = {
            "dedupe_key": (23, F.lit("")),
            "project": (29, F.repeat(F.lit("x"), 600)),
            "cache_miss_reason": (31, F.lit("No Token")),
            "granularity": (43, F.lit("day")),
            "tool_searches": (11, F.lit(-1)),
            "lines_added": (53, F.lit(2_000_000_000)),
            "cache_write_1h": (13, F.col("cache_write_tokens") + 1),
            "sidechain": (47, F.lit(2)),
            "tool_calls": (17, F.col("tool_calls") + 1),
            "member": (19, F.lit("no good")),
        }
        tool = F.when(F.col("e") % 37 == 0, "unheard-of").when(F.col("e") % 41 == 0, "plugin:acme-2").otherwise(F.col("tool"))
        bad = rows.withColumns({c: F.when(F.col("e") % n == 0, v).otherwise(F.col(c)) for c, (n, v) in wrong.items()} | {"tool": tool})
        said = bad.withColumn("reason", F.coalesce(etl.reject_reason("2024-01-25 00:00:00"), F.lit("")))
        return said.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

    return {
        "dedupe_insert": dedupe_insert,
        "restate_activity": restate_activity,
        "step_upsert": step_upsert,
        "superseded_agents": superseded,
        "line_dedupe": lambda x: etl.dedupe_lines(lines(x, "CASE WHEN e % 4 = 0 THEN '' ELSE concat('u', cast(floor(e / 15) as bigint)) END AS uuid")).select("file", "line", "uuid"),
        "response_merge": lambda x: etl.merge_responses(lines(x, "cast(floor(e / 15) as bigint) AS response", "v AS tokens", "v % 3 AS calls", "CASE WHEN e % 3 = 0 THEN '' ELSE k END AS skill"), ["file", "response"], ["tokens"], ["calls"], ["skill"]),
        "carry_forward": lambda x: etl.carry_forward(lines(x, "CASE WHEN v % 3 = 0 THEN k ELSE '' END AS branch"), ["branch"]),
        "attach_to_last": lambda x: etl.attach_to_last(lines(x, "k", "concat('r', e) AS key"), F.col("k") == "view", "key").where("owner IS NOT NULL AND k = 'error'").groupBy("file", "owner").agg(F.count(F.lit(1)).alias("errors")),
        "compaction_islands": lambda x: etl.islands(lines(x, "v"), F.col("v") % 3 == 0).groupBy("file").agg(F.sum(F.col("starts").cast("long")).alias("compactions")),
        "delta_counters": lambda x: etl.deltas(lines(x, "v", "CASE WHEN v % 10 < 3 THEN 0 ELSE v % 1000 END AS total"), ["v", "total"]).select("file", "line", "d_v", "d_total"),
        "pending_flush": lambda x: etl.flush_groups(lines(x, "k", "v"), F.col("k") == "view").where("record IS NOT NULL").groupBy("file", "record").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")),
        "rework_recurrence": lambda x: etl.rework(lines(x, "v % 7 AS added", "v % 11 AS removed"), ["file"], "line").select("file", "line", "rework"),
        "asof_model": lambda x: etl.as_of(lines(x, "k").where("k <> 'purchase'").select("file", "line"), lines(x, "k", "concat('m', v % 5) AS model").where("k = 'purchase'"), "file", "line", "model").where("model IS NOT NULL"),
        "incremental_changed": lambda x: etl.changed_inputs(*inputs(x)),
        "incremental_vanished": lambda x: etl.vanished(inputs(x)[1], inputs(x)[0]).select("path"),
        "step_window": lambda x: facts.step_horizon(etl.within_horizon(x.steps, NOW, 10)),
        "keep_newest": lambda x: etl.keep_newest(x.read("usage_record").select("tool", "day").distinct(), "tool", "day", 10),
        "clear_records": lambda x: etl.clear(x.usage, before="2024-01-20 00:00:00", tool="claude-code").groupBy("tool").agg(F.count(F.lit(1)).alias("n")),
        "clear_labels": clear_labels,
        "validate_records": validated,
        "canaries": lambda x: etl.canaries(runs(x)),
        "digest_movers": lambda x: surfaces.digest_movers(*snapshots(x)),
        "digest_verdict_changes": verdicts,
        "reconcile_scope": lambda x: surfaces.reconcile_scope(*billing(x)).withColumns({c: F.round(c, 9) for c in ("billed", "estimated")}),
        "reconcile_delta": lambda x: surfaces.reconcile(*billing(x)),
        "label_derive": lambda x: surfaces.derive_labels(facts.session_signals(x.usage), x.labels, RULES),
        "event_adapter": lambda x: surfaces.events_of(x.usage),
        "share_rays": lambda x: surfaces.rays(x.sessions),
        "survival": survived,
        "report_check_project": lambda x: reports.check(x.cube.where("project = 'proj-1'"), 100, 1e9),
    }


def oracle_sql() -> dict[str, str]:
    e = "cast(substr(dedupe_key, 2) as bigint)"
    offered = f"SELECT * REPLACE ({', '.join(f'{c} + e % 7 - 3 AS {c}' for c in COUNTS)}, edits + e % 2 + 1 AS edits, CASE WHEN e % 5 = 0 THEN '' ELSE 'renamed' END AS model) FROM ue WHERE e % 2 = 0"
    ue = f", ue AS (SELECT *, {e} AS e FROM usage_record), offered AS ({offered})"
    run = """, runs AS (SELECT tool, day AS seq, CASE WHEN day = '2024-01-30' AND tool = 'codex' THEN 0 ELSE count(DISTINCT session_id) * 10 END AS discovered, count(DISTINCT project) * 5 AS parsed,
      CASE WHEN day = '2024-01-30' AND tool = 'cline' THEN 0 ELSE count(*) END AS records, sum((edits > 0)::int) * 20 AS skipped, sum((lines_added = 0)::int) AS zero_tokens FROM usage_record GROUP BY tool, day),
      nr AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY seq DESC) AS n FROM runs), cur AS (SELECT * FROM nr WHERE n = 1),
      old AS (SELECT tool, quantile_cont(discovered, 0.5) AS usual, quantile_cont(records / cast(parsed as double), 0.5) AS uy, max(records) AS ever FROM nr WHERE n BETWEEN 2 AND 10 GROUP BY tool)"""
    snaps = f", was AS (SELECT tool || '/' || project AS name, sum(tokens)::bigint AS a FROM cube WHERE day < '{RECENT}' GROUP BY 1), nows AS (SELECT tool || '/' || project AS name, sum(tokens)::bigint AS a FROM cube WHERE day >= '{RECENT}' AND project <> 'proj-1' GROUP BY 1)"
    bill = """, estimate AS (SELECT day, model, cost, tokens FROM cube),
      export0 AS (
        SELECT day, ' ' || upper(model) AS model, sum(tokens) / 1000000.0 AS cost FROM cube
        WHERE day >= '2024-01-05' AND day <> '2024-01-10' AND model <> 'gpt-5.1' GROUP BY ALL),
      export AS (SELECT * FROM export0 UNION ALL SELECT day, 'vendor-extra', cost FROM export0 WHERE model = ' GEMINI-2.5-PRO'),
      days AS (
        SELECT coalesce(a.day, c.day) AS day, billed, estimated FROM (SELECT day, sum(cost) AS billed FROM export GROUP BY day) a
        FULL JOIN (SELECT day, sum(coalesce(cost, 0.0)) AS estimated FROM estimate GROUP BY day) c ON a.day = c.day),
      sides AS (
        SELECT *, CASE WHEN day BETWEEN '2024-01-03' AND '2024-01-28' AND (billed IS NOT NULL OR day BETWEEN (SELECT min(day) FROM export) AND (SELECT max(day) FROM export)) THEN 'both'
                       WHEN billed IS NULL THEN 'estimate' ELSE 'export' END AS side FROM days),
      common AS (SELECT day FROM sides WHERE side = 'both'),
      b AS (SELECT lower(trim(model)) AS model, sum(cost) AS billed FROM export WHERE day IN (SELECT day FROM common) GROUP BY 1),
      o AS (SELECT lower(trim(model)) AS model, sum(cost) AS estimated FROM estimate WHERE cost IS NOT NULL AND day IN (SELECT day FROM common) GROUP BY 1)"""
    lines = ", l AS (SELECT s AS file, e AS line, k, v FROM event_lines)"
    inputs = ", found AS (SELECT 'f' || cast(e % 400 as string) AS path, sum(v)::bigint AS size, max(e) AS mtime, 'b1' AS version, any_value(e % 400) AS n FROM event_lines GROUP BY e % 400), state AS (SELECT path, size, mtime + (n % 7 = 0)::int AS mtime, CASE WHEN n % 5 = 0 THEN 'b0' ELSE version END AS version FROM found WHERE n % 3 <> 0 UNION ALL SELECT 'gone' || path, size, mtime, version FROM found WHERE n < 10)"
    purposes = "(tool_reads + tool_searches + tool_commands + tool_writes + tool_other)"
    signals = "SELECT DISTINCT session_id, member, git_branch, skill FROM u ANTI JOIN session_label USING (session_id, member)"
    rules = " UNION ALL ".join(f"SELECT session_id, member, '{axis}' AS axis, '{value}' AS value FROM sig WHERE regexp_matches({source}, '{pattern}')" for source, pattern, axis, value in RULES)
    out = {
        "dedupe_insert": f"{ue} SELECT tool, dedupe_key, 0 AS seq, {', '.join(COUNTS)} FROM ue WHERE e % 3 <> 0 UNION ALL SELECT tool, dedupe_key, 1, {', '.join(COUNTS)} FROM offered WHERE e % 3 = 0",
        "restate_activity": f"{ue} SELECT coalesce(s.tool, o.tool) AS tool, coalesce(s.dedupe_key, o.dedupe_key) AS dedupe_key, {', '.join(f'greatest(coalesce(s.{c}, o.{c}), coalesce(o.{c}, s.{c})) AS {c}' for c in COUNTS)}, coalesce(o.edits, s.edits) AS edits, coalesce(o.granularity, s.granularity) AS granularity, coalesce(s.sidechain, o.sidechain) AS sidechain, coalesce(s.skill, o.skill) AS skill, coalesce(s.session_id, o.session_id) AS session_id, coalesce(s.ts, o.ts) AS ts, coalesce(s.model, o.model) AS model FROM (SELECT * FROM ue WHERE e % 3 <> 0) s FULL JOIN offered o ON s.tool = o.tool AND s.dedupe_key = o.dedupe_key",
        "step_upsert": f", st AS (SELECT *, {e} AS e FROM session_step), so AS (SELECT * REPLACE ('ok' AS outcome, tokens + 1 AS tokens) FROM st WHERE e % 2 = 0 AND e % 7 <> 0) SELECT coalesce(a.tool, b.tool) AS tool, coalesce(a.timeline, b.timeline) AS timeline, coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key, coalesce(b.outcome, a.outcome) AS outcome, coalesce(b.target_ref, a.target_ref) AS target_ref, coalesce(b.tokens, a.tokens) AS tokens, coalesce(b.ordinal, a.ordinal) AS ordinal, coalesce(a.kind, b.kind) AS kind FROM (SELECT * FROM st WHERE e % 3 <> 0) a FULL JOIN so b ON a.tool = b.tool AND a.timeline = b.timeline AND a.dedupe_key = b.dedupe_key",
        "superseded_agents": f"{ue} SELECT 'agent:' || cast(e % 50 as string) AS dedupe_key, e FROM ue WHERE agent <> '' AND e % 50 >= 20",
        "line_dedupe": ", l AS (SELECT s AS file, e AS line, CASE WHEN e % 4 = 0 THEN '' ELSE 'u' || cast(cast(floor(e / 15) as bigint) as string) END AS uuid FROM event_lines) SELECT file, line, uuid FROM l WHERE uuid = '' UNION ALL SELECT file, min(line), uuid FROM l WHERE uuid <> '' GROUP BY file, uuid",
        "response_merge": ", l AS (SELECT s AS file, e AS line, cast(floor(e / 15) as bigint) AS response, v AS tokens, v % 3 AS calls, CASE WHEN e % 3 = 0 THEN '' ELSE k END AS skill FROM event_lines) SELECT file, response, min(line) AS line, max(tokens) AS tokens, sum(calls)::bigint AS calls, coalesce(arg_min(skill, line) FILTER (WHERE skill <> ''), '') AS skill FROM l GROUP BY file, response",
        "carry_forward": ", l AS (SELECT s AS file, e AS line, CASE WHEN v % 3 = 0 THEN k END AS b FROM event_lines) SELECT file, line, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY file ORDER BY line), '') AS branch FROM l",
        "attach_to_last": f"{lines} SELECT file, owner, count(*) AS errors FROM (SELECT *, last_value(CASE WHEN k = 'view' THEN 'r' || cast(line as string) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS owner FROM l) WHERE owner IS NOT NULL AND k = 'error' GROUP BY ALL",
        "compaction_islands": f"{lines} SELECT file, sum((f AND NOT coalesce(p, false))::int)::bigint AS compactions FROM (SELECT file, v % 3 = 0 AS f, lag(v % 3 = 0) OVER (PARTITION BY file ORDER BY line) AS p FROM l) GROUP BY file",
        "delta_counters": f"{lines} SELECT file, line, greatest(a, 0) AS d_v, greatest(b, 0) AS d_total FROM (SELECT file, line, v - lag(v, 1, 0) OVER w AS a, t - lag(t, 1, 0) OVER w AS b FROM (SELECT *, CASE WHEN v % 10 < 3 THEN 0 ELSE v % 1000 END AS t FROM l) WINDOW w AS (PARTITION BY file ORDER BY line)) WHERE a > 0 OR b > 0",
        "pending_flush": f"{lines} SELECT file, record, sum(v)::bigint AS v, count(*) AS n FROM (SELECT *, CASE WHEN total > 0 THEN least(coalesce(before, 0), total - 1) END AS record FROM (SELECT *, sum((k = 'view')::int) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::bigint AS before, sum((k = 'view')::int) OVER (PARTITION BY file)::bigint AS total FROM l)) WHERE record IS NOT NULL GROUP BY ALL",
        "rework_recurrence": f"{lines}, c AS (SELECT *, pp - least(0, min(pp) OVER (PARTITION BY file ORDER BY line)) AS c FROM (SELECT *, sum(pa - r) OVER (PARTITION BY file ORDER BY line) AS pp FROM (SELECT *, v % 11 AS r, lag(v % 7, 1, 0) OVER (PARTITION BY file ORDER BY line) AS pa FROM l))) SELECT file, line, (coalesce(lag(c) OVER (PARTITION BY file ORDER BY line), 0) + pa - c)::bigint AS rework FROM c",
        "asof_model": f"{lines}, en AS (SELECT file, line, 'm' || cast(v % 5 as string) AS model FROM l WHERE k = 'purchase') SELECT r.file, r.line, coalesce((SELECT arg_max(model, line) FROM en WHERE en.file = r.file AND en.line <= r.line), (SELECT arg_min(model, line) FROM en WHERE en.file = r.file)) AS model FROM l r WHERE k <> 'purchase' AND file IN (SELECT file FROM en)",
        "incremental_changed": f"{inputs} SELECT path, size, mtime, version FROM found EXCEPT SELECT path, size, mtime, version FROM state",
        "incremental_vanished": f"{inputs} SELECT path FROM state WHERE path NOT IN (SELECT path FROM found)",
        "step_window": f" SELECT count(*) AS n_steps, min(ts) AS oldest, max(ts) AS newest FROM session_step WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY",
        "keep_newest": " SELECT tool, day FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY day DESC) AS n FROM (SELECT DISTINCT tool, day FROM usage_record)) WHERE n <= 10",
        "clear_records": " SELECT tool, count(*) AS n FROM u WHERE NOT (tool = 'claude-code' AND ts < TIMESTAMP '2024-01-20 00:00:00') GROUP BY tool",
        "clear_labels": " SELECT session_id, member, task FROM session_label WHERE (session_id, member) NOT IN (SELECT session_id, member FROM u GROUP BY ALL HAVING bool_and(tool = 'claude-code' AND ts < TIMESTAMP '2024-01-20 00:00:00'))",
        "validate_records": f"""{ue} SELECT reason, count(*) AS n FROM (SELECT CASE
            WHEN e % 23 = 0 THEN 'dedupe_key' WHEN e % 29 = 0 THEN 'length' WHEN e % 31 = 0 THEN 'cache_miss_reason' WHEN e % 37 = 0 THEN 'tool' WHEN e % 43 = 0 THEN 'granularity'
            WHEN ts < TIMESTAMP '2020-01-01 00:00:00' OR ts > TIMESTAMP '2024-01-27 00:00:00' THEN 'timestamp'
            WHEN e % 11 = 0 OR e % 53 = 0 THEN 'count' WHEN e % 13 = 0 THEN 'cache_write_1h' WHEN reasoning_tokens > output_tokens THEN 'reasoning'
            WHEN e % 47 = 0 THEN 'sidechain' WHEN e % 17 = 0 AND {purposes} <> 0 THEN 'purposes' ELSE '' END AS reason FROM ue) GROUP BY reason""",
        "canaries": f"{run} " + " UNION ALL ".join(f"SELECT tool, '{n}' AS canary FROM cur LEFT JOIN old USING (tool) WHERE {c}" for n, c in (("discovery", "usual > 0 AND (discovered = 0 OR (usual >= 20 AND discovered < 0.5 * usual))"), ("barren", "discovered > 0 AND records = 0 AND coalesce(ever, 0) = 0"), ("yield", "parsed >= 20 AND records / cast(parsed as double) < 0.25 * uy"), ("skipped", "skipped >= 50 AND skipped >= parsed"), ("zero_token", "records >= 50 AND zero_tokens >= 0.25 * records"))),
        "digest_movers": f"{snaps} SELECT coalesce(w.name, n.name) AS name, coalesce(w.a, 0) AS was, coalesce(n.a, 0) AS now, coalesce(n.a, 0) - coalesce(w.a, 0) AS delta FROM was w FULL JOIN nows n ON w.name = n.name WHERE coalesce(n.a, 0) <> coalesce(w.a, 0) ORDER BY abs(delta) DESC, 1 LIMIT 5",
        "digest_verdict_changes": f", w AS (SELECT project AS metric, CASE WHEN sum(tokens) % 2 = 0 THEN 'good' ELSE 'watch' END AS read FROM cube WHERE day < '{RECENT}' GROUP BY 1), n AS (SELECT project AS metric, CASE WHEN sum(tokens) % 2 = 0 THEN 'good' ELSE 'watch' END AS read FROM cube WHERE day >= '{RECENT}' AND project <> 'proj-1' GROUP BY 1) SELECT coalesce(w.metric, n.metric) AS metric, coalesce(w.read, '') AS was, coalesce(n.read, '') AS now FROM w FULL JOIN n ON w.metric = n.metric WHERE w.read IS DISTINCT FROM n.read",
        "reconcile_scope": f"{bill} SELECT day, side, round(billed, 9) AS billed, round(estimated, 9) AS estimated FROM sides",
        "reconcile_delta": f"""{bill}, m AS (
            SELECT coalesce(sum(CASE WHEN estimated IS NULL THEN billed END), 0.0) AS xb, coalesce(sum(CASE WHEN billed IS NULL THEN estimated END), 0.0) AS xe,
                   count(*) FILTER (WHERE billed IS NOT NULL AND estimated IS NOT NULL) AS shared_models FROM b FULL JOIN o ON b.model = o.model),
          t AS (
            SELECT sum(coalesce(cost, 0.0)) AS estimated, sum(CASE WHEN cost IS NULL THEN tokens ELSE 0 END)::bigint AS unpriced_tokens,
                   sum(CASE WHEN cost IS NOT NULL THEN tokens ELSE 0 END)::bigint AS priced_tokens, count(*) FILTER (WHERE cost IS NULL) AS unpriced_rows
            FROM estimate WHERE day IN (SELECT day FROM common)),
          c AS (
            SELECT count(*) FILTER (WHERE side = 'both') AS overlap_days, count(*) FILTER (WHERE side <> 'both' AND billed IS NOT NULL) AS export_only_days,
                   count(*) FILTER (WHERE side <> 'both' AND estimated IS NOT NULL) AS window_only_days,
                   coalesce(sum(CASE WHEN side <> 'both' THEN billed END), 0.0) AS billed_outside, coalesce(sum(CASE WHEN side <> 'both' THEN estimated END), 0.0) AS estimated_outside FROM sides),
          r AS (
            SELECT *, (SELECT sum(cost) FROM export WHERE day IN (SELECT day FROM common)) AS billed, unpriced_tokens * (estimated / priced_tokens) AS ex,
                   CASE WHEN shared_models > 0 THEN xb ELSE 0.0 END AS ob, CASE WHEN shared_models > 0 THEN xe ELSE 0.0 END AS oe FROM t, m, c)
          SELECT round(billed, 9) AS billed, round(estimated, 9) AS estimated, unpriced_tokens, priced_tokens, unpriced_rows, shared_models, overlap_days, export_only_days, window_only_days,
                 round(billed_outside, 9) AS billed_outside, round(estimated_outside, 9) AS estimated_outside, round(ob, 9) AS only_billed, round(oe, 9) AS only_estimated, round(ex, 9) AS extrapolated,
                 round(estimated + ex, 9) AS upper, round(billed - estimated, 9) AS delta, round(billed - estimated - (ex + ob - oe), 9) AS unexplained, billed BETWEEN estimated AND estimated + ex AS in_band FROM r""",
        "label_derive": f", sig AS ({signals}) SELECT session_id, member, axis, min(value) AS value FROM ({rules}) GROUP BY ALL HAVING count(DISTINCT value) = 1",
        "event_adapter": " SELECT tool, session_id, ts, dedupe_key AS event_id, 'ai_usage' AS type, input_tokens + output_tokens AS amount FROM u UNION ALL SELECT tool, session_id, ts, dedupe_key || '#edit', 'ai_edit', lines_added + lines_removed FROM u WHERE edits > 0 OR lines_added > 0 OR lines_removed > 0",
        "share_rays": " SELECT session_id, member, rank, round(sqrt(sqrt(output_tokens / cast(m as double))), 6) AS length FROM (SELECT *, row_number() OVER (ORDER BY first_ts, session_id, member) - 1 AS rank, max(output_tokens) OVER () AS m, greatest(ceil(count(*) OVER () / 3000.0), 1) AS kk FROM sessions) WHERE rank % kk::bigint = 0",
        "survival": f"{lines}, co AS (SELECT line % 101 AS c, sum(v % 40)::bigint AS added FROM l GROUP BY 1) SELECT surviving, added, round(surviving / cast(added as double), 6) AS rate FROM (SELECT (SELECT count(*) FROM l WHERE k <> 'error' AND line % 97 IN (SELECT c FROM co WHERE c % 10 <> 0)) AS surviving, (SELECT sum(added)::bigint FROM co WHERE c % 10 <> 0) AS added)",
        "report_check_project": " SELECT sum(tokens)::bigint AS tokens, round(sum(cost), 9) AS cost, sum(unpriced_tokens)::bigint AS unpriced_tokens, (sum(tokens) > 100)::int AS tokens_breach, (sum(cost) > 1e9 OR sum(unpriced_tokens) > 0)::int AS cost_breach FROM cube WHERE project = 'proj-1'",
    }
    return {k: PRELUDE.rstrip() + v for k, v in out.items()}
