"""Queries of provenance, check-ups, stale captures, the share card's shape and imports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators import etl, health, metrics, sequences, surfaces
from meterloom.plans import metric_oracles
from meterloom.plans.bridge import NOW, SINCE
from meterloom.plans.oracles import PRELUDE
from meterloom.schema import answering
from meterloom.session import scratch_path
from meterloom.sources import exports
from meterloom.streaming import imports

SIGNALS = {"cache_write": "cache_write_tokens", "reasoning": "reasoning_tokens", "lines_added": "lines_added", "compactions": "compactions", "rework_lines": "rework_lines", "rejected": "rejected", "tool_errors": "tool_errors"}
SECRET = bytes(range(32))
PATHS = ("vendor/a.go", "pkg/x_test.go", "docs/guide.md", "conf/app.yaml", "src/main.py", "bin/tool")


def queries() -> dict[str, Callable]:
    def state(x) -> DataFrame:
        return x.read("event_lines").selectExpr("concat('b', s % 3) AS version", "ts AS ingested_at").where("version <> 'b2'")

    def export_read(x) -> DataFrame:
        """The cube as an export in its vendor's spelling, some of its rows past reading."""
        day = F.when(F.col("tool") == "codex", F.concat("day", F.lit("T10:00:00Z"))).when(F.col("tool") == "cline", F.regexp_replace("day", "-", "/")).otherwise(F.col("day"))
        amount = F.concat(F.lit("$"), F.format_number(F.col("tokens") / 100, 2))
        amount = F.when(F.col("tool") == "gemini-cli", F.concat(F.lit("("), amount, F.lit(")"))).when(F.col("tool") == "copilot-cli", F.lit("n/a")).otherwise(amount)
        rows = x.cube.groupBy("tool", "day", "model").agg(F.sum("tokens").alias("tokens")).select(day.alias("Usage Date"), F.concat(F.lit(" "), "model").alias("SKU"), amount.alias("Amount USD"), F.format_number("tokens", 0).alias("Total Tokens"))
        path = scratch_path(x.spark, "export")
        rows.write.option("header", True).csv(path)
        read = exports.read_export(x.spark, path)
        return read.groupBy(F.coalesce("day", F.lit("")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def restated(x) -> DataFrame:
        rows = x.read("usage_record").withColumn("e", F.substring("dedupe_key", 2, 20).cast("long"))
        blank = {c: F.when(F.col("e") % 3 == 0, F.lit("" if c in ("skill", "agent") else 0)).otherwise(F.col(c)) for c in etl.SIGNALS}
        offered = rows.where("e % 2 = 0").withColumn("seq", F.lit(1)).withColumn("tool_reads", F.col("tool_reads") + 1)
        return etl.restate_signals(rows.withColumns(blank), offered).select("tool", "dedupe_key", *etl.SIGNALS)

    def changes(x) -> DataFrame:
        """A log of commits, one for every twenty events, each changing some of the paths."""
        path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("v") % len(PATHS) + 1).cast("int"))
        change = F.concat_ws("\t", (F.col("v") % 9).cast("string"), (F.col("v") % 4).cast("string"), path)
        commit = F.when(F.col("e") % 20 == 0, F.concat(F.lit("commit:c"), (F.col("e") / 20).cast("long").cast("string")))
        rows = x.read("event_lines").select(F.lit("log").alias("file"), (F.col("e") / 2000).cast("long").alias("part"), "e", F.posexplode(F.array_compact(F.array(commit, change))).alias("k", "line"))
        log = rows.select(F.concat("file", F.col("part").cast("string")).alias("file"), (F.col("e") * 2 + F.col("k")).alias("seq"), "line")
        return surfaces.categories(surfaces.numstat(log))

    def members(x) -> DataFrame:
        rows = x.read("usage_record").groupBy("member", "project").agg(F.count(F.lit(1)).alias("n"))
        return rows.select(surfaces.pseudonym("member", F.col("member"), SECRET).alias("member"), surfaces.pseudonym("project", F.col("project"), SECRET).alias("project"), "n")

    def facts(x) -> DataFrame:
        w = x.bounds
        delegated = x.usage.agg((F.sum(F.when(F.col("sidechain") == 1, F.col("output_tokens"))) / F.sum("output_tokens")).alias("share"))
        m = metrics.METRICS
        return health.shape_facts(m["model_fit"](x, w), m["session_taxonomy"](x, w), m["rhythm"](x, w), m["rework"](x, w), m["cache_hygiene"](x, w), m["context"](x, w), m["adoption"](x, w), x.cube, delegated)

    def streamed(x) -> DataFrame:
        """Records pushed in two files, the second restating part of the first, as a streaming import leaves them."""
        rows = x.read("usage_record").drop("day").withColumn("e", F.substring("dedupe_key", 2, 20).cast("long"))
        landing, store = scratch_path(x.spark, "landing"), scratch_path(x.spark, "store")
        rows.where("e % 3 <> 0").drop("e").coalesce(1).write.json(f"{landing}/a")
        again = rows.where("e % 2 = 0").withColumn("edits", F.col("edits") + 5).withColumn("input_tokens", F.col("input_tokens") + F.col("e") % 7 - 3).withColumn("granularity", F.when(F.col("e") % 10 == 0, "year").otherwise(F.col("granularity")))
        again.drop("e").coalesce(1).write.json(f"{landing}/b")
        imports.import_pushed(x.spark, f"{landing}/*", store, NOW, files=1)
        refused = imports.quarantine(x.spark, store).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.col("reason").alias("dedupe_key"), F.col("n").alias("input_tokens"), F.lit(0).cast("long").alias("edits"))
        return imports.usage(x.spark, store).select("dedupe_key", "input_tokens", "edits").unionByName(refused)

    def layers(x) -> DataFrame:
        """What each metric speaks of, and how many of the window's records it could rest on."""
        named = x.usage.agg(F.count(F.lit(1)).alias("records")).withColumn("metric", F.explode(F.array(*map(F.lit, metrics.METRICS))))
        return named.select("metric", health.layer(F.col("metric")).alias("layer"), "records")

    return {
        "provenance": lambda x: health.provenance(state(x)),
        "freshness": lambda x: x.read("usage_record").groupBy("tool").agg(F.max("ts").alias("newest")),
        "cost_per_record": lambda x: health.record_costs(x.usage, x.prices),
        "capability_filter": lambda x: health.answered_by(x.usage, "lines_added", "tool_errors").groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("lines_added").alias("lines_added")),
        "zero_token_records": lambda x: health.zero_token(x.read("usage_record").withColumns({c: F.when(F.substring("dedupe_key", 2, 20).cast("long") % 50 == 0, 0).otherwise(F.col(c)) for c in etl.VENDOR})).groupBy("tool").agg(F.count(F.lit(1)).alias("n")),
        "doctor": lambda x: health.doctor(x.read("usage_record"), x.steps, x.cube, NOW),
        "status_line": lambda x: health.status_line(x.usage, x.prices, "2024-01-20 15:00:00", 200.0),
        "stale_captures": lambda x: health.stale_captures(x.cube.withColumn("compactions", F.lit(0)), SIGNALS),
        "trace_coverage": lambda x: health.trace_coverage(etl.within_horizon(x.steps, NOW, 20), sequences.scoped(etl.within_horizon(x.steps, NOW, 20), x.sessions), NOW, SINCE),
        "metric_layers": layers,
        "share_axes": lambda x: health.axes(facts(x)),
        "share_archetype": lambda x: health.archetype(facts(x)),
        "share_hook": lambda x: health.hook(facts(x), health.hook_counts(x.cube, x.sessions, x.usage, NOW)),
        "export_read": export_read,
        "restate_signals": restated,
        "path_categories": changes,
        "pseudonyms": members,
        "stream_import": streamed,
    }


def oracle_sql() -> dict[str, str]:
    own = metric_oracles.metrics()
    metric = lambda n: f"({own[f'metric_{n}']})"
    facts = f""", f AS (
        SELECT premium_share AS premium, conversational / cast(nullif(tx.capable, 0) as double) AS conversational, off_share AS off_hours, churn_rate AS rework, reuse AS cache_read,
               compaction_rate AS compaction, ad.n_sessions AS sessions, sessions_per_day, c.n / cast(nullif(c.calls, 0) as double) AS commands, d.share AS delegation
        FROM {metric('model_fit')} mf, {metric('session_taxonomy')} tx, {metric('rhythm')} rh, {metric('rework')} rw, {metric('cache_hygiene')} ch, {metric('context')} cx, {metric('adoption')} ad,
             (SELECT sum(tool_commands) AS n, sum(tool_reads + tool_searches + tool_commands + tool_writes + tool_other) AS calls FROM cube) c,
             (SELECT sum(CASE WHEN sidechain = 1 THEN output_tokens END) / cast(sum(output_tokens) as double) AS share FROM u) d)"""
    fact = {"editing": "1 - conversational"}
    axes = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(greatest(0.02, least(0.98, ({fact.get(c, c)}) * {by})), 6) AS place FROM f WHERE ({fact.get(c, c)}) IS NOT NULL" for a, b, c, by in health.AXES)
    kinds = " ".join(f"WHEN {rule} THEN {k}" for k, (_, rule) in enumerate(health.ARCHETYPES, 1))
    names = ", ".join(f"'{n}'" for n, _ in health.ARCHETYPES)
    able = lambda *s: ", ".join(f"'{t}'" for t in answering(*s))
    stale = " UNION ALL ".join(
        f"""SELECT '{s}' AS signal, round(coalesce(sum(CASE WHEN tool IN ({able(s)}) AND shown > 0 THEN t END), 0) / cast(sum(t) as double), 6) AS covering,
        coalesce(sum(CASE WHEN tool IN ({able(s)}) THEN t END), 0) > 0 AS recorded FROM (SELECT tool, sum(tokens) AS t, sum({0 if c == 'compactions' else c}) AS shown FROM cube GROUP BY tool)"""
        for s, c in SIGNALS.items()
    )
    e = "cast(substr(dedupe_key, 2) as bigint)"
    blank = ", ".join(f"CASE WHEN {e} % 3 = 0 THEN {chr(39) * 2 if c in ('skill', 'agent') else 0} ELSE {c} END AS {c}" for c in etl.SIGNALS)
    empty = " AND ".join(f"s.{c} = {chr(39) * 2 if c in ('skill', 'agent') else 0}" for c in etl.SIGNALS)
    filled = ", ".join(f"CASE WHEN o.dedupe_key IS NOT NULL AND {empty} THEN o.{c} ELSE s.{c} END AS {c}" for c in etl.SIGNALS)
    # HMAC of names by the textbook: the key's pads are constants
    pad = lambda b: "unhex('" + bytes(x ^ b for x in SECRET.ljust(64, b"\0")).hex() + "')"
    hidden = lambda kind: f"CASE WHEN {kind} = '' THEN 'unknown' ELSE '{kind}-' || substr(sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode('{kind}:' || {kind})))), 1, 10) END"
    kinds_of = ", ".join(f"'{k}'" for k in ("generated", "test", "docs", "config", "source", "other"))
    paths = ", ".join(f"'{p}'" for p in PATHS)
    out = {
        "provenance": " SELECT max(ts) AS newest, 'mixed (2 builds)' AS build FROM event_lines WHERE s % 3 <> 2",
        "freshness": " SELECT tool, max(ts) AS newest FROM usage_record GROUP BY tool",
        "cost_per_record": """ SELECT tool, dedupe_key, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS tokens,
            round(input_tokens * p_in + output_tokens * p_out + (cache_write_tokens - least(cache_write_1h, cache_write_tokens)) * p_write + least(cache_write_1h, cache_write_tokens) * p_write_1h + cache_read_tokens * p_read, 9) AS cost
            FROM u LEFT JOIN prices ON price_model = regexp_replace(lower(model), '-[0-9]{8}$', '')""",
        "capability_filter": f" SELECT tool, count(*) AS n, sum(lines_added)::bigint AS lines_added FROM u WHERE tool IN ({able('lines_added', 'tool_errors')}) GROUP BY tool",
        "zero_token_records": f" SELECT tool, count(*) AS n FROM usage_record WHERE {e} % 50 = 0 GROUP BY tool",
        "doctor": f""" SELECT a.*, b.*, c.*, unpriced_share > 0.05 AS over_ceiling FROM (
            SELECT count(*) AS records, count(DISTINCT tool) AS tools, count(DISTINCT (session_id, member)) AS sessions, min(ts) AS oldest, max(ts) AS newest,
                   floor((epoch(TIMESTAMP '{NOW}') - epoch(min(CASE WHEN tool = 'claude-code' THEN ts END))) / 86400)::bigint AS kept_days FROM usage_record) a,
          (SELECT count(*) AS steps, floor((epoch(TIMESTAMP '{NOW}') - epoch(min(ts))) / 86400)::bigint AS step_days FROM session_step) b,
          (SELECT count(*) FILTER (WHERE cost IS NULL) AS unpriced_rows, count(DISTINCT CASE WHEN unpriced_tokens > 0 THEN model END) AS unpriced_models,
                  round(sum(unpriced_tokens) / cast(sum(tokens) as double), 6) AS unpriced_share FROM cube) c""",
        "status_line": f""", p AS (
            SELECT u.*, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS t,
                   input_tokens * p_in + output_tokens * p_out + (cache_write_tokens - least(cache_write_1h, cache_write_tokens)) * p_write + least(cache_write_1h, cache_write_tokens) * p_write_1h + cache_read_tokens * p_read AS cost
            FROM u LEFT JOIN prices ON price_model = regexp_replace(lower(model), '-[0-9]{{8}}$', '') WHERE ts <= TIMESTAMP '2024-01-20 15:00:00')
          SELECT sum(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN t ELSE 0 END)::bigint AS tokens, sum(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN lines_added ELSE 0 END)::bigint AS lines,
                 coalesce(bool_or(tool IN ({able('lines_added')})) FILTER (WHERE ts >= TIMESTAMP '2024-01-20'), false) AS line_capable, round(sum(cost), 9) AS month_cost,
                 floor((epoch(TIMESTAMP '2024-01-20 15:00:00') - epoch(max(ts))) / 60)::bigint AS age_minutes, round(round(sum(cost), 9) / 200.0, 6) AS of_plan FROM p""",
        "stale_captures": f", g AS ({stale}) SELECT *, CASE WHEN covering <= 0 AND recorded THEN 're-read' WHEN covering <= 0 THEN 'unanswerable' ELSE '' END AS reason FROM g",
        "trace_coverage": f""", st AS (SELECT * FROM session_step WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY),
          sc AS (
            SELECT st.*, CASE WHEN timeline <> '' THEN 'subagent' WHEN entrypoint = 'cli' THEN 'interactive' WHEN entrypoint IN ('sdk-py', 'sdk-cli') THEN 'programmatic' ELSE 'unstated' END AS scope
            FROM st LEFT JOIN (SELECT session_id, member, max(entrypoint) AS entrypoint FROM u GROUP BY ALL) USING (session_id, member)),
          x AS (
            SELECT count(DISTINCT CASE WHEN scope = 'interactive' THEN (session_id, member, timeline) END) AS n_sequences, 1 - avg((scope = 'interactive')::int) AS ex,
                   (30 - floor((epoch(min(ts)) - epoch(TIMESTAMP '{SINCE}')) / 86400)) / 30 AS covered FROM sc)
          SELECT n_sequences, round(ex, 6) AS excluded_share, round(covered, 6) AS covered, round((1 - ex) * covered, 6) AS covering FROM x""",
        "metric_layers": " SELECT metric, CASE WHEN metric IN ('concentration', 'rework', 'throughput') THEN 'output' ELSE 'activity' END AS layer, (SELECT count(*) FROM u) AS records FROM (VALUES " + ", ".join(f"('{n}')" for n in metrics.METRICS) + ") t(metric)",
        "share_axes": f"{facts} {axes}",
        "share_hook": f"""{facts}, n AS (
            SELECT sum(tokens) AS tokens, sum(lines_added) FILTER (WHERE tool IN ('claude-code', 'codex', 'copilot-cli')) AS lines,
                   sum(tool_reads + tool_searches + tool_commands + tool_writes + tool_other) FILTER (WHERE tool IN ('claude-code', 'codex')) AS tool_calls,
                   sum(rejected) FILTER (WHERE tool = 'claude-code') AS rejections, sum(cost) AS cost, count(DISTINCT model) FILTER (WHERE tokens > 0 AND model <> '') AS models FROM cube),
          d AS (SELECT avg((dayofweek(first_ts) IN (0, 6))::integer) AS weekend FROM sessions),
          h(place, family, figure, value, threshold) AS (
            SELECT x.* FROM f, n, d, LATERAL (VALUES (0, 'scale', 'tokens', n.tokens::double, 1e9), (1, 'scale', 'sessions_per_day', f.sessions_per_day, 20), (2, 'scale', 'lines', n.lines, 50000), (3, 'scale', 'tool_calls', n.tool_calls, 20000),
              (4, 'counterintuition', 'conversational', f.conversational * 100, 70), (5, 'counterintuition', 'commands', f.commands * 100, 40), (6, 'counterintuition', 'delegation', f.delegation * 100, 10), (7, 'counterintuition', 'models', n.models, 5),
              (8, 'money', 'cost', n.cost, 1000), (10, 'human', 'off_hours', f.off_hours * 100, 45), (11, 'human', 'weekend', d.weekend * 100, 20), (12, 'self-critical', 'rework', f.rework * 100, 3),
              (13, 'self-critical', 'premium', f.premium * 100, 80), (14, 'self-critical', 'rejections', n.rejections, 100), (15, 'craft', 'cache_read', f.cache_read * 100, 95)) x)
          SELECT family, figure, round(value, 6) AS value, threshold::double AS threshold, round(ln(value / threshold), 6) AS clearance FROM h WHERE value > threshold ORDER BY value / threshold DESC, place LIMIT 1""",
        "share_archetype": f"{facts} SELECT [{names}][k] AS name, k AS place FROM (SELECT CASE {kinds} END AS k FROM f)",
        "export_read": """, g AS (SELECT tool, day, model, sum(tokens)::bigint AS tokens FROM cube GROUP BY ALL)
          SELECT CASE WHEN tool = 'copilot-cli' THEN '' ELSE day END AS day, count(*) AS n,
                 round(sum(CASE tool WHEN 'copilot-cli' THEN 0.0 WHEN 'gemini-cli' THEN -tokens / 100.0 ELSE tokens / 100.0 END), 2) AS cost,
                 sum(CASE WHEN tool = 'copilot-cli' THEN 0 ELSE tokens END)::bigint AS tokens FROM g GROUP BY 1""",
        "restate_signals": f""", s AS (SELECT * REPLACE ({blank}) FROM usage_record), o AS (SELECT * REPLACE (tool_reads + 1 AS tool_reads) FROM usage_record WHERE {e} % 2 = 0)
          SELECT s.tool, s.dedupe_key, {filled} FROM s LEFT JOIN o ON s.tool = o.tool AND s.dedupe_key = o.dedupe_key""",
        "path_categories": f""", c AS (
            SELECT 'c' || cast(cast(floor(e / 20) as bigint) as string) AS "commit", v % {len(PATHS)} AS p, v % 9 AS added, v % 4 AS removed FROM event_lines)
          SELECT "commit", [{kinds_of}][p + 1] AS kind, count(DISTINCT [{paths}][p + 1]) AS files, sum(added)::bigint AS added, sum(removed)::bigint AS removed FROM c GROUP BY 1, 2""",
        "pseudonyms": f", g AS (SELECT member, project, count(*) AS n FROM usage_record GROUP BY ALL) SELECT {hidden('member')} AS member, {hidden('project')} AS project, n FROM g",
        "stream_import": f""", r AS (SELECT *, {e} AS e FROM usage_record), o AS (SELECT *, input_tokens + e % 7 - 3 AS i, edits + 5 AS ed FROM r WHERE e % 2 = 0 AND e % 10 <> 0)
          SELECT coalesce(s.dedupe_key, o.dedupe_key) AS dedupe_key, greatest(coalesce(s.input_tokens, o.i), coalesce(o.i, s.input_tokens)) AS input_tokens, coalesce(o.ed, s.edits) AS edits
          FROM (SELECT * FROM r WHERE e % 3 <> 0) s FULL JOIN o ON s.tool = o.tool AND s.dedupe_key = o.dedupe_key
          UNION ALL SELECT 'granularity', count(*), 0 FROM r WHERE e % 10 = 0""",
    }
    return {k: PRELUDE.rstrip() + v for k, v in out.items()}
