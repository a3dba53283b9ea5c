"""SQL for a second engine: the same questions asked independently of the DataFrame code. Doubles are rounded alike on both sides."""

from __future__ import annotations

from meterloom.plans.bridge import NOW, PRICE_COLUMNS, PRICES, PRIOR, RECENT, SINCE, oracle_facts
from meterloom.schema import CAPABILITY, SUMS


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else f"cast({x!r} as double)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _sums(columns) -> str:
    return ", ".join(f"cast(sum({c}) as bigint) AS {c}" for c in columns)


TOKENS = "(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens)"


def _prelude() -> str:
    facts = oracle_facts()
    ctes = [f"{n} AS ({q})" for n, q in facts.items()]
    ctes += [
        f"prices({', '.join(PRICE_COLUMNS)}) AS (VALUES {_values(PRICES)})",
        f"capability(tool, signal) AS (VALUES {_values(CAPABILITY)})",
        f"u AS (SELECT * FROM usage_record WHERE ts >= TIMESTAMP '{SINCE}')",
        f"cube0 AS (SELECT day, tool, model, project, entrypoint, member, granularity, {_sums(SUMS)} FROM u GROUP BY ALL)",
        f"cubel0 AS (SELECT day, tool, model, project, entrypoint, member, granularity, coalesce(task, '') AS task, coalesce(outcome, '') AS outcome, coalesce(difficulty, '') AS difficulty, {_sums(SUMS)} FROM u LEFT JOIN session_label USING (session_id, member) GROUP BY ALL)",
    ]
    for name in ("cube", "cubel"):
        ctes.append(f"""{name} AS (SELECT *, CASE WHEN cost IS NULL THEN tokens ELSE 0 END AS unpriced_tokens FROM (
            SELECT c.*, {TOKENS} AS tokens, coalesce(x.p_out, n.p_out) AS p_out,
              input_tokens * coalesce(x.p_in, n.p_in) + output_tokens * coalesce(x.p_out, n.p_out)
              + (cache_write_tokens - least(greatest(cache_write_1h, 0), greatest(cache_write_tokens, 0))) * coalesce(x.p_write, n.p_write)
              + least(greatest(cache_write_1h, 0), greatest(cache_write_tokens, 0)) * coalesce(x.p_write_1h, n.p_write_1h)
              + cache_read_tokens * coalesce(x.p_read, n.p_read) AS cost
            FROM {name}0 c LEFT JOIN prices x ON x.price_model = c.model
            LEFT JOIN prices n ON n.price_model = regexp_replace(lower(regexp_replace(trim(c.model), '\\[[^\\]]*\\]$', '')), '-[0-9]{{8}}$', '')))""")
    ctes += [
        """gaps AS (SELECT session_id, member, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY session_id, member ORDER BY ts) AS gap FROM u WHERE granularity = 'turn')""",
        """active AS (SELECT session_id, member, sum(gap) / 60.0 AS active_minutes FROM gaps WHERE gap <= 1800 GROUP BY ALL)""",
        """sessions AS (SELECT r.*, coalesce(a.active_minutes, 0.0) AS active_minutes, coalesce(l.task, '') AS task, coalesce(l.outcome, '') AS outcome, coalesce(l.difficulty, '') AS difficulty FROM (
            SELECT session_id, member, max(project) AS project, max(tool) AS tool, max(model) AS model, max(entrypoint) AS entrypoint, min(ts) AS first_ts, max(ts) AS last_ts,
              cast(sum(CASE WHEN granularity = 'turn' THEN 1 ELSE 0 END) as bigint) AS turns, cast(sum(output_tokens) as bigint) AS output_tokens,
              coalesce(max(CASE WHEN granularity = 'turn' THEN cache_read_tokens + input_tokens END), 0) AS peak_context, cast(sum(edits) as bigint) AS edits, cast(sum(compactions) as bigint) AS compactions
            FROM u GROUP BY session_id, member) r LEFT JOIN active a USING (session_id, member) LEFT JOIN session_label l USING (session_id, member))""",
    ]
    return "WITH " + ",\n".join(ctes) + "\n"


PRELUDE = _prelude()


def can(*signals: str) -> str:
    """SQL list of the tools that record all of the signals."""
    have = set(CAPABILITY)
    tools = sorted({t for t, _ in CAPABILITY if all((t, s) in have for s in signals)})
    return "(" + ", ".join(f"'{t}'" for t in tools) + ")"


LINE, REWORK = can("lines_added", "lines_removed"), can("rework_lines")
ACTIVITY = can("lines_added", "lines_removed", "edits", "tool_calls", "rework_lines")


def _report(cube: str, by: str) -> str:
    name = f"CASE WHEN {by} = '' THEN 'unlabeled' ELSE {by} END" if by in ("task", "outcome", "difficulty") else by
    numbers = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "lines_added", "tokens", "unpriced_tokens")
    eff = "round(CASE WHEN input_tokens + cache_read_tokens <> 0 THEN cache_read_tokens / cast(input_tokens + cache_read_tokens as double) END, 6) AS cache_eff"
    if by == "day":
        return f"SELECT day AS name, tool, model, project, entrypoint, member, granularity, {', '.join(numbers)}, round(cost, 9) AS cost, {eff} FROM {cube}"
    return f"""SELECT name, granularity, {', '.join(numbers)}, round(cost, 9) AS cost, {eff} FROM (SELECT {name} AS name,
        CASE WHEN count(DISTINCT granularity) > 1 THEN 'mixed' ELSE max(granularity) END AS granularity, {_sums(numbers)}, sum(cost) AS cost FROM {cube} GROUP BY 1)"""


def _effectiveness(by: str, cube: str = "cube", where: str = "true") -> str:
    return f"""SELECT {by} AS name, {_sums(("lines_added", "lines_removed", "edits", "tool_calls", "rejected", "tokens", "unpriced_tokens"))},
        round(sum(cost), 9) AS cost, max(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS has_unpriced, max(CASE WHEN tool IN {LINE} THEN 1 ELSE 0 END) AS line_capable,
        round(CASE WHEN max(CASE WHEN tool IN {LINE} THEN 1 ELSE 0 END) = 1 AND sum(lines_added) <> 0 THEN sum(cost) / (sum(lines_added) / 100.0) END, 6) AS cost_per_100_lines
        FROM {cube} WHERE {where} GROUP BY 1"""


def _movers(by: str) -> str:
    side = lambda c, when, name: f"coalesce(sum(CASE WHEN {when} THEN {c} END), 0)"
    now, then = f"day >= '{RECENT}'", f"day < '{RECENT}'"
    big = lambda c, when: f"cast({side(c, when, '')} as bigint)"
    return f"""SELECT {by} AS name, round({side('cost', now, '')} - {side('cost', then, '')}, 9) AS delta_cost, {big('lines_added', now)} - {big('lines_added', then)} AS delta_lines,
        round({side('cost', now, '')}, 9) AS cost_now, round({side('cost', then, '')}, 9) AS cost_prior, {big('lines_added', now)} AS lines_now, {big('lines_added', then)} AS lines_prior,
        {big('tokens', now)} AS tokens_now, {big('tokens', then)} AS tokens_prior, {big('unpriced_tokens', now)} AS unpriced_now, {big('unpriced_tokens', then)} AS unpriced_prior
        FROM cube WHERE day >= '{PRIOR}' GROUP BY 1"""


def _stats(by: str, where: str, tail: str = "") -> str:
    return f"""SELECT {by} AS name, cast(sum(lines_added) as bigint) AS lines_added, max(day) AS last_active, round(sum(cost), 9) AS cost, max(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS has_unpriced,
        round(CASE WHEN sum(lines_added) <> 0 THEN sum(cost) / (sum(lines_added) / 100.0) END, 6) AS cost_per_100_lines FROM cube WHERE {where} GROUP BY 1 {tail}"""


def core() -> dict[str, str]:
    top = "ORDER BY coalesce(round(sum(cost), 9), -1) DESC, name LIMIT 5"
    med = lambda c, p, who: f"cast(round(quantile_cont({c}, {p}) FILTER (WHERE {who})) as bigint)"
    turned, paced, edited, compacting = (f"tool IN {can(s)}" for s in ("turns", "active_minutes", "edits", "compactions"))
    out = {
        "usage_cube": f"SELECT day, tool, model, project, entrypoint, member, granularity, {', '.join(SUMS)} FROM cube0",
        "usage_by_label": f"SELECT day, tool, model, project, entrypoint, member, granularity, task, outcome, difficulty, {', '.join(SUMS)} FROM cubel0",
        "label_filter_usage": f"SELECT day, tool, model, project, entrypoint, member, granularity, {_sums(SUMS)} FROM u WHERE EXISTS (SELECT 1 FROM session_label l WHERE l.session_id = u.session_id AND l.member = u.member AND l.task = 'bugfix') GROUP BY ALL",
        "sessions": "SELECT * REPLACE (round(active_minutes, 6) AS active_minutes) FROM sessions",
        "active_minutes": "SELECT session_id, member, round(active_minutes, 6) AS active_minutes FROM active",
        "delegation": f"SELECT cast(sum(CASE WHEN CASE WHEN EXISTS (SELECT 1 FROM u WHERE sidechain = 1) THEN sidechain = 1 ELSE tool = 'claude-code' AND dedupe_key LIKE '%agent:%' END THEN {TOKENS} ELSE 0 END) as bigint) AS subagent_tokens, cast(sum({TOKENS}) as bigint) AS total_tokens FROM u",
        "turn_sizing": "SELECT model, sum(CASE WHEN output_tokens > 0 THEN 1 ELSE 0 END)::bigint AS turns, sum(CASE WHEN output_tokens > 0 AND output_tokens < 300 THEN 1 ELSE 0 END)::bigint AS small_turns FROM u WHERE granularity = 'turn' GROUP BY model",
        "cache_misses": "SELECT tool, cache_miss_reason, count(*) AS n FROM u WHERE cache_miss_reason <> '' GROUP BY ALL",
        "subpaths": "SELECT subpath, sum(lines_added)::bigint AS lines_added, count(DISTINCT session_id) AS n_sessions FROM u WHERE project = 'proj-1' GROUP BY subpath",
        "session_signals": "SELECT DISTINCT session_id, member, git_branch, skill, agent, entrypoint FROM u",
        "session_latest": "SELECT session_id, member, max(ts) AS last_ts FROM u GROUP BY ALL ORDER BY last_ts DESC, session_id, member LIMIT 1",
        "session_prefix": "SELECT DISTINCT session_id, member FROM u WHERE session_id LIKE 's1%'",
        "history": "SELECT tool, count(*) AS n_records, min(ts) AS history_start, max(ts) AS newest FROM usage_record GROUP BY tool",
        "step_horizon": "SELECT count(*) AS n_steps, min(ts) AS oldest, max(ts) AS newest FROM session_step",
        "report_by_day": _report("cube", "day"),
        "report_total": f"""SELECT coalesce(nullif(name, ''), '(unknown)') AS name, granularity, tokens, unpriced_tokens, cost, cache_eff FROM ({_report("cube", "entrypoint")})
            UNION ALL SELECT 'TOTAL', CASE WHEN count(DISTINCT granularity) > 1 THEN 'mixed' ELSE max(granularity) END, sum(tokens)::bigint, sum(unpriced_tokens)::bigint, round(sum(cost), 9),
            round(sum(cache_read_tokens) / sum(input_tokens + cache_read_tokens)::double, 6) FROM cube""",
        "movers_project": _movers("project"),
        "movers_tool": _movers("tool"),
        "insights_hot": _stats("project", f"project <> '' AND day >= '{RECENT}'", top),
        "insights_going_stale": _stats("project", f"project <> '' AND day < '{RECENT}' AND project NOT IN (SELECT project FROM cube WHERE day >= '{RECENT}')", top),
        "insights_dormant_tools": _stats("tool", f"day < '{RECENT}' AND tool NOT IN (SELECT tool FROM cube WHERE day >= '{RECENT}')"),
        "inventory": f"SELECT count(DISTINCT CASE WHEN project <> '' THEN project END) AS projects, count(DISTINCT model) AS models, count(DISTINCT tool) AS tools, count(DISTINCT entrypoint) AS entrypoints, count(DISTINCT day) AS days, {_sums(('lines_added', 'tokens', 'unpriced_tokens'))}, round(sum(cost), 9) AS cost, sum((tool IN {LINE})::int)::bigint AS line_capable_rows, sum(CASE WHEN tool IN {LINE} THEN tokens ELSE 0 END)::bigint AS line_capable_tokens, sum((project = '')::int)::bigint AS unattributed, sum((cost IS NULL)::int)::bigint AS unpriced_rows FROM cube",
        "churn": f"SELECT count(*) AS n_rows, {_sums(('tokens', 'lines_added', 'rework_lines'))}, round(CASE WHEN sum(lines_added) = 0 THEN 0.0 ELSE sum(rework_lines) / cast(sum(lines_added) as double) END, 6) AS rework_rate, (sum(rework_lines) > sum(lines_added))::int AS exceeds FROM cube WHERE tool IN {REWORK}",
        "unpriced_models": "SELECT model, sum(tokens)::bigint AS tokens FROM cube WHERE cost IS NULL GROUP BY model",
        "check_totals": f"SELECT {_sums(('tokens', 'unpriced_tokens'))}, round(sum(cost), 9) AS cost, (sum(tokens) > 1000000)::int AS tokens_breach, (sum(cost) > 1000000 OR sum(unpriced_tokens) > 0)::int AS cost_breach FROM cube",
        "session_stats": f"SELECT count(*) AS n_sessions, " + ", ".join(f"sum(({w})::int)::bigint AS with_{n}" for n, w in (("turns", turned), ("active_minutes", paced), ("edits", edited), ("compactions", compacting))) + f", {med('turns', 0.5, turned)} AS median_turns, {med('turns', 0.9, turned)} AS p90_turns, {med('output_tokens', 0.5, 'true')} AS median_output, {med('peak_context', 0.5, turned)} AS median_peak_context, round(quantile_cont(active_minutes, 0.5) FILTER (WHERE {paced}), 6) AS median_active_minutes, round(coalesce(avg((edits > 0)::int) FILTER (WHERE {edited}), 0.0), 6) AS code_share, round(coalesce(avg((compactions > 0)::int) FILTER (WHERE {compacting}), 0.0), 6) AS compaction_rate, count(DISTINCT first_ts::date) AS active_days, round(count(*) / cast(count(DISTINCT first_ts::date) as double), 6) AS sessions_per_day FROM sessions",
        "signal_coverage": "SELECT signal, capable_tokens, total_tokens, CASE WHEN capable_tokens = 0 THEN 'none' WHEN capable_tokens = total_tokens THEN 'full' ELSE 'partial' END AS support FROM (SELECT c.signal, coalesce(sum(t.tokens), 0)::bigint AS capable_tokens, (SELECT sum(tokens)::bigint FROM cube) AS total_tokens FROM capability c LEFT JOIN (SELECT tool, sum(tokens) AS tokens FROM cube GROUP BY tool) t USING (tool) GROUP BY c.signal)",
        "team": "SELECT c.member, c.lines_added, c.cost, c.has_unpriced, s.n_sessions FROM (SELECT member, sum(lines_added)::bigint AS lines_added, round(sum(cost), 9) AS cost, max((cost IS NULL)::int) AS has_unpriced FROM cube GROUP BY member) c FULL JOIN (SELECT member, count(*) AS n_sessions FROM sessions GROUP BY member) s USING (member)",
        "tokens_per_day": "SELECT day, sum(tokens)::bigint AS tokens FROM cube GROUP BY day",
        "tool_shares": f"SELECT round(sum(CASE WHEN tool IN {ACTIVITY} THEN tokens ELSE 0 END) / cast(sum(tokens) as double), 6) AS activity_share, round(sum(CASE WHEN cost IS NOT NULL THEN tokens ELSE 0 END) / cast(sum(tokens) as double), 6) AS priced_share, round(sum(CASE WHEN granularity = 'turn' THEN tokens ELSE 0 END) / cast(sum(tokens) as double), 6) AS turn_share FROM cube",
        "price_normalise": "SELECT DISTINCT model, regexp_replace(lower(regexp_replace(trim(model), '\\[[^\\]]*\\]$', '')), '-[0-9]{8}$', '') AS plain_model FROM usage_record",
        "drill_project": _effectiveness("tool", where="project = (SELECT project FROM cube WHERE project <> '' GROUP BY project ORDER BY sum(lines_added) DESC, project LIMIT 1)"),
    }
    for by in ("skill", "agent"):
        out[f"attribution_{by}"] = f"SELECT {by} AS name, sum({TOKENS})::bigint AS tokens, sum(lines_added)::bigint AS lines_added, count(*) AS n_records, count(DISTINCT session_id) AS n_sessions FROM u WHERE {by} <> '' GROUP BY 1"
    for by in ("project", "tool", "model", "entrypoint"):
        out[f"report_by_{by}"] = _report("cube", by)
    for by in ("task", "outcome", "difficulty"):
        out[f"report_by_{by}"] = _report("cubel", by)
    for by in ("project", "tool", "model", "entrypoint", "day"):
        out[f"effectiveness_by_{by}"] = _effectiveness(by)
    for by in ("model", "project"):
        out[f"totals_by_{by}"] = f"SELECT {by} AS name, sum(tokens)::bigint AS tokens, sum(lines_added)::bigint AS lines_added, round(sum(cost), 9) AS cost, round(sum(tokens) / cast((SELECT sum(tokens) FROM cube) as double), 6) AS token_share FROM cube GROUP BY 1"
    return {k: PRELUDE + v for k, v in out.items()}


__all__ = ["NOW", "PRELUDE", "core"]
