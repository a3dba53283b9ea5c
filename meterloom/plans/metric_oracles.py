"""SQL of the metrics and step sequences for a second engine."""

from __future__ import annotations

from meterloom.operators.metrics import MONEY
from meterloom.plans.bridge import NOW, PRIOR, RECENT, SINCE
from meterloom.plans.oracles import ACTIVITY, LINE, PRELUDE, REWORK, TOKENS, can

SEQUENCES = """, scoped0 AS (SELECT s.*, coalesce(x.project, '') AS project,
    CASE WHEN timeline <> '' THEN 'subagent' WHEN entrypoint = 'cli' THEN 'interactive' WHEN entrypoint IN ('sdk-py', 'sdk-cli') THEN 'programmatic' ELSE 'unstated' END AS scope,
    row_number() OVER (PARTITION BY session_id, member, timeline ORDER BY ordinal, dedupe_key) AS pos
    FROM (SELECT * FROM session_step) s LEFT JOIN (SELECT session_id, member, entrypoint, project FROM sessions) x USING (session_id, member)),
  inter AS (SELECT * FROM scoped0 WHERE scope = 'interactive'),
  cmd AS (SELECT *, sum((kind = 'command')::int) OVER (PARTITION BY session_id, member, timeline ORDER BY pos) AS commands FROM inter),
  lagged AS (SELECT *, lag(commands) OVER (PARTITION BY session_id, member, timeline, kind, target_ref ORDER BY pos) AS before FROM cmd),
  repeats AS (SELECT session_id, member, timeline, project, sum((kind = 'edit' AND target_ref > 0)::int)::bigint AS edits,
    sum((kind = 'edit' AND target_ref > 0 AND commands > coalesce(before, commands))::int)::bigint AS repeats, sum((kind = 'edit' AND target_ref = 0)::int)::bigint AS untargeted FROM lagged GROUP BY ALL),
  judged AS (SELECT *, repeats / cast(edits as double) AS rate FROM repeats WHERE edits >= 10),
  jm AS (SELECT count(*) AS n, quantile_cont(rate, 0.5) AS median FROM judged),
  js AS (SELECT max(n) AS n, max(median) AS median, CASE WHEN quantile_cont(abs(rate - median), 0.5) > 0 THEN quantile_cont(abs(rate - median), 0.5) / 0.6745 ELSE avg(abs(rate - median)) * 1.253314 END AS sigma, max((edits - 1) / cast(edits as double)) AS reachable FROM judged, jm),
  line AS (SELECT *, median + 3.5 * sigma AS floor, n >= 7 AND sigma > 0 AS can FROM js),
  loops AS (SELECT w.*, l.n AS judged, round(l.floor, 6) AS floor, (can AND floor < reachable)::int AS spread, (can AND floor >= reachable)::int AS unreachable,
    (SELECT count(*) FROM judged, line WHERE can AND line.floor < reachable AND rate > line.floor) AS outliers, (SELECT coalesce(sum(edits), 0)::bigint FROM judged, line WHERE can AND line.floor < reachable AND rate > line.floor) AS outlier_edits,
    round(w.repeats / cast(w.edits as double), 6) AS repeat_rate
    FROM (SELECT sum(edits)::bigint AS edits, sum(repeats)::bigint AS repeats, sum(untargeted)::bigint AS untargeted, sum((edits < 10 AND edits + untargeted > 0)::int)::bigint AS thin FROM repeats) w, line l),
  aft AS (SELECT *, outcome IN ('error', 'denied') AND kind <> 'compaction' AS failed, max(CASE WHEN outcome IN ('error', 'denied') OR kind = 'compaction' THEN pos END) OVER (PARTITION BY session_id, member, timeline ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
    max((kind = 'compaction')::int) OVER (PARTITION BY session_id, member, timeline ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost FROM inter),
  aftermath AS (SELECT *, round(after_tokens / cast(after_turns as double) / (tokens / cast(turns as double)), 6) AS cost_ratio FROM (SELECT count(*) AS n_steps, sum((kind = 'assistant')::int)::bigint AS turns, sum(CASE WHEN kind = 'assistant' THEN tokens ELSE 0 END)::bigint AS tokens,
    sum((kind = 'assistant' AND coalesce(pos - lf <= 10, false))::int)::bigint AS after_turns, sum(CASE WHEN kind = 'assistant' AND pos - lf <= 10 THEN tokens ELSE 0 END)::bigint AS after_tokens,
    sum(failed::int)::bigint AS failures, sum((kind = 'compaction')::int)::bigint AS compactions, sum(coalesce(lost, 0))::bigint AS steps_after_compaction FROM aft)),
  lasts AS (SELECT arg_max(ts, pos) AS ts, arg_max(outcome, pos) AS outcome FROM inter GROUP BY session_id, member, timeline),
  endings AS (SELECT count(*) AS n_sequences, coalesce(sum((epoch(ts) >= e - 3600)::int), 0)::bigint AS open, coalesce(sum((epoch(ts) < e - 3600 AND outcome IN ('error', 'denied'))::int), 0)::bigint AS abandoned FROM lasts, (SELECT max(epoch(ts)) AS e FROM session_step))
"""

WITH = f"""{PRELUDE.rstrip()}{SEQUENCES},
  days AS (SELECT count(DISTINCT day) AS days FROM cube),
  total AS (SELECT cast(sum(tokens) as double) AS all_tokens FROM cube),
  trend AS (SELECT *, CASE WHEN prior_lines > 0 THEN (recent_lines - prior_lines) / cast(prior_lines as double) END AS wow FROM (SELECT sum(CASE WHEN day >= '{RECENT}' THEN lines_added ELSE 0 END)::bigint AS recent_lines, sum(CASE WHEN day >= '{PRIOR}' AND day < '{RECENT}' THEN lines_added ELSE 0 END)::bigint AS prior_lines FROM cube)),
  shares AS (SELECT sum(CASE WHEN tool IN {ACTIVITY} THEN tokens ELSE 0 END) / cast(sum(tokens) as double) AS activity_share, sum(CASE WHEN cost IS NOT NULL THEN tokens ELSE 0 END) / cast(sum(tokens) as double) AS priced_share, sum(CASE WHEN granularity = 'turn' THEN tokens ELSE 0 END) / cast(sum(tokens) as double) AS turn_share FROM cube),
  tiers AS (SELECT *, CASE WHEN p_out IS NULL THEN 'unpriced' WHEN p_out >= 2e-5 THEN 'premium' ELSE 'cheaper' END AS tier FROM cube)
"""
CLASS = "(tool_reads + tool_searches + tool_commands + tool_writes + tool_other)"


def _sh(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / cast({b} as double) END)"


def _verdict(inner: str, known: str, good: str, purity: str, samples: str, covering: str, figures: list[str]) -> str:
    """Figures that start with '~' are doubles and rounded."""
    shown = ", ".join(f"round({f[1:]}, {9 if f[1:] in MONEY else 6}) AS {f[1:]}" if f[0] == "~" else f for f in figures)
    return f"""SELECT {shown}, CASE WHEN NOT coalesce({known}, false) THEN 'neutral' WHEN {good} THEN 'good' ELSE 'watch' END AS read,
      round(CASE WHEN coalesce({known}, false) THEN least(greatest({purity}, 0.0), 1.0) ELSE 0.5 END, 6) AS purity, cast({samples} as bigint) AS samples, round({covering}, 6) AS covering FROM ({inner})"""


TREND_PURITY = "coalesce(least(greatest(0.5 + wow / 2, 0.0), 1.0), 0.5)"


def _i(*names: str) -> str:
    return ", ".join(f"coalesce(sum({n}), 0)::bigint AS {n.split('.')[-1]}" for n in names)


def _p(name: str, cond: str, of: str = "tokens") -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN {of} ELSE 0 END), 0)::bigint AS {name}"


def metrics() -> dict[str, str]:
    med = lambda c, p, who, name: f"quantile_cont({c}, {p}) FILTER (WHERE {who}) AS {name}"
    count = lambda c, name: f"coalesce(sum(({c})::int), 0)::bigint AS {name}"
    hour, weekend = "hour(first_ts)", "dayofweek(first_ts) IN (0, 6)"
    paced = f"tool IN {can('active_minutes')}"
    own = f"tool IN {can('edits')}"
    turned = f"({own} AND tool IN {can('turns')})"
    comp = f"tool IN {can('compactions')}"
    out = {
        "adoption": _verdict(f"SELECT *, {_sh('n_sessions', 'days')} AS sessions_per_day FROM (SELECT count(*) AS n_sessions FROM sessions), days, (SELECT count(DISTINCT CASE WHEN project <> '' THEN project END) AS projects FROM cube), (SELECT count(*) AS dormant_projects FROM (SELECT DISTINCT project FROM cube WHERE project <> '' AND day < '{RECENT}' EXCEPT SELECT project FROM cube WHERE day >= '{RECENT}')), (SELECT count(*) AS dormant_tools FROM (SELECT DISTINCT tool FROM cube WHERE day < '{RECENT}' EXCEPT SELECT tool FROM cube WHERE day >= '{RECENT}')), trend", "n_sessions > 0", "coalesce(wow, 0.0) > 0 OR (projects > 1 AND n_sessions >= 3)", f"(least(greatest(projects / 5.0, 0.0), 1.0) + {TREND_PURITY}) / 2", "days", "1.0", ["n_sessions", "days", "projects", "dormant_projects", "dormant_tools", "recent_lines", "prior_lines", "~wow", "~sessions_per_day"]),
        "burn_anomaly": _verdict("SELECT s.days, s.median::bigint AS median_tokens, s.sigma, (SELECT count(*) FROM (SELECT day, sum(tokens) AS t FROM cube GROUP BY day) d WHERE s.sigma > 0 AND (d.t - s.median) / s.sigma > 3.5) AS spikes FROM (SELECT max(n) AS days, max(median) AS median, CASE WHEN quantile_cont(abs(t - median), 0.5) > 0 THEN quantile_cont(abs(t - median), 0.5) / 0.6745 ELSE avg(abs(t - median)) * 1.253314 END AS sigma FROM (SELECT day, cast(sum(tokens) as double) AS t FROM cube GROUP BY day), (SELECT count(*) AS n, floor(quantile_cont(t, 0.5)) AS median FROM (SELECT day, cast(sum(tokens) as double) AS t FROM cube GROUP BY day))) s", "days >= 7", "spikes = 0", f"1 - {_sh('spikes', 'days')}", "days", "1.0", ["days", "median_tokens", "~sigma", "spikes"]),
        "cache_hygiene": _verdict(f"SELECT *, {_sh('cache_read', '(cache_read + fresh)')} AS reuse, {_sh('hour_writes', 'writes')} AS hour_share, coalesce((SELECT cache_miss_reason FROM u WHERE cache_miss_reason <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), '') AS top_miss FROM (SELECT sum(cache_read_tokens)::bigint AS cache_read, sum(input_tokens)::bigint AS fresh, {_p('hour_writes', 'tool IN ' + can('cache_write_1h'), 'cache_write_1h')}, {_p('writes', 'tool IN ' + can('cache_write_1h'), 'cache_write_tokens')} FROM cube), days", "cache_read + fresh > 0", "reuse >= 0.5", "reuse", "days", "1.0", ["cache_read", "fresh", "hour_writes", "writes", "days", "~reuse", "~hour_share", "top_miss"]),
        "concentration": _verdict(f"SELECT count(*) AS projects, max(share) AS top1, sum(CASE WHEN rank > n - 3 THEN share END) AS top3, 2 * sum(rank * share) / (max(n) * sum(share)) - (max(n) + 1) / cast(max(n) as double) AS gini, max(CASE WHEN share >= 0.05 AND line_tokens > 0 THEN gap END) AS gap FROM (SELECT *, share - {_sh('lines', 'all_lines')} AS gap FROM (SELECT p.*, sum(tokens) OVER () AS all_tokens, sum(lines) OVER () AS all_lines, count(*) OVER () AS n, row_number() OVER (ORDER BY tokens, project) AS rank, tokens / cast(sum(tokens) OVER () as double) AS share FROM (SELECT project, sum(tokens)::bigint AS tokens, sum(lines_added)::bigint AS lines, {_p('line_tokens', 'tool IN ' + LINE)} FROM cube WHERE project <> '' GROUP BY project) p))", "projects >= 2 AND gap IS NOT NULL", "gap <= 0.2", "1 - gap", "projects", "1.0", ["projects", "~top1", "~top3", "~gini", "~gap"]),
        "context": _verdict(f"SELECT count(*) AS n_sessions, {count(comp, 'capable')}, cast(round(quantile_cont(turns, 0.5) FILTER (WHERE tool IN {can('turns')})) as bigint) AS median_turns, cast(round(quantile_cont(peak_context, 0.5) FILTER (WHERE tool IN {can('turns')})) as bigint) AS median_peak_context, {med('active_minutes', 0.5, paced, 'median_active_minutes')}, round(coalesce(avg((compactions > 0)::int) FILTER (WHERE {comp}), 0.0), 6) AS compaction_rate, coalesce(avg((edits > 0)::int) FILTER (WHERE {own}), 0.0) AS code_share, {med('active_minutes', 0.5, f'{own} AND {paced} AND edits > 0', 'code_active_minutes')} FROM sessions", "capable >= 3", "compaction_rate <= 0.2", "1 - compaction_rate", "capable", _sh("capable", "n_sessions"), ["n_sessions", "capable", "median_turns", "median_peak_context", "~median_active_minutes", "~compaction_rate", "~code_share", "~code_active_minutes"]),
        "coverage": _verdict("SELECT round(activity_share, 6) AS activity_share, round(priced_share, 6) AS priced_share, round(turn_share, 6) AS turn_share, days, 1 - round(activity_share, 6) AS cost_only_share FROM shares, days", "days > 0", "activity_share >= 0.8 AND priced_share >= 0.8", "least(activity_share, priced_share)", "days", "1.0", ["~activity_share", "~priced_share", "~turn_share", "days", "~cost_only_share"]),
        "edit_loops": _verdict("SELECT * FROM loops", "spread = 1", "outliers = 0", f"1 - {_sh('outlier_edits', 'edits')}", "judged", "1.0", ["edits", "repeats", "untargeted", "thin", "judged", "~floor", "spread", "unreachable", "outliers", "outlier_edits", "~repeat_rate"]),
        "explore_produce": _verdict(f"SELECT *, {_sh('writes', 'classified')} AS produce, {_sh('looks', 'classified')} AS explore, CASE WHEN writes > 0 THEN looks / cast(writes as double) END AS looks_per_write FROM (SELECT coalesce(sum{CLASS}, 0)::bigint AS classified, coalesce(sum(tool_calls), 0)::bigint AS calls, coalesce(sum(tool_writes), 0)::bigint AS writes, coalesce(sum(tool_reads + tool_searches), 0)::bigint AS looks FROM cube WHERE tool IN {can('tool_calls')})", "classified >= 50", "produce >= 0.05", "produce / 0.25", "classified", _sh("classified", "calls"), ["classified", "calls", "writes", "looks", "~produce", "~explore", "~looks_per_write"]),
        "friction": _verdict(f"SELECT *, {_sh('errors', 'observed')} AS error_rate, {_sh('rejected', 'refusable')} AS rejection_rate FROM (SELECT {_p('observed', f'tool IN {can("tool_errors")} AND {CLASS} > 0', 'tool_calls')}, {_p('errors', f'tool IN {can("tool_errors")} AND {CLASS} > 0', 'tool_errors')}, {_p('calls', f'tool IN {can("tool_errors")}', 'tool_calls')}, {_p('rejected', f'tool IN {can("rejected")}', 'rejected')}, {_p('refusable', f'tool IN {can("rejected")}', 'tool_calls')} FROM cube)", "observed >= 30 AND errors <= observed", "error_rate <= 0.15", "1 - error_rate / 0.33", "observed", _sh("observed", "calls"), ["observed", "errors", "calls", "rejected", "refusable", "~error_rate", "~rejection_rate"]),
        "intent": _verdict(f"SELECT count(*) AS n_sessions, {count("task <> ''", 'labelled')}, {count("outcome <> ''", 'with_outcome')}, (SELECT count(*) FROM (SELECT task FROM sessions WHERE task <> '' GROUP BY task HAVING count(*) >= 3)) AS classes FROM sessions", "classes >= 2", "true", _sh("labelled", "n_sessions"), "n_sessions", "1.0", ["n_sessions", "labelled", "with_outcome", "classes"]),
        "model_fit": _verdict(f"SELECT *, CASE WHEN premium_cost > cheapest THEN premium_cost - cheapest ELSE 0.0 END AS savings, {_sh('premium_tokens', '(premium_tokens + cheaper_tokens)')} AS premium_share, {_sh('unpriced', 'tokens')} AS unpriced_share, {_sh('premium_lines * 1e6', 'premium_tokens')} AS premium_lines_per_million, {_sh('cheaper_lines * 1e6', 'cheaper_tokens')} AS cheaper_lines_per_million FROM (SELECT {_p('premium_tokens', "tier = 'premium'")}, {_p('cheaper_tokens', "tier = 'cheaper'")}, {_p('unpriced', "tier = 'unpriced'")}, sum(tokens)::bigint AS tokens, {_p('premium_lines', "tier = 'premium'", 'lines_added')}, {_p('cheaper_lines', "tier = 'cheaper'", 'lines_added')}, coalesce(sum(CASE WHEN tier = 'premium' THEN cost END), 0.0) AS premium_cost FROM tiers), days, (SELECT min(m.i * p_in + m.o * p_out + (m.w - least(m.h, m.w)) * p_write + least(m.h, m.w) * p_write_1h + m.r * p_read) AS cheapest FROM prices, (SELECT sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r, sum(cache_write_tokens) AS w, sum(cache_write_1h) AS h FROM tiers WHERE tier = 'premium') m WHERE p_out < 2e-5 AND price_model IN (SELECT model FROM tiers WHERE tier = 'cheaper'))", "tokens > 0", "unpriced_share <= 0.5 AND premium_share <= 0.8", "1 - premium_share", "days", "1.0", ["premium_tokens", "cheaper_tokens", "unpriced", "tokens", "premium_lines", "cheaper_lines", "~premium_cost", "days", "~savings", "~premium_share", "~unpriced_share", "~premium_lines_per_million", "~cheaper_lines_per_million"]),
        "model_right_sizing": _verdict(f"SELECT *, {_sh('small_turns', 'turns')} AS small_share FROM (SELECT coalesce(sum((output_tokens > 0)::int), 0)::bigint AS turns, coalesce(sum((output_tokens > 0 AND output_tokens < 300)::int), 0)::bigint AS small_turns FROM u WHERE granularity = 'turn' AND model = 'claude-opus-4-5-20251101')", "turns >= 20", "small_share < 0.4", "1 - small_share", "turns", "1.0", ["turns", "small_turns", "~small_share"]),
        "reasoning_share": _verdict(f"SELECT *, {_sh('reasoning', 'output')} AS reasoning_share FROM (SELECT {_p('reasoning', f'tool IN {can("reasoning")}', 'reasoning_tokens')}, {_p('output', f'tool IN {can("reasoning")}', 'output_tokens')}, sum(output_tokens)::bigint AS all_output FROM cube), days", "output > 0", "reasoning_share < 0.3", "1 - reasoning_share", "days", _sh("output", "all_output"), ["reasoning", "output", "all_output", "days", "~reasoning_share"]),
        "recovery": _verdict(f"SELECT *, {_sh('abandoned', '(n_sequences - open)')} AS abandoned_share FROM aftermath, endings", "after_turns >= 30 AND cost_ratio IS NOT NULL", "cost_ratio < 1.5", "1 - (cost_ratio - 1)", "n_sequences", "1.0", ["n_steps", "turns", "tokens", "after_turns", "after_tokens", "failures", "compactions", "steps_after_compaction", "~cost_ratio", "n_sequences", "open", "abandoned", "~abandoned_share"]),
        "rework": _verdict(f"SELECT *, CASE WHEN lines_added > 0 AND rework_lines <= lines_added THEN rework_lines / cast(lines_added as double) END AS churn_rate, CASE WHEN calls > 0 THEN rejected / cast(calls as double) END AS rejection_rate FROM (SELECT {_p('lines_added', f'tool IN {REWORK}', 'lines_added')}, {_p('rework_lines', f'tool IN {REWORK}', 'rework_lines')}, {_p('capable_tokens', f'tool IN {REWORK}')}, {_p('rejected', f'tool IN {can("rejected")}', 'rejected')}, {_p('calls', f'tool IN {can("rejected")}', 'tool_calls')}, sum(tokens)::bigint AS tokens FROM cube), days", "(coalesce(churn_rate, 0) > 0.15 OR coalesce(rejection_rate, 0) > 0.15) OR (churn_rate IS NOT NULL AND rejection_rate IS NOT NULL)", "NOT (coalesce(churn_rate, 0) > 0.15 OR coalesce(rejection_rate, 0) > 0.15)", "1 - coalesce((churn_rate + rejection_rate) / 2, churn_rate, rejection_rate)", "days", _sh("capable_tokens", "tokens"), ["lines_added", "rework_lines", "capable_tokens", "rejected", "calls", "tokens", "days", "~churn_rate", "~rejection_rate"]),
        "rhythm": _verdict(f"SELECT *, {_sh('off', 'timed')} AS off_share, {_sh('weekend', 'timed')} AS weekend_share, {_sh('marathons', 'paced')} AS marathon_share FROM (SELECT count(*) AS timed, {count(paced, 'paced')}, {count(f'{weekend} OR {hour} < 8 OR {hour} >= 18', 'off')}, {count(weekend, 'weekend')}, {count(f'{hour} < 8', 'night')}, {count(f'{hour} >= 8 AND {hour} < 12', 'morning')}, {count(f'{hour} >= 12 AND {hour} < 18', 'afternoon')}, {count(f'{hour} >= 18', 'evening')}, {med('active_minutes', 0.95, paced, 'p95_active')}, {count(f'{paced} AND active_minutes >= 90', 'marathons')} FROM sessions)", "timed >= 5 AND paced >= 5", "off_share <= 0.25 AND marathon_share <= 0.15", "1 - (off_share + marathon_share) / 2", "timed", _sh("paced", "timed"), ["timed", "paced", "off", "weekend", "night", "morning", "afternoon", "evening", "~p95_active", "marathons", "~off_share", "~weekend_share", "~marathon_share"]),
        "session_taxonomy": _verdict(f"SELECT *, {_sh('(light + heavy)', 'capable')} AS editing_share, CASE WHEN conversational * 2 > capable THEN 'chat-led' WHEN (light + heavy) * 2 > capable THEN 'edit-led' ELSE 'mixed' END AS lead FROM (SELECT count(*) AS n_sessions, {count(own, 'capable')}, {count(f'{own} AND edits = 0', 'conversational')}, {count(f'{own} AND edits BETWEEN 1 AND 10', 'light')}, {count(f'{own} AND edits > 10', 'heavy')} FROM sessions)", "capable >= 5", "true", "editing_share", "capable", _sh("capable", "n_sessions"), ["n_sessions", "capable", "conversational", "light", "heavy", "~editing_share", "lead"]),
        "skill_economics": _verdict(f"SELECT m.*, t.tokens FROM (SELECT coalesce(arg_max(top / cast(basis as double), top / cast(basis as double)), 0.0) AS top_share, coalesce(arg_max(kind, top / cast(basis as double)), '') AS kind, coalesce(arg_max(labels, top / cast(basis as double)), 0) AS labels, coalesce(arg_max(basis, top / cast(basis as double)), 0) AS basis FROM (SELECT kind, count(*) AS labels, sum(t)::bigint AS basis, max(t)::bigint AS top FROM (SELECT 'skill' AS kind, skill AS name, sum({TOKENS}) AS t FROM u WHERE skill <> '' GROUP BY skill UNION ALL SELECT 'agent', agent, sum({TOKENS}) FROM u WHERE agent <> '' GROUP BY agent) GROUP BY kind HAVING count(*) >= 2)) m, (SELECT sum(tokens)::bigint AS tokens FROM cube) t", "basis >= 100000", "top_share <= 0.5", "1 - top_share", "labels", _sh("basis", "tokens"), ["~top_share", "kind", "labels", "basis", "tokens"]),
        "subscription_fit": _verdict(f"SELECT *, monthly / 200.0 AS multiple FROM (SELECT *, cost / span_days * 30 AS monthly FROM (SELECT sum(cost) AS cost, count(DISTINCT day) AS days, cast(greatest(date_diff('day', greatest(cast(min(day) as date), DATE '{SINCE[:10]}'), DATE '{NOW[:10]}') + CASE WHEN min(day) > '{SINCE[:10]}' THEN 1 ELSE 0 END, 1) as double) AS span_days FROM cube))", "cost IS NOT NULL", "multiple >= 1", "multiple / 2", "days", "1.0", ["~cost", "days", "~span_days", "~monthly", "~multiple"]),
        "throughput": _verdict(f"SELECT *, {_sh('lines', 'days')} AS lines_per_day FROM (SELECT sum(lines_added)::bigint AS lines, {count('tool IN ' + LINE, 'capable_rows')} FROM cube), days, trend", "capable_rows > 0", "coalesce(wow, 0.0) > 0 AND recent_lines >= 20", TREND_PURITY, "days", "1.0", ["lines", "days", "capable_rows", "recent_lines", "prior_lines", "~wow", "~lines_per_day"]),
        "turn_efficiency": _verdict(f"SELECT *, {_sh('one_shot', 'code_sessions')} AS one_shot_rate FROM (SELECT count(*) AS n_sessions, {count(turned, 'capable')}, {count(turned + ' AND edits > 0', 'code_sessions')}, {count(turned + ' AND edits > 0 AND turns <= 2', 'one_shot')}, {med('turns', 0.5, turned + ' AND edits > 0', 'median_turns')}, {med('output_tokens / cast(turns as double)', 0.5, turned + ' AND turns > 0', 'median_output_per_turn')} FROM sessions)", "code_sessions >= 5", "one_shot_rate >= 0.25", "one_shot_rate", "code_sessions", _sh("capable", "n_sessions"), ["n_sessions", "capable", "code_sessions", "one_shot", "~median_turns", "~median_output_per_turn", "~one_shot_rate"]),
    }
    every = " UNION ALL ".join(f"SELECT '{n}' AS metric, read, cast(purity as double) AS purity, samples, cast(covering as double) AS covering FROM ({q})" for n, q in out.items())
    weakest = "least(covering, round(activity_share, 6), round(priced_share, 6), round(turn_share, 6))"
    verdicts = f"SELECT metric, read, purity, samples, covering, CASE WHEN samples <= 0 OR covering <= 0 THEN 'insufficient' WHEN samples < 3 THEN 'low' WHEN {weakest} >= 0.8 THEN 'high' WHEN {weakest} >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, round({weakest}, 6) AS weakest FROM ({every}), shares"
    found = {f"metric_{n}": q for n, q in out.items()}
    found["confidence_axes"] = verdicts
    found["ranking"] = f"SELECT * FROM ({verdicts}) WHERE read = 'watch' AND confidence IN ('high', 'medium') ORDER BY CASE confidence WHEN 'high' THEN 2 ELSE 1 END DESC, covering DESC, CASE WHEN weakest >= 0.8 THEN 1.0 ELSE weakest END DESC, metric LIMIT 3"
    found["repeat_edits"] = "SELECT * FROM repeats"
    found["edit_loop_outliers"] = "SELECT * FROM loops"
    found["aftermath"] = "SELECT * FROM aftermath"
    found["sequence_endings"] = "SELECT * FROM endings"
    found["sequence_scope"] = "SELECT scope, count(DISTINCT (session_id, member, timeline)) AS n_sequences, count(*) AS n_steps FROM scoped0 GROUP BY scope"
    return {k: WITH + v for k, v in found.items()}
