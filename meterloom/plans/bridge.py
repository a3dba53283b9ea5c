"""The engine's fact tables made from the ``events`` table by one SQL text that Spark and a second engine both accept.

Divisions are written as floors of doubles, because integer division differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"
SINCE = "2024-01-01 00:00:00"
RECENT = "2024-01-25"  # first day of the last seven, today included
PRIOR = "2024-01-18"

SPARK = {"second": "cast(date_trunc('second', ts) as timestamp_ntz)", "day": "date_format(ts, 'yyyy-MM-dd')"}
OTHER = {"second": "date_trunc('second', ts)", "day": "strftime(ts, '%Y-%m-%d')"}

EVENTS = """
SELECT event_id AS e, event_type AS k, cast(round(value * 100) as bigint) AS v, {second} AS ts, {day} AS day,
       cast(floor(event_id / 100) as bigint) * 5 + event_id % 5 AS s
FROM {events}"""

FACTS = """
SELECT e, k, v, ts, day, s,
       CASE WHEN s % 10 <= 4 THEN 'claude-code' WHEN s % 10 <= 6 THEN 'codex' WHEN s % 10 = 7 THEN 'gemini-cli' WHEN s % 10 = 8 THEN 'copilot-cli'
            WHEN day < '2024-01-23' THEN 'cline' ELSE 'claude-code' END AS tool,
       CASE (e * 13) % 6 WHEN 0 THEN 'claude-opus-4-5-20251101' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'claude-haiku-4-5' WHEN 3 THEN 'gpt-5.1' WHEN 4 THEN 'gemini-2.5-pro' ELSE 'acme-llm-v2' END AS model,
       CASE WHEN (s * 7 + 3) % 6 = 0 OR ((s * 7 + 3) % 6 = 5 AND day >= '2024-01-22') THEN '' ELSE 'proj-' || cast((s * 7 + 3) % 6 as string) END AS project
FROM ({base}) b"""

USAGE = """
SELECT tool, 's' || cast(s as string) AS session_id, CASE WHEN s % 7 = 0 THEN 'alice' ELSE '' END AS member, project,
       CASE WHEN project = '' OR e % 3 = 0 THEN '' WHEN e % 3 = 1 THEN 'apps/a' ELSE 'apps/b' END AS subpath,
       model, CASE s % 4 WHEN 2 THEN '' WHEN 3 THEN 'sdk-py' ELSE 'cli' END AS entrypoint,
       CASE WHEN tool = 'copilot-cli' THEN 'session' ELSE 'turn' END AS granularity, ts, day, 'e' || cast(e as string) AS dedupe_key,
       3 * v + 100 AS input_tokens, cast(floor(v / 10) as bigint) + 20 AS output_tokens, 20 * v AS cache_read_tokens,
       CASE WHEN tool IN ('claude-code', 'copilot-cli', 'cline') THEN v ELSE 0 END AS cache_write_tokens,
       CASE WHEN tool = 'claude-code' THEN cast(floor(v / 4) as bigint) ELSE 0 END AS cache_write_1h,
       CASE WHEN tool IN ('codex', 'gemini-cli', 'copilot-cli') THEN cast(floor((cast(floor(v / 10) as bigint) + 20) / 3) as bigint) ELSE 0 END AS reasoning_tokens,
       CASE WHEN k = 'purchase' AND tool IN ('claude-code', 'codex', 'copilot-cli') THEN v % 40 + 1 ELSE 0 END AS lines_added,
       CASE WHEN k = 'purchase' AND tool IN ('claude-code', 'codex') THEN least(v % 4, v % 40 + 1) ELSE 0 END AS lines_removed,
       CASE WHEN k = 'purchase' AND tool IN ('claude-code', 'codex') THEN least(v % 4, v % 40 + 1) ELSE 0 END AS rework_lines,
       CASE WHEN k = 'purchase' AND tool IN ('claude-code', 'codex') THEN 1 ELSE 0 END AS edits,
       CASE WHEN tool NOT IN ('claude-code', 'codex') THEN 0 WHEN k = 'view' THEN 3 WHEN k = 'purchase' THEN 2 ELSE 1 END AS tool_calls,
       CASE WHEN tool IN ('claude-code', 'codex') AND k = 'view' THEN 2 ELSE 0 END AS tool_reads,
       CASE WHEN tool IN ('claude-code', 'codex') AND k = 'view' THEN 1 ELSE 0 END AS tool_searches,
       CASE WHEN tool IN ('claude-code', 'codex') AND k IN ('click', 'purchase', 'error') THEN 1 ELSE 0 END AS tool_commands,
       CASE WHEN tool IN ('claude-code', 'codex') AND k = 'purchase' THEN 1 ELSE 0 END AS tool_writes,
       CASE WHEN tool IN ('claude-code', 'codex') AND k = 'signup' THEN 1 ELSE 0 END AS tool_other,
       CASE WHEN tool = 'claude-code' AND k = 'error' THEN 1 ELSE 0 END AS tool_errors,
       CASE WHEN tool = 'claude-code' AND v % 17 = 0 THEN 1 ELSE 0 END AS rejected,
       CASE WHEN tool IN ('claude-code', 'codex') AND v % 101 = 0 THEN 1 ELSE 0 END AS compactions,
       CASE WHEN tool = 'claude-code' AND s % 9 = 0 THEN 1 ELSE 0 END AS sidechain,
       CASE WHEN tool = 'claude-code' AND s % 9 = 0 THEN CASE WHEN e % 2 = 0 THEN 'explore' ELSE 'general-purpose' END ELSE '' END AS agent,
       CASE WHEN tool <> 'claude-code' OR e % 4 >= 2 THEN '' WHEN e % 4 = 0 THEN 'review' ELSE 'docs' END AS skill,
       CASE WHEN tool <> 'claude-code' OR v % 19 <> 0 THEN '' WHEN e % 2 = 0 THEN 'system_changed' ELSE 'tools_changed' END AS cache_miss_reason,
       CASE s % 5 WHEN 0 THEN 'feat/x' WHEN 1 THEN 'fix/y' WHEN 2 THEN 'main' WHEN 3 THEN 'docs/z' ELSE '' END AS git_branch
FROM ({facts}) f"""

STEPS = """
SELECT tool, session_id, member, timeline, ordinal, dedupe_key, ts, kind, outcome, target_ref, tokens FROM (
  SELECT tool, 's' || cast(s as string) AS session_id, CASE WHEN s % 7 = 0 THEN 'alice' ELSE '' END AS member,
         CASE WHEN e % 23 = 0 THEN 'sub1' ELSE '' END AS timeline, 2 * (cast(floor((e % 100) / 5) as bigint) + 1) - 1 AS ordinal,
         'a' || cast(e as string) AS dedupe_key, ts, 'assistant' AS kind, CASE WHEN v % 13 = 0 THEN 'truncated' ELSE '' END AS outcome,
         cast(0 as bigint) AS target_ref, 24 * v + 220 AS tokens
  FROM ({facts}) f WHERE tool = 'claude-code'
  UNION ALL
  SELECT tool, 's' || cast(s as string), CASE WHEN s % 7 = 0 THEN 'alice' ELSE '' END, CASE WHEN e % 23 = 0 THEN 'sub1' ELSE '' END,
         2 * (cast(floor((e % 100) / 5) as bigint) + 1), 'c' || cast(e as string), ts,
         CASE k WHEN 'view' THEN 'read' WHEN 'click' THEN 'command' WHEN 'error' THEN 'command' ELSE 'edit' END,
         CASE WHEN k = 'error' THEN CASE WHEN v % 5 = 0 THEN 'denied' ELSE 'error' END ELSE 'ok' END,
         CASE WHEN k IN ('purchase', 'signup') THEN v % 4 ELSE 0 END, cast(0 as bigint)
  FROM ({facts}) f WHERE tool = 'claude-code') u"""

LABELS = """
SELECT 's' || cast(s as string) AS session_id, CASE WHEN s % 7 = 0 THEN 'alice' ELSE '' END AS member,
       CASE s % 4 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' WHEN 2 THEN 'refactor' ELSE 'docs' END AS task,
       CASE WHEN s % 6 = 0 THEN 'done' ELSE '' END AS outcome, CASE WHEN s % 9 = 0 THEN 'high' ELSE '' END AS difficulty
FROM (SELECT DISTINCT s FROM ({base}) b WHERE s % 3 = 0) d"""

#: Dollars a token for input, output, cache write, one-hour cache write, cache read. One model has no price on purpose.
PRICES = [
    ("claude-opus-4-5", 5e-6, 2.5e-5, 6.25e-6, 1e-5, 5e-7),
    ("claude-sonnet-4-5", 3e-6, 1.5e-5, 3.75e-6, 6e-6, 3e-7),
    ("claude-haiku-4-5", 1e-6, 5e-6, 1.25e-6, 1.25e-6, 1e-7),
    ("gpt-5.1", 1.25e-6, 1e-5, 0.0, 0.0, 1.25e-7),
    ("gemini-2.5-pro", 1.25e-6, 1e-5, 0.0, 0.0, 3e-7),
]
PRICE_COLUMNS = ("price_model", "p_in", "p_out", "p_write", "p_write_1h", "p_read")


def _text(name: str, events: str, dialect: dict[str, str]) -> str:
    base = EVENTS.format(events=events, **dialect)
    facts = FACTS.format(base=base)
    return {"event_lines": "{base}", "usage_record": USAGE, "session_step": STEPS, "session_label": LABELS}[name].format(facts=facts, base=base)


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``usage_record``, ``session_step``, ``session_label`` or the bare ``event_lines`` of the events in ``sf_dir``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_text(name, "{events}", SPARK), events=events)


def oracle_facts() -> dict[str, str]:
    """The same tables as SQL for the second engine."""
    return {n: _text(n, "events", OTHER) for n in ("event_lines", "usage_record", "session_step", "session_label")}
