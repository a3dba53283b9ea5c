"""Vocabularies and the capability matrix: which tool records which signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

DIMS = ("day", "tool", "model", "project", "entrypoint", "member", "granularity")
SUMS = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h", "reasoning_tokens",
    "lines_added", "lines_removed", "edits", "tool_calls", "rejected", "compactions", "rework_lines",
    "tool_reads", "tool_searches", "tool_commands", "tool_writes", "tool_other", "tool_errors",
)

#: Groups of signals and the tools that record them.
SIGNAL_GROUPS = {
    "cost": ("tokens_total", "tokens_input", "tokens_output", "cache_read", "cost", "sessions"),
    "cache_write": ("cache_write",),
    "reasoning": ("reasoning",),
    "cache_detail": ("cache_write_1h", "cache_miss_reason"),
    "turns": ("turns", "active_minutes"),
    "lines": ("lines_added", "lines_removed"),
    "edits": ("edits", "tool_calls", "rework_lines"),
    "compactions": ("compactions",),
    "steps": ("steps", "step_outcome", "step_target"),
    "friction": ("tool_errors", "rejected", "skill", "agent"),
}
#: Fixed values.
CAPABLE = {
    "claude-code": ("cost", "cache_write", "cache_detail", "turns", "lines", "edits", "compactions", "steps", "friction"),
    "codex": ("cost", "reasoning", "turns", "lines", "edits", "compactions"),
    "gemini-cli": ("cost", "reasoning", "turns"),
    "copilot-cli": ("cost", "cache_write", "reasoning", "lines"),
    "cline": ("cost", "cache_write", "turns"),
    "plugin": ("cost", "reasoning"),
}
#: Closed vocabularies.
STEP_KINDS = ("assistant", "read", "search", "command", "edit", "other", "compaction")
STEP_OUTCOMES = ("", "ok", "error", "denied", "truncated")

CAPABILITY = [(tool, signal) for tool, groups in CAPABLE.items() for g in groups for signal in SIGNAL_GROUPS[g]]

USAGE = StructType(
    [StructField(c, StringType()) for c in ("tool", "session_id", "member", "project", "subpath", "model", "entrypoint", "granularity")]
    + [StructField("ts", TimestampNTZType()), StructField("dedupe_key", StringType())]
    + [StructField(c, LongType()) for c in (*SUMS, "sidechain")]
    + [StructField(c, StringType()) for c in ("agent", "skill", "cache_miss_reason", "git_branch")]
)


def answering(*signals: str) -> list[str]:
    """The tools that record every one of the signals; a plugin answers for its own group."""
    return [t for t in CAPABLE if all((t, s) in set(CAPABILITY) for s in signals)]


def capability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITY, "tool string, signal string")
