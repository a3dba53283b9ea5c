"""What turns ordered log lines into facts, and facts into stored facts. All windows are partitioned by file or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.schema import CAPABLE, SUMS

VENDOR = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h", "reasoning_tokens")
ACTIVITY = ("lines_added", "lines_removed", "rework_lines", "edits", "tool_calls", "tool_reads", "tool_searches", "tool_commands", "tool_writes", "tool_other", "tool_errors", "rejected", "compactions")
MARKS = ("sidechain", "skill", "agent", "cache_miss_reason")
FIXED = ("ts", "session_id", "member", "project", "subpath", "git_branch", "entrypoint")


def _listed(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else names


def upto(by: str | list[str], order: str | list[str], last: int = 0):
    return Window.partitionBy(*_listed(by)).orderBy(*_listed(order)).rowsBetween(Window.unboundedPreceding, last)


def dedupe_lines(lines: DataFrame, file: str = "file", uuid: str = "uuid", line: str | list[str] = "line") -> DataFrame:
    """Drops lines whose uuid was seen before in the file; an empty one is never a repeat."""
    return lines.withColumn("_again", repeated(file, uuid, line)).where("NOT _again").drop("_again")


def alone(shared: Column, line: str | list[str]) -> Column:
    """A further key for rows that share nothing: each of them is a group of its own, so that no group holds all of a file's."""
    return F.when(~shared, F.struct(*_listed(line)))


def repeated(file: str = "file", uuid: str = "uuid", line: str | list[str] = "line") -> Column:
    """Whether a line's uuid was seen before in the file; an empty one is never a repeat."""
    named = F.col(uuid) != ""
    return named & (F.row_number().over(Window.partitionBy(file, uuid, alone(named, line)).orderBy(*_listed(line))) > 1)


def carried(rows: DataFrame, narrow: DataFrame, said: dict[str, Column], stretch: list[str], line: list[str], file: str = "file", earlier: DataFrame | None = None) -> DataFrame:
    """Adds to the rows, by name, what ``said`` (null where a row says nothing) said last in their file before their stretch. A file is
    as long as it likes: what each stretch says last is few rows, which alone are put in their file's order. ``narrow`` has the rows
    that are asked, or as many of their columns as ``said`` needs; ``earlier`` (file and the names of ``said``) what was said last in
    files before all of them."""
    place = F.struct(*line)
    last = narrow.groupBy(file, *stretch).agg(*(F.max_by(c, F.when(c.isNotNull(), place)).alias(name) for name, c in said.items()))
    ahead = upto(file, stretch, -1)
    before = last.select(file, *stretch, *(F.last(name, ignorenulls=True).over(ahead).alias(name) for name in said))
    if earlier is not None:
        held = earlier.select(file, *(F.col(name).alias(f"_{name}") for name in said))
        before = before.join(held, file, "left").select(file, *stretch, *(F.coalesce(name, f"_{name}").alias(name) for name in said))
    return rows.join(before.hint("shuffle_hash"), [file, *stretch])


def first_said(value: str, order: str) -> Column:
    """The first non-empty value of a group."""
    return F.coalesce(F.min_by(value, F.when(F.col(value) != "", F.col(order))), F.lit(""))


def merge_responses(lines: DataFrame, keys: list[str], most: list[str], summed: list[str], first: list[str], line: str = "line") -> DataFrame:
    """Lines of one response as one record: vendor counts are repeated and so taken once, activity adds up, names are the first said."""
    return lines.groupBy(*keys).agg(F.min(line).alias(line), *(F.max(c).alias(c) for c in most), *(F.sum(c).alias(c) for c in summed), *(first_said(c, line).alias(c) for c in first))


def carry_forward(lines: DataFrame, columns: list[str], file: str = "file", line: str | list[str] = "line") -> DataFrame:
    """Each column's last non-empty value so far in the file."""
    said = lambda c: F.coalesce(F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(upto(file, line)), F.lit(""))
    return lines.withColumns({c: said(c) for c in columns})


def attach_to_last(lines: DataFrame, is_record: Column, key: str, file: str = "file", line: str | list[str] = "line") -> DataFrame:
    """Adds ``owner``: the key of the last record at or before each line; null before the first."""
    return lines.withColumn("owner", F.last(F.when(is_record, F.col(key)), ignorenulls=True).over(upto(file, line)))


def islands(lines: DataFrame, flag: Column, file: str = "file", line: str = "line") -> DataFrame:
    """Adds ``starts``: true where a run of flagged lines begins, so that consecutive ones count once."""
    order = Window.partitionBy(file).orderBy(line)
    marked = lines.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return marked.withColumn("starts", F.col("_f") & ~F.coalesce(F.lag("_f").over(order), F.lit(False))).drop("_f")


def deltas(lines: DataFrame, counters: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """Cumulative counters as increments: never negative, rows without any growth dropped. The row before counts even where it is dropped."""
    order = Window.partitionBy(file).orderBy(line)
    raw = lines.withColumns({f"d_{c}": F.col(c) - F.lag(c, 1, 0).over(order) for c in counters})
    grown = F.greatest(*(F.col(f"d_{c}") for c in counters)) > 0
    return raw.where(grown).withColumns({f"d_{c}": F.greatest(F.col(f"d_{c}"), F.lit(0)) for c in counters})


def flush_groups(lines: DataFrame, emits: Column, file: str = "file", line: str = "line") -> DataFrame:
    """Adds ``record``: the number of the emitting line that what happened at a line goes to, which is the next one, and for what
    trails, the last. Null in a file that never emits."""
    before = F.coalesce(F.sum(F.when(emits, 1).otherwise(0)).over(upto(file, line, -1)), F.lit(0))
    total = F.sum(F.when(emits, 1).otherwise(0)).over(Window.partitionBy(file))
    return lines.withColumn("record", F.when(total > 0, F.least(before, total - 1)))


def rework(changes: DataFrame, keys: list[str], order: str | list[str], added: str = "added", removed: str = "removed") -> DataFrame:
    """Adds ``rework``: removed lines up to what was added before and not yet undone. The budget is a walk held at zero, whose closed
    form is a running sum less its running minimum."""
    w = Window.partitionBy(*keys).orderBy(*_listed(order))
    run = upto(keys, order)
    step = changes.withColumn("_pa", F.lag(added, 1, 0).over(w))
    walk = step.withColumn("_p", F.sum(F.col("_pa") - F.col(removed)).over(run))
    left = walk.withColumn("_c", F.col("_p") - F.least(F.lit(0), F.min("_p").over(run)))
    return left.withColumn("rework", F.coalesce(F.lag("_c").over(w), F.lit(0)) + F.col("_pa") - F.col("_c")).drop("_pa", "_p", "_c")


def as_of(rows: DataFrame, entries: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the value of the last entry at or before its time, else of the first entry. One pass over both, sorted together:
    no pair of row and entry is ever formed."""
    both = rows.withColumn("_v", F.lit(None).cast("string")).withColumn("_row", F.lit(1)).unionByName(entries.select(key, at, F.col(value).alias("_v")).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_row")
    past = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(past, first)).where("_row = 1").select(*rows.columns, value)


def insert_absent(stored: DataFrame, offered: DataFrame, keys: tuple[str, ...] = ("tool", "dedupe_key")) -> DataFrame:
    """Stored rows and the offered ones whose key is new; of offers with one key, the first by ``seq``."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    fresh = offered.withColumn("_n", best).where("_n = 1").drop("_n")
    return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def restate(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Stored and offered rows (``seq`` tells their order) as one row a key: vendor counts can only grow, derived activity is as last
    derived, marks are kept, and what a row is about never changes; a blank model is filled once."""
    rows = stored.unionByName(offered, allowMissingColumns=True)
    named = F.when(F.col("model") != "", F.col("seq"))
    have = set(rows.columns)
    pick = lambda f, names: [f(c).alias(c) for c in names if c in have]
    return rows.groupBy("tool", "dedupe_key").agg(*pick(F.max, VENDOR), *pick(lambda c: F.max_by(c, "seq"), (*ACTIVITY, "granularity")), *pick(F.max, MARKS), *pick(lambda c: F.min_by(c, "seq"), FIXED), F.coalesce(F.min_by("model", named), F.lit("")).alias("model"))


def upsert_steps(stored: DataFrame, offered: DataFrame, kinds: tuple[str, ...], outcomes: tuple[str, ...]) -> DataFrame:
    """Steps by (tool, timeline, dedupe_key): the last offer decides outcome, target, tokens and place; unknown kinds are refused."""
    sound = offered.where(F.col("kind").isin(*kinds) & F.col("outcome").isin(*outcomes))
    rows = stored.unionByName(sound)
    return rows.groupBy("tool", "timeline", "dedupe_key").agg(*(F.max_by(c, "seq").alias(c) for c in ("outcome", "target_ref", "tokens", "ordinal")), *(F.min_by(c, "seq").alias(c) for c in ("session_id", "member", "ts", "kind")))


def superseded(records: DataFrame, covered: DataFrame) -> DataFrame:
    """Records without the sub-agent aggregates whose own transcript was read."""
    agent = F.when(F.col("dedupe_key").startswith("agent:"), F.substring("dedupe_key", 7, 1 << 20))
    return records.withColumn("_a", agent).join(covered.select(F.col("agent_id").alias("_a")), "_a", "left_anti").drop("_a")


def within_horizon(steps: DataFrame, now: str, days: int) -> DataFrame:
    return steps if days == 0 else steps.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def changed_inputs(found: DataFrame, state: DataFrame) -> DataFrame:
    """Inputs that the same build has not read as they are now."""
    return found.join(state, ["path", "size", "mtime", "version"], "left_anti")


def vanished(state: DataFrame, found: DataFrame) -> DataFrame:
    return state.join(found.select("path"), "path", "left_anti")


def clear(records: DataFrame, before: str = "", tool: str = "") -> DataFrame:
    """What stays after records before a time, of a tool, are cleared."""
    gone = F.lit(True)
    if before:
        gone &= F.col("ts") < F.lit(before).cast("timestamp_ntz")
    if tool:
        gone &= F.col("tool") == tool
    return records.where(~gone)


def clear_labels(labels: DataFrame, records: DataFrame, kept: DataFrame) -> DataFrame:
    """Labels but for those of sessions that lost records and have none left."""
    key = ["session_id", "member"]
    lost = records.select(*key).distinct().join(kept.select(*key).distinct(), key, "left_anti")
    return labels.join(lost, key, "left_anti")


def keep_newest(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


MOST = 1_000_000_000  # of a count
LONGEST = 512  # bytes of a name
NAMES = ("tool", "session_id", "model", "dedupe_key", "project", "subpath", "git_branch", "entrypoint", "skill", "agent")
PURPOSES = ("tool_reads", "tool_searches", "tool_commands", "tool_writes", "tool_other")


def reject_reason(now: str) -> Column:
    """Why a pushed record is refused; null if it is sound. The first reason stands. Who pushed it is no matter here: the member is
    set by the receiver."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    known = tuple(t for t in CAPABLE if t != "plugin")
    counts = [*(F.col(c) for c in SUMS), F.col("sidechain")]
    purposes = sum((F.col(c) for c in PURPOSES[1:]), F.col(PURPOSES[0]))
    return (
        F.when(F.col("dedupe_key") == "", "dedupe_key")
        .when(F.greatest(*(F.octet_length(c) for c in NAMES)) > LONGEST, "length")
        .when(~F.col("cache_miss_reason").rlike(r"^[a-z0-9_]{0,64}\z"), "cache_miss_reason")
        .when(~F.col("tool").isin(*known) & ~F.col("tool").rlike(r"^plugin:[a-z0-9-]+\z"), "tool")
        .when(~F.col("granularity").isin("turn", "session"), "granularity")
        .when((F.col("ts") < at("2020-01-01 00:00:00")) | (F.col("ts") > at(now) + F.expr("interval 48 hours")), "timestamp")
        .when(F.least(*counts) < 0, "count")
        .when(F.greatest(*counts) > MOST, "count")
        .when(F.col("cache_write_1h") > F.col("cache_write_tokens"), "cache_write_1h")
        .when(F.col("reasoning_tokens") > F.col("output_tokens"), "reasoning")
        .when(~F.col("sidechain").isin(0, 1), "sidechain")
        .when((purposes != 0) & (purposes != F.col("tool_calls")), "purposes")
    )


SIGNALS = (*PURPOSES, "tool_errors", "sidechain", "skill", "agent")


def restate_signals(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Stored rows that lack every signal, as written by a build that did not read them, with those of the first offer (by ``seq``) of
    their (tool, dedupe_key) that has any. Nothing else changes, and nothing is inserted."""
    blank = F.lit(True)
    for c in SIGNALS:
        blank &= F.col(c) == ("" if c in ("skill", "agent") else 0)
    key = ["tool", "dedupe_key"]
    said = offered.where(~blank).groupBy(*key).agg(F.min_by(F.struct(*SIGNALS), "seq").alias("_said"))
    joined = stored.join(said, key, "left").withColumn("_fill", blank & F.col("_said").isNotNull())
    return joined.withColumns({c: F.when(F.col("_fill"), F.col(f"_said.{c}")).otherwise(F.col(c)) for c in SIGNALS}).select(*stored.columns)


def canaries(runs: DataFrame) -> DataFrame:
    """tool, canary of each tool's newest run, judged against the nine before: runs (tool, seq, discovered, parsed, records, skipped, zero_tokens)."""
    numbered = runs.withColumn("n", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("seq")))).where("n <= 10")
    old = F.col("n") > 1
    ratio = F.when(old & (F.col("parsed") > 0), F.col("records") / F.col("parsed"))
    now = lambda c: F.max(F.when(~old, F.col(c))).alias(c)
    row = numbered.groupBy("tool").agg(*(now(c) for c in ("discovered", "parsed", "records", "skipped", "zero_tokens")), F.percentile(F.when(old, F.col("discovered")), 0.5).alias("usual"), F.percentile(ratio, 0.5).alias("usual_yield"), F.coalesce(F.max(F.when(old, F.col("records"))), F.lit(0)).alias("ever"))
    tests = {
        "discovery": (F.col("usual") > 0) & ((F.col("discovered") == 0) | ((F.col("usual") >= 20) & (F.col("discovered") < 0.5 * F.col("usual")))),
        "barren": (F.col("discovered") > 0) & (F.col("records") == 0) & (F.col("ever") == 0),
        "yield": (F.col("parsed") >= 20) & (F.col("records") / F.greatest("parsed", F.lit(1)) < 0.25 * F.col("usual_yield")),
        "skipped": (F.col("skipped") >= 50) & (F.col("skipped") >= F.col("parsed")),
        "zero_token": (F.col("records") >= 50) & (F.col("zero_tokens") >= 0.25 * F.col("records")),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return row.select("tool", F.explode(found).alias("canary"))
