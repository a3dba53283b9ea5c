"""Digest, reconciliation, labels from rules, events, survival of lines and the share card's rays."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import cut

RAYS = 3000


def digest_movers(was: DataFrame, now: DataFrame, top: int = 5) -> DataFrame:
    """The largest changes between two snapshots (name, amount); a name that one lacks is zero there."""
    both = was.select("name", F.col("amount").alias("was")).join(now.select("name", F.col("amount").alias("now")), "name", "full_outer")
    rows = both.select("name", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now")).withColumn("delta", F.col("now") - F.col("was"))
    return rows.where("delta <> 0").orderBy(F.abs("delta").desc(), "name").limit(top)


def verdict_changes(was: DataFrame, now: DataFrame) -> DataFrame:
    """Metrics whose verdict is not what it was (metric, read)."""
    both = was.select("metric", F.col("read").alias("was")).join(now.select("metric", F.col("read").alias("now")), "metric", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("metric", F.coalesce("was", F.lit("")).alias("was"), F.coalesce("now", F.lit("")).alias("now"))


def reconcile_scope(export: DataFrame, estimate: DataFrame, first: str, last: str) -> DataFrame:
    """day, side, billed, estimated of each day: common to the vendor's export (day, cost) and the estimate within the window, or of
    one alone. A day of the estimate within the export's span is common even where nothing was billed on it."""
    billed = export.groupBy("day").agg(F.sum("cost").alias("billed"))
    ours = estimate.groupBy("day").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("estimated"))
    span = export.agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))  # one row
    days = billed.join(ours, "day", "full_outer").crossJoin(F.broadcast(span))
    covered = F.col("billed").isNotNull() | F.coalesce(F.col("day").between(F.col("from_day"), F.col("to_day")), F.lit(False))
    side = F.when(F.col("day").between(first, last) & covered, "both").when(F.col("billed").isNull(), "estimate").otherwise("export")
    # a day outside the window that both have is outside for each
    return days.select("day", side.alias("side"), "billed", "estimated")


def reconcile(export: DataFrame, estimate: DataFrame, first: str, last: str) -> DataFrame:
    """What the vendor billed against the estimate on their common days: export (day, model, cost), estimate (day, model, cost, null
    where a model has no price, tokens).

    Named causes of the difference are what unpriced tokens would cost at the priced ones' mean rate, and, only where the two know
    a model in common, what was billed for models that the estimate never priced and priced for models that were not billed. What
    is left is unexplained and never rounded away.
    """
    days = reconcile_scope(export, estimate, first, last)
    common = days.where("side = 'both'").select("day")
    key = F.lower(F.trim("model")).alias("model")
    here = estimate.join(common, "day", "left_semi")
    billed = export.join(common, "day", "left_semi")
    by_model = billed.where("model <> ''").groupBy(key).agg(F.sum("cost").alias("billed"))
    ours = here.where("cost IS NOT NULL").groupBy(key).agg(F.sum("cost").alias("estimated"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    alone = by_model.join(ours, "model", "full_outer").agg(zero(F.sum(F.when(F.col("estimated").isNull(), F.col("billed")))).alias("only_billed"), zero(F.sum(F.when(F.col("billed").isNull(), F.col("estimated")))).alias("only_estimated"), F.count_if(F.col("billed").isNotNull() & F.col("estimated").isNotNull()).alias("shared_models"))
    unpriced = F.col("cost").isNull()
    tokens = lambda when: F.coalesce(F.sum(F.when(when, F.col("tokens"))), F.lit(0))
    money = here.agg(zero(F.sum("cost")).alias("estimated"), tokens(unpriced).alias("unpriced_tokens"), tokens(~unpriced).alias("priced_tokens"), F.count_if(unpriced).alias("unpriced_rows"))
    total = billed.agg(zero(F.sum("cost")).alias("billed"))
    sides = lambda side: F.count_if(F.col("side") == side)
    outside = lambda c, side: zero(F.sum(F.when(F.col("side") != "both", F.col(c))))  # noqa: E731, ARG005
    counted = days.agg(sides("both").alias("overlap_days"), F.count_if((F.col("side") != "both") & F.col("billed").isNotNull()).alias("export_only_days"), F.count_if((F.col("side") != "both") & F.col("estimated").isNotNull()).alias("window_only_days"), outside("billed", "export").alias("billed_outside"), outside("estimated", "estimate").alias("estimated_outside"))
    row = money.crossJoin(total).crossJoin(alone).crossJoin(counted)  # each is one row
    extrapolated = F.when((F.col("priced_tokens") > 0) & (F.col("unpriced_tokens") > 0), F.col("estimated") / F.col("priced_tokens") * F.col("unpriced_tokens")).otherwise(0.0)
    known = lambda c: F.when(F.col("shared_models") > 0, F.col(c)).otherwise(0.0)
    row = row.withColumns({"extrapolated": extrapolated, "only_billed": known("only_billed"), "only_estimated": known("only_estimated")})
    row = row.withColumns({"upper": F.col("estimated") + F.col("extrapolated"), "delta": F.col("billed") - F.col("estimated")})
    row = row.withColumns({"unexplained": F.col("delta") - (F.col("extrapolated") + F.col("only_billed") - F.col("only_estimated")), "in_band": F.col("billed").between(F.col("estimated"), F.col("upper"))})
    return row.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


def derive_labels(signals: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """session_id, member, axis, value that rules (source column, pattern, axis, value) agree on, for sessions without any label."""
    hits = [F.when(F.col(source).rlike(pattern), F.struct(F.lit(axis).alias("axis"), F.lit(value).alias("value"))) for source, pattern, axis, value in rules]
    free = signals.join(labels, ["session_id", "member"], "left_anti")
    said = free.select("session_id", "member", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("session_id", "member", "h.*")
    return said.groupBy("session_id", "member", "axis").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")


def events_of(usage: DataFrame) -> DataFrame:
    """Each record as canonical observations: one of its usage, and one of its edits if it changed anything."""
    edited = (F.col("edits") > 0) | (F.col("lines_added") > 0) | (F.col("lines_removed") > 0)
    use = F.struct(F.col("dedupe_key").alias("event_id"), F.lit("ai_usage").alias("type"), (F.col("input_tokens") + F.col("output_tokens")).alias("amount"))
    edit = F.when(edited, F.struct(F.concat("dedupe_key", F.lit("#edit")).alias("event_id"), F.lit("ai_edit").alias("type"), (F.col("lines_added") + F.col("lines_removed")).alias("amount")))
    return usage.select("tool", "session_id", "ts", F.explode(F.array_compact(F.array(use, edit))).alias("e")).select("tool", "session_id", "ts", "e.*")


def rays(sessions: DataFrame, most: int = RAYS) -> DataFrame:
    """Every k-th session by its first time, at most ``most``, with its rank and the fourth root of its output over the largest.

    Sessions are dealt to ranges of their time and ranked within; a range's rank begins where those before it end, so no task sees
    all of them."""
    # a picture has a bounded number of rays: the limit is the feature
    order = ["first_ts", "session_id", "member"]
    dealt = sessions.select(*order, "output_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    local = cut(dealt.withColumn("here", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1), "rays")
    sizes = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("output_tokens").alias("most"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy()  # one row a range
    about = sizes.select("part", ahead.alias("ahead"), F.greatest(F.ceil(F.sum("n").over(every) / most), F.lit(1)).alias("k"), F.max("most").over(every).alias("largest"))
    ranked = local.join(about, "part").withColumn("rank", F.col("here") + F.col("ahead")).where(F.col("rank") % F.col("k") == 0)
    root = F.when(F.col("largest") > 0, F.sqrt(F.sqrt(F.col("output_tokens") / F.col("largest")))).otherwise(0.0)
    return ranked.select("session_id", "member", F.col("rank").cast("long").alias("rank"), F.round(root, 6).alias("length"))


def survival(blame: DataFrame, commits: DataFrame) -> DataFrame:
    """Lines of the window's commits that stand today, of those its non-merge commits added: blame (path, commit), commits (commit, added, merge)."""
    own = commits.where("NOT merge")
    standing = blame.join(own.select("commit"), "commit", "left_semi").agg(F.count(F.lit(1)).alias("surviving")).withColumn("one", F.lit(1))
    made = own.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added")).withColumn("one", F.lit(1))
    return standing.join(made, "one").select("surviving", "added", F.when(F.col("added") > 0, F.col("surviving") / F.col("added")).otherwise(-1.0).alias("rate"))


#: What tells the kind of a file, in the order in which kinds are tried.
GENERATED = {"dirs": ("vendor", "node_modules", "dist", "build", "target"), "names": ("go.sum", "package-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock"), "suffixes": (".pb.go", "_gen.go", "_generated.go", ".min.js", ".min.css", ".lock")}
TEST_DIRS = ("test", "tests", "testdata", "__tests__", "spec", "fixtures")
DOCS = {"dirs": ("doc", "docs"), "extensions": (".md", ".rst", ".adoc", ".txt"), "names": ("LICENSE", "NOTICE", "AUTHORS", "COPYING")}
CONFIG = {"extensions": (".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".conf", ".properties", ".env", ".mod"), "names": ("Makefile", "Dockerfile", "Procfile")}
SOURCE = tuple(".go .ts .tsx .js .jsx .py .rb .java .kt .rs .c .h .cc .cpp .cs .php .swift .scala .sh .sql .css .scss .html .vue .ex .exs .hs .lua .pl .r .proto".split())


def path_kind(path: Column) -> Column:
    """generated, test, docs, config, source or other, the first that fits."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    extension = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    within = lambda known: F.arrays_overlap(dirs, F.array(*map(F.lit, known)))
    ends = lambda c, known: F.greatest(*(c.endswith(x) for x in known))
    return (
        F.when(within(GENERATED["dirs"]) | name.isin(*GENERATED["names"]) | ends(name, GENERATED["suffixes"]), "generated")
        .when(within(TEST_DIRS) | ends(stem, ("_test", ".test", ".spec")) | stem.startswith("test_"), "test")
        .when(within(DOCS["dirs"]) | extension.isin(*DOCS["extensions"]) | name.isin(*DOCS["names"]), "docs")
        .when(extension.isin(*CONFIG["extensions"]) | name.isin(*CONFIG["names"]) | name.startswith("."), "config")
        .when(extension.isin(*SOURCE), "source")
        .otherwise("other")
    )


def numstat(log: DataFrame, line: str = "line") -> DataFrame:
    """commit, path, added, removed of each changed file in the lines of ``git log --numstat --format=commit:%H`` (columns line, seq in
    one order, per file): the path after a rename, null counts for binary files."""
    tab = F.split(F.col(line), "\t")
    commit = F.when(F.col(line).startswith("commit:"), F.substring(line, 8, 64))
    named = log.withColumn("commit", F.last(commit, ignorenulls=True).over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    changed = named.where(F.col(line).rlike(r"^(\d+|-)\t(\d+|-)\t")).select("commit", F.array_join(F.slice(tab, 3, 1 << 20), "\t").alias("said"), tab[0].try_cast("long").alias("added"), tab[1].try_cast("long").alias("removed"))
    inner = F.regexp_replace("said", r"\{[^{}]* => ([^{}]*)\}", "$1")
    after = F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "//+", "/")
    return changed.select("commit", after.alias("path"), "added", "removed")


def categories(changes: DataFrame) -> DataFrame:
    """How many files of each kind every commit changed, and their lines."""
    return changes.groupBy("commit", path_kind(F.col("path")).alias("kind")).agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))


def pseudonym(kind: str, name: Column, secret: bytes) -> Column:
    """A name that stands for another: the kind and ten hexadecimal digits of HMAC-SHA256 under this secret; of an empty one, unknown."""
    key = secret.ljust(64, b"\0") if len(secret) <= 64 else hashlib.sha256(secret).digest().ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(F.concat(F.lit(f"{kind}:"), name), "utf-8")), 256))
    digits = F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 10)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.concat(F.lit(f"{kind}-"), digits))
