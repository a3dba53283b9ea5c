"""What repositories say of work: which project a folder belongs to, which lines stand, and what git's own texts mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.logs import clean, rooted, text
from meterloom.operators import etl
from meterloom.operators.surfaces import path_kind
from meterloom.session import cut

#: Fixed value: what stands between a repository and the name of one of its worktrees in a pointer.
WORKTREES = "/.git/worktrees/"


def _within(whole: Column, start: Column, length: Column | None = None) -> Column:
    return F.substr(whole, start.cast("int"), length.cast("int")) if length is not None else F.substr(whole, start.cast("int"))


# --- projects


def roots(entries: DataFrame) -> DataFrame:
    """dir, root: which repository the folders that hold a ``.git`` belong to. ``entries`` has dir and pointer, the text of that entry
    where it is a file and null where it is a folder. A worktree's pointer, absolute or from its own folder, leads to its main
    repository; any other pointer leaves a folder its own root."""
    line = F.try_element_at(F.filter(F.transform(F.split(text("pointer"), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("gitdir:")), F.lit(1))
    told = F.trim(F.substring(line, 8, 1 << 20))
    whole = clean(F.when(told.startswith("/") | rooted(told), told).otherwise(F.concat("dir", F.lit("/"), told)))
    at = F.instr(whole, WORKTREES)
    root = F.when(told.isNotNull() & (at > 0), _within(whole, F.lit(1), at - 1)).otherwise(F.col("dir"))
    return entries.withColumn("dir", clean(F.col("dir"))).select("dir", root.alias("root")).groupBy("dir").agg(F.min("root").alias("root"))


def resolved(cwds: DataFrame, roots: DataFrame) -> DataFrame:
    """cwd, root, subpath, project of each different folder where work was done: its nearest ancestor with a repository, itself included.

    A folder is joined with the roots by its ancestors, as many as it has elements, so nothing is compared with every root. Without one it
    is its own project. A folder outside its root, as a worktree beside its repository is, has no subpath, and names nothing outside it.
    """
    found = cwds.select("cwd").where("cwd <> ''").distinct().withColumn("at", clean(F.col("cwd")))
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = F.transform(above, lambda x: F.when(x == "", "/").otherwise(x))
    up = found.withColumn("dir", F.explode(F.array_distinct(ancestors)))
    nearest = up.join(roots, "dir").groupBy("cwd").agg(F.max_by("root", F.length("dir")).alias("root"))
    whole = found.join(nearest, "cwd", "left").withColumn("inside", F.coalesce("root", "at"))
    under = F.when(F.col("inside") == "/", "/").otherwise(F.concat("inside", F.lit("/")))
    subpath = F.when(F.col("root").isNotNull() & (F.col("at") != F.col("inside")) & F.startswith(F.col("at"), under), _within(F.col("at"), F.length(under) + 1)).otherwise("")
    name = F.element_at(F.split("inside", "/"), -1)
    return whole.select("cwd", F.col("inside").alias("root"), subpath.alias("subpath"), F.when(name == "", F.col("inside")).otherwise(name).alias("project"))


def with_projects(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Records (cwd, project, subpath, ..) named by the repositories they were made in; those without a folder keep the name they have."""
    of = resolved(records, roots).select("cwd", F.col("project").alias("_project"), F.col("subpath").alias("_subpath"))
    joined = records.join(of, "cwd", "left")
    return joined.withColumn("project", F.coalesce("_project", "project")).withColumn("subpath", F.coalesce("_subpath", "subpath")).drop("_project", "_subpath")


# --- paths in git's texts

#: The escapes of a quoted path besides three octal digits.
ESCAPES = {"\\\\": "5C", '\\"': "22", "\\a": "07", "\\b": "08", "\\t": "09", "\\n": "0A", "\\v": "0B", "\\f": "0C", "\\r": "0D"}


def _bound(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def unquoted(path: Column) -> Column:
    """A path without git's quotes; one whose quotes can't be read stays as it is."""
    known = F.create_map(*(F.lit(x) for kv in ESCAPES.items() for x in kv))
    octal = lambda x: F.when(F.substring(x, 2, 1) <= "3", F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0"))
    byte = lambda x: F.when(x.rlike(r"^\\[0-7]{3}$"), octal(x)).when(x.startswith("\\"), known[x]).when(x != '"', F.hex(F.encode(x, "utf-8")))
    decoded = lambda octets: F.when(~F.exists(octets, lambda x: x.isNull()), F.unhex(F.array_join(octets, "")).cast("string"))
    # a lone backslash at the end is no escape
    whole = lambda inner: lambda pieces: F.when(F.array_join(pieces, "") == inner, _bound(F.transform(pieces, byte), decoded))
    read = lambda inner: _bound(F.regexp_extract_all(inner, F.lit(r'\\[0-7]{3}|\\.|[^\\"]+|"'), F.lit(0)), whole(inner))
    quoted = lambda p: (F.length(p) >= 2) & p.startswith('"') & p.endswith('"')
    return _bound(path, lambda p: F.when(quoted(p), F.coalesce(_bound(_within(p, F.lit(2), F.length(p) - 2), read), p)).otherwise(p))


def _renamed(field: Column) -> Column:
    at = F.instr(field, " => ")
    head, tail = _within(field, F.lit(1), at - 1), _within(field, at)
    from_end = F.instr(F.reverse(head), "{")
    opens = F.when(from_end > 0, F.length(head) - from_end + 1).otherwise(0)
    closes = F.instr(tail, "}")
    braced = F.concat(_within(head, F.lit(1), opens - 1), _within(tail, F.lit(5), closes - 5), _within(tail, closes + 1))
    return F.when((opens > 0) & (closes > 0), F.regexp_replace(braced, "//+", "/")).otherwise(_within(tail, F.lit(5)))


def renamed_to(field: Column) -> Column:
    """The later of two names: ``old => new``, or with braces round what changed."""
    return _bound(field, lambda f: F.when(f.contains(" => "), _renamed(f)).otherwise(f))


def plain_path(field: Column) -> Column:
    """The path that a field of git's names: nearly all are neither renamed nor quoted, and stand as they are."""
    return _bound(field, lambda f: F.when(f.contains(" => ") | f.startswith('"'), unquoted(renamed_to(f))).otherwise(f))


#: A power of two: how many of a log's places a stretch has.
STRETCH = 18


def numstat(log: DataFrame, line: str = "line") -> DataFrame:
    """commit, path, added, removed, parents, revert of each changed file in the lines of
    ``git log --numstat --format='commit:%H parents:%P subject:%s'`` (file, seq, line); null counts for binary files, and a row without a
    path for a commit that changed no file, as a merge's is told. A log is as long as it likes: which commit lines belong to is found in
    stretches of it, to which the commit that was open before them is brought."""
    said = F.col(line)
    header, changed = said.startswith("commit:"), said.rlike(r"^(\d+|-)\t(\d+|-)\t")
    told = log.where(header | changed).select("file", "seq", F.shiftright("seq", STRETCH).alias("stretch"), F.when(header, said).alias("own"), F.when(~header, F.split(said, "\t", 3)).alias("tab"))
    # paths are read before rows are put in order, so that no condition on them reads them again
    rows = told.select("file", "seq", "stretch", "own", plain_path(F.col("tab")[2]).alias("path"), F.col("tab")[0].try_cast("long").alias("added"), F.col("tab")[1].try_cast("long").alias("removed"))
    carried = etl.carried(rows, told.select("file", "seq", "stretch", "own"), {"past": F.col("own")}, ["stretch"], ["seq"])
    named = carried.withColumn("head", F.coalesce(F.last("own", ignorenulls=True).over(etl.upto(["file", "stretch"], "seq")), "past"))
    parents = F.trim(F.regexp_extract("head", r"parents:([0-9a-f ]*)", 1))
    return named.select(
        F.regexp_extract("head", r"^commit:([0-9a-f]*)", 1).alias("commit"), "path", "added", "removed",
        F.when(parents == "", 0).otherwise(F.size(F.split(parents, " +"))).alias("parents"), F.col("head").rlike('subject:Revert "').alias("revert"), F.col("own").isNotNull().alias("header"),
    )


def commits_of(changes: DataFrame) -> DataFrame:
    """commit, added, removed, parents, revert of each commit in the rows of ``numstat``."""
    one = changes.groupBy("commit").agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"), F.max("parents").alias("parents"), F.max("revert").alias("revert"))
    return one.where("commit <> ''")


def blamed(blame: DataFrame, line: str = "line") -> DataFrame:
    """path, commit, lines: of how many lines of a file git names which commit, in the text of ``git blame --porcelain`` or
    ``--line-porcelain`` (path, line). Only a block's header begins with a full object name; content begins with a tab, and keywords are
    no such names. Lines are counted before anything is joined, so a commit that made a third of all lines is a few rows."""
    first = F.regexp_extract(F.col(line), r"^([0-9a-f]{64}|[0-9a-f]{40}) ", 1)
    return blame.select("path", first.alias("commit")).where("commit <> ''").groupBy("path", "commit").agg(F.count(F.lit(1)).alias("lines"))


def survival(changes: DataFrame, blame: DataFrame, read: DataFrame) -> DataFrame:
    """One row: how much of what the window's commits added stands today.

    ``changes`` from ``numstat``, ``blame`` from ``blamed``, ``read`` the paths that git could blame. A merge has no added lines of its
    own, so lines that blame gives it stand apart (merge_lines) and outside the rate; files that git could not blame are counted
    (unreadable), as they did not fail to survive. The rate is -1 where nothing was added.
    """
    changes = cut(changes.select("commit", "path", "added", "removed", "parents", "revert"), "changes")  # asked five times
    commits = commits_of(changes)
    merge = F.col("parents") > 1
    own = commits.agg(
        F.count(F.lit(1)).alias("commits"), F.sum(merge.cast("long")).alias("merges"), F.sum(F.col("revert").cast("long")).alias("reverts"),
        F.coalesce(F.sum(F.when(~merge, F.col("added"))), F.lit(0)).alias("added"),
    )
    touched = changes.where("path <> '' AND added IS NOT NULL").select("path").distinct()
    files = touched.join(read.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    counts = files.agg(F.coalesce(F.sum(F.col("there").cast("long")), F.lit(0)).alias("files"), F.coalesce(F.sum((~F.col("there")).cast("long")), F.lit(0)).alias("unreadable"))
    lines = blame.join(files.where("there").select("path"), "path", "left_semi").groupBy("commit").agg(F.sum("lines").alias("lines"))
    standing = lines.join(commits.select("commit", merge.alias("merge")), "commit").agg(*(F.coalesce(F.sum(F.when(c, F.col("lines"))), F.lit(0)).alias(n) for c, n in ((~F.col("merge"), "surviving"), (F.col("merge"), "merge_lines"))))
    paths = changes.where("path <> ''").where(F.col("parents") <= 1).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("n", path_kind(F.col("path")).alias("kind"))
    kinds = paths.agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("source", "test", "docs", "config", "generated", "other")))
    one = lambda df: df.withColumn("_one", F.lit(1))
    whole = one(own).join(one(counts), "_one").join(one(standing), "_one").join(one(kinds), "_one").drop("_one")
    rate = F.when(F.col("added") > 0, F.col("surviving") / F.col("added")).otherwise(F.lit(-1.0))
    return whole.na.fill(0).withColumn("rate", F.round(rate, 6))
