"""Columns that log formats and reports share: texts, counts, times, names and lines as a log writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count(c: str | Column) -> Column:
    """A count that is never negative or missing."""
    return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(0))


def seconds(c: str | Column) -> Column:
    """A log's time, UTC, without fractions."""
    said = F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)
    return F.date_trunc("second", said).cast("timestamp_ntz")


def content_lines(c: Column) -> Column:
    feeds = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(feeds + (~c.endswith("\n")).cast("int"))


def token(c: Column) -> Column:
    """A word of a closed vocabulary, or nothing."""
    return F.when(c.rlike("^[a-z0-9_]{0,64}$"), c).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(text(path), "/+$", ""), "/"), -1)


def clean(path: Column) -> Column:
    """A slash path without empty, ``.`` and resolved ``..`` elements, as it is written; what climbs over the root of a rooted path stays
    at the root."""
    climbs = path.startswith("/")
    step = lambda done, e: (
        F.when(e.isin("", "."), done)
        .when((e == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != ".."), F.slice(done, 1, F.size(done) - 1))
        .when((e == "..") & climbs, done)
        .otherwise(F.concat(done, F.array(e)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(climbs, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def rooted(path: Column) -> Column:
    """Whether a slash path is absolute on any platform: from a root, a share or a drive."""
    return path.startswith("/") | path.rlike("^[A-Za-z]:/")


def target_key(target: Column, cwd: Column) -> Column:
    """One string for a file however it is named: backslashes as slashes, relative names from the working directory; empty where that is
    not known. A share keeps its two slashes."""
    slashed, here = (F.replace(text(c), F.lit("\\"), F.lit("/")) for c in (target, cwd))
    whole = F.when(rooted(slashed), slashed).when(rooted(here), F.concat(here, F.lit("/"), slashed)).otherwise("")
    share = whole.startswith("//")
    return F.when((slashed == "") | (whole == ""), "").otherwise(F.concat(F.when(share, "/").otherwise(""), clean(whole)))
