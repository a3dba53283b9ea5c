"""Reading log files line by line, in order, and the helpers that the log formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.logs import text
from meterloom.schema import USAGE

#: What a tool call is for, by its name; any other name is "other".
TOOL_CLASSES = {
    "reads": ("Read", "NotebookRead", "WebFetch", "read", "read_file", "view", "open_page", "fetch"),
    "searches": ("Grep", "Glob", "WebSearch", "ToolSearch", "grep", "glob", "search", "web_search"),
    "commands": ("Bash", "BashOutput", "KillShell", "shell", "exec", "bash", "run", "local_shell", "container.exec"),
    "writes": ("Edit", "Write", "MultiEdit", "NotebookEdit", "edit", "write", "apply_patch", "str_replace_editor"),
}
STEP_OF = {"reads": "read", "searches": "search", "commands": "command", "writes": "edit"}


def placed_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """file, at, n, raw: every non-empty line, with where its split of the file begins and its place in that, which order a file's lines.
    Large files are read in splits by many tasks, and no row is moved."""
    read = spark.read.options(**options).option("lineSep", "\n").text(path)
    raw = F.regexp_replace("value", "\r$", "").alias("raw")
    placed = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), raw)
    return placed.where("raw <> ''")


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """file, line (from 0), raw: every non-empty line, for formats whose keys hold a line's number."""
    line = (F.row_number().over(Window.partitionBy("file").orderBy("at", "n")) - 1).alias("line")
    return placed_lines(spark, path, **options).select("file", line, "raw")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Adds ``j``, in one parse; lines that are not JSON objects have none. A value of another type than expected is null by itself."""
    broken = F.col("j._broken").isNotNull()
    j = F.from_json("raw", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    # a line may be marked for one odd value only: what could not be parsed at all has no value either
    empty = F.to_json(F.col("j").dropFields("_broken")) == "{}"
    return lines.withColumn("j", F.when(F.ltrim("raw").startswith("{"), j)).withColumn("j", F.when(~(broken & empty), F.col("j")))


def skipped(lines: DataFrame) -> DataFrame:
    """How many lines of each file could not be read."""
    return lines.groupBy("file").agg(F.sum(F.col("j").isNull().cast("long")).alias("skipped"))


def purpose(name: Column) -> Column:
    out = F.lit("other")
    for kind, names in TOOL_CLASSES.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def fingerprint(lines: DataFrame) -> DataFrame:
    """file, fp: the 32-bit FNV-1a hash of each file's first line, in hexadecimal."""
    first = lines.groupBy("file").agg(F.min_by("raw", "line").alias("raw"))
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length("raw")), lambda i: F.conv(F.hex(F.substring(F.encode("raw", "utf-8"), i, F.lit(1))), 16, 10).cast("long"))
    return first.select("file", F.lpad(F.lower(F.hex(F.aggregate(octets, F.lit(2166136261).cast("long"), step))), 8, "0").alias("fp"))


def as_usage(records: DataFrame, tool: str) -> DataFrame:
    """Records with every column of the fact table: what a format does not tell is empty or zero. Undated records are left out."""
    have = {c.lower() for c in records.columns}

    def column(f) -> Column:
        if f.name == "tool":
            return F.lit(tool).alias("tool")
        empty = F.lit("" if f.dataType.typeName() == "string" else 0).cast(f.dataType) if f.name != "ts" else F.lit(None).cast(f.dataType)
        return (F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in have else empty).alias(f.name)

    return records.select(*(column(f) for f in USAGE.fields)).where("ts IS NOT NULL")
