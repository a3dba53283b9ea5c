"""Importing logs that grow: each run reads the bytes that were added since the last, and nothing twice.

A folder's listing (paths, sizes and times, no contents) is joined with the positions that the last run left. Of files that changed, the
head is probed: where it is as it was and the file has not shrunk, reading goes on at the position after the last whole line; a file that
was rotated or cut short is read from its start, under a new epoch. Ranges are split and read by many tasks.

What the new lines say (``transcripts.facts``) is put in order by itself, going on from what the position says of the file's state, and
appended to the store with the edits and steps that it holds. Of the lines read before, only those that have something in common with a
new one (``transcripts.links``: a line's id, a response, a tool call) are brought back; records and steps that new lines add to are made
of both and offered anew, and the others stand. So an import's work is that of what was added, but for one pass over the older lines'
numbers, and the records are those of one full read.

Positions, facts, records and steps are one change of the store: a run that dies anywhere is as if it had not begun, and a second run that
finds nothing new makes no generation. Records of lines that a rotation took away stay in the store.

Ranges are read with ``pyarrow.fs``, which opens local and shared folders, S3, GCS, Azure and HDFS by their addresses. An unfinished last
line is read as far as it goes and again once it is finished. A line that is longer than a split is read by the task in whose split it
begins. Blank lines and lines that are no JSON objects say nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.operators import etl
from meterloom.session import cut, drop_cut
from meterloom.sources import transcripts
from meterloom.sources.lines import as_usage
from meterloom.streaming.store import STEP, Generation, Store, offered

SPLIT = 64 << 20  # bytes that a task reads of a file
HEAD = 1024  # bytes by which a file is known again
BLOCK = 1 << 20
TOOL = "claude-code"
SAID = f"struct<{', '.join(f'{c}: string' for c in transcripts.CARRIED[:-1])}, {transcripts.CARRIED[-1]}: boolean>"
POSITION = f"file string, epoch long, size long, modified timestamp, offset long, head_size long, head_sum long, said {SAID}, seq long"
#: What is kept of the lines that were read; unfinished ones, which are read again, and repeated ones are passed over in each.
READ = {f"facts-{TOOL}": "past > 0 AND NOT again", f"edits-{TOOL}": "past > 0", f"places-{TOOL}": "past > 0 AND fresh"}


def listed(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """file, size, modified of the logs below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _opened(file: str):
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", file)
    where, path = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(file)
    return where.open_input_file(path)


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where to read each changed file from, and its head as it is now."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            with _opened(x["file"]) as f:
                size = min(x["size"], f.size())
                head = f.read_at(min(HEAD, size), 0)
            same = x["offset"] is not None and x["size"] >= x["offset"] and len(head) >= x["head_size"] and zlib.crc32(head[: x["head_size"]]) == x["head_sum"]
            epoch = 0 if x["epoch"] is None else x["epoch"] if same else x["epoch"] + 1
            out.append({"file": x["file"], "epoch": epoch, "size": x["size"], "modified": x["modified"], "start": x["offset"] if same else 0, "head_size": len(head), "head_sum": zlib.crc32(head)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("epoch", pa.int64()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("start", pa.int64()), ("head_size", pa.int64()), ("head_sum", pa.int64())]))


_LINES = pa.schema([("file", pa.string()), ("epoch", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("raw", pa.string()), ("past", pa.int64())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that begin in each range, each with its byte; ``past`` is the byte after it, 0 where it is not finished."""
    for batch in batches:
        for x in batch.to_pylist():
            yield from _of_range(x)


def _of_range(x: dict) -> Iterator[pa.RecordBatch]:
    at, end, out = x["first"], x["last"], []
    with _opened(x["file"]) as f:
        size = min(x["size"], f.size())
        held = b""
        if at > x["start"]:  # the line that this byte lies in is another range's, unless one begins here
            at -= 1
        here, skipping = at, at >= x["start"] and x["first"] > x["start"]
        while here < size:
            block = f.read_at(min(BLOCK, size - here), here)
            here += len(block)
            held += block
            begin = 0
            while (feed := held.find(b"\n", begin)) >= 0:
                if skipping:
                    skipping = False
                elif at + begin >= end:
                    break
                else:
                    out.append((at + begin, held[begin:feed], at + feed + 1))
                begin = feed + 1
            at, held = at + begin, held[begin:]
            if not skipping and at >= end:
                held = b""
                break
            if len(out) >= 10_000:
                yield _told(x, out)
                out = []
        if held and not skipping and at < end:
            out.append((at, held, 0))
    if out:
        yield _told(x, out)


def _told(x: dict, out: list[tuple]) -> pa.RecordBatch:
    n = len(out)
    raw = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line, _ in out]
    return pa.RecordBatch.from_arrays([pa.array([x["file"]] * n), pa.array([x["epoch"]] * n, pa.int64()), pa.array([a for a, _, _ in out], pa.int64()), pa.array([0] * n, pa.int64()), pa.array(raw, pa.string()), pa.array([p for _, _, p in out], pa.int64())], schema=_LINES)


def added_lines(changed: DataFrame) -> DataFrame:
    """file, epoch, at, n, raw, past of what was added to the files (as from ``probed``)."""
    edges = F.sequence("start", F.greatest("start", F.col("size") - 1), F.lit(SPLIT).cast("long"))
    ranges = changed.where("size > start").select("file", "epoch", "size", "start", F.explode(edges).alias("first")).withColumn("last", F.least(F.col("first") + SPLIT, F.col("size")))
    # dealt one by one to a number of tasks that is given: the ranges' rows are so small that they would else all be joined into one task
    told = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("last") - F.col("first")).alias("bytes")).first()
    tasks = min(told["n"], max(4 * changed.sparkSession.sparkContext.defaultParallelism, (told["bytes"] or 0) // SPLIT))
    return ranges.repartitionByRange(max(tasks, 1), "file", "first").mapInArrow(_lines, "file string, epoch long, at long, n long, raw string, past long")


def _schemas(spark: SparkSession) -> dict:
    nothing = spark.createDataFrame([], "file string, epoch long, at long, n long, raw string, past long")
    lines = transcripts.told_so_far(transcripts.facts(nothing, "epoch", "past"))
    place = "epoch long, past long, file string, at long, n long, k int, fresh boolean, target string, target_ref long, ordinal long"
    frames = (lines.withColumn("links", transcripts.links(lines)), transcripts.reworked(lines), spark.createDataFrame([], place))
    return {name: df.schema for name, df in zip(READ, frames, strict=True)}


def _kept(store: Store, name: str, base: Generation, schema, files: DataFrame) -> DataFrame:
    """What is kept of the lines of files (file, epoch) that were read before."""
    return store.table(name, base, schema).where(READ[name]).join(files, ["file", "epoch"], "left_semi")


def import_growing(store: Store, folder: str, names: str = "*.jsonl") -> Generation:
    """Brings the store up to what the folder's transcripts say now."""
    spark, base = store.spark, store.newest()
    at, (told, edited, placed) = f"positions-{TOOL}", READ
    newest = Window.partitionBy("file").orderBy(F.desc("seq"))
    known = store.table(at, base, spark.createDataFrame([], POSITION).schema).withColumn("_n", F.row_number().over(newest)).where("_n = 1 AND said IS NOT NULL").drop("_n", "seq")
    before = known.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "epoch", "offset", "head_size", "head_sum")
    found = listed(spark, folder, names).join(before, "file", "left").where("_size IS NULL OR size <> _size OR modified <> _modified")
    probed = found.select("file", "size", "modified", "epoch", "offset", "head_size", "head_sum").mapInArrow(_probed, "file string, epoch long, size long, modified timestamp, start long, head_size long, head_sum long")
    changed = cut(probed, "changed")
    if changed.isEmpty():
        return base

    number = F.lit(base.number + 1).cast("long")
    fresh = cut(transcripts.facts(added_lines(changed), "epoch", "past"), "facts")
    files = changed.select("file", "epoch")
    files = F.broadcast(files) if _few(changed) else files
    stood = known.select("file", "epoch", "said").join(files, ["file", "epoch"], "left_semi")
    schemas = _schemas(spark)
    old = places = budgets = None
    if base.tables.get(told):
        old = _met_again(fresh, stood, _kept(store, told, base, schemas[told], files))
        places = _kept(store, placed, base, schemas[placed], files)
        edits = _kept(store, edited, base, schemas[edited], files)
        budgets = edits.groupBy("file", "path").agg((F.sum("added") - F.sum("rework")).alias("added")).where("added > 0")
    lines = transcripts.told_so_far(fresh, stood.select("file", "said.*") if old else None, old.select("file", "uuid") if old else None)
    lines = lines.withColumn("links", transcripts.links(lines))
    written = {told: store.write(told, lines)}
    every = store.written(written[told], schemas[told])
    new = every.where("NOT again").withColumn("fresh", F.lit(True))
    written[edited] = store.write(edited, transcripts.reworked(new, budgets))
    changes = store.written(written[edited], schemas[edited]).withColumn("fresh", F.lit(True))
    if old:
        new = new.unionByName(old.withColumn("fresh", F.lit(False)))
        place = ["file", *transcripts.ORDER]
        changes = changes.unionByName(edits.join(old.where("kind = 'edit'").select(*place), place, "left_semi").withColumn("fresh", F.lit(False)))
    records = as_usage(transcripts.recorded(new, changes), TOOL)
    seq = F.struct(number.alias("batch"), F.monotonically_increasing_id().alias("n"))
    steps = transcripts.stepped(new, places).withColumns({"tool": F.lit(TOOL), "member": F.lit(""), "seq": seq})
    written["steps"] = written[placed] = store.write("steps", steps)

    # where each file stands, after its last whole line
    said = F.struct(*(F.col(c).alias(name) for c, name in zip((*transcripts.SAID, "owner", "lost"), transcripts.CARRIED, strict=True)))
    read = fresh.groupBy("file").agg(F.max("past").alias("past"))
    told_last = every.where("past > 0").groupBy("file").agg(F.max_by(said, F.struct(*transcripts.ORDER)).alias("now"))
    offset = F.greatest(F.col("start"), F.coalesce("past", F.lit(0)))
    stands = F.coalesce("now", "said", F.from_json(F.lit("{}"), SAID)).alias("said")
    positions = changed.join(read, "file", "left").join(told_last, "file", "left").join(stood, ["file", "epoch"], "left").select("file", "epoch", "size", "modified", offset.alias("offset"), "head_size", "head_sum", stands, number.alias("seq"))
    made = store.change(base, append={"usage": offered(records, base), at: positions}, written=written)
    drop_cut(changed, fresh, old)
    return made


def _met_again(fresh: DataFrame, stood: DataFrame, old: DataFrame) -> DataFrame:
    """Of the lines read before, those with which a new one has something in common; what is first said goes on with where its file
    ``stood``, so the last response there counts as new."""
    going = stood.where("said.past_key IS NOT NULL").select("file", F.col("said.past_key").alias("key"), F.lit("assistant").alias("kind"), F.lit("").alias("uuid"))
    sought = fresh.select("file", "key", "kind", "uuid", "made", "tools", "results").unionByName(going, allowMissingColumns=True)
    link = lambda links: F.explode(links).alias("link")
    met = cut(old.select(link(F.col("links"))).join(sought.select(link(transcripts.links(sought))), "link", "left_semi").distinct(), "met")
    place = ["file", *transcripts.ORDER]
    hits = cut(old.select(*place, link(F.col("links"))).join(met, "link", "left_semi").select(*place).distinct(), "hits")
    found = cut(old.join(hits, place, "left_semi"), "old")
    drop_cut(met, hits)
    return found


def import_changed(store: Store, folder: str, tool: str, parse: Callable[[SparkSession, list[str]], DataFrame], now: str, names: str = "*.jsonl", build: str = "1", files: int = 1000) -> Generation:
    """Brings the store up to what a folder of another tool's logs says now: a file whose size or time is not that of its last reading by
    this build is read again as a whole, and its records restated by their keys. Files go ``files`` at a time, each time one change, so a
    run that dies has done some of them and the next goes on."""
    spark, at = store.spark, f"positions-{tool}"
    state = spark.createDataFrame([], "path string, size long, mtime timestamp, version string, seq long").schema
    newest = Window.partitionBy("path").orderBy(F.desc("seq"))
    known = store.table(at, store.newest(), state).withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    found = listed(spark, folder, names).select(F.col("file").alias("path"), "size", F.col("modified").alias("mtime"), F.lit(build).alias("version"))
    changed = cut(etl.changed_inputs(found, known).orderBy("path"), "changed")
    held, made = [], store.newest()

    def read(paths: list[str]) -> Generation:
        base = store.newest()
        records = parse(spark, paths).persist()
        try:
            sound = records.where(etl.reject_reason(now).isNull())
            seen = changed.where(F.col("path").isin(paths)).withColumn("seq", F.lit(base.number + 1).cast("long"))
            return store.change(base, append={"usage": offered(sound, base), at: seen})
        finally:
            records.unpersist()

    for x in changed.select("path").toLocalIterator():
        held.append(x["path"])
        if len(held) == files:
            made, held = read(held), []
    return read(held) if held else made


def _few(changed: DataFrame, most: int = 100_000) -> bool:
    """Whether the changed files are so few that their names may be broadcast."""
    return changed.limit(most + 1).count() <= most


def compact_log_tables(store: Store) -> Generation:
    """The newest position of each file and what is kept of its epoch's lines, in one folder each in place of a folder a run."""
    base, at, schemas = store.newest(), f"positions-{TOOL}", _schemas(store.spark)
    if len(base.tables.get(at, [])) < 2:
        return base
    newest = Window.partitionBy("file").orderBy(F.desc("seq"))
    positions = store.table(at, base, store.spark.createDataFrame([], POSITION).schema).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return store.change(base, replace={at: positions} | {name: _kept(store, name, base, schemas[name], positions.select("file", "epoch")) for name in READ})
