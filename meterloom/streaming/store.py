"""A store whose tables change together: a generation names the folders that every table consists of, and is taken up in one step.

Tables are Parquet folders that never change once they are written. A change writes new folders and then one manifest, numbered one above
the newest; the manifest's creation, which fails where the number is taken, is the moment at which all of it holds. A run that dies before
leaves folders that no manifest names (``sweep`` removes them), and a manifest that was not written whole is passed over. Readers hold
the folders of the generation they began with, whatever is changed meanwhile.

Defined results: a table that no generation names is empty; a change of nothing makes no generation; a change on top of a generation that
is no longer the newest raises ``Overtaken`` and changes nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterloom.operators import etl
from meterloom.schema import USAGE
from meterloom.session import cut, drop_cut

SNAPSHOTS_KEPT = 12  # fixed value: of each window
SEQ = StructType([StructField(c, LongType()) for c in ("batch", "n")])
STEP = StructType(
    [StructField(c, StringType()) for c in ("tool", "session_id", "member", "timeline", "kind", "outcome", "dedupe_key", "model")]
    + [StructField("ts", USAGE["ts"].dataType)] + [StructField(c, LongType()) for c in ("ordinal", "tokens", "target_ref")]
)
OFFER = StructType([*USAGE.fields, StructField("seq", SEQ)])
TABLES = {
    "usage": OFFER,
    "steps": StructType([*STEP.fields, StructField("seq", SEQ)]),
    "labels": StructType([StructField(c, StringType()) for c in ("session_id", "member", "task", "outcome", "difficulty")]),
    "snapshots": StructType([StructField("window", StringType()), StructField("taken", USAGE["ts"].dataType), StructField("metric", StringType()), StructField("value", StringType())]),
    "refused": StructType([*USAGE.fields, StructField("raw", StringType()), StructField("reason", StringType()), StructField("push", StringType())]),
}


class Overtaken(RuntimeError):
    """Another run has changed the store since this one read it."""


@dataclass(frozen=True)
class Generation:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, name: str) -> Generation | None:
        stream = self._fs.open(self._at(f"{self.path}/generations/{name}"))
        try:
            said = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not said.endswith("\n"):
            return None  # its writer died
        told = json.loads(said)
        return Generation(told["number"], told["tables"])

    def newest(self) -> Generation:
        for name in reversed(self._names(f"{self.path}/generations")):
            found = self._manifest(name) if name.endswith(".json") else None
            if found:
                return found
        return Generation()

    def table(self, name: str, at: Generation | None = None, schema: StructType | None = None) -> DataFrame:
        """A table as of a generation, the newest by default."""
        folders = (at or self.newest()).tables.get(name, [])
        schema = schema or TABLES[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def write(self, name: str, df: DataFrame) -> str:
        """Writes a folder that a change may take up later (``written``), and says its name."""
        return self._write(name, df)

    def written(self, folder: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def change(self, base: Generation, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, drop: tuple[str, ...] = (), unless_empty: bool = False, written: dict[str, str] | None = None) -> Generation:
        """A generation on top of ``base`` with tables added to, replaced or emptied, all of it or nothing. ``unless_empty``: what turns
        out to have no rows once it is written is not appended. ``written``: folders by table that are written and now added; tables
        may share one."""
        tables = {name: list(folders) for name, folders in base.tables.items() if name not in drop}
        for name, folder in (written or {}).items():
            tables[name] = [*tables.get(name, []), folder]
        for name, df in (append or {}).items():
            folder = self._write(name, df)
            if unless_empty and self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").isEmpty():
                self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            else:
                tables[name] = [*tables.get(name, []), folder]
        for name, df in (replace or {}).items():
            tables[name] = [self._write(name, df)]
        if tables == base.tables:
            return base
        return self._publish(base, tables)

    def _publish(self, base: Generation, tables: dict[str, list[str]]) -> Generation:
        # a broken manifest uses its number up, so numbers may be skipped but never taken twice
        taken = [n for n in self._names(f"{self.path}/generations") if n.endswith(".json")]
        if self.newest().number != base.number:
            raise Overtaken(f"generation {self.newest().number} stands where {base.number} was read")
        number = max([base.number, *(int(n[:-5]) for n in taken)]) + 1
        made = Generation(number, tables)
        at = self._at(f"{self.path}/generations/{number:012}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as e:  # the JVM's file exists: another run was quicker
            raise Overtaken(f"generation {number} is taken") from e
        try:
            out.write(bytearray((json.dumps({"number": number, "tables": tables}) + "\n").encode()))
        finally:
            out.close()
        return made

    def sweep(self, older_than: float = 7 * 86400) -> list[str]:
        """Deletes folders that the newest generation does not name and that are older than any reader, in seconds; says which."""
        named = {f for folders in self.newest().tables.values() for f in folders}
        gone = []
        for name in self._names(f"{self.path}/tables"):
            for part in self._names(f"{self.path}/tables/{name}"):
                folder = f"tables/{name}/{part}"
                at = self._at(f"{self.path}/{folder}")
                if folder not in named and self._fs.getFileStatus(at).getModificationTime() / 1000 <= time.time() - older_than:
                    self._fs.delete(at, True)
                    gone.append(folder)
        return gone


def usage(store: Store, at: Generation | None = None) -> DataFrame:
    """The records of a store, one of each (tool, dedupe_key)."""
    offers = store.table("usage", at)
    return etl.restate(offers, offers.limit(0)).select(*USAGE.names)


def steps(store: Store, at: Generation | None = None) -> DataFrame:
    offers = store.table("steps", at)
    last = [F.max_by(c, "seq").alias(c) for c in ("outcome", "target_ref", "tokens", "ordinal", "model")]
    first = [F.min_by(c, "seq").alias(c) for c in ("session_id", "member", "ts", "kind")]
    return offers.groupBy("tool", "timeline", "dedupe_key").agg(*last, *first).select(*STEP.names)


def _seq(batch: int):
    return F.struct(F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("n"))


def offered(records: DataFrame, base: Generation) -> DataFrame:
    """Records as offers of the generation that will stand on ``base``."""
    return records.select(*USAGE.names, _seq(base.number + 1).alias("seq"))


def compact(store: Store) -> Generation:
    """One offer of each key in place of all that were made. Readers of older generations go on with theirs."""
    base = store.newest()
    whole = {"usage": usage(store, base).withColumn("seq", _seq(0)), "steps": steps(store, base).withColumn("seq", _seq(0))}
    return store.change(base, replace={name: df for name, df in whole.items() if len(base.tables.get(name, [])) > 1})


def clear(store: Store, before: str = "", tool: str = "") -> Generation:
    """Forgets records and steps before a time, of a tool, or all.

    Labels go of sessions that lost records and have none left. What was read stays known where the clear is by time, as old records are
    to be forgotten and not read anew; else it is forgotten too, of the tool or of all, so that the next import reads again what still
    lies there. Digest snapshots always go: what was deleted is no movement that a digest could report.
    """
    base = store.newest()
    kept = etl.clear(store.table("usage", base), before, tool)
    replace = {"usage": kept, "steps": etl.clear(store.table("steps", base), before, tool)}
    if base.tables.get("labels"):
        replace["labels"] = etl.clear_labels(store.table("labels", base), store.table("usage", base), kept)
    drop = ["snapshots"]
    for name in base.tables:
        of = name.partition("-")
        if of[0] in ("positions", "facts", "edits", "places") and not before and tool in ("", of[2]):
            drop.append(name)
    return store.change(base, replace=replace, drop=tuple(drop))


def snapshot(store: Store, window: str, taken: str, values: DataFrame) -> Generation:
    """Keeps a run's values (metric, value) of a window, and of each window the newest twelve runs."""
    base = store.newest()
    new = values.select(F.lit(window).alias("window"), F.lit(taken).cast("timestamp_ntz").alias("taken"), "metric", F.col("value").cast("string").alias("value"))
    every = store.table("snapshots", base).where((F.col("window") != window) | (F.col("taken") != F.lit(taken).cast("timestamp_ntz"))).unionByName(new)
    runs = every.select("window", "taken").distinct()
    kept = etl.keep_newest(runs, "window", "taken", SNAPSHOTS_KEPT)
    return store.change(base, replace={"snapshots": every.join(kept, ["window", "taken"], "left_semi").select(*TABLES["snapshots"].names)})


#: What a member may be called. No colon, as a member's name stands before one in keys.
MEMBER = re.compile(r"[A-Za-z0-9._-]{1,64}")


def push(store: Store, records: DataFrame, name: str, member: str, now: str) -> tuple[Generation, int]:
    """Takes a member's push (records, perhaps with ``raw``, the text of what could not be read) as a whole, or refuses it as a whole.

    One record that breaks a rule refuses all of them; why stands in the table ``refused``, and the store's records are as before. Keys
    get the member before them, so two members' equal keys stay apart and a row has one possible writer. Records that stand in the store
    as they are pushed are not offered again, so a push that comes twice changes nothing. Returns the generation, and how many records
    were refused.
    """
    if not MEMBER.fullmatch(member):
        raise ValueError("a member's name is made of letters, digits, dots, dashes and underscores")
    base = store.newest()
    named = set(records.columns)
    rows = records if "raw" in named else records.withColumn("raw", F.lit(None).cast("string"))
    empty = lambda f: F.lit("" if f.dataType.typeName() == "string" else 0).cast(f.dataType)
    blank = {f.name: F.coalesce(F.col(f.name).cast(f.dataType), empty(f)) if f.name in named else empty(f) for f in USAGE.fields if f.name != "ts"}
    lacking = F.when(F.col("raw").isNotNull() | F.col("ts").isNull(), "malformed")
    judged = cut(rows.withColumns(blank).withColumn("reason", F.coalesce(lacking, etl.reject_reason(now))).withColumn("push", F.lit(name)), "push")
    try:
        bad = judged.where("reason IS NOT NULL")
        n = bad.count()
        if n:
            return store.change(base, append={"refused": bad.select(*TABLES["refused"].names)}), n
        own = judged.withColumn("member", F.lit(member)).withColumn("dedupe_key", F.concat(F.lit(f"{member}:"), "dedupe_key"))
        said = lambda df: df.withColumn("_said", F.xxhash64(*USAGE.names))
        # what other members pushed has other keys, and is not read
        mine = usage(store, base).where(F.col("dedupe_key").startswith(f"{member}:"))
        fresh = said(own).join(said(mine).select("tool", "dedupe_key", "_said"), ["tool", "dedupe_key", "_said"], "left_anti").select(*USAGE.names)
        return store.change(base, append={"usage": offered(fresh, base)}, unless_empty=True), 0
    finally:
        drop_cut(judged)


def digest(store: Store, window: str, at: Generation | None = None) -> DataFrame:
    """metric, value, before, change of a window: its newest stored run against the one before. What was never kept, or was cleared with
    the records that it spoke of, has nothing to be compared with."""
    kept = store.table("snapshots", at).where(F.col("window") == window)
    runs = kept.select("taken").distinct().orderBy(F.desc("taken")).limit(2).withColumn("run", F.row_number().over(Window.orderBy(F.desc("taken"))))  # two rows
    told = kept.join(runs, "taken").withColumn("value", F.col("value").cast("double"))
    run = lambda n: F.max(F.when(F.col("run") == n, F.col("value")))
    return told.groupBy("metric").agg(run(1).alias("value"), run(2).alias("before")).withColumn("change", F.col("value") - F.col("before"))
