"""Conversation prefix trie by preorder intervals (operator 13).

Every distinct run of first turns is a node; what conversations share is stored once. No node is walked and no conversation is held whole:

* Turns become digests with a byte length at the first read, so texts are never shuffled. They are numbered by a distributed prefix sum
  (``running``), which deals rows by range, so a conversation that holds a third of all turns is spread over many tasks.
* A node's key is a prefix sum of hashes of (depth, turn), four lanes of 32 bits, so it needs the conversation's order alone.
* Conversations are ranked lexicographically by order-preserving names: runs of ``RADIX`` turns get their rank as a name, runs of as many
  names get theirs, until each conversation has one: log rounds in the longest conversation, each a sort of distinct runs.
* Members of a node are then an interval of ranks, and nodes ordered by (first member's rank, depth) stand in preorder. A subtree ends with
  the last node whose rank is at most its last member's, so leaves and savings are differences of two prefix sums over that order.
* The ids that end at a node are joined in pieces by all tasks; one task streams a node's pieces through a running digest.

Turns are compared by 128 bits of SHA-256 and nodes by 128 bits of hash: two different ones agree with odds of about n^2 / 2^129.

Defined results: rows of null conv_id belong to no conversation; null role or text is ''; null turns come first; rows of one turn number
stand by the digest of role and text, so repeated rows are turns of their own and reruns agree; texts of any length are digested whole; a
turnless conversation is a member of the root alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import cut

RADIX = 8  # turns or names of a run
PIECE = 1 << 16  # ids that are joined at a time
FAMILY = 5  # conversations that share the first turns of the first of them
MOST_SHARED = 8
LANES = ("l1", "l2", "l3", "l4")
MASK = (1 << 32) - 1
NOTHING = hashlib.sha256(b"").hexdigest()


def _summed(by: list[str], sums: list[str]):
    """Adds to the rows of a partition, sorted: row and sums within the key, all of this partition alone, and what is first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carried, head_over, waiting = TaskContext.get().partitionId(), None, np.zeros(len(sums) + 1, np.int64), False, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in by:
                column = batch.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            key = tuple(batch.column(c)[0].as_py() for c in by)
            lead = last is None
            if lead or key != last:
                new[0] = not lead
                carried[:] = 0
            run_of = np.cumsum(new)
            head = (run_of == 0) & (not head_over)
            head_over = head_over or bool(run_of[-1])
            starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
            of = np.cumsum(np.concatenate([[True], new[1:]])) - 1
            out = []
            for k, values in enumerate([np.ones(n, np.int64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in sums)]):
                whole = np.cumsum(values)
                before = (whole - values)[starts]
                before[0] -= carried[k]
                out.append(whole - before[of])
            carried = np.array([x[-1] for x in out], np.int64)
            last = tuple(batch.column(c)[n - 1].as_py() for c in by)
            first = np.zeros(n, bool)
            first[0] = lead
            columns = [*batch.columns, *(pa.array(x, pa.int64()) for x in out), pa.array(np.full(n, pid, np.int32)), pa.array(head), pa.array(first)]
            if waiting:
                yield told(*waiting, False)
            waiting = (batch.schema.names, columns, n)
        if waiting:
            yield told(*waiting, True)

    def told(names: list[str], columns: list[pa.Array], n: int, ends: bool) -> pa.RecordBatch:
        tail = np.zeros(n, bool)
        tail[-1] = ends
        return pa.RecordBatch.from_arrays([*columns, pa.array(tail)], [*names, "row", *(f"sum_{c}" for c in sums), "pid", "head", "lead", "tail"])

    return run


def running(df: DataFrame, by: list[str], order: list[str], sums: list[str], name: str) -> DataFrame:
    """The rows with ``row``, their number within the key from 1, and for each of ``sums`` its sum_ up to the row, in the order given.

    Rows are dealt by range, so a key may lie in many partitions; a row or two of each partition goes to the driver, which tells each what
    came before of its first key. All columns named are whole numbers or strings; ``by`` holds no nulls.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = ", ".join(["row long", *(f"sum_{c} long" for c in sums), "pid int", "head boolean", "lead boolean", "tail boolean"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + added
    local = cut(dealt.mapInArrow(_summed(by, sums), schema), name)
    totals = ["row", *(f"sum_{c}" for c in sums)]
    edges = {}
    for x in local.where("lead OR tail").select("pid", "head", "lead", "tail", *by, *totals).collect():
        edges.setdefault(x["pid"], {}).update(({"first": tuple(x[c] for c in by)} if x["lead"] else {}) | ({"last": tuple(x[c] for c in by), "totals": [x[c] for c in totals], "one": x["head"]} if x["tail"] else {}))
    carries, key, so_far = [], None, [0] * len(totals)
    for pid in sorted(edges):
        x = edges[pid]
        into = so_far if x["first"] == key else [0] * len(totals)
        if any(into):
            carries.append((pid, *into))
        so_far = [a + b for a, b in zip(x["totals"], into, strict=True)] if x["one"] else x["totals"]
        key = x["last"]
    told = spark.createDataFrame(carries, "pid int, " + ", ".join(f"_{c} long" for c in totals))
    joined = local.join(F.broadcast(told), "pid", "left")
    return joined.select(*df.columns, *(F.expr(f"`{c}` + if(head, coalesce(_{c}, 0), 0)").alias(c) for c in totals))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and bytes of each turn, numbered by ``row``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(said, 256), 1, 32).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return running(turns, ["conv_id"], ["turn", "digest"], [], "turns")


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as (c, d, digest, bytes) and the conversations as (c, len)."""
    turns = turns_of(conversations).select(F.col("conv_id").alias("c"), F.col("row").alias("d"), "digest", "bytes")
    return turns, cut(turns.groupBy("c").agg(F.count(F.lit(1)).alias("len")), "conversations")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``sequences``, but conversation c starts with the first h turns of c - c % 5 and goes on with its own after its first h,
    where h is crc32 of the decimal c, modulo 9."""
    turns = turns_of(conversations).drop("turn")
    lens = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "lengths")
    of = lens.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("s"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("h"), "own")
    first = lens.select(F.col("conv_id").alias("s"), F.col("own").alias("there"))
    known = of.join(first, "s", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(known.select("c", "s", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len")), "conversations")
    taken = turns.where(f"row <= {MOST_SHARED}").join(convs.select("c", "s", "h"), F.col("conv_id") == F.col("s")).where("row <= h").select("c", F.col("row").alias("d"), "digest", "bytes")
    own = turns.join(convs.select("c", "h", "m"), F.col("conv_id") == F.col("c")).where("row > h").select("c", F.expr("row - h + m").alias("d"), "digest", "bytes")
    return taken.unionByName(own), convs.select("c", "len")


def keyed(turns: DataFrame) -> DataFrame:
    """c, d, digest, bytes, the key (a, b) of the first d turns and that (pa, pb) of the turns before; of none it is (0, 0)."""
    hashed = turns.withColumn("x", F.xxhash64(F.lit(1), "d", "digest")).withColumn("y", F.xxhash64(F.lit(2), "d", "digest"))
    lanes = {"l1": F.shiftrightunsigned("x", 32), "l2": F.col("x").bitwiseAND(MASK), "l3": F.shiftrightunsigned("y", 32), "l4": F.col("y").bitwiseAND(MASK)}
    summed = running(hashed.withColumns(lanes).drop("x", "y"), ["c"], ["d"], list(LANES), "keys")
    packed = lambda hi, lo: F.shiftleft(hi.bitwiseAND(MASK), 32).bitwiseOR(lo.bitwiseAND(MASK))
    here, before = [F.col(f"sum_{c}") for c in LANES], [F.col(f"sum_{c}") - F.col(c) for c in LANES]
    return summed.select("c", "d", "digest", "bytes", packed(*here[:2]).alias("a"), packed(*here[2:]).alias("b"), packed(*before[:2]).alias("pa"), packed(*before[2:]).alias("pb"))


def ranked(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, len and r, the rank of the conversation's sequence among the different ones, a prefix before what it starts; 0 without turns."""
    longest = convs.agg(F.max("len")).first()[0] or 0
    runs = turns.select("c", F.expr("d - 1").alias("at"), F.col("digest").alias("name"))
    last = longest - 1
    while last >= 0:
        run = F.array_sort(F.collect_list(F.struct("at", "name")))
        joined = F.concat_ws("", F.transform(run, lambda x: x["name"]))
        blocks = cut(runs.groupBy("c", F.expr(f"at div {RADIX}").alias("block")).agg(joined.alias("run")), "runs")
        names = running(blocks.select("run").distinct(), [], ["run"], [], "names")
        last //= RADIX
        runs = blocks.join(names, "run").select("c", F.col("block").alias("at"), F.col("row").alias("r"), F.lpad(F.hex("row"), 12, "0").alias("name"))
        if not last:
            break
        runs = runs.drop("r")
    found = runs.select("c", "r") if longest else convs.select("c", F.lit(0).cast("long").alias("r")).limit(0)
    return cut(convs.join(found, "c", "left").select("c", "len", F.coalesce("r", F.lit(0)).alias("r")), "ranks")


def nodes_of(turns: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per node: its key, its parent's, its members' number, smallest id and first and last rank, and what it saves."""
    member = turns.join(ranks.select("c", "r"), "c")
    counted = member.groupBy("d", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count(F.lit(1)).alias("n"), F.min("c").alias("conv_id"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("bytes").alias("bytes"))
    none = F.lit(0).cast("long")
    root = ranks.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv_id"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("n > 0")
    root = root.select(none.alias("d"), none.alias("a"), none.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "n", "conv_id", "lo", "hi", none.alias("bytes"))
    return counted.unionByName(root).withColumn("saved", (F.col("n") - 1) * F.col("bytes")).drop("bytes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, held, key, piece = TaskContext.get().partitionId(), [], None, 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"r": pa.array([key[0]], pa.int64()), "len": pa.array([key[1]], pa.int64()), "pid": pa.array([pid], pa.int32()), "piece": pa.array([piece], pa.int32()), "ids": [",".join(held)]})

    for batch in batches:
        for r, length, c in zip(*(batch.column(x).to_pylist() for x in ("r", "len", "c")), strict=True):
            if (r, length) != key or len(held) == PIECE:
                if held:
                    yield told()
                held, piece, key = [], piece + 1, (r, length)
            held.append(str(c))
    if held:
        yield told()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for k in range(batch.num_rows):
            here = (batch.column("r")[k].as_py(), batch.column("len")[k].as_py())
            if here != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(batch.column("ids")[k].as_py().encode())
        if len(done) >= 10_000:
            yield _ends(done)
            done = []
    if key:
        yield _ends([*done, (*key, digest.hexdigest())])


def _ends(done: list[tuple]) -> pa.RecordBatch:
    r, length, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_pydict({"lo": pa.array(r, pa.int64()), "d": pa.array(length, pa.int64()), "ends_sha256": pa.array(digests, pa.string())})


def ends_of(ranks: DataFrame) -> DataFrame:
    """lo, d and the digest of the ids of the conversations that end at the node of that rank and depth."""
    pieces = ranks.repartitionByRange("r", "c").sortWithinPartitions("r", "c").mapInArrow(_pieces, "r long, len long, pid int, piece int, ids string")
    return pieces.repartition("r").sortWithinPartitions("r", "pid", "piece").mapInArrow(_digested, "lo long, d long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (c, d, digest, bytes) of conversations (c, len), d from 1: those of the contract, and of each the
    place in preorder and that of its subtree's last node, both from 1."""
    turns = keyed(turns)
    ranks = ranked(turns, convs)
    nodes = cut(nodes_of(turns, ranks), "nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    family = nodes.join(children, ["d", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = family.join(parents, ["d", "pa", "pb"], "left").withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    kept = cut(told.select("conv_id", "d", "parent_conv_id", "n", "n_children", "lo", "hi", "leaf", "saved"), "family")
    placed = running(kept, [], ["lo", "d"], ["leaf", "saved"], "preorder")
    ends = placed.groupBy(F.col("lo").alias("hi")).agg(F.max("row").alias("end"), F.max("sum_leaf").alias("end_leaf"), F.max("sum_saved").alias("end_saved"))
    return (
        placed.join(ends, "hi").join(ends_of(ranks), ["lo", "d"], "left").select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
            F.expr("end_leaf - sum_leaf + leaf").alias("n_leaves"), F.expr("end_saved - sum_saved + saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.col("row").alias("preorder"), F.col("end").alias("subtree_end"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(*sequences(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations)).drop("preorder", "subtree_end")
