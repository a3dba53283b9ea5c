"""SimHash near-duplicates with BK-trees (operator 1).

1. Each text becomes one 64-bit fingerprint; equal fingerprints become one node that keeps its smallest id.
2. Nodes are dealt to shards by blocks of their bits. Two fingerprints that differ in at most r bits agree in one of r + 1 blocks (in
   k of r + k), so every link lies inside some shard of one of the tables, and no table needs all pairs.
3. Each shard becomes a BK-tree: a node's children are keyed by their integer Hamming distance to it, and a search with radius r
   follows only the edges from d - r to d + r. A shard above ``SHARD_MOST`` is cut into several trees and every slice of its queries
   meets every tree: an exact way for hot shards, with no tree above the bound.
4. A search returns the shard's links as a spanning forest (one row per node at most), and the forests are joined to components by
   alternating large-star and small-star steps over written tables.

Sixty-four bits tell copies with a word or two changed, not similarity 0.8, at which a tenth or more of the bits differ. ``similar``
therefore takes 256 bits of shingles of five words in lower case and without punctuation, whose differing bits tell the angle between two texts and with it their similarity,
to about 0.03. They only find candidates: every link is confirmed by the exact Jaccard similarity of the two texts' shingles. The
radius leaves out about one in a thousand of the pairs at just the similarity asked for. Links of so many bits have no small exact set
of blocks: tables take samples of bits, as many tables as let a pair of just the similarity meet in one with probability ``RECALL``
(more alike pairs meet with more); width and number follow from the number of texts. Within so wide a radius a BK-tree leaves out
little, so shards are small: it is the samples that prune, and the exact similarity that decides. A node's candidates in a shard are confirmed nearest first, in rounds of growing
ranks (``RANKS``); a round leaves out pairs that the rounds before have joined, and the last takes all that are left. A node whose
candidates lie in a component of BIG nodes or more visits it instead of pairing with each of them: it is compared with the members in
slices, up to the first that it is similar to.

Trees reach their queries by a shuffle on the shard's key, not by a broadcast from the driver: the driver would otherwise see the
fingerprints of all documents.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows are rows of one node; a null id
never names a component unless all of its ids are null; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations, pairwise, repeat
from math import acos, ceil, comb, log, log2, pi
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from meterloom.llm.common import free_name, plain_words, struct_column, texts_of
from meterloom.session import cut, drop_cut

SEED = 42
RADIUS = 2
SHINGLE = 3
SHARD = 4096  # nodes of a shard, about
SHARD_MOST = 16_384  # nodes of a tree
HASHES = 1 << 16  # shingles whose bits are counted at once
QUERIES = 256  # searched at once

#: Of near-duplicates by similarity: words of a fingerprint, words of a shingle, nodes of a shard and of a tree, searched at once.
WIDE, WIDE_SHINGLE = 4, 5
WIDE_SHARD, WIDE_MOST, WIDE_QUERIES = 64, 4096, 128
SIMILARITY = 0.8
RECALL = 0.95  # of pairs at just the similarity
SLACK = 3  # standard errors by which the differing bits of a pair at just the similarity may pass their mean
RANKS = (0, 2, 16, 1 << 30)  # of a node's candidates in a shard, by round
BIG = 64  # nodes of a component that a node visits as a whole
VISITED = 512  # members, and visitors, that are compared at once

LINK = StructType([StructField("u", LongType()), StructField("v", LongType())])
SHARD_OF = [StructField("t", IntegerType()), StructField("key", LongType()), StructField("a", IntegerType()), StructField("b", IntegerType())]
CANDIDATE = StructType([*LINK.fields, *SHARD_OF, StructField("visit", BooleanType())])


def _shingle_hashes(words: list[bytes], shingle: int, seed: int):
    """The number of word shingles, and their hashes one by one."""
    if not words:
        return 0, iter(())
    if len(words) < shingle:
        return 1, iter([xxhash.xxh64_intdigest(b" ".join(words), seed)])
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return len(words) - shingle + 1, map(xxhash.xxh64_intdigest, shingles, repeat(seed))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the word shingles of a text, repeats included, as a signed 64-bit integer."""
    n, hashes = _shingle_hashes(text.encode("utf-8", "surrogatepass").lower().split(), shingle, seed)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        counts += _set_bits(np.fromiter(hashes, np.dtype("<u8"), min(HASHES, n - at)))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def even_words(text: str) -> list[bytes]:
    """The words that similarity looks at: in lower case, without ASCII punctuation unless that is all there is."""
    return plain_words(text) or text.lower().encode("utf-8", "surrogatepass").split()


def wide_fingerprint(text: str, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> tuple[int, ...]:
    """The SimHash of the distinct word shingles of a text, over WIDE times 64 bits, as signed 64-bit integers; then their number and
    the hash of their set."""
    n, hashes = _shingle_hashes(even_words(text), shingle, seed)
    if not n:
        return (0,) * (WIDE + 2)
    distinct = np.unique(np.fromiter(hashes, np.dtype("<u8"), n))
    out = []
    for k in range(WIDE):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(distinct), HASHES):
            mixed = (distinct[at : at + HASHES] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += _set_bits(mixed ^ (mixed >> np.uint64(31)))
        out.append(int(np.packbits(2 * counts > len(distinct), bitorder="little").view("<i8")[0]))
    whole = xxhash.xxh64_intdigest(distinct.tobytes(), seed)
    return (*out, len(distinct), whole - (1 << 64) if whole >> 63 else whole)


def _shingles(text: str, shingle: int) -> set:
    words = even_words(text)
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle)), strict=False))


def jaccard(a: str, b: str, shingle: int = WIDE_SHINGLE) -> float:
    """The exact Jaccard similarity of two texts' distinct word shingles; of two texts without words, 1."""
    x, y = _shingles(a, shingle), _shingles(b, shingle)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def apart_share(similarity: float) -> float:
    """The share of bits that tell two texts of this Jaccard similarity apart, on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def differing_bits(similarity: float, slack: float = SLACK) -> int:
    """The bits of a wide fingerprint by which two texts of this Jaccard similarity may differ: the mean and some standard errors."""
    share, bits = apart_share(similarity), 64 * WIDE
    return round(share * bits + slack * (share * (1 - share) * bits) ** 0.5)


def meeting(similarity: float, width: int, tables: int) -> float:
    """With what probability two texts of just this similarity lie within the radius and agree in all bits of a sample: their differing
    bits are a binomial number."""
    share, bits = apart_share(similarity), 64 * WIDE
    odds = (comb(bits, d) * share**d * (1 - share) ** (bits - d) * (1 - (1 - (1 - d / bits) ** width) ** tables) for d in range(differing_bits(similarity) + 1))
    return sum(odds)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKTree:
    """Distinct points, a row of 64-bit words each; the child of a node at distance d stands in column d of its row."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.bits = 64 * points.shape[1]
        self.child = np.full((len(points), self.bits + 1), -1, np.int32)
        edges = self.child.ravel()
        at = np.zeros(len(points), np.int64)  # where each point has come to
        falling = np.arange(1, len(points))
        while len(falling):
            edge = at[falling] * (self.bits + 1) + _apart(points[falling], points[at[falling]])
            slots, first = np.unique(edge, return_index=True)
            edges[slots] = falling[first]  # the first to come by an edge stays there
            at[falling] = edges[edge]
            falling = falling[at[falling] != falling]
        parent, edge = np.nonzero(self.child >= 0)
        self.listed = self.child[parent, edge]  # children in the order of their parents
        self.first = np.searchsorted(parent, np.arange(len(points) + 1))
        self.edge = np.zeros(len(points), np.int64)
        self.edge[self.listed] = edge

    def within(self, queries: np.ndarray, radius: int):
        """(query index, point index) of every pair within the radius."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found_p = [], []
        while len(q):
            d = _apart(queries[q], self.points[node])
            hit = d <= radius
            found_q.append(q[hit])
            found_p.append(node[hit])
            next_q, next_node = [], []
            if 2 * radius < 16:
                for e in range(-radius, radius + 1):
                    edge = d + e
                    inside = (edge > 0) & (edge <= self.bits)
                    to = self.child[node[inside], edge[inside]]
                    some = to >= 0
                    next_q.append(q[inside][some])
                    next_node.append(to[some])
            else:  # a wide reach meets most children: from a node's children to those within it
                n = self.first[node + 1] - self.first[node]
                of = np.repeat(np.arange(len(node)), n)
                child = self.listed[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[node][of]]
                some = np.abs(self.edge[child] - d[of]) <= radius
                next_q.append(q[of][some])
                next_node.append(child[some])
            q, node = np.concatenate(next_q), np.concatenate(next_node).astype(np.int64)
        return np.concatenate(found_q), np.concatenate(found_p)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; root[x] is always the smallest member of the set of x."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _search(radius: int, words: list[str], at_once: int):
    def shard(group: pa.Table) -> pa.Table:
        slice_of = group.column("part").to_numpy()
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        order = np.concatenate([np.flatnonzero(slice_of == a), np.flatnonzero(slice_of != a)])
        points = np.stack([group.column(c).to_numpy().view(np.uint64) for c in words], axis=1)[order]
        names = group.column("id").to_numpy()[order]
        n, n_tree = len(points), int((slice_of == a).sum())
        root = np.arange(n)
        if n > 1 and (a == b or 0 < n_tree < n):
            # a pivot that links to most: what is in its set by then needs no search of its own, as its links lead into the set
            # or are found from their other end
            stars = [np.flatnonzero(_apart(points, points[k]) <= radius) for k in range(0, n, -(-n // 8))]
            star = max(stars, key=len)
            root = _unite(root, star, np.full(len(star), star[0]))
            hot = 2 * len(star) > n
            tree = BKTree(points if hot or a == b else points[:n_tree])
            left = np.arange(0 if hot or a == b else n_tree, n)
            while len(left):
                if hot:
                    left = left[root[left] != root[star[0]]]
                some, left = left[:at_once], left[at_once:]
                if not len(some):
                    break
                q, p = tree.within(points[some], radius)
                root = _unite(root, some[q], p)
        moved = np.flatnonzero(root != np.arange(n))
        return pa.table({"u": pa.array(names[moved], pa.int64()), "v": pa.array(names[root[moved]], pa.int64())})

    return shard


def _nearest(radius: int, words: list[str], at_once: int, similarity: float, low: int, high: int):
    """Of each node of a shard, the candidates from rank ``low`` to ``high`` by distance that are not in its component yet; and a row
    that names the shard if some lie beyond. Sets whose sizes alone keep them under the similarity are no candidates. Instead of pairs
    with members of a big component it gives one visit (node, component)."""

    def shard(group: pa.Table) -> pa.Table:
        slice_of = group.column("part").to_numpy()
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        order = np.concatenate([np.flatnonzero(slice_of == a), np.flatnonzero(slice_of != a)])
        points = np.stack([group.column(c).to_numpy().view(np.uint64) for c in words], axis=1)[order]
        names, size, label, big = (group.column(c).to_numpy(zero_copy_only=False)[order] for c in ("id", "size", "label", "big"))
        n, n_tree = len(points), int((slice_of == a).sum())
        found, visits, more = [], [], False
        if n > 1 and (a == b or 0 < n_tree < n):
            tree = BKTree(points if a == b else points[:n_tree])
            first = 0 if a == b else n_tree
            for at in range(first, n, at_once):
                q, p = tree.within(points[at : at + at_once], radius)
                q += at
                may = (q != p) & (np.minimum(size[q], size[p]) / np.maximum(1, np.maximum(size[q], size[p])) >= similarity)
                q, p = q[may], p[may]
                nearer = np.lexsort((names[p], _apart(points[q], points[p]), q))
                q, p = q[nearer], p[nearer]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                apart = label[q] != label[p]
                more |= bool((apart & (rank >= high)).any())
                taken = apart & (rank >= low) & (rank < high)
                q, p = q[taken], p[taken]
                to, back = big[p], big[q]
                visits += [np.stack([names[q[to]], label[p[to]]]), np.stack([names[p[back]], label[q[back]]])]
                q, p = names[q[~to & ~back]], names[p[~to & ~back]]
                found.append(np.stack([np.maximum(q, p), np.minimum(q, p)]))
        rows = []
        for some, visit in ((found, False), (visits, True)):
            some = [x for x in some if x.size]
            if some:
                u, v = np.unique(np.concatenate(some, axis=1), axis=1)
                rows += [{"u": x, "v": y, "visit": visit} for x, y in zip(u.tolist(), v.tolist(), strict=True)]
        if more:
            rows.append({"t": group.column("t")[0].as_py(), "key": group.column("key")[0].as_py(), "a": a, "b": b})
        return pa.Table.from_pylist(rows, to_arrow_schema(CANDIDATE))

    return shard


def _tables(n: int, radius: int) -> list[list[tuple[int, int, int]]]:
    """For each table the (word, shift, width) stretches of bits that make its key: combinations of k blocks of radius + k, with the
    smallest k that gives shards of about SHARD nodes, cut to as many bits as n nodes need."""
    need = max(0, ceil(log2(max(1, n) / SHARD)))
    k = next(k for k in range(1, 64 - radius + 1) if k * (64 // (radius + k)) >= need or comb(radius + k + 1, k + 1) > 64)
    sizes = [64 // (radius + k) + (j < 64 % (radius + k)) for j in range(radius + k)]
    starts = [sum(sizes[:j]) for j in range(radius + k)]
    tables = []
    for chosen in combinations(range(radius + k), k):
        left, key = need, []
        for j in chosen:
            width = min(sizes[j], left)
            left -= width
            if width:
                key.append((0, starts[j] + sizes[j] - width, width))
        tables.append(key)
    return tables if need else [[]]  # one shard holds all


def _samples(n: int, similarity: float) -> list[list[tuple[int, int, int]]]:
    """As _tables, for wide fingerprints: samples of bits, as many as let a pair of just the similarity meet with probability RECALL.
    Shards keep their size, so width grows with the logarithm of n and the number of tables with a small power of n."""
    width = max(0, ceil(log2(max(1, n) / WIDE_SHARD)))
    if not width:
        return [[]]
    most = ceil(log(1 - RECALL) / log(1 - (1 - differing_bits(similarity) / (64 * WIDE)) ** width))  # what a pair at the radius needs
    wanted = bisect_left(range(1, most), RECALL, key=lambda tables: meeting(similarity, width, tables)) + 1
    pieces = next(k for k in range(min(2, width), width + 1) if comb(WIDE * (64 // ceil(width / k)), k) >= 4 * wanted)
    size = ceil(width / pieces)
    places = [(word, shift * size) for word in range(WIDE) for shift in range(64 // size)]
    dealt, tables, random = [], [], Random(SEED)
    while len(tables) < wanted:  # disjoint samples as far as the bits go, then other combinations of them
        if len(dealt) < pieces:
            dealt = random.sample(places, len(places))
        chosen, dealt = sorted(dealt[:pieces]), dealt[pieces:]
        key = [(word, shift, min(size, width - size * j)) for j, (word, shift) in enumerate(chosen)]
        key = [x for x in key if x[2] > 0]
        if key not in tables:
            tables.append(key)
    return tables


def _dealt(nodes: DataFrame, tables: list[list[tuple[int, int, int]]], most: int) -> DataFrame:
    """t, key, a, b, part and the columns of ``nodes`` (id, p0, p1, ..; others), a row for each shard or pair of its slices that a node is in."""
    keys = []
    for t, stretches in enumerate(tables):
        key = F.lit(0).cast("long")
        for word, shift, width in stretches:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(f"p{word}", shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    dealt = nodes.select(*nodes.columns, F.explode(F.array(*keys)).alias("to")).select(*nodes.columns, "to.t", "to.key")
    hot = cut(dealt.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1))
    sliced = dealt.join(hot, ["t", "key"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = sliced.withColumn("other", other).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    return pairs.select("t", "key", "a", "b", "part", *nodes.columns)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: forests of the nodes (columns id and p0; distinct) whose components are those of all links within the radius."""
    words = [c for c in nodes.columns if c[0] == "p"]
    pairs = _dealt(nodes, _tables(nodes.count(), radius), SHARD_MOST)
    return pairs.groupBy("t", "key", "a", "b").applyInArrow(_search(radius, words, QUERIES), LINK)


def _told(ids: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """id, text of these nodes; other texts are not moved."""
    some = ids.distinct().join(nodes.select("id", "text_hash"), "id")
    return cut(texts.join(some, "text_hash").groupBy("id").agg(F.first("text").alias("text")), "texts")


def _confirmed(found: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs u, v whose texts have the similarity."""

    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x, y, shingle) >= similarity for x, y in zip(texts_of(a), texts_of(b), strict=True)], pa.bool_())

    told = _told(found.select(F.explode(F.array("u", "v")).alias("id")), nodes, texts)
    left = found.join(told.withColumnRenamed("id", "u").withColumnRenamed("text", "one"), "u")
    both = left.join(told.withColumnRenamed("id", "v").withColumnRenamed("text", "other"), "v")
    return both.where(F.arrow_udf(alike, BooleanType())("one", "other")).select("u", "v")


def _welcomed(similarity: float, shingle: int):
    def group(rows: pa.Table) -> pa.Table:
        """Of each visitor the first member that is similar, if any: one link joins it."""
        visits = rows.column("visits").to_pylist()
        held = [(i, _shingles(t or "", shingle)) for i, t, out in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), visits, strict=True) if not out]
        u, v = [], []
        for i, text, out in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), visits, strict=True):
            if out:
                own = _shingles(text or "", shingle)
                for j, other in held:
                    if min(len(own), len(other)) >= similarity * max(len(own), len(other)) and (own or other):
                        both = len(own & other)
                        if both / (len(own) + len(other) - both) >= similarity:
                            u.append(i)
                            v.append(j)
                            break
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return group


def _visited(visits: DataFrame, labelled: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """u, v: of each visit (u, c) a member of component c whose text has the similarity. Members and visitors are dealt to slices, and
    a task compares one of each, so no pair is ever a row and no component comes together."""
    parts = lambda: F.ceil(F.count(F.lit(1)) / VISITED).cast("int")
    sizes = visits.groupBy("c").agg(parts().alias("visitor_parts"))
    members = labelled.select(F.col("label").alias("c"), "id").join(sizes, "c")
    sizes = cut(members.groupBy("c", "visitor_parts").agg(parts().alias("member_parts")), "visited")
    slice_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = labelled.select(F.col("label").alias("c"), "id").join(sizes, "c").withColumn("m", slice_of("member_parts")).withColumn("w", every("visitor_parts"))
    outside = visits.select("c", F.col("u").alias("id")).join(sizes, "c").withColumn("w", slice_of("visitor_parts")).withColumn("m", every("member_parts"))
    both = inside.select("c", "m", "w", "id", F.lit(False).alias("visits")).unionByName(outside.select("c", "m", "w", "id", F.lit(True).alias("visits")))
    told = _told(both.select("id"), nodes, texts)
    return both.join(told, "id").groupBy("c", "m", "w").applyInArrow(_welcomed(similarity, shingle), LINK)


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """u, v: as ``components``, of the links of nodes (id, p0, p1, .., size, text_hash; the texts by text_hash) whose texts have the similarity."""
    words = [c for c in nodes.columns if c[0] == "p"]
    radius = differing_bits(similarity)
    tables = _samples(nodes.count(), similarity)
    bare = nodes.select("id", *words, "size")
    stars = shards = None
    for low, high in pairwise(RANKS):
        if stars is None:
            labelled = bare.withColumn("label", F.col("id")).withColumn("big", F.lit(False))
        else:
            big = stars.groupBy(F.col("v").alias("label")).agg((F.count(F.lit(1)) >= BIG).alias("big")).where("big")
            rooted = bare.join(stars.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
            labelled = cut(rooted.join(big, "label", "left").withColumn("big", F.coalesce("big", F.lit(False))), "labelled")
        pairs = _dealt(labelled, tables, WIDE_MOST)
        if shards is not None:
            pairs = pairs.join(shards, ["t", "key", "a", "b"], "left_semi")
        told = cut(pairs.groupBy("t", "key", "a", "b").applyInArrow(_nearest(radius, words, WIDE_QUERIES, similarity, low, high), CANDIDATE), "candidates")
        found = cut(told.where("NOT visit").select("u", "v").distinct(), "pairs")
        good = _confirmed(found, nodes, texts, similarity, shingle)
        visits = cut(told.where("visit").select("u", F.col("v").alias("c")).distinct(), "visits")
        if not visits.isEmpty():
            good = good.unionByName(_visited(visits, labelled, nodes, texts, similarity, shingle))
        good = cut(good, "links")
        stars = components(good if stars is None else stars.unionByName(good))
        shards = told.where("u IS NULL").select("t", "key", "a", "b")
        if shards.isEmpty():
            break
    return stars


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the written table that they are made with."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_large_star``."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))), least


def _settled(edges: DataFrame) -> bool:
    """Whether each node is joined to the smallest of its component only, once: then the star steps change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), (F.col("u") < F.col("v")).alias("wrong")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(False).alias("wrong")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"), F.max("e.wrong").alias("wrong"))
    return not nodes.agg(F.max(F.col("wrong") | (F.col("ups") > F.col("least")))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node that has links, but for the roots, with the smallest node of its component. Each round is written, so a lost
    executor costs one round; the number of rounds grows with the logarithm of the longest chain. Whether a round is needed is counted
    first, as a round that changes nothing writes four tables.

    The smallest neighbours are written before they are joined: both sides of that join then come straight from a shuffle, and Spark
    splits the rows of a node with very many links (or sends the smallest neighbours out, where they are few)."""
    made = None
    while not _settled(edges):
        step, up = _large_star(edges)
        large = cut(step, "stars")
        step, down = _small_star(large)
        new = cut(step.distinct(), "stars")
        drop_cut(up, large, down, made)
        edges = made = new
    return edges


def _named(signed: DataFrame, nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """``signed`` with component_id, the smallest id of its node's component."""
    member = stars.unionByName(stars.select(F.col("v").alias("u"), "v").distinct())
    least = member.join(nodes, member.u == nodes.id).groupBy("v").agg(F.min("first").alias("component_id"))
    linked = member.join(cut(least, "roots"), "v").select(F.col("u").alias("id"), "component_id")
    named = nodes.join(linked, "id", "left").select("id", F.coalesce("component_id", "first").alias("component_id"))
    # written, so that both sides of the last join come straight from a shuffle and Spark can split a fingerprint that many rows share
    return signed.join(cut(named, "named"), "id")


def _signed(docs: DataFrame, printer, columns: list[str], key) -> DataFrame:
    """doc_id, text_hash, the columns that ``printer`` (text to a tuple) tells, and id, one row per row of ``docs``, written."""
    prints = struct_column(printer, StructType([StructField(c, LongType()) for c in columns]))
    told = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), prints(F.col("text")).alias("p")).select("doc_id", "text_hash", "p.*")
    return cut(told.withColumn("id", key), "prints")


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, p0 (signed), component_id, one row per row of ``docs``, by 64-bit fingerprints."""
    signed = _signed(docs, lambda x: (fingerprint(x, shingle),), ["p0"], F.col("p0"))
    nodes = cut(signed.groupBy("id", "p0").agg(F.min("doc_id").alias("first")), "nodes")
    stars = components(cut(links(nodes.drop("first"), radius), "links"))  # written, as the first star step reads it twice
    return _named(signed, nodes, stars)


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """doc_id, text_hash, component_id, one row per row of ``docs``, where texts of this Jaccard similarity of shingles link."""
    words = [f"p{k}" for k in range(WIDE)]
    signed = _signed(docs, lambda x: wide_fingerprint(x, shingle), [*words, "size", "shingles"], F.xxhash64(*words, "shingles"))
    told = signed.groupBy("id").agg(F.min("doc_id").alias("first"), F.min(F.struct(*words, "size", "text_hash")).alias("n"))
    nodes = cut(told.select("id", "first", "n.*"), "nodes")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    stars = similar_links(nodes.drop("first"), texts, similarity, shingle)
    return _named(signed.select("doc_id", "text_hash", "id"), nodes.select("id", "first"), stars).select("doc_id", "text_hash", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    return classes(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("p0")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each component in ``found`` (classes or similar): the one with the smallest id
    (of rows alike in id and text, one)."""
    found = cut(found.groupBy("doc_id", "text_hash", "component_id").agg(F.count(F.lit(1)).alias("n")), "classes")
    me = F.struct("doc_id", "text_hash")
    best = found.groupBy("component_id").agg(F.min(me).alias("best"))
    stays = found.join(best, found.component_id.eqNullSafe(best.component_id)).where(me == F.col("best"))
    names = {c: free_name(docs, f"kept_{c}") for c in ("doc_id", "text_hash")}
    own = free_name(docs, "own_hash")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    stays = stays.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & (F.col(own) == F.col(names["text_hash"]))
    kept = hashed.join(stays, same, "left_semi")
    if (found.agg(F.max("n")).first()[0] or 0) > 1:
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*docs.columns)
