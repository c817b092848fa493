"""N-gram Jaccard self-join with count-vector R-trees.

Every document is a set of five-word shingles. Equal sets are one node. A node's shingles are hashed
into groups (a power of two, 256 or about half the set's size); the group counts are its point. The
overlap of two sets is at most the sum of the coordinate minima of their points, and a link needs
overlap >= t / (1 + t) * (size + size), so a pair below that is out, and so is a pair of boxes of
points, bounded by the boxes' upper corners.

Which points can meet at all is settled by equi-joins: under one order of all shingles (frequent
ones last; the order is for speed, any order is exact) two linked sets share one of their first
n - ceil(t * n) + 1 shingles. Sets that share such a shingle are a block, without those that no other
set of the block can be similar to by size and by what stands behind the shingle in both orders.
Blocks with the same members are one; a block of more than LEAF points is cut by size into leaves,
and leaves, or pairs of them, are what a task takes. Inside, boxes of FANOUT points are compared
before their points.

What survives is verified on the exact sets. Only connectivity is asked for, so parts not yet
connected are joined round by round. The first round takes one block of each set, the largest, so a
point is sent once and at most one pair a set is verified; of large blocks it takes leaves and
neighbouring leaves alone. Later rounds take every block, and every pair of leaves, that still holds
two components, and propose a few pairs between them (one, then AGAIN times as many in each later round).
Verified pairs join components, refuted ones are not asked again, and rounds go on until no surviving
pair lies between two components: every pair is then linked, refuted, or within one component, and no
group of copies becomes its pairs. A block that another covers is left out from the start.

Defined cases: null or word-less texts have the empty set, linked with nothing; texts of one to four
words have one shingle, their sequence; equal sets are linked whatever their size; rows that share
an id each have their row; a null id never is a component id unless its component has no other;
empty tables give none; other columns are not read. 64-bit hashes stand for shingles and sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.llm.common import id_filter, passing, release, slices, texts_of
from tallybook.llm.components import components
from tallybook.llm.shingles import shingle_sets
from tallybook.session import store

SIMILAR = (75, 100)  # intersection / union of at least this share
FREQUENT = 1 << 16  # shingles ordered last: a bound on what the driver sends round, not on results
LEAF = 1024
FANOUT = 16
BUCKET_SIGNATURES = 1 << 21
HOME_NODES = 3_000
AGAIN = 1 << 12  # a round sends points again, so few rounds with more pairs each


def _node(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _dims(n: int) -> int:
    """Groups for a set of n shingles: many more than shingles for small sets, whose bound is then nearly exact."""
    return max(256, 1 << max(0, (max(n, 1) - 1).bit_length() - 1))


def _prefix(n: int) -> int:
    top, whole = SIMILAR
    return n + (-top * n) // whole + 1 if n else 0


def _point(found: np.ndarray) -> bytes:
    counts = np.bincount((found & np.uint64(_dims(len(found)) - 1)).astype(np.int64), minlength=_dims(len(found)))
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def _parse(point: bytes, n: int) -> np.ndarray:
    dims = _dims(n)
    return np.frombuffer(point, "<u1" if len(point) == dims else "<u4")


def _folded(point: np.ndarray, dims: int) -> np.ndarray:
    """The point over fewer groups, in the narrowest type that holds its counts."""
    if len(point) == dims:
        return point
    counts = point.reshape(-1, dims).sum(0, dtype=np.uint32)
    return counts.astype(np.min_scalar_type(int(counts.max())))


class _Frequent:
    """Misra-Gries summary of hash arrays with FREQUENT counters."""

    def __init__(self):
        self.keys, self.counts, self.pending, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.pending.append(hashes)
        self.size += len(hashes)
        if self.size > 500_000:
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        keys, counts = np.unique(np.concatenate(self.pending), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)
        if len(keys) > FREQUENT:
            counts = counts - np.partition(counts, -FREQUENT - 1)[-FREQUENT - 1]
        self.keys, self.counts, self.pending, self.size = keys[counts > 0], counts[counts > 0], [], 0


LARGE = (1 << 16) - 1  # sizes from here on are not told apart, and pass
# 32 bits of the shingle's hash, the set, its size, and how many of its shingles stand from this one on.
SIGNATURE = [("sig", "<u4"), ("node", "<i8"), ("n", "<u2"), ("rest", "<u2")]

SCANNED = "doc_id long, n int, node long, point binary, item long, low long"


def _scan(rows: DataFrame) -> DataFrame:
    """One pass: each document's set size and node, a node's point once per task, frequent shingles per task."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def run(batches):
        met, frequent = set(), _Frequent()
        for batch, texts in slices(batches):
            sizes, nodes, points = [], [], []
            for found in shingle_sets([t.encode() for t in texts]):
                node = _node(found)
                new = node not in met and len(found) > 0
                if new:
                    met.add(node)
                    frequent.add(found)
                sizes.append(len(found))
                nodes.append(node)
                points.append(_point(found) if new else None)
            blank = [None] * len(sizes)
            columns = [batch.column(0), sizes, nodes, points, blank, blank]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        frequent.settle()
        often = frequent.counts > 1
        items, low = frequent.keys[often].view(np.int64), frequent.counts[often]
        if len(items):
            columns = [[None] * len(items)] * 4 + [items, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(run, SCANNED)


def _signatures(rows: DataFrame, frequent, buckets: int) -> DataFrame:
    """(bucket, packed): prefix shingles as SIGNATURE, 16 bytes each."""

    def run(batches):
        keys, counts = frequent.value
        met, held, size = set(), [], 0

        def pack():
            shingles = np.concatenate([h[0] for h in held])
            sizes = np.array([len(h[0]) for h in held])
            whole = np.array([h[2] for h in held])
            place = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bucket = (shingles % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty(len(order), SIGNATURE)
            packed["sig"] = (shingles >> np.uint64(32))[order]
            packed["node"] = np.repeat([h[1] for h in held], sizes)[order]
            packed["n"] = np.minimum(np.repeat(whole, sizes), LARGE)[order]
            packed["rest"] = np.minimum(np.repeat(whole, sizes) - place, LARGE)[order]
            used, begin = np.unique(bucket[order], return_index=True)
            parts = [p.tobytes() for p in np.split(packed, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "packed"])

        for _, texts in slices(batches):
            for found in shingle_sets([t.encode() for t in texts]):
                node = _node(found)
                if node in met or not len(found):
                    continue
                met.add(node)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    often = keys[at] == found
                    last = found[often][np.argsort(counts[at[often]], kind="stable")]
                    found = np.concatenate([found[~often], last])
                prefix = found[: _prefix(len(found))]
                held.append((prefix, node, len(found)))
                size += len(prefix)
            if size > 300_000:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return rows.mapInArrow(run, "bucket int, packed binary")


def _may_link(n, rest, m, other_rest):
    """Whether sizes n and m, and what stands from a shared shingle on, allow a link.

    If the shingle is the first that both sets have, their overlap is at most the smaller rest; where
    it is not, the pair meets in the block of that first one.
    """
    top, whole = SIMILAR
    n, m = n.astype(np.int64), m.astype(np.int64)
    least = np.minimum(rest, other_rest).astype(np.int64)
    near = (top * np.maximum(n, m) <= whole * np.minimum(n, m)) & ((top + whole) * least >= top * (n + m))
    return near | (np.maximum(n, m) >= LARGE)


def _with_partner(block: np.ndarray) -> np.ndarray:
    """Rows of a block (one shingle's signatures) that may link with another of its rows."""
    if len(block) <= 64:
        fits = _may_link(block["n"][:, None], block["rest"][:, None], block["n"], block["rest"])
        np.fill_diagonal(fits, False)
        return block[fits.any(1)]
    # In order of size it is enough to look at the neighbours' sizes.
    block = block[np.argsort(block["n"], kind="stable")]
    n = block["n"].astype(np.int64)
    close = (SIMILAR[0] * n[1:] <= SIMILAR[1] * n[:-1]) | (n[1:] >= LARGE)
    return block[np.append(close, False) | np.insert(close, 0, False)]


def _blocks(signatures: DataFrame) -> DataFrame:
    """(block, members): nodes that share a prefix shingle and may link; blocks of equal members once."""

    def run(table: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), SIGNATURE)
        packed = packed[np.lexsort((packed["node"], packed["sig"]))]
        again = (packed["sig"][1:] == packed["sig"][:-1]) & (packed["node"][1:] == packed["node"][:-1])
        packed = packed[np.insert(~again, 0, True)] if len(packed) else packed  # a set's rows from several tasks
        starts = np.flatnonzero(np.diff(packed["sig"].astype(np.int64), prepend=-1))
        sizes = np.diff(np.append(starts, len(packed)))
        # Most blocks are of two sets: those are tested together.
        two = starts[sizes == 2]
        one, other = packed[two], packed[two + 1]
        two = two[_may_link(one["n"], one["rest"], other["n"], other["rest"])]
        found = np.stack([packed["node"][two], packed["node"][two + 1]], axis=1) if len(two) else np.empty((0, 2), np.int64)
        # Nodes are in ascending order, so equal members have equal bytes.
        members = [m.tobytes() for m in np.unique(found, axis=0)]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            block = _with_partner(packed[at : at + size])
            if len(block) > 1:
                members.append(np.sort(block["node"]).tobytes())
        members = list(dict.fromkeys(members))
        ids = [int.from_bytes(hashlib.blake2b(m, digest_size=8).digest(), "little", signed=True) for m in members]
        release()
        return pa.table({"block": pa.array(ids, pa.int64()), "members": pa.array(members, pa.binary())})

    grouped = signatures.groupBy("bucket").applyInArrow(run, "block long, members binary")
    return grouped.dropDuplicates(["block"])


def _memberships(blocks: DataFrame) -> DataFrame:
    """(block, node, head, size): head is the block's smallest node, size the number of its nodes."""

    def run(batches):
        for batch in batches:
            for block, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = np.frombuffer(members, "<i8")
                own = [np.full(len(nodes), v, np.int64) for v in (block, nodes.min(), len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[0]), pa.array(nodes), pa.array(own[1]), pa.array(own[2])], ["block", "node", "head", "size"]
                )

    return blocks.mapInArrow(run, "block long, node long, head long, size long")


class Tree:
    """R-tree over points of about one size: leaves of FANOUT points, packed by size and first coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.starts = np.arange(0, len(points), FANOUT)
        self.upper = np.maximum.reduceat(points, self.starts, axis=0)
        self.least = np.minimum.reduceat(sizes, self.starts)

    def near(self, point: np.ndarray, size: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Points from place `begin` on that may overlap enough, and their overlap bounds."""
        top, whole = SIMILAR
        first = begin // FANOUT
        bound = np.minimum(self.upper[first:], point).sum(1, dtype=np.int64)
        boxes = first + np.flatnonzero((top + whole) * bound >= top * (size + self.least[first:]))
        if not len(boxes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = (self.starts[boxes][:, None] + np.arange(FANOUT)).reshape(-1)
        at = at[(at >= begin) & (at < len(self.points))]
        bound = np.minimum(self.points[at], point).sum(1, dtype=np.int64)
        enough = (top + whole) * bound >= top * (size + self.sizes[at])
        return at[enough], bound[enough]


class Proposals:
    """Pairs to verify among the blocks of one home, with what is known of their components."""

    def __init__(self, points: dict[int, tuple[int, np.ndarray]], refuted: set, most: int):
        self.points, self.refuted, self.most = points, refuted, most
        self.parent: dict[int, int] = {}
        self.asked: dict[tuple[int, int], int] = {}
        self.tried: set[tuple[int, int]] = set()
        self.found: list[tuple[int, int]] = []
        self.more = False  # whether the block at hand has candidates that were not taken

    def part(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            self.parent[x] = x = self.parent.get(self.parent[x], self.parent[x])
        return x

    def offer(self, one: int, other: int, part: int, other_part: int) -> None:
        """Take a pair that the bounds let through, unless it is refuted or its parts have enough."""
        pair = (one, other) if one < other else (other, one)
        if part == other_part or pair in self.refuted or pair in self.tried:
            return
        x, y = self.part(part), self.part(other_part)
        key = (x, y) if x < y else (y, x)
        if x == y or self.asked.get(key, 0) >= self.most:
            self.more = True
            return
        self.asked[key] = self.asked.get(key, 0) + 1
        self.tried.add(pair)
        self.found.append(pair)
        if self.most == 1:  # a spanning forest of the candidates
            self.parent[y] = x

    def block(self, nodes: list[int], parts: list[int], sides: list[int]) -> None:
        """`sides` are 0 and 1 for a pair of leaves, where only pairs across count, or all 2."""
        self.more = False
        if len(set(parts)) < 2:
            return
        if len({self.part(p) for p in parts}) < 2:
            self.more = True
            return
        order = sorted(range(len(nodes)), key=lambda i: (self.points[nodes[i]][0], nodes[i]))
        nodes, parts, sides = ([c[i] for i in order] for c in (nodes, parts, sides))
        sizes = [self.points[n][0] for n in nodes]
        points = [self.points[n][1] for n in nodes]
        if len(nodes) <= FANOUT:
            self._pairs(nodes, parts, sides, sizes, points)
        else:
            self._tree(np.array(nodes), np.array(parts), np.array(sides), np.array(sizes), points)

    def _pairs(self, nodes, parts, sides, sizes, points) -> None:
        """A block of one box: its points are compared directly."""
        top, whole = SIMILAR
        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                if top * sizes[j] > whole * sizes[i]:
                    break
                if (sides[i] != 2 and sides[i] == sides[j]) or parts[i] == parts[j]:
                    continue
                pair = (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])
                if pair in self.tried or pair in self.refuted:
                    continue
                other = _folded(points[j], len(points[i]))
                if (top + whole) * int(np.minimum(points[i], other).sum(dtype=np.int64)) >= top * (sizes[i] + sizes[j]):
                    self.offer(nodes[i], nodes[j], parts[i], parts[j])

    def _tree(self, nodes, parts, sides, sizes, points) -> None:
        top, whole = SIMILAR
        dims = np.array([len(p) for p in points])
        trees = {}
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero((dims == d) | (dims == 2 * d))
            trees[d] = rows, Tree(np.stack([_folded(points[i], d) for i in rows]), sizes[rows])
        for i in range(len(nodes)):
            rows, tree = trees[int(dims[i])]
            at, bound = tree.near(points[i], int(sizes[i]), int(np.searchsorted(rows, i)) + 1)
            near = rows[at]
            fits = (whole * sizes[i] >= top * sizes[near]) & (parts[near] != parts[i])
            if sides[i] != 2:
                fits &= sides[near] != sides[i]
            near, bound = near[fits], bound[fits]
            best = np.argsort(-(bound / (sizes[near] + sizes[i])), kind="stable")
            for j in near[best].tolist():
                self.offer(int(nodes[i]), int(nodes[j]), int(parts[i]), int(parts[j]))


def _leaves(rows: DataFrame, sizes: DataFrame, first: bool) -> DataFrame:
    """(job, side, node, part) for blocks of more than LEAF nodes: their leaves, and the pairs of leaves that may link.

    Leaves are runs of equal size rank; two whose sizes can not link, or that lie in one component
    together, form no job. In the first round only neighbouring leaves do: they join what is alike,
    so that few pairs of leaves are left with two components.
    """
    place = F.row_number().over(Window.partitionBy("block").orderBy("n", "node")) - 1
    placed = rows.join(sizes, "node").withColumn("leaf", (place / LEAF).cast("int"))
    spans = placed.groupBy("block", "leaf").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("p"), F.max("part").alias("q")
    )
    one = spans.select("block", F.col("leaf").alias("i"), "high", "p", "q")
    other = spans.select("block", F.col("leaf").alias("j"), "low", F.col("p").alias("p2"), F.col("q").alias("q2"))
    top, whole = SIMILAR
    jobs = (
        one.join(other, "block")
        .where("j = i or j = i + 1" if first else "i <= j")
        .where(F.col("high") * whole >= F.col("low") * top)
        .where(~((F.col("p") == F.col("q")) & (F.col("p2") == F.col("q2")) & (F.col("p") == F.col("p2"))))
    )
    leaf_i = F.struct(F.col("i").alias("leaf"), F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side"))
    leaf_j = F.struct(F.col("j").alias("leaf"), F.lit(1).alias("side"))
    sides = jobs.select(
        "block", F.xxhash64("block", "i", "j").alias("job"),
        F.explode(F.when(F.col("i") == F.col("j"), F.array(leaf_i)).otherwise(F.array(leaf_i, leaf_j))).alias("s"),
    ).select("block", "job", "s.leaf", "s.side")
    return placed.join(sides, ["block", "leaf"]).select("job", "side", "node", "part")


def _jobs(members: DataFrame, points: DataFrame, homes: int, cut: bool, first: bool) -> DataFrame:
    """(home, job, side, node, part): blocks, or leaves and pairs of leaves of large ones, for (block, node, head, size, part).

    A home takes the blocks of one smallest node, so a group's blocks share the points sent there.
    """
    jobs = members.where(F.col("size") <= LEAF).select(
        F.pmod(F.xxhash64("head"), F.lit(homes)).alias("home"), F.col("block").alias("job"), F.lit(2).alias("side"), "node", "part"
    )
    if cut:
        large = _leaves(members.where(F.col("size") > LEAF), points.select("node", "n"), first)
        large = large.select(F.pmod(F.xxhash64("job"), F.lit(homes)).alias("home"), "job", "side", "node", "part")
        jobs = jobs.unionByName(large)
    return jobs


def _uncovered(memberships: DataFrame) -> DataFrame:
    """Memberships with `own`, the largest block of each node, without blocks that one other block covers.

    Where all members of a block have the same largest block, each of its pairs meets there.
    """
    own = memberships.groupBy("node").agg(F.max(F.struct("size", "block")).alias("own")).select("node", "own.block")
    rows = memberships.join(own.withColumnRenamed("block", "own"), "node")
    spans = rows.groupBy("block").agg(F.min("own").alias("p"), F.max("own").alias("q"))
    return rows.join(spans.where("p != q or p = block").select("block"), "block", "left_semi")


def _first_members(memberships: DataFrame) -> DataFrame:
    """Each node in its own block alone, where another node has the same; every node its own part."""
    taken = memberships.where("block = own").withColumn("part", F.col("node"))
    shared = taken.groupBy("block").count().where("count > 1").select("block")
    return taken.join(shared, "block", "left_semi")


def _unsettled(memberships: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Blocks that hold two components or more, with each node's component."""
    rows = memberships.withColumn("part", F.col("node"))
    if roots is not None:
        rows = memberships.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    still = rows.groupBy("block").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
    return rows.join(still.select("block"), "block", "left_semi")


def _left_over(jobs: DataFrame, flagged: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Jobs that had more candidates than were taken and still hold more than one component."""
    rows = jobs.join(flagged, "job", "left_semi")
    if roots is not None:
        rows = rows.join(roots, "node", "left").withColumn("part", F.coalesce("root", "part")).drop("root")
    still = rows.groupBy("job").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
    return rows.join(still.select("job"), "job", "left_semi")


def _propose(jobs: DataFrame, points: DataFrame, refuted: DataFrame | None, most: int) -> DataFrame:
    """(home, a, b, holder_a, holder_b, job): pairs to verify, each set with a document that holds it, and
    (with the others null) the jobs that have more of them.

    `jobs` must be a stored table.
    """
    if refuted is None:
        jobs = jobs.withColumn("against", F.lit(None).cast("array<long>"))
    else:
        against = refuted.groupBy("a").agg(F.collect_set("b").alias("against")).withColumnRenamed("a", "node")
        jobs = jobs.join(against, "node", "left")
    sent = jobs.select("home", "node").distinct().join(points, "node")
    sent = sent.select(F.col("home").alias("to"), F.col("node").alias("of"), "n", "point", "holder")

    def run(jobs: pa.Table, sent: pa.Table) -> pa.Table:
        sizes = sent.column("n").to_numpy().tolist()
        of, raw = sent.column("of").to_numpy().tolist(), sent.column("point").to_pylist()
        known = {node: (n, _parse(point, n)) for node, n, point in zip(of, sizes, raw)}
        holder = dict(zip(of, sent.column("holder").to_pylist()))
        jobs = jobs.sort_by([("job", "ascending"), ("node", "ascending")])
        job, side, node, part = (jobs.column(c).to_numpy() for c in ("job", "side", "node", "part"))
        with_some = jobs.select(["node", "against"]).filter(pc.is_valid(jobs.column("against")))
        ruled_out = {(x, y) for x, others in zip(*(c.to_pylist() for c in with_some.columns)) for y in others}
        work = Proposals(known, ruled_out, most)
        flagged = []
        begins = np.flatnonzero(np.diff(job, prepend=job[0] - 1)) if len(job) else []
        for begin, end in zip(begins, np.append(begins[1:], len(job))):
            work.block(node[begin:end].tolist(), part[begin:end].tolist(), side[begin:end].tolist())
            if work.more:
                flagged.append(job[begin])
        home = jobs.column("home")[0].as_py() if len(job) else 0
        found = [(home, a, b, holder[a], holder[b], None) for a, b in work.found]
        found += [(home, None, None, None, None, job) for job in flagged]
        columns = list(zip(*found)) or [[]] * 6
        release()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("home", "a", "b", "holder_a", "holder_b", "job"), columns)})

    both = jobs.groupBy("home").cogroup(sent.groupBy("to"))
    return both.applyInArrow(run, "home long, a long, b long, holder_a long, holder_b long, job long")


def _with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with `__node`, the node of their text's set, null for the empty set."""

    def run(batches):
        for batch in batches:
            nodes = []
            texts = pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1)], ["text"])
            for _, part in slices([texts]):
                nodes += [_node(found) if len(found) else None for found in shingle_sets([t.encode() for t in part])]
            columns = [*batch.columns[:-1], pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__node"])

    schema = StructType([*docs.schema.fields, StructField("__node", LongType())])
    return docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)


def _verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, linked) on the exact sets, cut again from the texts of one document for each node asked for.

    Refuted pairs come back as they are, linked ones as links of the components they make.
    """
    sides = [F.struct(F.col(c).alias("node"), F.col(f"holder_{c}").alias("doc_id")) for c in ("a", "b")]
    wanted = store(pairs.select("home", F.explode(F.array(*sides)).alias("s")).select("home", "s.*").distinct(), "wanted")
    shape = [F.col("home").alias("to"), F.col("node").alias("of"), "text"]
    texts = passing(rows, id_filter(wanted, "doc_id")).join(wanted, "doc_id").select(*shape)
    lost = wanted.where("doc_id is null")
    if not lost.isEmpty():  # sets that only rows without an id hold: found by the set itself, one text of each
        alike = passing(_with_node(rows.where("doc_id is null"), "text"), id_filter(lost, "node"), "__node")
        alike = alike.dropDuplicates(["__node"]).select("text", "__node")
        texts = texts.unionByName(alike.join(lost, F.col("__node") == F.col("node")).select(*shape))
    top, whole = SIMILAR

    def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {}
        for part in texts.to_batches(max_chunksize=500):
            own = part.column(1).to_pylist()
            for node, found in zip(own, shingle_sets([t.encode() for t in part.column(2).to_pylist()])):
                if node not in sets and _node(found) == node:  # a row of the same id may hold another set
                    sets[node] = found
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for one, other in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = sets[one], sets[other]
            same = len(np.intersect1d(x, y, assume_unique=True))
            if whole * same >= top * (len(x) + len(y) - same):
                parent[max(root(one), root(other))] = min(root(one), root(other))
            else:
                found.append((one, other, False))
        # Links of one home as stars: the same components, in shorter chains.
        found += [(root(x), x, True) for x in parent if root(x) != x]
        columns = list(zip(*found)) or [[]] * 3
        release()
        types = (pa.int64(), pa.int64(), pa.bool_())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "b", "linked"), columns, types)})

    both = pairs.groupBy("home").cogroup(texts.groupBy("to"))
    return both.applyInArrow(compare, "a long, b long, linked boolean")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node), one row per document, and (node, component_id, keep_node) for each node.

    Of a component's rows with the id component_id, keep_node is the smallest node.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    scanned = store(_scan(rows), "scanned")
    members = scanned.where("n is not null")
    often = scanned.where("item is not null").groupBy("item").agg(F.sum("low").alias("low"))
    often = often.orderBy(F.desc("low"), "item").limit(FREQUENT).collect()
    keys = np.array([r["item"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.array([r["low"] for r in often], np.int64)[order]))
    total = members.agg(F.sum("n")).first()[0] or 0
    # Buckets grow with the input, so that one holds about BUCKET_SIGNATURES.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4 // BUCKET_SIGNATURES)
    blocks = _blocks(_signatures(rows, frequent, buckets))
    memberships = store(_uncovered(store(_memberships(blocks), "memberships")), "uncovered")
    # One row for each set: its point, and the smallest id of a document that has it.
    nodes = members.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("holder"), F.first("n").alias("n"), F.first("point", ignorenulls=True).alias("point")
    )
    nodes = store(nodes, "nodes")
    points, holders = nodes.select("node", "n", "point", "holder"), nodes.select("node", "holder")
    shape = memberships.agg(F.count("*").alias("rows"), F.max("size").alias("largest")).first()
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shape["rows"] // HOME_NODES)
    cut = (shape["largest"] or 0) > LEAF  # without a block of several leaves there is no pair of leaves
    links = roots = refuted = None

    def verified(jobs: DataFrame, most: int) -> DataFrame:
        """Proposals of a round; what they link and refute is added to what is known."""
        nonlocal links, roots, refuted
        proposed = store(_propose(jobs, points, refuted, most), "proposed")
        pairs = proposed.where("a is not null").drop("job")
        if not pairs.isEmpty():
            verdicts = store(_verify(pairs, rows), "verdicts")
            fresh = verdicts.where("linked").select("a", "b")
            links = fresh if links is None else links.unionByName(fresh)
            fails = verdicts.where(~F.col("linked")).select("a", "b")
            refuted = fails if refuted is None else refuted.unionByName(fails)
            roots = store(components(links), "roots")
        return proposed

    verified(store(_jobs(_first_members(memberships), points, homes, cut, True), "jobs"), 1)
    jobs, most = store(_jobs(_unsettled(memberships, roots), points, homes, cut, False), "jobs"), 1
    while not jobs.isEmpty():
        flagged = verified(jobs, most).where("job is not null").select("job")
        if flagged.isEmpty():
            break
        jobs = store(_left_over(jobs, flagged, roots), "jobs")
        most *= AGAIN
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    least = F.struct(F.col("holder").isNull().alias("none"), "holder", "node")
    smallest = holders.join(roots, "node").groupBy("root").agg(F.min(least).alias("least"))
    of_node = holders.join(roots.join(smallest, "root").select("node", "least"), "node", "left")
    least = F.coalesce("least", least)
    of_node = of_node.select("node", least["holder"].alias("component_id"), least["node"].alias("keep_node"))
    return members.select("doc_id", "n", "node"), of_node


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    members, of_node = _linked(docs, id_col, text_col)
    return members.join(of_node, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows that stay of each component, those of the smallest id, with all columns.

    Rows are told apart by id and set, so a text stays that only shares its id with a near copy.
    With `repeats`, all rows of the smallest id stay, and all rows without an id. Without, exactly
    one row of a component stays: of the smallest id (null is larger than any other) that of the
    smallest node, and one of the rows that have both. Rows of the empty set all stay.
    """
    members, of_node = _linked(docs, id_col, text_col)
    pairs = members.where("n > 0").groupBy("doc_id", "node").agg(F.count("*").alias("copies")).join(of_node, "node")
    goes = F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))
    if not repeats:
        goes = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("keep_node")))
        pairs = pairs.where(goes | (F.col("copies") > 1))
    else:
        pairs = pairs.where(goes)
    pairs = store(pairs.select("doc_id", "node", goes.alias("goes")), "near_copies")
    # Only rows with the id of such a pair (and few others) are cut into shingles again and compared.
    bitmap = id_filter(pairs, "doc_id")
    doubtful = _with_node(passing(docs, bitmap, id_col), text_col)
    gone = pairs.where("goes").select(F.col("doc_id").alias("__id"), F.col("node").alias("__gone"))
    match = doubtful[id_col].cast("long").eqNullSafe(gone["__id"]) & (doubtful["__node"] == gone["__gone"])
    stay = doubtful.join(gone, match, "left_anti")
    if not repeats:
        own = F.when(F.col("__node").isNull(), F.monotonically_increasing_id())
        stay = stay.withColumn("__own", own).dropDuplicates([id_col, "__node", "__own"]).drop("__own")
    return passing(docs, bitmap, id_col, among=False).unionByName(stay.drop("__node"))


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    return similar_groups(docs)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS MATERIALIZED (SELECT s.doc_id, n, hash(s) AS h, s FROM s JOIN n USING (doc_id)),
q AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.h = y.h AND x.s = y.s AND x.doc_id < y.doc_id
  WHERE 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
p AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id, n.n
"""
