"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, each by its own codebook; a pair of centroids is
a cell, and every vector lies in the cell of its two nearest centroids. For a query the pairs are
visited in ascending order of the sum of the two squared distances, which a heap yields without
forming all pairs, until the visited cells hold enough entries. Those entries are then ranked by
their exact distance on the original vectors.

Codebooks are fitted by k-means on at most SAMPLE rows, chosen by the hash of their ids; every row is
indexed. How many entries are enough is a share of all entries, settled on the same sample: sampled
queries are compared by brute force with the sample, and the share is what found TARGET of their true
neighbours. In a denser table the true neighbours lie nearer, so the whole table does no worse.

Cells are dealt to homes of about HOME_BYTES of vectors, large cells to several homes; a query is
sent once to each home that holds one of its cells, with the list of these cells, and queries are dealt
into blocks of the same size. A task ranks one home's entries for one block's queries, so neither
a hot cell nor a hot query gathers in one task. Of equal vectors only the k + 1 rows of the smallest
ids can be among the k nearest of any other row (ties go to the smaller id), so only those are kept.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows
without an id take no part, neither as queries nor as candidates; of vectors of several lengths only
those of the most frequent length do (the smaller on a tie); of rows that share an id the one of the
least vector (by its bytes) counts; fewer candidates than k are all returned; empty tables give none;
other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.chunks import ragged
from tallybook.llm.common import limited
from tallybook.session import store

NEAREST = 10
SAMPLE = 16_384
SAMPLED_QUERIES = 256
TARGET = 0.96
CENTROIDS = 256  # of a half, at most
CELL_ENTRIES = 16  # aimed at for a cell
ROUNDS = 12
HOME_BYTES = 8 * 1024 * 1024


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _centroids(points: np.ndarray, count: int) -> np.ndarray:
    """k-means from evenly spaced rows of the sample; a centroid that loses all points stays where it was."""
    centroids = points[np.linspace(0, len(points) - 1, count).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        nearest = squared(points, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=count)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


class Codebooks:
    """Two codebooks; a cell is first * count + second."""

    def __init__(self, sample: np.ndarray, rows: int):
        # More rows, more cells; two equal halves of the exponent, and no more than the sample can tell apart.
        self.count = int(min(max(round((rows / CELL_ENTRIES) ** 0.5), 1), CENTROIDS, len(sample)))
        self.half = sample.shape[1] // 2
        self.books = [_centroids(part, self.count) for part in self._halves(sample)]

    def _halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, : self.half], vectors[:, self.half :]]

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [squared(part, book) for part, book in zip(self._halves(vectors), self.books)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(1) for d in self.distances(vectors))
        return first * self.count + second


def traverse(first: np.ndarray, second: np.ndarray):
    """Cells in ascending order of first[i] + second[j], without forming all pairs.

    A pair is pushed once both its predecessors, the same pair with one side nearer, were taken.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    count = len(b)
    heap, taken = [(x[0] + y[0], 0, 0)], [0] * len(a)  # taken: how many of a row's pairs are out
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i] * count + b[j]
        taken[i] = j + 1
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < count and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def visited(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells of a query's traversal until they hold `enough` entries."""
    found, entries = [], 0
    for cell in traverse(first, second):
        if sizes[cell]:
            found.append(cell)
            entries += int(sizes[cell])
            if entries >= enough:
                break
    return found


def _share(books: Codebooks, sample: np.ndarray, k: int) -> float:
    """Share of entries after which the sample's queries have TARGET of their true neighbours in the sample."""
    queries = np.arange(0, len(sample), max(1, len(sample) // SAMPLED_QUERIES))
    cells = books.cells(sample)
    sizes = np.bincount(cells, minlength=books.count**2)
    first, second = books.distances(sample[queries])
    needed = []
    for q, d in enumerate(squared(sample[queries], sample)):
        d[queries[q]] = np.inf
        true = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        order = np.argsort((first[q][:, None] + second[q][None]).ravel(), kind="stable")
        reached = np.empty(len(sizes), np.int64)
        reached[order] = np.cumsum(sizes[order])
        needed.append(reached[cells[true]])
    needed = np.sort(np.concatenate(needed)) if needed else np.empty(0)
    if not len(needed):
        return 1.0
    return float(needed[min(len(needed) - 1, int(TARGET * len(needed)))]) / len(sample)


@dataclass
class Index:
    """Stored entries (vec_id, vec, cell) and what tells where a query's neighbours lie."""

    entries: DataFrame
    books: Codebooks | None
    sizes: np.ndarray
    share: float
    k: int
    kind: str  # numpy's name of a component's type
    width: int

    @property
    def enough(self) -> int:
        """Entries a query visits; never fewer than could hold k others besides its own."""
        return max(int(np.ceil(self.share * int(self.sizes.sum()))), 2 * self.k + 2)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str, int]:
    """(vec_id, vec) of the rows that take part, vectors as packed bytes; components' type and number."""
    spark = limited(vectors.sparkSession)
    kind = "<f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "<f8"
    component = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{component}>").alias("v"))

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = rows.where("vec_id is not null and v is not null").where(~F.exists("v", odd)).where(F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "vec_id long, vec binary"), kind, 0
    width = lengths["n"]

    def pack(batches):
        size = width * np.dtype(kind).itemsize
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            flat += 0  # minus zero becomes zero: equal vectors have equal bytes
            raw = pa.py_buffer(flat.tobytes())
            offsets = pa.py_buffer((np.arange(batch.num_rows + 1) * size).astype("<i4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "vec"])

    packed = rows.where(F.size("v") == width).mapInArrow(pack, "vec_id long, vec binary")
    packed = store(packed, "vectors")
    repeated = packed.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not repeated.isEmpty():
        packed = packed.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return packed, kind, width


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.float64)


def build(packed: DataFrame, kind: str, width: int, k: int = NEAREST) -> Index:
    """Index of all rows of (vec_id, vec)."""
    spark = packed.sparkSession
    if not width:
        return Index(packed.withColumn("cell", F.lit(0)), None, np.zeros(1, np.int64), 1.0, k, kind, width)
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    sample = _matrix(sample.column("vec"), kind, width)
    books = Codebooks(sample, packed.count())
    shared = spark.sparkContext.broadcast(books)

    def deal(batches):
        for batch in batches:
            cells = shared.value.cells(_matrix(batch.column(1), kind, width)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["vec_id", "vec", "cell"])

    # Spark ranks in each task first: of a vector that many rows share, k + 1 rows a task are sent.
    own = Window.partitionBy("vec").orderBy("vec_id")
    kept = packed.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).drop("place")
    entries = store(kept.mapInArrow(deal, "vec_id long, vec binary, cell int"), "entries")
    sizes = np.zeros(books.count**2, np.int64)
    for row in entries.groupBy("cell").count().collect():  # at most CENTROIDS squared
        sizes[row["cell"]] = row["count"]
    return Index(entries, books, sizes, _share(books, sample, k), k, kind, width)


class Homes:
    """Where each cell's entries lie: homes first[cell] .. first[cell] + spread[cell] - 1."""

    def __init__(self, sizes: np.ndarray, most: int):
        self.first, self.spread = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        home, filled = 0, 0
        for cell in np.flatnonzero(sizes).tolist():
            size = int(sizes[cell])
            if filled and filled + size > most:
                home, filled = home + 1, 0
            self.first[cell], self.spread[cell] = home, -(-size // most)
            home, filled = home + int(self.spread[cell]) - 1, filled + size if size <= most else most
        self.count = home + 1


def _asked(queries: DataFrame, index: Index, shared: Broadcast) -> DataFrame:
    """(home, query_id, vec, cells): each query once for each home that holds cells it visits."""
    kind, width, enough = index.kind, index.width, index.enough

    def run(batches):
        books, sizes, homes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = books.distances(_matrix(batch.column(1), kind, width))
            rows, at, lists = [], [], []
            for q in range(batch.num_rows):
                cells = np.array(visited(first[q], second[q], sizes, enough), np.int64)
                spread = homes.spread[cells]
                home = np.repeat(homes.first[cells], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                order = np.argsort(home, kind="stable")
                home, cells = home[order], np.repeat(cells, spread)[order]
                own, begin = np.unique(home, return_index=True)
                rows += [q] * len(own)
                at += own.tolist()
                lists += [c.astype("<i4").tobytes() for c in np.split(cells, begin[1:])]
            part = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(at, pa.int64()), *part.columns, pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["home", "query_id", "vec", "cells"])

    return queries.mapInArrow(run, "home long, query_id long, vec binary, cells binary")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows (vec_id, vec) of `queries`."""
    spark = index.entries.sparkSession
    if index.books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    k, kind, width = index.k, index.kind, index.width
    at_once = max(64, HOME_BYTES // (width * np.dtype(kind).itemsize))
    # Small tables are spread over the cluster as well.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = Homes(index.sizes, max(64, min(at_once, int(index.sizes.sum()) // parts)))
    blocks = -(-queries.count() // at_once)
    shared = spark.sparkContext.broadcast((index.books, index.sizes, homes))
    asked = _asked(queries.withColumnRenamed("vec_id", "query_id"), index, shared)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).cast("int"))

    def place(batches):
        _, _, homes = shared.value
        for batch in batches:
            cell, salt = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            home = homes.first[cell] + salt % homes.spread[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(home)], ["vec_id", "vec", "cell", "to"])

    salted = index.entries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    placed = salted.mapInArrow(place, "vec_id long, vec binary, cell int, to long")
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))

    def rank(asked: pa.Table, entries: pa.Table) -> pa.Table:
        found = ([], [], [])
        if asked.num_rows and entries.num_rows:
            entries = entries.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            ids, cells, places = entries.column("vec_id").to_numpy(), entries.column("cell").to_numpy(), np.arange(entries.num_rows)
            vectors = _matrix(entries.column("vec").combine_chunks(), kind, width)
            points = _matrix(asked.column("vec").combine_chunks(), kind, width)
            for q, query_id, wanted in zip(points, asked.column("query_id").to_pylist(), asked.column("cells").to_pylist()):
                wanted = np.frombuffer(wanted, "<i4")
                begin, end = np.searchsorted(cells, wanted, "left"), np.searchsorted(cells, wanted, "right")
                rows = ragged(places, begin, end - begin)
                rows = rows[ids[rows] != query_id]
                apart = vectors[rows] - q
                distance = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                order = np.lexsort((ids[rows], distance))[:k]
                found[0].extend([query_id] * len(order))
                found[1].extend(ids[rows][order].tolist())
                found[2].extend(distance[order].tolist())
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), found, kinds)})

    both = asked.groupBy("home", "block").cogroup(placed.groupBy("to", "part"))
    near = both.applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found for each row whose id `every` divides, among all other rows."""
    packed, kind, width = usable(vectors, id_col, vec_col)
    index = build(packed, kind, width, k)
    return search(index, packed.where(F.col("vec_id") % every == 0))


def op12_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
