"""Ranked lexical search with FP-trees of documents.

Every document is restricted to the terms that search items hold and written as the list of those
terms in descending order of document frequency. Sorted, such lists share the paths of a trie; equal
ones are one leaf. A node keeps the largest count (tf) of every term that occurs below it and the
smallest length norm (m). A term's gain grows with tf and falls with m, so the gains of a node's
maxima at its least m bound the score of every document below it.

Per item the search goes depth first, the child with the most promising bounds first, and leaves a
subtree out as soon as its bound is below the item's k-th best score so far. All items of a block
walk a tree together, each with its own bounds and its own best list: the bounds of a node for all
items are one gather over the node's terms.

Documents stay where they are read: a task builds trees of about HELD postings from its own rows,
carries the best lists from tree to tree and gives at most k rows an item; the best of those are the
result. Items are searched in blocks of about BLOCK_TERMS terms, so what is sent to executors has a
bound however many items there are; a block costs one scan of the texts.

Defined cases: a null text has no terms; documents and items without terms, and items that no
document scores on, give no rows; rows that share a document id are each a document (with a null id
they rank behind all others of the same score); rows that share an item id (null too) are one item
with the terms of all of them; empty tables give none; a text of any length is read whole; other
columns are not read. Terms are looked up by a 64-bit hash and their first seven bytes and length.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.chunks import ragged
from tallybook.llm.common import limited, slices, texts_of
from tallybook.llm.shingles import runs, spans_hash
from tallybook.session import store

TOP = 20
BLOCK_TERMS = 200_000
HELD = 400_000
FEW = 8  # a subtree of so many leaves is a list of them
NO_ID = np.iinfo(np.int64).max

# Terms are runs of ASCII digits and letters and of all bytes of other characters.
_TERM = np.zeros(256, np.uint8)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _checks(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length (up to 255) and first seven bytes, lower-cased, of each span."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    sizes = end - begin
    found = np.minimum(sizes, 255).astype(np.uint64)
    for k in range(7):
        found |= np.where(k < sizes, _LOWER[padded[begin + k]], 0).astype(np.uint64) << np.uint64(8 * (k + 1))
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times): the terms of each item, lower-cased, as bytes."""

    def cut(batches):
        for batch, texts in slices(batches):
            _, begin, end, buffer, stops = runs([t.encode() for t in texts], _TERM)
            raw = _LOWER[buffer].tobytes()
            of = np.searchsorted(stops, np.arange(len(begin)), "right")
            terms = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(terms, pa.binary())], ["item_id", "term"]
            )

    rows = texts_of(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Terms:
    """A block's distinct terms, to be found by hash."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        ends = np.cumsum([len(t) for t in terms])
        buffer = np.frombuffer(b"".join(terms), np.uint8)
        begins = ends - np.array([len(t) for t in terms], np.int64)
        keys = spans_hash(buffer, begins, ends)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.checks = _checks(buffer, begins, ends)[self.order]

    def find(self, hashes: np.ndarray, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms, their numbers)."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        hit = hit[_checks(buffer, begin[hit], end[hit]) == self.checks[at[hit]]]
        return hit, self.order[at[hit]]


VECTORS = "doc_id long, n long, terms binary, tfs binary, term int, df long, counted long, length long"


def _vectors(rows: DataFrame, known) -> DataFrame:
    """Restricted vectors of documents, and at each task's end its document frequencies and totals."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in VECTORS.split(", ")]

    def row_batch(size: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        terms = known.value
        df, counted, length = np.zeros(len(terms.terms), np.int64), 0, 0
        for batch, texts in slices(batches):
            hashes, begin, end, buffer, stops = runs([t.encode() for t in texts], _TERM)
            sizes = np.diff(stops, prepend=0)
            counted += int((sizes > 0).sum())
            length += int(sizes.sum())
            hit, number = terms.find(hashes, buffer, begin, end)
            key = np.searchsorted(stops, hit, "right").astype(np.int64) * len(terms.terms) + number
            key, tf = np.unique(key, return_counts=True)
            of, number = key // len(terms.terms), (key % len(terms.terms)).astype("<u4")
            df += np.bincount(number, minlength=len(df))
            docs, first = np.unique(of, return_index=True)
            tf = tf.astype("<u4")
            yield row_batch(
                len(docs), doc_id=batch.column(0).take(pa.array(docs)), n=sizes[docs],
                terms=[x.tobytes() for x in np.split(number, first[1:])] if len(docs) else [],
                tfs=[x.tobytes() for x in np.split(tf, first[1:])] if len(docs) else [],
            )
        seen = np.flatnonzero(df)
        yield row_batch(len(seen), term=seen, df=df[seen])
        yield row_batch(1, counted=[counted], length=[length])

    return rows.mapInArrow(run, VECTORS)


def gains(tf: np.ndarray, m) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Ranking:
    """What a block's search needs everywhere: order and items of its terms, and the corpus totals."""

    def __init__(self, terms: int, df: np.ndarray, documents: int, length: int, of_item: np.ndarray, of_term: np.ndarray, times: np.ndarray, items: list):
        self.documents, self.length, self.items = documents, length, items
        weight = np.array([int(math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1)))) for d in df.tolist()], np.int64)
        # Terms by descending document frequency; without a weight or a document they add nothing.
        useful = np.flatnonzero((df > 0) & (weight > 0))
        useful = useful[np.argsort(-df[useful], kind="stable")]
        self.rank = np.full(terms, -1, np.int64)
        self.rank[useful] = np.arange(len(useful))
        rank = self.rank[of_term]
        keep = np.flatnonzero(rank >= 0)
        keep = keep[np.argsort(rank[keep], kind="stable")]
        self.item, self.weight = of_item[keep], (weight[of_term] * times)[keep]
        self.sizes = np.bincount(rank[keep], minlength=len(useful))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // max(self.length, 1)

    def scores(self, ranks: np.ndarray, tfs: np.ndarray, m: int) -> np.ndarray:
        """Of all items, for a document of these terms (or the bound for a node of these maxima)."""
        sizes = self.sizes[ranks]
        entry = ragged(np.arange(len(self.item)), self.begins[ranks], sizes)
        added = self.weight[entry] * np.repeat(gains(tfs, m), sizes)
        # Whole numbers far below 2**53: sums in doubles are exact.
        return np.bincount(self.item[entry], added, len(self.items)).astype(np.int64)


class Best:
    """The k best documents of each item so far, equal scores by smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.heaps = k, np.zeros(items, np.int64), [[] for _ in range(items)]

    def may(self, scores: np.ndarray) -> np.ndarray:
        """Items for which a document of this score could still count."""
        return (scores > 0) & (scores >= self.least)

    def offer(self, item: int, score: int, ids: list[int]) -> None:
        heap = self.heaps[item]
        for doc_id in ids:  # ascending: once one is not taken, no later one is
            entry = (score, -doc_id)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


class Tree:
    """FP-tree: leaves are distinct vectors in path order; a node is a run of leaves with a common path."""

    def __init__(self, vectors: list[tuple[bytes, bytes, int, int]]):
        """Vectors are (ranks as big-endian, so that bytes sort as paths do; tfs; m; document id)."""
        self.leaves, self.ids = [], []
        paths, before = [], None
        for path, tfs, m, doc_id in sorted(vectors):
            if before != (path, tfs, m):
                before = (path, tfs, m)
                paths.append(np.frombuffer(path, ">u4").astype(np.int64))
                self.leaves.append((paths[-1], np.frombuffer(tfs, "<u4").astype(np.int64), m))
                self.ids.append([])
            self.ids[-1].append(doc_id)
        self.shared = [0] + [self._common(a, b) for a, b in zip(paths, paths[1:])]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def build(self):
        """The root: (ranks, tf maxima, least m, children or None, leaf or None), children built first."""
        root = (0, len(self.leaves))
        pending, done = [(root, False)], {}
        children: dict[tuple[int, int], list[tuple[int, int]]] = {}
        while pending:
            span, ready = pending.pop()
            begin, end = span
            if end - begin == 1:
                done[span] = (*self.leaves[begin], None, begin)
            elif ready:
                parts = [done.pop(s) for s in children.pop(span)]
                done[span] = (*self._maxima(parts), min(p[2] for p in parts), parts, None)
            else:
                cuts = [begin]
                if end - begin <= FEW:
                    cuts += range(begin + 1, end)
                else:  # a path branches where the neighbours' common part is shortest
                    inner = self.shared[begin + 1 : end]
                    depth = min(inner)
                    cuts += [begin + 1 + i for i, d in enumerate(inner) if d == depth]
                children[span] = list(zip(cuts, [*cuts[1:], end]))
                pending.append((span, True))
                pending += [(s, False) for s in children[span]]
        return done[root]

    @staticmethod
    def _maxima(parts) -> tuple[np.ndarray, np.ndarray]:
        ranks = np.concatenate([p[0] for p in parts])
        tfs = np.concatenate([p[1] for p in parts])
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        if not len(ranks):
            return ranks, tfs
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        return ranks[first], np.maximum.reduceat(tfs[order], first)

    def search(self, ranking: Ranking, best: Best) -> None:
        """Depth first; a subtree is left out once no item's bound reaches that item's k-th best."""
        root = self.build()
        pending = [(root, ranking.scores(*root[:3]))]
        while pending:
            node, bounds = pending.pop()
            alive = best.may(bounds)
            if not alive.any():
                continue
            if node[3] is None:  # a leaf's bound is its score
                for item in np.flatnonzero(alive).tolist():
                    best.offer(item, int(bounds[item]), self.ids[node[4]])
                continue
            below = []
            for child in node[3]:
                reach = ranking.scores(*child[:3])
                if (best.may(reach) & alive).any():
                    below.append((child, reach))
            below.sort(key=lambda c: int(c[1][alive].sum()))  # the last is taken first
            pending += below


def _best_in_task(rows: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score): at most k rows an item from each task; `item` is the item's place in its block."""

    def run(batches):
        ranking = shared.value
        best, held, size = Best(len(ranking.items), k), [], 0

        def settle():
            if held:
                Tree(held).search(ranking, best)

        for batch in batches:
            norms = ranking.norm(batch.column(1).to_numpy(zero_copy_only=False))
            for doc_id, m, terms, tfs in zip(batch.column(0).to_pylist(), norms.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ranks = ranking.rank[np.frombuffer(terms, "<u4")]
                order = np.argsort(ranks)
                order = order[ranks[order] >= 0]
                if not len(order):
                    continue
                tfs = np.frombuffer(tfs, "<u4")[order].tobytes()
                held.append((ranks[order].astype(">u4").tobytes(), tfs, m, NO_ID if doc_id is None else doc_id))
                size += len(order)
                if size >= HELD:
                    settle()
                    held, size = [], 0
        settle()
        found = [(i, -e[1], e[0]) for i, heap in enumerate(best.heaps) for e in heap]
        columns = list(zip(*found)) or [[]] * 3
        ids = [None if d == NO_ID else d for d in columns[1]]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((columns[0], ids, columns[2]), kinds)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block's items; its terms fit the driver by construction."""
    spark = docs.sparkSession
    found = terms.toArrow()
    items = sorted(set(found.column("item_id").to_pylist()), key=lambda i: (i is None, i))
    of_item, distinct = found.column("item_id").to_pylist(), sorted(set(found.column("term").to_pylist()))
    number, place = {t: i for i, t in enumerate(distinct)}, {v: i for i, v in enumerate(items)}
    of_term = np.array([number[t] for t in found.column("term").to_pylist()], np.int64)
    of_item = np.array([place[i] for i in of_item], np.int64)
    times = found.column("times").to_numpy().astype(np.int64)

    vectors = store(_vectors(docs, spark.sparkContext.broadcast(Terms(distinct))), "restricted")
    totals = vectors.agg(F.sum("counted"), F.sum("length")).first()
    df = np.zeros(len(distinct), np.int64)
    for row in vectors.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    ranking = Ranking(len(distinct), df, totals[0] or 0, totals[1] or 0, of_item, of_term, times, items)
    best = _best_in_task(vectors.where("n is not null").select("doc_id", "n", "terms", "tfs"), spark.sparkContext.broadcast(ranking), k)
    names = spark.createDataFrame(list(enumerate(items)), "item int, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = limited(docs.sparkSession)
    rows = texts_of(docs)
    terms = store(item_terms(items), "item_terms")
    blocks = -(-terms.count() // (block_terms or BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    parts = [terms.where(block_of == b) for b in range(blocks)]
    found = [_block(rows, part, k) for part in parts if blocks == 1 or not part.isEmpty()]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Blocks are stored one by one, so none waits for another's plan.
    found = found if len(found) == 1 else [store(part, "ranked") for part in found]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def op11_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
v AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM v GROUP BY term),
s AS (
  SELECT item_id, r, doc_id, sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * n_docs) // n_terms AS BIGINT))))) AS score
  FROM v JOIN q USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
