"""Cross-tokenizer alignment of a byte-level BPE (A) and a merge-type SentencePiece model (B).

A batch's texts are encoded by both tokenizers, and every token gets the byte offset where it starts.
Two `merge_asof` calls, keyed by document, find for each token start the other side's token that
covers it; the union of both directions is every pair of tokens whose byte ranges overlap. Offsets
where tokens of both sides end cut a document's tokens into groups.

Links are counted per pair of ids over the whole corpus: a task adds up its own pairs, and Spark sums
what tasks give. The most frequent pairs, at most FREQUENT, are broadcast, and documents look their
pairs up there; links of other pairs, which are rare, meet their counts in an equi-join. So what is
broadcast has a bound, and no frequent pair gathers its links in one task.

Tokens of A are those of the space followed by the text, strings of special tokens being plain text;
B puts its space in front itself. Documents are kept between the two passes with their distinct id
pairs, packed, and are not encoded again.

Defined cases: a text that is null or empty, or whose tokens' bytes differ on one side from the space
and the text (B writes the blank sign U+2581 as a space), has no tokens: counts of zero and an empty
groups_sha256; a null id stays null; repeated rows each have their result and each count; an empty
table gives none; a text of any length is aligned whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.chunks import byte_bpe_ids, ragged, tokenizer
from tallybook.llm.common import slices, texts_of
from tallybook.llm.sentencepiece_bpe import Encoder, Vocabulary, encoder_of
from tallybook.session import store

FREQUENT = 1 << 20
PENDING = 2_000_000  # pairs a task holds before it adds them up
DISTINCT = 1_000_000  # distinct pairs a task holds before it gives them away


class Surfaces:
    """Bytes of each id, and its decimal digits followed by each separator, as flat arrays."""

    def __init__(self, surfaces: list[bytes]):
        self.sizes = np.array([len(s) for s in surfaces], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(surfaces), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.begins[ids], self.sizes[ids]).tobytes()


_surfaces: dict[str, Surfaces] = {}


def byte_surfaces(path: str) -> Surfaces:
    """Byte-level vocabulary: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    if path not in _surfaces:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = tokenizer(path, plain=True).get_vocab(with_added_tokens=False)
        found = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            found[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        _surfaces[path] = Surfaces(found)
    return _surfaces[path]


class Separated:
    """Every id's digits with one of the separators behind, in rows of one width."""

    def __init__(self, ids: int, separators: str = ",|;"):
        texts = [f"{i}{s}".encode() for i in range(ids) for s in separators]
        self.count, self.sizes = len(separators), np.array([len(t) for t in texts], np.int64)
        self.width = int(self.sizes.max())
        self.rows = np.frombuffer(b"".join(t.ljust(self.width) for t in texts), np.uint8).reshape(-1, self.width)

    def text(self, ids: np.ndarray, separator: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The whole text, and where each id's part ends."""
        at = ids.astype(np.int64) * self.count + separator
        sizes = self.sizes[at]
        return self.rows[at][np.arange(self.width) < sizes[:, None]].tobytes(), np.cumsum(sizes)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all tokens whose byte ranges overlap.

    Both have (doc, start, at): document, start and place of each token, ordered by document and start,
    starts counted on from document to document. Within a document the two sides cover the same bytes.
    """
    right = {"start": "there", "at": "of"}
    forth = pd.merge_asof(a, b.rename(columns=right), left_on="start", right_on="there", by="doc")
    back = pd.merge_asof(b, a.rename(columns=right), left_on="start", right_on="there", by="doc")
    back = back[back["there"] != back["start"]]  # tokens that start together are in `forth`
    of_a = np.concatenate([forth["at"].to_numpy(), back["of"].to_numpy()])
    of_b = np.concatenate([forth["of"].to_numpy(), back["at"].to_numpy()])
    return of_a.astype(np.int64), of_b.astype(np.int64)


class Aligned:
    """Alignment of a slice's documents; ids are in document order, and both sides cover the same bytes."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.documents = len(a)
        self.counts = [np.array([len(i) for i in side], np.int64) for side in (a, b)]
        self.ids = [np.concatenate(side).astype(np.int64) if side else np.empty(0, np.int64) for side in (a, b)]
        tables, ends = [], []
        for ids, counts, sizes in zip(self.ids, self.counts, (sizes_a, sizes_b)):
            ends.append(np.cumsum(sizes[ids]))
            doc = np.repeat(np.arange(self.documents), counts)
            tables.append(pd.DataFrame({"doc": doc, "start": ends[-1] - sizes[ids], "at": np.arange(len(ids))}))
        self.link_a, self.link_b = overlaps(*tables)
        self.doc_of_a = tables[0]["doc"].to_numpy()
        self.link_doc = self.doc_of_a[self.link_a]
        # Whether a token ends where one of the other side does: it closes its group.
        self.closes = []
        for own, other in (ends, ends[::-1]):
            met = np.zeros(int(other[-1]) + 1 if len(other) else 1, bool)
            met[other] = True
            self.closes.append(met[own])

    def n_links(self) -> np.ndarray:
        return np.bincount(self.link_doc, minlength=self.documents)

    def n_groups(self) -> np.ndarray:
        return np.bincount(self.doc_of_a[self.closes[0]], minlength=self.documents)

    def groups(self, separated: Separated) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        group_a, group_b = (np.cumsum(c) - c for c in self.closes)
        upto_a, upto_b = (np.flatnonzero(c) + 1 for c in self.closes)  # a side's tokens in the groups up to this one
        # A token stands behind its own side's earlier ones and the other side's of earlier (or, in B, these) groups.
        place_a = np.arange(len(group_a)) + np.concatenate([[0], upto_b])[group_a]
        place_b = np.arange(len(group_b)) + upto_a[group_b]
        ids = np.empty(len(group_a) + len(group_b), np.int64)
        separator = np.zeros(len(ids), np.int64)
        ids[place_a], ids[place_b] = self.ids
        separator[place_a[upto_a - 1]], separator[place_b[upto_b - 1]] = 1, 2
        text, ends = separated.text(ids, separator)
        last = np.cumsum(self.counts[0] + self.counts[1])
        stops = ends[last - 1]
        return [text[x : y - 1] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct id pairs as a * width + b, how many links hold each, documents' ends), document by document."""
        a, b = self.ids
        most = (int(a.max()) + 1) * width if len(a) else 1
        key = self.link_doc * most + a[self.link_a] * width + b[self.link_b]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        doc, pair = np.divmod(key[first], most)
        return pair, np.diff(np.append(first, len(key))), np.cumsum(np.bincount(doc, minlength=self.documents))


class Totals:
    """A task's sums per pair; what it holds is bounded, and a pair may be given more than once."""

    def __init__(self):
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pending, self.size = [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.pending.append((keys, times))
        self.size += len(keys)
        if self.size >= PENDING:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(p[0] for p in self.pending)])
        times = np.concatenate([self.times, *(p[1] for p in self.pending)])
        self.keys, back = np.unique(keys, return_inverse=True)
        self.times = np.bincount(back, times, len(self.keys)).astype(np.int64)
        self.pending, self.size = [], 0

    def give(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        found = self.keys, self.times
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        return found


ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, pair long, links long"
)
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def _rows(size: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in zip(_NAMES, _KINDS)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def encode_both(texts: list[str], path: str, surfaces: Surfaces, encoder: Encoder) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(places of the texts that have tokens, their ids of A, their ids of B)."""
    places = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in places]
    a = byte_bpe_ids(path, spaced, plain=True)
    b = [ids[1:-1] for ids in encoder.encode([texts[i] for i in places])]
    raw = [t.encode() for t in spaced]
    whole = b"".join(raw)
    if surfaces.joined(np.concatenate(a)) == whole == encoder.surfaces(np.concatenate(b)) if places else True:
        # Equal as a whole; each document is, if its sides are as long as its text.
        sizes = np.array([len(r) for r in raw])
        fits = [surfaces.sizes[x].sum() == n == encoder.sizes[y].sum() for x, y, n in zip(a, b, sizes)]
    else:
        fits = [surfaces.joined(x) == r == encoder.surfaces(y) for x, y, r in zip(a, b, raw)]
    return ([p for p, f in zip(places, fits) if f], [x for x, f in zip(a, fits) if f], [y for y, f in zip(b, fits) if f])


def align(docs: DataFrame, tokenizer_path: str, model_path: str) -> tuple[DataFrame, int]:
    """Stored rows of documents with their packed id pairs, and of pairs with tasks' sums; and B's number of ids."""
    rows = texts_of(docs)
    vocabulary = Vocabulary(model_path)
    width = len(vocabulary.surface)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder, surfaces = encoder_of(model_path, shared), byte_surfaces(tokenizer_path)
        separated = Separated(max(width, len(surfaces.sizes)))
        totals, number = Totals(), TaskContext.get().partitionId() << 33
        for batch, texts in slices(batches):
            size = len(texts)
            places, a, b = encode_both(texts, tokenizer_path, surfaces, encoder)
            counts = np.zeros((4, size), np.int64)
            digests, pairs, times = [""] * size, [b""] * size, [b""] * size
            if places:
                found = Aligned(a, b, surfaces.sizes, encoder.sizes)
                counts[:, places] = [*found.counts, found.n_groups(), found.n_links()]
                key, often, stops = found.pairs(width)
                totals.add(key, often)
                texts_of_groups = found.groups(separated)
                for p, group, k, t in zip(places, texts_of_groups, np.split(key, stops[:-1]), np.split(often, stops[:-1])):
                    digests[p] = hashlib.sha256(group).hexdigest()
                    pairs[p], times[p] = _packed(k), _packed(t)
            yield _rows(
                size, row=number + np.arange(size), doc_id=batch.column(0), n_a=counts[0], n_b=counts[1],
                n_groups=counts[2], n_links=counts[3], groups_sha256=digests, pairs=pairs, times=times,
            )
            number += size
            if len(totals.keys) >= DISTINCT:
                yield _sums(totals)
        yield _sums(totals)

    return store(rows.mapInArrow(run, ALIGNED), "aligned"), width


def _sums(totals: Totals) -> pa.RecordBatch:
    keys, times = totals.give()
    return _rows(len(keys), pair=keys, links=times)


def _packed(values: np.ndarray) -> bytes:
    """One byte of width, then the values in that width."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype("u1")
    return bytes([kind.itemsize]) + values.astype(f"<u{kind.itemsize}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.empty(0, np.int64)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, links, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    summed = aligned.where("pair is not null").groupBy("pair").agg(F.sum("links").alias("links"))
    summed = store(summed.withColumn("b", F.col("pair") % width), "pair_links")
    most = summed.groupBy("b").agg(F.max("links").alias("most"))
    return store(summed.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pair_counts")


def _looked_up(rows: DataFrame, table) -> DataFrame:
    """Documents with the sums over the pairs that are in the broadcast table."""

    def run(batches):
        keys, links, best = table.value
        for batch in batches:
            counts, sums = [], []
            for raw, often in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                pairs, times = _unpacked(raw.as_py()), _unpacked(often.as_py())
                hit, at = _places(keys, pairs)
                times, at = times[hit], at[hit]
                sums.append(int((times * links[at]).sum()))
                counts.append(int(times[best[at]].sum()))
            own = [pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *own], [*batch.schema.names[:-2], "n_best", "count_sum"])

    kept = ", ".join(ALIGNED.split(", ")[:7])
    return rows.mapInArrow(run, f"{kept}, n_best long, count_sum long")


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _rest(rows: DataFrame, table) -> DataFrame:
    """(row, pair, times) of the pairs that the broadcast table lacks."""

    def run(batches):
        keys = table.value[0]
        for batch in batches:
            for row, raw, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pairs, times = _unpacked(raw.as_py()), _unpacked(often.as_py())
                miss = ~_places(keys, pairs)[0]
                if miss.any():
                    columns = [np.full(int(miss.sum()), row), pairs[miss], times[miss]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "pair", "times"])

    return rows.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")


def alignments(docs: DataFrame, tokenizer_path: str, model_path: str, frequent: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document."""
    spark = docs.sparkSession
    most = FREQUENT if frequent is None else frequent
    aligned, width = align(docs, tokenizer_path, model_path)
    counts = pair_counts(aligned, width)
    often = counts.orderBy(F.desc("links"), "pair").limit(most).toArrow()
    keys = often.column("pair").to_numpy()
    order = np.argsort(keys)
    best = often.column("best").to_numpy(zero_copy_only=False).astype(bool)
    table = spark.sparkContext.broadcast((keys[order], often.column("links").to_numpy()[order], best[order]))
    rows = aligned.where("row is not null").select(*_NAMES[:9])
    found = _looked_up(rows, table)
    if counts.count() > len(keys):
        late = _rest(rows, table).join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("links")).alias("more_sum"),
        )
        zero = F.lit(0).cast("long")
        found = found.join(late, "row", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("more_best", zero),
                "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero),
            }
        )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(docs: DataFrame, tokenizer_path: str | None = None, model_path: str | None = None) -> DataFrame:
    if tokenizer_path is None or model_path is None:
        import public_tokenizers

        tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return alignments(docs, tokenizer_path, model_path)
