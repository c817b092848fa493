"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Tokens are runs of letters and digits (bytes above 127 count as letters) and runs of other visible
bytes, lower-cased A-Z. Features, hashed into 2**BITS places: words, pairs of neighbouring words (a
word and itself again is one feature for all words), and pairs of word shapes (case, kind, length
class). A document is its feature counts divided by its number of tokens; a score is a sparse dot
product, taken over the whole text.

Learning: at most `sample_rows` labelled rows of each label, taken by a hash of the id from those
outside the held-out fold, with texts of at most `sample_chars` characters (the bound on what the
driver gets). The intercept is moved from the sample's share of labels to that of all training rows.

Defined cases: null text is empty; a text without tokens has the intercept alone; a null id is in
the held-out fold; labels other than 0 and 1 are not learned; without labels of both kinds every
score is the share of label 1 (0.5 without any); repeated rows each have their score; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fold, slices, texts_of
from tallybook.llm.shingles import mix, runs

BITS = 18
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 16_000
THRESHOLD = 0.3
SCALE = 64.0

# Byte classes: 0 white space and control, 1 letters and digits, 2 other visible bytes.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
_CLASS[128:] = 1
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _CLASS[_first : _last + 1] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature places of all texts in order, where each text's end, and the numbers of tokens."""
    hashes, begin, end, buffer, stops = runs(texts, _CLASS)
    tokens = np.diff(stops, prepend=0)
    if not len(hashes):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64), tokens
    uppers = np.concatenate([[0], np.cumsum(_UPPER[buffer])])
    upper, size = uppers[end] - uppers[begin], end - begin
    case = np.where(upper == 0, 0, np.where(upper == size, 3, np.where(_UPPER[buffer[begin]] == 1, 1, 2)))
    shape = (_CLASS[buffer[begin]].astype(np.uint64) * 4 + case.astype(np.uint64)) * 8
    shape += np.minimum(np.log2(size).astype(np.uint64), 7)
    previous = np.roll(hashes, 1)
    first = stops[:-1][tokens[1:] > 0] if len(stops) > 1 else np.empty(0, np.int64)
    starts = np.zeros(len(hashes), bool)
    starts[0] = True
    starts[first[first < len(hashes)]] = True
    previous[starts] = 0
    shape_before = np.roll(shape, 1)
    shape_before[starts] = 1000
    pair = mix(previous * np.uint64(0x9E3779B97F4A7C15) + hashes)
    pair[previous == hashes] = 7
    shapes = mix(shape_before * np.uint64(4096) + shape + np.uint64(1 << 40))
    found = np.stack([hashes, pair, shapes], 1).reshape(-1)
    return (mix(found) >> np.uint64(64 - BITS)).astype(np.int64), stops * 3, tokens


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept) by per-coordinate FTRL-proximal updates over sparse rows."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        push = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, push / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, label in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int):
    """Examples as sparse rows, and the numbers of training labels of each kind."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (fold() != 0))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    short = docs.where(F.length("text") <= sample_chars)
    places = "label int, at binary, n binary"

    def rows(batches):
        for batch, texts in slices(batches):
            found, stops, tokens = features([t.encode() for t in texts])
            ats, ns = [], []
            for part, size in zip(np.split(found, stops[:-1]), tokens):
                at, n = np.unique(part, return_counts=True)
                ats.append(at.astype("<i4").tobytes())
                ns.append((n * (SCALE / max(int(size), 1))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("label")), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())],
                ["label", "at", "n"],
            )

    examples = []
    for label in (0, 1):
        # At most sample_rows ids: a proven bound for the broadcast and for the driver.
        order = F.xxhash64("doc_id")
        chosen = known.where(F.col("label") == label).select("doc_id", "label").distinct()
        chosen = chosen.orderBy(order, "doc_id").limit(sample_rows)
        joined = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
        examples += joined.mapInArrow(rows, places).collect()
    parsed = [
        (
            np.append(np.frombuffer(r["at"], "<i4").astype(np.int64), 1 << BITS),
            np.append(np.frombuffer(r["n"], "<f4").astype(float), 1.0),
            r["label"],
            bytes(r["at"]) + bytes(r["n"]),
        )
        for r in examples
    ]
    # Rows arrive in any order: sort by content, then shuffle with a fixed seed.
    parsed.sort(key=lambda e: (e[2], e[3]))
    order = np.random.default_rng(7).permutation(len(parsed))
    return [parsed[i][:3] for i in order], counts


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights with the intercept last; `docs` is (doc_id, text)."""
    examples, counts = _sample(docs, labels, sample_rows, sample_chars)
    good, bad = counts.get(1, 0), counts.get(0, 0)
    drawn = [e[2] for e in examples]
    if not good or not bad or len(set(drawn)) < 2:
        weights = np.zeros((1 << BITS) + 1)
        share = good / (good + bad) if good + bad else 0.5
        weights[-1] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return weights
    weights = train(examples)
    weights[-1] += np.log(good / bad) - np.log(sum(drawn) / (len(drawn) - sum(drawn)))
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value
        for batch, texts in slices(batches):
            found, stops, tokens = features([t.encode() for t in texts])
            sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
            total = sums[stops] - sums[np.concatenate([[0], stops[:-1]])]
            logit = total * (SCALE / np.maximum(tokens, 1)) + float(w[-1])
            scores = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = texts_of(docs)
    return score(rows, fit(rows, labels)).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns. One pass, no join."""
    rows = texts_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels).astype(np.float32))

    def run(batches):
        w = shared.value
        for batch, texts in slices(batches):
            found, stops, tokens = features([(t or "").encode() for t in texts])
            sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
            total = sums[stops] - sums[np.concatenate([[0], stops[:-1]])]
            logit = total * (SCALE / np.maximum(tokens, 1)) + float(w[-1])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
