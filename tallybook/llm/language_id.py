"""Language ID with a byte convolutional network.

Network: byte embedding, filters of several widths over it, ReLU, the largest activation of each
filter over a window, softmax. It is trained here in numpy (Adam) on windows of labelled texts.
Prediction cuts the whole text, as UTF-8 bytes, into windows of fixed length that overlap by the
widest filter less one, runs all windows of a batch together, and averages their probabilities by
the bytes they cover. For prediction embedding and filters are folded into one table per filter
position, so a convolution is a sum of table rows.

Learning uses rows of non-null `lang` outside the held-out fold: about `sample_rows` rows of each
language, chosen by a hash of the id, and of each at most three windows. That bounds what the driver
gets; the texts' other rows and the held-out fold play no part.

Defined cases: a null text or one without any letter is `und` with score 0; short texts are one
window padded with zero bytes; a null id is in the held-out fold; with one learned language the
answer is that language; with none everything is `und`; repeated rows each have their prediction; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fold, limited, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
SAMPLE_ROWS = 400
UNKNOWN = "und"


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, weight of each: the bytes that no earlier window has)."""
    step = WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(raw) - max(WIDTHS) + 1) // step))
    padded = np.zeros((count - 1) * step + WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    weights = np.full(count, step, np.float64)
    weights[-1] = max(len(raw) - (count - 1) * step, 1)
    return cut, weights


class Network:
    """Parameters: embedding (256, E), one (width * E, F) matrix and bias per width, output layer."""

    def __init__(self, languages: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBEDDED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDED), (w * EMBEDDED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = r.normal(0, 0.3, (FILTERS * len(WIDTHS), languages))
        self.p["out_b"] = np.zeros(languages)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of windows x (n, WINDOW) with classes y."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        seen, pooled = {}, []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # n, positions, E, w
            cols = cols.transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDED)
            act = cols @ p[f"w{w}"] + p[f"b{w}"]
            at = act.argmax(1)
            top = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
            seen[w] = (cols, at, top)
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["out_b"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "out_b": d.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = d @ p["out"].T
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            cols, at, top = seen[w]
            dt = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            chosen = cols[rows, at]  # n, F, w * E
            g[f"w{w}"] = np.einsum("nfk,nf->kf", chosen, dt)
            g[f"b{w}"] = dt.sum(0)
            back = (dt[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDED)
            bytes_at = x[rows[:, :, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["embed"], bytes_at, back)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 48, rate: float = 0.01, seed: int = 9) -> Network:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        by_class = [np.flatnonzero(y == c) for c in range(int(y.max()) + 1)]
        for t in range(1, steps + 1):
            classes = r.integers(0, len(by_class), batch)  # every language as often
            pick = np.array([r.choice(by_class[c]) for c in classes])
            xb = x[pick].copy()
            # Short texts are padded windows: cut some examples the same way.
            short = r.random(batch) < 0.35
            keep = r.integers(8, WINDOW, batch)
            xb[(np.arange(WINDOW)[None] >= keep[:, None]) & short[:, None]] = 0
            for k, g in self.step(xb, y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                scale = rate * (1 - t / (steps + 1))
                self.p[k] -= scale * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def folded(self) -> dict[str, np.ndarray]:
        """Tables for prediction: for each width and place in the filter, what a byte adds to each filter."""
        tables = {
            f"t{w}": np.stack(
                [self.p["embed"] @ self.p[f"w{w}"][k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(w)]
            ).astype(np.float32)
            for w in WIDTHS
        }
        return tables | {k: a.astype(np.float32) for k, a in self.p.items() if k[0] in "bo"}


def probabilities(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows (n, WINDOW), some at a time."""
    out = []
    for begin in range(0, len(x), 256):
        part = x[begin : begin + 256].astype(np.intp)
        pooled = []
        for w in WIDTHS:
            size = WINDOW - w + 1
            act = np.take(model[f"t{w}"][0], part[:, :size], axis=0)
            for k in range(1, w):
                act += np.take(model[f"t{w}"][k], part[:, k : k + size], axis=0)
            while size > 1:  # the maximum by halves stays vectorised
                half = size // 2
                np.maximum(act[:, :half], act[:, size - half : size], out=act[:, :half])
                size -= half
            pooled.append(np.maximum(act[:, 0] + model[f"b{w}"], 0))
        logits = np.concatenate(pooled, 1) @ model["out"] + model["out_b"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        out.append(e / e.sum(1, keepdims=True))
    return np.concatenate(out)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, lang_col: str = "lang"):
    """(languages, model) from `docs` (doc_id, text, lang)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return [], {}
    share = F.element_at(
        F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, sample_rows / counts[k]))]), F.col(lang_col)
    )
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    length = F.length("text")
    # Three windows of characters: the start, and two places drawn by a hash of the id.
    places = [F.pmod(F.xxhash64("doc_id", F.lit(s)), F.greatest(length - WINDOW, F.lit(1))) for s in (1, 2)]
    places = [F.lit(1), *[(p + 1).cast("int") for p in places]]
    cuts = F.array(*[F.substring("text", p, F.lit(WINDOW)) for p in places])
    chosen = labelled.where(unit < share).select("doc_id", lang_col, F.explode(F.array_distinct(cuts)).alias("part"))
    rows = sorted((r[1], r[2].encode()[:WINDOW]) for r in chosen.where(F.length("part") > 0).collect())
    if len({lang for lang, _ in rows}) < 2:
        return languages[:1], {}
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, part) in enumerate(rows):
        x[i, : len(part)] = np.frombuffer(part, np.uint8)
    known = sorted({lang for lang, _ in rows})
    y = np.array([known.index(lang) for lang, _ in rows])
    return known, Network(len(known)).fit(x, y).folded()


def predict(docs: DataFrame, languages: list[str], model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of `docs` (doc_id, text)."""
    limited(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def run(batches):
        for batch, texts in slices(batches):
            letters = batch.column(2).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            asked = [i for i, ok in enumerate(letters) if ok and languages]
            if asked and len(languages) == 1:
                for i in asked:
                    names[i], scores[i] = languages[0], 1.0
            elif asked:
                cut = [windows_of(texts[i].encode()) for i in asked]
                prob = probabilities(shared.value, np.concatenate([c[0] for c in cut]))
                weights = np.concatenate([c[1] for c in cut])
                starts = np.cumsum([0] + [len(c[1]) for c in cut[:-1]])
                mean = np.add.reduceat(prob * weights[:, None], starts, axis=0)
                mean /= np.add.reduceat(weights, starts)[:, None]
                for i, at, top in zip(asked, mean.argmax(1), mean.max(1)):
                    names[i], scores[i] = languages[at], min(float(top), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(docs: DataFrame) -> DataFrame:
    limited(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    languages, model = learn(rows)
    return predict(rows.select("doc_id", "text"), languages, model).select(
        "doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score"
    )
