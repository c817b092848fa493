"""Language ID and the quality classifier: held-out accuracy, defined cases, gradients."""

import numpy as np
import pytest

from tallybook.llm import language_id, quality
from tallybook.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def test_language_id_on_held_out_rows(spark):
    docs = table(spark, SF_DIR, "documents")
    found = language_id.op4_language_id(docs).where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    long = [r for r in found if r["n_chars"] >= 30]
    assert len(long) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in long]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_cases(spark):
    layout = "doc_id long, text string, lang string, source string, lang_pred string, letters int"
    rows = [(i, "the quick brown fox and the dog " * 3 if i % 2 else "der schnelle braune fuchs und der hund " * 3, "en" if i % 2 else "de", None, "x", 1) for i in range(60)]
    odd = [(100, None, "en", None, "x", 1), (101, "", None, None, "x", 1), (102, "1234 !?", "de", None, "x", 1), (None, "und der", None, None, "x", 1), (103, "fox", None, None, "x", 1), (104, "the dog and " * 9_000, None, None, "x", 1), (3, rows[3][1], "en", None, "x", 1)]
    docs = spark.createDataFrame(rows + odd, layout)
    found = language_id.op4_language_id(docs).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by_id[100]["score"] == 0
    assert by_id[104]["lang_pred"] == "en" and by_id[None]["held_out"]
    assert {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    none = language_id.op4_language_id(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = language_id.op4_language_id(docs.where("lang = 'en'")).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"}
    assert language_id.op4_language_id(docs.limit(0)).isEmpty()


def test_gradients():
    r = np.random.default_rng(0)
    net, x, y = language_id.Network(3), r.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        model = {k: v.astype(np.float64) for k, v in net.p.items()}
        e = model["embed"][x]
        pooled = []
        for w in language_id.WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(4, -1, w * language_id.EMBEDDED)
            pooled.append(np.maximum((cols @ model[f"w{w}"] + model[f"b{w}"]).max(1), 0))
        logits = np.concatenate(pooled, 1) @ model["out"] + model["out_b"]
        return float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(4), y]))

    grads = net.step(x, y)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-5
        up = loss()
        net.p[name][at] = kept - 1e-5
        down = loss()
        net.p[name][at] = kept
        assert (up - down) / 2e-5 == pytest.approx(grad[at], rel=1e-3, abs=1e-7)
    prob = language_id.probabilities(net.folded(), x)
    assert np.mean(-np.log(prob[np.arange(4), y])) == pytest.approx(loss(), rel=1e-4)


def test_windows_cover_the_text():
    for n in (0, 1, 3, 255, 256, 257, 1000, 5000):
        cut, weights = language_id.windows_of((bytes(range(1, 251)) * 30)[:n])
        assert cut.shape[1] == language_id.WINDOW and weights.sum() == max(n, 1)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    found = quality.op7_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in found if r["quality"] == 1]
    bad = [r["score"] for r in found if r["quality"] == 0]
    assert len(bad) >= 5 and np.mean([s >= 0.3 for s in good]) >= 0.98 and np.mean([s < 0.3 for s in bad]) >= 0.8
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98


def test_quality_cases(spark):
    clean, junk = "A calm sentence of plain words, then another one.", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"
    rows = [(i, (clean if i % 2 else junk) + f" {i}", 1, "x") for i in range(80)]
    odd = [(200, None, 1, "x"), (201, "", 1, "x"), (None, clean, 1, "x"), (202, " \n ", 1, "x"), (203, clean * 5_000, 1, "x"), (1, rows[1][1], 1, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, label int, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(5, None, 0), (6, 9, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.op7_quality(docs, labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[203]["predicted"] == 1 and by_id[10]["predicted"] == 0 and by_id[None]["held_out"]
    assert by_id[200]["score"] == by_id[201]["score"] == by_id[202]["score"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in found)
    none = quality.op7_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.op7_quality(docs.limit(0), labels).isEmpty()


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(1)
    examples = []
    for _ in range(400):
        label = int(r.integers(0, 2))
        at = np.unique(r.integers(100, 5_000, 20))
        examples.append((np.append(at, [label, 1 << quality.BITS]), np.ones(len(at) + 2), label))
    w = quality.train(examples)
    assert np.mean([(x @ w[at] > 0) == label for at, x, label in examples]) > 0.98 and (w != 0).sum() < 4_000
