"""Ranked lexical search and nearest neighbours against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, lower, plain

from tallybook.llm import lexical_search, nearest
from tallybook.llm.common import table

SF_DIR = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def model_ranking(docs, items, k=20):
    terms = [(d, TERM.findall(lower(t))) for d, t in docs]
    terms = [(d, w) for d, w in terms if w]
    n, length = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall(lower(t)))
    out = []
    for i, q in asked.items():
        found = []
        for d, w in terms:
            m, tf = 75 + 25 * len(w) * n // length, Counter(w)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in q.items() if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def words(r, n):
    return " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " .,;! "), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w5 W5 w5"), (8, "Ünï w1 ÜNÏ w9\x00w2_w4"), (9, "w3 " * 30_000), (10, "nothing of it")]


@pytest.mark.parametrize("held,few,block", [(400_000, 8, None), (300, 2, 40)])
def test_lexical_search(spark, monkeypatch, held, few, block):
    monkeypatch.setattr(lexical_search, "HELD", held)
    monkeypatch.setattr(lexical_search, "FEW", few)
    r = random.Random(3)
    docs = [(100 + i, words(r, r.randint(1, 80))) for i in range(300)]
    docs += ODD + [(1000 + i, docs[5][1]) for i in range(60)]
    items = [(i, words(r, r.randint(1, 25))) for i in range(30)] + [(40, None), (41, "?"), (42, "unseen words"), (None, "w1 w7"), (43, "w9 w9 ünï"), (43, "w3"), (44, docs[5][1])]
    asked = awkward(spark, items).withColumnRenamed("doc_id", "item_id")
    found = plain(lexical_search.ranked(awkward(spark, docs), asked, block_terms=block))
    assert found == model_ranking(docs, items)


def test_tree_bounds_hold_and_prune():
    """A node's bound is never below the score of a document under it, and subtrees are left out."""
    r = np.random.default_rng(1)
    vectors = []
    for i in range(400):
        ranks = np.sort(r.choice(60, r.integers(1, 12), replace=False))
        vectors.append((ranks.astype(">u4").tobytes(), r.integers(1, 5, len(ranks)).astype("<u4").tobytes(), int(r.integers(76, 200)), i))
    of_item, of_term = np.repeat(np.arange(10), 6), r.integers(0, 60, 60)
    df = 400 // (np.arange(60) + 2) + 1
    ranking = lexical_search.Ranking(60, df, 400, 2400, of_item, of_term, np.ones(60, np.int64), list(range(10)))
    tree = lexical_search.Tree(vectors)
    seen = [0]

    def check(node):
        seen[0] += 1
        if node[3] is None:
            return ranking.scores(*node[:3])
        best = np.max([check(c) for c in node[3]], axis=0)
        assert (ranking.scores(*node[:3]) >= best).all()
        return best

    check(tree.build())
    calls = [0]
    scores = ranking.scores
    ranking.scores = lambda *a: (calls.__setitem__(0, calls[0] + 1), scores(*a))[1]
    tree.search(ranking, lexical_search.Best(10, 3))
    assert calls[0] < seen[0]


def test_empty_tables(spark):
    docs, items = awkward(spark, [(1, "w1 w2"), (2, "w2"), (3, "w4")]), awkward(spark, [(5, "w1")]).withColumnRenamed("doc_id", "item_id")
    assert plain(lexical_search.ranked(docs.limit(0), items)) == []
    assert plain(lexical_search.ranked(docs, items.limit(0))) == []
    assert [r["doc_id"] for r in lexical_search.ranked(docs, items).collect()] == [1]


def model_nearest(rows, k, every):
    """(query, [(distance, id), ...]) of all true neighbours in order."""
    found = {}
    for q, v in rows:
        if q % every == 0:
            apart = sorted((math.dist(v, w), i) for i, w in rows if i != q)
            found[q] = apart[:k]
    return found


def vectors(spark, rows):
    return spark.createDataFrame([(v, 5, i, 3.0) for i, v in rows], "embedding array<float>, rank int, vec_id long, score double")


def recall(found, true):
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & {i for _, i in near}) for q, near in true.items())
    return hits / max(1, sum(len(near) for near in true.values()))


@pytest.mark.parametrize("home", [8 << 20, 64 * 40])
def test_nearest(spark, monkeypatch, home):
    monkeypatch.setattr(nearest, "HOME_BYTES", home)
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 10))
    points = (centres[r.integers(0, 8, 1500)] + 0.3 * r.normal(size=(1500, 10))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    rows += [(2000 + i, rows[40][1]) for i in range(300)]  # one vector of many rows, queries among them
    odd = [(5000, None), (5100, []), (5200, [0.0] * 10), (5300, [float("nan")] * 10), (5400, [None] + [1.0] * 9), (5500, [float("inf")] * 10), (5600, [1.0] * 9), (None, rows[0][1]), (0, rows[0][1])]
    found = nearest.nearest(vectors(spark, rows + odd), every=20, k=7).collect()
    true = model_nearest([(i, v) for i, v in rows], 7, 20)
    assert {r["query_id"] for r in found} == set(true)
    by_id = dict(rows)
    for q in true:
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 8))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        for r_ in own:
            assert abs(r_["score"] - math.dist(by_id[q], by_id[r_["vec_id"]])) < 1e-9
    assert recall(found, true) >= 0.9
    hot = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 2100]
    assert hot == [40, 2000, 2001, 2002, 2003, 2004, 2005]


def test_nearest_recall_on_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_DIR, "embeddings").collect()]
    found = nearest.op12_nearest(table(spark, SF_DIR, "embeddings")).collect()
    assert recall(found, model_nearest(rows, 10, 100)) >= 0.9


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 4.0]), (7, [9.0, 9.0, 9.0])]
    found = plain(nearest.nearest(vectors(spark, rows)).select("query_id", "rank", "vec_id"))
    assert found == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert plain(nearest.nearest(vectors(spark, rows[:1]))) == []
    assert plain(nearest.nearest(vectors(spark, rows).limit(0))) == []
    twice = [(0, [2.0, 1.0]), (0, [1.0, 1.0]), (3, [1.0, 1.0])]
    assert plain(nearest.nearest(vectors(spark, twice)).select("query_id", "vec_id", "score")) == [(0, 3, 1.0)]  # bytes of 2.0 come before those of 1.0


def test_traversal_is_in_order():
    r = np.random.default_rng(4)
    for n, m in ((1, 1), (4, 4), (9, 9)):
        first, second = r.integers(0, 6, n).astype(float), r.random(m)
        cells = list(nearest.traverse(first, second))
        sums = [first[c // m] + second[c % m] for c in cells]
        assert sorted(cells) == list(range(n * m)) and sums == sorted(sums)
