"""Exact copies, near copies, repeated substrings and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, components, lower, plain, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import decontamination, exact_dedup, jaccard_join, suffix_dedup
from tallybook.llm.components import components as linked
from tallybook.llm.suffix_groups import suffix_array

ODD = [
    (1, "Alpha BETA"), (2, "alpha beta"), (3, None), (4, ""), (5, "alpha  beta"), (6, "ÄB"), (7, "äb"),
    (8, "same row"), (8, "same row"), (8, "other text"), (None, "no id"), (None, "NO ID"), (9, "no id"), (10, "x" * 50_000),
]


def model_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out, stayed = [], set()
    for d, t in rows:
        ids = groups[lower(t)]
        keep = max((i for i in ids if i is not None), default=None)
        first = d == keep and lower(t) not in stayed
        if first:
            stayed.add(lower(t))
        out.append((d, keep, len(ids), first, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1024, 2])
def test_exact_dedup(spark, counters):
    rows = ODD + [(100 + i, "Hot") for i in range(40)]
    docs = awkward(spark, rows)
    found = exact_dedup.copy_groups(docs, counters=counters)
    got = plain(found.selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(digest))"))
    assert got == model_exact(rows)
    stay = exact_dedup.drop_copies(docs, counters=counters)
    assert stay.columns == docs.columns
    want = sorted(((m[0], m[4]) for m in model_exact(rows) if m[3]), key=str)
    got = [(r["doc_id"], hashlib.sha256(lower(r["text"]).encode()).hexdigest()) for r in stay.collect()]
    assert sorted(got, key=str) == want
    assert plain(exact_dedup.copy_groups(docs.limit(0))) == []


def test_heavy_hitters(spark):
    """Every digest above the guaranteed share is among the candidates, whatever the split."""
    rows = [(i, f"{'a' if i % 3 == 0 else 'b' if i % 5 == 0 else i}") for i in range(600)]
    table = exact_dedup.digests(awkward(spark, rows)).repartition(7)
    found = set(exact_dedup.heavy_candidates(table, "digest", 9))
    counts = Counter(lower(t) for _, t in rows)
    for text, n in counts.items():
        if n > len(rows) / 10:
            assert hashlib.sha256(text.encode()).digest() in found
    assert len(found) <= 9


def near_rows(seed, count=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.randint(8, 90))] for _ in range(12)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(count):
        kind = r.random()
        if kind < 0.55:
            text = list(r.choice(bases))
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = r.choice(words)
        elif kind < 0.7:
            text = [r.choice(words) for _ in range(r.randint(0, 12))] + passage
        else:
            text = [r.choice(words) for _ in range(r.randint(0, 40))]
        rows.append((i, r.choice([" ", "\n"]).join(text).upper() if r.random() < 0.2 else " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \t "), (503, "a b"), (504, "A  B"), (505, "a b c"), (506, "a b c d e"), (1, rows[1][1]), (None, rows[0][1]), (None, "only here with no id at all")]
    return rows


@pytest.mark.parametrize("leaf", [1024, 16])
def test_jaccard_join(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = near_rows(leaf)
    docs = awkward(spark, rows)
    assert plain(jaccard_join.similar_groups(docs)) == sorted(components(rows), key=str)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted((str(d) for d, _, c in components(rows) if d is None or d == c))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert plain(jaccard_join.similar_groups(docs.limit(0))) == []


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of many leaves: one component, the texts just below the threshold apart, and far fewer pairs than the group has."""
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        text = list(base)
        text[r.choice((0, 1, 58, 59))] = f"x{i}"
        if i % 50 == 0:  # two changes in the middle: similar to no copy by itself
            text[20], text[40] = f"y{i}", f"z{i}"
        rows.append((i, " ".join(text)))
    asked = []
    real = jaccard_join.store

    def seen(df, name, key=None):
        table = real(df, name, key)
        if name == "proposed":
            asked.append(table.where("a is not null").count())
        return table

    monkeypatch.setattr(jaccard_join, "store", seen)
    assert plain(jaccard_join.similar_groups(awkward(spark, rows))) == sorted(components(rows), key=str)
    assert sum(asked) < 20 * len(rows)


def test_near_copies_without_id(spark):
    """Sets that only rows without an id hold are verified like any other, against rows with and without one."""
    text = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(text)), (None, " ".join(text[:-1])), (None, " ".join(text[1:])), (None, " ".join(text[1:]))]
    rows += [(None, " ".join(other)), (None, " ".join(other[2:])), (None, " ".join(text[:12] + other[:12]))]
    found = plain(jaccard_join.similar_groups(awkward(spark, rows)))
    assert found == sorted(components(rows), key=str)
    assert [c for _, _, c in found].count(1) == 4


def test_bounds_never_lose_a_pair():
    """Points bound overlaps from above, folded or not, and the tree returns all that may link."""
    r = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**63, r.integers(5, 300), dtype=np.uint64)
        for _ in range(3):
            keep = base[r.random(len(base)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, 3, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    points = {i: (len(s), jaccard_join._parse(jaccard_join._point(s), len(s))) for i, s in enumerate(sets)}
    work = jaccard_join.Proposals(points, set(), 10**9)
    work.block(list(points), list(points), [2] * len(points))
    found = set(work.found)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                assert (i, j) in found


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["root"] for r in linked(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert found == {x: min(y for y in nodes if find(y) == find(x)) for x in nodes}
    assert linked(spark.createDataFrame([], "a long, b long")).isEmpty()


def model_repeats(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[False], cover]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((d, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [20_000, 2])
def test_suffix_dedup(spark, limit):
    r = random.Random(limit)
    parts = ["".join(r.choice("abcde é\0") for _ in range(r.randint(150, 420))) for _ in range(6)]
    rows = []
    for i in range(90):
        pieces = [r.choice([r.choice(parts), r.choice(parts)[r.randint(0, 120) :], "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90))), "xy" * r.randint(0, 200)]) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(pieces)))
    rows += [(500, None), (501, ""), (502, "a" * 199), (503, "b" * 200), (504, "c" * 201), (505, "d" * 3000), (None, parts[0]), (506, rows[0][1]), (506, rows[0][1])]
    found = suffix_dedup.cut_repeats(awkward(spark, rows), group_limit=limit)
    assert plain(found.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(text, 256)")) == model_repeats(rows)
    assert suffix_dedup.cut_repeats(awkward(spark, rows).limit(0)).isEmpty()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def model_leaks(docs, items, threshold=0.75, shortest=1):
    own, runs, tests = {}, {}, {}
    for d, t in docs:
        own.setdefault(d, set()).update(shingles(t))
        w = (t or "").lower().split()
        runs.setdefault(d, set()).update(" ".join(w[i : i + n]) for n in range(shortest, 5) for i in range(len(w) - n + 1))
    for i, t in items:
        tests.setdefault(i, set()).update(shingles(t))
    said = {d: {" ".join(x) if isinstance(x, tuple) else x for x in s} | runs[d] for d, s in own.items()}
    asked = {i: {" ".join(x) if isinstance(x, tuple) else x for x in q} for i, q in tests.items()}
    return sorted(
        ((d, i, len(s & q), len(q)) for d, s in said.items() for i, q in asked.items() if q and len(s & q) >= threshold * len(q)), key=str
    )


def test_decontamination(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 5, 9, 30, 60])))) for i in range(30)] + [(30, None), (31, ""), (32, "one two"), (5, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for i in range(150):
        item = r.choice(items)[1] or ""
        part = item.split()
        for _ in range(r.randint(0, 2)):
            if part:
                part[r.randrange(len(part))] = r.choice(words)
        text = [r.choice(words) for _ in range(r.randint(0, 200))]
        at = r.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + (part if i % 2 else []) + text[at:])))
    docs += [(900, None), (901, ""), (902, "One  TWO"), (903, "one two three"), (905, "zero\nONE two " * 40), (906, "two one"), (None, items[0][1]), (904, " ".join(r.choice(words) for _ in range(20_000)) + " " + items[3][1])]
    table = awkward(spark, docs)
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = model_leaks(docs, items)
    assert len(want) > 20 and plain(decontamination.leaks(table, tests)) == want
    assert (902, 32, 1, 1) in want and any(i == 32 and d != 902 for d, i, _, _ in want)  # two words, alone and inside a longer text
    clean = decontamination.decontaminate(table, tests)
    dirty = {w[0] for w in model_leaks(docs, items, shortest=5)}
    assert clean.columns == table.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in dirty)
    assert decontamination.leaks(table.limit(0), tests).isEmpty() and decontamination.leaks(table, tests.limit(0)).isEmpty()
    assert decontamination.decontaminate(table, tests.limit(0)).count() == len(docs)


def test_phrase_that_all_items_share(spark):
    """A stem of six words in every item and document makes no candidates; an item that is nothing else is found."""
    stem = "which of the following statements is"
    items = [(i, stem + " " + " ".join(f"a{i}x{k}" for k in range(12))) for i in range(40)]
    docs = [(i, f"so {stem} " + " ".join(f"b{i}x{k}" for k in range(30))) for i in range(40)] + [(77, "x " + items[7][1] + " y")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    known = decontamination.item_shingles(tests)
    probed = decontamination._probed(table, known, 1)
    assert plain(decontamination._candidates(probed, known)) == [(77, 7)]
    assert plain(decontamination.leaks(table, tests)) == model_leaks(docs, items)
    alone = spark.createDataFrame([*items, (99, stem)], "item_id long, text string")
    assert plain(decontamination.leaks(table, alone)) == model_leaks(docs, [*items, (99, stem)])
