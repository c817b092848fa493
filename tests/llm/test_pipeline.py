"""The pipeline's stages one by one against brute force, and the guard around the subpackage."""

import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import components, lower, plain
from test_dedup import model_leaks

from tallybook.llm import quality
from tallybook.llm.common import table
from tallybook.llm.jaccard_join import keep_one
from tallybook.llm.queries import QUERIES, SQL
from tallybook.session import store

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = quality.op7_quality(docs, table(spark, SF_DIR, "labels")).collect()
    left = {r["doc_id"]: rows[r["doc_id"]] for r in scores if r["predicted"]}
    now = docs
    expected = []
    expected.append(left)
    last = {lower(t): d for d, t in sorted(left.items())}
    left = {d: left[d] for d in last.values()}
    expected.append(left)
    left = {d: left[d] for d, _, c in components(sorted(left.items())) if d == c}
    expected.append(left)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    dirty = {d for d, *_ in model_leaks(sorted(left.items()), items, shortest=5)}
    left = {d: t for d, t in left.items() if d not in dirty}
    expected.append(left)
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        now = store(stage(spark, now, SF_DIR), "stage")
        assert now.columns == docs.columns and sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(want), name
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in left.items():
        ids = pieces.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    assert plain(corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)) == sorted(want, key=str)
    assert plain(corpus_pipeline.run(spark, SF_DIR)) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_awkward_tables(spark, kind):
    docs = table(spark, SF_DIR, "documents")
    extra = docs.selectExpr("*", "1 as digest", "'x' as __slotted", "2L as node")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " "), (None, "some words here for nobody"), (9004, "word " * 40_000)], "doc_id long, text string")
    now = extra.limit(0) if kind == "empty" else extra.limit(40).unionByName(odd, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = store(stage(spark, now, SF_DIR), "stage")
        assert now.columns == extra.columns
    found = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)
    assert found.count() == now.count()


def test_near_stage_tells_rows_apart(spark):
    """Rows that share an id, repeated rows and rows without an id: one row of each group of near copies."""
    a, b, c, d, e = ([f"{x}{i}" for i in range(60)] for x in "abcde")
    groups = [
        [(1, a), (2, a[1:]), (None, a[:-1])],  # the smallest id, not a null one
        [(2, b), (2, b)],  # shares the id of a near copy; repeated
        [(3, c), (3, c[1:]), (None, c)],  # two sets of the smallest id
        [(None, d), (None, d[1:]), (None, d[1:])],  # only null ids
        [(2, e)],
    ]
    rows = [(i, " ".join(w)) for g in groups for i, w in g] + [(2, ""), (2, " "), (None, None), (None, None)]
    docs = spark.createDataFrame([(t, 5, d) for d, t in rows], "text string, node long, doc_id long").repartition(5)
    kept = corpus_pipeline.near(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    full = [r for r in got if (r[1] or "").strip()]
    first = [next(n for n, g in enumerate(groups) if t[0] == g[0][1][0][0]) for _, t in full]
    assert sorted(first) == [0, 1, 2, 3, 4] and sorted(zip(first, (str(i) for i, _ in full))) == [(0, "1"), (1, "2"), (2, "3"), (3, "None"), (4, "2")]
    assert sorted(str(i) for i, t in got if not (t or "").strip()) == ["2", "2", "None", "None"]
    # Alone, keep_one leaves repeated rows and those without an id, but also goes by id and set.
    alone = sorted(str(r["doc_id"]) + r["text"][0] for r in keep_one(docs.where("length(trim(text)) > 0")).collect())
    assert alone == sorted(["1a", "Nonea", "2b", "2b", "3c", "3c", "Nonec", "Noned", "Noned", "Noned", "2e"])


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_entry_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("tallybook.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and not any(n.startswith("op") or n == "pipeline" for n in e.queries()), "still there"
"""
    root = Path(corpus_pipeline.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent / "tallybook"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "tallybook.llm" not in path.read_text(), path
