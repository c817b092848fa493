"""Token ids, their files and counts, and SentencePiece, against the libraries and exact round trips."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybook.llm import chunks, sentencepiece_bpe, simple8b, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (5, "plain text, with words"), (3, None), (4, ""), (9, "  two  blanks \n\n lines\t tab\r\n end "), (7, "Straße 日本 🙂 <|endoftext|> </s>"),
    (7, "Straße 日本 🙂 <|endoftext|> </s>"), (None, "no id"), (8, "word " * 30_000), (2, "x" * 20_000), (6, "nbsp　wide\x1c\x85sep"),
]


def library(plain=False):
    found = Tokenizer.from_file(BPE)
    if plain:
        found.encode_special_tokens = True
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_codec(ids):
    given_ids = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(given_ids)
    assert (simple8b.decode(words, offsets, len(ids)) == given_ids).all()
    assert len(offsets) == -(-len(ids) // simple8b.BLOCK)


def test_ids_in_files(spark):
    docs = awkward(spark, ROWS)
    found = plain(simple8b.op1_simple8b(docs))
    encoded = {t: [*e.ids, 2] for t, e in zip([t or "" for _, t in ROWS], library().encode_batch([t or "" for _, t in ROWS], add_special_tokens=False))}
    start, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(encoded[t or ""], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == sorted(want, key=str)
    assert simple8b.op1_simple8b(docs.limit(0)).isEmpty()


def test_small_chunks_read_back(spark, tmp_path):
    """Ids themselves, from a table of many chunks and shards."""
    path = str(tmp_path / "ids")
    simple8b.write_ids(awkward(spark, [(i, f"text number {i} " * 20) for i in range(300)]), path, BPE, 50256)
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in simple8b.read_ids(spark, path).collect()}
    for i in (0, 17, 299):
        assert back[i] == [*library().encode(f"text number {i} " * 20, add_special_tokens=False).ids, 50256]


def test_piece_table_is_exact_when_it_forgets(monkeypatch):
    monkeypatch.setattr(chunks, "GENERATION", 40)
    monkeypatch.setattr(chunks, "RECENT", 10)
    r, encode = random.Random(2), library()
    table = chunks.PieceTable(lambda pieces: chunks._library_ids(BPE, [p.decode() for p in pieces]))
    for _ in range(60):
        texts = [" ".join(f"w{r.randint(0, 90)}" for _ in range(30)) for _ in range(3)]
        found = table.texts([t.encode() for t in texts], chunks._before_blanks)
        assert [f.tolist() for f in found] == [encode.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "  ", "\n\n", "\t", "\r\n", "\x1c", " ", "　", "'s", "a", "B", "12", "!", "é", "日", "\x85", "<|endoftext|>", "\0", "word"]), max_size=12))
def test_pieces_give_the_library_ids(parts):
    text = "".join(parts)
    for plain in (False, True):
        found = chunks.byte_bpe_ids(BPE, [text], plain)[0].tolist()
        assert found == library(plain).encode(text, add_special_tokens=False).ids


def test_special_strings_are_their_tokens():
    assert chunks.byte_bpe_ids(BPE, ["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    assert 50256 not in chunks.byte_bpe_ids(BPE, ["a <|endoftext|> b"], plain=True)[0].tolist()


def test_token_counts(spark):
    rows = [(i, "w " * (i % 40) + "end") for i in range(200)] + ROWS
    docs = awkward(spark, rows).selectExpr("doc_id", "text", "if(doc_id % 3 = 0, null, cast(doc_id % 3 as string)) as source", "1 as documents")
    sizes = [len(e.ids) for e in library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    hist = token_counts.histogram(token_counts.lengths(docs, BPE))
    sums = token_counts.suffix_sums(hist)
    for r in sums.where("scope = 'all'").collect():
        limit = r["context_limit"]
        within = [s for s in sizes if s <= limit]
        assert (r["documents_within"], r["tokens_within"]) == (len(within), sum(within))
        assert r["documents_beyond"] == len(sizes) - len(within) and r["tokens_beyond"] == sum(sizes) - sum(within)
        assert r["truncated_tokens"] == sum(min(s, limit) for s in sizes)
    asked = {r["context_limit"]: r["truncated_tokens"] for r in token_counts.truncated_totals(hist, [0, 3, 17, 10**6]).where("scope = 'all'").collect()}
    assert asked == {x: sum(min(s, x) for s in sizes) for x in (0, 3, 17, 10**6)}
    ordered = sorted(sizes)
    found = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).where("scope = 'all'").collect()}
    assert found == {s: ordered[max(0, -int(-len(ordered) * s // 1) - 1)] for s in (0.0, 0.5, 0.9, 1.0)}
    hundred = spark.range(1, 101).selectExpr("null as source", "id as n_tokens")
    shares = [0.07, 0.14, 0.28, 0.55, 0.56, 0.0001, 1.0]
    asked = token_counts.quantiles(token_counts.suffix_sums(token_counts.histogram(hundred)), shares).where("scope = 'all'").collect()
    assert {r["share"]: r["n_tokens"] for r in asked} == dict(zip(shares, [7, 14, 28, 55, 56, 1, 100]))
    assert {(r["scope"], r["source"]) for r in sums.collect()} == {("all", None), ("source", None), ("source", "1"), ("source", "2")}
    whole = token_counts.op2_token_counts(docs).where("scope = 'all'").collect()
    assert {r["context_limit"]: r["truncated_tokens"] for r in whole if r["measure"] == "truncated"} == {x: sum(min(s, x) for s in sizes) for x in token_counts.LIMITS}
    assert {r["share"]: r["context_limit"] for r in whole if r["measure"] == "quantile"} == {s: ordered[max(0, math.ceil(len(ordered) * Fraction(str(s))) - 1)] for s in token_counts.SHARES}
    assert sum(r["documents"] for r in whole if r["measure"] == "length") == len(sizes)
    assert token_counts.op2_token_counts(docs.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary(PIECES))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_prefix_table_gives_the_library_ids(encoder, pieces):
    r = random.Random(1)
    known = list(encoder.vocabulary.text.values())
    odd = ["▁", " ", "  ", "\n", "a", "th", "é", "ß", "日", "\t", "\r", " ", "<s>", "</s>", "́", "🙂", "▁▁", " " * 17, "\x01", "　", "\0"]
    for _ in range(3_000):
        text = "".join(r.choice(odd) if r.random() < 0.5 else r.choice(known).replace("▁", r.choice(" ▁")) for _ in range(r.randint(0, 12)))
        ids = pieces.encode(text, add_bos=True, add_eos=True)
        assert encoder.encode([text])[0].tolist() == ids, text
        assert encoder.decode([np.array(ids, "<u4")])[0] == pieces.decode(ids), text
    for _ in range(2_000):
        ids = [r.randrange(32_000) if r.random() < 0.6 else r.randrange(3, 259) for _ in range(r.randint(0, 8))]
        assert encoder.decode([np.array(ids, "<u4")])[0] == pieces.decode(ids), ids


def test_compatibility_is_merging_side_by_side(encoder):
    r, vocabulary = random.Random(5), encoder.vocabulary
    ids = list(vocabulary.text)
    for _ in range(5_000):
        a, b = r.choice(ids), r.choice(ids)
        one, other = vocabulary.text[a], vocabulary.text[b]
        assert vocabulary.compatible(a, b) == (sentencepiece_bpe.merged(one + other, vocabulary.rank)[0] == [one, other])


def test_sentencepiece(spark, pieces):
    found = plain(sentencepiece_bpe.op3_sentencepiece(awkward(spark, ROWS)))
    want = []
    for d, t in ROWS:
        ids = pieces.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    assert found == sorted(want, key=str)
    back = sentencepiece_bpe.decode_ids(sentencepiece_bpe.encode_texts(awkward(spark, ROWS)))
    assert {r["doc_id"]: r["text"] for r in back.collect()}[5] == ROWS[0][1]
    assert sentencepiece_bpe.op3_sentencepiece(awkward(spark, ROWS).limit(0)).isEmpty()
