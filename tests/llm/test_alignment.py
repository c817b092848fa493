"""Cross-tokenizer alignment against token by token comparison with both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, plain
from tokenizers import Tokenizer

from tallybook.llm import alignment
from tallybook.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # Byte-level characters, from the rule that printable ones stand for themselves.
    kept = [b_ for b_ in range(256) if 33 <= b_ <= 126 or 161 <= b_ <= 172 or b_ >= 174]
    others = [b_ for b_ in range(256) if b_ not in kept]
    byte_of = {chr(c): c for c in kept} | {chr(256 + i): c for i, c in enumerate(others)}
    return a, b, byte_of


def spans(surfaces):
    out, at = [], 0
    for s in surfaces:
        out.append((at, at + len(s)))
        at += len(s)
    return out


def model(rows, libraries):
    a, b, byte_of = libraries
    documents, counts = [], Counter()
    for d, t in rows:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            raw_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not t or not (b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode()):
            documents.append((d, [], [], [], 0, ""))
            continue
        on_a, on_b = spans(raw_a), spans(raw_b)
        links, j0 = [], 0
        for i, (s, e) in enumerate(on_a):
            while on_b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(on_b) and on_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in on_a} & {e for _, e in on_b}):
            i2 = next(k for k in range(i, len(on_a)) if on_a[k][1] == cut) + 1
            j2 = next(k for k in range(j, len(on_b)) if on_b[k][1] == cut) + 1
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            i, j = i2, j2
        counts.update(links)
        documents.append((d, ids_a, ids_b, links, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        (
            (d, len(x), len(y), g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest)
            for d, x, y, links, g, digest in documents
        ),
        key=str,
    )


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "plain text, with words and tokenization"), (5, "Straße 日本 🙂 <|endoftext|> </s> <0x41>"), (None, "no id"),
    (6, "a ▁ blank sign"), (7, "word " * 20_000), (7, "same id, other text"), (8, "twice the same"), (8, "twice the same"), (9, "  two  blanks \n\n\ttab\r\n\x00 end "),
    (10, "nbsp　wide\x85sep"), (11, "y" * 5_000), (12, "\n"), (13, "▁"),
]


@pytest.mark.parametrize("frequent", [None, 30, 0])
def test_alignment(spark, libraries, frequent):
    r = random.Random(6)
    bits = ["the ", "un", "believ", "able ", "é", "日本", " token", "ization", "\n", "  ", "1234", "!?", "🙂", "<s>", "x"]
    rows = ROWS + [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 40)))) for i in range(60)]
    found = plain(alignment.alignments(awkward(spark, rows), BPE, PIECES, frequent))
    assert found == model(rows, libraries)


def test_given_table(spark, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    assert plain(alignment.op13_alignment(docs)) == model(rows, libraries)


def test_sums_are_whole_when_tasks_give_early(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PENDING", 50)
    monkeypatch.setattr(alignment, "DISTINCT", 20)
    rows = [(i, f"some words {i % 7} and others {i}") for i in range(40)]
    assert plain(alignment.op13_alignment(awkward(spark, rows))) == model(rows, libraries)
    assert alignment.op13_alignment(awkward(spark, rows).limit(0)).isEmpty()
