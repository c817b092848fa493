"""Merge-type SentencePiece encoding by a prefix table, and decoding.

For every prefix of a piece of text the table keeps the last token of that prefix's encoding. It is
unique: a token that ends there (found by an Aho-Corasick automaton over the vocabulary) is the last
one exactly if the last token of what stands before it is compatible with it, that is, if the two,
side by side, encode to themselves. The ids are then recovered from the end backwards.

Compatibility walks the two sides' merge histories in order of priority: the right-most symbols of
the left token and the left-most symbols of the right token, as they grow, must never form a piece
that would be merged before either side's next own merge. Runs of blanks, whose pieces share one
priority, are decided by merging the two side by side. Answers are kept in a bounded cache.

No piece has a blank behind another character, so a text is cut before its runs of blanks and words
are encoded once per worker cache. A character outside the vocabulary stands alone, as bytes.

Defined cases: a null text is empty and has the begin and end ids alone; a null id stays null;
repeated rows each have their result; an empty table gives none; a text of any length is encoded
whole; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.chunks import PieceTable, ragged
from tallybook.llm.common import limited, slices, texts_of

BLANK = "▁"
BEGIN, END = 1, 2
PAIR_ENTRIES = 200_000
PIECE_ENTRIES = 200_000
NEVER = float("inf")


def merged(text: str, rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols left after merging by rank (ties: leftmost), and the last merge."""
    symbols, last = list(text), None
    while True:
        best, at = NEVER, -1
        for i in range(len(symbols) - 1):
            found = rank.get(symbols[i] + symbols[i + 1], NEVER)
            if found < best:
                best, at = found, i
        if at < 0:
            return symbols, last
        last = (symbols[at], symbols[at + 1])
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Vocabulary:
    """What the driver derives from a model file once; executors get it by broadcast."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        kinds = model.SentencePiece
        if (
            model.trainer_spec.model_type != model.trainer_spec.BPE
            or not model.trainer_spec.byte_fallback
            or model.trainer_spec.treat_whitespace_as_suffix
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not rules.add_dummy_prefix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        ):
            raise ValueError("a merge-type model with byte fallback and without normalization is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        single = {piece for piece in normal if len(piece) == 1}
        if any(set(piece) - single or BLANK in piece.lstrip(BLANK) or "\n" in piece for piece in normal):
            raise ValueError("pieces must be built of single pieces, with blanks only in front, without line breaks")
        self.path = path
        self.rank = {p: -model.pieces[i].score if len(p) > 1 else NEVER for p, i in normal.items()}
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.surface = [b""] * len(model.pieces)
        for piece, i in normal.items():
            self.surface[i] = piece.replace(BLANK, " ").encode()
        for byte, i in self.bytes_id.items():
            self.surface[i] = bytes([byte])
        for i, p in enumerate(model.pieces):
            if p.type == kinds.UNKNOWN:
                self.surface[i] = " ⁇ ".encode()
        # Only pieces that encode to themselves can occur; where the last merge of each joined it gives its history.
        self.ids, self.cut = {}, {}
        for piece, i in normal.items():
            symbols, last = merged(piece, self.rank)
            if len(symbols) == 1:
                self.ids[piece], self.cut[piece] = i, len(last[0]) if last else 0
        self.text = {i: p for p, i in self.ids.items()}

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """Symbols at one edge from the single character up, each with the rank that absorbs it.

        Formed when asked for: answers on pairs are kept, and the edges of all pieces would take far
        more memory than all else here.
        """
        found, absorbed = [], NEVER
        while True:
            found.append((piece, absorbed))
            cut = self.cut[piece]
            if not cut:
                return found[::-1]
            absorbed, piece = self.rank[piece], piece[cut:] if side else piece[:cut]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        if BLANK * 2 in a or BLANK * 2 in b or (b[0] == BLANK and a[-1] == BLANK):
            return merged(a + b, self.rank)[0] == [a, b]
        ones, others = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            x, end_x = ones[i]
            y, end_y = others[j]
            joined = self.rank.get(x + y, NEVER)
            # On equal rank the merge further left goes first.
            if joined < end_x and joined <= end_y and joined < NEVER:
                return False
            if end_x == NEVER and end_y == NEVER:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1


class Encoder:
    """Per worker: automaton, pair cache, piece cache."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.width = len(vocabulary.surface)
        self.pairs: dict[int, bool] = {}
        self.cache = PieceTable(lambda pieces: [self.encode_piece(p.decode().replace(" ", BLANK)) for p in pieces], PIECE_ENTRIES)
        sizes = np.array([len(s) for s in vocabulary.surface], np.int64)
        self.sizes, self.offsets = sizes, np.cumsum(sizes) - sizes
        self.table = np.frombuffer(b"".join(vocabulary.surface), np.uint8)

    def encode_piece(self, piece: str) -> bytes:
        n = len(piece)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        pairs, width, compatible = self.pairs, self.width, self.vocabulary.compatible
        for end, (token, size) in self.automaton.iter(piece):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            before = last[start]
            if before >= 0:
                key = before * width + token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    fits = pairs[key] = compatible(before, token)
                if not fits:
                    continue
            last[end], begin[end] = token, start
        ids, at, in_bytes = [], n, self.vocabulary.bytes_id
        while at:
            if last[at] >= 0:
                ids.append(last[at])
                at = begin[at]
            else:  # a character without a piece
                ids.extend(in_bytes[b] for b in reversed(piece[at - 1].encode("utf-8")))
                at -= 1
        ids.reverse()
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts with begin and end ids."""
        begin, end = np.array([BEGIN], "<u4"), np.array([END], "<u4")
        raw = [b" " + t.replace(BLANK, " ").encode() if t else b"" for t in texts]
        return [np.concatenate([begin, ids, end]) for ids in self.cache.texts(raw, _before_words)]

    def surfaces(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' pieces, one after the other."""
        return ragged(self.table, self.offsets[ids], self.sizes[ids]).tobytes()

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.concatenate(rows) if rows else np.empty(0, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = ragged(self.table, self.offsets[ids], sizes).tobytes()
        stops = np.cumsum([len(r) for r in rows])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], stops])] if rows else []
        texts = []
        for row, a, b in zip(rows, bounds[:-1], bounds[1:]):
            raw = out[a:b]
            if raw[:1] == b" ":  # the blank that encoding put in front, unless a byte id stands there
                first = next(i for i in row.tolist() if self.sizes[i])
                raw = raw[1:] if first in self.vocabulary.text else raw
            texts.append(raw.decode("utf-8", "each_byte"))
        return texts


# One replacement character for every byte that is no UTF-8, as the library does.
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _before_words(buffer: np.ndarray) -> np.ndarray:
    """Before each run of blanks, and around line breaks, which are no part of any piece."""
    starts = buffer == 32
    starts[1:] &= ~starts[:-1]
    line = buffer == 10
    starts |= line
    starts[1:] |= line[:-1]
    return starts


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, vocabulary) -> Encoder:
    """The worker's encoder for a model file; the broadcast vocabulary is read only where there is none yet."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary.value)
    return _encoders[path]


def _default(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode_texts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of each whole text as little-endian unsigned 32-bit, with begin and end ids."""
    rows, path = texts_of(docs), _default(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        for batch, texts in slices(batches):
            ids = [i.tobytes() for i in encoder_of(path, shared).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""
    limited(encoded.sparkSession)
    rows, path = encoded.select("doc_id", "ids"), _default(model_path)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                ids = [np.frombuffer(b or b"", "<u4") for b in part.column(1).to_pylist()]
                texts = encoder_of(path, shared).decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    return rows.mapInArrow(run, "doc_id long, ids binary, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them, in one pass and one worker per task."""
    rows, path = texts_of(docs), _default(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        for batch, texts in slices(batches):
            ids = encoder_of(path, shared).encode(texts)
            back = encoder_of(path, shared).decode(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                ],
                [c.split()[0] for c in DIGESTS.split(", ")],
            )

    return rows.mapInArrow(run, DIGESTS)


def op3_sentencepiece(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    return round_trip(docs, model_path)
