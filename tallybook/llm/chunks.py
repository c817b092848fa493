"""Encoding by text pieces that no token crosses, with a bounded table of pieces per Python worker.

A tokenizer's result for a text is the results for its pieces one after the other when pieces are
cut only where the tokenizer itself always cuts. Words repeat, so most pieces are found in the table;
all of a slice's pieces are hashed, looked up and put together by numpy. The table is bounded: a
generation holds a given number of pieces, and when a new one begins the last but one is forgotten, which
changes the time taken and nothing else.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable

import numpy as np

from tallybook.llm.shingles import spans_hash

GENERATION = 500_000
RECENT = 60_000
LONGEST = 64  # bytes; longer pieces are encoded each time


class _Part:
    """Sorted keys with a second check word, and where the ids of each stand in the pool."""

    def __init__(self, keys, checks, begins, sizes):
        self.keys, self.checks, self.begins, self.sizes = keys, checks, begins, sizes

    @classmethod
    def empty(cls) -> _Part:
        return cls(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not here."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def merged(self, other: _Part) -> _Part:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        both = [np.concatenate([a, b])[order] for a, b in zip(self.columns(), other.columns())]
        return _Part(*both)

    def columns(self):
        return self.keys, self.checks, self.begins, self.sizes


class PieceTable:
    """piece -> ids; `encode` takes a list of pieces (bytes) and gives their ids as uint32 bytes."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[bytes]], generation: int | None = None):
        self.encode, self.generation = encode, generation or GENERATION
        self.parts = [_Part.empty(), _Part.empty(), _Part.empty()]  # recent, current and former generation
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0

    def _append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, new: _Part) -> None:
        recent, current, former = self.parts
        recent = recent.merged(new)
        if len(recent.keys) > RECENT:
            current, recent = current.merged(recent), _Part.empty()
        if len(current.keys) > self.generation:
            # The former generation goes; the pool keeps the ids of what stays.
            self.parts = [recent, _Part.empty(), current]
            kept = np.concatenate([recent.sizes, current.sizes]).astype(np.int64)
            begins = np.concatenate([recent.begins, current.begins])
            self.pool = ragged(self.pool, begins, kept)
            self.used = len(self.pool)
            moved = np.cumsum(kept) - kept
            recent.begins, current.begins = moved[: len(recent.keys)], moved[len(recent.keys) :]
            return
        self.parts = [recent, current, former]

    def ids(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece) for pieces buffer[begin:end]."""
        if not len(begin):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        hashes = spans_hash(buffer, begin, end)
        # Length and first seven bytes stand beside the 64-bit hash, so short pieces match exactly.
        padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        sizes = end - begin
        checks = np.minimum(sizes, 255).astype(np.uint64)
        for k in range(7):
            checks |= np.where(k < sizes, padded[begin + k], 0).astype(np.uint64) << np.uint64(8 * (k + 1))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        wanted, place, count = checks[first], np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        stale = None
        for which, part in enumerate(self.parts):
            at = part.find(keys[open_], wanted[open_])
            hit = at >= 0
            place[open_[hit]], count[open_[hit]] = part.begins[at[hit]], part.sizes[at[hit]]
            if which == 2:
                stale = open_[hit]
            open_ = open_[~hit]
        if len(open_):
            raw = buffer.tobytes()
            spans = zip(begin[first[open_]].tolist(), end[first[open_]].tolist())
            encoded = list(self.encode([raw[a:b] for a, b in spans]))
            count[open_] = [len(e) // 4 for e in encoded]
            place[open_] = self._append(np.frombuffer(b"".join(encoded), np.uint32)) + np.cumsum(count[open_]) - count[open_]
        found = ragged(self.pool, place[back], count[back])
        keep = np.sort(np.concatenate([open_[sizes[first[open_]] <= LONGEST], stale]))
        if len(keep):
            self._learn(_Part(keys[keep], wanted[keep], place[keep], count[keep].astype(np.int32)))
        return found, count[back]

    def texts(self, raw: list[bytes], cut: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """Ids of each text; `cut` gives the places where pieces begin, besides those where texts do."""
        sizes = np.array([len(t) for t in raw], np.int64)
        ends = np.cumsum(sizes)
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        if not len(buffer):
            return [np.empty(0, np.uint32) for _ in raw]
        starts = cut(buffer)
        starts[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(starts)
        ids, counts = self.ids(buffer, begin, np.append(begin[1:], len(buffer)))
        stops = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begin, ends)]
        return np.split(ids, stops[:-1])


def ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] of all spans, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)]


# A byte-level BPE never joins a character with white space after it, so a text may be cut before
# each run of blanks and line breaks that nothing but such a run adjoins. Texts with other white
# space (or with what Python, but not the tokenizer's pattern, counts as such) are encoded whole.
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def _other_space(text: str) -> bool:
    return any(space in text for space in _OTHER_SPACES)


def _before_blanks(buffer: np.ndarray) -> np.ndarray:
    blank = (buffer == 32) | (buffer == 10)
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    return starts


_tokenizers: dict[tuple[str, bool], object] = {}


def tokenizer(path: str, plain: bool = False):
    """The tokenizers library's object for a file, one per worker; with `plain`, special strings are plain text."""
    if (path, plain) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = plain
        _tokenizers[path, plain] = found
    return _tokenizers[path, plain]


def _library_ids(path: str, pieces: list[str], plain: bool = False) -> list[bytes]:
    # encode_batch_fast: the same ids without the offsets into the text.
    encoded = tokenizer(path, plain).encode_batch_fast(pieces, add_special_tokens=False)
    return [array("I", e.ids).tobytes() for e in encoded]


_tables: dict[tuple[str, bool], PieceTable] = {}


def byte_bpe_ids(path: str, texts: list[str], plain: bool = False) -> list[np.ndarray]:
    """Ids of whole texts, as the tokenizers library gives them with add_special_tokens=False.

    Strings of special tokens in a text become those tokens, as the library has it, or with `plain`
    are encoded like other text. They hold no white space, so no cut falls into one, and the
    library finds them in the pieces as it does in texts.
    """
    if (path, plain) not in _tables:
        _tables[path, plain] = PieceTable(lambda pieces: _library_ids(path, [p.decode() for p in pieces], plain))
    whole = [i for i, text in enumerate(texts) if _other_space(text)]
    raw = [t.encode() for t in texts]
    for i in whole:
        raw[i] = b""
    found = _tables[path, plain].texts(raw, _before_blanks)
    for i, ids in zip(whole, _library_ids(path, [texts[i] for i in whole], plain)):
        found[i] = np.frombuffer(ids, np.uint32)
    return found
