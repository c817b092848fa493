"""Word shingles as 64-bit hashes, for whole slices of texts at once.

Words are runs of bytes other than ASCII white space after lower-casing A-Z; a shingle is five
consecutive words. A text of one to four words has one shingle, its whole sequence; without words it
has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 18


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans_hash(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of buffer[begin:end], ascending spans that do not overlap; `codes` maps bytes first."""
    hashes = np.empty(len(begin), np.uint64)
    word = 0
    while word < len(begin):
        # Pieces of the buffer keep the tables of powers small; a longer span is a piece of its own.
        first = begin[word]
        stop = max(word + 1, int(np.searchsorted(end, first + _PIECE, "right")))
        b, e = begin[word:stop] - first, end[word:stop] - first
        size = int(e[-1])
        up, down = _powers(_PIECE if size <= _PIECE else 1 << size.bit_length())
        part = buffer[first : first + size]
        part = (part if codes is None else codes[part]).astype(np.uint64) + np.uint64(1)
        part *= up[:size]
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        hashes[word:stop] = (total[e] - total[b]) * down[b]
        word = stop
    return mix(hashes)


def runs(texts: list[bytes], classes: np.ndarray):
    """Maximal runs of bytes of one class other than 0, lower-casing A-Z: (hashes, begin, end, buffer, stops)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = classes[buffer]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    begin = change[kind[change] != 0]
    end = np.append(change, len(buffer))[np.searchsorted(change, begin) + 1]
    return spans_hash(buffer, begin, end, _LOWER), begin, end, buffer, np.searchsorted(begin, ends)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words end."""
    hashes, _, _, _, stops = runs(texts, _WORD)
    return hashes, stops


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order of their first word (with repeats), and where each text's end."""
    words, ends = word_hashes(texts)
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins
    chained = np.zeros(len(words), np.uint64)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        chained = chained * step + padded[k : k + len(words)]
    per_text = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    stops = np.cumsum(per_text)
    place = np.arange(int(stops[-1]) if len(stops) else 0)
    place = place + np.repeat(begins - (stops - per_text), per_text)
    found = chained[place]
    for t in np.flatnonzero((counts > 0) & (counts < WORDS)):
        h = int(counts[t])  # the number of words tells short sequences apart
        for w in words[begins[t] : ends[t]].tolist():
            h = (h * int(step) + w) & 0xFFFFFFFFFFFFFFFF
        found[stops[t] - 1] = h
    return mix(found), stops


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found, stops = shingle_hashes(texts)
    return [np.unique(part) for part in np.split(found, stops[:-1])] if texts else []


def shingle_texts(text: bytes) -> list[bytes]:
    """The shingles themselves, words joined by one blank, in the order of shingle_hashes."""
    words = text.lower().split()
    if len(words) < WORDS:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def run_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, fewer than WORDS, and where each text's end.

    A run hashes as a text of just these words does in shingle_hashes.
    """
    words, ends = word_hashes(texts)
    counts = np.diff(ends, prepend=0)
    per_text = np.maximum(counts - size + 1, 0)
    stops = np.cumsum(per_text)
    place = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(ends - counts - (stops - per_text), per_text)
    found = np.full(len(place), size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0xC2B2AE3D27D4EB4F) + words[place + k]
    return mix(found), stops


def run_texts(text: bytes, size: int) -> list[bytes]:
    """The runs themselves, in the order of run_hashes."""
    words = text.lower().split()
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
