"""Token ids in Simple-8b words: the codec in numpy, and the sharded table format.

A 64-bit word holds a 4-bit selector (top) and 60 payload bits: selector s packs COUNTS[s] ids of
BITS[s] bits, lowest bits first. Selector ESCAPE says that the next word is one id as it is, for ids
of more than 60 bits. Ids come in blocks of BLOCK; a block starts a new word, and its offset (in
words) is stored, so that all blocks are decoded at once. The last word of a block may be part full.

A table row is one chunk: whole documents in ascending id order, closed once CHUNK_IDS ids are
reached. `shard` is the range partition of document ids, `chunk` counts up in it, `first` is the
number of ids before the chunk in its shard; `doc_ids` and `lengths` are little-endian longs,
`offsets` little-endian unsigned 32-bit, `words` little-endian unsigned 64-bit. Spark's writer
commits the shards, so a lost executor leaves no part files behind.

Defined cases: a null text is empty and still has the end id; documents of equal id stay in the
order of their text's hash, each with its own place; a null id sorts first; an empty table gives no
rows; a text of any length is one document in one chunk; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.chunks import byte_bpe_ids
from tallybook.llm.common import slices, texts_of
from tallybook.session import shared_dir

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 14
BLOCK = 256
CHUNK_IDS = 1 << 18


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets) of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    total = len(ids)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-total // BLOCK)
    width = BLOCK + 64  # blanks behind each block let its last word be part full
    grid = np.zeros((blocks, width), np.uint64)
    grid.reshape(-1)[(np.arange(total) // BLOCK) * width + np.arange(total) % BLOCK] = ids
    flat = grid.reshape(-1)
    # Index of the narrowest selector that holds each id, then the largest over windows of ids.
    limits = np.array([(1 << int(b)) - 1 for b in BITS[:-1]], np.uint64)
    top = int(ids.max())
    if top < 1 << 20:
        need = np.searchsorted(limits, np.arange(top + 1, dtype=np.uint64), "left").astype(np.uint8)[flat]
    else:
        need = np.searchsorted(limits, flat, "left").astype(np.uint8)
    windows = {1: need}
    for size in (2, 4, 8, 16, 32):
        half = windows[size // 2]
        windows[size] = half.copy()
        np.maximum(half[: -size // 2], half[size // 2 :], out=windows[size][: -size // 2])
    best = np.where(need > 13, ESCAPE, 13).astype(np.uint8)
    for s in range(12, -1, -1):
        count = int(COUNTS[s])
        power = 1 << (count.bit_length() - 1)
        most = windows[power]
        if power != count:
            most = most.copy()
            np.maximum(most[: power - count], windows[power][count - power :], out=most[: power - count])
        np.copyto(best, np.uint8(s), where=most <= s)
    # All blocks step from word to word together.
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = total - (blocks - 1) * BLOCK
    base = np.arange(blocks) * width
    at = np.zeros(blocks, np.int64)
    starts = []
    alive = np.arange(blocks)
    while len(alive):
        here = base[alive] + at[alive]
        starts.append(here)
        at[alive] += COUNTS[best[here]]
        alive = alive[at[alive] < sizes[alive]]
    starts = np.sort(np.concatenate(starts))
    chosen = best[starts]
    places = np.cumsum(1 + (chosen == ESCAPE)) - 1  # of a word, or of an escape's raw word
    words = np.zeros(int(places[-1]) + 1, np.uint64)
    for s in np.unique(chosen):
        pick = chosen == s
        where, count = starts[pick], int(COUNTS[s])
        if s == ESCAPE:
            words[places[pick] - 1] = np.uint64(ESCAPE) << np.uint64(60)
            words[places[pick]] = flat[where]
            continue
        word = np.full(len(where), np.uint64(s) << np.uint64(60), np.uint64)
        for k in range(count):
            word |= flat[where + k] << np.uint64(k * int(BITS[s]))
        words[places[pick]] = word
    first = np.searchsorted(starts, base)
    offsets = (places[first] - (chosen[first] == ESCAPE)).astype(np.uint32)
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids again, all blocks at once."""
    out = np.zeros(total, np.uint64)
    if not total:
        return out
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    head = np.ones(len(words), bool)
    if (selector == ESCAPE).any():
        # A raw word may look like anything: walk only from escapes to see which words are raw.
        raw = -1
        for i in np.flatnonzero(selector == ESCAPE):
            if i != raw:
                raw = i + 1
                head[raw] = False
    places = np.flatnonzero(head)
    chosen = selector[places]
    if int(chosen.max()) > ESCAPE:
        raise ValueError("unknown selector")
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    first = np.searchsorted(places, offsets.astype(np.int64))
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(first, len(places))))
    begin = ends - counts
    begin = begin - begin[first][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, total)
    for s in np.unique(chosen):
        pick = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[begin[pick]] = words[places[pick] + 1]
            continue
        word, bits = words[places[pick]], int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            to = begin[pick] + k
            inside = to < limit[pick]
            out[to[inside]] = (word[inside] >> np.uint64(k * bits)) & mask
    return out


CHUNK = "shard int, chunk int, first long, n_ids long, doc_ids binary, lengths binary, offsets binary, words binary"


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode whole texts and write them to `path` as chunks in ascending document order."""
    rows = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    null_id = np.iinfo(np.int64).min  # stands for a missing document id in a chunk

    def pack(batches):
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, ids = [], []

        def close():
            lengths = np.array([len(i) for i in ids], "<i8")
            joined = np.concatenate(ids)
            words, offsets = encode(joined)
            row = {
                "shard": [shard], "chunk": [chunk], "first": [first], "n_ids": [len(joined)],
                "doc_ids": [np.array(held, "<i8").tobytes()], "lengths": [lengths.tobytes()],
                "offsets": [offsets.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()],
            }
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            arrays = [pa.array(v, t) for v, t in zip(row.values(), types)]
            return pa.RecordBatch.from_arrays(arrays, list(row)), len(joined)

        size = 0
        end = np.array([end_id], "<u4")
        for batch, texts in slices(batches):
            for doc_id, found in zip(batch.column(0).to_pylist(), byte_bpe_ids(tokenizer_path, texts)):
                held.append(null_id if doc_id is None else doc_id)
                ids.append(np.concatenate([found, end]))
                size += len(ids[-1])
                if size >= CHUNK_IDS:
                    row, n = close()
                    yield row
                    chunk, first, size, held, ids = chunk + 1, first + n, 0, [], []
        if held:
            yield close()[0]

    rows.mapInArrow(pack, CHUNK).write.option("compression", "zstd").parquet(path)


def _documents(batches):
    """(shard, document ids, begins in the shard, lengths, ids) of each chunk, decoded."""
    null_id = np.iinfo(np.int64).min
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], "<i8")
            words, offsets = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4")
            ids = decode(words, offsets, row["n_ids"]).astype("<u4")
            stops = np.cumsum(lengths)
            doc_ids = [None if d == null_id else d for d in np.frombuffer(row["doc_ids"], "<i8").tolist()]
            yield row["shard"], doc_ids, stops - lengths + row["first"], lengths, np.split(ids, stops[:-1])


def read_ids(spark, path: str, digest: bool = False) -> DataFrame:
    """(shard, doc_id, start in its shard, n_tokens) and ids as little-endian unsigned 32-bit, from the files.

    With `digest`, the ids' crc32 stands in their place, taken where they are decoded.
    """
    name, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema(
        [("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)]
    )

    def unpack(batches):
        for shard, doc_ids, starts, lengths, ids in _documents(batches):
            raw = (i.tobytes() for i in ids)
            values = [zlib.crc32(r) for r in raw] if digest else list(raw)
            columns = [[shard] * len(doc_ids), doc_ids, starts, lengths, values]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    chunks = spark.read.schema(CHUNK).parquet(path)
    last = "ids_crc32 long" if digest else "ids binary"
    return chunks.mapInArrow(unpack, f"shard int, doc_id long, start long, n_tokens long, {last}")


def shard_bases(spark, path: str) -> DataFrame:
    """(shard, base): ids in all shards before. As many rows as the table has partitions."""
    totals = spark.read.schema(CHUNK).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    base, rows = 0, []
    for row in sorted(totals):
        rows.append((row["shard"], base))
        base += row["n"]
    return spark.createDataFrame(rows, "shard int, base long")


def op1_simple8b(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tables/ids_{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer_path, end_id)

    back = read_ids(spark, path, digest=True)
    bases = F.broadcast(shard_bases(spark, path))  # one row per partition of the table
    return back.join(bases, "shard").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )
