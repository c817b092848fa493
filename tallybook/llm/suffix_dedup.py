"""Substring dedup with suffix arrays: bytes covered by a LENGTH-byte string that starts elsewhere too.

Which suffixes must be sorted together is settled by anchors. Every LENGTH-byte window has one: the
right-most of its k-grams with the least hash. Equal windows have equal anchors at equal places, so
windows are compared only where their anchors' hashes agree. Consecutive windows with one anchor are
a stretch, and its bytes (all its windows) are a context.

* Stretches whose anchor occurs nowhere else are unique: nothing to do.
* Contexts that occur more than once are repeated as a whole, whatever the number of copies; only
  one of them goes on.
* Different contexts around one anchor, such as the rims of a shared passage, are sorted: contexts
  become symbols of BLOCK bytes aligned to the anchor, a suffix array of each bucket of contexts is
  built by Lyndon-prefix grouping, and a window is repeated if, among the neighbours in the array
  that share enough bytes, one has the same bytes also before the block.
* Anchors with more than GROUP_LIMIT different contexts would make a bucket too large for a task:
  their windows are counted one by one instead, spread by their own hashes.

Rows are cut to spans; a document's spans are united in its own row. Texts move between machines
only where a document has something to sort or to remove; others are finished where they are read.

Defined cases: a null text is empty; texts shorter than LENGTH bytes keep everything; overlapping
repeats and repeats inside one document count; rows equal in id and text are two documents whose
copies remove each other; a null id stays null; an empty table gives no rows; a text of any length
is one document; other columns are not read. A window's anchor and a context are known by 64-bit
hashes; sorted contexts are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_filter, passing, slices, texts_of
from tallybook.llm.shingles import _powers, mix
from tallybook.llm.suffix_groups import suffix_array
from tallybook.session import store

LENGTH = 200
GRAM = 40
BLOCK = 8
GROUP_LIMIT = 20_000
BUCKET_ANCHORS = 1_000_000
BUCKET_CONTEXTS = 4_000
_PLACES = np.uint64((1 << 22) - 1)
_STEP = 1 << 18

STRETCH = [("anchor", "<u8"), ("context", "<u8"), ("row", "<i8"), ("at", "<u4"), ("back", "u1"), ("last", "u1"), ("state", "u1")]


def stretches(raw: list[bytes]):
    """Windows with one anchor, of all texts: (text, anchor place, first and last window, anchor hash, context hash)."""
    ends = np.cumsum([len(t) for t in raw])
    begins = np.concatenate([[0], ends[:-1]])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    found = []
    for step in range(0, max(len(whole) - LENGTH + 1, 0), _STEP):
        # Windows that begin in this step, and the bytes they reach.
        buffer = whole[step : step + _STEP + LENGTH - 1]
        n = len(buffer)
        up, down = _powers(_STEP + LENGTH)
        codes = (buffer.astype(np.uint64) + np.uint64(1)) * up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        hashes = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        # Place in the low bits, reversed: of equal hashes the right-most is the least.
        least = (hashes & ~_PLACES) | (_PLACES - np.arange(len(hashes), dtype=np.uint64))
        width, size = LENGTH - GRAM + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        windows = np.arange(len(least))
        text = np.searchsorted(ends, step + windows, "right")
        inside = step + windows + LENGTH <= ends[text]
        windows, text = windows[inside], text[inside]
        if not len(windows):
            continue
        place = (_PLACES - (least[inside] & _PLACES)).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(windows)) - 1
        at, lo, hi, text = place[first], windows[first], windows[last], text[first]
        context = (total[hi + LENGTH] - total[lo]) * down[lo]
        context = mix(context ^ ((at - lo).astype(np.uint64) << np.uint64(56)) ^ ((hi - lo).astype(np.uint64) << np.uint64(48)))
        shift = step - begins[text]
        found.append((text, at + shift, lo + shift, hi + shift, hashes[at], context))
    if not found:
        blank = np.empty(0, np.int64)
        return blank, blank, blank, blank, blank.view(np.uint64), blank.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row names a document by its id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, packed): stretches by anchor. Copies within a task are settled there; one of them goes on."""

    def run(batches):
        held, size = [], 0

        def pack():
            found = np.concatenate(held)
            order = np.lexsort((found["context"], found["anchor"]))
            found = found[order]
            new = np.concatenate(
                [[True], (found["anchor"][1:] != found["anchor"][:-1]) | (found["context"][1:] != found["context"][:-1])]
            )
            copies = np.diff(np.append(np.flatnonzero(new), len(found)))
            many = np.repeat(copies > 1, copies)
            found["state"] = np.where(many & new, 1, np.where(many, 2, 0))  # 1 stands for its copies, 2 is settled
            # What is settled passes through any bucket.
            by = np.where(found["state"] == 2, found["row"].view("<u8"), found["anchor"])
            bucket = (by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, begin = np.unique(bucket[order], return_index=True)
            parts = [p.tobytes() for p in np.split(found[order], begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "packed"])

        for batch, texts in slices(batches):
            keys = batch.column(0).to_numpy()
            text, at, lo, hi, anchor, context = stretches([t.encode() for t in texts])
            found = np.zeros(len(text), STRETCH)
            found["anchor"], found["context"], found["row"] = anchor, context, keys[text]
            found["at"], found["back"], found["last"] = at, at - lo, at - hi
            held.append(found)
            size += len(found)
            if size > 200_000:
                yield pack()
                held, size = [], 0
        if size:
            yield pack()

    return rows.select("row", "text").mapInArrow(run, "bucket int, packed binary")


def _settle(anchors: DataFrame, group_limit: int) -> DataFrame:
    """(row, anchor, at, first, last, task): task 0 repeated as a whole, 1 to sort, 2 to sort as a partner only,
    3 and 4 the same for anchors with too many contexts. Unique stretches leave."""

    def run(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table.column("packed").to_pylist()), STRETCH)
        done = found[found["state"] == 2]
        found = found[found["state"] != 2]
        found = found[np.lexsort((found["context"], found["anchor"]))]
        n = len(found)
        if n:
            new_anchor = np.concatenate([[True], found["anchor"][1:] != found["anchor"][:-1]])
            new = new_anchor | np.concatenate([[True], found["context"][1:] != found["context"][:-1]])
            start = np.flatnonzero(new)
            copies = np.diff(np.append(start, n))
            many = (copies > 1) | np.maximum.reduceat(found["state"] == 1, start)
            anchor_of = np.cumsum(new_anchor[start]) - 1
            different = np.bincount(anchor_of)[anchor_of]
        else:
            start, copies, many, different = (np.empty(0, np.int64),) * 4
        whole = np.repeat(many.astype(bool), copies) if n else np.empty(0, bool)
        # One stretch of each context is compared with the other contexts of its anchor.
        compared = different > 1
        leaders = found[start[compared]] if n else found
        task = np.where(different[compared] > group_limit, 3, 1) + many[compared].astype(np.int64) if n else np.empty(0, np.int64)
        rows = np.concatenate([done, found[whole], leaders])
        tasks = np.concatenate([np.zeros(len(done) + int(whole.sum()), np.int64), task])
        at = rows["at"].astype(np.int64)
        return pa.table(
            {
                "row": rows["row"], "anchor": rows["anchor"].view("<i8"), "at": at,
                "first": at - rows["back"], "last": at - rows["last"], "task": pa.array(tasks, pa.int32()),
            }
        )

    return anchors.groupBy("bucket").applyInArrow(
        run, "row long, anchor long, at long, first long, last long, task int"
    )


CONTEXT = "anchor long, row long, at long, first long, last long, wanted boolean, bytes binary"


def _contexts(settled: DataFrame, rows: DataFrame, tasks: tuple[int, int]) -> DataFrame:
    """The bytes of the stretches to compare, one block of bytes before and behind for alignment."""
    asked = settled.where(F.col("task").isin(*tasks))
    per_row = asked.groupBy("row").agg(
        F.collect_list(F.struct("anchor", "at", "first", "last", (F.col("task") == tasks[0]).alias("wanted"))).alias("parts")
    )
    few = passing(rows, id_filter(asked, "row"), "row").join(per_row, "row").select("row", "text", "parts")

    def run(batches):
        for batch, texts in slices(batches):
            out = []
            for row, text, parts in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                raw = text.encode()
                for p in parts:
                    before = (p["at"] - p["first"]) // BLOCK * BLOCK + 2 * BLOCK
                    behind = -(-(p["last"] + LENGTH - p["at"]) // BLOCK) * BLOCK
                    begin, end = p["at"] - before, p["at"] + behind
                    # 0xFF is no byte of UTF-8: what lies outside the text equals nothing in any window.
                    part = b"\xff" * max(0, -begin) + raw[max(0, begin) : end] + b"\xff" * max(0, end - len(raw))
                    out.append((p["anchor"], row, p["at"], p["first"], p["last"], p["wanted"], part))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            columns = list(zip(*out)) or [[]] * 7
            names = [c.split()[0] for c in CONTEXT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return few.mapInArrow(run, CONTEXT)


def repeated_windows(contexts: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """For each context (at, first, last, bytes), which of its windows occur in two places.

    `bytes` begins 2 * BLOCK and the windows' blocks before `at`; every byte but padding is the text's.
    """
    count = len(contexts)
    blocks = np.array([len(c[3]) // BLOCK for c in contexts])
    # A separator of its own after each context keeps matches inside.
    starts = np.cumsum(blocks + 1) - blocks - 1
    total = int(starts[-1] + blocks[-1] + 1)
    symbols = np.empty(total, np.uint64)
    values = np.frombuffer(b"".join(c[3] for c in contexts), ">u8").astype(np.uint64)
    inner = np.ones(total, bool)
    inner[starts + blocks] = False
    symbols[inner] = values
    _, ranks = np.unique(values, return_inverse=True)
    numbered = np.empty(total, np.int64)
    numbered[inner] = ranks + count
    numbered[~inner] = np.arange(count)
    symbols[~inner] = np.arange(count, dtype=np.uint64) | np.uint64(0xFF00000000000000)
    array = suffix_array(numbered)
    rank = np.empty(total, np.int64)
    rank[array] = np.arange(total)
    # Bytes that neighbours in the array share, up to LENGTH.
    shared = np.zeros(total, np.int64)
    same = np.arange(1, total)
    padded = np.concatenate([numbered, -1 - np.arange(LENGTH // BLOCK + 2)])
    for k in range(LENGTH // BLOCK):
        equal = padded[array[same - 1] + k] == padded[array[same] + k]
        part = same[~equal]
        a, b = array[part - 1] + k, array[part] + k
        ok = (a < total) & (b < total)
        differ = symbols[a[ok]] ^ symbols[b[ok]]
        for byte in range(1, BLOCK):  # leading bytes of the first block that differs
            shared[part[ok]] += differ < np.uint64(1) << np.uint64(64 - 8 * byte)
        same = same[equal]
        shared[same] += BLOCK
    # All windows: the aligned block at or after a window's first byte, and the bytes before it.
    sizes = np.array([c[2] - c[1] + 1 for c in contexts])
    owner = np.repeat(np.arange(count), sizes)
    first = np.concatenate([np.arange(c[1], c[2] + 1) for c in contexts])
    at = np.array([c[0] for c in contexts])[owner]
    lead = np.array([(c[0] - c[1]) // BLOCK * BLOCK + 2 * BLOCK for c in contexts])[owner]
    offset = first - at + lead
    block = -(-offset // BLOCK)
    before = block * BLOCK - offset
    suffix = starts[owner] + block
    repeated = np.zeros(len(first), bool)
    for d in range(BLOCK):
        pick = np.flatnonzero(before == d)
        if not len(pick):
            continue
        group = np.cumsum(shared < LENGTH - d)[rank[suffix[pick]]]
        head = symbols[suffix[pick] - 1] & np.uint64((1 << (8 * d)) - 1)
        order = np.lexsort((head, group))
        g, h = group[order], head[order]
        equal = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        repeated[pick[order]] = twice
    return np.split(repeated, np.cumsum(sizes)[:-1])


def _sorted_spans(contexts: DataFrame, buckets: int) -> DataFrame:
    """(row, begin, end) of the repeated windows of wanted contexts, a suffix array for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        if rows:
            found = repeated_windows([(r["at"], r["first"], r["last"], r["bytes"]) for r in rows])
            for r, hit in zip(rows, found):
                if r["wanted"] and hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                    out += [(r["row"], r["first"] + a, r["first"] + b - 1 + LENGTH) for a, b in edge.reshape(-1, 2).tolist()]
        columns = list(zip(*out)) or [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "begin", "end"), columns)})

    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    return contexts.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "row long, begin long, end long")


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with too many contexts: windows are counted by their bytes' hashes."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lead = (r["at"] - r["first"]) // BLOCK * BLOCK + 2 * BLOCK
                first = r["first"] - r["at"] + lead
                count = r["last"] - r["first"] + 1
                keys = [hashlib.blake2b(r["bytes"][i : i + LENGTH], digest_size=16).digest() for i in range(first, first + count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()), pa.array([r["row"]] * count, pa.int64()),
                        pa.array(np.arange(r["first"], r["last"] + 1)), pa.array([r["wanted"]] * count),
                    ],
                    ["window", "row", "begin", "wanted"],
                )

    windows = contexts.mapInArrow(run, "window binary, row long, begin long, wanted boolean")
    often = windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window")
    return windows.where("wanted").join(often, "window").select("row", "begin", (F.col("begin") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(row, begin, end): spans, possibly overlapping, of the bytes to remove; `docs` is (row, doc_id, text)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Buckets grow with the input: stretches are about LENGTH / 3 bytes long.
    buckets = max(partitions, total // 60 // BUCKET_ANCHORS)
    settled = store(_settle(_anchors(docs, buckets), group_limit), "stretches")
    counts = {r["task"]: r["count"] for r in settled.groupBy("task").count().collect()}
    spans = settled.where("task = 0").select("row", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end"))
    if counts.get(1):
        to_sort = counts[1] + counts.get(2, 0)
        contexts = _contexts(settled, docs, (1, 2))
        spans = spans.unionByName(_sorted_spans(contexts, max(partitions, to_sort // BUCKET_CONTEXTS)))
    if counts.get(3):
        spans = spans.unionByName(_counted_spans(_contexts(settled, docs, (3, 4))))
    return spans


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, text binary"


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, text): what is left of each text, as bytes."""
    rows = _keyed(texts_of(docs, id_col, text_col))
    spans = store(repeated_spans(rows, group_limit), "spans")
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    bitmap = id_filter(spans, "row")
    hit = passing(rows, bitmap, "row").join(per_row, "row", "left").select("doc_id", "text", "spans")
    bare = passing(rows, bitmap, "row", among=False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("text"),
    )

    def run(batches):
        for batch, texts in slices(batches):
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                raw, kept, at, removed, count, stop = text.encode(), [], 0, 0, 0, -1
                for span in spans or ():
                    begin, end = span["begin"], span["end"]
                    if begin > stop:  # touching spans are one run
                        count += 1
                        kept.append(raw[at:begin])
                        removed += end - begin
                        at = stop = end
                    elif end > stop:
                        removed += end - stop
                        at = stop = end
                kept.append(raw[at:])
                out.append((doc_id, len(raw), removed, count, b"".join(kept)))
            names = [c.split()[0] for c in CUT.split(", ")]
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return hit.mapInArrow(run, CUT).unionByName(bare)


def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )
