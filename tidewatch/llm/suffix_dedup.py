"""Exact repeated-substring removal by distributed prefix doubling of position ranks.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller
doc_id is removed. Ranks here are hashes of the prefix that starts at a position. They are refined
at growing lengths, and a position leaves as soon as its rank is unique to one document:

1. Length ANCHOR. Of all positions only the content-defined anchors take part: each 50-byte window
   names one anchor among the ANCHOR-grams that it holds, by its bytes alone, so equal windows name
   equal anchors. An anchor whose rank occurs in one document only leaves with its windows.
2. The run: the windows in a row that name the same anchor, with the bytes that they span. Of equal
   runs the smallest document keeps its own and all others lose theirs.
3. What is left are the first of each run of anchors with different runs, at the edges of repeats.
   Their halves are ranked (the anchor with what stands before it, and after it); a window needs one
   of the two to occur in two documents.
4. Windows that are left get ranks at the full length, past which nothing is refined.

Plain doubling over every position would shuffle about 16 bytes a byte of text each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, SubstringHashes, keyed_texts, shuffle_partitions, written

LENGTH, ANCHOR = 50, 20
FLUSH_BYTES, CHUNK_BYTES = 24 << 20, 1 << 15

SALTS = 61

RANKS = "anchor long, doc_id long, salt int, shared boolean"
RUNS = "anchor long, salt int, run long, doc_id long, first int, n int, at int"
TEXTS = "doc_id long, packed binary"


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of every ``width`` values, by their upper 32 bits."""
    best, span = (x & U64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=U64), 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[step:], best[:-step])
        span += step
    return (best & U64(0xFFFFFFFF)).astype(np.int64)


def anchors(hashes: SubstringHashes, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For every window of ``length``, where the anchor starts that it names: the ``anchor``-gram with the smallest hash."""
    if hashes.n < length:
        return np.empty(0, np.int64)
    return _sliding_argmin(hashes.every(anchor), length - anchor + 1)


def _runs(texts: list[bytes], length: int, anchor: int, whole: bool = True):
    """Columns of the runs of some texts, hashed as one string: text, anchor, then (if ``whole``) run, first, n, at."""
    hashes = SubstringHashes(b"".join(texts))
    named = anchors(hashes, length, anchor)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    starts = np.flatnonzero(text[: len(named)] == text[len(text) - len(named) :])  # windows inside one text
    if not len(starts):
        return None
    named = named[starts]
    edge = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    first, at = starts[edge], named[edge]
    text = text[first]
    if not whole:
        return text, hashes.of(at, at + anchor)
    last = starts[np.r_[edge[1:], len(starts)] - 1]
    ends = np.cumsum(sizes)
    low, high = (ends - sizes)[text], ends[text]
    half = (length - anchor + 1) // 2
    left, right = np.maximum(at - half, low), np.minimum(at + anchor + half, high)
    # the run's rank in the upper 48 bits; of the halves' ranks, which only rule windows out, 8 bits each
    before, after = hashes.of(left, at + anchor) >> U64(56), hashes.of(at, right) >> U64(56)
    run = (hashes.of(first, last + length) & ~U64(0xFFFF)) | (before << U64(8)) | after
    return text, hashes.of(at, at + anchor), run, first - low, last - first + 1, at - first


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled, and only opened in Python."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([zlib.compress(t.as_py().encode(), 1) for t in b.column("text")], pa.binary())], names=["doc_id", "packed"])


def _data(value) -> bytes:
    value = value.as_py()
    return value.encode() if isinstance(value, str) else zlib.decompress(value)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(doc_ids, texts, arrays of wanted ranks) of CHUNK_BYTES of text, or of one longer text, at a time: short texts share the cost of a call."""
    docs, texts, ranks, size = [], [], [], 0
    for b in batches:
        wanted = b.column("ranks") if "ranks" in b.schema.names else None
        for k, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column(1))):
            if wanted is not None:
                if not wanted[k].is_valid:
                    continue
                ranks.append(wanted[k].values.to_numpy())
            docs.append(doc)
            texts.append(_data(text))
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield docs, texts, ranks
                docs, texts, ranks, size = [], [], [], 0
    if docs:
        yield docs, texts, ranks


def _flushes(batches: Iterator[pa.RecordBatch], length: int, anchor: int, mask: int, whole: bool):
    """Columns of the runs of about FLUSH_BYTES of text at a time: anchors under ``mask`` first, documents last.

    Where ranks are given, only runs of these anchors. Ranks shared by two documents are wanted of
    every document that has them, so a chunk's ranks may be looked up as one set.
    """
    parts: list = []
    size = 0
    columns = lambda: [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]
    for docs, texts, ranks in _chunks(batches):
        size += sum(map(len, texts))
        if got := _runs(texts, length, anchor, whole):
            text, rank, *rest = got
            got = (rank & U64(mask), *rest, np.array(docs, np.int64)[text])
            if ranks:
                of = np.isin(got[0].view(np.int64), np.concatenate(ranks))
                got = tuple(c[of] for c in got)
            parts.append(got)
        if size >= FLUSH_BYTES and parts:
            yield columns()
            parts, size = [], 0
    if parts:
        yield columns()


def _met(keys: list, doc: np.ndarray):
    """Order by keys and document, and which rows there have the keys of a smaller document's row."""
    order = np.lexsort((doc, *keys[::-1]))
    fresh = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order, doc[order] > doc[order][lead]


def _batches(columns: dict, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(next(iter(columns.values()))), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + size]) for c in columns.values()], names=list(columns))


def _emit_ranks(length: int, anchor: int, mask: int):
    """(anchor, doc_id, salt, shared), once a document. shared: two documents have it here already; of these only the smallest goes on to meet others, so the rest get a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc in _flushes(batches, length, anchor, mask, whole=False):
            order, seen = _met([h], doc)
            a, d = h[order], doc[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])][: len(h)]
            order, seen = order[once], seen[once]
            shared = seen | np.r_[seen[1:], False]
            back = np.argsort(order)  # in the order of the documents, whose ids then compress well
            order, seen, shared = order[back], seen[back], shared[back]
            yield from _batches({"anchor": h[order].view(np.int64), "doc_id": doc[order], "salt": np.where(seen, 1 + doc[order] % SALTS, 0).astype(np.int32), "shared": shared})

    return run


def _emit_runs(length: int, anchor: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, r, first, n, at, doc in _flushes(batches, length, anchor, mask, whole=True):
            order, seen = _met([h, r], doc)
            back = np.argsort(order)
            order, seen = order[back], seen[back]
            yield from _batches(
                {
                    "anchor": h[order].view(np.int64),
                    "salt": np.where(seen, 1 + doc[order] % SALTS, 0).astype(np.int32),
                    "run": np.where(seen, 0, r[order].view(np.int64)),
                    "doc_id": doc[order],
                    "first": first[order].astype(np.int32),
                    "n": n[order].astype(np.int32),
                    "at": at[order].astype(np.int32),
                }
            )

    return run


def _emit_windows(length: int, anchor: int):
    half = (length - anchor + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, runs in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("runs")):
                if not runs.is_valid or not len(runs.values):
                    continue
                hashes = SubstringHashes(_data(text))
                col = lambda k: runs.values.field(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                first, n = col("first").astype(np.int64), col("n").astype(np.int64)
                key, before, after = (np.repeat(col(k), n) for k in ("anchor", "before", "after"))
                at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                left = np.repeat(first + col("at"), n) - at
                able = (before & (left >= half)) | (after & (left <= length - anchor - half))
                key, at = key[able], at[able]
                for a in range(0, len(at), 100_000):
                    s = at[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(hashes.of(s, s + length).view(np.int64)), pa.array(np.full(len(s), doc, np.int64)), pa.array(s.astype(np.int32))], names=["anchor", "window", "doc_id", "first"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(texts dealt by doc_id; doc_id and the runs (first, n) of window starts that occur in a smaller document)."""
    parts = shuffle_partitions(docs.sparkSession)
    texts = keyed_texts(docs).filter("doc_id IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    mask = ((1 << 64) - 1) ^ ((1 << max(0, 56 - size.bit_length())) - 1)  # first ranks need only some bits more than there are positions
    dealt = texts.mapInArrow(_pack, TEXTS).repartition(parts, "doc_id")
    by = Window.partitionBy("anchor", "salt")
    ranks = texts.mapInArrow(_emit_ranks(length, anchor, mask), RANKS).repartition(parts, "anchor", "salt")
    ranks = ranks.select("*", F.min("doc_id").over(by).alias("_low"), F.max("doc_id").over(by).alias("_high")).filter("shared OR _low < _high")
    ranks = ranks.groupBy("doc_id").agg(F.collect_list("anchor").alias("ranks"))
    runs = dealt.join(ranks, "doc_id", "left").select("doc_id", "packed", "ranks").mapInArrow(_emit_runs(length, anchor, mask), RUNS).repartition(parts, "anchor", "salt")
    rank = F.shiftright("run", 16)
    runs = runs.select(
        "*",
        F.min("doc_id").over(by).alias("_low"),
        F.max("doc_id").over(by).alias("_high"),
        F.min(rank).over(by).alias("_run"),
        F.max(rank).over(by).alias("_run2"),
        F.min("doc_id").over(Window.partitionBy("anchor", "salt", rank)).alias("_same"),
    ).filter("salt > 0 OR _low < _high")
    seen = F.col("salt") > 0
    even = F.col("_run") == F.col("_run2")
    # half ranks of the uneven anchors: a window holds the anchor with the half before it or with the half after it
    half = lambda c: Window.partitionBy("anchor", "salt", c)
    shared = lambda c: F.min("doc_id").over(half(c)) < F.max("doc_id").over(half(c))
    runs = runs.withColumn("_before", F.shiftright("run", 8).bitwiseAND(255)).withColumn("_after", F.col("run").bitwiseAND(255))
    runs = runs.withColumn("before", shared("_before")).withColumn("after", shared("_after"))
    settled = F.when(seen | (F.col("doc_id") > F.col("_same")), F.struct("first", "n"))
    uneven = F.when(~seen & ~even & (F.col("doc_id") == F.col("_same")) & (F.col("before") | F.col("after")), F.struct("anchor", "first", "n", "at", "before", "after"))
    found = runs.select("doc_id", settled.alias("settled"), uneven.alias("uneven")).filter("settled IS NOT NULL OR uneven IS NOT NULL")
    found = written(found.groupBy("doc_id").agg(F.collect_list("settled").alias("settled"), F.collect_list("uneven").alias("uneven")), "repeats")

    # left joins, as below: the shuffled texts are the same for both
    windows = dealt.join(found, "doc_id", "left").select("doc_id", "packed", F.col("uneven").alias("runs"))
    windows = windows.mapInArrow(_emit_windows(length, anchor), "anchor long, window long, doc_id long, first int")
    of_window = Window.partitionBy("anchor", "window")
    late = windows.select("doc_id", "first", F.min("doc_id").over(of_window).alias("_low")).filter("doc_id > _low").select("doc_id", F.struct("first", F.lit(1).alias("n")).alias("run"))
    late = late.groupBy("doc_id").agg(F.collect_list("run").alias("late"))
    return dealt, found.select("doc_id", "settled").join(late, "doc_id", "full").select("doc_id", F.concat(F.coalesce("settled", F.array()), F.coalesce("late", F.array())).alias("runs"))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, text binary"


def _removed(n: int, runs: pa.StructArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed byte ranges."""
    first, count = (runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "n"))
    end = first + count - 1 + length
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    gone = np.r_[False, np.cumsum(change)[:n] > 0, False]
    edge = np.flatnonzero(gone[1:] != gone[:-1])
    return edge[::2], edge[1::2]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, runs in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("runs")):
                data = _data(text)
                start, end = _removed(len(data), runs.values, length) if runs.is_valid and len(runs.values) else (np.empty(0, np.int64),) * 2
                kept = b"".join(data[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(data)])) if len(start) else data
                out.append((doc, len(data), int((end - start).sum()), len(start), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 4 + [pa.binary()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "text"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, text binary): each document with what stays of its bytes.

    ``docs`` needs unique doc_id, rows without one have no place in the order and are left out; null
    texts count as empty; documents shorter than ``length`` and
    empty tables come back unchanged; columns other than doc_id and text are ignored.
    """
    dealt, runs = repeated_windows(docs, length, anchor)
    return dealt.join(runs, "doc_id", "left").select("doc_id", "packed", "runs").mapInArrow(_cut(length), DIGEST)


def op2(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
