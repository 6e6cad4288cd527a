"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A register keeps, of the smallest hash under one hash function, the number of leading zeros and the
next MANTISSA bits, in two bytes. Bands of registers name candidate buckets; a bucket's members
meet its smallest member first, and only where components still differ after that do members meet
each other, in blocks, on registers: a collision-corrected estimate drops what is far below the
threshold, and all that is left is confirmed on full shingle sets, as strings. Documents with the
same words in the same order meet the others as one.

With BANDS bands of ROWS registers a pair at a threshold of 0.85 is missed with probability
(1 - 0.85**ROWS)**BANDS = 5e-9 (2e-5 at 0.8), one at 0.4 becomes a candidate with 0.04. An
estimate is MARGIN below the threshold by chance with about 2e-6. All members of a bucket that are
still apart meet, however many: blocks grow with the bucket from BLOCK to SPLIT members, so that up
to 16 * SPLIT of them are copied at most 16 times; the comparisons grow with the square of those apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SubstringHashes, keyed_texts, mix, shuffle_partitions, with_least, written
from .components import components

WORDS, BANDS, ROWS, MANTISSA = 5, 60, 8, 10
MARGIN, BLOCK, SPLIT = 0.075, 256, 4096
HASHES = BANDS * ROWS

SIGNATURE = "doc_id long, n_shingles long, same string, registers binary, buckets array<long>"


def normal(text: str) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between."""
    return b" ".join(text.encode().lower().split())  # bytes: lower-cases A-Z only, splits at \x20 \x09-\x0D


def shingles(joined: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a normal form; fewer words than that are one shingle; without words none."""
    if not joined:
        return np.empty(0, U64)
    hashes = SubstringHashes(joined)
    gaps = np.flatnonzero(hashes.bytes == 32)
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(joined)]
    if len(start) < words:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(start) - words + 1], end[words - 1 :]
    return np.unique(hashes.of(start, end))


def shingle_set(joined: bytes, words: int = WORDS) -> frozenset:
    """The word shingles themselves."""
    w = joined.split(b" ")
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)])


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7).integers(0, 1 << 63, (2, HASHES // 2), dtype=U64)
    return draw[0] * U64(2) + U64(1), draw[1] * U64(2) + U64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of the smallest 32-bit hash under each function, as 16 bits."""
    one, two = _multipliers()
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), 512):
            h = hashes[a : a + 512, None] * one
            h ^= h >> U64(32)
            h *= two
            h ^= h >> U64(29)
            np.minimum(low, h.view(np.uint32).min(axis=0), out=low)
    # a float's exponent tells the leading zeros
    value = low.astype(np.uint64)
    zeros = 32 - np.frexp(low.astype(np.float64))[1]
    mantissa = (value << (zeros + 1).astype(U64) & U64(0xFFFFFFFF)) >> U64(32 - MANTISSA)
    return ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype("<u2")


def _buckets(regs: np.ndarray) -> np.ndarray:
    """Hashes of the bands of registers."""
    regs = regs.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(BANDS, dtype=U64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + regs[:, r] + U64(1))
    return key.view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, same, regs, keys = [], [], [], []
            for text in b.column("text"):
                joined = normal(text.as_py())
                s = shingles(joined, words)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    same.append(hashlib.md5(joined).hexdigest())
                    regs.append(r.tobytes())
                    keys.append(_buckets(r))
                else:
                    same.append(None)
                    regs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.string()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "same", "registers", "buckets"]
            )

    return run


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the collisions of unequal minima.

    Two unequal minima have the same leading zeros with probability about 1/3 and then the same
    mantissa with 2**-MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0, (equal / HASHES - chance) / (1 - chance))


def _far(threshold: float):
    """Drop pairs whose estimate is well below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), "<u2").reshape(-1, HASHES) for c in ("rx", "ry"))
                near = estimate((x == y).sum(axis=1)) >= threshold - MARGIN
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near)) for c in ("x", "y")], names=["x", "y"])

    return run


def _blocks(threshold: float):
    """Pairs of different components within (bucket, block pair) runs of sorted rows, on registers.

    A pair that shares several buckets is told in that of its first common band alone.
    """

    def pairs(rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, part, ids, comp, bucket, regs = (np.concatenate([r[k] for r in rows]) for k in range(6))
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, z in zip(edge[:-1], edge[1:]):
            left = np.flatnonzero(part[a:z] != 2) + a
            right = np.flatnonzero(part[a:z] != 1) + a
            for i in left:
                other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (part[right] == 2))]
                near = other[estimate((regs[other] == regs[i]).sum(axis=1)) >= threshold - MARGIN]
                if len(near):
                    own = _buckets(regs[i])
                    common = (regs[near].reshape(len(near), BANDS, ROWS) == regs[i].reshape(BANDS, ROWS)).all(axis=2)
                    near = near[own[np.argmax(common, axis=1)] == bucket[a]]
                if len(near):
                    yield np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(rows):
            if found := list(pairs(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["x", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = (b.column("key").to_numpy(), b.column("side").to_numpy(), b.column("doc_id").to_numpy(), b.column("component").to_numpy(), b.column("bucket").to_numpy(), np.frombuffer(b"".join(v.as_py() for v in b.column("registers")), "<u2").reshape(-1, HASHES))
            last = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1]
            if held and held[-1][0][-1] != cols[0][0]:
                yield from out(held)
                held = []
            if last:
                yield from out([*held, tuple(c[:last] for c in cols)])
                held = []
            held.append(tuple(c[last:] for c in cols))
        if held:
            yield from out(held)

    return run


@lru_cache(maxsize=256)
def _opened(packed: bytes, words: int) -> frozenset:
    return shingle_set(zlib.decompress(packed), words)


def _confirm(threshold_num: int, threshold_den: int, words: int):
    """Pairs whose shingle sets, as strings, are as alike as asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sx"), b.column("sy")):
                x, y = _opened(x.as_py(), words), _opened(y.as_py(), words)
                both = len(x & y)
                keep.append(threshold_den * both >= threshold_num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("x", "y")], names=["a", "b"])

    return run


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([zlib.compress(normal(t.as_py()), 1) for t in b.column("text")], pa.binary())], names=["doc_id", "shingles"])


def _met(rows: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Candidates among rows (doc_id, component, bucket, m) of a bucket: its m rows meet in blocks of BLOCK to SPLIT rows."""
    size = F.least(F.lit(SPLIT), F.greatest(F.lit(BLOCK), F.ceil(F.col("m") / 16)))
    entries = rows.withColumn("blocks", F.ceil(F.col("m") / size).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    entries = entries.select("bucket", "doc_id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("second"))
    side = F.when(F.col("block") == F.col("second"), 0).when(F.col("block") < F.col("second"), 1).otherwise(2)
    entries = entries.select("doc_id", "component", "bucket", F.xxhash64("bucket", F.least("block", "second"), F.greatest("block", "second")).alias("key"), side.alias("side"))
    met = entries.join(heads, "doc_id").select("key", "side", "doc_id", "component", "bucket", "registers")
    return met.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_blocks(threshold), "x long, y long")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked, directly or through others, by a Jaccard of ``percent`` or more.

    ``docs`` needs unique doc_id, not null; documents without words (null, empty or white space) are
    linked with nothing; texts of any length are read whole; an empty table gives none; columns other than doc_id and text are ignored.
    """
    texts = keyed_texts(docs)
    signed = written(texts.mapInArrow(_sign(words), SIGNATURE), "signatures")
    grouped = lambda *columns: with_least(signed.filter("same IS NOT NULL").select("doc_id", "same", *columns), "same", "doc_id", "head", "copies")
    band = grouped("buckets").filter("head = doc_id").select("doc_id", F.explode("buckets").alias("bucket"))
    hub = band.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    band = written(band.join(hub, "bucket"), "buckets")
    heads = signed.select("doc_id", "registers")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose register estimate is not far below the threshold."""
        regs = lambda a, r: heads.select(F.col("doc_id").alias(a), F.col("registers").alias(r))
        return pairs.join(regs("x", "rx"), "x").join(regs("y", "ry"), "y").mapInArrow(_far(percent / 100), "x long, y long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct(), "pairs")
        wanted = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
        # the shuffle is asked for, since ``wanted`` grows with the data
        sets = written(texts.join(wanted.hint("merge"), "doc_id").mapInArrow(_normals, "doc_id long, shingles binary"), "sets")
        side = lambda a, s: sets.select(F.col("doc_id").alias(a), F.col("shingles").alias(s))
        return pairs.join(side("x", "sx"), "x").join(side("y", "sy"), "y").mapInArrow(_confirm(percent, 100, words), "a long, b long")

    stars = band.filter("doc_id <> hub").select(F.col("hub").alias("x"), F.col("doc_id").alias("y")).distinct()
    links = written(confirmed(near(stars)), "links")
    found = components(links)

    # buckets whose members are still apart: their members meet in blocks
    placed = band.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi AND m > 2").select("bucket", "m")
    placed = placed.select("bucket", "doc_id", "component").join(apart, "bucket")
    more = confirmed(_met(placed, heads, percent / 100))

    copies = grouped().filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    found = components(links.unionByName(more).unionByName(copies))
    return signed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, percent=85).withColumn("kept", F.col("doc_id") == F.col("component_id"))
