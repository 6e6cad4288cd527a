"""Shared helpers: written tables in the cluster's shared folder, and vectorised substring hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all nodes share; local sessions alone may leave it unset and get a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write(df: DataFrame, path: str, mode: str = "error", **options: str) -> None:
    """Write ``df`` as Parquet; the job's shuffle files go when it ends, since the table is what is read on."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).mode(mode).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tidewatch/{name}-{uuid.uuid4().hex}"
    write(df, path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, least: str, count: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of those with the same ``key`` (not null), and their number; a key that many rows share is met in SALTS parts."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.filter(F.col(key).isNotNull()).groupBy(key, "__salt").agg(F.min(value).alias(least), F.count("*").alias(count))
    whole = parts.groupBy(key).agg(F.min(least).alias(least), F.sum(count).alias(count))
    return salted.join(parts.select(key, "__salt").join(whole, key), [key, "__salt"], "left").drop("__salt")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- hashes of any substring from prefix sums ----------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 31) - 1
_BASES = (1_284_865_837, 1_812_433_253)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _BASE, U64)
        down = np.full(n + 1, _INVERSE, U64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo _PRIME, up to one multiple: 31 bits fold onto 31."""
    return (x & U64(_PRIME)) + (x >> U64(31))


_KEPT: dict[int, np.ndarray] = {}
_KEPT_SIZE = 1 << 22


def _prime_powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo _PRIME, at least; a table of up to _KEPT_SIZE powers stays in the process."""
    out = _KEPT.get(base, np.ones(1, np.uint32))
    while len(out) <= n:
        out = np.r_[out, _fold(_fold(_fold(out.astype(U64) * U64(pow(base, len(out), _PRIME))))).astype(np.uint32)]
    if len(out) <= _KEPT_SIZE:
        _KEPT[base] = out
    return out


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


@lru_cache(maxsize=1)
def _prime_values() -> np.ndarray:
    return np.random.default_rng(20241103).integers(1, _PRIME, (2, 256), dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h *= U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


class SubstringHashes:
    """Hashes of substrings of ``data``; equal substrings have equal hashes wherever they start.

    ``of`` is a pair of polynomials modulo 2**31 - 1: two different strings of n bytes meet with a
    probability of about (n / 2**31)**2. ``every`` is one modulo 2**64, quicker but with known
    collisions: it may pick positions, not tell strings apart.
    """

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.n = len(data)

    @cached_property
    def _sums(self) -> list[np.ndarray]:
        out = []
        for base, values in zip(_BASES, _prime_values()):
            terms = np.zeros(self.n + 1, U64)
            np.take(values, self.bytes, out=terms[1:])
            terms[1:] *= _prime_powers(self.n, base)[: self.n]
            out.append(np.cumsum(_fold(terms)))
        return out

    def of(self, start, end) -> np.ndarray:
        parts = []
        for base, sums in zip(_BASES, self._sums):
            down = _prime_powers(self.n, pow(base, -1, _PRIME))
            x = _fold(_fold(sums[end] - sums[start]))
            x = _fold(x) * down[start]
            x = _fold(_fold(x))
            parts.append(np.where(x >= U64(_PRIME), x - U64(_PRIME), x))
        with np.errstate(over="ignore"):
            return mix(((parts[0] << U64(31)) | parts[1]) + np.asarray(end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def every(self, length: int) -> np.ndarray:
        """Picking values, by their upper bits, of the substrings of ``length`` at every start."""
        if self.n < length:
            return np.empty(0, U64)
        up, down = _powers(1 << max(12, self.n.bit_length()))
        sums = np.zeros(self.n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_values().take(self.bytes) * up[: self.n], out=sums[1:])
            return (sums[length:] - sums[: self.n + 1 - length]) * down[: self.n + 1 - length]


# --- bounded samples of labelled documents ---------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, rows: int, size: int, sized: Column | None = None, balanced: bool = False) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of labelled documents for which ``training``, a condition on doc_id, holds, and the number of all such labels by class.

    At most ``rows`` documents and ``size`` in ``sized`` (a column over text; its bytes by default), in
    the order of a hash; ``balanced`` gives the labels 0 and 1 a half of both each. A document that no
    longer fits is passed over, so one long document costs itself alone. Of several labels of a
    doc_id the smallest counts, of several texts the smallest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(training)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(9))
    if balanced:
        half = lambda c: known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(rows // 2)
        few, left = half(0).unionByName(half(1)), {0: size // 2, 1: size // 2}
    else:
        few, left = known.orderBy(order, "doc_id").limit(rows), {None: size}
    texts = keyed_texts(docs)
    measure = F.octet_length("text") if sized is None else sized
    sizes = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.max(measure).alias("size")).select("doc_id", "label", "size", order.alias("order")).collect()  # at most ``rows`` rows
    chosen = []
    for r in sorted(sizes, key=lambda r: (r.order, r.doc_id)):
        share = r.label if balanced else None
        if r.size <= left[share]:
            left[share] -= r.size
            chosen.append((r.doc_id, r.label))
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    got = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(got, key=lambda r: r.doc_id)], counts
