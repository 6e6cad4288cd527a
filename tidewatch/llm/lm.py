"""Language-model scores by prediction by partial matching over byte contexts (order 4, escape method D).

Counts of (ORDER bytes, next byte) in the training texts make a context trie: shorter contexts are
sums over longer ones. A byte not seen in its context escapes to the next shorter one, where the
bytes of the longer context are excluded; since a longer context's bytes all occur in its suffix,
what is excluded there depends on the two contexts only and is an attribute of the trie's nodes.
So the log-probability of every distinct ORDER + 1 bytes is one row of a table, made by joins.

Texts are dealt into blocks of about BLOCK_BYTES. A block counts its distinct words and byte
strings, the counts are summed over the blocks, and each block gets back the rows that it uses:
tables grow with the corpus, and no task holds more than one block and its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SubstringHashes, keyed_texts, shuffle_partitions, written

BLOCK_BYTES, TRAIN_FOLDS, HELD_OUT = 32 << 20, 5, 1
ORDER, COUNT_KEYS = 4, 1 << 21
WORD, GRAM = 0, 1
END_WORD = -1


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    joined = b" ".join(data.lower().split())
    if not joined:
        return np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return SubstringHashes(joined).of(np.r_[0, gaps + 1], np.r_[gaps, len(joined)]).view(np.int64)


def grams(data: bytes) -> np.ndarray:
    """Each byte, and an end (0), behind the ORDER bytes before it (0 before the text)."""
    b = np.frombuffer(b"\0" * ORDER + data + b"\0", np.uint8).astype(np.int64)
    n = len(b) - ORDER
    keys = b[:n]
    for k in range(1, ORDER + 1):
        keys = keys << 8 | b[k : k + n]
    return keys


class _Counts:
    """Distinct keys with their counts; about COUNT_KEYS keys wait to be counted at a time."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        for part in np.array_split(keys, 1 + len(keys) // COUNT_KEYS):
            self.held.append(part)
            self.size += len(part)
            if self.size >= COUNT_KEYS:
                self._count()

    def _count(self) -> None:
        if self.held:
            self.counted.append(np.unique(np.concatenate(self.held), return_counts=True))
            self.held, self.size = [], 0
        if len(self.counted) == 8:
            self.counted = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(c) for c in zip(*self.counted))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        return self._merged() if self.counted else (np.empty(0, np.int64), np.empty(0, np.int64))


def _features(group: pa.Table) -> pa.Table:
    """(block, kind, key, n): the block's distinct words and grams, with their counts in its training texts."""
    kinds = {(k, t): _Counts() for k in (WORD, GRAM) for t in (False, True)}
    for text, held in zip(group.column("text"), group.column("held_out").to_pylist()):
        data = text.as_py().encode()
        kinds[WORD, not held].add(np.append(word_hashes(data), END_WORD))
        for a in range(0, len(data) + 1, COUNT_KEYS):  # a long text in parts, each with the bytes before it
            part = grams(data[max(0, a - ORDER) : a + COUNT_KEYS])
            last = a + COUNT_KEYS > len(data)
            kinds[GRAM, not held].add(part[min(a, ORDER) :] if last else part[min(a, ORDER) : -1])
    out = []
    for kind in (WORD, GRAM):
        seen, n = kinds.pop((kind, True)).result()
        other = np.setdiff1d(kinds.pop((kind, False)).result()[0], seen, assume_unique=True)
        keys = np.r_[seen, other]
        out.append((np.full(len(keys), kind), keys, np.r_[n, np.zeros(len(other), np.int64)]))
    kind, keys, n = map(np.concatenate, zip(*out))
    block = group.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(keys), block), pa.int64()), "kind": pa.array(kind, pa.int32()), "key": pa.array(keys), "n": pa.array(n, pa.int64())})


def gram_log10(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the last byte of every row of ``counts`` (key of ORDER + 1 bytes, n) behind the others."""
    ctx = lambda c: F.shiftrightunsigned(c, 8)
    tables = {ORDER: counts.select(F.col("key").alias(f"k{ORDER}"), F.col("n").alias(f"n{ORDER}"))}
    for order in range(ORDER - 1, -1, -1):
        suffix = F.col(f"k{order + 1}").bitwiseAND((1 << 8 * (order + 1)) - 1)
        tables[order] = tables[order + 1].groupBy(suffix.alias(f"k{order}")).agg(F.sum(f"n{order + 1}").alias(f"n{order}"))
        if order < 2:
            tables[order] = F.broadcast(tables[order])  # at most 65,536 rows
    nodes = {}
    for order in range(ORDER, -1, -1):
        t = tables[order].filter(F.col(f"n{order}") > 0).withColumn(f"c{order}", ctx(F.col(f"k{order}")))
        aggs = [F.sum(f"n{order}").alias(f"total{order}"), F.count("*").alias(f"kinds{order}")]
        if order:
            t = t.withColumn(f"k{order - 1}", F.col(f"k{order}").bitwiseAND((1 << 8 * order) - 1)).join(tables[order - 1], f"k{order - 1}")
            aggs.append(F.sum(f"n{order - 1}").alias(f"inside{order}"))
        nodes[order] = t.groupBy(f"c{order}").agg(*aggs)
        if order < 2:
            nodes[order] = F.broadcast(nodes[order])  # at most 256 rows
    rows = tables[ORDER]
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            rows = rows.withColumn(f"k{order}", F.col(f"k{ORDER}").bitwiseAND((1 << 8 * (order + 1)) - 1)).join(tables[order], f"k{order}")
        rows = rows.withColumn(f"c{order}", ctx(F.col(f"k{order}"))).join(nodes[order], f"c{order}", "left")

    def code(order: int) -> Column:
        if order < 0:
            return -F.log10(256 - F.coalesce("kinds0", F.lit(0)))
        total, kinds = F.col(f"total{order}"), F.col(f"kinds{order}")
        if order < ORDER:
            total, kinds = total - F.coalesce(f"inside{order + 1}", F.lit(0)), kinds - F.coalesce(f"kinds{order + 1}", F.lit(0))
        escape = F.when(F.coalesce(kinds, F.lit(0)) > 0, F.log10(0.5 * kinds / total)).otherwise(0.0)
        return F.when(F.col(f"n{order}") > 0, F.log10((F.col(f"n{order}") - 0.5) / total)).otherwise(escape + code(order - 1))

    return rows.select(F.col(f"k{ORDER}").alias("key"), code(ORDER).alias("value"))


def _score(train_tokens: int, vocabulary: int):
    floor = np.log10(train_tokens + 0.5 * (vocabulary + 1))

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        words, word_n = pd.Index(key[kind == WORD]), value[kind == WORD]
        contexts, code = pd.Index(key[kind == GRAM]), value[kind == GRAM]
        rows = []
        for doc, text, held in zip(texts.column("doc_id").to_pylist(), texts.column("text"), texts.column("held_out").to_pylist()):
            data = text.as_py().encode()
            c = word_n[words.get_indexer(np.append(word_hashes(data), END_WORD))]
            bits = sum(code[contexts.get_indexer(g)].sum() for g in np.array_split(grams(data), 1 + len(data) // COUNT_KEYS))
            rows.append((doc, held, len(c), int((c > 0).sum()), train_tokens, float((np.log10(c + 0.5) - floor).sum()), float(bits)))
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(SCORE_TYPES.items(), cols)})

    return run


SCORE_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model of those whose crc32(doc_id as text) mod 5 is not 1.

    Null and empty texts are an end alone; without training texts all bytes are alike; repeated rows
    and rows without doc_id are documents of their own, the latter in training; a text longer than a
    block is a block's main part; an empty table gives none; columns other than doc_id and text are
    ignored. A text's score counts its bytes and its end.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % TRAIN_FOLDS
    texts = keyed_texts(docs).withColumn("held_out", fold == HELD_OUT)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(shuffle_partitions(spark), "block")
    used = written(dealt.groupBy("block").applyInArrow(_features, "block long, kind int, key long, n long"), "features")
    counts = written(used.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens, kinds = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = counts.filter(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value"))
    model = model.unionByName(gram_log10(counts.filter(F.col("kind") == GRAM)).select(F.lit(GRAM).alias("kind"), "key", "value"))
    values = used.select("block", "kind", "key").join(written(model, "model"), ["kind", "key"])
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score(tokens, kinds), SCORES)


def op7(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
