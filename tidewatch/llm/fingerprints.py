"""SpotSigs document fingerprints with DataFrame functions only.

Common words of the corpus are anchors: a word is one if it makes up ANCHOR_SHARE of all words, so
there are at most 1 / ANCHOR_SHARE of them. Each occurrence of an anchor starts a chain of the next
CHAIN content words (words that are no anchors) among the LOOK words after it. The distinct chains,
hashed to 32 bits, are the document's set; the fingerprint is the set in order, as hexadecimal. A
text with words but without a chain has one signature of all its words. Likeness is the Jaccard
coefficient of two sets; where a least value is asked for, pairs whose set lengths rule it out are
not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, let, shuffle_partitions, written

ANCHOR_SHARE, CHAIN, LOOK, ANCHOR_CHARS = 0.002, 2, 6, 12


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def common_words(docs: DataFrame, share: float = ANCHOR_SHARE) -> list[str]:
    """The words, of up to ANCHOR_CHARS characters, that make up ``share`` of all words, counted over all texts; at most 1 / share."""
    words = keyed_texts(docs).select(F.explode(_words(F.col("text"))).alias("word"))
    counted = words.groupBy(F.when(F.length("word") <= ANCHOR_CHARS, F.col("word")).alias("word")).agg(F.count("*").alias("n"))
    counted = written(counted, "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in counted.filter(F.col("word").isNotNull() & (F.col("n") >= max(1, share * total))).collect())


def signatures(text: Column, anchors: list[str]) -> Column:
    """Sorted distinct 32-bit signatures of a text (array of long)."""

    def chains(w: Column) -> Column:
        n = F.size(w)
        content = F.transform(w, lambda x: F.when(~x.isin(anchors), x)) if anchors else w

        def of(c: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(c, i).isNull())
            chain = lambda i: let(F.slice(F.array_compact(F.slice(c, i + 1, LOOK)), 1, CHAIN), lambda k: F.when(F.size(k) == CHAIN, F.xxhash64(F.element_at(w, i), k)))
            return F.array_compact(F.transform(at, chain))

        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(let(content, of), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(w)))))

    return F.array_sort(F.array_distinct(F.transform(let(_words(text), chains), lambda h: h.bitwiseAND(0xFFFFFFFF))))


def fingerprint(sigs: Column) -> Column:
    return F.concat_ws("", F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard of two sets, 1 for two empty ones; 0 without comparing where their lengths keep it under ``at_least``."""
    m, n = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    value = F.when((m == 0) & (n == 0), 1.0).otherwise(both / (m + n - both))
    return F.when(F.least(m, n) < at_least * F.greatest(m, n), 0.0).otherwise(value) if at_least else value


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by a search in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*map(F.lit, bounds[::step])).cast("array<bigint>")
    fine = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda b: b < value))
    return let(below(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + below(F.slice(fine, (c - 1) * step + 1, step))))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row with the next smaller doc_id; after the smallest, of the largest.

    Rows are dealt by ranges of doc_id; each range gets the last row of the range below as a guest, so
    nothing is ordered as a whole. Null doc_ids come before all others.
    """
    parts = shuffle_partitions(rows.sparkSession)
    at = [k / parts for k in range(1, parts)]
    bounds = sorted({b for b in (rows.agg(F.percentile_approx("doc_id", at, 100 * parts)).first()[0] or []) if b is not None}) if at else []
    bucket = _bucket(F.col("doc_id"), bounds) if bounds else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("int")
    last = [r for r in rows.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()]  # a row per range
    hosts = [(r.doc_id, last[(k + 1) % len(last)].bucket) for k, r in enumerate(last)]
    guests = rows.sparkSession.createDataFrame(hosts, "host_id long, host int")
    both = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("host_id")), "left").withColumn("bucket", bucket)
    seats = F.array(F.struct(F.col("bucket").alias("seat"), F.lit(1).alias("own")), F.struct(F.col("host").alias("seat"), F.lit(0).alias("own")))
    both = both.withColumn("seat", F.explode(F.when(F.col("host").isNull(), F.slice(seats, 1, 1)).otherwise(seats)))
    order = Window.partitionBy(F.col("seat.seat")).orderBy(F.col("seat.own"), F.col("doc_id").asc_nulls_first())
    return both.select("*", *(F.lag(c).over(order).alias(f"next_{c}") for c in columns)).filter("seat.own = 1").drop("host_id", "host", "bucket", "seat")


def op1(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are to these and to the next document's.

    Null texts count as empty; an empty text has the empty fingerprint; the next document of a sole
    row is itself; doc_id is unique; columns other than doc_id and text are ignored.
    """
    anchors = common_words(docs)
    rows = keyed_texts(docs).withColumn("sigs", signatures(F.col("text"), anchors))
    rows = with_next(rows, ["text", "sigs"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("CAST(n_chars div 2 AS INT)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited"), anchors))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
