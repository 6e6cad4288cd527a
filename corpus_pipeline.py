"""The corpus pipeline: each stage takes documents and returns those it keeps, with its decisions made.

``run`` applies the stages in order; a runner may instead write each stage's rows and read them
again as the next one's documents. No stage depends on how its input was made. Every row is a
document, also one without doc_id or with that of another row: stages decide by a row key in the
order of the doc_ids, null ones last, and rows of one doc_id in reading order. Columns that start
with ``__pipeline_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import minhash, mixing, packing, rules, suffix_dedup
from tidewatch.llm.common import documents, shuffle_partitions, written

#: Learned rules, registers, byte ranges and tokenisation have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


ROW = "__pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row (long): its doc_id where all are given and differ, else a number in a written table."""
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias(ROW)).count().filter(F.col(ROW).isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn(ROW, own)
    order = [own.asc_nulls_last(), F.col("__pipeline_read").asc()]
    dealt = docs.withColumn("__pipeline_read", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.drop("__pipeline_read").withColumn(ROW, F.monotonically_increasing_id()), "rows", compression="zstd")


def _by_row(rows: DataFrame) -> DataFrame:
    """The texts with the row key as doc_id, for operators that need one."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rows = _numbered(docs)
    verdicts = rules.judge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), ROW)
    return rows.join(verdicts.filter("kept").select(ROW), ROW, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: that with the smallest doc_id."""
    rows = _numbered(docs)
    groups = minhash.near_duplicates(_by_row(rows))
    return rows.join(groups.filter("doc_id = component_id").select(F.col("doc_id").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat a passage of an earlier one; bytes of a character cut apart go too."""
    rows = _numbered(docs)
    kept = suffix_dedup.remove_repeats(_by_row(rows)).select(F.col("doc_id").alias(ROW), F.try_validate_utf8(F.col("text").cast("string")).alias("clean"), F.make_valid_utf8(F.col("text").cast("string")).alias("repaired"))
    text = F.coalesce("clean", F.translate("repaired", "�", ""))
    kept = kept.select(ROW, text.alias("text"))
    rest = rows.drop("text", "n_chars")
    return rest.join(kept, ROW).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _copy_ids(copies: DataFrame, docs: DataFrame) -> DataFrame:
    """``copies`` with doc_ids of their own for the second and third of a document: above all ids of ``docs``, or below, or where neither has room, hashes that meet no other id."""
    kind, copy = docs.schema["doc_id"].dataType, F.col("__pipeline_copy")
    low, high = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    most, span = (1 << 31 if kind.simpleString() == "int" else 1 << 63) - 1, high - low + 1
    last = mixing.MOST_COPIES - 1
    if high + last * span <= most or low - last * span >= -most:
        step = span if high + last * span <= most else -span
        return copies.withColumn("doc_id", (F.col("doc_id") + copy * F.lit(step)).cast(kind))
    if most < 1 << 32:
        raise ValueError("no doc_ids of this type are left for the copies")
    seed = 0
    while True:
        own = F.when(copy > 0, F.xxhash64(F.lit(seed), "doc_id", copy)).otherwise(F.col("doc_id"))
        new = copies.select("doc_id", "__pipeline_copy", own.alias("__pipeline_id")).filter("doc_id IS NOT NULL").distinct()
        if new.groupBy("__pipeline_id").count().filter("count > 1").isEmpty():
            return copies.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), own))
        seed += 1


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies after the first get doc_ids that no document has, or none where the document has none."""
    rows = _numbered(docs)
    taken = mixing.mix(rows.select(F.col(ROW).alias("doc_id"), "text", "source")).filter("copies > 0").select(F.col("doc_id").alias(ROW), F.col("copies").alias("__pipeline_copies"))
    copies = rows.join(taken, ROW).withColumn("__pipeline_copy", F.explode(F.sequence(F.lit(0), F.col("__pipeline_copies").cast("int") - 1)))
    return _copy_ids(copies, docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
