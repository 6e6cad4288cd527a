"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Pieces are taken in batches of like length, longest first. A superstep range-sorts a batch and the
gaps that may hold it by size and sweeps every range upwards: a gap takes the longest document that
fits and is still free, which is the document's successor among the gaps; where several want one
gap, rank in the order decides. What a range leaves meets the ranges above it by rank. Then the gaps
are updated and the rest of the batch goes on; with no gap for it, sequences are opened.
A gap that holds several documents of the batch takes part as several slots.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, shared_dir, write, written
from .tokens import default_tokenizer, encoder

CAPACITY, END_ID = 2048, 0
RANGE_ROWS = 500_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut where longer than ``capacity``."""
    path = tokenizer or default_tokenizer()
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(text.as_py()) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def batches(capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Ranges (low, high] of lengths, longest first: those that a sequence holds once, twice, ... and then wider ones."""
    parts = [*range(1, 9), *(k << p for p in range(2, 40) for k in (3, 4))]
    edges = sorted({capacity // k for k in parts} | {0}, reverse=True)
    return list(zip(edges[1:], edges))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep over a range of documents and gaps by size: each gap takes the longest document not taken that fits.

    What the range leaves is numbered for the ranges above: documents from the longest, gaps from the smallest.
    """
    part = TaskContext.get().partitionId()
    docs: list[tuple[int, int]] = []
    out: list[tuple] = []
    alone = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * len(SWEPT)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SWEPT.values())], names=list(SWEPT))

    for b in batches:
        for size, kind, key, slot, free in zip(*(b.column(c).to_pylist() for c in ("size", "kind", "id", "slot", "free"))):
            if kind == 0:
                docs.append((key, size))
            elif docs:
                item, length = docs.pop()
                out.append((part, MATCHED, None, key, slot, free, item, length))
            else:
                out.append((part, GAP, alone, key, slot, free, None, None))
                alone += 1
        if len(out) > 100_000:
            yield batch()
            out.clear()
    out += [(part, DOC, k, None, None, None, item, length) for k, (item, length) in enumerate(reversed(docs))]
    yield batch()


MATCHED, GAP, DOC = 0, 1, 2
SWEPT = {"part": pa.int32(), "state": pa.int32(), "rank": pa.int64(), "sequence": pa.int64(), "slot": pa.int32(), "free": pa.int64(), "item": pa.int64(), "size": pa.int64()}
SWEPT_SQL = "part int, state int, rank long, sequence long, slot int, free long, item long, size long"
PLACED = "sequence long, item long, size long, offset long, left long, head boolean"


def _between_ranges(docs: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Spans (gap range, first gap, document range, first document, count) that match what single ranges left: gaps with the nearest documents below."""
    below: list[list[int]] = []  # range, documents left, documents taken
    spans = []
    for part in sorted(docs.keys() | gaps.keys()):
        done = 0
        while done < gaps.get(part, 0) and below:
            take = min(below[-1][1], gaps[part] - done)
            spans.append((part, done, below[-1][0], below[-1][2], take))
            done += take
            below[-1][1] -= take
            below[-1][2] += take
            if not below[-1][1]:
                below.pop()
        if docs.get(part):
            below.append([part, docs[part], 0])
    return spans


def _sweep(docs: DataFrame, gaps: DataFrame, slots: Column, rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """One superstep: (slots of gaps with what they took, documents left, their number, least length).

    Documents (item, size) and gaps (sequence, free), these in ``slots`` equal parts, are sorted by
    size over about ``rows`` / RANGE_ROWS ranges, and each range is swept on its own. The ranges'
    leftovers are matched by rank: the counts of a range, a row each, settle which meet.
    """
    spark = docs.sparkSession
    empty = F.lit(None)
    gaps = gaps.withColumn("slots", slots).select((F.expr("free div slots")).alias("size"), F.lit(1).alias("kind"), F.col("sequence").alias("id"), F.explode(F.sequence(F.lit(0), (F.col("slots") - 1).cast("int"))).alias("slot"), "free")
    both = docs.select("size", F.lit(0).alias("kind"), F.col("item").alias("id"), empty.cast("int").alias("slot"), empty.cast("long").alias("free")).unionByName(gaps)
    order = ["size", "kind", F.xxhash64("id", "slot")]
    ranges = max(1, -(-rows // RANGE_ROWS))
    dealt = both.repartitionByRange(ranges, *order) if ranges > 1 else both.repartition(1)  # a shuffle: a merged scan would hold all its readers open
    swept = written(dealt.sortWithinPartitions(*order, "id", "slot").mapInArrow(_match, SWEPT_SQL), "pack-sweep")
    if ranges == 1:
        swept = swept.coalesce(1)  # what one task has swept needs no shuffle to be counted and summed up
    tally = swept.groupBy("part", "state").agg(F.count("*").alias("n"), F.min("size").alias("least")).collect()  # three rows a range
    count = lambda state: {r.part: r.n for r in tally if r.state == state}
    spans = _between_ranges(count(DOC), count(GAP))
    met = swept.filter(F.col("state") != DOC).select("sequence", "slot", "free", "item", "size")
    left = swept.filter(F.col("state") == DOC).select("part", "rank", "item", "size")
    if spans:
        table = F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], "span long, gap_part int, gap_first long, doc_part int, doc_first long, n long"))  # at most two rows a range
        of_gap = (F.col("part") == F.col("gap_part")) & (F.col("rank") >= F.col("gap_first")) & (F.col("rank") < F.col("gap_first") + F.col("n"))
        of_doc = (F.col("part") == F.col("doc_part")) & (F.col("rank") >= F.col("doc_first")) & (F.col("rank") < F.col("doc_first") + F.col("n"))
        g = swept.filter(F.col("state") == GAP).join(table, of_gap, "left").select("span", (F.col("rank") - F.col("gap_first")).alias("k"), "sequence", "slot", "free")
        d = left.join(table, of_doc, "left")
        taken = d.filter("span IS NOT NULL").select("span", (F.col("rank") - F.col("doc_first")).alias("k"), "item", "size")
        met = swept.filter(F.col("state") == MATCHED).select("sequence", "slot", "free", "item", "size").unionByName(g.join(taken, ["span", "k"], "left").select("sequence", "slot", "free", "item", "size"))
        left = d.filter("span IS NULL")
    n = sum(count(DOC).values()) - sum(s[-1] for s in spans)
    return met, left.select("item", "size"), n, min((r.least for r in tally if r.state == DOC), default=0)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (any columns with length 1..capacity) with sequence_id and offset long, gapless from 0.

    Equal rows are items of their own; an empty table gives none. Columns sequence_id, offset and
    those that start with _pack are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    columns = items.columns
    items = written(items.withColumn("_pack_item", F.monotonically_increasing_id()), "pack-items")
    lengths = items.select(F.col("_pack_item").alias("item"), F.col("length").cast("long").alias("size"))
    folder = f"{shared_dir(spark)}/tidewatch/packed-{uuid.uuid4().hex}"
    (_, longest), *rest = todo = batches(capacity)
    half = todo[0][0]
    of_batch = sum((F.when(F.col("size") <= high, 1).otherwise(0) for _, high in rest), F.lit(0))
    amounts = {r[0]: r[1] for r in lengths.groupBy(of_batch.alias("b")).count().collect()}  # a row per batch
    files = max(1, -(-sum(amounts.values()) // RANGE_ROWS))
    # the longest open a sequence each, named by the item
    alone = lengths.filter(F.col("size") > half)
    write(alone.select(F.col("item").alias("sequence"), "item", "size", F.lit(0).cast("long").alias("offset"), (capacity - F.col("size")).alias("left"), F.lit(True).alias("head")), f"{folder}/step=0")
    gaps = spark.read.schema(PLACED).parquet(f"{folder}/step=0").select("sequence", F.col("left").alias("free"))
    opened, step = 0, 0
    for k, (low, high) in enumerate(rest, 1):
        docs, n, least = lengths.filter((F.col("size") > low) & (F.col("size") <= high)), amounts.get(k, 0), low + 1
        while n:
            able = gaps.filter(F.col("free") >= least)
            some = able.count()
            if not some:
                total = docs.agg(F.sum("size")).first()[0]
                some = max(-(-total // capacity), -(-n // (capacity // (low + 1))))
                able = spark.range(opened, opened + some).select((-1 - F.col("id")).alias("sequence"), F.lit(capacity).cast("long").alias("free"))
                opened += some
            most = max(1, -(-2 * n // some))
            slots = F.greatest(F.lit(1), F.least(F.expr(f"free div {high}"), F.lit(most)))
            met, docs, n, least_left = _sweep(docs, able, slots, n + min(some * most, 2 * n + some))
            step += 1
            of = Window.partitionBy("sequence")
            before = F.coalesce(F.sum("size").over(of.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            placed = met.select("sequence", "item", "size", (capacity - F.col("free") + before).alias("offset"), (F.col("free") - F.coalesce(F.sum("size").over(of), F.lit(0))).alias("left"), (F.row_number().over(of.orderBy("slot")) == 1).alias("head"))
            write(placed, f"{folder}/step={step}")
            changed = spark.read.schema(PLACED).parquet(f"{folder}/step={step}").filter("head").select("sequence", F.col("left").alias("free"))
            gaps = written(gaps.filter((F.col("free") < least) & (F.col("free") > 0)).unionByName(changed.filter("free > 0")).coalesce(files), "pack-gaps")
            least = least_left
    placed = spark.read.schema(PLACED).parquet(folder).filter("item IS NOT NULL").select(F.col("item").alias("_pack_item"), F.col("sequence").alias("sequence_id"), "offset")
    return items.join(placed, "_pack_item").select(*[F.col(f"`{c}`") for c in columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents with their places.

    Null and empty texts are one END_ID; texts of any length are cut into as many pieces as they
    need; equal rows and null doc_ids stay as they are; an empty table gives none; other columns of
    ``docs`` are ignored.
    """
    return pack(pieces(docs, capacity, tokenizer), capacity)


def op4(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
