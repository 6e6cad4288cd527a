"""Training-order materialisation: fixed-stride token records at keyed pseudo-random global slots.

Sequences are numbered by document and piece, and a Feistel network over the smallest even
number of bits that holds them, walked until it lands inside, permutes these numbers: each slot
comes from its number and the key alone, without a sort or a table. A shard is one uncompressed file of
``shard_records`` records in slot order, written by one task; every record has the same number of
bytes, so a reader resumes at ``slot % shard_records * stride`` of its shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed_texts, mix, shared_dir, shuffle_partitions, write, written
from .tokens import default_tokenizer, encoder

SEQUENCE, SHARD_RECORDS, KEY, ROUNDS, END_ID, ID_BYTES = 1024, 8192, 20240607, 6, 0, 2
WAVES = 4


def feistel(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of range(size) by cycle-walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & mask
        for r in range(ROUNDS):
            with np.errstate(over="ignore"):
                f = mix(right * U64(0x9E3779B97F4A7C15) + U64((key * 0x2545F4914F6CDD1D + r * 0x632BE59BD9B4E019) % (1 << 64)))
            left, right = right, left ^ (f & mask)
        return (left << U64(half)) | right

    x = once(np.asarray(index).astype(U64))
    while (out := x >= U64(size)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def stride(length: int, id_bytes: int = ID_BYTES) -> int:
    """Bytes of a record of ``length`` ids."""
    return id_bytes * length


def shard_file(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def records(docs: DataFrame, length: int = SEQUENCE, key: int = KEY, tokenizer: str | None = None, id_bytes: int = ID_BYTES) -> DataFrame:
    """(slot, doc_id, piece, length, payload): ids and END_ID of each document in records of up to ``length`` ids.

    Numbers follow doc_id, then piece (null doc_ids first, equal doc_ids by text): texts are dealt by
    ranges of that order and encoded once, into a written table; a range's records start after those
    of the ranges before it. So the key alone settles the order, however the files are split.
    """
    path = tokenizer or default_tokenizer()
    step = id_bytes * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            doc_ids, pieces, lengths, payloads = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(np.frombuffer(enc.ids(text.as_py()), "<u4"), END_ID)
                if int(ids.max()) >= 1 << 8 * id_bytes:
                    raise ValueError(f"token ids need more than {id_bytes} bytes: set id_bytes")
                data = ids.astype(f"<u{id_bytes}").tobytes()
                for k, a in enumerate(range(0, len(data), step)):
                    payloads.append(data[a : a + step])
                    lengths.append(min(length, len(ids) - k * length))
                    pieces.append(k)
                    doc_ids.append(doc)
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(np.arange(done, done + n)), pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(lengths, pa.int32()), pa.array(payloads, pa.binary())],
                names=["part", "local", "doc_id", "piece", "length", "payload"],
            )
            done += n

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    dealt = keyed_texts(docs).repartitionByRange(shuffle_partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    encoded = written(dealt.mapInArrow(cut, "part int, local long, doc_id long, piece int, length int, payload binary"), "records", compression="zstd")
    sizes = dict(encoded.groupBy("part").count().collect())  # a row per range, of which there are spark.sql.shuffle.partitions
    ends = np.cumsum([sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)])
    before, total = np.r_[0, ends], int(ends[-1]) if len(ends) else 0
    slot = F.pandas_udf(lambda part, local: pd.Series(feistel(before[part.to_numpy()] + local.to_numpy(), total, key)), "long")
    return encoded.select(slot("part", "local").alias("slot"), "doc_id", "piece", "length", "payload")


def write_shards(docs: DataFrame, path: str, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS, key: int = KEY, tokenizer: str | None = None, id_bytes: int = ID_BYTES) -> None:
    """Write the records to ``path``: a file per shard = slot div ``shard_records``, and index, a table of where each record is.

    The record of a slot is the stride(length) bytes at byte_offset of its shard's file, zero-padded.
    A file is written under another name and renamed when it is whole; shards are written in WAVES rounds. ``path`` is a folder, on a
    store that pyarrow opens, which all nodes share. Null doc_ids come first; rows of one doc_id are
    ordered by text; null and empty texts are one END_ID; texts of any length are cut into as many
    records as they fill; an empty table writes no file; columns other than doc_id and text are
    ignored. ``id_bytes`` is the width of an id, 2 or 4; ids that need more raise.
    """
    step = stride(length, id_bytes)
    store, folder = FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        shard, name, out = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(name, f"{root}/{shard_file(shard)}")

        try:
            for b in batches:
                for s, offset, payload in zip(b.column("shard").to_pylist(), b.column("byte_offset").to_pylist(), b.column("payload").to_pylist()):
                    if s != shard:
                        close()
                        shard, name = s, f"{root}/.{shard_file(s)}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(name, buffer_size=1 << 20)
                    if out.tell() != offset:
                        raise ValueError(f"shard {s} has {out.tell()} bytes before the record at {offset}")
                    out.write(payload.ljust(step, b"\0"))
                yield b.drop_columns(["payload"])
            close()
            name = None
        finally:
            if name is not None:  # a failed task leaves no file
                out.close()
                fs.delete_file(name)

    rows = records(docs, length, key, tokenizer, id_bytes).withColumn("shard", F.expr(f"slot div {shard_records}")).withColumn("byte_offset", F.expr(f"(slot % {shard_records}) * {step}"))
    shards = -(-rows.count() // shard_records)
    waves = max(1, min(WAVES, shards))
    for k in range(waves):  # the shuffle files of one wave at a time stand beside the records and the shards
        part = rows.filter(F.col("shard") % waves == k).repartitionById(shuffle_partitions(docs.sparkSession), F.expr(f"CAST(shard div {waves} AS int)")).sortWithinPartitions("slot")
        write(part.mapInArrow(put, INDEX), f"{path}/index", mode="append", compression="zstd")


INDEX = "slot long, doc_id long, piece int, length int, shard long, byte_offset long"


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, length: int = SEQUENCE, id_bytes: int = ID_BYTES) -> DataFrame:
    """Records from ``from_slot`` on, their payloads read at their places in the shards; index files and row groups before it are skipped by their statistics."""
    step = stride(length, id_bytes)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        shard, file = None, None
        try:
            for b in batches:
                payloads = []
                for s, offset in zip(b.column("shard").to_pylist(), b.column("byte_offset").to_pylist()):
                    if s != shard:
                        if file is not None:
                            file.close()
                        shard, file = s, fs.open_input_file(f"{root}/{shard_file(s)}")
                    payloads.append(file.read_at(step, offset))
                    if len(payloads[-1]) != step:
                        raise ValueError(f"shard {s} ends within the record at {offset}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary())], names=[*b.schema.names, "payload"])
        finally:
            if file is not None:
                file.close()

    index = spark.read.schema(INDEX).parquet(f"{path}/index").filter(F.col("slot") >= from_slot)
    return index.mapInArrow(get, f"{INDEX}, payload binary")


def digests(rows: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """The records without their payloads, with the checksum of their ids as they stand in the shards."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(np.frombuffer(p.as_py(), f"<u{id_bytes}")[:n].astype("<u4")) for p, n in zip(b.column("payload"), b.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "length", "slot", "shard", "byte_offset")), pa.array(sums, pa.int64())], names=["doc_id", "piece", "length", "slot", "shard", "byte_offset", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, piece int, length int, slot long, shard long, byte_offset long, ids_crc32 long")


def op10(docs: DataFrame) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/tidewatch/shards-{uuid.uuid4().hex}"
    write_shards(docs, path)
    return digests(read_shards(docs.sparkSession, path))
