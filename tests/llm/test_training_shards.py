"""Shards of the training order as files: each record at its byte offset."""

import os
import zlib

from tidewatch.llm import common, training_order

SF = "/root/testdata/sf0.001"


def test_records_stand_at_their_offsets(spark, tmp_path):
    docs, length, shard_records = common.documents(spark, SF), 64, 50
    path = f"file://{tmp_path}/shards"
    training_order.write_shards(docs, path, length, shard_records)
    rows = training_order.digests(training_order.read_shards(spark, path, length=length)).collect()
    stride = training_order.stride(length)
    assert len(rows) > 10 * shard_records
    for r in rows:
        assert r.shard == r.slot // shard_records and r.byte_offset == r.slot % shard_records * stride
        with open(f"{tmp_path}/shards/{training_order.shard_file(r.shard)}", "rb") as f:
            f.seek(r.byte_offset)
            record = f.read(stride)
        ids = b"".join(record[k : k + 2] + b"\0\0" for k in range(0, 2 * r.length, 2))
        assert len(record) == stride and not any(record[2 * r.length :]) and zlib.crc32(ids) == r.ids_crc32
    files = [f for f in os.listdir(tmp_path / "shards") if f != "index"]
    assert sorted(files) == [training_order.shard_file(k) for k in range(-(-len(rows) // shard_records))]
    assert sum(os.path.getsize(tmp_path / "shards" / f) for f in files) == len(rows) * stride
    late = training_order.read_shards(spark, path, from_slot=120, length=length).collect()
    assert sorted(r.slot for r in late) == list(range(120, len(rows)))


def test_offsets_of_the_query(spark):
    rows = training_order.op10(common.documents(spark, SF)).collect()
    assert all(r.byte_offset == r.slot % training_order.SHARD_RECORDS * training_order.ID_BYTES * training_order.SEQUENCE for r in rows)
