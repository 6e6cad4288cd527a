"""Capture files written byte by byte, and what is read from them."""

import random
import struct

import pytest

from tidewatch.operators import flows
from tidewatch.sources import capture_files, captures


def ipv4(l4: bytes, proto=6, src=(10, 0, 0, 1), dst=(93, 184, 0, 7), part=0x4000, total=None):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(l4) if total is None else total, 7, part, 64, proto, 0, *src, *dst) + l4


def tcp(flags=2, payload=b"", doff=5):
    return struct.pack(">HHIIBBHHH", 49152, 443, 1000, 2000, doff << 4, flags, 8192, 0, 0) + payload


ETHER = b"\0" * 12 + b"\x08\x00"
FRAMES = [
    (1, ETHER + ipv4(tcp(payload=b"hello"))),
    (1, b"\0" * 12 + b"\x81\x00\x00\x05\x88\xa8\x00\x06\x08\x00" + ipv4(tcp(18))),
    (101, ipv4(struct.pack(">HHHH", 5353, 53, 30, 0) + b"x" * 22, proto=17)),
    (1, ETHER + ipv4(b"\x08\x03\0\0", proto=1)),
    (113, b"\0" * 14 + b"\x08\x00" + ipv4(b"y" * 32, part=0x00B9)),
    (276, b"\x86\xdd" + b"\0" * 18 + struct.pack(">IHBB", 6 << 28, 24, 6, 55) + bytes(range(16)) + b"\xfd" + b"\0" * 15 + tcp(payload=b"data")),
    (1, b"\0" * 12 + b"\x08\x06" + b"\0" * 40),
    (1, ETHER + b"\x45\0"),
]


def classic(frames, order="<", nanos=False):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(order + "IIII", 100 + k, 5000 if nanos else 5, len(f), len(f)) + f for k, f in enumerate(frames))


def block(order, kind, body):
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def nextgen(frames, order="<", resolution=None):
    out = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    for linktype, _ in frames:
        option = struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0) if resolution is not None else b""
        out += block(order, 1, struct.pack(order + "HHI", linktype, 0, 0) + option)
    for k, (_, f) in enumerate(frames):
        ticks = 100_000_005 if resolution is None else (100 << (resolution & 0x7F) if resolution & 0x80 else 100 * 10**resolution)
        out += block(order, 6, struct.pack(order + "IIIII", k, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def test_decode(spark):
    rows = spark.createDataFrame([(k, link, bytearray(f)) for k, (link, f) in enumerate(FRAMES)], "packet_no long, linktype int, frame binary")
    got = {r.packet_no: r for r in captures.decode_frames(rows).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    a = got[0]
    assert (a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.protocol, a.ip_ttl, a.ip_id, a.ip_flags, a.frag_offset) == ("10.0.0.1", "93.184.0.7", 49152, 443, 6, 64, 7, 2, 0)
    assert (a.ip_len, a.ihl, a.tcp_flags, a.tcp_window, a.tcp_seq, a.tcp_ack, a.tcp_doff, a.payload_len, a.frame_len) == (45, 20, 2, 8192, 1000, 2000, 20, 5, 59)
    assert (got[1].tcp_flags, got[1].frame_len) == (18, 62)
    assert (got[2].src_port, got[2].dst_port, got[2].payload_len, got[2].tcp_doff) == (5353, 53, 22, 8)
    assert (got[3].src_port, got[3].dst_port, got[3].payload_len) == (8, 3, 0)
    assert (got[4].frag_offset, got[4].src_port, got[4].payload_len, got[4].tcp_doff) == (185, 0, 32, 0)
    assert (got[5].src_ip, got[5].dst_ip, got[5].ip_ttl, got[5].payload_len, got[5].ihl) == ("1:203:405:607:809:a0b:c0d:e0f", "fd00:0:0:0:0:0:0:0", 55, 4, 40)


def test_unknown_link_type(spark):
    with pytest.raises(Exception, match="unsupported link type 9"):
        captures.decode_frames(spark.createDataFrame([(9, bytearray(b"abc"))], "linktype int, frame binary")).collect()


@pytest.mark.parametrize("order", ["<", ">"])
def test_times_and_orders(order):
    f = FRAMES[0][1]
    assert [t for t, _, _ in captures.frames_of(classic([f, f], order))] == [100_000_005, 101_000_005]
    assert [t for t, _, _ in captures.frames_of(classic([f], order, nanos=True))] == [100_000_005]
    assert [(t, k) for t, k, _ in captures.frames_of(nextgen(FRAMES[:3], order))] == [(100_000_005, 1), (100_000_005, 1), (100_000_005, 101)]
    for resolution in (3, 9, 0x80 | 10):
        assert [t for t, _, _ in captures.frames_of(nextgen(FRAMES[:1], order, resolution))] == [100_000_000]


def test_cut_off_ends_are_left_out():
    f = FRAMES[0][1]
    assert len(list(captures.frames_of(classic([f, f])[:-3]))) == 1
    assert len(list(captures.frames_of(nextgen(FRAMES[:2])[:-3]))) == 1


@pytest.mark.parametrize("data", [b"", b"no capture", classic([])[:20], classic([]) + struct.pack("<IIII", 1, 1, 1 << 30, 1), nextgen([]) + struct.pack("<III", 6, 0, 0), nextgen([]) + struct.pack("<III", 6, 14, 0), nextgen([]) + block("<", 1, b"\0" * 4), nextgen([]) + block("<", 6, struct.pack("<IIIII", 0, 0, 0, 99, 99))])
def test_malformed(data):
    with pytest.raises(captures.MalformedCapture):
        list(captures.frames_of(data))


def test_files_to_flows(spark, tmp_path):
    f = FRAMES[0][1]
    (tmp_path / "a.pcap").write_bytes(classic([f, f, f]))
    (tmp_path / "b.pcapng").write_bytes(nextgen(FRAMES))
    (tmp_path / "c.pcap").write_bytes(classic([f]) + struct.pack("<IIII", 1, 1, 1 << 30, 1))
    path = f"file://{tmp_path}"
    frames = capture_files.read_frames(spark, path)
    assert sorted(frames.groupBy("capture_id").count().toPandas()["count"]) == [2, 3, 8]
    assert frames.filter("error IS NOT NULL").count() == 1
    got = capture_files.read_captures(spark, path)
    assert got.filter("error IS NULL").count() == 10
    assert [r.error for r in got.filter("error IS NOT NULL").collect()] == [f"a record of {1 << 30} bytes is over the limit of {16 << 20}"]
    assert capture_files.read_captures(spark, path, "DROPMALFORMED").count() == 10
    assert capture_files.read_captures(spark, path, max_packets=1).count() == 3
    with pytest.raises(Exception, match="over the limit"):
        capture_files.read_captures(spark, path, mode="FAILFAST").count()
    with pytest.raises(ValueError, match="mode"):
        capture_files.read_frames(spark, path, mode="ELSE")
    assert flows.assemble_flows(got).count() == flows.assemble_flows(capture_files.read_captures(spark, path, "DROPMALFORMED")).count() > 3


def nested(rng, order):
    """Frames of which many hold stretches of another capture's records, some up to their very end."""
    inner = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    body = classic(inner, order)[24:]
    out = []
    for _ in range(40):
        kind, cut = rng.randrange(4), rng.randint(0, len(body) - 1)
        payload = [b"", body[cut : cut + rng.randint(0, 1400)], body, nextgen([(1, x) for x in inner], order)[: rng.randint(0, 2000)]][kind]
        out.append(ETHER + ipv4(tcp(payload=payload)))
    return out


def test_ranges_of_any_size_give_the_same_packets(spark, tmp_path):
    rng, order = random.Random(8), "<"
    frames = nested(rng, order)
    two = nextgen([(rng.choice([1, 101]), f) for f in frames[:20]], order, 9)
    other = nextgen([(113, f) for f in frames[20:]], "<" if order == ">" else ">", 3)
    files = {"a.pcap": classic(frames, order), "b.pcap": classic(frames, ">", nanos=True)[:-7], "c.pcapng": two + other, "d.pcap": classic(frames[:20], order) + b"\xff" * 40 + classic(frames)[24:], "e.pcap": classic([]), "f.pcap": b"no capture", "h.pcapng": two + other + struct.pack("<III", 6, 14, 0) + other}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    path = f"file://{tmp_path}"
    want = []
    for name, data in files.items():
        packets = []
        try:
            for packet in captures.frames_of(data):
                packets.append(packet)
            error = None
        except captures.MalformedCapture as e:
            error = str(e)
        want.append((packets, error))
    assert sum(e is not None for _, e in want) == 3 and len(want[2][0]) == 40 and len(want[3][0]) == 20
    for size in (1 << 30, 5000, 700):
        got = {}
        for r in capture_files.read_frames(spark, path, range_bytes=size).collect():
            got.setdefault(r.capture_id, {})[r.packet_no] = (r.ts_us, r.linktype, r.frame, r.error)
        found = []
        for rows in got.values():
            error = rows.pop(None, (None,) * 4)[3]
            assert sorted(rows) == list(range(len(rows)))
            found.append(([(t, k, bytes(f)) for t, k, f, _ in (rows[n] for n in range(len(rows)))], error))
        assert sorted(found, key=repr) == sorted((w for w in want if w != ([], None)), key=repr)
    few = capture_files.read_frames(spark, path, range_bytes=1000, max_packets=7)
    assert sorted(few.filter("error IS NULL").groupBy("capture_id").count().toPandas()["count"]) == [7] * 5


def test_guess_starts_at_a_record():
    frames = [ETHER + ipv4(tcp(payload=b"x" * (k % 90))) for k in range(200)]
    for data in (classic(frames), classic(frames, ">"), nextgen([(1, f) for f in frames]), nextgen([(1, f) for f in frames], ">")):
        src = captures.Held(data)
        form, at = captures.opening(src)
        borders = [at, *(end for end, _ in captures.walk(src, captures.Form(**form.values()), at, len(data)))]
        for low in range(100, len(data) - 2000, 777):
            assert capture_files.guess(src, form, low, low + 2000)[0] == min(b for b in borders if b >= low)


def test_written_captures_read_back(spark, tmp_path):
    rows = [(k % 2, 10**15 + 7 * k, 1, bytearray(FRAMES[k % 2][1]), None) for k in range(50)] + [(0, None, 1, None, "bad")]
    frames = spark.createDataFrame(rows, "capture_id long, ts_us long, linktype int, frame binary, error string").repartition(3)
    path = f"file://{tmp_path}/out"
    files = capture_files.write_captures(frames, path).collect()
    assert sum(f.n_packets for f in files) == 50
    got = capture_files.read_captures(spark, path, "FAILFAST", range_bytes=200)
    assert sorted((r.ts_us, r.payload_len) for r in got.collect()) == sorted((t, 5 * (1 - k % 2)) for k, (_, t, *_) in enumerate(rows[:50]))


def test_stream_of_growing_captures(spark, tmp_path):
    rng = random.Random(3)
    frames = nested(rng, "<")
    whole = {"a.pcap": classic(frames), "b.pcapng": nextgen([(rng.choice([1, 101]), f) for f in frames], ">", 6), "c.pcap": classic(frames[:5]) + struct.pack("<IIII", 1, 1, 1 << 30, 1)}
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(capture_files.CaptureSource)
    stream = spark.readStream.format("tidewatch_captures").option("maxBytesPerTrigger", 3000).option("rangeBytes", 700).load(f"file://{folder}")
    query = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for part in (0.3, 0.31, 1.0):
            for name, data in whole.items():
                (folder / name).write_bytes(data[: int(part * len(data))])
            query.processAllAvailable()
        rows = spark.table("grown").collect()
    finally:
        query.stop()
    got = {}
    for r in rows:
        got.setdefault(r.capture_id, []).append(r)
    found = sorted((sorted((r.packet_no, r.ts_us, r.linktype, bytes(r.frame)) for r in c if r.error is None), sum(r.error is not None for r in c)) for c in got.values())
    want = [([(n, *p) for n, p in enumerate(captures.frames_of(whole[x]))], 0) for x in ("a.pcap", "b.pcapng")]
    want.append(([(n, *p) for n, p in enumerate(captures.frames_of(classic(frames[:5])))], 1))
    assert found == sorted(want)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    frames = [f for _, f in FRAMES[:2]] * 20
    folder = tmp_path / "in"
    folder.mkdir()
    counts = []
    for n in (10, 25, 40):
        (folder / "a.pcap").write_bytes(classic(frames[:n]))
        packets = capture_files.stream_captures(spark, f"file://{folder}")
        query = packets.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [10, 25, 40]


def test_decoding_takes_headers_alone(spark):
    """Frames go through column by column: no expression is evaluated once for each byte that is read."""
    frame = bytes(12) + b"\x08\x00" + bytes([0x45, 0, 0, 44, 0, 7, 0x40, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + (1024).to_bytes(2, "big") + (80).to_bytes(2, "big") + bytes(8) + bytes([0x60, 2, 1, 0, 0, 0, 0, 0])
    table = spark.createDataFrame([(1, 1, frame + bytes(5000)), (2, 1, None), (3, 1, frame[:30])], "packet_no long, linktype int, frame binary")
    got = captures.decode_frames(table)
    (r,) = got.collect()
    assert (r.packet_no, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.tcp_doff, r.payload_len, r.frame_len) == (1, "10.0.0.1", "10.0.0.2", 1024, 80, 24, 0, 5054)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("conv(") == 0
