"""Packet captures: their two formats, read record by record from any place, and frames decoded batch by batch."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import store_of

# --- fixed values of the file formats ------------------------------------------------------------
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9), b"\x4d\x3c\xb2\xa1": ("<", 10**9)}
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
ORDER_MARKS = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
RECORD_LIMIT = 16 << 20
ETHERNET, SLL, SLL2, RAW = 1, 113, 276, (101, 12, 14)
IPV4, IPV6, TAGS = 0x0800, 0x86DD, (0x8100, 0x88A8)
TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58
# -------------------------------------------------------------------------------------------------

FRAMES = "capture_id long, packet_no long, ts_us long, linktype int, frame binary, error string"
PACKETS = (
    "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_ttl int, ip_id int, ip_flags int, frag_offset int, ip_len long, ihl int, "
    "tcp_flags int, tcp_window long, tcp_seq long, tcp_ack long, tcp_doff int, payload_len long, frame_len long"
)
PACKET_COLUMNS = tuple(c.split()[0] for c in PACKETS.split(", "))


class MalformedCapture(ValueError):
    pass


class Held:
    """Bytes in memory, read by place."""

    def __init__(self, data: bytes):
        self._view, self.length = memoryview(data), len(data)

    def get(self, at: int, size: int) -> memoryview:
        return self._view[at : at + size]


class Opened:
    """A file on any store that pyarrow opens, read by place through a buffer of ``CHUNK`` bytes."""

    CHUNK = 4 << 20

    def __init__(self, path: str, length: int | None = None):
        store, name = store_of(path)
        self._file = store.open_input_file(name)
        self.length = self._file.size() if length is None else length
        self._from, self._view = 0, memoryview(b"")

    def get(self, at: int, size: int) -> memoryview:
        size = max(0, min(size, self.length - at))
        if at < self._from or at + size > self._from + len(self._view):
            self._file.seek(at)
            self._from, self._view = at, memoryview(self._file.read(max(size, min(self.CHUNK, self.length - at))))
        return self._view[at - self._from : at - self._from + size]

    def close(self) -> None:
        self._file.close()


class Form:
    """What must be known of a capture before a place in it, to read on from there: byte order, clock and link types. Plain values, so that it goes with rows and stream offsets."""

    def __init__(self, blocks: bool, order: str = "<", per_second: int = 10**6, linktype: int = ETHERNET, interfaces: Iterable = ()):
        self.blocks, self.order, self.per_second, self.linktype = blocks, order, per_second, linktype
        self.interfaces = [tuple(x) for x in interfaces]  # (link type, clock option or None)

    def values(self) -> dict:
        return vars(self)


def opening(src) -> tuple[Form, int]:
    """The form of a capture and the place of its first record."""
    head = bytes(src.get(0, 24))
    if head[:4] == SECTION.to_bytes(4, "little"):
        return Form(True), 0
    if head[:4] not in CLASSIC:
        raise MalformedCapture("no capture: unknown first bytes")
    if len(head) < 24:
        raise MalformedCapture("the file ends within its header")
    order, per_second = CLASSIC[head[:4]]
    return Form(False, order, per_second, struct.unpack_from(order + "I", head, 20)[0]), 24


def walk(src, form: Form, at: int, stop: int, frames: bool = True) -> Iterator[tuple[int, tuple | None]]:
    """(place after it, packet or None) of each record that starts before ``stop``; a packet is (time in microseconds, link type, frame). Without ``frames``, these are None. A cut-off last record counts for nothing and ends the capture."""
    return (_blocks if form.blocks else _classic)(src, form, at, stop, frames)


def _classic(src, form: Form, at: int, stop: int, frames: bool) -> Iterator[tuple[int, tuple | None]]:
    header = struct.Struct(form.order + "4I")
    while at < stop:
        head = src.get(at, 16)
        if len(head) < 16:
            return
        seconds, part, size, _ = header.unpack(head)
        if size > RECORD_LIMIT:
            raise MalformedCapture(f"a record of {size} bytes is over the limit of {RECORD_LIMIT}")
        if at + 16 + size > src.length:
            return
        packet = (seconds * 10**6 + part * 10**6 // form.per_second, form.linktype, bytes(src.get(at + 16, size)) if frames else None)
        at += 16 + size
        yield at, packet


def _clock(options: memoryview, order: str) -> int | None:
    """Option 9 of an interface: how its ticks become seconds."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 0:
            break
        if code == 9 and size and at + 4 < len(options):
            return options[at + 4]
        at += 4 + size + -size % 4
    return None


def _micros(ticks: int, clock: int | None) -> int:
    """Microseconds; ticks are such without a clock option."""
    if clock is None:
        return ticks
    return ticks * 10**6 // (2 ** (clock & 0x7F) if clock & 0x80 else 10**clock)


def _blocks(src, form: Form, at: int, stop: int, frames: bool) -> Iterator[tuple[int, tuple | None]]:
    while at < stop:
        head = src.get(at, 12)
        if len(head) < 8:
            return
        (kind,) = struct.unpack_from(form.order + "I", head)
        if kind == SECTION:  # reads the same in both orders
            mark = bytes(head[8:12])
            if len(mark) < 4:
                return
            if mark not in ORDER_MARKS:
                raise MalformedCapture("a section of unknown byte order")
            form.order, form.interfaces = ORDER_MARKS[mark], []
        (size,) = struct.unpack_from(form.order + "I", head, 4)
        if size % 4 or not (28 if kind == SECTION else 12) <= size <= RECORD_LIMIT:
            raise MalformedCapture(f"a block of {size} bytes")
        if at + size > src.length:
            return
        packet = None
        if kind == INTERFACE:
            body = src.get(at + 8, size - 12)
            if len(body) < 8:
                raise MalformedCapture("an interface block of under 8 bytes")
            form.interfaces.append((struct.unpack_from(form.order + "H", body)[0], _clock(body[8:], form.order)))
        elif kind == PACKET:
            if size < 32:
                raise MalformedCapture("a packet block of under 20 bytes")
            of, high, low, held, _ = struct.unpack(form.order + "5I", src.get(at + 8, 20))
            if held > size - 32:
                raise MalformedCapture(f"a packet of {held} bytes in a block with {size - 32}")
            linktype, clock = form.interfaces[of] if of < len(form.interfaces) else (ETHERNET, None)
            packet = (_micros(high << 32 | low, clock), linktype, bytes(src.get(at + 28, held)) if frames else None)
        at += size
        yield at, packet


def frames_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(time in microseconds, link type, frame) of every packet of a classic or next-generation capture; a cut-off end is left out."""
    src = Held(data)
    form, at = opening(src)
    return (packet for _, packet in walk(src, form, at, src.length) if packet is not None)


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
_NAMES = [c.split()[0] for c in FRAMES.split(", ")]


def frame_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of FRAMES in batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if len(held) == 10_000 or size > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)


HEAD = 128  # tags, the longest IP header and the longest header beyond it that is read take 102


def _addresses(data: np.ndarray, at: np.ndarray, six: np.ndarray) -> pa.Array:
    """Addresses as texts: of 16 bytes where ``six``, else of 4; each distinct one is written out once."""
    out = np.empty(len(at), object)
    for of, size in ((~six, 4), (six, 16)):
        if of.any():
            raw = np.ascontiguousarray(data[at[of][:, None] + np.arange(size)])
            distinct, which = np.unique(raw.view(f"V{size}").ravel(), return_inverse=True)
            texts = [".".join(map(str, v.tobytes())) if size == 4 else ":".join(f"{g:x}" for g in struct.unpack(">8H", v.tobytes())) for v in distinct]
            out[of] = np.array(texts, object)[which.ravel()]
    return pa.array(out, pa.string())


def _decoded(b: pa.RecordBatch, rest: list[str]) -> pa.RecordBatch:
    """The packets of a batch of ``rest``, _link, _size (of the frame) and _head (its first HEAD bytes)."""
    heads = b.column("_head").cast(pa.binary())
    starts = np.frombuffer(heads.buffers()[1], np.int32)[heads.offset : heads.offset + len(heads)].astype(np.int64)
    data = np.r_[np.frombuffer(heads.buffers()[2] or b"", np.uint8), np.zeros(4 * HEAD, np.uint8)]
    link, size = b.column("_link").fill_null(-1).to_numpy(zero_copy_only=False), b.column("_size").to_numpy()
    for strange in link[~np.isin(link, (ETHERNET, SLL, SLL2, *RAW))]:
        raise ValueError(f"unsupported link type {strange}")

    def number(at: np.ndarray, n: int) -> np.ndarray:
        """Big-endian numbers; past a frame's end they mean nothing."""
        out = np.zeros(len(at), np.int64)
        for k in range(n):
            out = out << 8 | data[at + k]
        return out

    first, second, third = (number(starts + k, 2) for k in (12, 16, 20))
    two = (size >= 22) & np.isin(first, TAGS) & np.isin(second, TAGS)
    one = (size >= 18) & np.isin(first, TAGS)
    ether = np.where(two, third, np.where(one, second, np.where(size >= 14, first, -1)))
    version = np.where(size >= 1, number(starts, 1) >> 4, 0)
    raw = np.where(version == 4, IPV4, np.where(version == 6, IPV6, -1))
    kind = np.select([link == ETHERNET, link == SLL, link == SLL2], [ether, np.where(size >= 16, number(starts + 14, 2), -1), np.where(size >= 20, number(starts, 2), -1)], raw)
    skip = np.select([link == ETHERNET, link == SLL, link == SLL2], [np.where(two, 22, np.where(one, 18, 14)), 16, 20], 0)
    six, ip, held = kind == IPV6, starts + skip, np.maximum(0, size - skip)
    lead = number(ip, 1)
    ihl = np.where(six, 40, (lead & 15) * 4)
    fine = np.where(six, (held >= 40) & (lead >> 4 == 6), (kind == IPV4) & (held >= 20) & (lead >> 4 == 4) & (ihl >= 20) & (held >= ihl))
    b, size, six, ip, held, ihl = b.filter(pa.array(fine)), size[fine], six[fine], ip[fine], held[fine], ihl[fine]

    zero = lambda x: np.where(six, 0, x)
    stated, part = number(ip + 2, 2), number(ip + 6, 2)
    length = np.where(six, number(ip + 4, 2) + 40, np.where(stated > 0, stated, held))
    protocol, ttl, frag = number(ip + np.where(six, 6, 9), 1), number(ip + np.where(six, 7, 8), 1), zero(part & 0x1FFF)
    l4, beyond, left = ip + ihl, held - ihl, np.maximum(0, length - ihl)
    head = frag == 0
    tcp, udp, icmp = head & (protocol == TCP) & (beyond >= 20), head & (protocol == UDP) & (beyond >= 8), head & np.isin(protocol, (ICMP, ICMPV6)) & (beyond >= 4)
    offset, stated = np.maximum(20, (number(l4 + 12, 1) >> 4) * 4), number(l4 + 4, 2)
    of_tcp = lambda at, n: np.where(tcp, number(l4 + at, n), 0)
    port = lambda at, k: np.where(tcp | udp, number(l4 + at, 2), np.where(icmp, number(l4 + k, 1), 0))
    payload = np.select([tcp, udp, icmp], [left - offset, np.where(stated >= 8, stated, left) - 8, left - 8], left)
    made = [
        _addresses(data, ip + np.where(six, 8, 12), six), _addresses(data, ip + np.where(six, 24, 16), six), port(0, 0), port(2, 1), protocol, ttl, zero(number(ip + 4, 2)), zero(part >> 13), frag, length, ihl,
        of_tcp(13, 1), of_tcp(14, 2), of_tcp(4, 4), of_tcp(8, 4), np.where(tcp, offset, np.where(udp | icmp, 8, 0)), np.maximum(0, payload), size,
    ]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in PACKETS.split(", ")]
    return pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(x, t) for x, t in zip(made, types)], names=[*rest, *PACKET_COLUMNS])


def decode_frames(frames: DataFrame) -> DataFrame:
    """``frames`` (linktype, frame and any others) with the packet's columns in place of the two.

    Frames that hold no readable IPv4 or IPv6 packet go. Ethernet may carry two tags; fragments after
    the first have lengths only; ICMP shows type and code as ports. Other link types raise. Batches
    are decoded column by column, and hold only the headers of their frames.
    """
    rest = [c for c in frames.columns if c not in ("linktype", "frame", "error")]
    # a generator keeps a frame's expression from being written out wherever the frame is used
    once = frames.select(*rest, F.inline(F.array(F.struct(F.col("linktype").cast("int").alias("_link"), F.col("frame").alias("_frame"))))).filter("_frame IS NOT NULL")
    heads = once.select(*rest, "_link", F.length("_frame").cast("long").alias("_size"), F.substring("_frame", 1, HEAD).alias("_head"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _decoded(b, rest)

    schema = StructType([*(f for f in heads.schema if f.name in rest), *StructType.fromDDL(PACKETS)])
    return heads.mapInArrow(decode, schema)
