"""Capture files to packets, in byte ranges of any size, and folders of growing captures as a stream.

A range of a capture does not show where its first record starts. Every range first guesses: the
earliest place from which several plausible headers follow one another; then it skims its headers.
A range's records must begin where those of the range before it end, so a guess that does not is
skimmed again from there: the ranges that stand are those of a reading from the start. The skim
also tells each range's first packet number and what blocks before it declare.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .captures import FRAMES, RECORD_LIMIT, SECTION, Form, MalformedCapture, Opened, decode_frames, frame_batches, opening, walk
from .shared import materialised, store_of

RANGE_BYTES, CHAIN, MAX_TASKS = 128 << 20, 8, 20_000
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
_RANGE = "path string, capture_id long, length long, k int, low long, high long"
_SKIM = f"{_RANGE}, first long, form string, last long, after_order string, declared string, resets boolean, n_packets long, error string, wrong boolean, first_packet long"


# --- where a range's first record starts -----------------------------------------------------------


def _plausible(src, form: Form, at: int) -> int | None:
    """The place after a record whose header at ``at`` looks sound, None if it does not."""
    head = src.get(at, 16)
    if form.blocks:
        if len(head) < 12:
            return None
        kind, size = struct.unpack_from(form.order + "2I", head)
        if size % 4 or not 12 <= size <= RECORD_LIMIT or at + size > src.length:
            return None
        if kind == SECTION and struct.unpack_from(form.order + "I", head, 8)[0] != 0x1A2B3C4D:
            return None
        return at + size if src.get(at + size - 4, 4) == head[4:8] else None
    if len(head) < 16:
        return None
    _, part, size, whole = struct.unpack(form.order + "4I", head)
    return at + 16 + size if part < form.per_second and size <= whole <= RECORD_LIMIT and at + 16 + size <= src.length else None


def _candidates(data: np.ndarray, form: Form) -> np.ndarray:
    """Places in ``data`` that may hold a header, by its fixed limits alone."""
    if form.blocks:
        words = data[: len(data) // 4 * 4].view(form.order + "u4")
        return np.flatnonzero((words[1:] >= 12) & (words[1:] <= RECORD_LIMIT) & (words[1:] % 4 == 0)) * 4
    if len(data) < 16:
        return np.zeros(0, np.int64)
    part, size, whole = (_numbers(data, k, form.order) for k in (4, 8, 12))
    return np.flatnonzero((part < form.per_second) & (size <= whole) & (whole <= RECORD_LIMIT))


def _numbers(data: np.ndarray, k: int, order: str) -> np.ndarray:
    """The 32-bit number ``k`` bytes after each place that has 16 bytes."""
    parts = [data[k + i : len(data) - 15 + k + i].astype(np.uint32) for i in range(4)]
    if order == "<":
        parts.reverse()
    return (parts[0] << 24) | (parts[1] << 16) | (parts[2] << 8) | parts[3]


def guess(src, form: Form, low: int, high: int) -> tuple[int, str] | None:
    """(place, byte order) of the first record that seems to start in [low, high)."""
    step = 1 << 20
    if form.blocks:
        low += -low % 4
    for at in range(low, high, step):
        data = np.frombuffer(src.get(at, min(step, high - at) + 16), np.uint8)
        found = []
        for order in "<>" if form.blocks else form.order:
            trial = Form(form.blocks, order, form.per_second)
            for place in _candidates(data, trial) + at:
                end, links = int(place), 0
                while links < CHAIN and end is not None and end < src.length:
                    end, links = _plausible(src, trial, end), links + 1
                if end is not None and place < min(high, at + step):
                    found.append((int(place), order))
                    break
        if found:
            return min(found)
    return None


# --- ranges -----------------------------------------------------------------------------------------


def _skim(low: int, high: int, path: str, length: int, start: int | None, form: str | None) -> dict:
    """first, form, last, after_order, declared, resets, n_packets and error of the records that start in [low, high): from ``start``, where it is known, else from a guess; first is null where none is found."""
    src = Opened(path, length)
    none = {"first": None, "form": None, "last": None, "after_order": None, "declared": None, "resets": False, "n_packets": 0, "error": None}
    try:
        try:
            head, first = opening(src)
        except MalformedCapture as e:
            return none if low else none | {"first": 0, "last": length, "error": str(e)}
        state = Form(**json.loads(form)) if form else head
        if not low:
            start = first
        elif start is None:
            got = guess(src, head, low, high)
            if got is None:
                return none
            start, state.order = got
        state.interfaces = own = []
        found = none | {"first": start, "form": json.dumps(state.values())}
        at, n, error = start, 0, None
        try:
            for at, packet in walk(src, state, start, high, frames=False):
                n += packet is not None
        except MalformedCapture as e:
            error = str(e)
        return found | {"last": at if at >= high and not error else length, "after_order": state.order, "declared": json.dumps(state.interfaces), "resets": state.interfaces is not own, "n_packets": n, "error": error}
    finally:
        src.close()


def _skimmed(ranges: DataFrame) -> DataFrame:
    def skim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([r | _skim(r["low"], r["high"], r["path"], r["length"], r["first"], r["form"])], b.schema)

    return ranges.mapInArrow(skim, _SKIM)


def _settle(table: pa.Table) -> pa.Table:
    """A file's ranges in order: those that do not start where the records before them end are ``wrong`` and told where to start; the ranges before the first wrong one get first_packet and the interfaces declared before them. Beyond it, ends that wrong ranges had found themselves count until the next round."""
    rows, end, order, interfaces, n = sorted(table.to_pylist(), key=lambda r: r["k"]), 0, None, [], 0
    base, stands = json.loads(rows[0]["form"] or "{}"), True
    for r in rows:
        form = json.loads(r["form"]) if r["form"] else base
        if r["k"] and end >= min(r["high"], r["length"]):
            if stands:
                r |= {"first": None, "form": None, "n_packets": 0, "error": None}
            continue
        if r["k"] and (r["first"] != end or form["order"] != order):
            r |= {"first": end, "form": json.dumps(form | {"order": order, "interfaces": []}), "wrong": True}
            stands = False
            if r["last"] is None or r["error"]:
                break
        if not stands:
            end, order = r["last"], r["after_order"]
            continue
        r["first_packet"], end, order = n, r["last"], r["after_order"]
        n += r["n_packets"]
        if r["form"]:
            r["form"] = json.dumps(form | {"interfaces": interfaces})
            declared = json.loads(r["declared"])
            interfaces = declared if r["resets"] else interfaces + declared
    return pa.Table.from_pylist(rows, table.schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """A task for each row, as far as MAX_TASKS allow."""
    return rows.repartition(max(1, min(MAX_TASKS, rows.count())))


def capture_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The captures under ``path`` in ranges of about ``range_bytes``: path, capture_id (a hash of the path), first and last place of the records that start in a range, the form to read them by, first_packet, n_packets and error, which the last range of a malformed file has.

    A small table, written: one row for each range that holds records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("capture_id"), "length")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("*", low.alias("low")).select("path", "capture_id", "length", F.floor(F.col("low") / range_bytes).cast("int").alias("k"), "low", F.greatest(F.lit(1), F.least("length", F.col("low") + range_bytes)).alias("high"))
    rest = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _SKIM.removeprefix(_RANGE + ", ").split(", ")]
    table = _skimmed(_dealt(ranges.select("*", *rest)))
    while True:
        table = materialised(table.groupBy("path").applyInArrow(_settle, _SKIM), "ranges")
        wrong = table.filter("wrong").withColumn("wrong", F.lit(False))
        if wrong.isEmpty():
            return table.filter("first IS NOT NULL").select("path", "capture_id", "length", "first", "last", "form", "first_packet", "n_packets", "error")
        table = table.filter("wrong IS NULL OR NOT wrong").unionByName(_skimmed(_dealt(wrong)))


def frames_in_ranges(ranges: DataFrame, mode: str = "PERMISSIVE", max_packets: int | None = None) -> DataFrame:
    """The frames of ``capture_ranges``, a task a range."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    most = (1 << 62) if max_packets is None else max_packets

    def packets(r: dict) -> Iterator[tuple]:
        n = r["first_packet"]
        if r["form"] and n < most:
            src = Opened(r["path"], r["length"])
            try:
                for _, packet in walk(src, Form(**json.loads(r["form"])), r["first"], r["last"]):
                    if packet is not None:
                        if n >= most:
                            break
                        yield r["capture_id"], n, *packet, None
                        n += 1
            except MalformedCapture:
                pass  # told by the row's error
            finally:
                src.close()
        if r["error"] and n < most:
            if mode == "FAILFAST":
                raise MalformedCapture(f"{r['path']}: {r['error']}")
            if mode == "PERMISSIVE":
                yield r["capture_id"], None, None, None, None, r["error"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from frame_batches(packets(r))

    return _dealt(ranges.filter(F.col("first_packet") < most)).mapInArrow(read, FRAMES)


def read_frames(spark: SparkSession, path: str, mode: str = "PERMISSIVE", max_packets: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(capture_id, packet_no, ts_us, linktype, frame, error) of the files under ``path``; capture_id is a hash of a file's path, packet_no a packet's place in it.

    A malformed file gives its frames up to there and then, in PERMISSIVE mode, one row with only
    capture_id and error; none in DROPMALFORMED mode; in FAILFAST mode it fails the query. A cut-off
    last record is left out, and Spark lists no empty files. ``max_packets`` counts packets of a file, and errors beyond them are not
    seen. Files are skimmed once when this is called, in ranges of ``range_bytes``, and read once
    when the rows are used; their store must be one that pyarrow opens.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    return frames_in_ranges(capture_ranges(spark, path, range_bytes), mode, max_packets)


def read_captures(spark: SparkSession, path: str, mode: str = "PERMISSIVE", max_packets: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The packets of the capture files under ``path`` and, as ``read_frames`` tells them, their errors: rows with capture_id and error only."""
    frames = materialised(read_frames(spark, path, mode, max_packets, range_bytes), "frames") if mode == "PERMISSIVE" else read_frames(spark, path, mode, max_packets, range_bytes)
    packets = decode_frames(frames)
    if mode != "PERMISSIVE":
        return packets
    return packets.withColumn("error", F.lit(None).cast("string")).unionByName(frames.filter("error IS NOT NULL").select("capture_id", "error"), allowMissingColumns=True)


def write_captures(frames: DataFrame, path: str) -> DataFrame:
    """Write (capture_id, ts_us, frame) as classic captures under ``path``, one for each capture and task, in microseconds and the order of the rows in it; gives (capture_id, file, n_packets), which must be read for the files to be written. Rows without time or frame are left out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = store_of(path)
        store.create_dir(folder)
        files, counts = {}, {}
        for b in batches:
            for capture, ts, frame in zip(*(b.column(c).to_pylist() for c in ("capture_id", "ts_us", "frame"))):
                if ts is None or frame is None:
                    continue
                if capture not in files:
                    name = f"{folder}/capture-{capture}-{TaskContext.get().partitionId()}.pcap"
                    files[capture] = name, store.open_output_stream(name)
                    files[capture][1].write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, RECORD_LIMIT, 1))
                files[capture][1].write(struct.pack("<4I", ts // 10**6, ts % 10**6, len(frame), len(frame)) + frame)
                counts[capture] = counts.get(capture, 0) + 1
        for _, out in files.values():
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(list(files)), pa.array([n for n, _ in files.values()]), pa.array([counts[c] for c in files], pa.int64())], names=["capture_id", "file", "n_packets"])

    return frames.select(F.col("capture_id").cast("long").alias("capture_id"), F.col("ts_us").cast("long").alias("ts_us"), "frame").mapInArrow(write, "capture_id long, file string, n_packets long")


# --- streams ----------------------------------------------------------------------------------------


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int, number: int, form: dict):
        self.path, self.first, self.last, self.number, self.form = path, first, last, number, form


class CaptureStream(DataSourceStreamReader):
    """A folder of captures that grow or come anew. The offset holds, for each file, the place after its last whole record that was given, the number of packets before it and the form there."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxbytespertrigger", 256 << 20))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.seen: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def _files(self) -> Iterator[tuple[str, int]]:
        store, folder = store_of(self.path)
        for f in sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path):
            if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
                yield self.path.rstrip("/") + "/" + f.base_name, f.size

    def latestOffset(self) -> dict:  # noqa: N802
        """The next whole records of every file: headers of at most about maxBytesPerTrigger new bytes are skimmed."""
        files, left = dict(self.seen), self.most
        for path, length in self._files():
            at, number, form, error = files.get(path, (0, 0, None, None))
            if error or length <= at or left <= 0:
                continue
            end, number, form, error = _advance(path, at, number, form, min(length, at + left), length)
            left -= end - at
            if form is not None or error:
                files[path] = (end, number, form, error)
        self.seen = files
        return {"files": {p: list(x) for p, x in files.items()}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {p: tuple(x) for p, x in end["files"].items()} | self.seen
        out: list[InputPartition] = []
        for path, (last, _, _, error) in end["files"].items():
            at, number, form, _ = start["files"].get(path, (0, 0, None, None))
            while at < last:
                to, following, after, _ = _advance(path, at, number, form, min(last, at + self.range_bytes), last)
                if to == at:
                    break
                out.append(_Stretch(path, at, min(to, last), number, form))
                at, number, form = to, following, after
            if error and not start["files"].get(path, (0, 0, None, None))[3]:
                out.append(_Stretch(path, -1, -1, 0, {"error": error}))
        return out

    def read(self, stretch: _Stretch) -> Iterator[pa.RecordBatch]:
        if stretch.first < 0:
            yield from frame_batches([(_path_hash(stretch.path), None, None, None, None, stretch.form["error"])])
            return
        src = Opened(stretch.path, stretch.last)
        form, first = opening(src) if stretch.form is None else (Form(**stretch.form), stretch.first)
        capture, n = _path_hash(stretch.path), stretch.number
        yield from frame_batches((capture, n + k, *packet, None) for k, packet in enumerate(p for _, p in walk(src, form, first, stretch.last) if p is not None))
        src.close()

    def commit(self, end: dict) -> None:
        pass


def _advance(path: str, at: int, number: int, form: dict | None, stop: int, length: int) -> tuple[int, int, dict | None, str | None]:
    """Skim whole records from ``at``: (place after the last that starts before ``stop``, packets before that, form there, error)."""
    src = Opened(path, length)
    try:
        if form is None and length < 24:
            return at, number, None, None  # not written far enough to be told
        state, at = opening(src) if form is None else (Form(**form), at)
        for at, packet in walk(src, state, at, stop, frames=False):
            number += packet is not None
        return at, number, json.loads(json.dumps(state.values())), None
    except MalformedCapture as e:
        return at, number, form, str(e)
    finally:
        src.close()


def _path_hash(path: str) -> int:
    """A capture's number in a stream: 64 bits of its path's digest."""
    import hashlib

    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big", signed=True)


class CaptureSource(DataSource):
    """``spark.readStream.format("tidewatch_captures").load(folder)``: frames of captures as they grow; options maxBytesPerTrigger and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_captures"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema: StructType) -> CaptureStream:  # noqa: N802
        return CaptureStream({k.lower(): v for k, v in self.options.items()})


def stream_captures(spark: SparkSession, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """The packets of a folder's captures as an unbounded table, ended records only; a file that turns out malformed gives no more."""
    spark.dataSource.register(CaptureSource)
    frames = spark.readStream.format("tidewatch_captures").option("maxBytesPerTrigger", max_bytes).load(folder)
    return decode_frames(frames)
