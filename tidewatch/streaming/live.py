"""Unbounded packets and flows: event-time windows, lookbacks and idle sessions under a watermark.

Rows older than the watermark are dropped, and Spark's query progress tells how many
(``numRowsDroppedByWatermark``); state is bounded by the watermark and the window.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators.flows import CONVERSATION, canonical_key, derived_features
from ..schema import ACTIVE_US, HISTORY_US, IDLE_US, WINDOW_US
from ..sources.shared import store_of
from . import flow_state

DELAY = "60 seconds"


def stream_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files as a stream (a folder, or a pattern for single files); a message source takes its place by another ``readStream``."""
    return spark.readStream.schema(schema).parquet(path)


def with_event_time(rows: DataFrame, micros: str, delay: str = DELAY) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros(F.col(micros))).withWatermark("ts", delay)


def _at(name: str) -> Column:
    return F.unix_micros(F.col(f"w.{name}")).alias(f"{name}_us")


def stream_window_counts(flows: DataFrame, window: str = "30 seconds") -> DataFrame:
    """Flows and bytes of each tumbling window and capture, once it has closed."""
    g = flows.groupBy(F.window("ts", window).alias("w"), "capture_id").agg(F.count("*").alias("n_flows"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("total_bytes"))
    return g.select("capture_id", _at("start"), "n_flows", "total_bytes")


def stream_window_distincts(flows: DataFrame, window: str = "30 seconds") -> DataFrame:
    """Distinct sources, destinations and destination ports of each tumbling window and capture, once it has closed: values are counted by window, and closed windows' values are counted again."""
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    each = flows.select("ts", "capture_id", F.explode(F.array(value("src", "src_ip"), value("dst", "dst_ip"), value("port", "dst_port"))).alias("x")).select("ts", "capture_id", "x.*")
    seen = each.groupBy(F.window("ts", window).alias("w"), "capture_id", "kind", "value").agg(F.count("*").alias("n"))
    n = lambda kind: F.count(F.when((F.col("kind") == kind) & F.col("value").isNotNull(), 1))
    g = seen.groupBy(F.window(F.window_time("w"), window).alias("w"), "capture_id").agg(F.sum(F.when(F.col("kind") == "src", F.col("n"))).alias("n_flows"), n("src").alias("distinct_src_ips"), n("dst").alias("distinct_dst_ips"), n("port").alias("distinct_dst_ports"))
    return g.select("capture_id", _at("start"), "n_flows", "distinct_src_ips", "distinct_dst_ips", "distinct_dst_ports")


def stream_history(flows: DataFrame, span: str = "600 seconds", step: str = "30 seconds") -> DataFrame:
    """Contacts of each destination in every sliding lookback, once it has closed."""
    g = flows.groupBy(F.window("ts", span, step).alias("w"), "capture_id", "dst_ip").agg(F.count("*").alias("contacts"))
    return g.select("capture_id", "dst_ip", _at("start"), "contacts")


def stream_idle_sessions(packets: DataFrame, idle: str = "120 seconds") -> DataFrame:
    """Packets of each address pair between idle gaps, once the gap has passed."""
    pair = (F.least("src_ip", "dst_ip").alias("host_a"), F.greatest("src_ip", "dst_ip").alias("host_b"))
    g = packets.groupBy(F.session_window("ts", idle).alias("w"), "capture_id", *pair).agg(F.count("*").alias("n_packets"), F.sum("frame_len").alias("n_bytes"))
    return g.select("capture_id", "host_a", "host_b", _at("start"), "n_packets", "n_bytes")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet at ``path``, and read that back; a rerun resumes."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_progress").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


FLOW_ROW = f"capture_id long, ip_a long, port_a int, ip_b long, port_b int, protocol int, {flow_state.ROW}"
FORGET_US = 86_400_000_000
ARRAY_ROWS = 64  # below, arrays take longer than packets one by one


class FlowProcessor(StatefulProcessor):
    """Flows of one conversation: packets wait until the watermark has passed them, then go through the lifetime rules in time order.

    What is kept is the conversation's first sender, the packets that wait, the open flow's sums and,
    as a map, the data that it has sent. A flow is given out when a packet closes it or the watermark
    passes its idle gap. Once the watermark is ``forget_us`` past the last packet, nothing is kept.
    Flows that begin and end within one call never meet the state; of many packets, they are made by arrays, all at once.
    """

    def __init__(self, idle_us: int, active_us: int, close_on_teardown: bool, forget_us: int):
        self.idle_us, self.active_us, self.teardown, self.forget_us = idle_us, active_us, close_on_teardown, max(forget_us, idle_us)

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "src_ip string, src_port int, latest_us long")
        self.waiting = handle.getListState("waiting", flow_state.WAITING)
        self.open = handle.getValueState("open", flow_state.STATE)
        self.sent = handle.getMapState("sent", "fwd boolean, seq long, length long", "known boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        fresh = [flow_state.Packets.of(frame) for frame in rows]
        yield from self._advance(key, flow_state.Packets.joined([flow_state.Packets.of_values(self.waiting.get()), *fresh]), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._advance(key, flow_state.Packets.of_values(self.waiting.get()), timerValues)

    def _seen(self, new: set, older: bool) -> Callable:
        """Whether data came before in the flow: ``new`` takes what this call adds, the map holds what is ``older``."""
        known = set()

        def seen(*data) -> bool:
            if data in new or data in known:
                return True
            if older and self.sent.containsKey(data):
                known.add(data)
                return True
            new.add(data)
            return False

        return seen

    def _directions(self, p: flow_state.Packets, first: tuple | None) -> tuple[np.ndarray, tuple]:
        """Which packets come from the conversation's first sender, and that sender with the latest time."""
        fwd = np.zeros(len(p), bool)
        cuts = [0, *(np.flatnonzero(np.diff(p.ts_us) > self.forget_us) + 1).tolist(), len(p)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a or first is None or int(p.ts_us[0]) - first[2] > self.forget_us:
                first = (p.ips[p.src_ip[a]], int(p.src_port[a]), 0)
            ip = p.ips.index(first[0]) if first[0] in p.ips else -1
            fwd[a:b] = (p.src_ip[a:b] == ip) & (p.src_port[a:b] == first[1])
        return fwd, (*first[:2], int(p.ts_us[-1]))

    def _advance(self, key, waiting, timers):
        mark = timers.getCurrentWatermarkInMs() * 1000
        due_now = waiting.ts_us < mark
        ready, later = waiting[due_now].sorted(), waiting[~due_now]
        flow = flow_state.OpenFlow.of(tuple(self.open.get())) if self.open.exists() else None
        first = tuple(self.first.get()) if self.first.exists() else None
        done, whole, new, kept = [], [], set(), bool(flow)

        def close() -> None:
            nonlocal kept
            done.append(flow.row())
            new.clear()
            if kept:
                self.sent.clear()
                kept = False

        if len(ready):
            fwd, first = self._directions(ready, first)
            ts = int(ready.ts_us[0])
            if flow and (flow.marks["closed"] or ts - flow.end_us > self.idle_us or ts - flow.start_us > self.active_us):
                close()
                flow = None
            for i, j, over in flow_state.cut(ready, fwd, flow, self.idle_us, self.active_us, self.teardown):
                if flow is None and len(ready) >= ARRAY_ROWS and (over or int(ready.ts_us[j - 1]) + self.idle_us < mark):
                    whole.append((i, j))
                    continue
                flow = flow or ready.opening(i)
                seen = self._seen(new, kept)
                for p, ahead in zip(ready[i:j].dicts(), fwd[i:j].tolist()):
                    flow.add(p, ahead, self.teardown, seen)
                if over:
                    close()
                    flow = None
        if flow and (flow.marks["closed"] or flow.end_us + self.idle_us < mark):
            close()
            flow = None
        for data in new:
            self.sent.updateValue(data, (True,))
        self.waiting.clear()
        if len(later):
            self.waiting.put(later.values())
        if flow:
            self.open.update(flow.values())
        else:
            self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if first and not len(later) and not flow and first[2] + self.forget_us < mark:
            self.first.clear()
            first = None
        if first:
            self.first.update(first)
        due = ([int(later.ts_us.min())] if len(later) else []) + ([flow.end_us + self.idle_us] if flow else []) + ([first[2] + self.forget_us] if first else [])
        if due:
            self.handle.registerTimer(max(min(due) // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))
        names = [c.split()[0] for c in FLOW_ROW.split(", ")]
        if done:
            yield pd.DataFrame([(*key, *row) for row in done], columns=names)
        if whole:  # a row of flows: only the first and the last of a call may be others
            a, b = whole[0][0], whole[-1][1]
            made = flow_state.closed_flows(ready[a:b], fwd[a:b], np.array([i - a for i, _ in whole]))
            yield made.assign(**dict(zip(names, key)))[names]


def stream_flows(packets: DataFrame, idle_us: int = IDLE_US, active_us: int = ACTIVE_US, close_on_teardown: bool = True, forget_us: int = FORGET_US) -> DataFrame:
    """Flows of an unbounded packet stream, with all features of ``flows.assemble_flows``, by state for each conversation; ``packets`` carries a watermark on ts.

    The rules are those of the batch, but that a conversation silent for over ``forget_us`` begins
    anew, with its next sender as the first; nulls count as 0. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). Packets older than the watermark are dropped
    by Spark and counted in its progress.
    """
    known = canonical_key(packets)
    fields = [F.coalesce(F.col(c).cast(t), F.lit(0 if t != "string" else "").cast(t)).alias(c) for c, t in (f.split() for f in flow_state.PACKET.split(", ")) if c != "protocol"]
    keyed = known.select(*(F.col(c).cast(t).alias(c) for c, t in zip(CONVERSATION, ("long", "long", "int", "long", "int", "int"))), *fields, "ts")
    rows = keyed.groupBy(*CONVERSATION).transformWithStateInPandas(FlowProcessor(idle_us, active_us, close_on_teardown, forget_us), outputStructType=FLOW_ROW, outputMode="Append", timeMode="EventTime")
    return derived_features(rows)


def heartbeat(rows: DataFrame, name: str, size: str) -> DataFrame:
    """``rows`` observed under ``name``: rows and bytes seen and the earliest and latest time, told with the progress of every batch."""
    return rows.observe(name, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


PROGRESS = "id string, run_id string, name string, batch long, at string, input_rows long, late_rows long, state_rows long, watermark string, observed string, rows long, bytes long, earliest_us long, latest_us long"


class ProgressLog(StreamingQueryListener):
    """Writes every progress of the session's queries as a small file under ``path``, so that counts hold however long a query runs; ``spark.streams.addListener`` takes it. ``path`` is on a store that pyarrow opens."""

    def __init__(self, path: str):
        self.path = path
        self.store, self.folder = store_of(path)
        self.store.create_dir(self.folder)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        operators = p.get("stateOperators", [])
        row = {"id": p["id"], "run_id": p["runId"], "name": p.get("name"), "batch": p["batchId"], "at": p["timestamp"], "input_rows": p.get("numInputRows", 0), "watermark": p.get("eventTime", {}).get("watermark")}
        row |= {"late_rows": sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in operators), "state_rows": sum(int(o.get("numRowsTotal", 0)) for o in operators)}
        micros = lambda t: None if t is None else int(pd.Timestamp(t).tz_localize(None).value // 1000)
        seen = p.get("observedMetrics") or {None: {}}
        lines = [row | {"observed": name, "rows": m.get("rows"), "bytes": m.get("bytes"), "earliest_us": micros(m.get("earliest")), "latest_us": micros(m.get("latest"))} for name, m in seen.items()]
        with self.store.open_output_stream(f"{self.folder}/{p['id']}-{p['runId']}-{p['batchId']}-{p['timestamp'].replace(':', '')}.json") as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())


def progress(spark: SparkSession, path: str) -> DataFrame:
    """What a ``ProgressLog`` wrote under ``path``, a row for each progress and observation."""
    return spark.read.schema(PROGRESS).json(path)


def stream_status(spark: SparkSession, path: str, window_us: int = WINDOW_US) -> DataFrame:
    """By query and observation: batches, rows, bytes and late rows over the query's whole life, rows in state after the last batch, and the windows between the earliest and the latest row. A batch that ran again counts once, as it ran last."""
    last = Window.partitionBy("id", "observed", "batch").orderBy(F.desc("at"))
    rows = progress(spark, path).filter("input_rows > 0 OR late_rows > 0 OR state_rows > 0").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    n = F.when(F.max("latest_us").isNotNull(), F.floor(F.max("latest_us") / window_us) - F.floor(F.min("earliest_us") / window_us) + 1).otherwise(0)
    return rows.groupBy("id", "name", "observed").agg(F.count("*").alias("batches"), F.coalesce(F.sum("rows"), F.sum("input_rows")).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sum("late_rows").alias("late_rows"), F.max_by("state_rows", "batch").alias("state_rows"), n.alias("windows"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has dropped because they were older than the watermark, by the reports that Spark still holds (the last 100); a ``ProgressLog`` keeps all."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in json.loads(p.json if isinstance(p.json, str) else p.json()).get("stateOperators", []))


def _parts(path: str) -> dict[int, str]:
    """The folders bucket=N under ``path``."""
    store, folder = store_of(path)
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {int(f.base_name.removeprefix("bucket=")): f.path for f in found if f.base_name.startswith("bucket=")}


def alert_batches(flows: DataFrame, score, path: str, progress: str, history_us: int = HISTORY_US, keep_us: int | None = None):
    """Each micro-batch through ``score`` (DataFrame of flows to one with capture_id, window) together with the trailing history.

    Flows are kept under ``path``/flows by stretches of ``history_us`` of event time and by batch; a
    batch is scored with all kept flows of its captures that start within ``history_us`` before its
    first, and what comes out stands under its number in ``path``/scores, so that a replayed batch
    replaces its own rows. Stretches that end more than ``keep_us`` (twice the history by default)
    before the latest flow are deleted after the batch: captures further behind find no history.
    ``path`` is on a store that pyarrow opens.
    """
    keep = 2 * history_us if keep_us is None else max(keep_us, history_us)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"bucket": F.floor(F.col("start_us") / history_us), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/flows")
        parts = _parts(f"{path}/flows")
        if not parts:
            return
        own = spark.read.parquet(f"{path}/flows").filter(F.col("batch") == number)
        since = own.groupBy("capture_id").agg((F.min("start_us") - history_us).alias("_since"))
        first = since.agg(F.min("_since")).first()[0]
        if first is not None:
            kept = spark.read.parquet(f"{path}/flows").filter((F.col("bucket") >= first // history_us) & (F.col("batch") <= number))
            trailing = kept.join(since, "capture_id").filter("start_us >= _since").drop("_since", "batch", "bucket")
            score(trailing).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")
        store, _ = store_of(path)
        for bucket, folder in parts.items():
            if bucket < max(parts) - keep // history_us:
                store.delete_dir(folder)

    return flows.writeStream.foreachBatch(sink).option("checkpointLocation", progress)
