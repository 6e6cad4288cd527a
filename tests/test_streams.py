"""Streams over files: trailing history, heartbeats and late rows."""

import json
import random
import time

import pandas
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import flows, studies, windows
from tidewatch.streaming import flow_state, live

FLOW = "capture_id long, flow_no long, start_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, fwd_bytes long, bwd_bytes long, total_packets long, syn_count long, ack_count long, rst_count long, fwd_ttl_mean double"


def flow(no, second):
    return (1, no, int(second * 1e6), "10.0.0.1", "10.0.0.2", 5000, 22, 6, 100, 50, 3, 1, 1, 0, 64.0)


def run(q):
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_batches_are_scored_with_their_history(spark, tmp_path):
    source, path, progress = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    score = lambda rows: windows.state_volume(windows.assign_windows(rows))
    schema = spark.createDataFrame([], FLOW).schema
    for part in ([flow(1, 0), flow(2, 40)], [flow(3, 50), flow(4, 2000)]):
        spark.createDataFrame(part, FLOW).coalesce(1).write.mode("append").parquet(source)
        rows = live.stream_rows(spark, source, schema)
        run(live.alert_batches(rows, score, path, progress))
    got = {(r.batch, r.window): r.n_flows for r in spark.read.parquet(f"{path}/scores").collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2, (1, 66): 1}


def test_heartbeat_and_late_rows(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = spark.createDataFrame([], FLOW).schema
    spark.createDataFrame([flow(1, 0), flow(2, 1000)], FLOW).coalesce(1).write.mode("append").parquet(source)
    rows = live.heartbeat(live.with_event_time(live.stream_rows(spark, source, schema), "start_us"), "beat", "fwd_bytes")
    counts = live.stream_window_counts(rows)
    sink = lambda: run(counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/progress").option("path", f"file://{tmp_path}/rows"))
    q = sink()
    beats = [p for p in q.recentProgress if p.observedMetrics]
    assert sum(p.observedMetrics["beat"]["rows"] for p in beats) == 2 and sum(p.observedMetrics["beat"]["bytes"] for p in beats) == 200
    assert live.late_rows(q) == 0
    spark.createDataFrame([flow(3, 5), flow(4, 1001)], FLOW).coalesce(1).write.mode("append").parquet(source)
    assert live.late_rows(sink()) == 1


def test_one_object_per_capture(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "capture_id long, headline string")
    timeline = spark.createDataFrame([(1, 0.5, 3), (1, 0.1, 2)], "capture_id long, risk double, window long")
    flagged = spark.createDataFrame([(2, 1, "x")], "capture_id long, place int, flow_id string")
    got = {r.capture_id: json.loads(r.result) for r in studies.serialise_analysis(heads, timeline, flagged).collect()}
    assert got[1] == {"headline": "a", "timeline": [{"window": 2, "risk": 0.1}, {"window": 3, "risk": 0.5}], "flagged_flows": []}
    assert got[2]["timeline"] == [] and got[2]["flagged_flows"] == [{"place": 1, "flow_id": "x"}]
    assert studies.long_view(timeline, ("risk",)).agg(F.sum("value")).first()[0] == 0.6


# --- whole flows, kept state, progress ----------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACKETS = f"capture_id long, {flow_state.PACKET}"


def packet(rng, no, second, host, reverse):
    a, b = (f"10.0.0.{host}", 5000 + host), ("93.184.0.7", 443)
    src, dst = (b, a) if reverse else (a, b)
    length = rng.choice([0, 0, 1, 40, 1400])
    return (1, no, int(second * 1e6), src[0], dst[0], src[1], dst[1], 6 if host % 3 else 17, 40 + length, rng.choice([2, 16, 16, 24, 24, 17, 4]), length, rng.choice([100, 200, 300]), rng.choice([50, 60]), rng.choice([0, 8192, 500]), rng.choice([64, 128]), 20, 20, rng.choice([0, 1, 2]), rng.choice([0, 0, 0, 185]))


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def flows_in_steps(spark, tmp_path, parts, **options):
    """The flows after each part, which a stream reads one by one, and the rows then in state."""
    source, out = f"{tmp_path}/in", f"file://{tmp_path}/rows"
    schema, counts, states = spark.createDataFrame([], PACKETS).schema, [], []
    for part in parts:
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(source)
        rows = live.with_event_time(live.stream_rows(spark, source, schema), "ts_us", "10 seconds")
        made = live.stream_flows(rows, **options)
        q = run(made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/progress").option("path", out))
        counts.append(spark.read.schema(made.schema).parquet(out).count())
        states.append(json.loads(q.lastProgress.json)["stateOperators"][0]["numRowsTotal"])
    return spark.read.schema(made.schema).parquet(out), counts, states


def test_stream_flows_have_all_features_of_batch_flows(spark, tmp_path, rocksdb):
    rng = random.Random(11)
    rows = sorted((packet(rng, n, rng.random() * 1500 + (400 if n % 5 == 0 else 0), rng.randint(1, 4), rng.random() < 0.4) for n in range(500)), key=lambda r: r[2])
    rows = [(r[0], n, *r[2:]) for n, r in enumerate(rows)]
    end = [packet(rng, 1000 + k, 4000 + 200 * k, 9, False) for k in range(2)]
    cuts = [0, 37, 200, 201, 420, 500]
    parts = [[*rows[i:j][::-1]] for i, j in zip(cuts[:-1], cuts[1:])] + [end[:1], end[1:]]
    got, counts, states = flows_in_steps(spark, tmp_path, parts, idle_us=60_000_000, active_us=200_000_000)
    assert counts == sorted(counts) and counts[1] > 0
    got = got.filter("flow_no < 1000")
    want = flows.assemble_flows(spark.createDataFrame(rows, PACKETS), 60_000_000, 200_000_000)
    key = ["flow_no"]
    a, b = got.toPandas().sort_values(key).reset_index(drop=True), want.toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) > 60 and a.retransmission_count.sum() > 0 and a.out_of_order_count.sum() > 0 and a.dup_ack_count.sum() > 0
    names = [c for c in b.columns if c in a.columns]
    assert set(names) >= set(b.columns) - {"island", "episode"} and len(names) > 71
    for c in names:
        pandas.testing.assert_series_equal(a[c], b[c], check_dtype=False, rtol=1e-9, atol=1e-9)


def test_state_of_silent_conversations_goes(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    first = [packet(rng, n, n / 10, 1 + n % 40, False) for n in range(80)]
    later = [[packet(rng, 100 + k, 1000 + 1000 * k, 1, True)] for k in range(3)]
    _, counts, states = flows_in_steps(spark, tmp_path, [first, *later], forget_us=300_000_000)
    assert max(states) >= 40 and states[-1] < max(states) / 4 and counts[-1] >= 40, states


def test_distincts_of_windows(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = spark.createDataFrame([], FLOW).schema
    rows = [(c, n, int(s * 1e6), f"10.0.0.{a}", f"10.0.1.{b}", 5000, p, 6, 1, 1, 1, 0, 0, 0, 64.0) for n, (c, s, a, b, p) in enumerate([(1, 0, 1, 1, 22), (1, 5, 1, 2, 22), (1, 29, 2, 2, None), (1, 31, 3, 3, 80), (2, 10, 9, 9, 443), (1, 500, 1, 1, 1)])]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, FLOW).coalesce(1).write.mode("append").parquet(source)
    made = live.stream_window_distincts(live.with_event_time(live.stream_rows(spark, source, schema), "start_us"))
    got = {(r.capture_id, r.start_us): tuple(r)[2:] for r in live.drain(made, f"file://{tmp_path}/out").collect()}
    assert got == {(1, 0): (3, 2, 2, 1), (1, 30_000_000): (1, 1, 1, 1), (2, 0): (1, 1, 1, 1)}


def test_progress_log_keeps_more_than_spark_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 5)
    source, log = f"{tmp_path}/in", f"file://{tmp_path}/log"
    listener = live.ProgressLog(log)
    spark.streams.addListener(listener)
    schema = spark.createDataFrame([], FLOW).schema
    try:
        spark.createDataFrame([flow(0, 900)], FLOW).coalesce(1).write.mode("append").parquet(source)
        for k in range(24):
            (tmp_path / "in").mkdir(exist_ok=True)
            pandas.DataFrame([flow(k + 1, 5 if k % 2 else 900 + k)], columns=[c.split()[0] for c in FLOW.split(", ")]).to_parquet(f"{source}/part-{k:04d}.parquet")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        rows = live.heartbeat(live.with_event_time(rows, "start_us"), "beat", "fwd_bytes")
        q = run(live.stream_window_counts(rows).writeStream.format("memory").queryName("counted").outputMode("append"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        for _ in range(100):
            status = live.stream_status(spark, log).filter(F.col("observed") == "beat").first()
            if status and status.rows == 25:
                break
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert (status.rows, status.bytes, status.late_rows, status.windows) == (25, 2500, 12, 31)
    assert live.late_rows(q) < 12


def test_history_past_the_lookback_goes(spark, tmp_path):
    source, path, state = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    seen = []

    def score(rows):
        seen.append(sorted(r.flow_no for r in rows.select("flow_no").collect()))
        return rows.select("capture_id", F.lit(0).alias("window"))

    schema = spark.createDataFrame([], FLOW).schema
    for part in ([flow(1, 0), flow(2, 40)], [flow(3, 90)], [flow(4, 150)], [flow(5, 1000)], [flow(6, 1030)]):
        spark.createDataFrame(part, FLOW).coalesce(1).write.mode("append").parquet(source)
        run(live.alert_batches(live.stream_rows(spark, source, schema), score, path, state, history_us=100_000_000))
    assert seen == [[1, 2], [1, 2, 3], [3, 4], [5], [5, 6]]
    kept = sorted(p.name for p in (tmp_path / "out" / "flows").glob("bucket=*"))
    assert kept == ["bucket=10"]


class Handle:
    """State of one conversation, which counts how often its map is asked or emptied."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getValueState(self, name, *schemas):  # noqa: N802
        return State(self, name)

    getListState = getMapState = getValueState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        return self.name in self.handle.kept

    def get(self):
        return self.handle.kept.get(self.name, [])

    def put(self, value):
        self.handle.kept[self.name] = value

    update = put

    def clear(self):
        self.handle.calls += self.name == "sent"
        self.handle.kept.pop(self.name, None)

    def containsKey(self, key):  # noqa: N802
        self.handle.calls += 1
        return key in self.handle.kept.get(self.name, {})

    def updateValue(self, key, value):  # noqa: N802
        self.handle.kept.setdefault(self.name, {})[key] = value


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


@pytest.mark.parametrize("cuts", [(), (700,), (100, 101, 400, 900)])
def test_flows_of_one_call_are_made_without_state_and_alike(monkeypatch, cuts):
    rng = random.Random(5)
    rows = [packet(rng, n, s, 1, rng.random() < 0.4) for n, s in enumerate(sorted(rng.random() * 20_000 * (n % 3 + 1) for n in range(1000)))]
    names = [c.split()[0] for c in PACKETS.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    made = []
    for few in (0, 10_000):
        monkeypatch.setattr(live, "ARRAY_ROWS", few)
        handle, out = Handle(), []
        processor = live.FlowProcessor(60_000_000, 200_000_000, True, 300_000_000)
        processor.init(handle)
        for a, b in zip((0, *cuts), (*cuts, 1000)):
            out += processor.handleInputRows((1, 2, 3, 4, 5, 6), iter([frame[a:b]]), Clock(a and int(frame.ts_us[a]) // 1000))
        out += processor.handleExpiredTimer((1, 2, 3, 4, 5, 6), Clock(10**9), None)
        made.append(pd.concat(out).sort_values("flow_no").reset_index(drop=True))
        if not cuts:
            assert handle.calls == 0  # nothing was open before
        assert not handle.kept and not handle.timers
    assert len(made[0]) > 300 and made[0].retransmission_count.sum() > 0 and made[0].out_of_order_count.sum() > 0 and made[0].dup_ack_count.sum() > 0
    assert made[0].total_packets.sum() == 1000 and (made[0].columns == made[1].columns).all()
    pandas.testing.assert_frame_equal(*made, check_dtype=False, rtol=1e-9, atol=1e-9)
