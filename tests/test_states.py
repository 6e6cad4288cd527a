"""The composed path from packets to verdicts, and hand-computed values of its parts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import flows, labels, samples, windows

PACKET = "capture_id long, packet_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_ttl int, ip_id int, ip_flags int, frag_offset int, ip_len long, ihl int, tcp_flags int, tcp_window long, tcp_seq long, tcp_ack long, tcp_doff int, payload_len long, frame_len long"


def packet(no, second, src="10.0.0.1", dst="10.0.0.2", sport=5000, dport=22, flags=2, payload=0):
    return (1, no, int(second * 1e6), src, dst, sport, dport, 6, 64, no, 2, 0, 40 + payload, 20, flags, 100, no, 0, 20, payload, 54 + payload)


def test_packets_to_verdicts(spark):
    scan = [packet(k, k / 10, dport=100 + k, sport=5000 + k) for k in range(30)]
    late = [packet(100, 65, dst="93.184.0.7", dport=443, payload=900)]
    states = windows.build_states(flows.assemble_flows(spark.createDataFrame(scan + late, PACKET)))
    assert states.columns[:2] == ["capture_id", "window"] and states.columns[2:105] == list(schema.STATE_FEATURES) and len(schema.STATE_FEATURES) == 103
    rows = {r.window: r for r in states.collect()}
    assert sorted(rows) == [0, 1, 2]
    assert (rows[0].max_ports_per_src_dst, rows[0].sequential_port_ratio, rows[0].half_open_ratio, rows[0].n_flows, rows[0].distinct_internal_dsts) == (30, 1, 1, 30, 1)
    assert rows[0].graph_mean_degree == 30 and rows[0].graph_max_degree == 30 and rows[0].payload_zero_ratio__mean == 1
    assert all(rows[1][c] == 0 for c in states.columns[2:])
    assert (rows[2].external_flow_share, rows[2].new_dst_ratio, rows[2].payload_mean__max) == (1, 1, 900)
    summary = windows.window_summary(states)
    assert len(summary.columns) == 28
    forecasts = spark.createDataFrame([(1, 0, 0.6, "Reconnaissance"), (1, 1, 0.9, "Impact"), (1, 2, 0.1, "Benign")], "capture_id long, window long, probability double, stage string")
    got = {r.window: r for r in labels.verdicts(forecasts, summary).collect()}
    # 20 ports, empty payloads, short flows and 15 ports on a host speak for it, resets do not: 4.7 of 5.7
    assert got[0].observed_score == round(4.7 / 5.7, 4) and got[0].level == "CONFIRMED" and got[0].risk == 0.6 and len(got[0].reasons) == 4
    assert (got[1].level, got[2].level) == ("PREDICTED", "WATCH")  # a SYN alone is half open


def test_a_reset_ends_a_flow_and_a_second_fin_admits_one_more(spark):
    rows = [packet(0, 0), packet(1, 1, flags=4), packet(2, 2), packet(3, 3, flags=1), packet(4, 4, "10.0.0.2", "10.0.0.1", 22, 5000, flags=1), packet(5, 5, flags=16), packet(6, 6)]
    got = flows.packets_in_episodes(spark.createDataFrame(rows, PACKET)).collect()
    assert [r.episode for r in sorted(got, key=lambda r: r.packet_no)] == [0, 0, 1, 1, 1, 1, 2]


def test_long_flows_are_cut_by_the_active_timeout(spark):
    rows = [packet(k, 100 * k, flags=16) for k in range(10)]
    got = flows.packets_in_episodes(spark.createDataFrame(rows, PACKET)).collect()
    assert [r.episode for r in sorted(got, key=lambda r: r.packet_no)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_grid_to_a_given_end(spark):
    f = flows.assemble_flows(spark.createDataFrame([packet(0, 0), packet(1, 200, sport=1)], PACKET))
    assert windows.bounds(f, t_end_us=400_000_000).first().n_windows == 14
    assert {r.window for r in windows.assign_windows(f, t_end_us=60_000_000).collect()} == {0, 2}


def test_victim_and_peers(spark):
    rows = [packet(k, k, src="10.0.0.255", dst=f"10.0.1.{k % 15}") for k in range(60)] + [packet(99, 99, src="10.0.0.255", dst="8.8.8.8")]
    got = {r.host: r.host_rank for r in flows.rank_hosts(spark.createDataFrame(rows, PACKET)).collect()}
    assert got["10.0.0.255"] == 1 and "10.0.1.0" not in got and len(got) == 13 and sorted(got.values()) == list(range(1, 14))


def test_the_earlier_of_equal_intervals(spark):
    timeline = spark.createDataFrame([(1, 50, 90, "Benign"), (1, 0, 100, "Impact"), (2, 0, 100, "Benign"), (2, 50, 90, "Impact"), (3, 0, 9, "Impact"), (3, 0, 9, "Exfiltration")], "capture_id long, start_us long, end_us long, stage string")
    points = spark.createDataFrame([(1, 60), (2, 60), (3, 5), (4, 1)], "capture_id long, t_us long")
    assert {r.capture_id: r.stage for r in labels.stage_at(points, timeline).collect()} == {1: "Impact", 2: "Benign", 3: "Exfiltration", 4: "Benign"}


def test_splits(spark):
    rows = spark.createDataFrame([(1, k) for k in range(10)], "capture_id long, window long")
    got = {r.window: r.split for r in samples.time_split(rows, 0.2, 0.2, 8).collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "train", 4: "train", 6: "val", 8: "test", 9: "test"}
    many = spark.createDataFrame([(k, 0) for k in range(8)], "capture_id long, window long")
    stages = spark.createDataFrame([(1, "Impact"), (5, "Impact"), (2, "Benign")], "capture_id long, stage string")
    held = {r.capture_id: r.split for r in samples.holdout_split(many, stages, "Impact").collect()}
    assert {c for c, s in held.items() if s == "test"} == {1, 5} and sorted(held) == list(range(8)) and "val" in held.values()
    with pytest.raises(ValueError):
        samples.holdout_split(many, stages, "Exfiltration")
    with pytest.raises(ValueError):
        samples.group_split(many.filter("capture_id < 2"), 0.2, 0.2, 1)


def test_beacons_sum_up_a_window_of_flows_before_they_are_spread(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 2), n, rng.randint(0, 900) * 500_000, "10.0.0.1", f"93.184.0.{rng.randint(1, 2)}", 443) for n in range(300)]
    rows += [(1, 1000 + k, k * 20_000_000, "10.0.0.2", "93.184.0.9", 80) for k in range(20)]
    made = windows.assign_windows(spark.createDataFrame(rows, "capture_id long, flow_no long, start_us long, src_ip string, dst_ip string, dst_port int"))
    for history in (100_000_000, 600_000_000):  # the first is no whole number of windows
        got = windows.detect_beacons(made, 30_000_000, history)
        want = {}
        for r in made.collect():
            low, high = (r.start_us - r.t0) // 30_000_000, min((r.start_us - r.t0 + history) // 30_000_000 - 1, r.n_windows - 1)
            for k in range(low, high + 1):
                want.setdefault((r.capture_id, k), {}).setdefault((r.src_ip, r.dst_ip, r.dst_port), []).append((r.start_us, r.flow_no))
        for r in got.collect():
            best = []
            for flows_ in want[r.capture_id, r.window].values():
                flows_.sort()
                gaps = [(b[0] - a[0]) / 1e6 for a, b in zip(flows_, flows_[1:]) if b[0] > a[0]]
                if len(flows_) >= 4 and flows_[-1][0] - flows_[0][0] >= 10_000_000 and len(gaps) >= 3 and statistics.mean(gaps) >= 1:
                    best.append((-round(1 / (1 + statistics.pstdev(gaps) / statistics.mean(gaps)), 9), flows_[0], len(flows_)))
            assert (r.beacon_regularity, r.beacon_flow_count) == ((-min(best)[0], min(best)[2]) if best else (None, None)), (history, r)
        plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        at = next(k for k, line in enumerate(plan) if "lag(start_us" in line)
        below = next((k for k in range(at + 1, len(plan)) if depth(plan[k]) <= depth(plan[at])), len(plan))
        assert not any("Generate" in line for line in plan[at:below])  # each flow is ordered once


def test_packets_are_made_and_parsed_once_for_their_episodes(spark):
    rows = [packet(k, 3 * k, flags=4 if k == 2 else 16) for k in range(5)]
    got = flows.packets_in_episodes(spark.createDataFrame(rows, PACKET).withColumn("src_ip", F.concat(F.lit("10.0.0."), F.col("packet_no") * 0 + 1)))
    assert [(r.src_ip, r.fwd, r.episode) for r in got.orderBy("packet_no").collect()] == [("10.0.0.1", True, int(k > 2)) for k in range(5)]
    assert "concat" not in got._jdf.queryExecution().optimizedPlan().toString()
