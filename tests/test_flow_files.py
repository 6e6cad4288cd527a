"""Foreign flow files and timelines."""

import pytest

from tidewatch.sources import flow_files


def test_day_first_dates_infinity_and_microseconds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,SYN Flag Cnt,Label\n443,6,02/03/2018 08:47:38,2000000,3,1,300,100,Infinity,1,BENIGN\n22,6,02/03/2018 08:47:39,0,0,0,0,0,NaN,0,SSH-Bruteforce\n")
    r = flow_files.read_flow_csv(spark, str(tmp_path / "*.csv")).orderBy("start_ts").collect()
    assert [(x.dataset, x.capture, x.flow_duration, x.flow_bytes_per_s, x.total_packets, x.total_bytes, x.syn_ratio, x.is_wellknown_dst_port, x.label) for x in r] == [("cicids2018", "a.csv", 2.0, 0.0, 4.0, 400.0, 0.25, 1.0, "Benign"), ("cicids2018", "a.csv", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "SSH-Bruteforce")]
    assert r[0].start_ts == 1519980458 and r[0].end_ts == r[0].start_ts + 2


def test_epoch_seconds_and_row_order(spark, tmp_path):
    (tmp_path / "u.csv").write_text("sport,dsport,proto,dur,Spkts,Dpkts,sbytes,dbytes,sttl,dttl,Stime,attack_cat\n1,53,17,0.5,1,1,60,70,64,63,1421927414,\n2,80,6,1.5,2,2,90,10,64,63,1421927415,Exploits\n")
    r = flow_files.read_flow_csv(spark, str(tmp_path / "u.csv")).orderBy("start_ts").collect()
    assert [(x.dataset, x.flow_duration, x.start_ts, x.label) for x in r] == [("unswnb15", 0.5, 1421927414.0, "Benign"), ("unswnb15", 1.5, 1421927415.0, "Exploits")]
    (tmp_path / "x.csv").write_text("ts,dport\nmorning,1\nnoon,2\n")
    assert sorted((x.start_ts, x.dst_port) for x in flow_files.read_flow_csv(spark, str(tmp_path / "x.csv")).collect()) == [(0.0, 1.0), (1.0, 2.0)]


def test_headers():
    assert flow_files.detect_dataset([" Destination Port", "Label"]) == "cicids2017"
    assert flow_files.detect_dataset(["SrcAddr", "DstAddr"]) == "ctu13"
    assert flow_files.detect_dataset(["flow_id", "start_ts", "total_packets"]) == "export"
    assert flow_files.detect_dataset(["a"]) == "generic"


def test_timeline(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"meta": {"seed": 1},\n "timeline": [{"start": 1.5, "end": 2.25, "stage": "Impact", "attacker": "a"}, {"start": 3, "end": 4, "stage": "Benign"}]}')
    rows = flow_files.read_timeline(spark, str(tmp_path / "t.json")).orderBy("start_us").collect()
    assert [(r.capture, r.start_us, r.end_us, r.stage, r.attacker) for r in rows] == [("t.json", 1500000, 2250000, "Impact", "a"), ("t.json", 3000000, 4000000, "Benign", None)]


def test_headers_of_several_datasets_under_one_pattern(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("Dst Port,Fwd IAT Mean,FIN Flag Cnt,Pkt Len Min,Fwd Header Len,Fwd Header Len,Tot Fwd Pkts,Tot Bwd Pkts,Timestamp\n80,1.5,1,2,20,99,3,1,02/03/2018 08:47:38\n")
    (tmp_path / "c+d.csv").write_text("﻿sport,dsport,sbytes,dbytes,sttl,Stime,capture_id\n1,2,60,40,64,1421927414,7\n")
    (tmp_path / "e.csv").write_text("Dst Port,Fwd IAT Mean,FIN Flag Cnt,Pkt Len Min,Fwd Header Len,Fwd Header Len,Tot Fwd Pkts,Tot Bwd Pkts,Timestamp\n81,2.5,0,0,0,0,1,0,02/03/2018 08:47:39\n")
    pattern = f"file://{tmp_path}/*.csv"
    rows = {r.capture: r for r in flow_files.read_flow_csv(spark, pattern).collect()}
    a, c, e = rows["a b.csv"], rows["c+d.csv"], rows["e.csv"]
    assert (a.dataset, a.fwd_iat_mean, a.fin_count, a.payload_min, a.header_len_mean, a.total_packets, a.capture_id) == ("cicids2018", 1.5, 1.0, 2.0, 20.0, 4.0, None)
    assert (c.dataset, c.src_port, c.ttl_mean, c.total_bytes, c.capture_id, c.start_ts) == ("unswnb15", 1.0, 64.0, 100.0, 7, 1421927414.0)
    assert (e.dst_port, e.start_ts - a.start_ts) == (81.0, 1.0)
    assert set(flow_files.NUMERIC_ALIASES) <= set(rows["e.csv"].asDict()) and len(flow_files.FLOW_ALIASES) == 44 and len(flow_files.PACKET_ALIASES) == 27
    there = flow_files.flow_availability(spark, pattern)
    got = {(r.capture, r.feature): (r.available, r.source) for r in there.collect()}
    assert got["a b.csv", "total_packets"] == (True, "derived") and got["a b.csv", "total_bytes"] == (False, None) and got["c+d.csv", "ttl_mean"] == (True, "sttl") and got["e.csv", "fin_count"] == (True, "FIN Flag Cnt")
    summary = {r.capture: (r.n_available, r.n_features, r.n_packet_level, r.level) for r in flow_files.availability_summary(there).collect()}
    assert summary["c+d.csv"] == (7, 71, 1, "flow") and summary["e.csv"][2:] == (2, "flow")
    with pytest.raises(ValueError, match="unknown dataset"):
        flow_files.read_flow_csv(spark, pattern, dataset="netflow9")


def test_row_order_over_blocks_of_a_file(spark, tmp_path):
    for name, n in (("x.csv", 700), ("y.csv", 90)):
        (tmp_path / name).write_text("ts,dport\n" + "".join(f"at {k},{k}\n" for k in range(n)))
    (tmp_path / "z.csv").write_text("ts,dport\n" + "".join(f"{1000 + k},{k}\n" for k in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = flow_files.read_flow_csv(spark, f"file://{tmp_path}/*.csv").select("capture", "start_ts", "dst_port")
        assert rows.count() == 1090 and rows.rdd.getNumPartitions() > 1
        for r in rows.collect():
            assert r.start_ts == r.dst_port + (1000 if r.capture == "z.csv" else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
