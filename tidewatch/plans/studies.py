"""Queries of the sources, studies and streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import expressions as ex
from ..operators import profile, studies
from ..sources import flow_files, shared
from ..sources.shared import materialised
from ..streaming import live
from .registry import _EP, _LONG, _ON, _SC, _STD, _TL, W, _long, _onsets, _scores, _stage_sql, _timeline, _w, _windowed, query, rounded
from .states import FLOWS, WHOLE_FLOWS, whole_flows


@query(
    """WITH a AS (SELECT DISTINCT concat('fd00:', replace(src_ip, '.', ':')) AS address FROM packets_v),
    v AS (SELECT address, (list_reduce(list_prepend(2166136261::BIGINT, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(address, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295) & 1048575) | 4026531840 AS folded FROM a)
    SELECT address, folded, printf('v6:%05x', folded & 1048575) AS shown FROM v""",
    "packets_v",
)
def ipv6_fold(spark, sf_dir):
    a = fixtures.view(spark, sf_dir, "packets_v").select(F.concat(F.lit("fd00:"), F.replace("src_ip", F.lit("."), F.lit(":"))).alias("address")).distinct()
    return a.withColumn("folded", ex.ipv6_fold(F.col("address"))).withColumn("shown", F.format_string("v6:%05x", F.col("folded").bitwiseAND(1048575)))


@query(
    """WITH s AS (SELECT capture_id, min(ts_us) AS a, max(ts_us) AS z FROM packets_v GROUP BY 1),
    p AS (SELECT capture_id, CASE WHEN ts_us < a + (z - a) * 0.55::DOUBLE THEN 'train' WHEN ts_us < a + (z - a) * 0.72::DOUBLE THEN 'val' ELSE 'test' END AS split, frame_len FROM packets_v JOIN s USING (capture_id) WHERE ts_us < z)
    SELECT capture_id, split, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes FROM p GROUP BY ALL""",
    "packets_v",
)
def segment_split(spark, sf_dir):
    p = studies.segment_split(fixtures.view(spark, sf_dir, "packets_v"))
    return p.groupBy("capture_id", "split").agg(F.count("*").alias("n_packets"), F.sum("frame_len").alias("n_bytes"))


_OVER = "WITH b AS (SELECT * FROM packets_v WHERE protocol = 6), i AS (SELECT * FROM packets_v WHERE protocol <> 6), s AS (SELECT capture_id, min(ts_us) AS a, max(ts_us) AS z FROM b GROUP BY 1) "


def _overlay(spark, sf_dir):
    p = fixtures.view(spark, sf_dir, "packets_v")
    return studies.overlay_union(p.filter("protocol = 6"), p.filter("protocol <> 6"), fixtures.view(spark, sf_dir, "timeline_v"))


@query(_OVER + "SELECT capture_id, packet_no, ts_us, false AS injected FROM b UNION ALL SELECT i.capture_id, packet_no, ts_us, true FROM i JOIN s ON i.capture_id = s.capture_id AND ts_us BETWEEN a AND z", "packets_v")
def overlay_packets(spark, sf_dir):
    return _overlay(spark, sf_dir)[0].select("capture_id", "packet_no", "ts_us", "injected")


@query(_OVER + "SELECT t.capture_id, start_us, least(end_us, z) AS end_us, stage, end_us > z AS truncated FROM timeline_v t JOIN s ON t.capture_id = s.capture_id AND start_us <= z", "packets_v", "timeline_v")
def overlay_timeline(spark, sf_dir):
    return _overlay(spark, sf_dir)[1]


@query(f"SELECT capture_id, array_to_string(list_sort(list(DISTINCT {_stage_sql('label')})), ',') AS stages FROM flows_v GROUP BY 1", "flows_v")
def group_stages(spark, sf_dir):
    f = fixtures.view(spark, sf_dir, "flows_v").withColumn("stage", ex.stage_from_label(F.col("label")))
    return studies.group_stages(f).withColumn("stages", F.array_join("stages", ","))


@query(_EP + "c AS (SELECT capture_id, count(*) AS n_windows FROM s GROUP BY 1) SELECT capture_id, n_windows, CASE WHEN n_windows < 16 THEN concat('needs 16 windows, has ', n_windows) END AS note FROM c", "scores_v")
def min_context_check(spark, sf_dir):
    return studies.min_context_check(_windowed(spark, sf_dir))


@query(
    _LONG + """c AS (SELECT capture_id, win, feature, list(value) OVER (PARTITION BY capture_id, feature ORDER BY win ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS x FROM l),
    f AS (SELECT capture_id, win, feature, x[-1] AS last, list_reduce(list_prepend(0.0::DOUBLE, x), lambda a, v: 0.5::DOUBLE * v + 0.5::DOUBLE * a) AS ewma, list_max(x[-3:]) AS recent_max, x[-1] - x[-8] AS slope, list_sum([abs(v) FOR v IN x]) AS t FROM c WHERE len(x) = 16)
    SELECT capture_id, win AS "window", feature, round(last, 6) AS last, round(ewma, 6) AS ewma, round(recent_max, 6) AS recent_max, round(slope, 6) AS slope, CAST(sum(CASE WHEN abs(last) > 3 THEN 1 ELSE 0 END) OVER q AS BIGINT) AS far_last, CAST(sum(CASE WHEN abs(ewma) > 3 THEN 1 ELSE 0 END) OVER q AS BIGINT) AS far_ewma,
    round(avg(abs(last)) OVER q, 6) AS mean_last, round(avg(t) OVER q / 16, 6) AS mean_all FROM f WINDOW q AS (PARTITION BY capture_id, win)"""
)
def context_features(spark, sf_dir):
    return rounded(studies.context_features(_long(spark, sf_dir)))


@query(_LONG + "p AS (SELECT feature, value, lag(value) OVER (PARTITION BY capture_id, feature ORDER BY win) AS f FROM l) SELECT feature, count(*) AS n, round(avg((f - value) * (f - value)), 6) AS mse, round(avg(abs(f - value)), 6) AS mae, round(sqrt(avg((f - value) * (f - value))), 6) AS rmse FROM p WHERE f IS NOT NULL GROUP BY 1")
def persistence_forecast(spark, sf_dir):
    return rounded(studies.dynamics_metrics(studies.persistence_forecast(_long(spark, sf_dir))))


@query(
    _STD + """e AS (SELECT feature, m, CASE WHEN s < 1e-8 THEN 1.0 ELSE s END AS s, a, b FROM f), z AS (SELECT l.*, m, s, (value - m) / s AS z, (a - m) / s - 1 AS lo, (b - m) / s + 1 AS hi FROM l JOIN e USING (feature)),
    g AS (SELECT capture_id, feature, m, s, lo, hi, avg(value) AS value, avg(z) AS z, avg(CASE WHEN z < lo OR z > hi THEN 1.0 ELSE 0.0 END) AS windows_outside FROM z GROUP BY ALL HAVING avg(CASE WHEN z < lo OR z > hi THEN 1.0 ELSE 0.0 END) > 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY round(windows_outside + greatest(z - hi, lo - z, 0) / 1e3, 9) DESC, feature) AS INTEGER) AS place FROM g)
    SELECT capture_id, feature, round(value, 6) AS value, round(lo * s + m, 6) AS train_low, round(hi * s + m, 6) AS train_high, round(windows_outside, 6) AS windows_outside, place FROM r WHERE place <= 6"""
)
def worst_features(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(studies.worst_features(long, materialised(profile.fit_standardiser(long), "standardiser")))


@query(
    """WITH s AS (SELECT y, floor(score_milli / 10) / 100 AS score FROM scores_v), t AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM s), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1),
    r AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g), m AS (SELECT threshold, tp / (tp + fp) AS precision, tp / np AS recall, fp / nn AS fpr FROM r, t),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
    SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1""",
    "scores_v",
)
def find_best_threshold(spark, sf_dir):
    s = fixtures.view(spark, sf_dir, "scores_v").select("y", (F.floor(F.col("score_milli") / 10) / 100).alias("score"))
    return rounded(studies.find_best_threshold(s))


@query(
    """WITH s AS (SELECT y, floor(score_milli / 10) / 100 AS score FROM scores_v), t AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM s), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1),
    r AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g), m AS (SELECT threshold, tp / (tp + fp) AS precision, tp / np AS recall, fp / nn AS fpr FROM r, t),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
    SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM f WHERE fpr <= 0.1 ORDER BY recall DESC, threshold LIMIT 1""",
    "scores_v",
)
def find_best_threshold_limited(spark, sf_dir):
    s = fixtures.view(spark, sf_dir, "scores_v").select("y", (F.floor(F.col("score_milli") / 10) / 100).alias("score"))
    return rounded(studies.find_best_threshold(s, "recall", max_fpr=0.1))


_PPV = ", ".join(f"round(CASE WHEN tpr * {p} + fpr * {1 - p!r} > 0 THEN tpr * {p} / (tpr * {p} + fpr * {1 - p!r}) END, 6) AS ppv_{k}" for k, p in enumerate(studies.PREVALENCES, 2))


@query(_SC + f"c AS (SELECT unnest([0.6, 0.8, 0.95, 1.2]::DOUBLE[]) AS threshold), r AS (SELECT threshold, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS fpr, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS tpr FROM s, c GROUP BY 1) SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(fpr * 2880, 6) AS false_alerts_per_day, {_PPV} FROM r", "scores_v")
def operating_points(spark, sf_dir):
    return rounded(studies.operating_points(_scores(spark, sf_dir), (0.6, 0.8, 0.95, 1.2)))


@query(_ON + "SELECT capture_id % 3 AS split, count(*) AS samples, CAST(sum(CASE WHEN onset IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS positives, count(DISTINCT CASE WHEN onset IS NOT NULL THEN concat(capture_id, '|', onset) END) AS onsets FROM o3 GROUP BY 1", "flows_v", "timeline_v")
def label_distribution_by_split(spark, sf_dir):
    return studies.label_distribution(_onsets(spark, sf_dir).withColumn("split", F.col("capture_id") % 3), "split")


@query(_TL + "SELECT capture_id % 3 AS split, stage, count(*) AS windows FROM lw WHERE win % 7 <> 0 GROUP BY 1, 2", "flows_v", "timeline_v")
def stage_distribution(spark, sf_dir):
    return studies.stage_distribution(_timeline(spark, sf_dir).withColumns({"valid": F.col("window") % 7 != 0, "split": F.col("capture_id") % 3}), "split")


@query(_ON + ", s AS (SELECT capture_id, onset, onset - win AS steps, (win * 37 % 100) / 100.0 AS score FROM o3 WHERE onset IS NOT NULL), c AS (SELECT unnest([0.3, 0.6, 0.9]::DOUBLE[]) AS threshold), p AS (SELECT threshold, capture_id, onset, max(CASE WHEN score >= threshold THEN steps END) * 30.0::DOUBLE AS lead FROM s, c GROUP BY 1, 2, 3) SELECT threshold, count(*) AS n_events, round(count(lead) / count(*), 6) AS event_recall, round(quantile_cont(lead, 0.5), 6) AS median_lead_s FROM p GROUP BY 1", "flows_v", "timeline_v")
def event_points(spark, sf_dir):
    return rounded(studies.event_points(_onsets(spark, sf_dir).withColumn("score", F.col("window") * 37 % 100 / 100), (0.3, 0.6, 0.9)))


@query(_ON + "SELECT capture_id, count(*) AS samples, CAST(sum(CASE WHEN onset IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS positives, count(DISTINCT onset) AS onsets FROM o3 GROUP BY 1", "flows_v", "timeline_v")
def label_distribution(spark, sf_dir):
    return studies.label_distribution(_onsets(spark, sf_dir))


@query(W + ', c AS (SELECT capture_id, win, count(*) AS n_flows, CAST(sum(fwd_bytes + bwd_bytes) AS BIGINT) AS n_bytes FROM w GROUP BY 1, 2) SELECT capture_id, CAST(to_json(list({\'window\': win, \'n_flows\': n_flows, \'n_bytes\': n_bytes} ORDER BY win)) AS VARCHAR) AS timeline FROM c GROUP BY 1', "flows_v")
def serialise_result(spark, sf_dir):
    g = _w(spark, sf_dir).groupBy("capture_id", "window").agg(F.count("*").alias("n_flows"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("n_bytes"))
    return studies.serialise_result(g, ("n_flows", "n_bytes"))


@query(
    """SELECT capture_id, CAST(flow_no AS DOUBLE) AS flow_duration, src_ip, dst_ip, CAST(start_us AS DOUBLE) AS start_ts, CAST(start_us + flow_no AS DOUBLE) AS end_ts, CAST(dst_port AS DOUBLE) AS dst_port, CAST(fwd_bytes + bwd_bytes AS DOUBLE) AS total_bytes, round(fwd_bytes / (fwd_bytes + bwd_bytes), 6) AS bytes_ratio, round(syn_count / total_packets, 6) AS syn_ratio,
    CASE WHEN trim(label) = 'BENIGN' THEN 'Benign' ELSE trim(label) END AS label FROM flows_v""",
    "flows_v",
)
def flow_csv_round_trip(spark, sf_dir):
    path = shared.scratch(spark, "flows")
    f = fixtures.view(spark, sf_dir, "flows_v")
    flow_files.write_flows_csv(f.withColumn("flow_id", F.col("flow_no")).withColumn("Flow Duration", F.col("flow_no")).withColumnRenamed("start_us", "start_ts"), path)
    back = flow_files.read_flow_csv(spark, path)
    return rounded(back.select("capture_id", "flow_duration", "src_ip", "dst_ip", "start_ts", "end_ts", "dst_port", "total_bytes", "bytes_ratio", "syn_ratio", "label"))


_CIC = {"Dst Port": "dst_port", "Src Port": "src_port", "Protocol": "protocol", "Flow Duration": "flow_no", "Tot Fwd Pkts": "total_packets", "Tot Bwd Pkts": "ack_count", "TotLen Fwd Pkts": "fwd_bytes", "TotLen Bwd Pkts": "bwd_bytes", "SYN Flag Cnt": "syn_count", "FIN Flag Cnt": "rst_count", "URG Flag Cnt": "ack_count", "Fwd IAT Mean": "bwd_bytes", "Bwd IAT Max": "flow_no", "Fwd Pkts/s": "fwd_bytes", "Bwd Seg Size Avg": "bwd_bytes", "Pkt Len Min": "syn_count", "Pkt Len Std": "ack_count", "Fwd Header Len": "total_packets", "Label": "label"}
_UNSW = {"srcip": "src_ip", "dstip": "dst_ip", "sport": "src_port", "dsport": "dst_port", "proto": "protocol", "dur": "flow_no", "sbytes": "fwd_bytes", "dbytes": "bwd_bytes", "Spkts": "total_packets", "Dpkts": "syn_count", "sttl": "fwd_ttl_mean", "dttl": "fwd_ttl_mean", "Sload": "bwd_bytes", "Stime": "start_us", "attack_cat": "label"}
_GIVEN = {0: {"dst_port", "src_port", "protocol", "flow_duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "fin_count", "urg_count", "fwd_iat_mean", "bwd_iat_max", "fwd_packets_per_s", "bwd_mean_packet_size", "payload_min", "payload_std", "header_len_mean"}, 1: {"src_port", "dst_port", "protocol", "flow_duration", "fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets", "ttl_mean", "ttl_max", "fwd_packets_per_s"}}
_MADE = {0: {"total_packets", "total_bytes", "bytes_ratio", "packets_ratio", "mean_packet_size", "syn_ratio", "is_wellknown_dst_port"}, 1: {"total_packets", "total_bytes", "bytes_ratio", "packets_ratio", "mean_packet_size", "is_wellknown_dst_port"}}


def _foreign_files(spark, sf_dir) -> str:
    """The flows in two foreign layouts under one folder: captures 0 and 1 in that of one dataset, 2 and 3 in another's."""
    path = shared.scratch(spark, "foreign")
    f = fixtures.view(spark, sf_dir, "flows_v")
    date = F.date_format(F.timestamp_seconds(F.floor(F.col("start_us") / 1_000_000)), "dd/MM/yyyy HH:mm:ss").alias("Timestamp")
    f.filter("capture_id < 2").select(*(F.col(c).alias(n) for n, c in _CIC.items()), F.lit("Infinity").alias("Flow Byts/s"), date).write.csv(f"{path}/a", header=True)
    f.filter("capture_id >= 2").select(*(F.col(c).alias(n) for n, c in _UNSW.items())).write.csv(f"{path}/b", header=True)
    return f"{path}/*/*.csv"


_NUM = lambda **k: ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in k.items())
_FOREIGN = ("dataset", "src_ip", "start_ts", "end_ts", "label", "flow_duration", "fwd_packets", "bwd_packets", "total_packets", "total_bytes", "packets_ratio", "syn_ratio", "fin_count", "urg_count", "fwd_iat_mean", "bwd_iat_max", "fwd_packets_per_s", "bwd_mean_packet_size", "payload_min", "payload_std", "header_len_mean", "ttl_mean", "ttl_max", "flow_bytes_per_s", "retransmission_count", "is_wellknown_dst_port")


@query(
    f"""WITH f AS (SELECT *, CASE WHEN trim(label) = 'BENIGN' THEN 'Benign' ELSE trim(label) END AS said, CAST(floor(start_us / 1000000) AS DOUBLE) AS s, CAST(list_contains({list(map(int, flow_files.WELL_KNOWN_PORTS))}, dst_port) AS DOUBLE) AS known FROM flows_v)
    SELECT 'cicids2018' AS dataset, '' AS src_ip, s AS start_ts, round(s + flow_no * 1e-6::DOUBLE, 6) AS end_ts, said AS label, round(flow_no * 1e-6::DOUBLE, 6) AS flow_duration, {_NUM(fwd_packets='total_packets', bwd_packets='ack_count', total_packets='total_packets + ack_count', total_bytes='fwd_bytes + bwd_bytes')}, round(total_packets / (total_packets + ack_count), 6) AS packets_ratio, round(syn_count / (total_packets + ack_count), 6) AS syn_ratio,
      {_NUM(fin_count='rst_count', urg_count='ack_count', fwd_iat_mean='bwd_bytes', bwd_iat_max='flow_no', fwd_packets_per_s='fwd_bytes', bwd_mean_packet_size='bwd_bytes', payload_min='syn_count', payload_std='ack_count', header_len_mean='total_packets', ttl_mean='0', ttl_max='0', flow_bytes_per_s='0', retransmission_count='0', is_wellknown_dst_port='known')} FROM f WHERE capture_id < 2
    UNION ALL SELECT 'unswnb15', src_ip, CAST(start_us AS DOUBLE), CAST(start_us + flow_no AS DOUBLE), said, CAST(flow_no AS DOUBLE), total_packets, syn_count, total_packets + syn_count, fwd_bytes + bwd_bytes, round(total_packets / (total_packets + syn_count), 6), 0, 0, 0, 0, 0, bwd_bytes, 0, 0, 0, 0, fwd_ttl_mean, fwd_ttl_mean, 0, 0, known FROM f WHERE capture_id >= 2""",
    "flows_v",
)
def foreign_flow_files(spark, sf_dir):
    return rounded(flow_files.read_flow_csv(spark, _foreign_files(spark, sf_dir)).select(*_FOREIGN))


@query(
    " UNION ALL ".join(
        f"SELECT '{kind}' AS dataset, '{c}' AS feature, {str(c in flow_files.PACKET_ALIASES).lower()} AS packet_level, {str(c in _GIVEN[k] | _MADE[k] | extra).lower()} AS available"
        for k, kind, extra in ((0, "cicids2018", {"flow_bytes_per_s"}), (1, "unswnb15", set()))
        for c in flow_files.NUMERIC_ALIASES
    )
)
def flow_availability(spark, sf_dir):
    return flow_files.flow_availability(spark, _foreign_files(spark, sf_dir)).select("dataset", "feature", "packet_level", "available").distinct()


@query(W + ', c AS (SELECT capture_id, win, count(*) AS n_flows FROM w GROUP BY 1, 2) SELECT capture_id, win AS "window", n_flows, 30.0::DOUBLE AS window_s FROM c', "flows_v")
def corpus_round_trip(spark, sf_dir):
    path = shared.scratch(spark, "corpus")
    flow_files.write_corpus(_w(spark, sf_dir).groupBy("capture_id", "window").agg(F.count("*").alias("n_flows")), path)
    return flow_files.read_corpus(spark, path)


@query("SELECT start_us, end_us, stage, concat('10.20.', capture_id) AS attacker, CAST(NULL AS VARCHAR) AS victim FROM timeline_v", "timeline_v")
def timeline_round_trip(spark, sf_dir):
    """Each capture's timeline written as one document and read back."""
    path = shared.scratch(spark, "timeline")
    t = fixtures.view(spark, sf_dir, "timeline_v")
    one = F.struct((F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "stage", F.concat(F.lit("10.20."), F.col("capture_id")).alias("attacker"))
    docs = t.groupBy("capture_id").agg(F.to_json(F.struct(F.collect_list(one).alias("timeline"))).alias("value"))
    docs.write.partitionBy("capture_id").text(path)
    return flow_files.read_timeline(spark, f"{path}/*/*.txt").select("start_us", "end_us", "stage", "attacker", "victim")


def _stream(spark, sf_dir, view: str, micros: str):
    path = f"{sf_dir}/events.parquet"
    rows = live.stream_rows(spark, f"{path}*", spark.read.parquet(path).schema)
    return live.with_event_time(fixtures.over(spark, view, rows), micros)


_CLOSED = lambda view, c: f"m AS (SELECT CAST(floor(max({c}) / 1000) AS BIGINT) * 1000 - 60000000 AS mark FROM {view}) "


@query("WITH s AS (SELECT capture_id, CAST(floor(start_us / 30000000) AS BIGINT) * 30000000 AS start_us, fwd_bytes + bwd_bytes AS b FROM flows_v), " + _CLOSED("flows_v", "start_us") + "SELECT capture_id, start_us, count(*) AS n_flows, CAST(sum(b) AS BIGINT) AS total_bytes FROM s, m WHERE start_us + 30000000 <= mark GROUP BY 1, 2", "flows_v")
def stream_window_counts(spark, sf_dir):
    return live.drain(live.stream_window_counts(_stream(spark, sf_dir, "flows_v", "start_us")), shared.scratch(spark, "stream"))


@query("WITH s AS (SELECT capture_id, CAST(floor(start_us / 30000000) AS BIGINT) * 30000000 AS start_us, src_ip, dst_ip, dst_port FROM flows_v), " + _CLOSED("flows_v", "start_us") + "SELECT capture_id, start_us, count(*) AS n_flows, count(DISTINCT src_ip) AS distinct_src_ips, count(DISTINCT dst_ip) AS distinct_dst_ips, count(DISTINCT dst_port) AS distinct_dst_ports FROM s, m WHERE start_us + 30000000 <= mark GROUP BY 1, 2", "flows_v")
def stream_window_distincts(spark, sf_dir):
    return live.drain(live.stream_window_distincts(_stream(spark, sf_dir, "flows_v", "start_us")), shared.scratch(spark, "stream"))


@query("WITH s AS (SELECT capture_id, dst_ip, (CAST(floor(start_us / 30000000) AS BIGINT) - unnest(range(20))) * 30000000 AS start_us FROM flows_v), " + _CLOSED("flows_v", "start_us") + "SELECT capture_id, dst_ip, start_us, count(*) AS contacts FROM s, m WHERE start_us + 600000000 <= mark GROUP BY 1, 2, 3", "flows_v")
def stream_history(spark, sf_dir):
    return live.drain(live.stream_history(_stream(spark, sf_dir, "flows_v", "start_us")), shared.scratch(spark, "stream"))


@query(
    """WITH p AS (SELECT capture_id, least(src_ip, dst_ip) AS host_a, greatest(src_ip, dst_ip) AS host_b, ts_us, frame_len, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY capture_id, least(src_ip, dst_ip), greatest(src_ip, dst_ip) ORDER BY ts_us, packet_no) > 120000000 THEN 1 ELSE 0 END AS cut, packet_no FROM packets_v),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY capture_id, host_a, host_b ORDER BY ts_us, packet_no) AS island FROM p), """ + _CLOSED("packets_v", "ts_us") + """
    SELECT capture_id, host_a, host_b, min(ts_us) AS start_us, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes FROM i, m GROUP BY capture_id, host_a, host_b, island, mark HAVING max(ts_us) + 120000000 <= mark""",
    "packets_v",
)
def stream_idle_sessions(spark, sf_dir):
    return live.drain(live.stream_idle_sessions(_stream(spark, sf_dir, "packets_v", "ts_us")), shared.scratch(spark, "stream"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(FLOWS + ", " + _CLOSED("packets_v", "ts_us") + f" SELECT {WHOLE_FLOWS} FROM flows_a, m WHERE end_us + 120000000 < mark", "packets_v")
def stream_flows(spark, sf_dir):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = live.drain(live.stream_flows(_stream(spark, sf_dir, "packets_v", "ts_us")), shared.scratch(spark, "stream"))
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    mark = spark.read.parquet(f"{sf_dir}/events.parquet")
    end = fixtures.over(spark, "packets_v", mark).agg((F.floor(F.max("ts_us") / 1000) * 1000 - 60_000_000).alias("mark"))
    # flows that a packet has closed may come out before their idle gap has passed: only those past it are the same however the stream is cut
    rows = out.crossJoin(F.broadcast(end)).filter(F.col("end_us") + 120_000_000 < F.col("mark"))
    return whole_flows(rows)
