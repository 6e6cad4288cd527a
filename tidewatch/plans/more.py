"""Queries of expressions, contexts, profiles, models and their explanation; with DuckDB SQL where it can say the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures, schema
from ..functions import expressions as ex
from ..functions import words
from ..operators import attribution, evaluation, labels, models, profile, protocol, reports, samples, studies, windows
from ..sources import capture_files, captures
from ..sources.shared import materialised, scratch
from . import registry
from .registry import _LONG, _ON, _SCALED, _SEQ, _TL, STEADY, W, _long, _onsets, _scores, _sequences, _timeline, _w, query, rounded, steady
from .states import STATES, flows_of_packets, states_of_packets

_V = "capture_id, win AS \"window\""


@query("WITH s AS (SELECT capture_id, min(ts_us) AS a, max(ts_us) AS z FROM packets_v GROUP BY 1) SELECT capture_id, packet_no FROM packets_v JOIN s USING (capture_id) WHERE ts_us >= a + (z - a) * 0.25::DOUBLE AND ts_us < a + (z - a) * 0.5::DOUBLE", "packets_v")
def time_segment(spark, sf_dir):
    return studies.time_segment(fixtures.view(spark, sf_dir, "packets_v"), 0.25, 0.5).select("capture_id", "packet_no")


@query("SELECT DISTINCT concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol, '-', start_us) AS flow_id FROM flows_v", "flows_v")
def flow_ids(spark, sf_dir):
    f = fixtures.view(spark, sf_dir, "flows_v")
    return f.select(ex.flow_id(*(F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us"))).alias("flow_id")).distinct()


@query("WITH a AS (SELECT DISTINCT src_ip FROM packets_v) SELECT src_ip, src_ip AS back FROM a", "packets_v")
def int_to_ip(spark, sf_dir):
    a = fixtures.view(spark, sf_dir, "packets_v").select("src_ip").distinct()
    return a.withColumn("back", ex.int_to_ip(ex.ip_to_int(F.col("src_ip"))))


_CTX = W.rstrip() + ", st AS (SELECT capture_id, win, count(*) AS n FROM w GROUP BY 1, 2), q AS (SELECT capture_id, win, list(n) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM st) "


@query(_CTX + f"SELECT {_V}, array_to_string(c, ',') AS context, array_to_string(c[-3:], ',') AS last_three FROM q WHERE len(c) = 8", "flows_v")
def contexts(spark, sf_dir):
    s = _w(spark, sf_dir).groupBy("capture_id", "window").agg(F.count("*").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    c = samples.contexts(s, 8, "n")
    return c.select("capture_id", "window", text(F.col("context")).alias("context"), text(samples.context_slice(F.col("context"), 3)).alias("last_three"))


@query(
    _TL.rstrip() + f""", o1 AS (SELECT capture_id, win, CAST(stage IN (3, 4, 5, 6) AS INTEGER) AS act, count(*) OVER (PARTITION BY capture_id) AS n FROM lw),
    o2 AS (SELECT *, max(act) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS busy, min(CASE WHEN act = 1 THEN win END) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS onset FROM o1)
    SELECT {_V}, CAST(onset IS NOT NULL AS INTEGER) AS label, coalesce(onset - win, 0) AS steps_to_onset, onset FROM o2 WHERE win >= 3 AND win <= n - 6 AND busy = 0""",
    "flows_v",
    "timeline_v",
)
def escalation_samples(spark, sf_dir):
    return samples.build_onset_samples(samples.escalation_task(_timeline(spark, sf_dir).withColumn("valid", F.lit(True))), 4, 5)


@query(_TL + f", k AS (SELECT unnest(['unlabelled', 'dataset labels', 'ground-truth timeline']) AS label_source) SELECT {_V}, stage, stage <> 1 AND label_source <> 'unlabelled' AS valid, label_source FROM lw, k", "flows_v", "timeline_v")
def label_source(spark, sf_dir):
    rows = _timeline(spark, sf_dir).withColumn("valid", F.col("stage") != 1).select("capture_id", "window", "stage", "valid")
    none, data, timeline = (labels.label_source(rows, *flags) for flags in ((False, False), (False, True), (True, True)))
    return none.unionByName(data).unionByName(timeline)


_HOLD = "WITH c AS (SELECT capture_id, capture_id % 3 = 0 AND bool_or(stage_true = 3) AS held FROM scores_v GROUP BY 1), r AS (SELECT capture_id, row_number() OVER (ORDER BY md5(concat('1337|', capture_id)), capture_id) AS i, count(*) OVER () AS n FROM c WHERE NOT held) "


@query(_HOLD + "SELECT capture_id, 'test' AS split FROM c WHERE held UNION ALL SELECT capture_id, CASE WHEN i <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END FROM r", "scores_v")
def holdout_split(spark, sf_dir):
    s = fixtures.view(spark, sf_dir, "scores_v")
    stages = s.filter("stage_true = 3 AND capture_id % 3 = 0").select("capture_id", F.lit("LateralMovement").alias("stage"))
    return samples.holdout_split(s.select("capture_id").distinct(), stages, "LateralMovement")


@query(_SCALED + f", z AS (SELECT l.*, m, sc, a, b, (value - m) / sc AS z FROM l JOIN e USING (feature)) SELECT {_V}, feature, round(z, 5) AS z, round(value, 5) AS restored, round(greatest((a - m) / sc - 1, least((b - m) / sc + 1, z)) * sc + m, 5) AS clamped FROM z")
def standardise(spark, sf_dir):
    long = _long(spark, sf_dir)
    c = profile.inverse(profile.clamp(long, materialised(profile.fit_standardiser(long), "standardiser")))
    return rounded(c.select("capture_id", "window", "feature", "z", "restored", "clamped"), 5)


_PROFILE = _LONG + """c AS (SELECT feature, quantile_cont(value, 0.5) AS centre, stddev_pop(value) AS std FROM l GROUP BY 1),
d AS (SELECT feature, centre, std, quantile_cont(abs(value - centre), 0.5) AS mad FROM l JOIN c USING (feature) GROUP BY 1, 2, 3),
p AS (SELECT feature, centre, greatest(1.4826 * mad, 0.5 * std, 1e-3 + 0.01 * abs(centre)) AS scale FROM d), z AS (SELECT capture_id, win, feature, greatest(-10.0, least(10.0, (value - centre) / scale)) AS z FROM l JOIN p USING (feature)) """


@query(_PROFILE + f"SELECT {_V}, feature, round(z, 5) AS z FROM z")
def profile_transform(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(profile.profile_transform(long, materialised(profile.fit_profile(long), "profile")).select("capture_id", "window", "feature", "z"), 5)


@query(_PROFILE + "SELECT capture_id, round(quantile_cont(abs(z), 0.5), 5) AS drift, quantile_cont(abs(z), 0.5) > 0.6 AS warned FROM z GROUP BY 1")
def drift_score(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(profile.drift_score(profile.profile_transform(long, materialised(profile.fit_profile(long), "profile")), 0.6), 5)


def _describe_sql(c: str) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.FEATURE_WORDS.items())
    base = f"regexp_replace({c}, '(__mean|__std|__max)$', '')"
    suffix = " ".join(f"WHEN {c} LIKE '%\\{k[:2]}{k[2:]}' ESCAPE '\\' THEN '{v} '" for k, v in words.SUFFIX_WORDS.items()).replace("\\__", "\\_\\_")
    return f"concat(CASE {suffix} ELSE '' END, CASE {base} {names} ELSE replace({base}, '_', ' ') END)"


_NAMES = f"[{', '.join(repr(c) for c in (*schema.STATE_FEATURES, 'some_other__max'))}]"


@query(f"SELECT event_id, f AS feature, {_describe_sql('f')} AS description FROM (SELECT event_id, ({_NAMES})[CAST(event_id % 104 AS INTEGER) + 1] AS f FROM events)")
def describe_features(spark, sf_dir):
    names = F.array(*map(F.lit, (*schema.STATE_FEATURES, "some_other__max")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(names, (F.col("event_id") % 104).cast("int")).alias("feature"))
    return e.withColumn("description", words.describe_feature(F.col("feature")))


@query("SELECT DISTINCT stage, concat(stage, ' (', CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.TACTICS.items()) + " ELSE '-' END, ') - ', CASE WHEN stage = 'Impact' THEN 'T1486' ELSE '' END) AS description FROM timeline_v", "timeline_v")
def describe_stages(spark, sf_dir):
    t = fixtures.view(spark, sf_dir, "timeline_v").select("stage").distinct()
    return t.withColumn("description", words.describe_stage(F.col("stage"), {"Impact": "T1486"}))


def _frames(spark, sf_dir):
    """Ethernet frames of the packets, as captures hold them."""
    p = fixtures.view(spark, sf_dir, "packets_v")
    h = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    octets = lambda c: F.concat(*(h(F.element_at(F.split(c, r"\."), k), 2) for k in range(1, 5)))
    col = F.col
    ip = F.concat(F.lit("4500"), h(col("ip_len"), 4), h(col("ip_id"), 4), h(F.shiftleft(col("ip_flags"), 13) + col("frag_offset"), 4), h(col("ip_ttl"), 2), h(col("protocol"), 2), F.lit("0000"), octets(col("src_ip")), octets(col("dst_ip")))
    tcp = F.concat(h(col("src_port"), 4), h(col("dst_port"), 4), h(col("tcp_seq"), 8), h(col("tcp_ack"), 8), F.lit("50"), h(col("tcp_flags"), 2), h(col("tcp_window"), 4), F.lit("00000000"))
    udp = F.concat(h(col("src_port"), 4), h(col("dst_port"), 4), h(col("payload_len") + 8, 4), F.lit("0000"))
    icmp = F.concat(h(col("src_port") % 256, 2), h(col("dst_port") % 256, 2), F.lit("000000000000"))
    l4 = F.when(col("protocol") == 6, tcp).when(col("protocol") == 17, udp).otherwise(icmp)
    return p.select("capture_id", "packet_no", "ts_us", F.lit(1).alias("linktype"), F.unhex(F.concat(F.lit("0" * 24 + "0800"), ip, l4)).alias("frame"))


_PART = "CASE WHEN frag_offset > 0 THEN {} ELSE {} END"


@query(
    f"""SELECT capture_id, packet_no, ts_us, src_ip, dst_ip, {_PART.format(0, 'CASE WHEN protocol = 1 THEN src_port % 256 ELSE src_port END')} AS src_port, {_PART.format(0, 'CASE WHEN protocol = 1 THEN dst_port % 256 ELSE dst_port END')} AS dst_port, protocol, ip_ttl, ip_id, ip_flags, frag_offset, ip_len, ihl,
    CASE WHEN frag_offset = 0 AND protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, CASE WHEN frag_offset = 0 AND protocol = 6 THEN tcp_window ELSE 0 END AS tcp_window, CASE WHEN frag_offset = 0 AND protocol = 6 THEN tcp_seq ELSE 0 END AS tcp_seq, CASE WHEN frag_offset = 0 AND protocol = 6 THEN tcp_ack ELSE 0 END AS tcp_ack,
    CASE WHEN frag_offset > 0 THEN 0 WHEN protocol = 6 THEN 20 ELSE 8 END AS tcp_doff, CASE WHEN frag_offset > 0 THEN ip_len - 20 WHEN protocol = 6 THEN payload_len WHEN protocol = 17 THEN payload_len ELSE ip_len - 28 END AS payload_len FROM packets_v""",
    "packets_v",
)
def decode_frames(spark, sf_dir):
    return captures.decode_frames(_frames(spark, sf_dir)).drop("frame_len")


@query(registry.ORACLE["decode_frames"].replace("SELECT capture_id, packet_no, ts_us, src_ip", "SELECT ts_us, src_ip", 1))
def read_captures(spark, sf_dir):
    """The packets written as capture files, one for each capture and task, and read back in ranges of 64 KB."""
    path = scratch(spark, "captures")
    capture_files.write_captures(_frames(spark, sf_dir).sortWithinPartitions("capture_id", "ts_us"), path).collect()
    return capture_files.read_captures(spark, path, "FAILFAST", range_bytes=64 << 10).drop("capture_id", "packet_no", "frame_len")


# --- models on the states of the packets ---------------------------------------------------------

_FEW = ["log_n_flows", "log_n_bytes", "tcp_share", "half_open_ratio", "new_dst_ratio", "graph_max_degree"]


def _model_samples(spark, sf_dir, length=8, horizon=3, features=_FEW):
    """Samples over the packets' states, labelled by the share of resets of the window; and whole captures dealt to splits."""
    s = materialised(states_of_packets(spark, sf_dir), "states")
    stage = F.when(F.col("half_open_ratio") > 0.5, 6).when(F.col("rst_share") > 0.2, 1).otherwise(0)
    lab = s.select("capture_id", "window", stage.alias("stage"), F.lit(True).alias("valid"))
    out = materialised(models.sequence_samples(s, lab, features, length, horizon), "samples")
    split = s.select("capture_id").distinct().withColumn("split", F.when(F.col("capture_id") == 3, "test").when(F.col("capture_id") == 2, "val").otherwise("train"))
    return s, lab, out, split


def _parts(samples_, split):
    every = samples_.join(split, "capture_id")
    return [every.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


@query()
def predict_next(spark, sf_dir):
    """All features after every whole context of every capture, the last ones too; learnt on the samples of the first two splits."""
    length, features = 16, list(schema.STATE_FEATURES)
    s, _, x, split = _model_samples(spark, sf_dir, length, 5, features)
    train, val, _ = _parts(x, split)
    every = samples.contexts(s.select("capture_id", "window", F.array(*(F.col(c).cast("double") for c in features)).alias("x")), length, "x")
    forecasts = models.predict_next(every.select("capture_id", "window", "context"), models.fit_dynamics(train, val))
    return forecasts.select("capture_id", "window", F.posexplode("forecast").alias("feature", "value"))


@query()
def rollout_timeline(spark, sf_dir):
    _, _, x, split = _model_samples(spark, sf_dir)
    train, val, test = _parts(x, split)
    dynamics, heads = models.fit_dynamics(train, val), models.fit_heads(train, val, (0.03, 0.5))
    rolled = models.rollout(test, 3, lambda r: models.predict_next(r, dynamics, clamp=True), lambda r: models.predict_heads(r, heads))
    rows, peak = models.forecast_timeline(materialised(rolled, "rolled"), schema.WINDOW_US)
    return rows.select("capture_id", "window", "step", "start_us", "infiltration", "stage").join(peak, ["capture_id", "window"])


@query(_SEQ + f", r AS (SELECT capture_id, win, unnest([1, 2, 3]) AS step, c[-1] AS value FROM k) SELECT {_V}, step, CAST(value AS DOUBLE) AS value, 0.0::DOUBLE AS infiltration, 'Benign' AS stage FROM r", "flows_v")
def rollout_persistence(spark, sf_dir):
    s = _sequences(spark, sf_dir).withColumn("context", F.transform("context", lambda x: F.array(x.cast("double"))))
    r = models.rollout(s, 3, models.persistence)
    return r.select("capture_id", "window", "step", F.get("state", F.lit(0)).alias("value"), "infiltration", "stage")


@query()
def benchmark_models(spark, sf_dir):
    _, _, x, split = _model_samples(spark, sf_dir)
    return protocol.benchmark_models(x, split, 3, alphas=(1.0, 100.0))


@query()
def ablation(spark, sf_dir):
    s, lab, _, split = _model_samples(spark, sf_dir)
    return protocol.ablation(s.select("capture_id", "window", *schema.STATE_FEATURES[::6]), lab, split, 4, 2, contexts=(1,), alphas=(100.0,))


def _onset_contexts(spark, sf_dir):
    """Onset samples with a context of whole vectors: windows of the embeddings, eight dimensions wide after summing."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fold = F.array(*(F.aggregate(F.filter("embedding", lambda v, i: i % 8 == k), F.lit(0.0), lambda a, v: a + v.cast("double")) for k in range(8)))
    x = e.select(F.col("label").cast("long").alias("capture_id"), F.col("vec_id").alias("window"), fold.alias("x"))
    c = samples.contexts(x, 4, "x")
    return c.withColumn("label", (F.get("x", F.lit(0)) > 0).cast("int")).select("capture_id", "window", "label", "context")


@query()
def mahalanobis_score(spark, sf_dir):
    s = materialised(_onset_contexts(spark, sf_dir), "contexts")
    return models.mahalanobis_score(s, models.fit_mahalanobis(s)).select("capture_id", "window", "label", "score")


@query()
def isolation_score(spark, sf_dir):
    s = materialised(_onset_contexts(spark, sf_dir), "contexts")
    return models.isolation_score(s, models.fit_isolation(s)).select("capture_id", "window", "label", "score")


@query()
def hazard_probability(spark, sf_dir):
    s = materialised(_onset_contexts(spark, sf_dir), "contexts")
    long = s.select("capture_id", "window", F.posexplode(F.element_at("context", -1)).alias("feature", "value"))
    rows = profile.fit_profile(long).orderBy("feature").collect()
    p = {"centre": [r.centre for r in rows], "scale": [r.scale for r in rows]}
    scored = materialised(models.hazard_score(s, models.fit_hazard(s, p, rounds=40), p).select("capture_id", "window", "label", "score"), "hazard")
    return models.probability(scored, models.calibrate(scored))


@query("SELECT capture_id, t, 0.0::DOUBLE AS score FROM scores_v", "scores_v")
def prior_score(spark, sf_dir):
    return models.prior_score(fixtures.view(spark, sf_dir, "scores_v").select("capture_id", "t"))


# --- explanation, with a linear scorer -------------------------------------------------------------

_WEIGHTS = [0.5, -1.0, 0.25, 2.0, 0.0, -0.75, 1.5, 0.125]


def _linear(rows):
    """Sum of the last window's values by weight and a tenth of the first one's."""
    dot = lambda v: F.aggregate(F.zip_with(v, F.array(*map(F.lit, _WEIGHTS)), lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("score", dot(F.element_at("context", -1)) + 0.1 * dot(F.element_at("context", 1)))


_LIN = """WITH e AS (SELECT CAST(label AS BIGINT) AS capture_id, vec_id AS win, [list_sum([CAST(embedding[CAST(k + 8 * j + 1 AS INTEGER)] AS DOUBLE) FOR j IN range(len(embedding) // 8)]) FOR k IN range(8)] AS x FROM embeddings),
c AS (SELECT capture_id, win, list(x) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS context FROM e), k AS (SELECT * FROM c WHERE len(context) = 4),
m AS (SELECT f, avg(v) AS m FROM (SELECT unnest(range(8)) AS f, unnest(y) AS v FROM (SELECT unnest(context) AS y FROM k)) GROUP BY 1) """
_LW = "[" + ", ".join(f"{w}::DOUBLE" for w in _WEIGHTS) + "]"


@query(
    _LIN + f""", x AS (SELECT capture_id, win, context[4][1] AS a, context[4][2] AS b FROM k), mo AS (SELECT avg(a) AS ma, stddev_pop(a) + 1e-6::DOUBLE AS sa, avg(b) AS mb, stddev_pop(b) + 1e-6::DOUBLE AS sb FROM x WHERE a <= 0),
    z AS (SELECT capture_id, win, a <= 0 AS benign, (a - ma) / sa AS u, (b - mb) / sb AS v FROM x, mo), cv AS (SELECT avg(u * u) AS s11, avg(u * v) AS s12, avg(v * v) AS s22, count(*) AS n FROM z WHERE benign),
    q AS (SELECT s11, s12, s22, (s11 + s22) / 2 AS mu, n, (SELECT avg(pow(u * u - s11, 2) + 2 * pow(u * v - s12, 2) + pow(v * v - s22, 2)) FROM z, cv WHERE benign) / n AS noise FROM cv), h AS (SELECT *, pow(s11 - mu, 2) + 2 * s12 * s12 + pow(s22 - mu, 2) AS spread FROM q),
    r AS (SELECT least(noise, spread) / spread AS k, * FROM h), p AS (SELECT (1 - k) * s11 + k * mu AS p11, (1 - k) * s12 AS p12, (1 - k) * s22 + k * mu AS p22 FROM r)
    SELECT {_V}, {STEADY('(u * u * p22 - 2 * u * v * p12 + v * v * p11) / (p11 * p22 - p12 * p12)')} AS score FROM z, p"""
)
def mahalanobis_of_two(spark, sf_dir):
    s = materialised(_onset_contexts(spark, sf_dir).withColumn("context", F.transform("context", lambda row: F.slice(row, 1, 2))), "contexts")
    return steady(models.mahalanobis_score(s, models.fit_mahalanobis(s)).select("capture_id", "window", "score"))


@query(
    _LIN + f""", b AS (SELECT sum(m * ({_LW})[f + 1]) AS b FROM m), d AS (SELECT capture_id, win, abs(list_dot_product(context[4], {_LW}) - b) AS d0, abs(list_dot_product(context[1], {_LW}) - b) * 0.1 AS d3 FROM k, b)
    SELECT {_V}, lag, floor(CASE WHEN d0 + d3 = 0 THEN 0 ELSE CASE lag WHEN 0 THEN d0 WHEN 3 THEN d3 ELSE 0 END / (d0 + d3) END * 1e5 + 0.37771234::DOUBLE) / 1e5 AS share FROM d, (SELECT unnest([0, 1, 2, 3]) AS lag)"""
)
def temporal_attribution(spark, sf_dir):
    s = materialised(_onset_contexts(spark, sf_dir), "contexts")
    return steady(attribution.temporal_attribution(s, s, _linear))


_ALL = [((7 * k) % 11 - 5) / 8 for k in range(len(schema.STATE_FEATURES))]


def _tame(c: str) -> F.Column:
    return F.col(c).cast("double") / (1 + F.abs(F.col(c).cast("double")))


def _drivers(x: np.ndarray) -> np.ndarray:
    """Sum of the last window's features by weight and a tenth of the first one's."""
    w = np.array(_ALL)
    return x[:, -1] @ w + 0.1 * (x[:, 0] @ w)


def _state_contexts(spark, sf_dir):
    s = states_of_packets(spark, sf_dir).select("capture_id", "window", F.array(*map(_tame, schema.STATE_FEATURES)).alias("x"))
    return materialised(samples.contexts(s, 4, "x"), "contexts")


_DRIVEN = STATES + f""", sx AS (SELECT capture_id, win, [{', '.join(f'CAST({c} AS DOUBLE) / (1 + abs(CAST({c} AS DOUBLE)))' for c in schema.STATE_FEATURES)}] AS x FROM st),
sc AS (SELECT capture_id, win, x AS last, lag(x, 3) OVER (PARTITION BY capture_id ORDER BY win) AS first FROM sx), sf AS (SELECT capture_id, win, unnest(range({len(schema.STATE_FEATURES)})) AS feature, unnest(last) + 0.1::DOUBLE * unnest(first) AS v, unnest({_ALL}) AS w FROM sc WHERE first IS NOT NULL),
bg AS (SELECT feature, avg(v) AS m FROM sf WHERE capture_id = 0 AND win < 30 GROUP BY 1), ph AS (SELECT capture_id, win, feature, w * (v - m) AS phi FROM sf JOIN bg USING (feature)) """


@query(_DRIVEN + f"SELECT {_V}, CAST(feature AS INTEGER) AS feature, {STEADY('phi')} AS contribution FROM ph", "packets_v")
def feature_attribution(spark, sf_dir):
    c = _state_contexts(spark, sf_dir)
    shares = attribution.matrix_attribution(c, c.filter("capture_id = 0 AND window < 30"), _drivers)
    return steady(shares.select("capture_id", "window", "feature", "contribution"))


@query(
    _DRIVEN.rstrip() + f""", pl AS (SELECT *, row_number() OVER (PARTITION BY capture_id, win ORDER BY round(abs(phi), 9) DESC, feature) AS place FROM ph)
    SELECT {_V}, place, ({[*schema.STATE_FEATURES]})[feature + 1] AS feature, {STEADY('phi')} AS contribution, CASE WHEN phi > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM pl WHERE place <= 4""",
    "packets_v",
)
def top_drivers(spark, sf_dir):
    c = _state_contexts(spark, sf_dir)
    shares = attribution.matrix_attribution(c, c.filter("capture_id = 0 AND window < 30"), _drivers)
    name = F.get(F.array(*map(F.lit, schema.STATE_FEATURES)), F.col("feature"))
    return steady(attribution.top_drivers(shares, name, 4).drop("description"))


_FORECAST = _ON.rstrip() + """, rs AS (SELECT capture_id, win, count(*) FILTER (rst_count > 0) / count(*) AS v FROM w GROUP BY 1, 2),
cx AS (SELECT sp.capture_id, sp.win, list(coalesce(v, 0.0::DOUBLE)) OVER (PARTITION BY sp.capture_id ORDER BY sp.win ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM sp LEFT JOIN rs USING (capture_id, win)),
fc AS (SELECT o3.capture_id, win, CAST(onset IS NOT NULL AS INTEGER) AS y, round(list_reduce(list_prepend(0.0::DOUBLE, x), lambda a, v: 0.5::DOUBLE * v + 0.5::DOUBLE * a), 9) AS score, coalesce(onset - win, 0) AS steps, onset FROM o3 JOIN cx USING (capture_id, win)) """


def _forecast(spark, sf_dir):
    """Quiet samples scored by the smoothed share of flows with resets in their last four windows."""
    n, resets = F.count("*"), F.count(F.when(F.col("rst_count") > 0, 1))
    share = _timeline(spark, sf_dir).select("capture_id", "window").join(_w(spark, sf_dir).groupBy("capture_id", "window").agg((resets / n).alias("v")), ["capture_id", "window"], "left").fillna(0.0, ["v"])
    context = F.collect_list("v").over(Window.partitionBy("capture_id").orderBy("window").rowsBetween(-3, 0))
    scores = share.select("capture_id", "window", F.round(samples.ewma(context), 9).alias("score"))
    return materialised(_onsets(spark, sf_dir).withColumnRenamed("label", "y").join(scores, ["capture_id", "window"]), "forecast")


_CUT = lambda b: f"coalesce((SELECT min(score) FROM r WHERE n > 0 AND fp - n <= floor(nn * {b})), 'inf'::DOUBLE)"
_HIT = lambda y: f"(SELECT count(*) FILTER (score > cut AND y = {y}) / nullif(count(*) FILTER (y = {y}), 0) FROM fc, k)"
_PPV = lambda p: f"CASE WHEN {_HIT(1)} * {p} + {_HIT(0)} * (1 - {p}) > 0 THEN {_HIT(1)} * {p} / ({_HIT(1)} * {p} + {_HIT(0)} * (1 - {p})) END"


@query(
    _FORECAST.rstrip()
    + f""", g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM fc GROUP BY 1),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g),
k AS (SELECT {_CUT(0.05)} AS cut), ev AS (SELECT capture_id, onset, max(CASE WHEN score > cut THEN steps END) * 30.0 AS lead FROM fc, k WHERE onset IS NOT NULL GROUP BY 1, 2)
SELECT CAST((SELECT count(*) FROM fc) AS BIGINT) AS n, max(np) AS n_pos, max(nn) AS n_neg, round(max(np / (np + nn)), 6) AS prevalence, round({_HIT(0)}, 6) AS fpr, round({_HIT(1)}, 6) AS tpr, round(sum(n * (tp - p / 2)) / max(np * nn), 6) AS auc, round(sum(p * tp / (tp + fp)) / max(np), 6) AS average_precision,
  (SELECT count(*) FROM ev) AS n_events, round((SELECT count(lead) / count(*) FROM ev), 6) AS event_recall, (SELECT quantile_cont(CAST(lead AS DOUBLE), 0.5) FROM ev) AS median_lead_s,
  (SELECT cut FROM k) AS threshold, 'test (optimistic)' AS threshold_source, 0.05::DOUBLE AS fpr_budget, round(max(np / (np + nn)), 6) AS chance_ap, round({_HIT(0)} * 2880, 6) AS false_alerts_per_day, round(3.0 / max(nn), 6) AS fpr_resolution, 0.05 >= 3.0 / max(nn) AS budget_resolvable,
  {', '.join(f"round({_PPV(p)}, 6) AS ppv_{k}" for k, p in enumerate(studies.PREVALENCES, 2))},
  {', '.join(f"round((SELECT sum(CASE WHEN score > {_CUT(b)} THEN p ELSE 0 END) / max(np) FROM r), 6) AS tpr_at_{f'{b:g}'.replace('.', '_')}" for b in protocol.FPR_BUDGETS)} FROM r""",
    "flows_v",
    "timeline_v",
)
def evaluate_forecaster(spark, sf_dir):
    return rounded(protocol.evaluate_forecaster(_forecast(spark, sf_dir), budget=0.05))


@query(
    _FORECAST.rstrip()
    + """, c AS (SELECT DISTINCT capture_id FROM fc), i AS (SELECT capture_id, row_number() OVER (ORDER BY capture_id) - 1 AS i, count(*) OVER () AS m FROM c), mm AS (SELECT max(m) AS m FROM i),
d AS (SELECT CAST(floor(x.range / m) AS BIGINT) AS rep, CAST('0x' || substr(md5(concat('0|', x.range)), 1, 8) AS BIGINT) % m AS i FROM mm, range(0, 200 * (SELECT m FROM mm)) x), k AS (SELECT rep, capture_id, count(*) AS k FROM d JOIN i USING (i) GROUP BY 1, 2),
pr AS (SELECT capture_id, score, sum(y) AS p, sum(1 - y) AS n FROM fc GROUP BY 1, 2), g AS (SELECT rep, score, sum(k * p) AS p, sum(k * n) AS n FROM k JOIN pr USING (capture_id) GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY score DESC) AS tp FROM g),
u AS (SELECT rep, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc FROM r GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0),
tp AS (SELECT rep, sum(k * h) / sum(k * p) AS tpr FROM k JOIN (SELECT capture_id, count(*) FILTER (y = 1 AND score >= 0.25) AS h, sum(y) AS p FROM fc GROUP BY 1) USING (capture_id) GROUP BY 1),
ev AS (SELECT capture_id, onset, max(CAST(score >= 0.25 AS INTEGER)) AS warned FROM fc WHERE onset IS NOT NULL GROUP BY 1, 2),
er AS (SELECT rep, sum(k * a) / sum(k * b) AS recall FROM k JOIN (SELECT capture_id, sum(warned) AS a, count(*) AS b FROM ev GROUP BY 1) USING (capture_id) GROUP BY 1)
SELECT CAST(count(*) AS INTEGER) AS draws, """
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{side}" for n, c in (("auc", "auc"), ("tpr", "tpr"), ("event_recall", "recall")) for side, q in (("low", 0.025), ("high", 0.975)))
    + " FROM u LEFT JOIN tp USING (rep) LEFT JOIN er USING (rep)",
    "flows_v",
    "timeline_v",
)
def bootstrap_intervals(spark, sf_dir):
    return rounded(evaluation.cluster_bootstrap(_forecast(spark, sf_dir), 200, threshold=0.25))


@query("WITH s AS (SELECT * FROM scores_v WHERE y = 0) SELECT count(*) AS windows, count(*) FILTER (score_milli >= 950) AS alerts FROM s", "scores_v")
def false_alarm_counts(spark, sf_dir):
    return protocol.false_alarm_bound(_scores(spark, sf_dir).filter("y = 0"), 0.95, 2.0).select("windows", "alerts")


_PRE = " UNION ALL ".join(f"SELECT capture_id, win, '{c}' AS feature, {c} AS value FROM st" for c in schema.PRECURSOR_FEATURES)


@query(
    f"""{STATES}, lg AS ({_PRE}), ms AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-6 AS s FROM lg WHERE capture_id = 0 GROUP BY 1),
    ct AS (SELECT capture_id, win, list((value - ms.m) / ms.s) OVER (PARTITION BY capture_id, lg.feature ORDER BY win ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS x FROM lg JOIN ms USING (feature)),
    ew AS (SELECT capture_id, win, list_reduce(list_prepend(0.0::DOUBLE, x), lambda a, v: 0.5::DOUBLE * v + 0.5::DOUBLE * a) AS score FROM ct WHERE len(x) = 16)
    SELECT {_V}, {STEADY('max(score)')} AS score FROM ew GROUP BY 1, 2""",
    "packets_v",
)
def cusum_precursors(spark, sf_dir):
    long = studies.long_view(materialised(states_of_packets(spark, sf_dir), "states"), schema.PRECURSOR_FEATURES)
    return steady(reports.cusum_score(long, long.filter("capture_id = 0")))


@query("SELECT stage_true, stage_pred, count(*) AS n FROM scores_v GROUP BY 1, 2", "scores_v")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(fixtures.view(spark, sf_dir, "scores_v"))


@query(
    """WITH a AS (SELECT stage_true AS stage, count(*) AS support, count(*) FILTER (stage_pred = stage_true) AS ok FROM scores_v GROUP BY 1), b AS (SELECT stage_pred AS stage, count(*) AS predicted FROM scores_v GROUP BY 1),
    m AS (SELECT coalesce(support, 0) AS support, CASE WHEN coalesce(ok, 0) = 0 THEN 0 ELSE 2 * ok / (support + predicted) END AS f1, coalesce(ok, 0) AS ok FROM a FULL JOIN b USING (stage))
    SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(ok) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m""",
    "scores_v",
)
def stage_summary(spark, sf_dir):
    return rounded(evaluation.stage_summary(fixtures.view(spark, sf_dir, "scores_v"), 7))


@query()
def analysis_result(spark, sf_dir):
    flows_ = materialised(flows_of_packets(spark, sf_dir), "flows")
    s = materialised(windows.build_states(flows_), "states")
    stage = F.element_at(F.array(*map(F.lit, schema.STAGES)), ((F.col("window") * 5 + F.col("capture_id")) % 7 + 1).cast("int"))
    v = materialised(labels.score_timeline(s.select("capture_id", "window", (F.col("window") * 37 % 101 / 100).alias("probability"), stage.alias("stage")), s), "verdicts")
    peaks = labels.peaks(v)
    flagged = studies.flagged_flows(windows.assign_windows(flows_), peaks).select("capture_id", "place", "flow_id", "total_packets", "total_bytes", "score")
    return studies.serialise_analysis(labels.headline(v).join(peaks, "capture_id"), v, flagged)
