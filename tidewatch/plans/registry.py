"""Queries over the driver's tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, schema
from ..functions import expressions as ex
from ..operators import evaluation, flows, labels, profile, samples, windows
from ..sources.shared import materialised

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = fixtures.with_views(sql, *views)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


EDGE = 0.37771234


def steady(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles cut to cells whose edges no short fraction meets, so that a last digit of the sums never decides; see STEADY."""
    cell = lambda c: F.floor(c * float(10**digits) + F.lit(EDGE)).cast("double") / float(10**digits)
    return df.select(*(cell(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def STEADY(x: str, digits: int = 5) -> str:  # noqa: N802
    """The SQL of ``steady``."""
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + {EDGE}::DOUBLE) / 1e{digits}"


def _in(ports: tuple) -> str:
    return f"({', '.join(map(str, ports))})"


_INT = lambda c: f"(list_reduce([CAST(x AS BIGINT) FOR x IN string_split({c}, '.')], lambda a, b: a * 256 + b))"
_INSIDE = lambda c: "(" + " OR ".join(f"({_INT(c)} >> {32 - b}) = {n >> (32 - b)}" for n, b in schema.PRIVATE_BLOCKS) + ")"

def windows_sql(flows: str) -> str:
    """CTEs t (grid of each capture) and w (flows with their window) over a table of flows."""
    return f"""WITH t AS (SELECT capture_id, min(start_us) t0, CAST(floor((max(start_us) - min(start_us)) / 30000000) AS BIGINT) + 1 AS n_windows FROM {flows} GROUP BY 1),
w AS (SELECT f.*, t.t0, t.n_windows, CAST(floor((start_us - t0) / 30000000) AS BIGINT) AS win, {_INSIDE('src_ip')} AS src_in, {_INSIDE('dst_ip')} AS dst_in FROM {flows} f JOIN t USING (capture_id)) """


W = windows_sql("flows_v")
_G = "GROUP BY capture_id, win"


def _w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_windows(fixtures.view(spark, sf_dir, "flows_v"))


def _stage_sql(column: str) -> str:
    tests = []
    for pattern, stage in schema.LABEL_PATTERNS:
        for ahead, plain in (("backdoor(?!.*c2)", "backdoor"), ("|worm(?!.*dos)", ""), ("|shellcode\\b(?!.*access)", "")):
            pattern = pattern.replace(ahead, plain)
        tests.append(f"WHEN regexp_matches(lower(trim({column})), '{pattern}') THEN '{stage}'")
    return f"CASE WHEN trim({column}) = '' THEN 'Benign' {' '.join(tests)} ELSE 'OutOfScope' END"


_INDEX = "CASE {} " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(schema.STAGES)) + " END"


@query(
    f"""SELECT DISTINCT src_ip, {_INT('src_ip')} AS ip_value, {_INSIDE('src_ip')} AS internal, src_port IN {_in(schema.AUTH_PORTS)} AS auth, src_port IN {_in(schema.WELL_KNOWN_PORTS)} AS well_known, tcp_flags,
    array_to_string(list_filter([{', '.join(f"CASE WHEN tcp_flags & {b} <> 0 THEN '{n}' END" for b, n in schema.TCP_FLAGS)}], lambda x: x IS NOT NULL), '|') AS flags FROM packets_v""",
    "packets_v",
)
def address_functions(spark, sf_dir):
    p = fixtures.view(spark, sf_dir, "packets_v")
    return p.select("src_ip", ex.ip_to_int(F.col("src_ip")).alias("ip_value"), ex.is_internal(F.col("src_ip")).alias("internal"), ex.service_class(F.col("src_port"), schema.AUTH_PORTS).alias("auth"), ex.service_class(F.col("src_port"), schema.WELL_KNOWN_PORTS).alias("well_known"), "tcp_flags", ex.flags_to_str(F.col("tcp_flags")).alias("flags")).distinct()


@query(
    f"WITH s AS (SELECT label, {_stage_sql('label')} AS stage FROM flows_v) SELECT label, stage, CAST(stage IN {schema.INFILTRATION_STAGES} AS INTEGER) AS infiltration, count(*) AS n FROM s GROUP BY ALL",
    "flows_v",
)
def stage_from_label(spark, sf_dir):
    f = fixtures.view(spark, sf_dir, "flows_v").withColumn("stage", ex.stage_from_label(F.col("label")))
    return f.groupBy("label", "stage", ex.infiltration_flag(F.col("stage")).alias("infiltration")).agg(F.count("*").alias("n"))


_CONV = f"""WITH k AS (SELECT *, ({_INT('src_ip')}, src_port) <= ({_INT('dst_ip')}, dst_port) AS low FROM packets_v),
c AS (SELECT *, CASE WHEN low THEN concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol) ELSE concat(dst_ip, ':', dst_port, '-', src_ip, ':', src_port, '-', protocol) END AS conv FROM k),
d AS (SELECT *, src_ip = first_value(src_ip) OVER q AND src_port = first_value(src_port) OVER q AS fwd, row_number() OVER q AS rn, coalesce(ts_us - lag(ts_us) OVER q, 0) AS gap FROM c WINDOW q AS (PARTITION BY capture_id, conv ORDER BY ts_us, packet_no)),
"""


@query(_CONV + "i AS (SELECT *, sum(CASE WHEN gap > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, conv ORDER BY ts_us, packet_no) AS island FROM d) SELECT capture_id, packet_no, fwd, CAST(island AS BIGINT) AS island FROM i", "packets_v")
def split_idle(spark, sf_dir):
    p = flows.split_idle(flows.flow_direction(flows.canonical_key(fixtures.view(spark, sf_dir, "packets_v"))))
    return p.select("capture_id", "packet_no", "fwd", "island")


_EPISODES = _CONV + """e AS (
  SELECT capture_id, conv, rn, packet_no, ts_us, 0 AS ep, ts_us AS start, fwd AND protocol = 6 AND tcp_flags & 5 = 1 AS ff, NOT fwd AND protocol = 6 AND tcp_flags & 5 = 1 AS fb, false AS grace, protocol = 6 AND tcp_flags & 4 <> 0 AS closed FROM d WHERE rn = 1
  UNION ALL
  SELECT capture_id, conv, rn, packet_no, ts_us, CASE WHEN cut THEN ep + 1 ELSE ep END, CASE WHEN cut THEN ts_us ELSE start END, nff, nfb, g OR (fin AND nff AND nfb), g OR rst
  FROM (SELECT *, (ff AND NOT cut) OR (fin AND fwd) AS nff, (fb AND NOT cut) OR (fin AND NOT fwd) AS nfb, grace AND NOT cut AS g
    FROM (SELECT d.*, e.ep, e.start, e.ff, e.fb, e.grace, d.gap > 120000000 OR d.ts_us - e.start > 300000000 OR e.closed AS cut, d.protocol = 6 AND d.tcp_flags & 4 <> 0 AS rst, d.protocol = 6 AND d.tcp_flags & 5 = 1 AS fin
      FROM e JOIN d ON d.capture_id = e.capture_id AND d.conv = e.conv AND d.rn = e.rn + 1))),
"""
_FLOW = _EPISODES + """x AS (SELECT d.*, e.ep FROM d JOIN e USING (capture_id, conv, rn)),
y AS (SELECT *, CASE WHEN payload_len > 0 AND protocol = 6 THEN 1 WHEN payload_len <= 0 AND protocol = 6 AND tcp_flags & 16 <> 0 THEN 2 ELSE 0 END AS kind FROM x),
z AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY capture_id, conv, ep ORDER BY ts_us, packet_no) AS g1, ts_us - lag(ts_us) OVER (PARTITION BY capture_id, conv, ep, fwd ORDER BY ts_us, packet_no) AS g2,
  row_number() OVER (PARTITION BY capture_id, conv, ep, fwd, kind, tcp_seq, payload_len ORDER BY ts_us, packet_no) > 1 AS again,
  max(tcp_seq) OVER (PARTITION BY capture_id, conv, ep, fwd, kind ORDER BY ts_us, packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest,
  lag(tcp_ack) OVER (PARTITION BY capture_id, conv, ep, fwd, kind ORDER BY ts_us, packet_no) AS last_ack FROM y)
"""


_SI = _INDEX.format(f"({_stage_sql('label')})")


@query(
    W.rstrip() + f""", s AS (SELECT capture_id, win, {_SI} AS i FROM w) SELECT capture_id, win AS "window", CAST(coalesce(max(i), 0) AS INTEGER) AS stage, NOT (max(i) IS NULL OR (max(i) = 0 AND count(*) FILTER (i IS NULL) > 0)) AS valid FROM s {_G}""",
    "flows_v",
)
def label_windows_flows(spark, sf_dir):
    return labels.label_windows_flows(_w(spark, sf_dir))


_TL = W.rstrip() + f""", sp AS (SELECT capture_id, t0, unnest(range(n_windows)) AS win FROM t), pb AS (SELECT capture_id, win, unnest([t0 + win * 30000000, t0 + win * 30000000 + 15000000, t0 + win * 30000000 + 29999999]) AS t_us FROM sp),
lb AS (SELECT pb.*, stage, CASE WHEN stage = 'Impact' THEN 0 ELSE {_INDEX.format('stage')} END AS rk FROM pb LEFT JOIN timeline_v v ON v.capture_id = pb.capture_id AND t_us BETWEEN start_us AND end_us),
l1 AS (SELECT capture_id, win, t_us, coalesce(arg_max(stage, rk), 'Benign') AS stage FROM lb GROUP BY ALL), lw AS (SELECT capture_id, win, CAST(max({_INDEX.format('stage')}) AS INTEGER) AS stage FROM l1 {_G}) """


def _timeline(spark, sf_dir):
    f = fixtures.view(spark, sf_dir, "flows_v")
    spine = windows.window_spine(f).join(windows.bounds(f).select("capture_id", "t0"), "capture_id")
    return labels.label_windows_timeline(spine, fixtures.view(spark, sf_dir, "timeline_v"))


@query(_TL + 'SELECT capture_id, win AS "window", stage FROM lw', "flows_v", "timeline_v")
def label_windows_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


_ON = _TL.rstrip() + """, o1 AS (SELECT capture_id, win, CAST(stage > 1 AS INTEGER) AS act, count(*) OVER (PARTITION BY capture_id) AS n FROM lw),
o2 AS (SELECT *, max(act) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS busy, min(CASE WHEN act = 1 THEN win END) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS onset FROM o1),
o3 AS (SELECT * FROM o2 WHERE win >= 3 AND win <= n - 6 AND busy = 0) """


def _onsets(spark, sf_dir):
    w = _timeline(spark, sf_dir).select("capture_id", "window", (F.col("stage") > 1).cast("int").alias("active"), F.lit(True).alias("valid"))
    return samples.build_onset_samples(w, 4, 5)


@query(_ON + 'SELECT capture_id, win AS "window", CAST(onset IS NOT NULL AS INTEGER) AS label, coalesce(onset - win, 0) AS steps_to_onset, onset FROM o3', "flows_v", "timeline_v")
def build_onset_samples(spark, sf_dir):
    return _onsets(spark, sf_dir)


@query(_ON + ", s AS (SELECT capture_id, onset, onset - win AS steps, (win * 37 % 100) / 100.0 AS score FROM o3 WHERE onset IS NOT NULL), p AS (SELECT capture_id, onset, max(CASE WHEN score >= 0.5 THEN steps END) * 30.0 AS lead FROM s GROUP BY 1, 2) SELECT capture_id, count(*) AS events, count(lead) AS warned, round(quantile_cont(CAST(lead AS DOUBLE), 0.5), 6) AS median_lead_s FROM p GROUP BY 1", "flows_v", "timeline_v")
def event_stats(spark, sf_dir):
    s = _onsets(spark, sf_dir).withColumn("score", F.col("window") * 37 % 100 / 100)
    return rounded(evaluation.event_stats(s, 0.5))


_SEQ = W.rstrip() + """, st AS (SELECT capture_id, win, count(*) AS n, CAST(max(rst_count) AS INTEGER) AS r FROM w GROUP BY 1, 2), q AS (SELECT capture_id, win, list(n) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c, lead(n) OVER (PARTITION BY capture_id ORDER BY win) AS nx, list(r) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS s FROM st),
k AS (SELECT * FROM q WHERE len(c) = 4 AND len(s) = 3) """


def _sequences(spark, sf_dir):
    s = _w(spark, sf_dir).groupBy("capture_id", "window").agg(F.count("*").alias("n"), F.max("rst_count").cast("int").alias("r"))
    return samples.build_sequences(s, 4, 3, "n", "r")


@query(_SEQ + """SELECT capture_id, win AS "window", array_to_string(c, ',') AS context, nx AS target_state, array_to_string(s, ',') AS target_stage, round(list_reduce(list_prepend(0.0::DOUBLE, [CAST(x AS DOUBLE) FOR x IN c]), lambda a, x: 0.5 * x + 0.5 * a), 6) AS ewma FROM k""", "flows_v")
def build_sequences(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.select("capture_id", "window", text(F.col("context")).alias("context"), "target_state", text(F.col("target_stage")).alias("target_stage"), F.round(samples.ewma(F.col("context")), 6).alias("ewma"))


@query(_SEQ + """, i AS (SELECT capture_id, win, row_number() OVER (PARTITION BY capture_id ORDER BY win) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM k), b AS (SELECT *, n - round_even(n * 0.15, 0) - round_even(n * 0.25, 0) AS e1, n - round_even(n * 0.25, 0) AS e2, round_even(n * 0.15, 0) AS nv, round_even(n * 0.25, 0) AS nt FROM i),
d AS (SELECT *, greatest(0, least(40, e1 - 1, CASE WHEN nv > 0 THEN nv - 1 ELSE 0 END, CASE WHEN nt > 0 THEN nt - 1 ELSE 0 END)) AS g FROM b)
SELECT capture_id, win AS "window", CASE WHEN i < e1 - g THEN 'train' WHEN i >= e1 AND i < e2 - g THEN 'val' WHEN i >= e2 THEN 'test' END AS split FROM d WHERE e1 > 0 AND (i < e1 - g OR (i >= e1 AND i < e2 - g) OR i >= e2)""", "flows_v")
def time_split(spark, sf_dir):
    return samples.time_split(_sequences(spark, sf_dir).select("capture_id", "window"), 0.15, 0.25, 40)


@query("WITH c AS (SELECT DISTINCT capture_id FROM scores_v), o AS (SELECT capture_id, row_number() OVER (ORDER BY md5(concat('7|', capture_id)), capture_id) AS i, count(*) OVER () AS n FROM c) SELECT capture_id, CASE WHEN i <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' WHEN i <= greatest(1, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM o", "scores_v")
def group_split(spark, sf_dir):
    s = fixtures.view(spark, sf_dir, "scores_v").select("capture_id").distinct()
    return samples.group_split(s, 0.2, 0.2, 7)


@query("WITH c AS (SELECT CAST(stage_true AS INTEGER) AS stage, count(*) AS n FROM scores_v GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c) SELECT CAST(r.range AS INTEGER) AS stage, round(coalesce(total / (k * n), 1.0), 6) AS weight FROM range(8) r LEFT JOIN c ON c.stage = r.range, t", "scores_v")
def class_weights(spark, sf_dir):
    s = fixtures.view(spark, sf_dir, "scores_v").select(F.col("stage_true").cast("int").alias("stage"))
    return rounded(samples.class_weights(s, 8))


_LONG = "WITH l AS (SELECT CAST(label AS BIGINT) AS capture_id, vec_id AS win, CAST(unnest(range(len(embedding))) AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), "
_STD = _LONG + "f AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM l GROUP BY 1), "


def _long(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("long").alias("capture_id"), F.col("vec_id").alias("window"), F.posexplode("embedding").alias("feature", "v")).select("capture_id", "window", "feature", F.col("v").cast("double").alias("value"))


_SCALED = _STD + "e AS (SELECT feature, m, s < 1e-8 AS constant, CASE WHEN s < 1e-8 THEN 1.0 ELSE s END AS sc, a, b FROM f) "


@query(_SCALED + "SELECT feature, round(m, 5) AS mean, round(sc, 5) AS scale, round((a - m) / sc - 1, 5) AS lo, round((b - m) / sc + 1, 5) AS hi, constant FROM e")
def fit_standardiser(spark, sf_dir):
    return rounded(profile.fit_standardiser(_long(spark, sf_dir)), 5)


@query(
    _LONG + """c AS (SELECT feature, quantile_cont(value, 0.5) AS centre, stddev_pop(value) AS std FROM l GROUP BY 1),
    d AS (SELECT feature, centre, std, quantile_cont(abs(value - centre), 0.5) AS mad FROM l JOIN c USING (feature) GROUP BY 1, 2, 3)
    SELECT feature, round(centre, 5) AS centre, round(greatest(1.4826 * mad, 0.5 * std, 1e-3 + 0.01 * abs(centre)), 5) AS scale FROM d"""
)
def fit_profile(spark, sf_dir):
    return rounded(profile.fit_profile(_long(spark, sf_dir)), 5)


@query(
    _SCALED + """, o AS (SELECT capture_id, win, avg(CASE WHEN constant THEN CASE WHEN abs(value - m) > 1e-8 THEN 1.0 ELSE 0.0 END WHEN (value - m) / sc < (a - m) / sc - 1 OR (value - m) / sc > (b - m) / sc + 1 THEN 1.0 ELSE 0.0 END) AS share FROM l JOIN e USING (feature) GROUP BY 1, 2),
    g AS (SELECT capture_id, quantile_cont(share, 0.5) AS mid, quantile_cont(share, 0.95) AS high, count(*) FILTER (share > 0.10) AS n FROM o GROUP BY 1)
    SELECT capture_id, round(mid, 5) AS median_outside, round(high, 5) AS p95_outside, n AS windows_outside, CASE WHEN mid > 0.10 THEN 'outside' WHEN mid > 0.03 THEN 'marginal' ELSE 'inside' END AS verdict FROM g"""
)
def assess_novelty(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(profile.assess_novelty(long, materialised(profile.fit_standardiser(long), "standardiser")), 5)


def _scores(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "scores_v").withColumn("score", F.col("score_milli") / 1000)


_SC = "WITH s AS (SELECT *, score_milli / 1000 AS score FROM scores_v), "
_RUN = "g AS (SELECT capture_id, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER q AS tp, sum(n) OVER q AS fp FROM g WINDOW q AS (PARTITION BY capture_id ORDER BY score DESC)) "


@query(_SC + "c AS (SELECT count(*) FILTER (score >= 0.6 AND y = 1) AS tp, count(*) FILTER (score >= 0.6 AND y = 0) AS fp, count(*) FILTER (score < 0.6 AND y = 0) AS tn, count(*) FILTER (score < 0.6 AND y = 1) AS fn FROM s) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c", "scores_v")
def binary_metrics(spark, sf_dir):
    return rounded(evaluation.binary_metrics(_scores(spark, sf_dir), 0.6))


@query(_SC + _RUN + "SELECT capture_id, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM r GROUP BY 1", "scores_v")
def ranking_metrics(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return rounded(evaluation.roc_auc(s, "capture_id").join(evaluation.average_precision(s, "capture_id"), "capture_id"))


@query(_SC + "n AS (SELECT capture_id, score, count(*) AS c FROM s WHERE y = 0 GROUP BY 1, 2), a AS (SELECT *, sum(c) OVER (PARTITION BY capture_id ORDER BY score DESC) - c AS above, sum(c) OVER (PARTITION BY capture_id) AS t FROM n) SELECT capture_id, round(min(score), 6) AS cut FROM a WHERE above <= floor(t * 0.05) GROUP BY 1", "scores_v")
def threshold_for_fpr(spark, sf_dir):
    return rounded(evaluation.threshold_for_fpr(_scores(spark, sf_dir), 0.05))


@query("WITH a AS (SELECT stage_true AS stage, count(*) AS support, count(*) FILTER (stage_pred = stage_true) AS ok FROM scores_v GROUP BY 1), b AS (SELECT stage_pred AS stage, count(*) AS predicted FROM scores_v GROUP BY 1) SELECT a.stage, support, round(coalesce(ok / predicted, 0), 6) AS precision, round(ok / support, 6) AS recall, round(CASE WHEN ok = 0 THEN 0 ELSE 2 * ok / (support + predicted) END, 6) AS f1 FROM a LEFT JOIN b USING (stage)", "scores_v")
def stage_metrics(spark, sf_dir):
    return rounded(evaluation.stage_metrics(fixtures.view(spark, sf_dir, "scores_v"), 7))


@query(_SC + "c AS (SELECT DISTINCT capture_id FROM s), i AS (SELECT capture_id, row_number() OVER (ORDER BY capture_id) - 1 AS i, count(*) OVER () AS m FROM c), mm AS (SELECT max(m) AS m FROM i), d AS (SELECT CAST(floor(x.range / m) AS BIGINT) AS rep, CAST('0x' || substr(md5(concat('0|', x.range)), 1, 8) AS BIGINT) % m AS i FROM mm, range(0, 200 * (SELECT m FROM mm)) x), k AS (SELECT rep, i, count(*) AS k FROM d GROUP BY 1, 2), pr AS (SELECT capture_id, score, sum(y) AS p, count(*) AS c FROM s GROUP BY 1, 2), g AS (SELECT rep, score, sum(k * p) AS p, sum(k * (c - p)) AS n FROM k JOIN i USING (i) JOIN pr USING (capture_id) GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY score DESC) AS tp FROM g), u AS (SELECT rep, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc FROM r GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0) SELECT count(*) AS draws, round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high FROM u", "scores_v")
def cluster_bootstrap(spark, sf_dir):
    return rounded(evaluation.cluster_bootstrap(_scores(spark, sf_dir), 200))


_EP = "WITH s AS (SELECT capture_id, CAST(floor(t / 10) AS BIGINT) AS win, max(score_milli) / 1000 AS score FROM scores_v GROUP BY 1, 2), "


def _windowed(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "scores_v").groupBy("capture_id", F.expr("t div 10").alias("window")).agg((F.max("score_milli") / 1000).alias("score"))


@query(_EP + "a AS (SELECT *, win - row_number() OVER (PARTITION BY capture_id ORDER BY win) AS i FROM s WHERE score >= 0.7) SELECT capture_id, min(win) AS first_window, max(win) AS last_window, count(*) AS n_windows, round(max(score), 6) AS peak FROM a GROUP BY capture_id, i", "scores_v")
def alert_episodes(spark, sf_dir):
    return rounded(labels.alert_episodes(_windowed(spark, sf_dir), 0.7))


@query(_EP.rstrip(", ") + " SELECT capture_id, win AS \"window\", round(score, 6) AS score, round(avg(score) OVER (PARTITION BY capture_id ORDER BY win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM s", "scores_v")
def smooth_scores(spark, sf_dir):
    return rounded(samples.smooth_scores(_windowed(spark, sf_dir), 3))


@query(_EP + "m AS (SELECT capture_id, max(score) AS peak FROM s GROUP BY 1) SELECT s.capture_id, min(win) AS \"window\", round(max(peak), 6) AS peak FROM s JOIN m ON s.capture_id = m.capture_id AND s.score = m.peak GROUP BY 1", "scores_v")
def peak_window(spark, sf_dir):
    return rounded(labels.peak_window(_windowed(spark, sf_dir)))


from . import more, reports, states, studies  # noqa: E402, F401  register their queries
