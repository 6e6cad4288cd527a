"""Queries from packets to flows, window states, rule scores and verdicts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, schema
from ..operators import flows, labels, studies, windows
from ..sources.shared import materialised
from .registry import _FLOW, _INSIDE, STEADY, W, _in, _w, query, steady, windows_sql

_FOUR = (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))
_IAT = ", ".join(f"coalesce({f}({c}){cond}, 0) / 1e6 AS {pre}iat_{k}" for pre, c, cond in (("", "g1", ""), ("fwd_", "g2", " FILTER (fwd)"), ("bwd_", "g2", " FILTER (NOT fwd)")) for f, k in _FOUR)
_STAT = ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {n}_{k}" for c, n in (("ip_ttl", "ttl"), ("tcp_window", "window"), ("payload_len", "payload")) for f, k in _FOUR)
_FLAGS = ", ".join(f"count(*) FILTER (tcp_flags & {b} <> 0) AS {n.lower()}_count" for b, n in schema.TCP_FLAGS)
_DIV = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
FLOWS = (
    _FLOW.rstrip()
    + f""", fa AS (SELECT capture_id, arg_min(packet_no, (ts_us, packet_no)) AS flow_no, min(ts_us) AS start_us, max(ts_us) AS end_us,
  {', '.join(f'arg_min({c}, (ts_us, packet_no)) AS {c}' for c in ('src_ip', 'dst_ip', 'src_port', 'dst_port'))}, any_value(protocol) AS protocol, (max(ts_us) - min(ts_us)) / 1e6 AS flow_duration,
  count(*) FILTER (fwd) AS fwd_packets, count(*) FILTER (NOT fwd) AS bwd_packets, count(*) AS total_packets, CAST(coalesce(sum(ip_len) FILTER (fwd), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(ip_len) FILTER (NOT fwd), 0) AS BIGINT) AS bwd_bytes, CAST(sum(ip_len) AS BIGINT) AS total_bytes,
  {_IAT}, {_FLAGS}, {_STAT}, count(DISTINCT ip_ttl) AS ttl_unique, coalesce(avg(ip_ttl) FILTER (fwd), avg(ip_ttl)) AS fwd_ttl_mean, count(*) FILTER (tcp_window = 0) AS window_zero_count,
  CAST(quantile_cont(payload_len, 0.5) AS DOUBLE) AS payload_p50, CAST(quantile_cont(payload_len, 0.9) AS DOUBLE) AS payload_p90, count(*) FILTER (payload_len = 0) / count(*) AS payload_zero_ratio, avg(ihl) AS header_len_mean, avg(tcp_doff) AS tcp_doff_mean,
  count(*) FILTER (kind = 1 AND again) AS retransmission_count, count(*) FILTER (kind = 1 AND again) / count(*) AS retransmission_ratio, count(*) FILTER (kind = 1 AND NOT again AND tcp_seq < highest) AS out_of_order_count, count(*) FILTER (kind = 2 AND tcp_ack = last_ack) AS dup_ack_count,
  count(*) FILTER (ip_flags & 1 <> 0 OR frag_offset > 0) AS frag_packet_count, count(*) FILTER (ip_flags & 2 <> 0) / count(*) AS df_ratio, count(*) FILTER (ip_flags & 1 <> 0) / count(*) AS mf_ratio FROM z GROUP BY capture_id, conv, ep),
flows_a AS (SELECT *, total_bytes / greatest(flow_duration, 1e-6) AS flow_bytes_per_s, total_packets / greatest(flow_duration, 1e-6) AS flow_packets_per_s, fwd_packets / greatest(flow_duration, 1e-6) AS fwd_packets_per_s, bwd_packets / greatest(flow_duration, 1e-6) AS bwd_packets_per_s,
  {_DIV('fwd_bytes', 'total_bytes')} AS bytes_ratio, fwd_packets / total_packets AS packets_ratio, total_bytes / total_packets AS mean_packet_size, {_DIV('fwd_bytes', 'fwd_packets')} AS fwd_mean_packet_size, {_DIV('bwd_bytes', 'bwd_packets')} AS bwd_mean_packet_size,
  {', '.join(f'{k}_count / total_packets AS {k}_ratio' for k in ('syn', 'rst', 'ack', 'psh'))}, CAST(dst_port IN {_in(schema.WELL_KNOWN_PORTS)} AS INTEGER) AS is_wellknown_dst_port,
  concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol, '-', start_us) AS flow_id FROM fa)"""
)
_DOUBLES = [f"{p}iat_{k}" for p in ("", "fwd_", "bwd_") for _, k in _FOUR] + [f"{n}_{k}" for n in ("ttl", "window", "payload") for k in ("mean", "std")]
_DOUBLES += ["flow_duration", "fwd_ttl_mean", "payload_p50", "payload_p90", "payload_zero_ratio", "header_len_mean", "tcp_doff_mean", "retransmission_ratio", "df_ratio", "mf_ratio"]
_DOUBLES += ["flow_bytes_per_s", "flow_packets_per_s", "fwd_packets_per_s", "bwd_packets_per_s", "bytes_ratio", "packets_ratio", "mean_packet_size", "fwd_mean_packet_size", "bwd_mean_packet_size", "syn_ratio", "rst_ratio", "ack_ratio", "psh_ratio"]
_WHOLE = [f"{n}_{k}" for n in ("ttl", "window", "payload") for k in ("min", "max")] + [f"{n.lower()}_count" for _, n in schema.TCP_FLAGS]
_WHOLE += ["capture_id", "flow_no", "start_us", "end_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_id", "is_wellknown_dst_port", "fwd_packets", "bwd_packets", "total_packets", "fwd_bytes", "bwd_bytes", "total_bytes"]
_WHOLE += ["ttl_unique", "window_zero_count", "retransmission_count", "out_of_order_count", "dup_ack_count", "frag_packet_count"]


def flows_of_packets(spark, sf_dir):
    return flows.assemble_flows(fixtures.view(spark, sf_dir, "packets_v"))


WHOLE_FLOWS = f"{', '.join(f'CAST({c} AS BIGINT) AS {c}' if c.endswith(('_min', '_max')) else c for c in _WHOLE)}, {', '.join(f'{STEADY(c, 4)} AS {c}' for c in _DOUBLES)}"


def whole_flows(f):
    """Every column of flows, doubles cut to steady cells."""
    return steady(f.select(*(F.col(c).cast("long").alias(c) if c.endswith(("_min", "_max")) else c for c in _WHOLE), *_DOUBLES), 4)


@query(f"{FLOWS} SELECT {WHOLE_FLOWS} FROM flows_a", "packets_v")
def assemble_flows(spark, sf_dir):
    return whole_flows(flows_of_packets(spark, sf_dir))


@query(
    f"""WITH h AS (SELECT capture_id, unnest([src_ip, dst_ip]) AS host FROM packets_v), c AS (SELECT capture_id, host, count(*) AS n_packets FROM h WHERE {_INSIDE('host')} GROUP BY 1, 2),
    v AS (SELECT capture_id, arg_min(host, (-n_packets, host)) AS victim FROM c GROUP BY 1),
    p AS (SELECT c.*, row_number() OVER (PARTITION BY c.capture_id ORDER BY n_packets DESC, host) + 1 AS host_rank FROM c JOIN v USING (capture_id) WHERE host <> victim AND NOT regexp_matches(host, '\\.(0|255)$'))
    SELECT c.capture_id, host, n_packets, CAST(1 AS BIGINT) AS host_rank FROM c JOIN v ON c.capture_id = v.capture_id AND host = victim UNION ALL SELECT capture_id, host, n_packets, host_rank FROM p WHERE host_rank <= 13""",
    "packets_v",
)
def rank_hosts(spark, sf_dir):
    r = flows.rank_hosts(fixtures.view(spark, sf_dir, "packets_v"))
    return r.withColumn("host_rank", F.col("host_rank").cast("long"))


# --- window states -----------------------------------------------------------------------------

_SHARE = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
_DNS = f"(dst_port IN {_in(schema.DNS_PORTS)} OR src_port IN {_in(schema.DNS_PORTS)})"
_SIZE = "sum(fwd_bytes + bwd_bytes)"
_OUT = "sum(CASE WHEN src_in AND NOT dst_in THEN fwd_bytes WHEN NOT src_in AND dst_in THEN bwd_bytes ELSE 0 END)"
_QUERY = f"coalesce(avg(fwd_bytes) FILTER ({_DNS}), 0)"


def _volume(rst: str) -> dict[str, str]:
    return {
        "n_flows": "CAST(count(*) AS DOUBLE)", "total_bytes": f"CAST({_SIZE} AS DOUBLE)",
        "log_n_flows": "ln(1 + count(*))", "log_n_packets": "ln(1 + sum(total_packets))", "log_n_bytes": f"ln(1 + {_SIZE})",
        "log_bytes_per_s": f"ln(1 + {_SIZE} / 30)", "log_packets_per_s": "ln(1 + sum(total_packets) / 30)", "log_flows_per_s": "ln(1 + count(*) / 30)",
        "log_mean_flow_bytes": f"ln(1 + {_SIZE} / count(*))", "mean_flow_bytes": f"{_SIZE} / count(*)", "mean_flow_packets": "sum(total_packets) / count(*)",
        "tcp_share": _SHARE("protocol = 6"), "udp_share": _SHARE("protocol = 17"), "icmp_share": _SHARE("protocol = 1"),
        "internal_flow_share": _SHARE("src_in AND dst_in"), "external_flow_share": _SHARE("src_in AND NOT dst_in"), "inbound_flow_share": _SHARE("NOT src_in AND dst_in"),
        "outbound_bytes_ratio": f"{_OUT} / {_SIZE}",
        "auth_service_share": _SHARE(f"dst_port IN {_in(schema.AUTH_PORTS)}"), "admin_service_share": _SHARE(f"dst_port IN {_in(schema.ADMIN_PORTS)}"), "web_service_share": _SHARE(f"dst_port IN {_in(schema.WEB_PORTS)}"),
        "half_open_ratio": _SHARE("syn_count > 0 AND ack_count = 0"), "rst_share": f"avg({rst})", "dns_share": _SHARE(_DNS), "dns_query_size": _QUERY, "log_dns_query_size": f"ln(1 + {_QUERY})",
        "rst_injection_ratio": _SHARE("rst_count > 0 AND total_packets > 12"),
    }


_DIST = {f"{c}__{k}": f"{f}(CAST({c} AS DOUBLE))" for c in schema.AGGREGATED_FEATURES for f, k in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"))}
_BY = "GROUP BY capture_id, win"
_MEET = """tr AS (SELECT capture_id, win, src_ip, dst_ip, dst_port, count(*) n, sum(fwd_bytes + bwd_bytes) AS b, bool_or(src_in AND dst_in) AS inn FROM w GROUP BY ALL),
pr AS (SELECT capture_id, win, src_ip, dst_ip, count(*) AS ports, list_sort(list(dst_port)) AS l FROM tr GROUP BY ALL),
be AS (SELECT *, row_number() OVER (PARTITION BY capture_id, win ORDER BY ports DESC, src_ip, dst_ip) AS r FROM pr),
b1 AS (SELECT capture_id, win, ports AS max_ports_per_src_dst, CASE WHEN ports < 3 THEN 0.0 ELSE len(list_filter(range(1, ports), lambda i: l[i + 1] - l[i] = 1)) / (ports - 1) END AS sequential_port_ratio FROM be WHERE r = 1),
fn AS (SELECT capture_id, win, max(n) AS same_port_fanout FROM (SELECT capture_id, win, src_ip, dst_port, count(*) n FROM tr GROUP BY ALL) GROUP BY 1, 2),
co AS (SELECT capture_id, win, max(n) AS max_srcs_per_dst_service FROM (SELECT capture_id, win, dst_ip, dst_port, count(*) n FROM tr GROUP BY ALL) GROUP BY 1, 2),
ip AS (SELECT capture_id, win, max(n) AS distinct_internal_dsts FROM (SELECT capture_id, win, src_ip, count(DISTINCT CASE WHEN inn THEN dst_ip END) n FROM tr GROUP BY ALL) GROUP BY 1, 2),
dg AS (SELECT capture_id, win, avg(n) AS graph_mean_degree, max(n) AS graph_max_degree FROM (SELECT capture_id, win, host, count(*) n FROM (SELECT capture_id, win, unnest([src_ip, dst_ip]) AS host FROM w) GROUP BY ALL) GROUP BY 1, 2),
tt AS (SELECT capture_id, win, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS ttl_inconsistency FROM (SELECT capture_id, win, src_ip, count(DISTINCT round_even(fwd_ttl_mean, 0)) n FROM w GROUP BY ALL) GROUP BY 1, 2),
sv AS (SELECT capture_id, win, max(n) AS max_flows_per_src_dst_port FROM tr GROUP BY 1, 2),
di AS (SELECT capture_id, win, count(DISTINCT src_ip) AS distinct_src, count(DISTINCT dst_ip) AS distinct_dst, count(DISTINCT dst_port) AS distinct_dst_ports, count(DISTINCT src_port) AS distinct_src_ports FROM w GROUP BY 1, 2),
ts AS (SELECT capture_id, win, max(n) / sum(n) AS top1_src_flow_share, max(b) / sum(b) AS top1_src_byte_share FROM (SELECT capture_id, win, src_ip, count(*) n, sum(fwd_bytes + bwd_bytes) b FROM w GROUP BY ALL) GROUP BY 1, 2),
td AS (SELECT capture_id, win, max(n) / sum(n) AS top1_dst_flow_share FROM (SELECT capture_id, win, dst_ip, count(*) n FROM w GROUP BY ALL) GROUP BY 1, 2)"""
_NEW = """a1 AS (SELECT DISTINCT capture_id, win, dst_ip FROM w), a2 AS (SELECT *, min(win) OVER (PARTITION BY capture_id, dst_ip) = win AS f FROM a1), a3 AS (SELECT capture_id, win, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS new_dst_ratio FROM a2 GROUP BY 1, 2),
p1 AS (SELECT DISTINCT capture_id, win, dst_port FROM w), p2 AS (SELECT *, min(win) OVER (PARTITION BY capture_id, dst_port) = win AS f FROM p1), p3 AS (SELECT capture_id, win, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS new_dst_port_ratio FROM p2 GROUP BY 1, 2)"""
_BEACON = """hh AS (SELECT w.* EXCLUDE (win), unnest(range(CAST(floor((start_us - t0) / 30000000) AS BIGINT), least(CAST(floor((start_us - t0 + 600000000) / 30000000) AS BIGINT), n_windows))) AS win FROM w),
gg AS (SELECT *, (start_us - lag(start_us) OVER (PARTITION BY capture_id, win, src_ip, dst_ip, dst_port ORDER BY start_us, flow_no)) / 1e6 AS gap FROM hh),
pp AS (SELECT capture_id, win, src_ip, dst_ip, dst_port, count(*) AS n, max(start_us) - min(start_us) AS span, count(gap) FILTER (gap > 0) AS gaps, avg(gap) FILTER (gap > 0) AS m, stddev_pop(gap) FILTER (gap > 0) AS s, min((start_us, flow_no)) AS f FROM gg GROUP BY ALL),
bb AS (SELECT *, round(1 / (1 + s / m), 9) AS reg FROM pp WHERE n >= 4 AND span >= 10000000 AND gaps >= 3 AND m >= 1), rr AS (SELECT *, row_number() OVER (PARTITION BY capture_id, win ORDER BY reg DESC, f) AS k FROM bb),
bc AS (SELECT capture_id, win, reg AS beacon_regularity, n AS beacon_flow_count FROM rr WHERE k = 1),
ex AS (SELECT capture_id, win, count(*) FILTER (n >= 3) AS repeat_external_dst_count FROM (SELECT capture_id, win, dst_ip, count(*) n FROM hh WHERE src_in AND NOT dst_in GROUP BY ALL) GROUP BY 1, 2)"""


def states_sql(flows_table: str) -> str:
    """CTEs up to st: capture_id, win and, by their names, all state and summary features of every window."""
    volume = ", ".join(f"{x} AS {c}" for c, x in (_volume("rst_ratio") | _DIST).items())
    found = {c: t for t, cs in {"vo": [*_volume(""), *_DIST], "b1": ["max_ports_per_src_dst", "sequential_port_ratio"], "fn": ["same_port_fanout"], "co": ["max_srcs_per_dst_service"], "ip": ["distinct_internal_dsts"], "dg": ["graph_mean_degree", "graph_max_degree"], "tt": ["ttl_inconsistency"], "sv": ["max_flows_per_src_dst_port"], "di": ["distinct_src", "distinct_dst", "distinct_dst_ports", "distinct_src_ports"], "ts": ["top1_src_flow_share", "top1_src_byte_share"], "td": ["top1_dst_flow_share"], "a3": ["new_dst_ratio"], "p3": ["new_dst_port_ratio"], "bc": ["beacon_regularity", "beacon_flow_count"], "ex": ["repeat_external_dst_count"]}.items() for c in cs}
    plain = {"mean_payload_zero_ratio": "payload_zero_ratio__mean", "mean_retransmission_ratio": "retransmission_ratio__mean", "mean_payload_mean": "payload_mean__mean"}

    def value(c: str) -> str:
        c = plain.get(c, c)
        got = f"{found[c]}.{c}" if c in found else f"ln(1 + {found[c[4:]]}.{c[4:]})"
        return f"CASE WHEN vo.n_flows IS NULL THEN 0.0 ELSE coalesce(CAST({got} AS DOUBLE), 0.0) END"

    columns = ", ".join(f"{value(c)} AS {c}" for c in dict.fromkeys((*schema.STATE_FEATURES, *schema.SUMMARY_FEATURES)))
    joins = " ".join(f"LEFT JOIN {t} ON {t}.capture_id = sp.capture_id AND {t}.win = sp.win" for t in dict.fromkeys(found.values()))
    return windows_sql(flows_table).rstrip().removeprefix("WITH ") + f", vo AS (SELECT capture_id, win, {volume} FROM w {_BY}), {_MEET}, {_NEW}, {_BEACON}, sp AS (SELECT capture_id, unnest(range(n_windows)) AS win FROM t), st AS (SELECT sp.capture_id, sp.win, {columns} FROM sp {joins})"


STATES = f"{FLOWS}, {states_sql('flows_a')}"
_KEYS = 'capture_id, win AS "window"'


def states_of_packets(spark, sf_dir):
    return windows.build_states(flows_of_packets(spark, sf_dir))


@query(STATES + f" SELECT {_KEYS}, {', '.join(f'''{STEADY(f'ln(1 + {c})' if '__' in c else c)} AS {c}''' for c in schema.STATE_FEATURES)} FROM st", "packets_v")
def build_states(spark, sf_dir):
    s = states_of_packets(spark, sf_dir)
    return steady(s.select(*windows.KEY, *(F.log1p(c).alias(c) if "__" in c else F.col(c) for c in schema.STATE_FEATURES)))


@query(STATES + f" SELECT {_KEYS}, {', '.join(f'{STEADY(c)} AS {c}' for c in schema.SUMMARY_FEATURES)} FROM st", "packets_v")
def window_summary(spark, sf_dir):
    return steady(windows.window_summary(states_of_packets(spark, sf_dir)))


@query(STATES + f" SELECT {_KEYS}, {', '.join(f'{STEADY(c)} AS {c}' for c in windows.feature_levels()['packet'] if '__' not in c)}, {', '.join(f'{STEADY(f"ln(1 + {c})")} AS {c}' for c in windows.feature_levels()['packet'] if '__' in c)} FROM st", "packets_v")
def select_features(spark, sf_dir):
    s = windows.select_features(states_of_packets(spark, sf_dir), "packet")
    return steady(s.select(*windows.KEY, *(F.log1p(c).alias(c) if "__" in c else F.col(c) for c in s.columns[2:])))


@query(W.rstrip() + f" SELECT {_KEYS}, {', '.join(f'{STEADY(x)} AS {c}' for c, x in _volume('rst_count / total_packets').items())} FROM w {_BY}", "flows_v")
def state_volume(spark, sf_dir):
    v = windows.state_volume(_w(spark, sf_dir)).drop("n_packets")
    return steady(v.withColumns({c: F.col(c).cast("double") for c in ("n_flows", "total_bytes")}))


_COUNTS = ("distinct_src", "distinct_dst", "distinct_dst_ports", "distinct_src_ports")
_TOPS = ("top1_src_flow_share", "top1_src_byte_share", "top1_dst_flow_share")


@query(W.rstrip() + f", {_MEET} SELECT {_KEYS}, {', '.join(_COUNTS)}, {', '.join(f'{STEADY(f"ln(1 + {c})")} AS log_{c}' for c in _COUNTS)}, {', '.join(f'{STEADY(c)} AS {c}' for c in _TOPS)} FROM di JOIN ts USING (capture_id, win) JOIN td USING (capture_id, win)", "flows_v")
def state_diversity(spark, sf_dir):
    return steady(windows.state_diversity(_w(spark, sf_dir)))


@query(FLOWS + ", " + windows_sql("flows_a").rstrip().removeprefix("WITH ") + f" SELECT {_KEYS}, {', '.join(f'{STEADY(f"ln(1 + {x})")} AS {c}' for c, x in _DIST.items())} FROM w {_BY}", "packets_v")
def state_distribution(spark, sf_dir):
    d = windows.state_distribution(windows.assign_windows(flows_of_packets(spark, sf_dir)))
    return steady(d.select(*windows.KEY, *(F.log1p(c).alias(c) for c in d.columns[2:])))


_LOGGED = ("max_flows_per_src_dst_port", "same_port_fanout", "max_srcs_per_dst_service")


@query(
    W.rstrip() + f""", {_MEET} SELECT {_KEYS}, max_ports_per_src_dst, {STEADY('sequential_port_ratio')} AS sequential_port_ratio, {', '.join(_LOGGED)}, distinct_internal_dsts, {STEADY('graph_mean_degree')} AS graph_mean_degree, CAST(graph_max_degree AS BIGINT) AS graph_max_degree, {STEADY('ttl_inconsistency')} AS ttl_inconsistency, {', '.join(f'{STEADY(f"ln(1 + {c})")} AS log_{c}' for c in _LOGGED)}
    FROM b1 JOIN fn USING (capture_id, win) JOIN co USING (capture_id, win) JOIN ip USING (capture_id, win) JOIN dg USING (capture_id, win) JOIN tt USING (capture_id, win) JOIN sv USING (capture_id, win)""",
    "flows_v",
)
def detect_sweeps(spark, sf_dir):
    return steady(windows.detect_sweeps(_w(spark, sf_dir)))


@query(W.rstrip() + f", {_NEW} SELECT {_KEYS}, {STEADY('new_dst_ratio')} AS new_dst_ratio, {STEADY('new_dst_port_ratio')} AS new_dst_port_ratio FROM a3 JOIN p3 USING (capture_id, win)", "flows_v")
def detect_new_peers(spark, sf_dir):
    return steady(windows.detect_new_peers(_w(spark, sf_dir)))


@query(W.rstrip() + f", {_BEACON} SELECT {_KEYS}, {STEADY('beacon_regularity')} AS beacon_regularity, beacon_flow_count, {STEADY('ln(1 + coalesce(beacon_flow_count, 0))')} AS log_beacon_flow_count, repeat_external_dst_count FROM bc FULL JOIN ex USING (capture_id, win)", "flows_v")
def detect_beacons(spark, sf_dir):
    return steady(windows.detect_beacons(_w(spark, sf_dir)))


@query(W.rstrip() + f" SELECT {_KEYS}, flow_no FROM (SELECT capture_id, flow_no, unnest(range(CAST(floor((start_us - t0) / 30000000) AS BIGINT), least(CAST(floor((start_us - t0 + 600000000) / 30000000) AS BIGINT), n_windows))) AS win FROM w)", "flows_v")
def history_expand(spark, sf_dir):
    return windows.history_expand(_w(spark, sf_dir)).select("capture_id", "window", "flow_no")


# --- rules and verdicts ------------------------------------------------------------------------


def _support(feature: str, op: str, limit: float) -> str:
    up = f"({feature} - {limit!r}::DOUBLE * 0.82::DOUBLE) / ({limit!r}::DOUBLE * 0.36::DOUBLE)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {up if op == '>' else f'1.0::DOUBLE - {up}'}))"


def _score(stage: str, known: tuple) -> str:
    """A stage's score over the features known by name."""
    rules = [r for r in schema.RULES if r[0] == stage]
    got = " + ".join(f"{w!r}::DOUBLE * {_support(f, op, limit)}" for _, f, op, limit, w in rules if f in known) or "0.0::DOUBLE"
    return f"({got}) / {sum(r[4] for r in rules)!r}::DOUBLE"


def _fired(stage: str, known: tuple) -> str:
    texts = [f"CASE WHEN {f} {op} {limit!r}::DOUBLE THEN '{t}' END" for (s, f, op, limit, _), t in zip(schema.RULES, schema.RULE_TEXTS) if s == stage and f in known]
    return f"list_filter([{', '.join(texts)}], lambda x: x IS NOT NULL)" if texts else "CAST([] AS VARCHAR[])"


@query(STATES + " " + " UNION ALL ".join(f"SELECT {_KEYS}, '{s}' AS stage, {STEADY(_score(s, schema.SUMMARY_FEATURES))} AS score FROM st" for s in labels.RULE_STAGES), "packets_v")
def score_stages(spark, sf_dir):
    return steady(labels.score_stages(windows.window_summary(states_of_packets(spark, sf_dir))))


@query(STATES + ", fi AS (" + " UNION ALL ".join(f"SELECT {_KEYS}, '{s}' AS stage, {_fired(s, schema.SUMMARY_FEATURES)} AS r FROM st" for s in labels.RULE_STAGES) + ") SELECT capture_id, \"window\", stage, array_to_string(r, '; ') AS rules FROM fi WHERE len(r) > 0", "packets_v")
def explain_rules(spark, sf_dir):
    return labels.explain_rules(windows.window_summary(states_of_packets(spark, sf_dir))).withColumn("rules", F.array_join("rules", "; "))


_STAGE_AT = f"({list(schema.STAGES)!r})[CAST((win * 5 + capture_id) % 7 AS INTEGER) + 1]"


def _forecasts(states):
    """Stand-in forecasts over the windows that there are: what a model says is no concern of the verdicts."""
    stage = F.element_at(F.array(*map(F.lit, schema.STAGES)), ((F.col("window") * 5 + F.col("capture_id")) % 7 + 1).cast("int"))
    return states.select("capture_id", "window", (F.col("window") * 37 % 101 / 100).alias("probability"), stage.alias("stage"))


def _verdict_sql(known: tuple) -> str:
    """CTEs from st to vd: verdicts of the stand-in forecasts."""
    names = labels.RULE_STAGES
    scores = "[" + ", ".join(_score(s, known) for s in names) + "]"
    fired = "[" + ", ".join(_fired(s, known) for s in names) + "]"
    stages = "[" + ", ".join(f"'{s}'" for s in names) + "]"
    return f"""fc AS (SELECT *, win * 37 % 101 / 100 AS p, {_STAGE_AT} AS fs, {scores} AS sc, {fired} AS fr FROM st),
    ev AS (SELECT *, list_max(sc) AS best, list_position(sc, list_max(sc)) AS bi, list_position({stages}, fs) AS fi FROM fc),
    ew AS (SELECT *, coalesce(sc[fi], 0.0::DOUBLE) AS e, {stages}[bi] AS os, fs = 'Benign' AS benign FROM ev),
    vd AS (SELECT capture_id, win, fs AS forecast_stage, p AS probability, round(e, 4) AS observed_score, os AS observed_stage, round(best, 4) AS observed_best_score, NOT benign AND e >= 0.35 AS corroborated,
      CASE WHEN benign THEN CASE WHEN best >= 0.35 THEN 'WATCH' ELSE 'CLEAR' END WHEN e >= 0.35 AND p >= 0.7::DOUBLE - 0.15::DOUBLE * least(1.0, e / 0.35::DOUBLE) THEN 'CONFIRMED' WHEN p >= 0.7 THEN 'PREDICTED' WHEN p >= 0.4 OR best >= 0.35 THEN 'WATCH' ELSE 'CLEAR' END AS level,
      round(CASE WHEN benign THEN p * 0.55::DOUBLE WHEN e >= 0.35 THEN p ELSE p * (0.55::DOUBLE + 0.45::DOUBLE * greatest(0.0, least(1.0, (e - 0.18::DOUBLE) / 0.17::DOUBLE))) END, 4) AS risk,
      CASE WHEN e > 0 AND len(fr[fi]) > 0 THEN fr[fi][1:4] WHEN best > 0 THEN fr[bi][1:4] ELSE CAST([] AS VARCHAR[]) END AS reasons FROM ew)"""


_VERDICT = "forecast_stage, round(probability, 6) AS probability, observed_score, observed_stage, observed_best_score, corroborated, level, risk, array_to_string(reasons, '; ') AS reasons"


def _shown(v):
    return v.withColumns({"reasons": F.array_join("reasons", "; "), "probability": F.round("probability", 6)})


@query(f"{STATES}, {_verdict_sql(schema.SUMMARY_FEATURES)} SELECT {_KEYS}, {_VERDICT} FROM vd", "packets_v")
def window_verdicts(spark, sf_dir):
    s = materialised(states_of_packets(spark, sf_dir), "states")
    return _shown(labels.verdicts(_forecasts(s), windows.window_summary(s)))


@query(f"{STATES}, {_verdict_sql(schema.STATE_FEATURES)} SELECT {_KEYS}, {_VERDICT}, level = 'CONFIRMED' AS alert FROM vd", "packets_v")
def score_timeline(spark, sf_dir):
    s = materialised(states_of_packets(spark, sf_dir), "states")
    return _shown(labels.score_timeline(_forecasts(s), s))


@query(
    f"""{STATES}, {_verdict_sql(schema.SUMMARY_FEATURES)}, hd AS (SELECT capture_id, max(risk) AS peak, arg_max(win, (risk, -win)) AS peak_window, max(probability) AS raw, arg_max((forecast_stage, win, risk, observed_score), (risk, -win)) FILTER (level = 'CONFIRMED') AS c, arg_max((forecast_stage, win, risk, observed_score), (risk, -win)) FILTER (level = 'PREDICTED') AS p FROM vd GROUP BY 1)
    SELECT capture_id, CASE WHEN capture_id = 3 THEN concat('VERDICT WITHHELD -- traffic outside the model''s training distribution (peak raw probability ', printf('%.2f', raw), ', not trustworthy here)')
    WHEN c IS NOT NULL THEN concat('CONFIRMED ', c[1], ' in window ', c[2], ' at ', printf('%.2f', c[3]), ' (corroborated by ', printf('%.2f', c[4]), ' rule evidence)', CASE WHEN p IS NOT NULL THEN concat('; model forecasts ', p[1], ' next (not yet corroborated)') ELSE '' END)
    WHEN p IS NOT NULL THEN concat('PREDICTED ', p[1], ' at ', printf('%.2f', p[3]), ' -- forecast only, no corroborating evidence in the capture yet') ELSE concat('no confirmed intrusion; peak credible risk ', printf('%.2f', peak)) END AS headline, peak_window AS "window", round(peak, 4) AS peak_risk, round(raw, 6) AS raw_peak_probability FROM hd""",
    "packets_v",
)
def headline(spark, sf_dir):
    s = materialised(states_of_packets(spark, sf_dir), "states")
    v = materialised(labels.verdicts(_forecasts(s), windows.window_summary(s)), "verdicts")
    novelty = s.select("capture_id").distinct().withColumn("verdict", F.when(F.col("capture_id") == 3, "outside").otherwise("inside"))
    return labels.headline(v, novelty).join(labels.peaks(v), "capture_id").withColumn("raw_peak_probability", F.round("raw_peak_probability", 6))


@query(
    f"""{STATES}, pk AS (SELECT capture_id, arg_max(win, (n_flows, -win)) AS win FROM st GROUP BY 1), ps AS (SELECT st.* FROM st JOIN pk USING (capture_id, win)),
    al AS ({' UNION ALL '.join(f"SELECT capture_id, win, {k} AS k, '{s}' AS stage, {_score(s, schema.SUMMARY_FEATURES)} AS score FROM ps" for k, s in enumerate(labels.RULE_STAGES))}),
    ra AS (SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, k) AS INTEGER) AS place FROM al) SELECT {_KEYS}, place, stage, {STEADY('score')} AS score FROM ra WHERE place <= 3""",
    "packets_v",
)
def rule_agreement(spark, sf_dir):
    s = materialised(states_of_packets(spark, sf_dir), "states")
    peak = labels.peak_window(s.select("capture_id", "window", F.col("n_flows").alias("score")))
    return steady(labels.rule_agreement(s, peak))


@query(
    f"""{FLOWS}, {windows_sql('flows_a').rstrip().removeprefix('WITH ')}, cw AS (SELECT capture_id, win, count(*) AS n FROM w GROUP BY 1, 2), pk AS (SELECT capture_id, arg_max(win, (n, -win)) AS win FROM cw GROUP BY 1),
    ff AS (SELECT w.*, round(2.0::DOUBLE * syn_ratio + 1.5::DOUBLE * rst_ratio + payload_zero_ratio + ln(1 + total_bytes) / 20.0::DOUBLE + retransmission_ratio, 9) AS score FROM w JOIN pk USING (capture_id, win)),
    fl AS (SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, flow_no) AS INTEGER) AS place FROM ff)
    SELECT {_KEYS}, flow_no, flow_id, place, coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {n.lower()}_count > 0 THEN '{n}' END" for _, n in schema.TCP_FLAGS)}), ''), '-') AS flags, {STEADY('score')} AS score FROM fl WHERE place <= 25""",
    "packets_v",
)
def flagged_flows(spark, sf_dir):
    w = materialised(windows.assign_windows(flows_of_packets(spark, sf_dir)), "windows")
    peaks = labels.peak_window(w.groupBy("capture_id", "window").agg(F.count("*").alias("score")))
    flags = studies.flag_summary({n: F.col(f"{n.lower()}_count") for _, n in schema.TCP_FLAGS})
    return steady(studies.flagged_flows(w, peaks).select("capture_id", "window", "flow_no", "flow_id", "place", flags.alias("flags"), "score"))
