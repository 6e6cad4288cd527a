"""Views that turn the events tables into packets, flows, a timeline and scores, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TS = ("CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 600) AS BIGINT)", "CAST(floor((epoch_us(ts) - 1704067200000000) / 600) AS BIGINT)")
_K = ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
_H = ("CAST(conv(substr(md5(CAST(event_id AS STRING)), 1, 8), 16, 10) AS BIGINT)", "CAST('0x' || substr(md5(CAST(event_id AS STRING)), 1, 8) AS BIGINT)")

PACKETS = """
WITH b AS (SELECT event_id, {ts} AS ts_us, user_id, event_type, {k} AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
h AS (SELECT *, user_id % 12 AS hi, k % 16 AS ho, (event_id % 3 = 0) AS rev FROM b),
q AS (SELECT *, concat('10.20.', CAST(hi % 4 AS STRING), '.', CAST(hi + 10 AS STRING)) AS src,
  CASE WHEN ho % 4 = 0 THEN concat('10.20.', CAST((ho + 1) % 4 AS STRING), '.', CAST(ho + 30 AS STRING)) ELSE concat('93.184.', CAST(ho AS STRING), '.7') END AS dst,
  49152 + hi AS sp,
  CASE ho % 8 WHEN 0 THEN 445 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 80 WHEN 5 THEN 3389 WHEN 6 THEN 8443 ELSE 0 END AS dp,
  CASE WHEN event_type IN ('click', 'purchase') THEN cents % 1461 ELSE 0 END AS pl FROM h)
SELECT user_id % 4 AS capture_id, event_id AS packet_no, ts_us,
  CASE WHEN rev THEN dst ELSE src END AS src_ip, CASE WHEN rev THEN src ELSE dst END AS dst_ip,
  CASE WHEN rev THEN dp ELSE sp END AS src_port, CASE WHEN rev THEN sp ELSE dp END AS dst_port,
  CASE WHEN dp = 53 THEN 17 WHEN dp = 0 THEN 1 ELSE 6 END AS protocol,
  CASE WHEN event_id % 43 = 0 THEN 128 ELSE 64 - CASE WHEN rev THEN 3 ELSE 0 END END AS ip_ttl,
  event_id % 65536 AS ip_id, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 2 END AS ip_flags,
  CASE WHEN event_id % 31 = 0 THEN 185 ELSE 0 END AS frag_offset, 40 + pl AS ip_len, 20 AS ihl,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 WHEN 'click' THEN 24 WHEN 'error' THEN 20 ELSE 17 END AS tcp_flags,
  (event_id * 7919) % 65536 AS tcp_window, (event_id % 7) * 100 AS tcp_seq, (event_id % 5) * 50 AS tcp_ack,
  20 AS tcp_doff, pl AS payload_len, 54 + pl AS frame_len FROM q"""

FLOWS = """
WITH b AS (SELECT *, {ts} AS start_us, {k} AS k FROM events)
SELECT user_id % 4 AS capture_id, event_id AS flow_no, start_us,
  concat('10.20.', CAST((user_id % 12) % 4 AS STRING), '.', CAST((user_id % 12) + 10 AS STRING)) AS src_ip,
  CASE WHEN k % 4 = 0 THEN concat('10.20.', CAST((k % 16 + 1) % 4 AS STRING), '.', CAST(k % 16 + 30 AS STRING)) ELSE concat('93.184.', CAST(k % 16 AS STRING), '.7') END AS dst_ip,
  49152 + event_id % 97 AS src_port,
  CASE k % 8 WHEN 0 THEN 445 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 80 WHEN 5 THEN 3389 WHEN 6 THEN 1000 + event_id % 40 ELSE 0 END AS dst_port,
  CASE k % 8 WHEN 2 THEN 17 WHEN 7 THEN 1 ELSE 6 END AS protocol,
  CAST(round(value * 100) AS BIGINT) % 5000 + 40 AS fwd_bytes, event_id * 31 % 4000 AS bwd_bytes,
  event_id % 19 + 1 AS total_packets, event_id % 3 AS syn_count,
  CASE WHEN event_type = 'signup' THEN 0 ELSE event_id % 5 END AS ack_count,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rst_count,
  CASE WHEN event_id % 41 = 0 THEN 128 ELSE 64 END AS fwd_ttl_mean,
  CASE event_id % 12 WHEN 0 THEN 'SSH-Bruteforce' WHEN 1 THEN 'PortScan' WHEN 2 THEN 'Bot' WHEN 3 THEN 'DDOS attack-HOIC' WHEN 4 THEN 'dnscat2' WHEN 5 THEN 'Conficker worm' WHEN 6 THEN 'some-new-attack' ELSE ' BENIGN ' END AS label
FROM b"""

TIMELINE = """
SELECT CAST(n_nationkey % 4 AS BIGINT) AS capture_id, CAST(n_nationkey AS BIGINT) * 160000000 AS start_us,
  CAST(n_nationkey AS BIGINT) * 160000000 + CAST(n_nationkey * 37 % 11 + 1 AS BIGINT) * 15000000 AS end_us,
  CASE n_nationkey % 6 WHEN 0 THEN 'Reconnaissance' WHEN 1 THEN 'InitialAccess' WHEN 2 THEN 'LateralMovement' WHEN 3 THEN 'CommandAndControl' WHEN 4 THEN 'Exfiltration' ELSE 'Impact' END AS stage
FROM nation"""

SCORES = """
SELECT user_id % 10 AS capture_id, event_id AS t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  ({h} % 1000 + CASE WHEN event_type = 'error' THEN 300 ELSE 0 END) AS score_milli, user_id % 7 AS stage_true, {k} % 7 AS stage_pred
FROM events"""

VIEWS = {"packets_v": PACKETS, "flows_v": FLOWS, "timeline_v": TIMELINE, "scores_v": SCORES}


def _text(name: str, dialect: int) -> str:
    return VIEWS[name].format(ts=_TS[dialect], k=_K[dialect], h=_H[dialect])


def _table(name: str) -> str:
    return "nation" if name == "timeline_v" else "events"


def over(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """The view over given rows of its table, which may be a stream."""
    return spark.sql(_text(name, 0).replace(f"FROM {_table(name)}", "FROM {source}"), source=rows)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return over(spark, name, spark.read.parquet(f"{sf_dir}/{_table(name)}.parquet"))


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views (and any further CTEs at its start) in front."""
    if not names:
        return sql.strip()
    views = ", ".join(f"{n} AS ({_text(n, 1)})" for n in names)
    return f"WITH RECURSIVE {views}, {sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH {views} {sql}"
