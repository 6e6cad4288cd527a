"""Packets to bidirectional flows.

Idle gaps always end a flow, so idle islands come from window functions. Only islands that outlast
the active timeout, or TCP islands with RST or FIN, can be cut further; these alone are folded, in
time order, as a stream that keeps the state of one episode and returns the packets that start one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import flow_id, ip_to_int, is_internal, safe_div
from ..schema import ACTIVE_US, IDLE_US, TCP, TCP_FLAGS, WELL_KNOWN_PORTS
from ..sources.shared import materialised

CONVERSATION = ["capture_id", "ip_a", "port_a", "ip_b", "port_b", "protocol"]


def canonical_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free endpoints (ip_a, port_a) <= (ip_b, port_b); an unreadable address or port counts as -1.

    Addresses are parsed in a step of their own, and the keys are never null, so that neither a
    projection nor a join's null filter repeats the parsing.
    """
    known = lambda c: F.coalesce(c, F.lit(-1))
    end = lambda side: F.struct(known(ip_to_int(F.col(f"{side}_ip"))).alias("ip"), known(F.col(f"{side}_port")).alias("port"))
    ends = packets.withColumns({"_src": end("src"), "_dst": end("dst")})
    ends = ends.withColumns({"_low": F.least("_src", "_dst"), "_high": F.greatest("_src", "_dst")})
    fields = {f"{f}_{side}": F.col(f"{c}.{f}") for side, c in (("a", "_low"), ("b", "_high")) for f in ("ip", "port")}
    return ends.withColumns(fields).drop("_src", "_dst", "_low", "_high")


def _conversation() -> Window:
    return Window.partitionBy(*CONVERSATION).orderBy("ts_us", "packet_no")


def flow_direction(packets: DataFrame) -> DataFrame:
    """Add fwd: same sender as the conversation's first packet."""
    first = F.first(F.struct("src_ip", "src_port")).over(_conversation())
    return packets.withColumn("fwd", F.struct("src_ip", "src_port") == first)


def split_idle(packets: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Add island: counts gaps longer than the timeout so far in the conversation."""
    gap = F.col("ts_us") - F.lag("ts_us").over(_conversation())
    return packets.withColumn("_cut", (F.coalesce(gap, F.lit(0)) > idle_us).cast("int")).withColumn("island", F.sum("_cut").over(_conversation())).drop("_cut")


def _cuts(active_us: int, close: bool):
    """The packets that start an episode after the first one of an island, from packets in the order of islands and time; what is kept is the state of one episode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, fin_fwd, fin_bwd, grace, closed = 0, False, False, False, False
        for b in batches:
            cuts = []
            for first, ts, flags, fwd, tcp in zip(*(b.column(c).to_pylist() for c in ("_first", "ts_us", "tcp_flags", "fwd", "_tcp"))):
                cut = not first and (closed or ts - start > active_us)
                if first or cut:
                    start, fin_fwd, fin_bwd, grace, closed = ts, False, False, False, False
                cuts.append(cut)
                rst = close and tcp and bool(flags & 4)
                fin = close and tcp and bool(flags & 1) and not rst
                fin_fwd, fin_bwd = fin_fwd or (fin and fwd), fin_bwd or (fin and not fwd)
                closed = closed or grace or rst  # the packet after the second FIN is admitted, and closes
                grace = grace or (fin and fin_fwd and fin_bwd)
            yield b.filter(pa.array(cuts, pa.bool_())).drop_columns(["_first", "ts_us", "tcp_flags", "fwd", "_tcp"])

    return run


def split_episodes(packets: DataFrame, active_us: int = ACTIVE_US, close_on_teardown: bool = True) -> DataFrame:
    """Add episode within each island: active-timeout and teardown cuts. Null flags count as 0."""
    island = [*CONVERSATION, "island"]
    tcp = F.col("protocol") == TCP
    whole = Window.partitionBy(*island)
    order = whole.orderBy("ts_us", "packet_no")
    needs = F.max("ts_us").over(whole) - F.min("ts_us").over(whole) > active_us
    if close_on_teardown:
        needs = needs | F.bool_or(tcp & (F.col("tcp_flags").bitwiseAND(5) != 0)).over(whole)
    rows = packets.select(*island, "packet_no", "ts_us", F.coalesce("tcp_flags", F.lit(0)).alias("tcp_flags"), "fwd", F.coalesce(tcp, F.lit(False)).alias("_tcp"), (F.row_number().over(order) == 1).alias("_first"), needs.alias("_needs"))
    rows = rows.filter("_needs").drop("_needs").sortWithinPartitions(*island, "ts_us", "packet_no")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*island, "packet_no").dtypes)
    cuts = rows.mapInArrow(_cuts(active_us, close_on_teardown), schema).withColumn("_cut", F.lit(1))
    return packets.join(cuts, [*island, "packet_no"], "left").withColumn("episode", F.sum(F.coalesce("_cut", F.lit(0))).over(order)).drop("_cut")


def flow_features(packets: DataFrame, key: list[str]) -> DataFrame:
    """One row per ``key``: volume, timing, flags, endpoints and packet-level statistics of its packets."""
    order = Window.partitionBy(*key).orderBy("ts_us", "packet_no")
    way = Window.partitionBy(*key, "fwd").orderBy("ts_us", "packet_no")
    data = (F.col("payload_len") > 0) & (F.col("protocol") == TCP)
    bare = ~(F.col("payload_len") > 0) & (F.col("protocol") == TCP) & (F.col("tcp_flags").bitwiseAND(16) != 0)
    kind = F.when(data, 1).when(bare, 2).otherwise(0)
    within = Window.partitionBy(*key, "fwd", "_kind").orderBy("ts_us", "packet_no")
    again = Window.partitionBy(*key, "fwd", "_kind", "tcp_seq", "payload_len").orderBy("ts_us", "packet_no")
    p = packets.withColumn("_kind", kind).select(
        "*",
        (F.col("ts_us") - F.lag("ts_us").over(order)).alias("_gap"),
        (F.col("ts_us") - F.lag("ts_us").over(way)).alias("_way_gap"),
        (F.row_number().over(again) > 1).alias("_again"),
        F.max("tcp_seq").over(within.rowsBetween(Window.unboundedPreceding, -1)).alias("_highest"),
        F.lag("tcp_ack").over(within).alias("_last_ack"),
    )
    n = F.count("*")
    some = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    of = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    fwd, bwd = F.col("fwd"), ~F.col("fwd")
    first = lambda c: F.min_by(c, F.struct("ts_us", "packet_no")).alias(c)
    retrans = (F.col("_kind") == 1) & F.col("_again")
    stat4 = lambda c, name: [f(F.col(c)).alias(f"{name}_{k}") for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    iat = [(F.coalesce(f(F.when(cond, F.col(c))), F.lit(0)) / 1e6).alias(f"{pre}iat_{k}") for pre, cond, c in (("", F.lit(True), "_gap"), ("fwd_", fwd, "_way_gap"), ("bwd_", bwd, "_way_gap")) for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    out = p.groupBy(*key).agg(
        first("packet_no"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), first("src_ip"), first("dst_ip"), first("src_port"), first("dst_port"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("flow_duration"),
        some(fwd).alias("fwd_packets"), some(bwd).alias("bwd_packets"), n.alias("total_packets"),
        of(fwd, "ip_len").alias("fwd_bytes"), of(bwd, "ip_len").alias("bwd_bytes"), F.sum("ip_len").alias("total_bytes"),
        *iat,
        *(some(F.col("tcp_flags").bitwiseAND(bit) != 0).alias(f"{name.lower()}_count") for bit, name in TCP_FLAGS),
        *stat4("ip_ttl", "ttl"), F.size(F.collect_set("ip_ttl")).cast("long").alias("ttl_unique"), F.coalesce(F.avg(F.when(fwd, F.col("ip_ttl"))), F.avg("ip_ttl")).alias("fwd_ttl_mean"),
        *stat4("tcp_window", "window"), some(F.col("tcp_window") == 0).alias("window_zero_count"),
        *stat4("payload_len", "payload"), F.percentile("payload_len", F.array(F.lit(0.5), F.lit(0.9))).alias("_payload"),
        (some(F.col("payload_len") == 0) / n).alias("payload_zero_ratio"),
        F.avg("ihl").alias("header_len_mean"), F.avg("tcp_doff").alias("tcp_doff_mean"),
        some(retrans).alias("retransmission_count"), (some(retrans) / n).alias("retransmission_ratio"),
        some((F.col("_kind") == 1) & ~F.col("_again") & (F.col("tcp_seq") < F.col("_highest"))).alias("out_of_order_count"),
        some((F.col("_kind") == 2) & (F.col("tcp_ack") == F.col("_last_ack"))).alias("dup_ack_count"),
        some((F.col("ip_flags").bitwiseAND(1) != 0) | (F.col("frag_offset") > 0)).alias("frag_packet_count"),
        (some(F.col("ip_flags").bitwiseAND(2) != 0) / n).alias("df_ratio"), (some(F.col("ip_flags").bitwiseAND(1) != 0) / n).alias("mf_ratio"),
    )
    return derived_features(out.withColumns({"payload_p50": F.col("_payload")[0], "payload_p90": F.col("_payload")[1]}).drop("_payload").withColumnRenamed("packet_no", "flow_no"))


def derived_features(out: DataFrame) -> DataFrame:
    """Add the rates, ratios and the id that follow from a flow's sums."""
    span = F.greatest(F.col("flow_duration"), F.lit(1e-6))
    col = F.col
    return out.select(
        "*",
        (col("total_bytes") / span).alias("flow_bytes_per_s"), (col("total_packets") / span).alias("flow_packets_per_s"),
        (col("fwd_packets") / span).alias("fwd_packets_per_s"), (col("bwd_packets") / span).alias("bwd_packets_per_s"),
        safe_div(col("fwd_bytes"), col("total_bytes")).alias("bytes_ratio"), (col("fwd_packets") / col("total_packets")).alias("packets_ratio"),
        (col("total_bytes") / col("total_packets")).alias("mean_packet_size"),
        safe_div(col("fwd_bytes"), col("fwd_packets")).alias("fwd_mean_packet_size"), safe_div(col("bwd_bytes"), col("bwd_packets")).alias("bwd_mean_packet_size"),
        *((col(f"{k}_count") / col("total_packets")).alias(f"{k}_ratio") for k in ("syn", "rst", "ack", "psh")),
        col("dst_port").isin(*WELL_KNOWN_PORTS).cast("int").alias("is_wellknown_dst_port"),
        flow_id(col("src_ip"), col("src_port"), col("dst_ip"), col("dst_port"), col("protocol"), col("start_us")).alias("flow_id"),
    )


def packets_in_episodes(packets: DataFrame, idle_us: int = IDLE_US, active_us: int = ACTIVE_US, close_on_teardown: bool = True) -> DataFrame:
    """Packets with fwd, island and episode. They are written with their keys first: islands and their cuts both read them, and to make and parse them is dear."""
    keyed = materialised(canonical_key(packets.filter(F.col("ts_us").isNotNull())), "packets")
    return split_episodes(split_idle(flow_direction(keyed), idle_us), active_us, close_on_teardown)


def assemble_flows(packets: DataFrame, idle_us: int = IDLE_US, active_us: int = ACTIVE_US, close_on_teardown: bool = True) -> DataFrame:
    """One row per flow, numbered (flow_no) by its first packet; rows without a time, as of unreadable captures, are no packets; an empty packet table gives the same columns and no rows."""
    return flow_features(packets_in_episodes(packets, idle_us, active_us, close_on_teardown), [*CONVERSATION, "island", "episode"])


def rank_hosts(packets: DataFrame, peers: int = 12) -> DataFrame:
    """Private hosts by the packets that they take part in: rank 1 is the victim, then ``peers`` others that are no .0 or .255 address."""
    hosts = packets.select("capture_id", F.explode(F.array("src_ip", "dst_ip")).alias("host")).filter(is_internal(F.col("host")))
    counts = hosts.groupBy("capture_id", "host").agg(F.count("*").alias("n_packets"))
    order = Window.partitionBy("capture_id").orderBy(F.desc("n_packets"), "host")
    victims = counts.withColumn("host_rank", F.row_number().over(order)).filter("host_rank = 1")
    rest = counts.filter(~F.col("host").rlike(r"\.(0|255)$")).join(victims.select("capture_id", F.col("host").alias("_victim")), "capture_id").filter("host <> _victim").drop("_victim")
    return victims.unionByName(rest.withColumn("host_rank", F.row_number().over(order) + 1).filter(F.col("host_rank") <= peers + 1))
