"""Flows to fixed windows per capture: the spine, state features by grain, detectors and novelty of peers.

Every grouped feature first counts at its own grain (capture, window, key...), so a host or service
that floods a window is pre-aggregated before windows are put together. All that concerns who meets
whom is read off one table, a row per (capture, window, source, destination, port), by grouping sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_internal, safe_div
from ..schema import ADMIN_PORTS, AGGREGATED_FEATURES, AUTH_PORTS, DNS_PORTS, HISTORY_US, ICMP, PACKET_BASES, PACKET_DETECTORS, STATE_FEATURES, SUMMARY_FEATURES, TCP, UDP, WEB_PORTS, WINDOW_US
from ..sources.shared import materialised

KEY = ["capture_id", "window"]
FLOW_COLUMNS = ("capture_id", "flow_no", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "fwd_bytes", "bwd_bytes", "total_packets", "syn_count", "ack_count", "rst_count", "fwd_ttl_mean")


def bounds(flows: DataFrame, stride_us: int = WINDOW_US, t_end_us: int | None = None) -> DataFrame:
    """(capture_id, t0, n_windows); ``t_end_us`` draws the grid to that time instead of the last start."""
    span = flows.groupBy("capture_id").agg(F.min("start_us").alias("t0"), F.max("start_us").alias("t1"))
    end = F.col("t1") if t_end_us is None else F.greatest(F.col("t0"), F.lit(t_end_us))
    return span.select("capture_id", "t0", (F.floor((end - F.col("t0")) / stride_us) + 1).cast("long").alias("n_windows"))


def assign_windows(flows: DataFrame, stride_us: int = WINDOW_US, t_end_us: int | None = None) -> DataFrame:
    """Add window, by start time from the capture's first flow, and whether the ends are inside; flows past the grid's end count in its last window."""
    rows = flows.join(bounds(flows, stride_us, t_end_us), "capture_id")
    window = F.least(F.floor((F.col("start_us") - F.col("t0")) / stride_us), F.col("n_windows") - 1).cast("long")
    return rows.select("*", window.alias("window"), is_internal(F.col("src_ip")).alias("src_in"), is_internal(F.col("dst_ip")).alias("dst_in"))


def window_spine(flows: DataFrame, stride_us: int = WINDOW_US, t_end_us: int | None = None) -> DataFrame:
    return bounds(flows, stride_us, t_end_us).select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1)).alias("window"))


def _share(cond) -> F.Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def _ratio(w: DataFrame, name: str) -> F.Column:
    """A flow's flag ratio, where flows carry it, else its count over its packets."""
    return F.col(f"{name}_ratio") if f"{name}_ratio" in w.columns else safe_div(F.col(f"{name}_count"), F.col("total_packets"))


def _volume(w: DataFrame, window_us: int) -> list[F.Column]:
    n, size = F.count("*"), F.col("fwd_bytes") + F.col("bwd_bytes")
    inside, out, into = F.col("src_in") & F.col("dst_in"), F.col("src_in") & ~F.col("dst_in"), ~F.col("src_in") & F.col("dst_in")
    dns = F.col("dst_port").isin(*DNS_PORTS) | F.col("src_port").isin(*DNS_PORTS)
    span = window_us / 1e6
    port = F.col("dst_port")
    leaving = F.sum(F.when(out, F.col("fwd_bytes")).when(into, F.col("bwd_bytes")).otherwise(0))
    query = F.coalesce(F.avg(F.when(dns, F.col("fwd_bytes"))), F.lit(0.0))
    return [
        n.alias("n_flows"), F.sum(size).alias("total_bytes"), F.sum("total_packets").alias("n_packets"),
        F.log1p(n).alias("log_n_flows"), F.log1p(F.sum("total_packets")).alias("log_n_packets"), F.log1p(F.sum(size)).alias("log_n_bytes"),
        F.log1p(F.sum(size) / span).alias("log_bytes_per_s"), F.log1p(F.sum("total_packets") / span).alias("log_packets_per_s"), F.log1p(n / span).alias("log_flows_per_s"),
        F.log1p(F.sum(size) / n).alias("log_mean_flow_bytes"), (F.sum(size) / n).alias("mean_flow_bytes"), (F.sum("total_packets") / n).alias("mean_flow_packets"),
        _share(F.col("protocol") == TCP).alias("tcp_share"), _share(F.col("protocol") == UDP).alias("udp_share"), _share(F.col("protocol") == ICMP).alias("icmp_share"),
        _share(inside).alias("internal_flow_share"), _share(out).alias("external_flow_share"), _share(into).alias("inbound_flow_share"),
        safe_div(leaving, F.sum(size)).alias("outbound_bytes_ratio"),
        _share(port.isin(*AUTH_PORTS)).alias("auth_service_share"), _share(port.isin(*ADMIN_PORTS)).alias("admin_service_share"), _share(port.isin(*WEB_PORTS)).alias("web_service_share"),
        _share((F.col("syn_count") > 0) & (F.col("ack_count") == 0)).alias("half_open_ratio"), F.avg(_ratio(w, "rst")).alias("rst_share"),
        _share(dns).alias("dns_share"), query.alias("dns_query_size"), F.log1p(query).alias("log_dns_query_size"),
        _share((F.col("rst_count") > 0) & (F.col("total_packets") > 12)).alias("rst_injection_ratio"),
    ]


def state_volume(w: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Volume, protocol and direction mix, and the detectors that are shares of flows; rst_share is the mean share of a flow's packets with RST."""
    return w.groupBy(*KEY).agg(*_volume(w, window_us))


def _distribution(features: tuple[str, ...]) -> list[F.Column]:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return [F.coalesce(f(finite(F.col(c).cast("double"))), F.lit(0.0)).alias(f"{c}__{k}") for c in features for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.max, "max"))]


def state_distribution(w: DataFrame, features: tuple[str, ...] = AGGREGATED_FEATURES) -> DataFrame:
    """Mean, population deviation and maximum of per-flow features, finite values only."""
    return w.groupBy(*KEY).agg(*_distribution(features))


PAIR, FAN, SERVICE, SOURCE, TARGET, PORT = 1, 2, 4, 3, 5, 6


def _meetings(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per window, source, destination and port; their grouping sets, told apart by ``gid``)."""
    ends = ["src_ip", "dst_ip", "dst_port"]
    triples = w.groupBy(*KEY, *ends).agg(F.count("*").alias("n"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("b"), F.bool_or(F.col("src_in") & F.col("dst_in")).alias("inner"))
    sets = [[F.col(c) for c in (*KEY, *s)] for s in (ends, ends[:2], [ends[0], ends[2]], ends[1:], ends[:1], ends[1:2], ends[2:])]
    grouped = triples.groupingSets(sets, *(F.col(c) for c in (*KEY, *ends)))
    return triples, grouped.agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("b").alias("b"), F.bool_or("inner").alias("inner"), F.grouping_id().cast("int").alias("gid"))


def _hosts(sets: DataFrame) -> DataFrame:
    """Per window: busiest hosts, most internal peers of a source, and degrees of the multigraph of flows."""
    gid = F.col("gid")
    rows = sets.filter(gid.isin(PAIR, SOURCE, TARGET)).select(
        *KEY,
        F.when(gid == TARGET, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("host"),
        F.when(gid == PAIR, 0).otherwise(F.col("n")).alias("degree"),
        F.when(gid == SOURCE, F.col("n")).alias("sent"),
        F.when(gid == SOURCE, F.col("b")).alias("bytes"),
        F.when(gid == TARGET, F.col("n")).alias("got"),
        F.when((gid == PAIR) & F.col("inner"), 1).otherwise(0).alias("peers"),
    )
    hosts = rows.groupBy(*KEY, "host").agg(F.sum("degree").alias("degree"), F.max("sent").alias("sent"), F.max("bytes").alias("bytes"), F.max("got").alias("got"), F.sum("peers").alias("peers"))
    return hosts.groupBy(*KEY).agg(
        (F.max("sent") / F.sum("sent")).alias("top1_src_flow_share"), safe_div(F.max("bytes"), F.sum("bytes")).alias("top1_src_byte_share"), (F.max("got") / F.sum("got")).alias("top1_dst_flow_share"),
        F.max("peers").alias("distinct_internal_dsts"), F.avg("degree").alias("graph_mean_degree"), F.max("degree").alias("graph_max_degree"),
    )


def _fans(sets: DataFrame) -> DataFrame:
    """Per window: distinct ends and ports, fan-out, convergence, and the pair with most ports (the first of equals)."""
    of = lambda g, c: F.when(F.col("gid") == g, F.col(c))
    some = lambda g: F.count(F.when(F.col("gid") == g, 1))
    best = F.min(F.when(F.col("gid") == PAIR, F.struct((-F.col("c")).alias("ports"), "src_ip", "dst_ip")))
    rows = sets.groupBy(*KEY).agg(
        some(SOURCE).alias("distinct_src"), some(TARGET).alias("distinct_dst"), some(PORT).alias("distinct_dst_ports"),
        F.max(of(0, "most")).alias("max_flows_per_src_dst_port"), F.max(of(FAN, "c")).alias("same_port_fanout"), F.max(of(SERVICE, "c")).alias("max_srcs_per_dst_service"), best.alias("best"),
    )
    return rows.withColumn("max_ports_per_src_dst", -F.col("best.ports"))


def _sequential(triples: DataFrame, fans: DataFrame) -> DataFrame:
    """Share of the busiest pair's ports, in order, that follow the one before; only pairs with three ports or more."""
    best = fans.filter("max_ports_per_src_dst >= 3").select(*KEY, F.col("best.src_ip").alias("src_ip"), F.col("best.dst_ip").alias("dst_ip"))
    ports = triples.join(best, [*KEY, "src_ip", "dst_ip"]).select(*KEY, "dst_port")
    step = F.col("dst_port") - F.lag("dst_port").over(Window.partitionBy(*KEY).orderBy("dst_port"))
    return ports.withColumn("step", step).groupBy(*KEY).agg(F.avg((F.col("step") == 1).cast("double")).alias("sequential_port_ratio"))


def _new(sets: DataFrame) -> DataFrame:
    """Shares of the window's destinations and destination ports that the capture had not shown before."""
    first = F.min("window").over(Window.partitionBy("capture_id", "gid", "dst_ip", "dst_port"))
    seen = sets.filter(F.col("gid").isin(TARGET, PORT)).select(*KEY, "gid", (first == F.col("window")).cast("double").alias("new"))
    share = lambda g: F.avg(F.when(F.col("gid") == g, F.col("new")))
    return seen.groupBy(*KEY).agg(share(TARGET).alias("new_dst_ratio"), share(PORT).alias("new_dst_port_ratio"))


def _source_traits(w: DataFrame) -> DataFrame:
    """Per window: distinct source ports, and the share of sources that show more than one TTL."""
    trait = F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("src"), F.col("src_port").cast("double").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("src_ip").alias("src"), F.bround("fwd_ttl_mean").cast("double").alias("value")))
    rows = w.select(*KEY, F.explode(trait).alias("t")).select(*KEY, "t.*").distinct().groupBy(*KEY, "kind", "src").agg(F.count("*").alias("c"))
    return rows.groupBy(*KEY).agg(F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("distinct_src_ports"), F.avg(F.when(F.col("kind") == 1, (F.col("c") > 1).cast("double"))).alias("ttl_inconsistency"))


def state_diversity(w: DataFrame) -> DataFrame:
    """Distinct ends and ports per window, also as log1p, and the shares of the busiest hosts."""
    _, sets = _meetings(w)
    log = lambda c: F.log1p(c).alias(f"log_{c}")
    counts = ("distinct_src", "distinct_dst", "distinct_dst_ports", "distinct_src_ports")
    hosts = _hosts(sets).select(*KEY, "top1_src_flow_share", "top1_src_byte_share", "top1_dst_flow_share")
    return _fans(sets).join(_source_traits(w), KEY).join(hosts, KEY).select(*KEY, *counts, *map(log, counts), *hosts.columns[2:])


def detect_sweeps(w: DataFrame) -> DataFrame:
    """Ports per pair, flows per service, fan-out, convergence, internal peers, degrees and TTL mixing; counts also as log1p."""
    triples, sets = _meetings(w)
    fans = _fans(sets)
    rows = fans.drop("best").join(_hosts(sets), KEY).join(_source_traits(w), KEY).join(_sequential(triples, fans), KEY, "left").fillna(0.0, ["sequential_port_ratio"])
    logs = ("max_flows_per_src_dst_port", "same_port_fanout", "max_srcs_per_dst_service")
    plain = ("max_ports_per_src_dst", "sequential_port_ratio", *logs, "distinct_internal_dsts", "graph_mean_degree", "graph_max_degree", "ttl_inconsistency")
    return rows.select(*KEY, *plain, *(F.log1p(c).alias(f"log_{c}") for c in logs))


def detect_new_peers(w: DataFrame) -> DataFrame:
    return _new(_meetings(w)[1])


def lookback(stride_us: int = WINDOW_US, history_us: int = HISTORY_US) -> tuple[F.Column, F.Column]:
    """First and last window whose lookback holds a flow's start."""
    since = F.col("start_us") - F.col("t0")
    return F.floor(since / stride_us), F.least(F.floor((since + history_us) / stride_us) - 1, F.col("n_windows") - 1)


def history_expand(w: DataFrame, stride_us: int = WINDOW_US, history_us: int = HISTORY_US) -> DataFrame:
    """Each flow once in every window whose lookback holds its start."""
    low, high = lookback(stride_us, history_us)
    return w.filter(low <= high).drop("window").withColumn("window", F.explode(F.sequence(low, high)))


def detect_beacons(w: DataFrame, stride_us: int = WINDOW_US, history_us: int = HISTORY_US) -> DataFrame:
    """Regularity of the most regular contact over the lookback, its flows, and external hosts contacted again.

    A lookback holds a contact's flows in a row, so gaps are taken once, before anything is spread over
    windows. Flows with the same first and last window are summed up first, with the gaps between
    them; what meets other flows of the contact are these sums. A gap to the sum before counts in the
    windows that hold that one too. So that a busy contact isn't one task, sums are dealt by stretches
    of time as long as the lookback, each with the stretches before and after it as guests: no lookback
    reaches further. Gaps are microseconds, so sums are exact; their squares fit a long up to 50 minutes.
    """
    triple = ["capture_id", "src_ip", "dst_ip", "dst_port"]
    exact = "long" if max(stride_us, history_us) <= 3_000_000_000 else "decimal(38,0)"
    square = lambda c: F.col(c).cast(exact) * F.col(c).cast(exact)
    low, high = lookback(stride_us, history_us)
    h = w.select(*triple, "start_us", "flow_no", low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    near = [*triple, "_low", "_high"]
    gap = F.col("start_us") - F.lag("start_us").over(Window.partitionBy(*near).orderBy("start_us", "flow_no"))
    h = h.withColumn("_gap", F.when(gap > 0, gap))
    # first_no: the first in the order of the gaps
    c = h.groupBy(*near).agg(F.count("*").alias("c"), F.min("start_us").alias("a"), F.max("start_us").alias("z"), F.min_by("flow_no", F.struct("start_us", "flow_no")).alias("no"), F.count("_gap").alias("gaps"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("s1"), F.coalesce(F.sum(square("_gap")), F.lit(0)).alias("s2"))
    own = F.floor(F.col("_low") * stride_us / history_us)
    stretch = Window.partitionBy(*triple, "_seat")
    order = stretch.orderBy("_low", "_high")
    c = c.withColumn("_own", own).withColumn("_seat", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1)))
    since = F.col("a") - F.lag("z").over(order)
    c = c.select("*", F.when(since > 0, since).alias("_gap"), F.coalesce(F.lag("_high").over(order), F.lit(-1)).alias("_before"), F.sum("c").over(stretch).alias("_near"))
    c = c.filter("_own = _seat AND _near >= 4").withColumn("window", F.explode(F.sequence("_low", "_high")))
    c = c.withColumn("_gap", F.when(F.col("window") <= F.col("_before"), F.col("_gap")))
    total = lambda inside, between: F.sum(F.col(inside) + F.coalesce(between, F.lit(0))).alias(inside)
    per = c.groupBy(*KEY, *triple[1:]).agg(F.sum("c").alias("n"), F.min("a").alias("first_us"), (F.max("z") - F.min("a")).alias("span"), total("gaps", F.when(F.col("_gap").isNotNull(), 1)), total("s1", F.col("_gap")), total("s2", square("_gap")), F.min_by("no", "a").alias("first_no"))
    per = per.filter("n >= 4 AND span >= 10000000 AND gaps >= 3 AND s1 >= gaps * 1000000")
    whole = lambda name: F.col(name).cast("decimal(38,0)")
    mean = F.col("s1") / F.col("gaps")
    std = F.sqrt((whole("gaps") * whole("s2") - whole("s1") * whole("s1")).cast("double")) / F.col("gaps")
    per = per.withColumn("regularity", F.round(1 / (1 + std / mean), 9))
    best = per.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("regularity"), "first_us", "first_no"))).filter("r = 1").select(*KEY, F.col("regularity").alias("beacon_regularity"), F.col("n").alias("beacon_flow_count"))
    # flows with the same first and last window are counted before they are spread
    far = w.filter("src_in AND NOT dst_in").groupBy("capture_id", "dst_ip", low.alias("_low"), high.alias("_high")).agg(F.count("*").alias("c"))
    far = far.filter("_low <= _high").withColumn("window", F.explode(F.sequence("_low", "_high"))).groupBy(*KEY, "dst_ip").agg(F.sum("c").alias("n"))
    far = far.groupBy(*KEY).agg(F.sum(F.when(F.col("n") >= 3, 1).otherwise(0)).alias("repeat_external_dst_count"))
    return best.join(far, KEY, "full").withColumn("log_beacon_flow_count", F.log1p(F.coalesce("beacon_flow_count", F.lit(0))))


def with_flow_columns(flows: DataFrame) -> DataFrame:
    """The columns that states are made of; per-flow features that the flows lack are derived from counts, or 0."""
    size = F.col("fwd_bytes") + F.col("bwd_bytes")
    derived = {"total_bytes": size, "syn_ratio": _ratio(flows, "syn"), "rst_ratio": _ratio(flows, "rst"), "bytes_ratio": safe_div(F.col("fwd_bytes"), size), "mean_packet_size": safe_div(size, F.col("total_packets"))}
    extra = [c for c in AGGREGATED_FEATURES if c not in FLOW_COLUMNS]
    return flows.select(*FLOW_COLUMNS, *((F.col(c) if c in flows.columns else derived.get(c, F.lit(0.0))).alias(c) for c in extra))


def build_states(flows: DataFrame, stride_us: int = WINDOW_US, history_us: int = HISTORY_US, window_us: int | None = None, t_end_us: int | None = None) -> DataFrame:
    """Every window of every capture: the STATE_FEATURES in their order, then the values of the summary that are not among them.

    ``flows`` has the FLOW_COLUMNS and as many AGGREGATED_FEATURES as there are; they are written
    once with their windows, since several aggregates read them. Empty windows are 0 throughout.
    """
    flows = materialised(with_flow_columns(flows), "flows")
    w = materialised(assign_windows(flows, stride_us, t_end_us), "windows")
    numbers = w.groupBy(*KEY).agg(*_volume(w, window_us or stride_us), *_distribution(tuple(c for c in AGGREGATED_FEATURES)))
    triples, sets = _meetings(w)
    sets = materialised(sets, "meetings")
    triples = sets.filter("gid = 0")
    fans = _fans(sets)
    parts = [numbers, fans, _hosts(sets), _sequential(triples, fans), _new(sets), _source_traits(w), detect_beacons(w, stride_us, history_us)]
    states = reduce(lambda a, b: a.join(b, KEY, "left"), parts, window_spine(flows, stride_us, t_end_us))
    counts = ("distinct_src", "distinct_dst", "distinct_dst_ports", "distinct_src_ports", "max_flows_per_src_dst_port", "same_port_fanout", "max_srcs_per_dst_service")
    states = states.withColumns({f"log_{c}": F.log1p(c) for c in counts})
    states = states.withColumns({"mean_payload_zero_ratio": F.col("payload_zero_ratio__mean"), "mean_retransmission_ratio": F.col("retransmission_ratio__mean"), "mean_payload_mean": F.col("payload_mean__mean")})
    more = [c for c in SUMMARY_FEATURES if c not in STATE_FEATURES]
    value = lambda c: F.when(F.col("n_flows").isNull(), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return states.select(*KEY, *map(value, (*STATE_FEATURES, *more)))


def window_summary(states: DataFrame) -> DataFrame:
    """The values of each window that rules and people read; all 0 for a window without flows."""
    return states.select(*KEY, *SUMMARY_FEATURES)


def feature_levels() -> dict[str, list[str]]:
    """The state features that flow records can give, and those that need packets."""
    packet = [c for c in STATE_FEATURES if c.split("__")[0] in PACKET_BASES or c in PACKET_DETECTORS]
    return {"packet": packet, "flow": [c for c in STATE_FEATURES if c not in packet]}


def select_features(states: DataFrame, level: str) -> DataFrame:
    """``states`` with the features of one level: flow, packet or both."""
    levels = feature_levels()
    return states.select(*KEY, *(c for c in STATE_FEATURES if level == "both" or c in levels[level]))
