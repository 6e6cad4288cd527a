"""State features and stages in plain words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what features and stages are called ---------------------------------------------
FEATURE_WORDS = {
    "log_n_flows": "number of conversations",
    "log_n_packets": "packet volume",
    "log_n_bytes": "byte volume",
    "log_bytes_per_s": "throughput",
    "log_packets_per_s": "packet rate",
    "log_flows_per_s": "connection rate",
    "log_distinct_src": "number of distinct sources",
    "log_distinct_dst": "number of distinct destinations",
    "log_distinct_dst_ports": "number of distinct destination ports",
    "log_distinct_src_ports": "number of distinct source ports",
    "tcp_share": "share of TCP traffic",
    "udp_share": "share of UDP traffic",
    "icmp_share": "share of ICMP traffic",
    "internal_flow_share": "share of internal-to-internal traffic",
    "external_flow_share": "share of traffic leaving the network",
    "inbound_flow_share": "share of traffic entering from outside",
    "outbound_bytes_ratio": "proportion of bytes leaving the network",
    "top1_src_flow_share": "concentration of activity on one source host",
    "top1_dst_flow_share": "concentration of activity on one destination host",
    "top1_src_byte_share": "concentration of volume on one source host",
    "log_mean_flow_bytes": "typical conversation size",
    "mean_flow_packets": "typical packets per conversation",
    "max_ports_per_src_dst": "most ports one host probed on a single target",
    "log_max_flows_per_src_dst_port": "most repeated connections to one service",
    "sequential_port_ratio": "how sequentially ports were walked",
    "auth_service_share": "share of traffic to remote-access services",
    "admin_service_share": "share of traffic to SMB/RDP/SSH/WMI",
    "web_service_share": "share of traffic to web services",
    "distinct_internal_dsts": "internal peers reached by one host",
    "beacon_regularity": "how metronomic repeated outbound contacts are",
    "log_beacon_flow_count": "size of the most regular contact pattern",
    "repeat_external_dst_count": "external hosts contacted repeatedly",
    "new_dst_ratio": "proportion of destinations never seen before",
    "new_dst_port_ratio": "proportion of destination ports never seen before",
    "graph_mean_degree": "average host connectivity",
    "graph_max_degree": "connectivity of the busiest host",
    "log_same_port_fanout": "hosts one source contacted on a single port (worm fan-out)",
    "half_open_ratio": "proportion of connections that never completed a handshake",
    "log_max_srcs_per_dst_service": "sources converging on one service",
    "dns_share": "share of traffic that is DNS",
    "log_dns_query_size": "size of DNS queries (long encoded subdomains mean tunnelling)",
    "ttl_inconsistency": "one source arriving with several different TTLs",
    "rst_injection_ratio": "resets injected into conversations already in flight",
    "flow_duration": "conversation duration",
    "total_packets": "packets per conversation",
    "total_bytes": "bytes per conversation",
    "flow_bytes_per_s": "per-conversation throughput",
    "flow_packets_per_s": "per-conversation packet rate",
    "bytes_ratio": "byte asymmetry (how one-sided a conversation is)",
    "packets_ratio": "packet asymmetry",
    "mean_packet_size": "packet size",
    "iat_mean": "gap between packets",
    "iat_std": "irregularity of packet timing",
    "syn_ratio": "SYN flag ratio",
    "rst_ratio": "RST flag ratio (refused connections)",
    "psh_ratio": "PSH flag ratio",
    "ttl_std": "TTL variation",
    "ttl_unique": "number of distinct TTL values",
    "fwd_ttl_mean": "TTL of packets from the initiating host",
    "window_mean": "TCP receive-window size",
    "payload_mean": "payload size",
    "payload_zero_ratio": "proportion of packets carrying no payload",
    "retransmission_ratio": "retransmission rate",
    "frag_packet_count": "fragmented packets",
}
SUFFIX_WORDS = {"__mean": "average", "__std": "variability of", "__max": "peak"}
TACTICS = {"Reconnaissance": "TA0043", "InitialAccess": "TA0001", "LateralMovement": "TA0008", "CommandAndControl": "TA0011", "Exfiltration": "TA0010", "Impact": "TA0040"}
# ----------------------------------------------------------------------------------------------------


def describe_feature(name: Column) -> Column:
    """A feature's name in words, by its base and suffix; unknown names with spaces for underscores."""
    words = F.create_map(*(F.lit(x) for pair in FEATURE_WORDS.items() for x in pair))
    suffix = F.regexp_extract(name, "(__mean|__std|__max)$", 1)
    base = F.regexp_replace(name, "(__mean|__std|__max)$", "")
    text = F.coalesce(F.try_element_at(words, base), F.replace(base, F.lit("_"), F.lit(" ")))
    prefix = F.try_element_at(F.create_map(*(F.lit(x) for pair in SUFFIX_WORDS.items() for x in pair)), suffix)
    return F.concat_ws(" ", prefix, text)


def describe_stage(stage: Column, techniques: dict[str, str] | None = None) -> Column:
    """A stage with the identifier of its tactic, and its techniques where a table of them is given."""
    of = lambda table, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), stage), F.lit(other))
    text = F.concat(stage, F.lit(" ("), of(TACTICS, "-"), F.lit(")"))
    return F.concat(text, F.lit(" - "), of(techniques, "")) if techniques else text
