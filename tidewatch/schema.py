"""Fixed values of the data model: vocabularies, port sets, rules and label patterns."""

# --- fixed values -------------------------------------------------------------------------------
STAGES = ("Benign", "Reconnaissance", "InitialAccess", "LateralMovement", "CommandAndControl", "Exfiltration", "Impact")
INFILTRATION_STAGES = STAGES[2:]
OUT_OF_SCOPE = "OutOfScope"
TCP_FLAGS = ((1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG"), (64, "ECE"), (128, "CWR"))
WELL_KNOWN_PORTS = (20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 123, 135, 137, 138, 139, 143, 161, 389, 443, 445, 465, 514, 587, 631, 636, 993, 995, 1433, 1521, 3306, 3389, 5432, 5900, 8080, 8443)
AUTH_PORTS = (21, 22, 23, 3389, 445, 1433, 3306, 5432, 5900)
ADMIN_PORTS = (135, 139, 445, 3389, 22, 5985, 5986)
WEB_PORTS = (80, 443, 8080, 8443)
DNS_PORTS = (53, 5353, 853)
#: Private, loopback and link-local blocks: network address, prefix bits.
PRIVATE_BLOCKS = ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x7F000000, 8), (0xA9FE0000, 16))
#: Stage, summary feature, comparison, threshold, weight.
RULES = (
    ("Reconnaissance", "distinct_dst_ports", ">", 20.0, 1.4),
    ("Reconnaissance", "mean_payload_zero_ratio", ">", 0.7, 1.2),
    ("Reconnaissance", "mean_flow_packets", "<", 6.0, 0.8),
    ("Reconnaissance", "rst_share", ">", 0.2, 1.0),
    ("Reconnaissance", "max_ports_per_src_dst", ">", 15.0, 1.3),
    ("InitialAccess", "max_flows_per_src_dst_port", ">", 12.0, 1.4),
    ("InitialAccess", "auth_service_share", ">", 0.3, 1.2),
    ("InitialAccess", "rst_share", ">", 0.15, 0.7),
    ("InitialAccess", "distinct_dst_ports", "<", 12.0, 0.6),
    ("LateralMovement", "internal_flow_share", ">", 0.6, 1.3),
    ("LateralMovement", "admin_service_share", ">", 0.25, 1.4),
    ("LateralMovement", "distinct_internal_dsts", ">", 2.0, 1.1),
    ("LateralMovement", "mean_retransmission_ratio", ">", 0.02, 0.6),
    ("CommandAndControl", "beacon_regularity", ">", 0.88, 2.0),
    ("CommandAndControl", "mean_flow_bytes", "<", 6000.0, 0.8),
    ("CommandAndControl", "external_flow_share", ">", 0.4, 0.7),
    ("CommandAndControl", "repeat_external_dst_count", ">", 3.0, 1.2),
    ("Exfiltration", "outbound_bytes_ratio", ">", 0.85, 1.6),
    ("Exfiltration", "total_bytes", ">", 2000000.0, 1.3),
    ("Exfiltration", "mean_payload_mean", ">", 800.0, 0.9),
    ("Exfiltration", "external_flow_share", ">", 0.4, 0.6),
    ("Impact", "half_open_ratio", ">", 0.5, 1.6),
    ("Impact", "max_srcs_per_dst_service", ">", 8.0, 1.4),
    ("Impact", "n_flows", ">", 400.0, 1.0),
    ("Impact", "mean_flow_packets", "<", 5.0, 0.6),
)
#: Ordered label patterns, first match wins, lower case.
LABEL_PATTERNS = (
    (r"^(benign|normal|background|-)$", "Benign"),
    (r"portscan|port scan|port-scan|reconnaissance|^scan|probe|analysis|heartbleed", "Reconnaissance"),
    (r"nmap|ipsweep|portsweep|satan|mscan|saint", "Reconnaissance"),
    (r"mitm|man.?in.?the.?middle|arp.?spoof|arp.?poison|dns.?spoof|cache.?poison", "Reconnaissance"),
    (r"worm|conficker|sasser|blaster|wannacry.?spread|eternalblue|smb.?exploit", "LateralMovement"),
    (r"brute ?-?force|bruteforce|patator|password|guess", "InitialAccess"),
    (r"credential.?stuff|cred.?stuff|account.?takeover|password.?spray", "InitialAccess"),
    (r"web attack|xss|sql ?injection|sqli|infilt|exploit|shellcode|backdoor(?!.*c2)", "InitialAccess"),
    (r"^r2l$|warezclient|warezmaster|imap|multihop|phf|spy", "InitialAccess"),
    (r"lateral|^u2r$|rootkit|buffer_overflow|loadmodule|perl|smb|psexec", "LateralMovement"),
    (r"\bbot\b|botnet|^bot$|c&?c|command.?and.?control|beacon|irc|mirai|zeus|neris|rbot|virut", "CommandAndControl"),
    (r"spyware|keylog|rat\b|remote.?access.?tro", "CommandAndControl"),
    (r"trojan|worm(?!.*dos)", "CommandAndControl"),
    (r"exfil|data ?theft|data ?leak", "Exfiltration"),
    (r"dns.?tunnel|tunnel|iodine|dnscat|covert.?channel", "Exfiltration"),
    (r"ransom|wannacry|locky|cryptolocker|encrypt.?for.?impact|wiper", "Impact"),
    (r"ddos|dos ?attack|^dos|goldeneye|slowloris|slowhttptest|hulk|\bloic\b|\bhoic\b", "Impact"),
    (r"flood|syn.?flood|udp.?lag|^apache", "Impact"),
    (r"fuzzers|generic|analysis|shellcode\b(?!.*access)", "OutOfScope"),
)
#: What each rule says, in the order of RULES.
RULE_TEXTS = (
    "probing more than 20 distinct destination ports",
    "probe packets carry no payload",
    "conversations end after a handful of packets",
    "a high share of connections are refused with RST",
    "one source sweeping many ports on one host",
    "repeated connections to a single service",
    "traffic concentrated on remote-access services",
    "many attempts refused",
    "targeting few ports, not sweeping",
    "traffic is internal host to internal host",
    "SMB/RDP/SSH/WMI activity",
    "one host reaching several internal peers",
    "retransmissions typical of pushed tooling",
    "near-constant interval between outbound contacts",
    "each contact moves very little data",
    "destination is outside the network",
    "the same external host contacted repeatedly",
    "almost all bytes are leaving the network",
    "bulk volume moved in a single window",
    "packets are consistently near MTU",
    "destination is outside the network",
    "most connections never complete a handshake",
    "many sources converging on one service",
    "an extreme number of conversations in one window",
    "conversations end almost immediately",
)
#: State features of a window, in their order: scalars, then mean, std and max of per-flow features, then detectors.
SCALAR_FEATURES = (
    "log_n_flows", "log_n_packets", "log_n_bytes", "log_bytes_per_s", "log_packets_per_s", "log_flows_per_s",
    "log_distinct_src", "log_distinct_dst", "log_distinct_dst_ports", "log_distinct_src_ports",
    "tcp_share", "udp_share", "icmp_share", "internal_flow_share", "external_flow_share", "inbound_flow_share",
    "outbound_bytes_ratio", "top1_src_flow_share", "top1_dst_flow_share", "top1_src_byte_share",
    "log_mean_flow_bytes", "mean_flow_packets",
)
AGGREGATED_FEATURES = (
    "flow_duration", "total_packets", "total_bytes", "flow_bytes_per_s", "flow_packets_per_s",
    "bytes_ratio", "packets_ratio", "mean_packet_size", "iat_mean", "iat_std", "syn_ratio", "rst_ratio", "psh_ratio",
    "ttl_std", "ttl_unique", "window_mean", "payload_mean", "payload_zero_ratio", "retransmission_ratio", "frag_packet_count",
)
DETECTOR_FEATURES = (
    "max_ports_per_src_dst", "log_max_flows_per_src_dst_port", "sequential_port_ratio",
    "auth_service_share", "admin_service_share", "web_service_share", "distinct_internal_dsts",
    "beacon_regularity", "log_beacon_flow_count", "repeat_external_dst_count", "new_dst_ratio", "new_dst_port_ratio",
    "graph_mean_degree", "graph_max_degree", "log_same_port_fanout", "half_open_ratio", "log_max_srcs_per_dst_service",
    "dns_share", "log_dns_query_size", "ttl_inconsistency", "rst_injection_ratio",
)
#: The values that rules and people read, not logged.
SUMMARY_FEATURES = (
    "n_flows", "total_bytes", "distinct_dst_ports", "mean_payload_zero_ratio", "mean_flow_packets", "rst_share",
    "max_ports_per_src_dst", "max_flows_per_src_dst_port", "auth_service_share", "admin_service_share",
    "internal_flow_share", "external_flow_share", "distinct_internal_dsts", "mean_retransmission_ratio",
    "beacon_regularity", "mean_flow_bytes", "repeat_external_dst_count", "outbound_bytes_ratio", "mean_payload_mean",
    "same_port_fanout", "half_open_ratio", "max_srcs_per_dst_service", "dns_share", "dns_query_size",
    "ttl_inconsistency", "rst_injection_ratio",
)
#: What is read off packets and no flow record has: per-flow bases and detectors.
PACKET_BASES = ("ttl_std", "ttl_unique", "window_mean", "payload_mean", "payload_zero_ratio", "retransmission_ratio", "frag_packet_count")
PACKET_DETECTORS = ("ttl_inconsistency", "rst_injection_ratio")
#: The indicators of reconnaissance that the CUSUM score follows.
PRECURSOR_FEATURES = (
    "log_distinct_dst_ports", "sequential_port_ratio", "syn_ratio__mean", "half_open_ratio", "max_ports_per_src_dst",
    "new_dst_port_ratio", "log_same_port_fanout", "new_dst_ratio", "rst_ratio__mean", "log_max_flows_per_src_dst_port",
)
# ------------------------------------------------------------------------------------------------

WINDOW_US = 30_000_000
HISTORY_US = 600_000_000
IDLE_US, ACTIVE_US = 120_000_000, 300_000_000
TCP, UDP, ICMP = 6, 17, 1
STATE_FEATURES = (*SCALAR_FEATURES, *(f"{c}__{k}" for c in AGGREGATED_FEATURES for k in ("mean", "std", "max")), *DETECTOR_FEATURES)
