"""Flow tables, timelines and corpora from and to files: header detection, alias resolution, casts and derived columns.

Many files are read at once; what a header decides is metadata, everything else is a projection.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.expressions import clean_label
from ..schema import WELL_KNOWN_PORTS
from .shared import store_of

# --- fixed values: canonical column and the spellings that public flow files use ------------------
FLOW_ALIASES = {
    "flow_duration": ("Flow Duration", "dur", "Duration"),
    "fwd_packets": ("Tot Fwd Pkts", "Total Fwd Packets", "Spkts"),
    "bwd_packets": ("Tot Bwd Pkts", "Total Backward Packets", "Dpkts"),
    "total_packets": (),
    "fwd_bytes": ("TotLen Fwd Pkts", "Total Length of Fwd Packets", "sbytes", "SrcBytes"),
    "bwd_bytes": ("TotLen Bwd Pkts", "Total Length of Bwd Packets", "dbytes", "DstBytes"),
    "total_bytes": (),
    "flow_bytes_per_s": ("Flow Byts/s", "Flow Bytes/s"),
    "flow_packets_per_s": ("Flow Pkts/s", "Flow Packets/s"),
    "fwd_packets_per_s": ("Fwd Pkts/s", "Fwd Packets/s", "Sload"),
    "bwd_packets_per_s": ("Bwd Pkts/s", "Bwd Packets/s", "Dload"),
    "bytes_ratio": (),
    "packets_ratio": (),
    "mean_packet_size": ("Pkt Size Avg", "Average Packet Size"),
    "fwd_mean_packet_size": ("Fwd Pkt Len Mean", "Fwd Packet Length Mean", "Fwd Seg Size Avg"),
    "bwd_mean_packet_size": ("Bwd Pkt Len Mean", "Bwd Packet Length Mean", "Bwd Seg Size Avg"),
    "iat_mean": ("Flow IAT Mean",),
    "iat_std": ("Flow IAT Std",),
    "iat_min": ("Flow IAT Min",),
    "iat_max": ("Flow IAT Max",),
    "fwd_iat_mean": ("Fwd IAT Mean",),
    "fwd_iat_std": ("Fwd IAT Std",),
    "fwd_iat_min": ("Fwd IAT Min",),
    "fwd_iat_max": ("Fwd IAT Max",),
    "bwd_iat_mean": ("Bwd IAT Mean",),
    "bwd_iat_std": ("Bwd IAT Std",),
    "bwd_iat_min": ("Bwd IAT Min",),
    "bwd_iat_max": ("Bwd IAT Max",),
    "fin_count": ("FIN Flag Cnt", "FIN Flag Count"),
    "syn_count": ("SYN Flag Cnt", "SYN Flag Count"),
    "rst_count": ("RST Flag Cnt", "RST Flag Count"),
    "psh_count": ("PSH Flag Cnt", "PSH Flag Count"),
    "ack_count": ("ACK Flag Cnt", "ACK Flag Count"),
    "urg_count": ("URG Flag Cnt", "URG Flag Count"),
    "ece_count": ("ECE Flag Cnt", "ECE Flag Count"),
    "cwr_count": ("CWR Flag Count", "CWE Flag Count", "CWE Flag Cnt"),
    "syn_ratio": (),
    "rst_ratio": (),
    "ack_ratio": (),
    "psh_ratio": (),
    "dst_port": ("Dst Port", "Destination Port", "dsport", "dport"),
    "src_port": ("Src Port", "Source Port", "sport", "srcport"),
    "protocol": ("Protocol", "proto"),
    "is_wellknown_dst_port": (),
}
PACKET_ALIASES = {
    "ttl_mean": ("sttl",),
    "ttl_std": (),
    "ttl_min": (),
    "ttl_max": ("dttl",),
    "ttl_unique": (),
    "fwd_ttl_mean": (),
    "window_mean": ("Init Fwd Win Byts", "Init_Win_bytes_forward", "swin"),
    "window_std": (),
    "window_min": (),
    "window_max": (),
    "window_zero_count": (),
    "payload_mean": ("Pkt Len Mean", "Packet Length Mean"),
    "payload_std": ("Pkt Len Std", "Packet Length Std"),
    "payload_min": ("Pkt Len Min", "Min Packet Length"),
    "payload_max": ("Pkt Len Max", "Max Packet Length"),
    "payload_p50": (),
    "payload_p90": (),
    "payload_zero_ratio": (),
    "header_len_mean": ("Fwd Header Len", "Fwd Header Length"),
    "tcp_doff_mean": (),
    "retransmission_count": (),
    "retransmission_ratio": (),
    "dup_ack_count": (),
    "out_of_order_count": (),
    "frag_packet_count": (),
    "df_ratio": (),
    "mf_ratio": (),
}
TEXT_ALIASES = {
    "src_ip": ("Src IP", "Source IP", "srcip", "SrcAddr", "Src_IP"),
    "dst_ip": ("Dst IP", "Destination IP", "dstip", "DstAddr", "Dst_IP"),
    "start_ts": ("Timestamp", "StartTime", "Stime", "ts"),
    "label": ("Label", "attack_cat", "Attack", "class"),
}
DATASETS = ("cicids2018", "cicids2017", "unswnb15", "ctu13", "export", "generic")
MICROSECOND_DURATIONS = ("cicids2018", "cicids2017")
# ---------------------------------------------------------------------------------------------------

NUMERIC_ALIASES = FLOW_ALIASES | PACKET_ALIASES
DUAL_LEVEL = 5  # packet-level features that a source must give for more than a flow-level run


def plain(name: str) -> str:
    """A column name without case, blanks and punctuation."""
    return re.sub("[^a-z0-9]", "", name.lower())


def detect_dataset(columns: list[str]) -> str:
    """Which public flow dataset a header belongs to, ``export`` for our own files, else ``generic``."""
    have = set(map(plain, columns))
    tests = (
        ("cicids2018", "dstport" in have and bool(have & {"totfwdpkts", "flowbytss"})),
        ("cicids2017", "totalfwdpackets" in have or " destination port" in (c.lower() for c in columns)),
        ("unswnb15", have >= {"sbytes", "dbytes", "sttl"}),
        ("ctu13", have >= {"srcaddr", "dstaddr"}),
        ("export", have >= {"flowid", "startts", "totalpackets"}),
    )
    return next((name for name, ok in tests if ok), "generic")


def resolve_aliases(columns: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Canonical name to source column, the canonical spelling first, then aliases in order."""
    source = {plain(c): c for c in columns}
    found = {}
    for name, others in aliases.items():
        hit = next((source[plain(a)] for a in (name, *others) if plain(a) in source), None)
        if hit is not None:
            found[name] = hit
    return found


def scrub_numeric(value: Column) -> Column:
    """Text or number to a finite double; infinities, NaN and anything else are 0."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def scale_duration(value: Column, dataset: str) -> Column:
    """Seconds, from the dataset's unit."""
    return value * 1e-6 if dataset in MICROSECOND_DURATIONS else value


def parse_timestamps(rows: DataFrame, column: str, by: str, part: str | None = None) -> DataFrame:
    """Replace text ``column`` by epoch seconds, decided per ``by``: numbers if over 90 % are, else day-first dates (0 where unreadable), else row order.

    Row order counts rows within a ``part`` (where a file's block starts; each lies in one task) and
    adds the rows of earlier parts, for files without readable times alone.
    """
    number = F.col(column).try_cast("double")
    text = F.trim(F.col(column))
    formats = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")
    date = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    rows = rows.withColumns({"_number": number, "_date": F.unix_micros(date) / 1e6, "_row": F.monotonically_increasing_id(), "_part": F.col(part).cast("long") if part else F.lit(0).cast("long")})
    kind = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.count("_number").alias("_numbers"), F.count("_date").alias("_dates"), F.min("_row").alias("_first"))
    whole, before = Window.partitionBy(by), Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a file's blocks
    kind = kind.select(by, "_part", (F.sum("_numbers").over(whole) / F.sum("_n").over(whole)).alias("_numeric"), F.sum("_dates").over(whole).alias("_dates"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = rows.join(kind, [by, "_part"])
    order = (F.col("_row") + F.col("_shift")).cast("double")
    seconds = F.when(F.col("_numeric") > 0.9, F.coalesce("_number", F.lit(0.0))).when(F.col("_dates") > 0, F.coalesce("_date", F.lit(0.0))).otherwise(order)
    return rows.withColumn(column, seconds).drop("_number", "_date", "_row", "_numeric", "_dates", "_part", "_shift")


def _derivations() -> list[tuple]:
    """(column, what it needs, its value), in order."""
    over = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return [
        ("total_packets", ("fwd_packets", "bwd_packets"), lambda: F.col("fwd_packets") + F.col("bwd_packets")),
        ("total_bytes", ("fwd_bytes", "bwd_bytes"), lambda: F.col("fwd_bytes") + F.col("bwd_bytes")),
        ("bytes_ratio", ("total_bytes", "total_packets"), lambda: over("fwd_bytes", "total_bytes")),
        ("packets_ratio", ("total_bytes", "total_packets"), lambda: over("fwd_packets", "total_packets")),
        ("mean_packet_size", ("total_bytes", "total_packets"), lambda: over("total_bytes", "total_packets")),
        *((f"{k}_ratio", (f"{k}_count",), lambda k=k: over(f"{k}_count", "total_packets")) for k in ("syn", "rst", "ack", "psh")),
        ("is_wellknown_dst_port", ("dst_port",), lambda: F.col("dst_port").isin(*map(float, WELL_KNOWN_PORTS)).cast("double")),
    ]


def derive_missing(rows: DataFrame, have: set[str]) -> DataFrame:
    """Totals, ratios and the well-known flag, where their inputs are in ``have`` and they are not."""
    have = set(have)
    for name, inputs, value in _derivations():
        if name not in have and have.issuperset(inputs):
            rows = rows.withColumn(name, value())
            have.add(name)
        elif name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0.0))
    return rows


def available_features(columns: list[str]) -> dict[str, str]:
    """Canonical features that a header gives, with the source column, or ``derived``."""
    found = resolve_aliases(columns, NUMERIC_ALIASES)
    for name, inputs, _ in _derivations():
        if name not in found and found.keys() >= set(inputs):
            found[name] = "derived"
    return found


def canonical_flows(raw: DataFrame, dataset: str = "auto", label_column: str | None = None) -> DataFrame:
    """Raw text columns to the canonical flow schema: every flow and packet feature; absent numbers are 0, absent labels Benign.

    ``capture`` tells the file and ``_block``, where it is there, the block of it; a ``capture_id`` of
    the source is kept. Which features the source gave, ``available_features`` tells of its header.
    """
    columns = [c for c in raw.columns if c not in ("capture", "_block")]
    dataset = detect_dataset(columns) if dataset == "auto" else dataset
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset}: one of {', '.join(DATASETS)}")
    numbers, texts = resolve_aliases(columns, NUMERIC_ALIASES), resolve_aliases(columns, TEXT_ALIASES)
    if label_column in columns:
        texts["label"] = label_column
    col = lambda c: F.col(f"`{c}`")
    value = {c: scrub_numeric(col(numbers[c])) if c in numbers else F.lit(0.0) for c in NUMERIC_ALIASES}
    value["flow_duration"] = scale_duration(value["flow_duration"], dataset)
    text = {c: col(texts[c]) if c in texts else F.lit("" if c != "start_ts" else None).cast("string") for c in TEXT_ALIASES}
    text["label"] = clean_label(text["label"])
    kept = [col("capture_id").try_cast("long").alias("capture_id")] if "capture_id" in columns else []
    block = "_block" if "_block" in raw.columns else None
    rows = raw.select("capture", *([block] if block else []), *kept, *(v.alias(c) for c, v in text.items()), *(v.alias(c) for c, v in value.items()))
    rows = derive_missing(parse_timestamps(rows, "start_ts", "capture", block), set(numbers)).drop("_block")
    return rows.withColumn("end_ts", F.col("start_ts") + F.col("flow_duration")).withColumn("dataset", F.lit(dataset))


HEADER_BYTES = 1 << 20


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, capture, header) of the CSV files under ``path``: the columns of each file's first line, in order; repeated names get their place added. Files are opened in the tasks, on a store that pyarrow opens; compressed ones by their ending."""

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column("path").to_pylist():
                store, name = store_of(p)
                with store.open_input_stream(name) as src:
                    line = src.read(HEADER_BYTES).decode("utf-8-sig", "replace").splitlines()[:1]
                names: list[str] = []
                for c in next(csv.reader(line), []):
                    names.append(c if c not in names else f"{c}.{len(names)}")
                found.append(names)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([p.rsplit("/", 1)[-1] for p in b.column("path").to_pylist()]), pa.array(found, pa.list_(pa.string()))], names=["path", "capture", "header"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(first_lines, "path string, capture string, header array<string>")


def flow_availability(spark: SparkSession, path: str, dataset: str = "auto") -> DataFrame:
    """A row for each file and canonical feature: capture, dataset, feature, packet_level, available, and its source column or ``derived``; unavailable ones are those that ``read_flow_csv`` fills with 0."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for capture, header in zip(b.column("capture").to_pylist(), b.column("header").to_pylist()):
                found = available_features(header)
                kind = detect_dataset(header) if dataset == "auto" else dataset
                rows += [(capture, kind, c, c in PACKET_ALIASES, c in found, found.get(c)) for c in NUMERIC_ALIASES]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k < 5 else pa.array(list(c), pa.string()) for k, c in enumerate(zip(*rows))], names=["capture", "dataset", "feature", "packet_level", "available", "source"])

    return read_headers(spark, path).mapInArrow(resolve, "capture string, dataset string, feature string, packet_level boolean, available boolean, source string")


def availability_summary(availability: DataFrame) -> DataFrame:
    """Per file: features that are there, of which of packets, and whether that makes it a dual-level run."""
    packet = F.count_if(F.col("available") & F.col("packet_level"))
    return availability.groupBy("capture", "dataset").agg(F.count_if("available").alias("n_available"), F.count("*").alias("n_features"), packet.alias("n_packet_level"), F.when(packet < DUAL_LEVEL, "flow").otherwise("dual").alias("level"))


def read_flow_csv(spark: SparkSession, path: str, dataset: str = "auto", label_column: str | None = None) -> DataFrame:
    """Flow CSV files of any headers under one path or pattern, each file a capture; files of one header are read by one projection. ``capture_id`` is there if a header has it. Only headers and paths come to the driver."""
    groups = read_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    out = None
    for g in groups:
        if not g.header:
            continue
        raw = spark.read.csv(g.paths, header=True, schema=StructType([StructField(c, StringType()) for c in g.header]))
        file = F.element_at(F.split("_metadata.file_path", "/"), -1)
        rows = canonical_flows(raw.select("*", F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))).alias("capture"), F.col("_metadata.file_block_start").alias("_block")), dataset, label_column)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no flow file with a header under {path}")
    return out


def write_flows_csv(flows: DataFrame, path: str) -> None:
    """CSV with headers, as ``read_flow_csv`` takes them."""
    flows.write.csv(path, header=True)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Stage timeline documents (one JSON object a file) to intervals in microseconds."""
    interval = "start double, end double, stage string, attacker string, victim string, campaign string, note string"
    docs = spark.read.schema(f"timeline array<struct<{interval}>>").json(path, multiLine=True)
    rows = docs.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("capture"), F.inline("timeline"))
    us = lambda c: F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_us")
    return rows.select("capture", us("start"), us("end"), "stage", "attacker", "victim", "campaign", "note")


def write_corpus(states: DataFrame, path: str, window_s: float = 30.0) -> None:
    """Windows as Parquet, one folder a capture."""
    states.withColumn("window_s", F.lit(window_s)).write.partitionBy("capture_id").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("capture_id", F.col("capture_id").cast("long"))
