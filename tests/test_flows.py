"""Hand-made packets: lifetimes, directions and TCP anomalies."""

from pyspark.sql import functions as F

from tidewatch.functions import expressions as ex
from tidewatch.operators import flows, samples

COLUMNS = "capture_id long, packet_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_ttl int, ip_id long, ip_flags int, frag_offset int, ip_len long, ihl int, tcp_flags int, tcp_window long, tcp_seq long, tcp_ack long, tcp_doff int, payload_len long, frame_len long"


def packet(no, s, flags=16, back=False, seq=0, ack=0, payload=0, protocol=6):
    a, b = (("10.0.0.1", 5000), ("8.8.8.8", 443))[:: -1 if back else 1]
    return (1, no, int(s * 1e6), a[0], b[0], a[1], b[1], protocol, 64, no, 2, 0, 40 + payload, 20, flags, 100, seq, ack, 20, payload, 54 + payload)


def flows_of(spark, rows, **options):
    return flows.assemble_flows(spark.createDataFrame(rows, COLUMNS), **options).orderBy("start_us").collect()


def test_gap_of_exactly_the_timeout_stays(spark):
    assert [f.total_packets for f in flows_of(spark, [packet(0, 0), packet(1, 120), packet(2, 240.5)])] == [2, 1]


def test_active_timeout_restarts_at_the_cut(spark):
    rows = [packet(k, 100 * k) for k in range(8)]
    assert [f.total_packets for f in flows_of(spark, rows)] == [4, 4]


def test_reset_closes_and_final_ack_is_admitted(spark):
    assert [f.total_packets for f in flows_of(spark, [packet(0, 0, 2), packet(1, 1, 4), packet(2, 2)])] == [2, 1]
    fin = [packet(0, 0), packet(1, 1, 17), packet(2, 2, 17, back=True), packet(3, 3), packet(4, 4)]
    assert [f.total_packets for f in flows_of(spark, fin)] == [4, 1]
    assert [f.total_packets for f in flows_of(spark, fin, close_on_teardown=False)] == [5]


def test_anomalies_are_counted_by_direction(spark):
    rows = [packet(0, 0, seq=100, payload=10), packet(1, 1, seq=100, payload=10), packet(2, 2, seq=50, payload=10), packet(3, 3, back=True, ack=7), packet(4, 4, back=True, ack=7)]
    f = flows_of(spark, rows)[0]
    assert (f.retransmission_count, f.out_of_order_count, f.dup_ack_count, f.fwd_packets, f.bwd_packets) == (1, 1, 1, 3, 2)


def test_empty_table_keeps_its_columns(spark):
    out = flows.assemble_flows(spark.createDataFrame([], COLUMNS))
    assert out.count() == 0 and "payload_p90" in out.columns


def test_partitions_do_not_matter(spark):
    rows = [packet(k, 37 * k % 900, flags=(16, 17, 4, 2)[k % 4], back=k % 3 == 0, payload=k % 5) for k in range(200)]
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, flows_of(spark, rows[::-1] if n > 1 else rows))))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1]


def test_expressions(spark):
    row = spark.range(1).select(
        ex.ip_to_int(F.lit("1.2.3.4")).alias("a"), ex.ip_to_int(F.lit("1.2.3")).alias("b"), ex.int_to_ip(F.lit(16909060)).alias("c"), ex.flags_to_str(F.lit(0)).alias("d"), ex.flags_to_str(F.lit(18)).alias("e"),
        ex.is_internal(F.lit("172.31.0.1")).alias("f"), ex.is_internal(F.lit("fe80::1")).alias("g"), ex.clean_label(F.lit(" - ")).alias("h"), samples.ewma(F.array(F.lit(1.0), F.lit(1.0))).alias("i"),
    ).first()
    assert tuple(row) == (16909060, None, "1.2.3.4", "-", "SYN|ACK", True, False, "Benign", 0.75)
