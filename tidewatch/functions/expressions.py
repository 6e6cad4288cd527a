"""Column expressions on addresses, flags, ports, labels and rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INFILTRATION_STAGES, LABEL_PATTERNS, OUT_OF_SCOPE, PRIVATE_BLOCKS, TCP_FLAGS


def ip_to_int(ip: Column) -> Column:
    """Dotted quad to its 32-bit value; null for anything else."""
    part = lambda k: F.element_at(F.split(ip, r"\."), k).cast("long")
    valid = ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(valid, F.shiftleft(part(1), 24) + F.shiftleft(part(2), 16) + F.shiftleft(part(3), 8) + part(4))


def int_to_ip(value: Column) -> Column:
    octet = lambda k: F.shiftright(value, k).bitwiseAND(255).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def ipv6_fold(address: Column) -> Column:
    """FNV-1a of the text's bytes, 20 bits of it, in 240.0.0.0/12."""
    codes = F.transform(F.split(address, ""), F.ascii)
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step).bitwiseAND(0xFFFFF).bitwiseOR(0xF0000000)


def flags_to_str(flags: Column) -> Column:
    text = F.concat_ws("|", *(F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in TCP_FLAGS))
    return F.when(text == "", "-").otherwise(text)


def is_internal(ip: Column) -> Column:
    blocks = lambda v: reduce(or_, (F.shiftright(v, 32 - bits) == base >> (32 - bits) for base, bits in PRIVATE_BLOCKS))
    # inside an array the address is parsed once, not once a block
    return F.coalesce(F.exists(F.array(ip_to_int(ip)), blocks), F.lit(False))


def service_class(port: Column, ports: tuple[int, ...]) -> Column:
    return port.isin(*ports)


def stage_from_label(label: Column) -> Column:
    text = F.lower(F.trim(label))
    stage = F.when(text == "", "Benign")
    for pattern, name in LABEL_PATTERNS:
        stage = stage.when(text.rlike(pattern), name)
    return stage.otherwise(OUT_OF_SCOPE)


def clean_label(label: Column) -> Column:
    text = F.trim(label)
    return F.when(text.isNull() | text.isin("", "nan", "NaN", "None", "-", "normal", "BENIGN"), "Benign").otherwise(text)


def infiltration_flag(stage: Column) -> Column:
    return stage.isin(*INFILTRATION_STAGES).cast("int")


def rule_support(value: Column, op: Column, threshold: Column, band: float = 0.18) -> Column:
    """Support from 0 to 1 on a ramp of ``band`` to either side of the threshold."""
    span = F.when(threshold == 0, band).otherwise(F.abs(threshold) * band)
    rising = (value - threshold + span) / (2 * span)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(op == ">", rising).otherwise(1 - rising)))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def flow_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column, ts_us: Column) -> Column:
    return F.concat(src_ip, F.lit(":"), src_port.cast("string"), F.lit("-"), dst_ip, F.lit(":"), dst_port.cast("string"), F.lit("-"), protocol.cast("string"), F.lit("-"), ts_us.cast("string"))
