"""Flows of one conversation: an open flow as a bounded state that takes packets one by one, and whole flows by arrays; both end as rows of flow features."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd

from ..schema import TCP, TCP_FLAGS

FIRST = ("src_ip", "dst_ip", "src_port", "dst_port", "flow_no", "start_us")
MARKS = ("fin_fwd", "fin_bwd", "grace", "closed")
COUNTS = (
    "total_packets", "fwd_packets", "total_bytes", "fwd_bytes", *(f"{name.lower()}_count" for _, name in TCP_FLAGS), "window_zero_count",
    "retransmission_count", "out_of_order_count", "dup_ack_count", "frag_packet_count", "df", "mf", "fwd_ttl", "ihl", "tcp_doff",
)
#: Latest times of all, forward and backward packets; highest sequence number of data and last acknowledgement of bare ones, each way.
LATEST = ("end_us", "fwd_us", "bwd_us", "seq_fwd", "seq_bwd", "ack_fwd", "ack_bwd")
#: Number, mean, sum of squared deviations, least and largest of each.
MOMENTS = ("iat", "fwd_iat", "bwd_iat", "ttl", "window")
PACKET = (
    "packet_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_len long, tcp_flags int, payload_len long, tcp_seq long, tcp_ack long, "
    "tcp_window long, ip_ttl int, ihl int, tcp_doff int, ip_flags int, frag_offset int"
)
PACKET_NAMES = tuple(c.split()[0] for c in PACKET.split(", "))
#: Packets that wait: a matrix of longs, a row a packet and a column a name, whose addresses are places in ``ips``.
WAITING = "packets binary, ips array<string>"
WAITING_ROWS = 10_000
_AT = {c: k for k, c in enumerate(PACKET_NAMES)}
#: payloads and payload_packets: how many packets had each payload length, 65,536 lengths at most.
STATE = "src_ip string, dst_ip string, src_port int, dst_port int, flow_no long, start_us long, marks array<boolean>, counts array<bigint>, latest array<bigint>, moments array<double>, ttls array<bigint>, payloads array<bigint>, payload_packets array<bigint>"


def _stats(name: str, kind: str) -> str:
    return f"{name}_mean double, {name}_std double, {name}_min {kind}, {name}_max {kind}"


#: What ``flows.flow_features`` sums up of a flow's packets, in its order.
ROW = (
    "flow_no long, start_us long, end_us long, src_ip string, dst_ip string, src_port int, dst_port int, flow_duration double, fwd_packets long, bwd_packets long, total_packets long, "
    "fwd_bytes long, bwd_bytes long, total_bytes long, " + ", ".join(_stats(f"{p}iat", "double") for p in ("", "fwd_", "bwd_")) + ", " + ", ".join(f"{name.lower()}_count long" for _, name in TCP_FLAGS) + ", "
    + _stats("ttl", "long") + ", ttl_unique long, fwd_ttl_mean double, " + _stats("window", "long") + ", window_zero_count long, " + _stats("payload", "long") + ", payload_zero_ratio double, "
    "header_len_mean double, tcp_doff_mean double, retransmission_count long, retransmission_ratio double, out_of_order_count long, dup_ack_count long, frag_packet_count long, df_ratio double, mf_ratio double, payload_p50 double, payload_p90 double"
)


class OpenFlow:
    def __init__(self, first: tuple):
        self.first = first
        self.marks = dict.fromkeys(MARKS, False)
        self.counts = dict.fromkeys(COUNTS, 0)
        self.latest = dict.fromkeys(LATEST, -1)
        self.moments = {m: [0.0, 0.0, 0.0, 0.0, 0.0] for m in MOMENTS}
        self.ttls: set[int] = set()
        self.payloads: dict[int, int] = {}

    def values(self) -> tuple:
        """The state as a row of STATE."""
        return (*self.first, list(self.marks.values()), list(self.counts.values()), list(self.latest.values()), [x for m in self.moments.values() for x in m], sorted(self.ttls), list(self.payloads), list(self.payloads.values()))

    @classmethod
    def of(cls, row: tuple) -> OpenFlow:
        flow = cls(tuple(row[:6]))
        marks, counts, latest, moments, ttls, lengths, packets = (list(x) for x in row[6:])
        flow.marks, flow.counts, flow.latest = dict(zip(MARKS, marks)), dict(zip(COUNTS, counts)), dict(zip(LATEST, latest))
        flow.moments = {m: moments[5 * k : 5 * k + 5] for k, m in enumerate(MOMENTS)}
        flow.ttls, flow.payloads = set(ttls), dict(zip(lengths, packets))
        return flow

    @property
    def start_us(self) -> int:
        return self.first[5]

    @property
    def end_us(self) -> int:
        return self.latest["end_us"]

    def _moment(self, name: str, x: float) -> None:
        m, x = self.moments[name], float(x)  # the state's arrays take no whole numbers for doubles
        low, high = (x, x) if not m[0] else (min(m[3], x), max(m[4], x))
        n, d = m[0] + 1, x - m[1]
        mean = m[1] + d / n
        self.moments[name] = [n, mean, m[2] + d * (x - mean), low, high]

    def add(self, p: dict, fwd: bool, teardown: bool, seen) -> None:
        """Take the next packet; ``seen(fwd, seq, length)`` tells whether such data came before, and remembers it."""
        c, last, ts = self.counts, self.latest, p["ts_us"]
        side = "fwd" if fwd else "bwd"
        tcp, flags, length = p["protocol"] == TCP, p["tcp_flags"], p["payload_len"]
        rst = teardown and tcp and bool(flags & 4)
        fin = teardown and tcp and bool(flags & 1) and not rst
        m = self.marks
        m[f"fin_{side}"] = m[f"fin_{side}"] or fin
        m["closed"] = m["closed"] or m["grace"] or rst  # the packet after the second FIN is admitted, and closes
        m["grace"] = m["grace"] or (fin and m["fin_fwd"] and m["fin_bwd"])
        for name, of in (("iat", "end_us"), (f"{side}_iat", f"{side}_us")):
            if c["total_packets"] if of == "end_us" else last[of] != -1:
                self._moment(name, ts - last[of])
            last[of] = ts
        self._moment("ttl", p["ip_ttl"])
        self._moment("window", p["tcp_window"])
        self.ttls.add(p["ip_ttl"])
        self.payloads[length] = self.payloads.get(length, 0) + 1
        c["total_packets"] += 1
        c["total_bytes"] += p["ip_len"]
        if fwd:
            c["fwd_packets"] += 1
            c["fwd_bytes"] += p["ip_len"]
            c["fwd_ttl"] += p["ip_ttl"]
        for bit, name in TCP_FLAGS:
            c[f"{name.lower()}_count"] += bool(flags & bit)
        c["window_zero_count"] += p["tcp_window"] == 0
        c["frag_packet_count"] += bool(p["ip_flags"] & 1) or p["frag_offset"] > 0
        c["df"] += bool(p["ip_flags"] & 2)
        c["mf"] += bool(p["ip_flags"] & 1)
        c["ihl"] += p["ihl"]
        c["tcp_doff"] += p["tcp_doff"]
        if tcp and length > 0:
            if seen(fwd, p["tcp_seq"], length):
                c["retransmission_count"] += 1
            elif p["tcp_seq"] < last[f"seq_{side}"]:
                c["out_of_order_count"] += 1
            last[f"seq_{side}"] = max(last[f"seq_{side}"], p["tcp_seq"])
        elif tcp and flags & 16:
            c["dup_ack_count"] += last[f"ack_{side}"] == p["tcp_ack"]
            last[f"ack_{side}"] = p["tcp_ack"]

    def _quantile(self, q: float) -> float:
        """Linear between the two packets nearest to the rank."""
        rank = q * (self.counts["total_packets"] - 1)
        low, at = None, 0
        for length in sorted(self.payloads):
            at += self.payloads[length]
            if low is None and at > math.floor(rank):
                low = length
            if at > math.ceil(rank):
                return low + (rank - math.floor(rank)) * (length - low)
        return float(low)

    def row(self) -> tuple:
        """The flow as a row of ROW."""
        c, n = self.counts, self.counts["total_packets"]
        src_ip, dst_ip, src_port, dst_port, flow_no, start = self.first

        def stats(name: str, unit: float = 1.0, kind=float) -> tuple:
            count, mean, squares, low, high = self.moments[name]
            return (mean / unit, math.sqrt(squares / count) / unit if count else 0.0, kind(low / unit), kind(high / unit))

        total = sum(k * v for k, v in self.payloads.items())
        mean = total / n
        payload = (mean, math.sqrt(sum(v * (k - mean) ** 2 for k, v in self.payloads.items()) / n), min(self.payloads), max(self.payloads))
        ttl = stats("ttl", kind=int)
        return (
            flow_no, start, self.end_us, src_ip, dst_ip, src_port, dst_port, (self.end_us - start) / 1e6, c["fwd_packets"], n - c["fwd_packets"], n,
            c["fwd_bytes"], c["total_bytes"] - c["fwd_bytes"], c["total_bytes"], *stats("iat", 1e6), *stats("fwd_iat", 1e6), *stats("bwd_iat", 1e6), *(c[f"{name.lower()}_count"] for _, name in TCP_FLAGS),
            *ttl, len(self.ttls), c["fwd_ttl"] / c["fwd_packets"] if c["fwd_packets"] else ttl[0], *stats("window", kind=int), c["window_zero_count"], *payload, self.payloads.get(0, 0) / n,
            c["ihl"] / n, c["tcp_doff"] / n, c["retransmission_count"], c["retransmission_count"] / n, c["out_of_order_count"], c["dup_ack_count"], c["frag_packet_count"], c["df"] / n, c["mf"] / n, float(self._quantile(0.5)), float(self._quantile(0.9)),
        )


class Packets:
    """Packets of one conversation, as WAITING has them; ``packets.ts_us`` is a column."""

    def __init__(self, matrix: np.ndarray, ips: list[str]):
        self.matrix, self.ips = matrix, ips

    def __len__(self) -> int:
        return len(self.matrix)

    def __getattr__(self, name: str) -> np.ndarray:
        return self.matrix[:, _AT[name]]

    def __getitem__(self, rows) -> Packets:
        return Packets(self.matrix[rows], self.ips)

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Packets:
        codes, ips = pd.factorize(pd.concat([frame["src_ip"], frame["dst_ip"]], ignore_index=True))
        matrix = np.empty((len(frame), len(PACKET_NAMES)), np.int64)
        for c, k in _AT.items():
            matrix[:, k] = codes[: len(frame)] if c == "src_ip" else codes[len(frame) :] if c == "dst_ip" else frame[c].to_numpy()
        return cls(matrix, list(ips))

    @classmethod
    def joined(cls, parts: list[Packets]) -> Packets:
        ips: dict[str, int] = {}
        matrices = [np.zeros((0, len(PACKET_NAMES)), np.int64)]
        for p in parts:
            places = np.array([ips.setdefault(ip, len(ips)) for ip in p.ips], np.int64)
            m = p.matrix.copy()
            for c in ("src_ip", "dst_ip"):
                m[:, _AT[c]] = places[m[:, _AT[c]]] if len(places) else 0
            matrices.append(m)
        return cls(np.concatenate(matrices), list(ips))

    def values(self) -> list[tuple]:
        """As rows of WAITING."""
        out = []
        for at in range(0, len(self), WAITING_ROWS):
            m = self.matrix[at : at + WAITING_ROWS].copy()
            ends = [_AT["src_ip"], _AT["dst_ip"]]
            used, places = np.unique(m[:, ends], return_inverse=True)
            m[:, ends] = places.reshape(-1, 2)
            out.append((m.tobytes(), [self.ips[k] for k in used]))
        return out

    @classmethod
    def of_values(cls, rows) -> Packets:
        return cls.joined([cls(np.frombuffer(bytes(data), np.int64).reshape(-1, len(PACKET_NAMES)), list(ips)) for data, ips in rows])

    def sorted(self) -> Packets:
        return self[np.lexsort((self.packet_no, self.ts_us))]

    def dicts(self) -> list[dict]:
        """Packet by packet, as ``OpenFlow.add`` takes them."""
        return [dict(zip(PACKET_NAMES, r)) for r in self.matrix.tolist()]

    def opening(self, k: int) -> OpenFlow:
        return OpenFlow((self.ips[self.src_ip[k]], self.ips[self.dst_ip[k]], int(self.src_port[k]), int(self.dst_port[k]), int(self.packet_no[k]), int(self.ts_us[k])))


def cut(p: Packets, fwd: np.ndarray, flow: OpenFlow | None, idle_us: int, active_us: int, teardown: bool) -> list[tuple[int, int, bool]]:
    """(first packet, packet after the last, whether it is over) of each flow of sorted packets; the first goes on with ``flow``, where there is one. The last is over only if a packet has closed it."""
    n, ts = len(p), p.ts_us.tolist()
    tcp = (p.protocol == TCP) & teardown
    rst = tcp & (p.tcp_flags & 4 != 0)
    fin = tcp & (p.tcp_flags & 1 != 0) & ~rst
    at = lambda mask: np.flatnonzero(mask).tolist()
    resets, fins_fwd, fins_bwd, breaks = at(rst), at(fin & fwd), at(fin & ~fwd), at(np.diff(p.ts_us, prepend=p.ts_us[:1]) > idle_us)

    def next_of(places: list[int], k: int) -> int:
        k = bisect_left(places, k)
        return places[k] if k < len(places) else n

    out, i = [], 0
    while i < n:
        marks = flow.marks if flow else dict.fromkeys(MARKS, False)
        start = flow.start_us if flow else ts[i]
        second = max(i - 1 if marks["fin_fwd"] else next_of(fins_fwd, i), i - 1 if marks["fin_bwd"] else next_of(fins_bwd, i))
        closing = i if marks["grace"] else min(next_of(resets, i), second + 1)  # the packet after the second FIN is admitted, and closes
        j = min(n, next_of(breaks, i + 1), bisect_right(ts, start + active_us, i), closing + 1)
        out.append((i, j, j < n or closing < n))
        i, flow = j, None
    return out


def closed_flows(p: Packets, fwd: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
    """Whole flows, which begin at ``starts`` among sorted packets and follow each other, as rows of ROW; as ``OpenFlow`` makes them."""
    n, ts, length = len(p), p.ts_us, p.payload_len
    packets = np.diff(starts, append=n)
    count, ends = len(starts), starts + packets - 1
    flow = np.repeat(np.arange(count), packets)
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)

    def stats(name: str, x: np.ndarray, of: np.ndarray, unit: float = 1.0, whole: bool = False) -> dict:
        some = np.maximum(np.bincount(of, minlength=count), 1)
        mean = np.bincount(of, x, count) / some
        std = np.sqrt(np.bincount(of, (x - mean[of]) ** 2, count) / some)
        low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        if len(first):
            low[of[first]], high[of[first]] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        return {f"{name}_mean": mean / unit, f"{name}_std": std / unit, f"{name}_min": low if whole else low / unit, f"{name}_max": high if whole else high / unit}

    def gaps(name: str, rows: np.ndarray) -> dict:
        same = np.diff(flow[rows]) == 0
        return stats(name, np.diff(ts[rows])[same], flow[rows][1:][same], 1e6)

    def quantile(q: float) -> np.ndarray:
        rank = q * (packets - 1)
        low = ordered[starts + np.floor(rank).astype(int)]
        return low + (rank - np.floor(rank)) * (ordered[starts + np.ceil(rank).astype(int)] - low)

    tcp = p.protocol == TCP
    side = 2 * flow + ~fwd
    data, bare = np.flatnonzero(tcp & (length > 0)), np.flatnonzero(tcp & ~(length > 0) & (p.tcp_flags & 16 != 0))
    again = np.zeros(len(data), bool)
    order = np.lexsort((length[data], p.tcp_seq[data], side[data]))
    keys = np.stack([side[data], p.tcp_seq[data], length[data]], axis=1)[order]
    again[order[1:]] = (keys[1:] == keys[:-1]).all(axis=1)
    # behind the highest sequence number so far on its side: places of numbers grow from side to side
    order = np.argsort(side[data], kind="stable")
    numbers, place = np.unique(np.append(p.tcp_seq[data], -1), return_inverse=True)
    base = np.unique(side[data][order], return_inverse=True)[1] * len(numbers)
    highest = np.maximum.accumulate(np.maximum(base + place[:-1][order], base + place[-1])) if len(data) else base
    before = np.maximum(np.append(base[:1], highest[:-1]), base + place[-1])
    behind = np.zeros(len(data), bool)
    behind[order] = base + place[:-1][order] < before
    order = bare[np.argsort(side[bare], kind="stable")]
    same = np.diff(side[order], prepend=-1) == 0
    repeated = np.zeros(n, bool)
    repeated[order] = p.tcp_ack[order] == np.where(same, np.append([-1], p.tcp_ack[order][:-1]), -1) if len(order) else False
    of_data = lambda mask: np.bincount(flow[data], mask, count).astype(np.int64)
    ordered = length[np.lexsort((length, flow))]
    ttls = np.unique(np.stack([flow, p.ip_ttl], axis=1), axis=0)[:, 0]
    size, fwd_size, fwd_packets, fragments = total(p.ip_len), total(np.where(fwd, p.ip_len, 0)), total(fwd), p.ip_flags & 1 != 0
    ttl, lengths, every = stats("ttl", p.ip_ttl, flow, whole=True), stats("payload", length, flow, whole=True), np.arange(n)
    ips = np.array(p.ips, object)
    out = {"flow_no": p.packet_no[starts], "start_us": ts[starts], "end_us": ts[ends], "src_ip": ips[p.src_ip[starts]], "dst_ip": ips[p.dst_ip[starts]], "src_port": p.src_port[starts], "dst_port": p.dst_port[starts]}
    out |= {"flow_duration": (ts[ends] - ts[starts]) / 1e6, "fwd_packets": fwd_packets, "bwd_packets": packets - fwd_packets, "total_packets": packets, "fwd_bytes": fwd_size, "bwd_bytes": size - fwd_size, "total_bytes": size}
    out |= gaps("iat", every) | gaps("fwd_iat", every[fwd]) | gaps("bwd_iat", every[~fwd]) | {f"{name.lower()}_count": total(p.tcp_flags & bit != 0) for bit, name in TCP_FLAGS}
    out |= ttl | {"ttl_unique": np.bincount(ttls, minlength=count), "fwd_ttl_mean": np.where(fwd_packets > 0, total(np.where(fwd, p.ip_ttl, 0)) / np.maximum(fwd_packets, 1), ttl["ttl_mean"])}
    out |= stats("window", p.tcp_window, flow, whole=True) | {"window_zero_count": total(p.tcp_window == 0)} | lengths | {"payload_zero_ratio": total(length == 0) / packets, "header_len_mean": total(p.ihl) / packets, "tcp_doff_mean": total(p.tcp_doff) / packets}
    out |= {"retransmission_count": of_data(again), "retransmission_ratio": of_data(again) / packets, "out_of_order_count": of_data(behind & ~again), "dup_ack_count": total(repeated), "frag_packet_count": total(fragments | (p.frag_offset > 0))}
    out |= {"df_ratio": total(p.ip_flags & 2 != 0) / packets, "mf_ratio": total(fragments) / packets, "payload_p50": quantile(0.5), "payload_p90": quantile(0.9)}
    return pd.DataFrame(out)
