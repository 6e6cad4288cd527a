"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are its own, and those of the lines before and after it. The
field is fitted on a sample of at most LABEL_ROWS labelled training documents, whose texts and line features take at most
LABEL_BYTES and whose lines all take the document's label; everything is scored by forward-backward marginals, averaged over the lines by
their length and calibrated on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SubstringHashes, keyed_texts, labelled_sample

LABEL_ROWS, FOLDS, HELD_OUT, STEPS, RATE, RIDGE, CUT = 6000, 5, 0, 200, 0.1, 1e-3, 0.3
LABEL_BYTES, LINE_BYTES, BATCH_LINES = 64 << 20, 8 * 36, 50_000
OWN = 12


def _classes() -> np.ndarray:
    """For each byte: capital, digit, symbol, exclamation or question mark, white space, start of a character."""
    table = np.zeros((6, 256), np.int32)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b" \t\n\x0b\x0c\r")):
        table[k, list(chars)] = 1
    table[5] = 1
    table[5, 0x80:0xC0] = 0
    return table


CLASSES = _classes()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, characters of each line) for the lines that hold a word."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, 3 * OWN)), np.zeros(0)
    data = b"\n".join(lines)
    b = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(x) for x in lines]) + np.arange(len(lines))
    starts = np.r_[0, ends[:-1] + 1]
    capital, digit, symbol, bang, space, chars = (np.add.reduceat(c[b], starts) for c in CLASSES)
    chars = np.maximum(chars - (np.arange(len(lines)) < len(lines) - 1), 1)
    hashes = SubstringHashes(data)
    gap = CLASSES[4][b] > 0
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    word = hashes.of(first, last)
    line = np.searchsorted(ends, first, side="right")
    count = lambda mask: np.bincount(line[mask], minlength=len(lines))
    words = np.maximum(np.bincount(line, minlength=len(lines)), 1)
    echo = np.r_[False, word[1:] == word[:-1]]
    _, group, copies = np.unique(hashes.of(starts, ends), return_inverse=True, return_counts=True)
    _, of, n = np.unique(word ^ (line.astype(U64) << U64(40)), return_inverse=True, return_counts=True)
    own = np.stack(
        [
            np.ones(len(lines)),
            np.log1p(chars) / 8,
            capital / chars * 4,
            digit / chars * 4,
            np.minimum(symbol / words, 3),
            np.minimum(bang / words, 2),
            np.minimum((chars - space) / words, 30) / 8,
            count(echo) / words * 2,
            np.log1p(copies[group] - 1),
            count(n[of] > 1) / words,
            (words < 4) * 1.0,
            (symbol > words / 2) * 1.0 + (capital > chars / 3),
        ],
        axis=1,
    )
    out = np.zeros((len(lines), 3 * OWN))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN :] = own[1:]
    return out, chars


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from the one with most lines, and where each one's lines start."""
    return np.argsort(-sizes, kind="stable"), np.r_[0, np.cumsum(sizes)[:-1]]


def marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and expected counts of label pairs; ``scores`` is the log-odds of good, line by line, document by document."""
    order, start = _chains(sizes)
    size = sizes[order]
    at = start[order]
    node = np.stack([np.zeros(len(scores)), scores], axis=1)
    fwd, bwd = np.zeros_like(node), np.zeros_like(node)
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # documents with more than t lines
    add = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    for t in range(steps):
        rows = at[: live[t]] + t
        fwd[rows] = node[rows] if not t else node[rows] + add((fwd[rows - 1][:, :, None] + trans).swapaxes(1, 2))
    for t in range(steps - 2, -1, -1):
        rows = at[: live[t + 1]] + t
        bwd[rows] = add(trans + (node[rows + 1] + bwd[rows + 1])[:, None, :])
    both = fwd + bwd
    whole = add(both)
    pairs = np.zeros((2, 2))
    has_next = np.ones(len(scores), bool)
    has_next[(start + sizes - 1)[sizes > 0]] = False
    rows = np.flatnonzero(has_next)
    if len(rows):
        pairs = np.exp(fwd[rows][:, :, None] + trans + (node[rows + 1] + bwd[rows + 1])[:, None, :] - whole[rows][:, None, None]).sum(axis=0)
    return np.exp(both[:, 1] - whole), pairs


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
    """Field and calibration by gradient ascent on the conditional likelihood (Adam), each document of the same weight."""
    good = np.repeat(labels, sizes).astype(float)
    chain = np.zeros((2, 2))
    for y, n in zip(labels, sizes):
        chain[int(y), int(y)] += max(0, n - 1)
    w, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans)]
    for step in range(1, STEPS + 1):
        p, pairs = marginals(features @ w, sizes, trans)
        grads = (features.T @ (good - p) / len(good) - RIDGE * w, (chain - pairs) / max(len(good), 1) - RIDGE * trans)
        for x, g, (m, v) in zip((w, trans), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"w": w, "trans": trans, "prior": float(labels.mean()) if len(labels) else 0.5, "a": 1.0, "b": 0.0}
    x = _logit(_document_scores(model, features, sizes, weights))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a + 0.05 * ((labels - p) * x).mean(), b + 0.3 * (labels - p).mean()
    return model | {"a": float(a), "b": float(b)}


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _document_scores(model: dict, features: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    p, _ = marginals(features @ model["w"], sizes, model["trans"])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(doc, weights, len(sizes))
    return np.where(sizes > 0, np.bincount(doc, p * weights, len(sizes)) / np.maximum(total, 1), model["prior"])


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from at most LABEL_ROWS labelled documents outside the held-out fold, in the order of a hash, whose texts and line features take up to LABEL_BYTES; a document that does not fit is passed over. Without any, a model that says 0.5."""
    size = F.octet_length("text") + LINE_BYTES * (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)
    sample, counts = labelled_sample(docs, labels, "quality", ~_held_out(), LABEL_ROWS, LABEL_BYTES, size)
    if not sample:
        return {"w": np.zeros(3 * OWN), "trans": np.zeros((2, 2)), "prior": 0.5, "a": 1.0, "b": 0.0}
    got = [line_features(text) for text, _ in sample]
    labelled = np.array([y for _, y in sample])
    return fit(np.concatenate([x for x, _ in got]), np.array([len(x) for x, _ in got]), labelled, np.concatenate([c for _, c in got]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score): null, empty and blank texts get the labels' mean; texts of any length are read whole, about BATCH_LINES lines at a time; repeated rows and null doc_ids stay as they are; an empty table gives none; other columns are ignored."""
    model = train(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, lines, got = 0, 0, []
            for k, t in enumerate(b.column("text")):
                got.append(line_features(t.as_py()))
                lines += len(got[-1][1])
                if lines < BATCH_LINES and k + 1 < b.num_rows:
                    continue
                sizes = np.array([len(c) for _, c in got])
                raw = _document_scores(model, np.concatenate([x for x, _ in got]), sizes, np.concatenate([c for _, c in got]))
                out = np.where(sizes > 0, 1 / (1 + np.exp(-(model["a"] * _logit(raw) + model["b"]))), raw)
                part = b.slice(first, len(got))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(out)], names=["doc_id", "held_out", "score"])
                first, lines, got = k + 1, 0, []

    return keyed_texts(docs).select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, labels).select("*", (F.col("score") >= CUT).cast("int").alias("predicted"))
