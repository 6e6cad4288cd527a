"""Toxic spans by a linear-chain conditional random field over words.

Every word is clean or toxic; its features are the word and its beginnings, and the chain joins
neighbours. Labels are given for documents alone, so words are labelled first: in a toxic document
those with a feature that toxic documents have far more often than chance allows, in a clean one
none. The field is fitted on a bounded sample of labelled documents (``SAMPLE_ROWS``,
``SAMPLE_BYTES``); every document is then scored by forward-backward marginals, whose chance of at
least one toxic word is calibrated on the sample.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, labelled_sample

SAMPLE_ROWS, SAMPLE_BYTES = 8000, 5 << 20
FOLDS, HELD_OUT, CUT, TAG = 5, 0, 0.5, 0.5
BEGINNINGS = (4, 5, 6, 7)
SEED_SHARE = 0.8
SHINGLE, MARKS = 5, 8
STEPS, RATE, RIDGE = 50, 0.25, 1e-4
BATCH_WORDS, KEPT_WORDS, LIMIT = 200_000, 400_000, 30.0
EDGES = string.punctuation + "«»“”„’…¿¡"
WORD = re.compile(r"\S+")


def features(word: str) -> list[str]:
    """The features of a word in lower case: itself, without punctuation around it, and its beginnings, if it is longer."""
    word = word.strip(EDGES)
    return [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) > k)] if word else []


class Chain:
    """Forward and backward messages over documents in one sequence, a clean place after each: what lies beyond a document's ends is clean.

    The sequence is folded into about the square root of its length in columns, so that numpy takes
    one step for all of them: products of each column's step matrices, then messages from column
    to column, then every place's messages from its column's own.
    """

    def __init__(self, sizes: np.ndarray):
        total = int(sizes.sum()) + len(sizes)
        self.side = max(1, math.isqrt(total))
        self.columns = -(-total // self.side)
        ends = np.cumsum(sizes + 1) - 1
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(int(sizes.sum())) + self.doc
        assert not len(ends) or ends[-1] == total - 1

    def _spread(self, scores: np.ndarray) -> np.ndarray:
        """exp(score) of every place, 0 at those that are clean by themselves; a row for each place in a column."""
        e = np.zeros(self.side * self.columns)
        e[self.place] = np.exp(np.clip(scores, -LIMIT, LIMIT))
        return np.ascontiguousarray(e.reshape(self.columns, self.side).T)

    def marginals(self, scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of every word, and the expected number of each pair of neighbouring labels."""
        e, t = self._spread(scores), np.exp(np.clip(trans, -LIMIT, LIMIT))
        shape = (2, 2, self.columns)
        product = np.zeros(shape)
        product[0, 0] = product[1, 1] = 1
        for row in e:
            a = product[:, :1] * t[0, 0] + product[:, 1:] * t[1, 0]
            b = (product[:, :1] * t[0, 1] + product[:, 1:] * t[1, 1]) * row
            product = np.concatenate([a, b], axis=1)
            product /= product.sum(axis=(0, 1))
        ahead, behind = np.zeros((2, self.columns)), np.zeros((2, self.columns))
        message = np.array([1.0, 0.0])
        for c in range(self.columns):
            ahead[:, c] = message
            message = message @ product[:, :, c]
            message /= message.sum()
        message = np.ones(2)
        for c in range(self.columns - 1, -1, -1):
            behind[:, c] = message
            message = product[:, :, c] @ message
            message /= message.sum()
        fwd, bwd = np.zeros((self.side, *ahead.shape)), np.zeros((self.side, *ahead.shape))
        for k, row in enumerate(e):
            before = ahead if not k else fwd[k - 1]
            fwd[k, 0] = before[0] * t[0, 0] + before[1] * t[1, 0]
            fwd[k, 1] = (before[0] * t[0, 1] + before[1] * t[1, 1]) * row
            fwd[k] /= fwd[k].sum(axis=0)
        bwd[-1] = behind
        for k in range(self.side - 2, -1, -1):
            clean, toxic = bwd[k + 1, 0], bwd[k + 1, 1] * e[k + 1]
            bwd[k, 0] = t[0, 0] * clean + t[0, 1] * toxic
            bwd[k, 1] = t[1, 0] * clean + t[1, 1] * toxic
            bwd[k] /= bwd[k].sum(axis=0)
        both = fwd * bwd
        p = (both[:, 1] / both.sum(axis=1)).T.ravel()[self.place]
        before = np.concatenate([ahead[None], fwd[:-1]])
        pair = before[:, :, None] * t[None, :, :, None] * (np.stack([np.ones_like(e), e], axis=1) * bwd)[:, None]
        return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=(0, 3))

    def evidence(self, p: np.ndarray, documents: int) -> np.ndarray:
        """Log-odds that a document holds a toxic word, its words' marginals taken as independent."""
        h = np.bincount(self.doc, -np.log1p(-np.minimum(p, 1 - 1e-9)), documents)
        return np.where(h > 0, np.log(np.expm1(np.clip(h, 1e-12, 500))), math.log(1e-12))


def singles(documents: list[list[str]]) -> list[int]:
    """Places of the documents that share none of their MARKS least shingles with an earlier one: copies say nothing new of a word."""
    seen: set[int] = set()
    out = []
    for k, words in enumerate(documents):
        marks = sorted({zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))})[:MARKS]
        if seen.isdisjoint(marks):
            out.append(k)
        seen.update(marks)
    return out


def seeds(documents: list[set[str]], toxic: list[bool]) -> set[str]:
    """Features whose documents are toxic in at least SEED_SHARE of cases and more often than chance lets any feature be."""
    n, hits = Counter(), Counter()
    for found, bad in zip(documents, toxic):
        n.update(found)
        if bad:
            hits.update(found)
    share = sum(toxic) / max(len(toxic), 1)
    if not 0 < share < 1:
        return set()
    most = math.log(max(len(n), 1)) + 1

    def surprise(k: int, m: int) -> float:
        r = k / m
        return k * math.log(r / share) + ((m - k) * math.log((1 - r) / (1 - share)) if k < m else 0.0)

    return {f for f, k in hits.items() if k >= SEED_SHARE * n[f] and k / n[f] > share and surprise(k, n[f]) >= most}


def fit(texts: list[str], toxic: list[bool], prior: float) -> dict:
    """Weights of features and transitions, and calibration for a share ``prior`` of toxic documents; of copies the first is used."""
    words = [t.lower().split() for t in texts]
    single = singles(words)
    words, toxic = [words[k] for k in single], [toxic[k] for k in single]
    numbers: dict[str, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in each), np.int64, len(each)) for each in words]
    of_word = [features(w) for w in numbers]
    marks = seeds([{f for w in set(each) for f in of_word[w]} for each in (x.tolist() for x in ids)], toxic)
    marked = np.array([any(f in marks for f in fs) for fs in of_word], bool)
    used = [k for k, each in enumerate(ids) if not toxic[k] or (len(each) and marked[each].any())]  # a toxic document without a marked word says nothing of its words
    none = {"weights": {}, "bias": -LIMIT, "trans": np.zeros((2, 2)), "a": 0.0, "b": _logit(prior)}
    if not marks:
        return none
    seen = Counter(f for k in used for w in set(ids[k].tolist()) for f in of_word[w])
    names = [f for f, c in seen.items() if c > 1]
    number = {f: k + 1 for k, f in enumerate(names)}  # 0: no feature
    width = 1 + len(BEGINNINGS)
    table = np.array([([number.get(f, 0) for f in fs] + [0] * width)[:width] for fs in of_word], np.int64)
    tokens = np.concatenate([ids[k] for k in used])
    sizes = np.array([len(ids[k]) for k in used])
    y = np.concatenate([marked[ids[k]] if toxic[k] else np.zeros(len(ids[k]), bool) for k in used])
    chain = Chain(sizes)
    labels = np.zeros(chain.side * chain.columns, np.int64)
    labels[chain.place] = y
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (np.r_[0, labels[:-1]], labels), 1)
    w, trans, bias = np.zeros(len(names) + 1), np.zeros((2, 2)), np.array([math.log((y.sum() + 1) / (len(y) + 1))])
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans, bias)]
    for step in range(1, STEPS + 1):
        p, expected = chain.marginals(w[table].sum(axis=1)[tokens] + bias[0], trans)
        by_word = np.bincount(tokens, y - p, len(table))
        on_weights = np.bincount(table.ravel(), np.repeat(by_word, width), len(w))
        on_weights[0] = 0
        grads = (on_weights - RIDGE * len(used) * w, pairs - expected - RIDGE * len(used) * trans, np.array([(y - p).sum()]))
        for x, g, (m, v) in zip((w, trans, bias), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        trans[0, 0] = 0.0
    model = none | {"weights": {f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-4}, "bias": float(bias[0]), "trans": trans}
    score = _Words(model)
    every = Chain(np.array([len(x) for x in ids]))
    p, _ = every.marginals(np.array([score[x] for each in words for x in each], float), trans)
    return model | calibration(every.evidence(p, len(ids)), np.array(toxic), prior)


def calibration(x: np.ndarray, toxic: np.ndarray, prior: float) -> dict:
    """Slope and offset of a logistic curve, the sample's classes weighed to the prior; targets are held off 0 and 1 by a row's worth."""
    weight = np.where(toxic, prior / max(toxic.sum(), 1), (1 - prior) / max((~toxic).sum(), 1))
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    z = np.clip(x, -20, 20)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -LIMIT, LIMIT)))
        g = np.array([(weight * (target - p) * z).sum(), (weight * (target - p)).sum()]) - 1e-4 * np.array([a - 1, 0])
        h = weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
        a, b = max(a + d[0], 1e-3), b + d[1]
    return {"a": float(a), "b": float(b)}


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


class _Words(dict):
    """Emission score of each word, worked out when first asked for; emptied at KEPT_WORDS."""

    def __init__(self, model: dict):
        super().__init__()
        self.weights, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        score = self[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return score


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Code point ranges of stretches of words that are more likely toxic than not, and their highest probability."""
    out: list[dict] = []
    last = None
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] <= TAG:
            continue
        if last == k - 1:
            out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[k]))}
        else:
            out.append({"start": m.start(), "end": m.end(), "probability": float(p[k])})
        last = k
    return out


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from labelled documents outside the held-out fold: of each class at most SAMPLE_ROWS / 2 documents and SAMPLE_BYTES / 2 of text. Without labels of both classes nothing is toxic but by the prior, which is 0 without any label."""
    sample, counts = labelled_sample(docs, labels, "toxic", ~held_out(), SAMPLE_ROWS, SAMPLE_BYTES, balanced=True)
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit([t for t, _ in sample], [y == 1 for _, y in sample], prior)


def tag_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, spans): spans lists (start, end, probability) of toxic stretches in code points of the text.

    Null, empty and blank texts have no spans and the score of a text without evidence; texts of any
    length are read whole, about BATCH_WORDS words at a time; repeated rows and null doc_ids stay as
    they are; an empty table gives none; other columns are ignored.
    """
    model = train(docs, labels)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(model)
        for b in batches:
            first, texts, sizes, emissions, n = 0, [], [], [], 0
            for k, t in enumerate(b.column("text")):
                texts.append(t.as_py())
                emissions.append([known[w] for w in texts[-1].lower().split()])
                sizes.append(len(emissions[-1]))
                n += sizes[-1]
                if n < BATCH_WORDS and k + 1 < b.num_rows:
                    continue
                chain = Chain(np.array(sizes))
                p, _ = chain.marginals(np.concatenate([np.array(x, float) for x in emissions]), model["trans"])
                out = 1 / (1 + np.exp(-np.clip(model["a"] * np.clip(chain.evidence(p, len(sizes)), -20, 20) + model["b"], -LIMIT, LIMIT)))
                cuts = np.cumsum([0, *sizes])
                found = [spans(x, p[i:j]) if j > i and p[i:j].max() > TAG else [] for x, i, j in zip(texts, cuts[:-1], cuts[1:])]
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(out), pa.array(found, kind)], names=["doc_id", "held_out", "score", "spans"])
                first, texts, sizes, emissions, n = k + 1, [], [], [], 0

    return keyed_texts(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, spans array<struct<start: int, end: int, probability: double>>")


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = tag_documents(docs, labels)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
