"""Runs of words against brute force, however the words arrive."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tidewatch.llm import common, periodic_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "ab " * 24, "ab " * 23, "a b c " * 8 + "x " + "a b c " * 9, "one two three", "one two three", "x" * 5000, "é ñ ß \x85  " * 30, "p q " * 400 + "r"]


def brute(words, min_length, min_exponent):
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q) and not any(q % p == 0 and a <= i and j + q <= a + m for a, m, p in found):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def sample(rng):
    n, letters = rng.randint(0, 150), rng.choice([1, 2, 3, 5])
    words = []
    while len(words) < n:
        words += [str(rng.randrange(letters)) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 2, 3, 4, 7])
        words *= rng.choice([1, 1, 1, 2])
    return words


@pytest.mark.parametrize("min_length, min_exponent", [(24, 3), (1, 2), (10, 3), (60, 2), (130, 3)])
def test_runs_are_all_and_only_those(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(15):
        texts = [sample(rng) for _ in range(rng.randint(1, 4))]
        want = [brute(w, min_length, min_exponent) for w in texts]
        for piece in (1, 7, 64, 100_000):
            assert periodic_runs.stream_runs(texts, min_length, min_exponent, piece) == want


def test_repeats_across_pieces_of_a_long_text():
    words = [str(k) for k in range(3000)] + [str(k % 700) for k in range(5000)] + ["z"] * 2000
    want = [(3000, 5000, 700), (8000, 2000, 1)]
    assert [periodic_runs.stream_runs([words], piece=p)[0] for p in (50, 999, 1 << 20)] == [want] * 3


def test_collapsed_keeps_the_first_period():
    words = "a b c a b c a b c x".split()
    assert periodic_runs.collapsed(words, periodic_runs.stream_runs([words], 6, 3)[0]) == "a b c x".split()


def reference_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_over_documents(spark):
    docs = common.documents(spark, SF)
    rows = periodic_runs.op13(docs)
    assert rows.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = {r.doc_id: tuple(r) for r in rows.collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    short = [d for d, t in texts.items() if len(WORD.findall(t or "")) < 500]
    assert len(short) > 100 and sum(got[d][1] > 0 for d in short) > 5
    assert [got[d] for d in short] == [reference_row(d, texts[d]) for d in short]


def test_odd_rows(spark):
    pairs = [*((k, t) for k, t in enumerate(ODD)), (None, "ab " * 30), (None, None), (4, "ab " * 30)]
    odd = spark.createDataFrame([(d, t, 1, "z") for d, t in pairs], "doc_id long, text string, period int, runs string")
    assert by_row(periodic_runs.op13(odd).collect()) == by_row(reference_row(d, t) for d, t in pairs)
    found = {r.doc_id: r for r in periodic_runs.detect(odd.filter("doc_id IS NOT NULL AND doc_id <> 4")).collect()}
    assert [tuple(x) for x in found[6].runs] == [(0, 24, 3), (25, 27, 3)] and found[6].text == "a b c x a b c"
    assert [tuple(x) for x in found[len(ODD) - 1].runs] == [(0, 800, 2)] and found[len(ODD) - 1].text == "p q r"
    assert found[0].runs == [] and found[0].text == ""
    assert periodic_runs.op13(odd.limit(0)).count() == periodic_runs.detect(odd.limit(0)).count() == 0
