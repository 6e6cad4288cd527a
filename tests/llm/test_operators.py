"""Each operator against brute force over whole texts, and on odd rows."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, crf, fingerprints, lm, minhash, mixing, packing, rules, suffix_dedup, token_counts, tokens, training_order

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "one two three", "one two three", "x" * 5000, "Nt, " * 400, "ab cd " * 30 + "\n" + "ab cd " * 30, "é ñ ß\n\n|***| <|endoftext|> ½", "THE " * 60]


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 7, t, None if k % 3 == 0 else f"s{k % 2}", 1, "z") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, anchor int, component string")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def both(docs, odd, texts):
    yield docs, texts
    yield odd, {k * 7: t or "" for k, t in enumerate(ODD)}


def ascii_lower(text):
    return text.encode().lower().decode()


def test_repeats(docs, odd, texts):
    for frame, want in both(docs, odd, texts):
        got = {r.doc_id: r for r in suffix_dedup.op2(frame).collect()}
        assert got.keys() == want.keys()
        first = {}
        for d in sorted(want):
            data = want[d].encode()
            gone = np.zeros(len(data), bool)
            for q in range(len(data) - 49):
                if first.setdefault(data[q : q + 50], d) < d:
                    gone[q : q + 50] = True
            spans = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_near_duplicates(docs, odd, texts):
    for frame, want in both(docs, odd, texts):
        sets = {}
        for d, t in want.items():
            w = WORD.findall(ascii_lower(t))
            sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        group = {d: d for d in want}
        ids = sorted(want)
        for i, a in enumerate(ids):
            for b in ids[:i]:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    old, new = sorted((group[a], group[b]), reverse=True)
                    group = {k: new if v == old else v for k, v in group.items()}
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op3(frame).collect()}
        assert got == {d: (len(sets[d]), group[d], group[d] == d) for d in want}


def test_packing(docs, odd, texts):
    enc = tokens.encoder(tokens.default_tokenizer())
    for frame, want in both(docs, odd, texts):
        rows = packing.op4(frame).collect()
        whole = {d: enc.ids(t) + b"\0\0\0\0" for d, t in want.items()}
        sequences, lengths = defaultdict(list), Counter()
        for r in rows:
            assert zlib.crc32(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            sequences[r.sequence_id].append((r.offset, r.length))
            lengths[r.doc_id] += r.length
        assert lengths == {d: len(x) // 4 for d, x in whole.items()}
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        assert len(sequences) <= 1.02 * sum(lengths.values()) / packing.CAPACITY + 1


def best_fit_decreasing(sizes, capacity):
    gaps: list = []
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        free = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, free - size)
    return len(gaps)


@pytest.mark.parametrize("high", [100, 7])
def test_supersteps_pack_as_best_fit(spark, monkeypatch, high):
    rng = np.random.default_rng(high)
    sizes = [int(x) for x in rng.integers(1, high + 1, 250)]
    items = spark.createDataFrame([(k % 3, n) for k, n in enumerate(sizes)], "id int, length long")
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)
    rows = packing.pack(items, 100).collect()
    assert sorted((r.id, r.length) for r in rows) == sorted((k % 3, n) for k, n in enumerate(sizes))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 100
    assert len(sequences) <= 1.03 * best_fit_decreasing(sizes, 100) + 1


def test_leftovers_of_ranges_meet_as_brackets():
    # documents left per range, then gaps left per range: gaps take the nearest documents below
    assert packing._between_ranges({0: 3, 1: 1}, {1: 1, 2: 2}) == [(1, 0, 0, 0, 1), (2, 0, 1, 0, 1), (2, 1, 0, 1, 1)]


def test_tokens(docs, odd, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    enc = tokens.encoder(tokens.default_tokenizer())
    for frame, want in both(docs, odd, texts):
        got = {r.doc_id: r for r in token_counts.op5(frame).collect()}
        for d, t in want.items():
            ids = model.encode(t, add_special_tokens=False).ids
            assert enc.ids(t) == np.array(ids, "<u4").tobytes()
            assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), len(ids), len(ids) > 512)


def test_other_tokenizers(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    frame = spark.createDataFrame([(1, "It is there."), (None, "\U00011de0a \U00011de0"), (3, None)], "doc_id long, text string")
    for path, count in (
        (path, sentencepiece.SentencePieceProcessor(model_file=path).encode),
        (tokens.default_tokenizer(), lambda t: Tokenizer.from_file(tokens.default_tokenizer()).encode(t, add_special_tokens=False).ids),
    ):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, path).collect()}
        assert got == {r.doc_id: len(count(r.text)) if r.text else 0 for r in frame.collect()}


def test_counts_agree_for_any_chunks(docs):
    one = sorted(token_counts.count_tokens(docs).collect())
    assert one == sorted(token_counts.count_tokens(docs.repartition(5), chunk_bytes=5000).collect())


def test_many_chunks_meet_common_pieces_in_parts(docs, monkeypatch):
    one = sorted(token_counts.count_tokens(docs).collect())
    monkeypatch.setattr(token_counts, "CHUNKS_A_SALT", 7)
    assert one == sorted(token_counts.count_tokens(docs, chunk_bytes=5000).collect())


def test_words_that_meet_under_powers_of_two(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = minhash.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_buckets_split_by_later_bands(docs, monkeypatch):
    want = sorted(minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "SPLIT", 2)
    assert want == sorted(minhash.near_duplicates(docs).collect())


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Pairs that share one band, in a bucket of others, are found whatever the bucket's size."""
    draw = random.Random(5)
    rows = [(k, " ".join(f"w{i}" for i in range(300) if draw.random() < 2 / 3)) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(minhash.near_duplicates(table, 58, 1).collect())
    assert sum(r.doc_id != r.component_id for r in want) > 10
    monkeypatch.setattr(minhash, "SPLIT", 2)
    monkeypatch.setattr(minhash, "BLOCK", 1)
    assert want == sorted(minhash.near_duplicates(table, 58, 1).collect())


def test_layouts_agree(docs, odd):
    for op in (mixing.op6, training_order.op10):
        assert sorted(op(docs.repartition(3)).collect()) == sorted(op(docs.repartition(5)).collect())
    twice = odd.union(odd).withColumn("doc_id", F.when(F.col("doc_id") > 30, F.col("doc_id")))
    by = lambda r: [(v is None, v) for v in r]
    for op in (mixing.op6, training_order.op10):
        assert sorted(op(twice.repartition(3)).collect(), key=by) == sorted(op(twice.repartition(5)).collect(), key=by)


def test_wide_ids(spark, docs, tmp_path):
    path = f"file://{tmp_path}/wide"
    training_order.write_shards(docs, path, 64, 50, id_bytes=4)
    rows = training_order.digests(training_order.read_shards(spark, path, length=64, id_bytes=4), 4).collect()
    narrow = f"file://{tmp_path}/narrow"
    training_order.write_shards(docs, narrow, 64, 50)
    assert {(r.slot, r.ids_crc32) for r in rows} == {(r.slot, r.ids_crc32) for r in training_order.digests(training_order.read_shards(spark, narrow, length=64)).collect()}


def test_mixing(spark, docs):
    rows = mixing.op6(docs).collect()
    assert sorted(rows) == sorted(mixing.op6(docs).collect())
    assert sum({(r.source_size, r.target) for r in rows} and [r.size for r in rows]) == sum(len(WORD.findall(r.text)) for r in docs.select("text").collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, largest, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        target[s] = r.target
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 490)], "source string, size long")
    assert {r.source: round(r.target, 6) for r in mixing.targets(sizes).collect()} == {"a": 30.0, "b": 492.5, "c": 246.25, None: 1231.25}


def test_mixing_odd_rows(odd):
    rows = mixing.op6(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken == 0 for r in rows if r.size == 0)


def test_language_model(odd):
    want = {k * 7: t or "" for k, t in enumerate(ODD)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in want}
    deep = lm.ORDER
    counts = [defaultdict(Counter) for _ in range(deep + 1)]
    words = Counter()
    for d, t in want.items():
        if not held[d]:
            b = b"\0" * deep + t.encode() + b"\0"
            for i in range(deep, len(b)):
                for order in range(deep + 1):
                    counts[order][b[i - order : i]][b[i]] += 1
            words.update([*WORD.findall(ascii_lower(t)), None])
    for r in lm.op7(odd).collect():
        b = b"\0" * deep + want[r.doc_id].encode() + b"\0"
        total = 0.0
        for i in range(deep, len(b)):
            out: set = set()
            for order in range(deep, -1, -1):
                live = {k: v for k, v in counts[order].get(b[i - order : i], {}).items() if k not in out}
                if not live:
                    continue
                n = sum(live.values())
                if b[i] in live:
                    total += math.log10((live[b[i]] - 0.5) / n)
                    break
                total += math.log10(0.5 * len(live) / n)
                out |= set(live)
            else:
                total -= math.log10(256 - len(out))
        toks = [*WORD.findall(ascii_lower(want[r.doc_id])), None]
        n, v = sum(words.values()), len(words)
        base = sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(toks), sum(words[t] > 0 for t in toks), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)


def test_rules(docs, labels, odd, texts):
    for frame, want in both(docs, odd, texts):
        for r in rules.op8(frame, labels).collect():
            t = want[r.doc_id]
            w = WORD.findall(t)
            seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed)
            assert not (failed and r.kept)


def test_rules_tell_bad_from_good(spark):
    d, y = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.op8(d, y).join(y, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.97 and kept.get(0, 0) < 0.4


def test_line_field(spark, odd, labels):
    d, y = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = crf.op9(d, y).filter("held_out").join(y, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert all(0 <= r.score <= 1 for r in crf.op9(odd, labels).collect())


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    sizes, trans = np.array([3, 0, 1, 4]), rng.normal(size=(2, 2))
    scores = rng.normal(size=sizes.sum())
    got, pairs = crf.marginals(scores, sizes, trans)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in sizes:
        s = scores[at : at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(s[k] * y for k, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        want += [sum(x for p, x in zip(paths, w) if p[k]) for k in range(n)]
        for p, x in zip(paths, w):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_long_texts_are_counted_in_parts(monkeypatch):
    texts = ["ab" * 40, "", "abcde", "x" * 21, "The the THE end"]
    group = pa.table({"block": pa.array([0] * 5, pa.int64()), "text": texts, "held_out": [False, False, True, False, True]})
    one = lm._features(group)
    monkeypatch.setattr(lm, "COUNT_KEYS", 7)
    assert one.sort_by("key").equals(lm._features(group).sort_by("key"))
    assert sum(n for n, k in zip(one.column("n").to_pylist(), one.column("kind").to_pylist()) if k == lm.GRAM) == 80 + 1 + 1 + 21 + 1


def test_training_order(docs, texts):
    rows = training_order.op10(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    enc = tokens.encoder(tokens.default_tokenizer())
    for r in rows:
        ids = np.frombuffer(enc.ids(texts[r.doc_id]) + b"\0\0\0\0", "<u4")[r.piece * training_order.SEQUENCE :][: training_order.SEQUENCE]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    assert sorted(training_order.feistel(np.arange(1000), 1000)) == list(range(1000))


def test_fingerprints(docs, odd, texts):
    for frame, want in both(docs, odd, texts):
        ids = sorted(want)
        got = {r.doc_id: r for r in fingerprints.op1(frame).collect()}
        by_text = {}
        for k, d in enumerate(ids):
            t, n = want[d], want[ids[k - 1]]
            half = len(t) // 2
            assert got[d].n_chars == len(t)
            assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
            assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
            a, b = (set(re.findall("........", got[x].fingerprint)) for x in (d, ids[k - 1]))
            assert got[d].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for op in (fingerprints.op1, suffix_dedup.op2, minhash.op3, packing.op4, token_counts.op5, mixing.op6, lm.op7, training_order.op10):
        assert op(none).count() == 0
    for op in (rules.op8, crf.op9):
        assert op(none, labels).count() == 0
