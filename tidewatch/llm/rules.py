"""Quality rules: a decision list learned by sequential covering, with DataFrame functions only.

Document statistics are one row a document. Statistics of labelled documents (LABEL_ROWS of them at
most, by hash of doc_id) are binned at quantiles and counted; on these counts rules for the bad
class grow, condition by condition, on two thirds, and are pruned on the other third. The list
comes out as one ordered conditional expression.
"""

from __future__ import annotations

from collections import Counter
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

LABEL_ROWS, CUTS, MOST_RULES, LEAST_COVER = 50_000, (0.02, 0.05, 0.1, 0.2, 0.5, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.99), 16, 5
SURE = 0.9
SPACES, SYMBOLS, CAPITALS = " \t\n\x0b\x0c\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, REPEAT_PERCENT = 50, 50

#: What conditions may test: name -> expression over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))

        def marked(g: Column) -> Column:
            n = F.size(g)
            same = lambda i, j: (j >= 1) & (j <= n) & (F.get(g, j - 1)["h"] == F.get(g, i - 1)["h"])
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(g, i - 1)["i"]))

        spans = lambda p: F.aggregate(p, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
        return F.when(F.size(w) < 3, 0).otherwise(let(let(F.array_sort(windows), marked), spans))

    return let(words, of)


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """Counts for every document, behind its doc_id and ``keys``; null texts have none of anything; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *keys,
        let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        (F.char_length(text) - without(SPACES)).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without(CAPITALS).alias("n_capitals"),
        without("!").alias("n_bangs"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
    )
    return counted.select("doc_id", *keys, *(F.col(c).cast("long").alias(n) for c, n in (("w.n", "n_words"), ("word_chars",) * 2, ("n_symbols",) * 2, ("l.d", "n_dup_lines"), ("w.r", "n_repeat_words"), ("l.n", "n_lines"), ("n_capitals",) * 2, ("n_bangs",) * 2)))


def _covers(conditions: list, cell: tuple) -> bool:
    return all(cell[f] > b if up else cell[f] <= b for f, b, up in conditions)


def _grow(cells: Counter) -> list:
    """Conditions (feature, bin, above) added while they gain, by counts of (bins, bad)."""
    conditions: list = []
    while True:
        bad, good = (sum(n for (_, y), n in cells.items() if y == v) for v in (1, 0))
        if not bad or not good:
            return conditions
        best = (0.0, None)
        for f in range(len(FEATURES)):
            by: dict = {}
            for (c, y), n in cells.items():
                by.setdefault(c[f], [0, 0])[1 - y] += n
            p = q = 0
            for b in sorted(by)[:-1]:
                p, q = p + by[b][0], q + by[b][1]
                for up, (x, z) in ((False, (p, q)), (True, (bad - p, good - q))):
                    if x >= LEAST_COVER:
                        gain = x * (log2(x / (x + z)) - log2(bad / (bad + good)))
                        best = max(best, (gain, (f, b, up)), key=lambda g: g[0])
        if best[1] is None or best[0] < 1:
            return conditions
        conditions.append(best[1])
        cells = Counter({k: n for k, n in cells.items() if _covers([best[1]], k[0])})


def learn(cells: list[tuple[tuple, int, bool, int]]) -> list[list]:
    """Ordered rules of conditions from rows (bins, bad, for pruning, count)."""
    grow = Counter({(c, y): 0 for c, y, _, _ in cells})
    prune = Counter()
    for c, y, late, n in cells:
        (prune if late else grow)[c, y] += n
    rules: list = []
    while len(rules) < MOST_RULES:
        rule = _grow(+grow)

        def worth(r: list) -> tuple:
            x, z = (sum(n for (c, y), n in prune.items() if y == v and _covers(r, c)) for v in (1, 0))
            return x / (x + z) if x >= LEAST_COVER else 0.0, x

        if not rule:
            break
        cut = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r)[0] >= SURE, worth(r)[1] if worth(r)[0] >= SURE else worth(r)[0]))
        if worth(cut)[0] < SURE:
            break
        rules.append(cut)
        grow, prune = (Counter({k: n for k, n in x.items() if not _covers(cut, k[0])}) for x in (grow, prune))
    return rules


def decision_list(stats: DataFrame, labels: DataFrame) -> Column:
    """True where the learned list keeps a document; without labels it keeps all. Labels may hold nulls and repeats (the lowest counts)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_ROWS)
    rows = written(stats.join(known, "doc_id").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"), *(F.expr(e).alias(n) for n, e in FEATURES.items())), "labelled")
    cuts = [sorted(set(c or [])) for c in rows.agg(*(F.percentile_approx(n, list(CUTS), 100_000) for n in FEATURES)).first()]
    bins = [sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cut), F.lit(0)).alias(n) for n, cut in zip(FEATURES, cuts)]
    late = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    cells = rows.select("bad", late.alias("late"), *bins).groupBy("bad", "late", *FEATURES).count().collect()  # at most LABEL_ROWS rows
    names = list(FEATURES)
    rules = learn([(tuple(r[n] for n in names), r["bad"], r["late"], r["count"]) for r in cells])
    keep = F.lit(True)
    for rule in reversed(rules):
        tests = [F.expr(FEATURES[names[f]]) > cuts[f][b] if up else F.expr(FEATURES[names[f]]) <= cuts[f][b] for f, b, up in rule]
        whole = tests[0]
        for t in tests[1:]:
            whole = whole & t
        keep = F.when(whole, False).otherwise(keep)
    return keep


def judge(docs: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Statistics of each document (with its ``keys``), base_failed and kept; repeated rows stay repeated; an empty table gives none."""
    stats = written(statistics(docs, *keys), "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision_list(stats, labels))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
