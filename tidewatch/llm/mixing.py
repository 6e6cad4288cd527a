"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's rate (target words over its words) gives each of its documents floor(rate) whole copies
and a fractional one. Pivotal steps pair two fractions and randomly move mass between them until
one is 0 or 1; expectations stay, and so does the sum of words. Documents of a source are paired with others
of like size, in blocks of bounded size; each block leaves one fraction, and the blocks' remains
are combined by a reduction tree, across sizes last. Draws are hashes of the pair, keys of the rows themselves: reruns agree, whatever the files, partitions or cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, let, written

WEIGHTS, MOST_COPIES, BLOCK, SEED, EACH = (5, 2, 1), 3, 32, 11, 10_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size); weights repeat over the sources by code point, null last.

    All sizes are shared out by weight; a target stops at ``most`` times its source's size, and what
    is above is reshared by weight until none is. The table of sources is small, one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everywhere = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # sources reach their caps in the order of cap / weight; the first one that doesn't sets the level of all others
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everywhere)
    return rows.withColumn("final", final).select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(F.col("cap")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 53)) / float(1 << 53)


def _step(acc: Column, x: Column) -> Column:
    """One pivotal step of the fraction carried (a) and the next (x): words go from one to the other until one is 0 or 1."""
    a = acc["rest"]
    one = lambda c, v: F.struct(c["key"].alias("key"), c["row"].alias("row"), F.lit(v).alias("extra"))
    rest = lambda c, p: F.struct(c["size"].alias("size"), c["key"].alias("key"), c["row"].alias("row"), p.alias("p"))

    def outcome(c: Column, d: Column) -> Column:
        """c takes what it lacks from d, or all that d has."""
        lack, has = c["size"] * (1 - c["p"]), d["size"] * d["p"]
        fills = F.struct(rest(d, (has - lack) / d["size"]).alias("rest"), one(c, 1).alias("done"))
        return F.when(lack <= has, fills).otherwise(F.struct(rest(c, c["p"] + has / c["size"]).alias("rest"), one(d, 0).alias("done")))

    up = F.least(a["size"] * (1 - a["p"]), x["size"] * x["p"])
    down = F.least(a["size"] * a["p"], x["size"] * (1 - x["p"]))
    takes = _uniform(a["key"], x["key"]) * (up + down) < down  # each way with the odds that keep both expectations
    return let(F.when(takes, outcome(a, x)).otherwise(outcome(x, a)), lambda o: F.struct(o["rest"].alias("rest"), F.concat(acc["done"], F.array(o["done"])).alias("done")))


def _round_blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row per block: ``rest`` (the fraction left) and ``done`` (rows decided)."""
    blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("size", "key", "row", "p"))).alias("rows"))
    start = F.struct(F.element_at("rows", 1).alias("rest"), F.expr("CAST(array() AS array<struct<key: bigint, row: struct<doc_id: bigint, size: bigint, whole: bigint, source_size: bigint, target: double>, extra: int>>)").alias("done"))
    return blocks.select("source", "like", F.aggregate(F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))"), start, _step).alias("out"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, copies): how often the mix takes each document.

    Size is the number of words, 0 for null and empty texts, which are never taken. A null source is
    a source of its own; equal rows are documents of their own; an empty table gives none; columns
    other than doc_id, text and source are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    aim = targets(sized, weights, most).withColumnRenamed("source", "aim_source")
    rows = sized.join(aim, F.col("source").eqNullSafe(F.col("aim_source"))).withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate"))
    like = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 2)).otherwise(-1).cast("int")
    row = F.struct("doc_id", "size", "whole", "source_size", "target")
    # equal rows are alike: they are counted and told apart by number, so keys depend on no layout
    rows = rows.groupBy("source", like.alias("like"), row.alias("row"), "p").agg(F.count("*").alias("n"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(EACH))))
    rows = rows.withColumn("number", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + EACH, F.col("n")) - 1)))
    rows = rows.select("source", "row.size", "like", F.xxhash64("source", "row", "number").alias("key"), "row", "p")
    rows = written(rows, "fractions")
    decided = [rows.filter("p = 0").select("row", F.lit(0).alias("extra"))]
    rows = rows.filter("p > 0")
    level = 0
    while True:
        counts = rows.groupBy("source", "like").agg(F.count("*").alias("n"))
        most_rows = counts.agg(F.max("n")).first()[0] or 0
        if most_rows <= 1:
            break
        counts = counts.select(F.col("source").alias("s"), F.col("like").alias("l"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        dealt = rows.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("like") == F.col("l"))).withColumn("block", F.pmod(F.xxhash64(F.lit(level), "key"), F.col("blocks")))
        out = written(_round_blocks(dealt, ["source", "like", "block"]), "rounded")
        decided.append(out.select(F.explode("out.done").alias("d")).select("d.row", "d.extra"))
        rows = out.select("source", "like", "out.rest.*")
        level += 1
    # one fraction for each source and size is left: at most 130 a source
    out = written(_round_blocks(rows.withColumn("like", F.lit(0)), ["source", "like"]), "rounded")
    decided.append(out.select(F.explode("out.done").alias("d")).select("d.row", "d.extra"))
    decided.append(out.select(F.col("out.rest.row").alias("row"), F.when(_uniform(F.col("out.rest.key")) < F.col("out.rest.p"), 1).otherwise(0).alias("extra")))
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    return every.select("row.doc_id", "row.size", "row.source_size", "row.target", (F.col("row.whole") + F.col("extra")).alias("copies"))


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
