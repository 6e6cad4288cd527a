"""Standardiser, network profile and novelty over the long view (capture_id, window, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

PARTS = 64


def quantiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...], times: str | None = None) -> DataFrame:
    """(by..., q, v): exact, linearly interpolated quantiles of each group, however large; a row counts as often as its ``times`` says.

    A sketch cuts each group's range into PARTS; counts of the parts tell in which of them the wanted
    ranks lie, and only these are ordered, value by value with its count. Null values are left out.
    A sketch depends on the order in which its pieces arrive, so it is written: counts and ordered
    values must see the same cuts.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), *([F.col(times).alias("_times")] if times else []))
    sketch = materialised(rows.groupBy(*by).agg(F.percentile_approx("_x", [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts")), "cuts")
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    counted = rows.join(sketch, by).groupBy(*by, part.alias("_part"), "_x").agg((F.sum("_times") if times else F.count("*")).alias("_c"))
    group = Window.partitionBy(*by)
    parts = counted.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    parts = parts.select(*by, "_part", "_n", (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_all"))
    at = F.col("q") * (F.col("_all") - 1)
    wanted = parts.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).select(*by, "_part", "_n", "_before", "q", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"))
    wanted = wanted.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    some = wanted.select(*by, "_part", "_before").distinct()
    near = Window.partitionBy(*by, "_part").orderBy("_x")
    ends = counted.join(some, [*by, "_part"]).withColumn("_end", F.col("_before") + F.sum("_c").over(near)).drop("_before")
    hit = ends.join(wanted.drop("_n", "_before"), [*by, "_part"]).filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    share = F.when(F.col("_rank") == F.floor("_at"), 1 - (F.col("_at") - F.floor("_at"))).otherwise(F.col("_at") - F.floor("_at"))
    return hit.groupBy(*by, "q").agg(F.sum(F.col("_x") * share).alias("v"))


def _side_by_side(found: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("q") == q, F.col("v"))).alias(n) for q, n in names.items()))


def _moments(long: DataFrame, times: str | None) -> DataFrame:
    """(feature, mean, std); a feature of one value has that value and 0, whatever sums of it round to."""
    if not times:
        return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    long = long.filter("value IS NOT NULL")
    mean = F.sum(F.col("value") * F.col(times)) / F.sum(times)
    means = long.groupBy("feature").agg(F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(mean).alias("mean"))
    off = F.col("value") - F.col("mean")
    return long.join(means, "feature").groupBy("feature", "mean").agg(F.sqrt(F.sum(off * off * F.col(times)) / F.sum(times)).alias("std"))


def fit_standardiser(long: DataFrame, times: str | None = None) -> DataFrame:
    """(feature, mean, scale, lo, hi, constant); lo and hi are on standardised values. A row counts as often as its ``times`` says."""
    ends = _side_by_side(quantiles(long, ["feature"], "value", (0.005, 0.995), times), ["feature"], {0.005: "a", 0.995: "b"})
    s = _moments(long, times).join(ends, "feature")
    scale = F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std"))
    z = lambda c: (F.col(c) - F.col("mean")) / scale
    return s.select("feature", "mean", scale.alias("scale"), (z("a") - 1).alias("lo"), (z("b") + 1).alias("hi"), (F.col("std") < 1e-8).alias("constant"))


def transform(long: DataFrame, standardiser: DataFrame) -> DataFrame:
    return long.join(standardiser, "feature").withColumn("z", (F.col("value") - F.col("mean")) / F.col("scale"))


def inverse(standardised: DataFrame) -> DataFrame:
    """Back from z, by the mean and scale beside it, to the feature's own units."""
    return standardised.withColumn("restored", F.col("z") * F.col("scale") + F.col("mean"))


def clamp(long: DataFrame, standardiser: DataFrame) -> DataFrame:
    z = F.greatest("lo", F.least("hi", "z"))
    return transform(long, standardiser).withColumn("clamped", z * F.col("scale") + F.col("mean"))


def fit_profile(long: DataFrame, least: int = 8) -> DataFrame:
    """(feature, centre, scale) by median and the largest of the robust, plain and floor scales. Features with under ``least`` windows have none."""
    half = {0.5: "centre"}
    centre = _side_by_side(quantiles(long, ["feature"], "value", (0.5,)), ["feature"], half)
    centre = centre.join(long.groupBy("feature").agg(F.stddev_pop("value").alias("std"), F.count("*").alias("n")), "feature").filter(F.col("n") >= least)
    far = long.join(centre.select("feature", "centre"), "feature").select("feature", F.abs(F.col("value") - F.col("centre")).alias("far"))
    mad = _side_by_side(quantiles(far, ["feature"], "far", (0.5,)), ["feature"], {0.5: "mad"})
    return centre.join(mad, "feature").select("feature", "centre", F.greatest(1.4826 * F.col("mad"), 0.5 * F.col("std"), 1e-3 + 0.01 * F.abs("centre")).alias("scale"))


def profile_transform(long: DataFrame, profile: DataFrame) -> DataFrame:
    return long.join(profile, "feature").withColumn("z", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("value") - F.col("centre")) / F.col("scale"))))


def outside(long: DataFrame, standardiser: DataFrame) -> DataFrame:
    z = transform(long, standardiser)
    out = F.when(F.col("constant"), F.abs(F.col("value") - F.col("mean")) > 1e-8).otherwise((F.col("z") < F.col("lo")) | (F.col("z") > F.col("hi")))
    return z.withColumn("outside", out.cast("int"))


def assess_novelty(long: DataFrame, standardiser: DataFrame) -> DataFrame:
    """Per capture: median and p95 of the windows' shares of features outside the envelope, and the verdict by the median."""
    per = outside(long, standardiser).groupBy("capture_id", "window").agg(F.avg("outside").alias("share"))
    ends = _side_by_side(quantiles(per, ["capture_id"], "share", (0.5, 0.95)), ["capture_id"], {0.5: "median_outside", 0.95: "p95_outside"})
    g = ends.join(per.groupBy("capture_id").agg(F.sum((F.col("share") > 0.10).cast("int")).alias("windows_outside")), "capture_id")
    return g.withColumn("verdict", F.when(F.col("median_outside") > 0.10, "outside").when(F.col("median_outside") > 0.03, "marginal").otherwise("inside"))


def drift_score(z: DataFrame, warn: float = 3.0) -> DataFrame:
    """Per capture: the median distance from the profile over all windows and features, and whether it is over ``warn``."""
    found = quantiles(z.select("capture_id", F.abs("z").alias("_far")), ["capture_id"], "_far", (0.5,))
    return found.select("capture_id", F.col("v").alias("drift"), (F.col("v") > warn).alias("warned"))
