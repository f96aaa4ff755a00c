"""Problem 6: percentiles of very large numeric columns by merging centroid digests.

A digest of a group is a table of centroids (mean, weight, least, most). It is made by sorting the values, mapping each
value's quantile through a scale function that is steep at both ends, and grouping values with one integer part of it:
clusters are small in the tails and large in the middle. Digests of days, deliveries or salts are merged by sorting the
centroids of all and clustering them again by the same function. Everything is windows and aggregates inside the JVM.
A second pass over the values counts how many lie below each answer, which certifies the rank error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.session import cut_lineage

#: Size of a digest: about delta / 2 centroids.
DELTA = 200
#: Rows of a group that one task sorts when a digest is built; larger groups are built in parts.
PART_ROWS = 2_000_000
#: Digests of one group that one task merges at once.
FAN_IN = 512


def rank_bound(levels: int, delta: int = DELTA) -> float:
    """The greatest rank error of an answer from digests that were clustered ``levels`` times (1: built; 2: built and merged).

    A cluster in the middle spans pi / delta of the ranks, and an answer lies within half of it, pi / (2 delta); each
    further clustering may move it by as much again.
    """
    return levels * math.pi / (2 * delta)


def scale(q: Column, delta: int) -> Column:
    """The scale function delta/(2 pi) asin(2q - 1)."""
    return F.lit(delta / (2 * math.pi)) * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1)))


def build(df: DataFrame, keys: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """keys, cluster, mean, weight, least, most. Null and NaN values are left out; ties and repeated values all count; groups without values have no digest."""
    clean = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    # equal values are one weighted row after the map-side half of this aggregate
    weighed = clean.groupBy(*keys, "v").agg(F.count("*").cast("double").alias("weight"))
    return _cluster(weighed.select(*keys, F.col("v").alias("mean"), "weight", F.col("v").alias("least"), F.col("v").alias("most")), keys, delta)


def merge(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Digests of finer keys -> digests of ``keys``. Merging keeps the total weight; merging empty digests gives none."""
    return _cluster(digests.select(*keys, "mean", "weight", "least", "most"), keys, delta)


def _cluster(points: DataFrame, keys: list[str], delta: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("mean", "least", "most", "weight")
    below = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    # a value heavier than the widest cluster stays alone, so that its centroid is a step; its neighbours on both sides can't share a cluster
    alone = F.when((F.col("least") == F.col("most")) & (F.col("weight") > total * (math.pi / (2 * delta))), F.col("least"))
    placed = points.withColumn("q", (below + F.col("weight") / 2) / total).withColumn("cluster", F.floor(scale(F.col("q"), delta)).cast("int")).withColumn("alone", alone)
    placed = placed.groupBy(*keys, "cluster", "alone").agg(F.when(F.min("least") == F.max("most"), F.min("least")).otherwise(F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("least").alias("least"), F.max("most").alias("most"))
    return placed.drop("alone")


def quantiles(digests: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys, prob, estimate, n: linear between the centres of neighbouring centroids, exact least and most at the ends.

    A centroid of several equal values is a step: every rank within it gives its value, and ranks beside it none of it.
    """
    w = Window.partitionBy(*keys).orderBy("mean", "cluster")
    below = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    step = (F.col("least") == F.col("most")) & (F.col("weight") > 1)
    at = digests.withColumn("n", total).withColumn("below", below)
    at = at.withColumn("from", F.when(step, F.col("below")).otherwise(F.col("below") + F.col("weight") / 2)).withColumn("to", F.when(step, F.col("below") + F.col("weight")).otherwise(F.col("below") + F.col("weight") / 2))
    at = at.withColumn("pto", F.lag("to").over(w)).withColumn("pmean", F.lag("mean").over(w)).withColumn("nto", F.lead("to").over(w))
    asked = at.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs)))).withColumn("rank", F.col("prob") * F.col("n"))
    first, final = F.col("pto").isNull(), F.col("nto").isNull()
    covers = (first | (F.col("rank") >= F.col("pto"))) & (F.col("rank") < F.col("to"))
    tail = final & (F.col("rank") >= F.col("to"))
    tail_share = F.when(F.col("n") > F.col("to"), (F.col("rank") - F.col("to")) / (F.col("n") - F.col("to"))).otherwise(F.lit(0.0))
    low, start = F.when(first, F.col("least")).otherwise(F.col("pmean")), F.coalesce("pto", F.lit(0.0))
    estimate = (
        F.when(tail, F.col("mean") + tail_share * (F.col("most") - F.col("mean")))
        .when((F.col("rank") == F.col("from")) & (F.col("from") == start), (low + F.col("mean")) / 2)  # just between two steps
        .when(F.col("rank") >= F.col("from"), F.col("mean"))
        .otherwise(low + (F.col("rank") - start) / (F.col("from") - start) * (F.col("mean") - low))
    )
    return asked.where(covers | tail).select(*keys, "prob", estimate.alias("estimate"), F.col("n").cast("bigint").alias("n"))


def merge_parts(digests: DataFrame, keys: list[str], parts: int, delta: int = DELTA) -> tuple[DataFrame, int]:
    """Digests of (keys, part) -> digests of keys, and how often they were clustered: at most FAN_IN parts meet in one task."""
    levels = 2
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        digests = merge(digests.withColumn("part", F.pmod("part", F.lit(parts))), [*keys, "part"], delta)
        levels += 1
    return merge(digests, keys, delta), levels


def parts_for(df: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> int:
    """Into how many parts groups are split, so that the largest has about ``part_rows`` rows a part: one counting pass, one number."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(most or 0) // part_rows))


def certify(df: DataFrame, keys: list[str], value: str, answers: DataFrame, salts: int = 8) -> DataFrame:
    """``answers`` with n_below, n_upto and rank_error: how far prob lies from the share of values below (or up to) the estimate.

    The second pass: equal values are counted map-side, and the answers, a few rows a group, are repeated per salt.
    """
    counted = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy(*keys, "v").agg(F.count("*").alias("c")).withColumn("salt", F.pmod(F.hash("v"), F.lit(salts)))
    probes = answers.groupBy(*keys).agg(F.collect_list(F.struct("prob", "estimate")).alias("probes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = counted.join(probes, [*keys, "salt"]).select(*keys, "v", "c", F.explode("probes").alias("p"))
    ranks = hit.groupBy(*keys, F.col("p.prob").alias("prob")).agg(F.sum(F.when(F.col("v") < F.col("p.estimate"), F.col("c")).otherwise(0)).alias("n_below"), F.sum(F.when(F.col("v") <= F.col("p.estimate"), F.col("c")).otherwise(0)).alias("n_upto"))
    error = F.greatest(F.lit(0.0), F.col("n_below") / F.col("n") - F.col("prob"), F.col("prob") - F.col("n_upto") / F.col("n"))
    return answers.join(ranks, [*keys, "prob"]).withColumn("rank_error", error)


def usable(c: str = "confidence") -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0, 1)


def confidences(recognition: DataFrame) -> DataFrame:
    """Rows with a feature and a usable confidence."""
    return recognition.where(F.col("feature_id").isNotNull() & usable())


def confidence_digests(rows: DataFrame, keys: list[str], parts: int, delta: int = DELTA) -> DataFrame:
    """Digests of confidences per ``keys`` and part, ready for ``merge_parts``: a feature with a third of all rows is built in many parts."""
    return build(rows.select(*keys, "confidence", F.pmod(F.xxhash64("result_id"), F.lit(parts)).cast("int").alias("part")), [*keys, "part"], "confidence", delta)


def exact_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: by counting equal values and running sums, for the few groups that need it."""
    counted = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    at = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    # the two middle values: the first ones with half of all rows, and with more than half, up to them
    return at.groupBy(*keys).agg(((F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("v"))) + F.min(F.when(2 * F.col("upto") > F.col("n"), F.col("v")))) / 2).alias("median"))


def low_median_features(recognition: DataFrame, least_rows: int = 30, below: float = 0.5, delta: int = DELTA) -> DataFrame:
    """feature_id whose median is below ``below``: certified by counting around the estimate; where that leaves it open, by the exact median."""
    good = confidences(recognition)
    rows = good.select("feature_id", "confidence")
    parts = parts_for(rows, ["feature_id"])
    merged, levels = merge_parts(confidence_digests(good, ["feature_id"], parts, delta), ["feature_id"], parts, delta)
    margin = rank_bound(levels, delta)
    answers = cut_lineage(quantiles(merged, ["feature_id"], [0.5 - margin, 0.5 + margin]).where(F.col("n") >= least_rows))
    known = certify(rows, ["feature_id"], "confidence", answers, max(8, parts))
    under = (F.col("prob") > 0.5) & (F.col("estimate") < below) & (2 * F.col("n_upto") > F.col("n"))
    over = (F.col("prob") < 0.5) & (F.col("estimate") >= below) & (2 * F.col("n_below") < F.col("n"))
    verdict = cut_lineage(known.groupBy("feature_id").agg(F.max(under).alias("low"), F.max(over).alias("high")))
    unsure = rows.join(verdict.where("not low and not high").select("feature_id"), "feature_id", "left_semi")
    settled = exact_medians(unsure, ["feature_id"], "confidence").where(F.col("median") < below)
    return verdict.where("low").select("feature_id").unionByName(settled.select("feature_id"))
