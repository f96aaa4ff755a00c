"""Problem 8: mixing sources to target shares of the total size.

Capped water-filling: every source gets its share of the total unless that is more than ``max_repeats`` times its size;
such sources are clamped there and what they lack is spread over the others in proportion to their targets, until no
further source is clamped. A source is then repeated a whole number of times, and the fraction is a seeded sample of its
texts: a text is in the extra round if its hash lies below a threshold. The threshold is set where the tokens of the
texts below it come nearest to the fraction: tokens are summed in hash buckets, and only inside the bucket where the
fraction is reached are texts put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 65_536


def water_fill(sizes: dict[str, int], targets: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens for each source. Sources without tokens or target get none; if all are clamped, the total is not reached."""
    free = {s for s in sizes if sizes[s] > 0 and targets.get(s, 0) > 0 and caps.get(s, 0) > 0}
    got = dict.fromkeys(sizes, 0.0)
    room = float(total)
    while free:
        weight = sum(targets[s] for s in free)
        over = {s for s in free if room * targets[s] / weight >= caps[s] * sizes[s]}
        if not over:
            for s in free:
                got[s] = room * targets[s] / weight
            break
        for s in over:
            got[s] = float(caps[s] * sizes[s])
        room -= sum(got[s] for s in over)
        free -= over
    return got


def source_name(c: str = "source"):
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(""))


def plan_mix(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, wanted_tokens, whole, fraction), a row a target source.

    ``total`` is the size of the mix; by default the size of all texts of target sources. The plan is as long as the list
    of targets, and computed on the driver from one row a source.
    """
    goal = {r.source: r for r in targets.select(source_name().alias("source"), "target_share", "max_repeats").where("source is not null").collect()}
    listed = F.broadcast(targets.select(source_name().alias("source")).where("source is not null").distinct())
    have = {r.source: r for r in sized.select(source_name().alias("source"), "n_tokens").join(listed, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    sizes = {s: int(have[s].n or 0) if s in have else 0 for s in goal}
    shares = {s: float(g.target_share or 0) for s, g in goal.items()}
    got = water_fill(sizes, shares, {s: float(g.max_repeats or 0) for s, g in goal.items()}, total if total is not None else sum(sizes.values()))
    rows = []
    for s in sorted(goal):
        times = got[s] / sizes[s] if sizes[s] else 0.0
        whole = int(times + 1e-12)
        rows.append((s, shares[s], int(goal[s].max_repeats or 0), have[s].docs if s in have else 0, sizes[s], got[s], whole, max(0.0, times - whole)))
    kind = T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("n_docs", T.LongType())]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("wanted_tokens", T.DoubleType()), T.StructField("whole", T.IntegerType()), T.StructField("fraction", T.DoubleType())]
    )
    return sized.sparkSession.createDataFrame(rows, kind)


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, total: float | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, n_tokens, repeats): each text that is in the mix, and how often.

    Texts whose source is null, blank or no target, and texts of clamped-out sources, are not in the mix. Sources are the
    same if they are after trimming and lower-casing. Repeated rows are texts of their own with a common fate. The same
    seed gives the same mix.
    """
    plan = F.broadcast(plan_mix(sized, targets, total).select("source", "n_tokens", "whole", "fraction").withColumnRenamed("n_tokens", "source_tokens"))
    texts = sized.select(F.col(doc_id).alias("doc_id"), source_name().alias("source"), "n_tokens").join(plan, "source")
    texts = texts.withColumn("draw", F.xxhash64(F.lit(seed), "source", "doc_id")).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int"))
    # whole buckets first; at most BUCKETS rows a source
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = texts.where("fraction > 0").groupBy("source", "bucket", "source_tokens", "fraction").agg(F.sum("n_tokens").alias("t")).withColumn("ahead", F.coalesce(F.sum("t").over(by_bucket), F.lit(0)))
    edge = sums.withColumn("want", F.col("source_tokens") * F.col("fraction")).where("ahead <= want and want < ahead + t").groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("want") - F.col("ahead"), "bucket").alias("lack"))
    marked = texts.join(F.broadcast(edge), "source", "left")
    order = Window.partitionBy("source").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = marked.where("bucket = edge").withColumn("upto", F.sum("n_tokens").over(order))
    extra_edge = at_edge.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("lack")).cast("int")).drop("upto")
    others = marked.where("edge is null or bucket <> edge").withColumn("extra", ((F.col("fraction") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("int"))
    both = others.unionByName(extra_edge)
    return both.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")


def mix_checks(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source what has to hold of ``mixed``: capped (no text repeated too often), even (repeats of two texts differ by one at most), near (within one text of the tokens that water-filling gives)."""
    plan = plan_mix(sized, targets, total)
    texts = sized.select(F.col("doc_id"), source_name().alias("source"), "n_tokens").where("source is not null")
    most = texts.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.min("repeats").alias("least"), F.count("*").alias("n"))
    full = plan.join(got, "source", "left").join(most, "source", "left").na.fill(0, ["tokens", "most", "least", "n", "longest"])
    least = F.when(F.col("n") < F.col("n_docs"), 0).otherwise(F.col("least"))  # texts that aren't in the mix
    return full.select("source", "max_repeats", F.when(F.col("n_docs") > 0, F.col("n_docs")).alias("n_docs"), (F.col("most") <= F.col("max_repeats")).alias("capped"), (F.col("most") - least <= 1).alias("even"), (F.abs(F.col("tokens") - F.col("wanted_tokens")) <= F.col("longest")).alias("near"))


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source: target and actual share, epochs, and whether the cap holds it down."""
    plan = plan_mix(sized, targets, total)
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    joined = plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row a source
    clamped = F.col("wanted_tokens") >= F.col("n_tokens") * F.col("max_repeats")
    return joined.select("source", "target_share", F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0)).alias("actual_share"), "mixed_tokens", F.try_divide("mixed_tokens", "n_tokens").alias("epochs"), "max_repeats", clamped.alias("clamped"))
