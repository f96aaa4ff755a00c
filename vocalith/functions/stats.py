"""Describe-5: greatest, least, mean, median and population deviation of a column, as aggregate columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes in output order.
SUFFIXES = ("max", "min", "mean", "med", "std")


def describe5(value: Column, prefix: str, when: Column | None = None, names: tuple[str, ...] = SUFFIXES, approximate: bool = False, unit: float | None = None, exact: int | None = None) -> list[Column]:
    """Five aggregates named ``prefix_<name>``; all null over no values (nulls are none).

    The median interpolates between the middle values. It keeps a counter per distinct value of a group;
    ``approximate`` bounds that for groups with very many distinct values. ``unit`` is applied to the results, so that sums
    of whole numbers stay exact. With ``exact`` the mean is that of decimals with so many places after the point (values
    from -10^17 to 10^17), summed exactly: it doesn't depend on the order of rows. It is rounded once: a quotient of doubles
    may fall below a mean that ends in a 5.
    """
    v = value if when is None else F.when(when, value)
    median = F.percentile_approx(v, 0.5, 10_000).cast("double") if approximate else F.percentile(v.cast("double"), 0.5)
    mean = F.avg(v) if exact is None else _decimal_mean(v, exact)
    columns = (F.max(v), F.min(v), mean, median, F.stddev_pop(v))
    return [(c.cast("double") if unit is None else c.cast("double") * unit).alias(f"{prefix}_{n}") for c, n in zip(columns, names)]


def _decimal_mean(v: Column, places: int) -> Column:
    """Sum and quotient in decimals; sums below 10^10 leave ten more places to the quotient, so that small means keep their digits."""
    total, n = F.sum(v.cast(f"decimal({18 + places},{places})")), F.count(v)
    return F.coalesce((total.try_cast(f"decimal({10 + places},{places})") / n).cast("double"), (total / n).cast("double"))


#: Groups of up to so many rows are settled by one aggregate.
SMALL = 100_000
#: Half the width, in shares of a group, of the range that is sure to hold its median: twice the error of the sketch that finds it.
HALF_WIDTH = 4e-4


def describe5_table(df: DataFrame, keys: list[str], value: Column, prefix: str, small: int = SMALL) -> DataFrame:
    """keys and the five columns of ``describe5``, for groups of any size and any number of different values.

    The median is exact without a counter per value: a first pass bounds it by a sketch, a second counts the values below
    the bounds and orders only those between them. Null and NaN values are none; a group of none has nulls, as there.
    Groups of at most ``small`` rows go the short way.
    """
    rows = df.select(*keys, value.cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    first = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile_approx("v", [0.5 - HALF_WIDTH, 0.5 + HALF_WIDTH], 5_000).alias("q"))
    # beyond the sketch's own error the bounds move out by one more of it; in small groups they are the ends
    wide = first.withColumn("lo", F.when(F.col("n") <= small, F.col("min")).otherwise(F.col("q")[0])).withColumn("hi", F.when(F.col("n") <= small, F.col("max")).otherwise(F.col("q")[1]))
    held = _with(rows.where("v is not null"), wide.select(*keys, "lo", "hi"), keys)
    # values below the range are one row, those in it are counted
    slot = F.when(F.col("v") < F.col("lo"), F.lit(float("-inf"))).when(F.col("v") <= F.col("hi"), F.col("v"))
    counted = held.withColumn("s", slot).where("s is not null").groupBy(*keys, "s").agg(F.count("*").alias("c"))
    ranked = _with(counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("s"))), first.select(*keys, "n"), keys)
    low, high = F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("s"))), F.min(F.when(2 * F.col("upto") > F.col("n"), F.col("s")))
    out = _with(first, ranked.groupBy(*keys).agg(((low + high) / 2).alias("med")), keys, "left")
    return out.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in SUFFIXES))


def _with(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of ``more``; null keys meet."""
    named = more.withColumnsRenamed({k: f"_with_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_with_{k}")) for k in keys))
    return rows.join(named, on, how).drop(*(f"_with_{k}" for k in keys))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
