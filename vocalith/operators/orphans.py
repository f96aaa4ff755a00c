"""Problem 5: references to records that do not exist, are deleted or arrive later.

Parent and child keys are brought into one long form of events (key, time, what) and grouped by key. The state of a key
at a moment is a running sum over its events: +1 when a parent row is loaded, -1 when it is deleted. As one key may hold
a third of all rows, the sum has two levels: the events of a (key, month) are added up first, with map-side combining;
the sums of the months before are carried into each month as one more event; and within a month the child events of a
key are spread over salts, each with a copy of the month's parent events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.keys import clean_key


#: Child rows of a key and month that one task orders; more are spread over salts.
SALT_ROWS = 200_000


def _parent_events(parents: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """Two events a row at most. A row deleted before or when it was loaded was never alive; one without load time neither."""
    rows = parents.select(clean_key(key).alias("k"), F.col(loaded).alias("at"), F.col(deleted).alias("gone")).where("k is not null")
    alive = F.col("at").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("at")))
    events = F.filter(
        F.array(
            F.struct(F.col("at").alias("at"), F.when(alive, 1).otherwise(0).alias("d"), F.when(F.col("at").isNotNull(), 1).otherwise(0).alias("seen"), F.lit(1).alias("parents"), F.when(F.col("at").isNull(), 1).otherwise(0).alias("timeless")),
            F.when(alive & F.col("gone").isNotNull(), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("seen"), F.lit(0).alias("parents"), F.lit(0).alias("timeless"))),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("k", F.explode(events).alias("x")).select("k", "x.*")


def orphan_rows(children: dict[str, tuple[DataFrame, str, str, str]], parents: DataFrame, key: str = "call_id", loaded: str = "loaded_at", deleted: str = "deleted_at", salts: int | None = None) -> DataFrame:
    """(table_name, row_id, period_month, reason) of each child row whose key no living parent row has at its time.

    children: table name -> (rows, id column, key column, time column). Rows with a null or blank key refer to nothing
    and are left out. A child without a time has period_month null and finds no living parent: ``missing`` if the key has
    no parent row at all, else ``deleted``. Repeated rows are each reported; empty tables give no rows.
    """
    tables = [rows.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), clean_key(fk).alias("k"), F.col(at).alias("at")) for name, (rows, row_id, fk, at) in children.items()]
    child = reduce(DataFrame.unionByName, tables).where("k is not null").select("k", "at", *(F.lit(0).alias(c) for c in ("d", "seen", "parents", "timeless")), "table_name", "row_id", F.lit(1).alias("turn"))
    if salts is None:  # one counting pass, one number
        most = child.groupBy("k", F.date_trunc("month", F.col("at")).alias("month")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        salts = max(1, -(-(most or 0) // SALT_ROWS))
    parent = _parent_events(parents, key, loaded, deleted).select("k", "at", "d", "seen", "parents", "timeless", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("bigint").alias("row_id"), F.lit(0).alias("turn"))
    events = parent.unionByName(child).withColumn("month", F.date_trunc("month", F.col("at")))
    # level one: sums of each (key, month); no month sorts first and carries nothing
    monthly = events.groupBy("k", "month").agg(*(F.sum(c).alias(c) for c in ("d", "seen", "parents", "timeless")), F.max("turn").alias("asked"))
    w = Window.partitionBy("k").orderBy(F.col("month").asc_nulls_first())
    past, all_of = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    carried = (
        monthly.withColumn("d", F.coalesce(F.sum("d").over(past), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum("seen").over(past), F.lit(0)))
        .withColumn("parents", F.sum("parents").over(all_of))
        .withColumn("timeless", F.sum("timeless").over(all_of))
        .where("asked = 1")
        .select("k", "month", F.lit(None).cast("timestamp").alias("at"), "d", "seen", "parents", "timeless", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("bigint").alias("row_id"), F.lit(-1).alias("turn"))
    )
    # level two: the running state within a (key, month, salt)
    own = parent.withColumn("month", F.date_trunc("month", F.col("at"))).where("month is not null").withColumn("parents", F.lit(0)).withColumn("timeless", F.lit(0))
    copied = carried.unionByName(own.select(carried.columns)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = child.withColumn("month", F.date_trunc("month", F.col("at"))).withColumn("salt", F.pmod(F.hash("table_name", "row_id"), F.lit(salts)))
    run = Window.partitionBy("k", "month", "salt").orderBy(F.col("turn") >= 0, F.col("at"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    state = copied.unionByName(asked.select(copied.columns)).select("table_name", "row_id", "turn", "at", *(F.sum(c).over(run).alias(c) for c in ("d", "seen", "parents", "timeless")))
    reason = F.when(F.col("parents") == 0, "missing").when(F.col("at").isNotNull() & (F.col("seen") == 0) & (F.col("timeless") == 0), "late").otherwise("deleted")
    return state.where("turn = 1 and d <= 0").select("table_name", "row_id", F.date_format("at", "yyyy-MM").alias("period_month"), reason.alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per child table, period and reason."""
    return orphans.groupBy("table_name", "period_month", "reason").agg(F.count("*").alias("n_rows"))


def orphan_keys(children: dict[str, tuple[DataFrame, str, str, str]], parents: DataFrame, key: str = "call_id") -> DataFrame:
    """(table_name, k, n_rows) of keys that no parent row has: tagged keys in long form, grouped, kept if no parent flag is among them."""
    tables = [rows.select(clean_key(fk).alias("k"), F.lit(name).alias("table_name"), F.lit(0).alias("is_parent")) for name, (rows, _, fk, _) in children.items()]
    tagged = reduce(DataFrame.unionByName, [*tables, parents.select(clean_key(key).alias("k"), F.lit("").alias("table_name"), F.lit(1).alias("is_parent"))]).where("k is not null")
    counted = tagged.groupBy("k", "table_name").agg(F.count("*").alias("n_rows"), F.max("is_parent").alias("is_parent"))
    return counted.withColumn("known", F.max("is_parent").over(Window.partitionBy("k"))).where("known = 0").select("table_name", F.col("k").alias("key"), "n_rows")
