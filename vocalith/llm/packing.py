"""Problem 7: filling containers of fixed capacity with texts of varying length.

Harmonic packing. A text of class k takes more than 1/(k+1) and at most 1/k of a container, so k of them always fit: a
bin of class k is filled with exactly k texts of one size, wherever they are. That alone leaves up to half of a bin of
class 1 empty, so the classes are refined: a plan over the *histogram of sizes* (at most ``capacity`` rows, however many
texts there are) sets out how many bins of each kind there are, and which smaller sizes top up their rest. Then each text
finds its bin by its size and its rank among the texts of that size. Ranks need no global sort: texts of a size are
numbered within salts, and each salt starts where the ones before end. ``harmonic`` is the method without the plan.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first_rank, n_items, per_bin, first_bin): which ranks of a size go to which run of bins.

    Sizes are taken from large to small. Size s opens bins of its class k = capacity // s with k texts each; what is left
    of such a run of equal bins is topped up with the largest sizes that still fit, each as often as it fits.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(left)
    taken = dict.fromkeys(sizes, 0)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def fill(first: int, count: int, room: int, limit: int) -> None:
        """Tops up ``count`` equal bins, numbered from ``first``, with sizes of at most ``limit``."""
        runs = [(first, count, room, limit)]
        while runs:
            at, many, free, most = runs.pop()
            j = bisect_right(sizes, min(free, most)) - 1
            while j >= 0 and not left[sizes[j]]:
                j -= 1
            if j < 0 or many <= 0:
                continue
            s = sizes[j]
            each = free // s
            full = min(many, left[s] // each)
            if full:
                out.append((s, taken[s], full * each, each, at))
                taken[s] += full * each
                left[s] -= full * each
                if free - full * 0 - each * s > 0:
                    runs.append((at, full, free - each * s, s - 1))
            rest = left[s]
            if full < many and rest:  # fewer than one bin takes
                out.append((s, taken[s], rest, rest, at + full))
                taken[s] += rest
                left[s] = 0
                runs.append((at + full, 1, free - rest * s, s - 1))
                full += 1
            if full < many:
                runs.append((at + full, many - full, free, s - 1))

    for s in reversed(sizes):
        n = left[s]
        if not n:
            continue
        k = capacity // s
        full, rest = divmod(n, k)
        left[s] = 0
        if full:
            out.append((s, taken[s], full * k, k, bins))
            taken[s] += full * k
            fill(bins, full, capacity - k * s, s - 1)
            bins += full
        if rest:
            out.append((s, taken[s], rest, rest, bins))
            taken[s] += rest
            fill(bins, 1, capacity - rest * s, s - 1)
            bins += 1
    return out


_plan_type = T.StructType([T.StructField(n, T.LongType()) for n in ("capacity_id", "size", "first_rank", "n_items", "per_bin", "first_bin")])


#: Rows that one task ranks; sizes and classes with more are ranked in salts.
SALT_ROWS = 1_000_000


def _each(sized: DataFrame, capacities: DataFrame, doc_id: str) -> DataFrame | None:
    """A row a text and capacity; n_full pieces of it fill a container of their own. None without capacities."""
    sizes = capacities.select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).where("capacity_tokens > 0").collect()  # a fixed list
    if not sizes:
        return None
    caps = F.array(*(F.struct(F.lit(r.capacity_id).alias("capacity_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity_tokens")) for r in sizes))
    each = sized.select(F.col(doc_id).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.explode(caps).alias("c")).select("doc_id", "n_tokens", "c.*")
    return each.withColumn("n_full", F.expr("n_tokens div capacity_tokens")).withColumn("size", F.col("n_tokens") - F.col("n_full") * F.col("capacity_tokens"))


def histogram(items: DataFrame) -> DataFrame:
    """How many rests (pieces smaller than the container) there are of each size: at most the sum of the capacities."""
    return items.where("size > 0").groupBy("capacity_id", "capacity_tokens", "size").agg(F.count("*").alias("n"))


def _salted(items: DataFrame, salts: int) -> DataFrame:
    return items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))


def _ahead(counts: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the smaller salts and classes of a group; ``counts`` has a row a salt and class."""
    order = [c for c in counts.columns if c not in (*by, value)]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))


def _full_pieces(items: DataFrame, first: DataFrame, salts: int) -> DataFrame:
    """Pieces that fill a container: numbered a text at a time, from ``first`` (capacity_id, first) on. No piece is ranked by itself."""
    full = _salted(items.where("n_full > 0"), salts)
    starts = _ahead(full.groupBy("capacity_id", "salt").agg(F.sum("n_full").alias("n")), ["capacity_id"], "n", "start").drop("n")
    within = Window.partitionBy("capacity_id", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("ahead", F.coalesce(F.sum("n_full").over(within), F.lit(0))).join(starts, ["capacity_id", "salt"]).join(first, "capacity_id")
    each = placed.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)))
    return each.select("capacity_id", (F.col("first") + F.col("start") + F.col("ahead") + F.col("piece_no")).cast("bigint").alias("bin_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("start_token"), F.col("capacity_tokens").alias("n_tokens"))


def _rests(placed: DataFrame, bin_id) -> DataFrame:
    return placed.select("capacity_id", bin_id.cast("bigint").alias("bin_id"), "doc_id", F.col("n_full").alias("piece_no"), (F.col("n_full") * F.col("capacity_tokens")).alias("start_token"), F.col("size").alias("n_tokens"))


def _without_tokens(items: DataFrame) -> DataFrame:
    return _rests(items.where("n_tokens = 0"), F.lit(None))


def _nothing(sized: DataFrame) -> DataFrame:
    return sized.sparkSession.createDataFrame([], "capacity_id int, bin_id bigint, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint")


def harmonic(sized: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", salts: int | None = None) -> DataFrame:
    """Plain harmonic packing, the columns of ``pack``: k texts of class k a bin, each class and salt filled by itself.

    A class takes texts of more than 1/(k+1) and at most 1/k of a container. At most one bin a class and salt is left with
    fewer than k.
    """
    items = _each(sized, capacities, doc_id)
    if items is None:
        return _nothing(sized)
    classed = items.where("size > 0").withColumn("k", F.expr("capacity_tokens div size"))
    if salts is None:
        most = classed.groupBy("capacity_id", "k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        salts = max(1, -(-most // SALT_ROWS))
    rests = _salted(classed, salts)
    counts = rests.groupBy("capacity_id", "k", "salt").agg(F.count("*").alias("n")).withColumn("bins", F.expr("(n + k - 1) div k")).drop("n")
    starts = _ahead(counts, ["capacity_id"], "bins", "start").drop("bins")
    within = Window.partitionBy("capacity_id", "k", "salt").orderBy("doc_id")
    placed = rests.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["capacity_id", "k", "salt"])
    first = _capacity_ids(capacities).join(counts.groupBy("capacity_id").agg(F.sum("bins").alias("first")), "capacity_id", "left").na.fill(0, ["first"])
    filled = _rests(placed, F.col("start") + F.expr("rank div k"))
    return filled.unionByName(_full_pieces(items, first, salts)).unionByName(_without_tokens(items))


def _capacity_ids(capacities: DataFrame) -> DataFrame:
    return capacities.where("capacity_tokens > 0").select("capacity_id").distinct()


def pack(sized: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", salts: int | None = None) -> DataFrame:
    """(capacity_id, bin_id, doc_id, piece_no, start_token, n_tokens): every text in one container of each capacity.

    Texts without tokens (or with null) take no room and have bin_id null. Repeated rows are texts of their own. Empty input
    gives no rows. The histogram and the plan are bounded by the capacities; only they are collected. A text larger than a
    container is cut into full pieces, which are bins of their own, and a rest, which is packed as other texts are.
    """
    items = _each(sized, capacities, doc_id)
    if items is None:
        return _nothing(sized)
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in histogram(items).collect():  # at most the sum of the capacities
        counts.setdefault((r.capacity_id, r.capacity_tokens), {})[r["size"]] = r.n
    if salts is None:
        salts = max(1, -(-max((n for h in counts.values() for n in h.values()), default=0) // SALT_ROWS))
    plan = [(c, *row) for (c, tokens), h in sorted(counts.items()) for row in plan_bins(h, tokens)]
    spark = sized.sparkSession
    runs = spark.createDataFrame(pd.DataFrame(plan, columns=_plan_type.names).astype("int64"), _plan_type) if plan else spark.createDataFrame([], _plan_type)

    rests = _salted(items.where("size > 0"), salts)
    starts = _ahead(rests.groupBy("capacity_id", "size", "salt").agg(F.count("*").alias("n")), ["capacity_id", "size"], "n", "start")
    # each salt gets only the runs that its ranks reach into
    reach = (F.col("first_rank") < F.col("start") + F.col("n")) & (F.col("start") < F.col("first_rank") + F.col("n_items"))
    near = starts.join(runs, ["capacity_id", "size"]).where(reach).groupBy("capacity_id", "size", "salt").agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("first_rank", "n_items", "per_bin", "first_bin"))).alias("runs"))
    within = Window.partitionBy("capacity_id", "size", "salt").orderBy("doc_id")
    found = rests.withColumn("rank", F.row_number().over(within) - 1).join(near, ["capacity_id", "size", "salt"]).withColumn("at", F.col("start") + F.col("rank"))
    hit = F.expr("element_at(filter(runs, x -> x.first_rank <= at and at < x.first_rank + x.n_items), 1)")
    filled = _rests(found.withColumn("run", hit), F.col("run.first_bin") + F.expr("(at - run.first_rank) div run.per_bin"))
    bins = runs.groupBy("capacity_id").agg(F.max(F.expr("first_bin + (n_items + per_bin - 1) div per_bin")).alias("first"))
    first = _capacity_ids(capacities).join(bins, "capacity_id", "left").na.fill(0, ["first"])
    return filled.unionByName(_full_pieces(items, first, salts)).unionByName(_without_tokens(items))


def packing_checks(packed: DataFrame, sized: DataFrame, capacities: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per capacity what has to hold: all texts there once, none lost or cut without need, no bin over its capacity."""
    cap = capacities.select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    texts = sized.groupBy(F.col(doc_id).alias("doc_id")).agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("want"))
    got = packed.join(cap, "capacity_id").groupBy("capacity_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count("bin_id").alias("placed"))
    need = F.greatest(F.lit(1), F.expr("(want + capacity_tokens - 1) div capacity_tokens"))
    held = got.join(texts, "doc_id", "full").groupBy("capacity_id").agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("placed") == 0, 1)).alias("n_empty"), F.count(F.when(~F.col("got").eqNullSafe(F.col("want")), 1)).alias("n_lost"), F.count(F.when(F.col("pieces") != need, 1)).alias("n_cut"))
    bins = packed.where("bin_id is not null").groupBy("capacity_id", "bin_id").agg(F.sum("n_tokens").alias("used")).join(cap, "capacity_id").groupBy("capacity_id").agg(F.count(F.when(F.col("used") > F.col("capacity_tokens"), 1)).alias("n_over"))
    return held.join(bins, "capacity_id", "left").na.fill(0, ["n_over"])


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: bins, texts, tokens, and the share of room that is filled."""
    sums = packed.groupBy("capacity_id").agg(F.countDistinct("bin_id").alias("n_bins"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    fill = F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))
    return sums.join(F.broadcast(capacities), "capacity_id").select("capacity_id", "capacity_tokens", "n_bins", "n_pieces", "n_tokens", fill.alias("filled"))
