"""Problem 2: overlapping, nested and touching intervals per entity as continuous periods, and the gaps between them.

Two levels, so that one entity with a huge number of intervals is no single task. Intervals are clipped into time shards
(the whole shards inside a long interval become one *run*, never one row a shard) and the pieces of each (entity, shard)
are merged locally. Inner pieces and inner gaps of a shard are final then. Only its first and last piece, which may touch
the shard's boundaries, and the runs are stitched and coalesced per entity: at most two rows a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.keys import clean_key
from vocalith.functions.literals import with_word_list

#: Width of a time shard in ticks of 100 ns: five minutes, so that a file with very many intervals is several tasks.
SHARD_TICKS = 3_000_000_000


def _shard_of(at: str, width: int) -> str:
    return f"(({at}) div {width} - case when ({at}) % {width} < 0 then 1 else 0 end)"


def clip(rows: DataFrame, shard: int) -> DataFrame:
    """(k, s, e) -> (k, p, run, s, e): head and tail in their shards, and the run of whole shards between them."""
    cut = rows.withColumn("a", F.expr(_shard_of("s", shard))).withColumn("b", F.expr(_shard_of("e - 1", shard)))
    pieces = F.expr(
        f"""case when a = b then array(named_struct('p', a, 'run', false, 's', s, 'e', e))
            else filter(array(named_struct('p', a, 'run', false, 's', s, 'e', (a + 1) * {shard}),
                              named_struct('p', b, 'run', false, 's', b * {shard}, 'e', e),
                              named_struct('p', a + 1, 'run', true, 's', (a + 1) * {shard}, 'e', b * {shard})), x -> x.s < x.e) end"""
    )
    return cut.select("k", F.explode(pieces).alias("x")).select("k", "x.p", "x.run", "x.s", "x.e")


def merge_local(clipped: DataFrame) -> DataFrame:
    """Merged pieces of each (entity, shard), as (k, p, tag, s, e): final periods and gaps, edge pieces and runs."""
    # pieces with one start become one row in the map-side half of this aggregate, however many copies there are
    firsts = clipped.groupBy("k", "p", "run", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("k", "p", "run").orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = firsts.withColumn("before", reach).withColumn("n", F.sum(F.when(F.col("before") >= F.col("s"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy("k", "p", "run", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    by_n = Window.partitionBy("k", "p", "run").orderBy("n")
    near = pieces.withColumn("prev_e", F.lag("e").over(by_n)).withColumn("next_s", F.lead("s").over(by_n))
    tags = F.expr(
        """filter(array(
             case when run then named_struct('tag', 'run', 's', s, 'e', e)
                  when prev_e is null or next_s is null then named_struct('tag', 'edge', 's', s, 'e', e)
                  else named_struct('tag', 'period', 's', s, 'e', e) end,
             case when not run and next_s is not null then named_struct('tag', 'gap', 's', e, 'e', next_s) end), x -> x is not null)"""
    )
    return near.select("k", "p", F.explode(tags).alias("x")).select("k", "p", "x.tag", "x.s", "x.e")


def stitch(edges: DataFrame) -> DataFrame:
    """Edge pieces and runs of each entity -> (k, p, tag, s, e): periods, gaps, and the shards that a run covers."""
    w = Window.partitionBy("k").orderBy("s", F.col("tag").desc(), "e")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        edges.withColumn("before", F.max("e").over(past))
        .withColumn("covered", (F.col("tag") == "edge") & F.coalesce(F.max(F.when(F.col("tag") == "run", F.col("e"))).over(past) >= F.col("e"), F.lit(False)))
        .withColumn("opens", F.coalesce(F.col("before") < F.col("s"), F.lit(True)))
        .withColumn("began", F.max(F.when(F.col("opens"), F.col("s"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("prev_began", F.lag("began").over(w))
        .withColumn("same", F.coalesce((F.lag("p").over(w) == F.col("p")) & (F.lag("tag").over(w) == "edge") & (F.col("tag") == "edge"), F.lit(False)))
        .withColumn("final", F.lead("s").over(w).isNull())
    )
    out = F.expr(
        """filter(array(
             case when opens and before is not null then named_struct('tag', 'period', 's', prev_began, 'e', before) end,
             case when opens and before is not null and not same then named_struct('tag', 'gap', 's', before, 'e', s) end,
             case when final then named_struct('tag', 'period', 's', began, 'e', greatest(before, e)) end,
             case when covered then named_struct('tag', 'covered', 's', s, 'e', e) end), x -> x is not null)"""
    )
    return rows.select("k", "p", F.explode(out).alias("x")).select("k", "p", "x.tag", "x.s", "x.e")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, shard: int = SHARD_TICKS) -> DataFrame:
    """(key, kind 'period'|'gap', start_tick, end_tick).

    Rows with a null key, a null end or no positive length are left out; equal rows count once; touching intervals are
    one period. A gap lies between two successive periods of a key. Negative times are allowed. Empty input gives no rows.
    """
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("k is not null and s < e")
    local = merge_local(clip(rows, shard))
    stitched = stitch(local.where("tag in ('edge', 'run')"))
    covered = stitched.where("tag = 'covered'").select("k", "p").distinct()
    inner = local.where("tag in ('period', 'gap')").join(covered, ["k", "p"], "left_anti")
    both = inner.select("k", "tag", "s", "e").unionByName(stitched.where("tag in ('period', 'gap')").select("k", "tag", "s", "e"))
    return both.select(F.col("k").alias(key), F.col("tag").alias("kind"), F.col("s").alias("start_tick"), F.col("e").alias("end_tick"))


def speech_intervals(recognition: DataFrame) -> DataFrame:
    """(audio_file_id, s, e) of segments and of the words in good word timings. Words inside their own segment add nothing and are dropped in the row."""
    read = recognition.select(clean_key("audio_file_id").alias("audio_file_id"), "offset", "duration", "word_timing").where("audio_file_id is not null")
    words = with_word_list(read, "word_timing", "_w", "_why")
    ends = words.select(
        "audio_file_id",
        F.expr("case when duration > 0 then named_struct('s', offset, 'e', try_add(offset, duration)) end").alias("own"),
        F.expr(
            """transform(coalesce(_w, cast(array() as array<variant>)), x -> named_struct('s', try_variant_get(x, '$.Offset', 'bigint'),
               'e', try_add(try_variant_get(x, '$.Offset', 'bigint'), try_variant_get(x, '$.Duration', 'bigint'))))"""
        ).alias("spoken"),
    )
    spans = F.expr("concat(array(own), filter(spoken, x -> x.s < x.e and not coalesce(x.s >= own.s and x.e <= own.e, false)))")
    return ends.select("audio_file_id", F.explode(spans).alias("x")).select("audio_file_id", "x.s", "x.e").where("s < e")


def speech_periods(recognition: DataFrame, shard: int = SHARD_TICKS) -> DataFrame:
    """Continuous periods of speech of each audio file and the gaps between them."""
    return merge_intervals(speech_intervals(recognition), "audio_file_id", "s", "e", shard)
