"""Features of hypotheses at every level of grouping: each hypothesis by itself, then the mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.operators import features
from vocalith.operators import segments as sg
from vocalith.plans.pipeline import extract


def transcript_features(hypotheses: DataFrame, meta: DataFrame | None, level: str, name: str, **settings) -> DataFrame:
    """The level's keys and the feature set ``name``, mean over hypotheses.

    hypotheses: call_id, hyp_no, segment_id (``a_b_<start>_<end>``), text. meta: call_id, subject_id, week, day and, if there,
    time, which order calls in a group. Calls without metadata are left out, unless the level needs none and meta is None.
    """
    rows = sg.at_level(hypotheses, meta, level)
    keys = sg.LEVEL_KEYS[level]
    start = F.try_element_at(F.split("segment_id", "_"), F.lit(-2)).try_cast("bigint")
    when = [F.col(c).cast("string").alias(c) for c in ("day", "time") if c in rows.columns]
    named = F.to_json(F.struct(*keys, "hyp_no"), {"ignoreNullFields": "false"})
    segments = rows.select(named.alias("id"), F.struct(*when, "call_id").alias("ord"), F.coalesce(start, F.lit(0)).alias("tie"), "text", F.col("text").alias("text_basic"))
    made = extract(segments, (name,), **settings)[name]
    names = [c for c in made.columns if c != "id"]
    schema = ", ".join(f"`{k}` string" for k in keys) + ", hyp_no int"
    each = made.withColumn("_k", F.from_json("id", schema)).select(F.struct(*(F.col(f"_k.{k}") for k in keys)).alias("id"), *names)
    return features.hypothesis_mean(each, names).select("id.*", *names)
