"""The canonical segments, levels of grouping, and what joins to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.functions.keys import clean_key
from vocalith.operators.moments import DAY_US, read_moments

#: The call types, and the flag each keeps (None keeps all).
CALL_TYPES = {"all": None, "personal": False, "assessment": True}
#: The keys of each level of grouping.
LEVEL_KEYS = {"subject": ["subject_id"], "week": ["subject_id", "week"], "day": ["subject_id", "day"], "call": ["call_id"], "segment": ["segment_id"]}


def segments(results: DataFrame, by_feature: bool | None = None) -> DataFrame:
    """Recognizer rows as (id, ord, tie, ...): id is ``feature_id`` where the table has that column and ``by_feature`` isn't False, else the audio file.

    Order in a group: ``seg_order`` (or ``order``) where given, else ``segment_number``; ties by result_id. Rows without
    id are left out.
    """
    columns = set(results.columns)
    feature = "feature_id" in columns if by_feature is None else by_feature
    order = [F.col(f"`{c}`") for c in ("seg_order", "order", "segment_number") if c in columns]
    key = F.nullif(F.col("feature_id"), F.lit("")) if feature else clean_key("audio_file_id")
    tie = F.col("result_id") if "result_id" in columns else F.xxhash64(*[c for c in ("audio_file_id", "segment_number", "text") if c in columns])
    keep = [F.col(f"`{c}`") for c in ("text", "text_basic", "confidence", "offset", "duration", "word_timing", "segment_number") if c in columns]
    return results.select(key.alias("id"), F.coalesce(*order, F.lit(-1)).alias("ord"), tie.alias("tie"), clean_key("audio_file_id").alias("call_id"), *keep).where("id is not null")


def flag(c: Column | str) -> Column:
    """Several spellings of a boolean; null for anything else."""
    text = F.lower(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")))
    return F.when(text.isin("t", "true", "1", "yes", "y"), True).when(text.isin("f", "false", "0", "no", "n"), False)


def metadata(rows: DataFrame, call_type: str = "all") -> DataFrame:
    """(call_id, subject_id, is_assessment, last): one row a call, the last loaded. An unknown call type is an error when the plan is built."""
    if call_type not in CALL_TYPES:
        raise ValueError(f"call_type must be one of {', '.join(CALL_TYPES)}")
    last = F.max_by(F.struct("subject_id", flag("is_assessment").alias("is_assessment"), "call_datetime", "meta_id"), F.struct("loaded_at", "meta_id"))
    one = rows.select(clean_key("call_id").alias("call_id"), "subject_id", "is_assessment", "call_datetime", "loaded_at", "meta_id").where("call_id is not null").groupBy("call_id").agg(last.alias("m")).select("call_id", "m.*")
    wanted = CALL_TYPES[call_type]
    return one if wanted is None else one.where(F.col("is_assessment") == F.lit(wanted))


def call_days(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(call_id, day): the date that ``call_datetime`` states as it is written, 'yyyy-MM-dd', whatever zone stands beside it.

    Of several rows of a call, the last loaded that states one counts; calls without any are left out. Slashed dates
    follow the site's ``date_order`` (else DMY, as in ``moments.normalise``); a count since 1970 states its date in UTC.
    """
    site = sites.select("site_id", "date_order")
    placed = rows.select(clean_key("call_id").alias("call_id"), "site_id", "call_datetime", "loaded_at", "meta_id").where("call_id is not null").join(site, "site_id", "left")
    read = read_moments(placed.withColumn("date_order", F.coalesce("date_order", F.lit("DMY"))), "call_datetime", "date_order", ["call_id", "loaded_at", "meta_id"]).where("local_us is not null")
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("local_us") / DAY_US).cast("int")), "yyyy-MM-dd")
    return read.groupBy("call_id").agg(F.max_by(day, F.struct("loaded_at", "meta_id")).alias("day"))


def day_id(day: Column | str = "day") -> Column:
    """Id of subject and date of a call; a call without date is kept under NaT, as pandas writes it."""
    return F.concat_ws("_", "subject_id", F.coalesce((F.col(day) if isinstance(day, str) else day).cast("string"), F.lit("NaT")))


def with_level(rows: DataFrame, meta: DataFrame, level: str, day: Column | None = None) -> DataFrame:
    """Segments of the calls in ``meta``; at level ``day`` the id becomes subject and date of the call.

    The dimension joins on the call; a call with a third of all segments is left to the skew join of the adaptive planner.
    """
    if level not in ("call", "day"):
        raise ValueError("level must be call or day")
    if level == "call":
        return rows.join(meta.select("call_id"), "call_id", "left_semi").withColumn("id", F.col("call_id"))
    keyed = meta.select("call_id", day_id("day" if day is None else day).alias("_id"))
    return rows.join(keyed, "call_id").withColumn("id", F.col("_id")).drop("_id")


def at_level(rows: DataFrame, meta: DataFrame | None, level: str) -> DataFrame:
    """Rows with call_id (and segment_id at level segment) and the keys of ``level`` (``LEVEL_KEYS``); where ``meta`` (call_id, subject_id, week, day) is given, calls without it are left out."""
    if level not in LEVEL_KEYS:
        raise ValueError(f"level must be one of {', '.join(LEVEL_KEYS)}")
    if meta is None and level not in ("call", "segment"):
        raise ValueError(f"level {level} needs metadata")
    return rows if meta is None else rows.join(meta.select("call_id", *(c for c in ("subject_id", "week", "day", "time") if c in meta.columns and c not in rows.columns)), "call_id")


def level_totals(rows: DataFrame, level: str, totals: DataFrame) -> DataFrame:
    """(id, duration_s): the durations of the distinct calls of each group of ``rows`` (see ``at_level``), by ``totals`` (call_id, duration_s).

    id is the struct of the level's keys. A segment's own duration is the span in its id, in seconds.
    """
    key = F.struct(*LEVEL_KEYS[level]).alias("id")
    if level == "segment":
        at = lambda i: F.try_element_at(F.split("segment_id", "_"), F.lit(i)).try_cast("bigint")
        return rows.select("segment_id").distinct().select(key, ((at(-1) - at(-2)) * 1e-3).alias("duration_s"))
    return rows.select("call_id", *LEVEL_KEYS[level]).distinct().join(totals, "call_id").groupBy(key).agg(F.sum("duration_s").alias("duration_s")) if level != "call" else totals.select(key, "duration_s")


def durations(rows: DataFrame) -> DataFrame:
    """(call_id, duration_s): summed per call, from duration_ms where set, else duration (both ms)."""
    ms = F.coalesce(*[F.col(c) for c in ("duration_ms", "duration") if c in rows.columns])
    return rows.select(clean_key("call_id").alias("call_id"), ms.alias("ms")).where("call_id is not null").groupBy("call_id").agg((F.coalesce(F.sum("ms"), F.lit(0.0)) * 1e-3).alias("duration_s"))


def split_day_id(df: DataFrame, level: str = "day") -> DataFrame:
    """Day ids taken apart at the last underscore (subjects may hold some); at level call the id is the call."""
    if level == "call":
        return df.withColumn("call_id", F.col("id"))
    return df.withColumn("subject_id", F.regexp_replace("id", "_[^_]*$", "")).withColumn("date", F.regexp_extract("id", "([^_]*)$", 1))


def append(frames: list[DataFrame]) -> DataFrame:
    """Frames under each other by name, missing columns null, columns in alphabetical order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in sorted(out.columns)))
