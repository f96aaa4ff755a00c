"""Row-local stages over streams of recognizer results. State is kept only for the windowed report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions.literals import with_word_list
from vocalith.operators.features import timing_measures
from vocalith.operators.segments import segments


def results_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def measures_stream(results: DataFrame) -> DataFrame:
    """Timing measures of each segment as it arrives: no state and no shuffle."""
    return timing_measures(segments(results, by_feature=False))


def rejects_stream(results: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Word timings that can't be read, per day of receipt and reason; a day is final once ``late`` has passed."""
    read = with_word_list(results.select(F.col("received_at").cast("timestamp").alias("received_at"), "word_timing"), "word_timing").where("word_reason is not null")
    return read.withWatermark("received_at", late).groupBy(F.window("received_at", window).alias("day"), "word_reason").agg(F.count("*").alias("n_rows"))
