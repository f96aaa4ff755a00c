"""File adapters: recognizer CSVs, dimensions, text dumps of alignments and confidences, dictionaries and lists."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.functions.keys import clean_key

#: The columns of recognizer results; the optional ones may be missing from a file.
RESULTS = T.StructType(
    [
        T.StructField("audio_file_id", T.StringType()), T.StructField("feature_id", T.StringType()), T.StructField("order", T.LongType()), T.StructField("segment_number", T.LongType()),
        T.StructField("text", T.StringType()), T.StructField("text_basic", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("offset", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("word_timing", T.StringType()),
    ]
)
#: A decimal number, with or without exponent; nothing else that a cast would take.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths listed one a line; blank lines are none."""
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]  # a list of files


def recognizer_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSVs under each other by column name: each is read by its own header, missing columns are null, all get the declared type.

    The headers of all files are found in one job, over their first blocks; files with one header are read in one scan.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    if paths:
        lines = spark.read.text(paths).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("i"))
        for r in lines.groupBy("path").agg(F.min_by("value", "i").alias("head")).orderBy("path").collect():  # a list of files
            groups.setdefault(tuple(c.strip().strip('"') for c in r.head.split(",")), []).append(unquote(r.path))
    out = None
    for names, group in groups.items():
        if not names:
            continue
        rows = spark.read.options(**_CSV).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(group)
        typed = rows.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in RESULTS))
        optional = [f.name for f in RESULTS if f.name in ("feature_id", "order") and f.name not in names]
        typed = typed.drop(*optional)
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], RESULTS)


def _dimension(spark: SparkSession, path: str) -> DataFrame:
    """A dimension from Parquet (a path that ends so) or CSV."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.options(**_CSV).csv(path)


def call_metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = _dimension(spark, path)
    return rows.withColumn("call_ts", F.col("call_datetime").try_cast("timestamp")).withColumn("day", F.to_date("call_ts"))


def call_durations(spark: SparkSession, path: str) -> DataFrame:
    """duration_ms, or duration where that column is missing, as duration_sec beside the file's columns."""
    rows = _dimension(spark, path)
    ms = F.col("duration_ms") if "duration_ms" in rows.columns else F.col("duration")
    return rows.withColumn("duration_sec", ms.try_cast("double") * 1e-3)


def calls_by_week(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, subject_id, week, day, time): one row a call of metadata that has a row a segment; of several the last by date and time."""
    rows = _dimension(spark, path)
    text = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))
    one = rows.select(clean_key("call_id").alias("call_id"), F.struct("subject_id", text("week").alias("week"), text("day", "date").alias("day"), text("time").alias("time")).alias("m")).where("call_id is not null")
    return one.groupBy("call_id").agg(F.max_by("m", F.struct("m.day", "m.time", "m.week", "m.subject_id")).alias("m")).select("call_id", "m.*")


def confidence_lines(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, segment_id, start_ms, end_ms, conf) of <root>/<call_id>/conf_sym.txt; calls without the file have no rows."""
    lines = spark.read.text(f"{root}/*/conf_sym.txt").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("call_id"), F.split("value", " ").alias("f"))
    return parse_confidence(lines)


def parse_confidence(lines: DataFrame) -> DataFrame:
    """Rows with ``f`` (fields of a line) -> segment_id, start_ms, end_ms, conf; what can't be read is null."""
    part = lambda i: F.try_element_at(F.split("segment_id", "_"), F.lit(i)).try_cast("bigint")
    keep = [c for c in lines.columns if c != "f"]
    return lines.select(*keep, F.try_element_at("f", F.lit(1)).alias("segment_id"), F.when(F.try_element_at("f", F.lit(6)).rlike(NUMBER), F.try_element_at("f", F.lit(6)).try_cast("double")).alias("conf")).withColumn("start_ms", part(3)).withColumn("end_ms", part(4))


def alignments(spark: SparkSession, root: str, name: str = "word_phone_ali_timing.txt") -> DataFrame:
    """(call_id, seg, start_ms, end_ms, i, line) of <root>/<call_id>/<name>; blocks start with a quote at a line's start."""
    files = spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("call_id"), "value")
    return parse_alignments(files)


def parse_alignments(files: DataFrame) -> DataFrame:
    blocks = files.select("call_id", F.explode(F.split("value", '\n"')).alias("b")).select("call_id", F.split(F.trim(F.regexp_replace("b", r"^\s+|\s+$", "")), r"\r?\n").alias("ls"))
    headed = blocks.select("call_id", F.regexp_replace(F.try_element_at("ls", F.lit(1)), '"', "").alias("seg"), F.slice("ls", 2, 1_000_000_000).alias("ls")).where("seg <> ''")
    part = lambda i: F.try_element_at(F.split("seg", "_"), F.lit(i)).try_cast("bigint")
    return headed.select("call_id", "seg", part(3).alias("start_ms"), part(4).alias("end_ms"), F.posexplode("ls").alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """(call_id, hyp_no, segment_id, text): every file in <root>/<call_id>/ is one hypothesis, numbered by file name."""
    lines = spark.read.text(f"{root}/*/*").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("call_id"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    ranked = lines.select("call_id", "file").distinct().withColumn("hyp_no", F.row_number().over(Window.partitionBy("call_id").orderBy("file")) - 1)
    return lines.join(ranked, ["call_id", "file"]).select("call_id", "hyp_no", F.regexp_extract("value", r"^(\S*)", 1).alias("segment_id"), F.regexp_replace("value", r"^\S*\s?", "").alias("text"))


def timing_tables(spark: SparkSession, path: str) -> DataFrame:
    """A directory of feature CSVs under each other."""
    return spark.read.options(header=True, inferSchema=True).csv(path)


def stop_words(spark: SparkSession, path: str) -> list[str]:
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]  # a word list


def load_dictionary(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``dictionary`` of a file that Spark can read, wherever it is."""
    return parse_dictionary(spark.read.text(path, wholetext=True).first().value.splitlines())  # one dictionary


def dictionary(path: str) -> list[tuple[str, str]]:
    """``dictionary`` of a file on this machine."""
    with open(path, encoding="utf-8") as f:
        return parse_dictionary(f)


def parse_dictionary(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(pattern, category) of a .dic file: between two lines of % are numbered categories, after them patterns with their numbers."""
    names: dict[str, str] = {}
    out: list[tuple[str, str]] = []
    inside = 0
    for line in lines:
        fields = line.strip().split("\t") if "\t" in line else line.split()
        if fields[:1] == ["%"]:
            inside += 1
        elif inside == 1 and len(fields) >= 2:
            names[fields[0].strip()] = fields[1].strip()
        elif inside >= 2 and fields and fields[0]:
            out += [(fields[0].strip().lower(), names[n.strip()]) for n in fields[1:] if n.strip() in names]
    return out
