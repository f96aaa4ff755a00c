"""python -m vocalith.cli features|timing|confidence|aggregate|activity|alignments|lines|transcripts|topics ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vocalith.operators import features, topics
from vocalith.operators import segments as sg
from vocalith.plans.pipeline import DEFAULT, REGISTRY, extract
from vocalith.plans.transcripts import transcript_features
from vocalith.functions import text as tx
from vocalith.functions.keys import clean_key
from vocalith.functions.libraries import library_providers
from vocalith.functions.providers import LEXICON, Providers, rule_lemma
from vocalith.session import let_workers_import
from vocalith.sources import files, sinks


def _segments(spark: SparkSession, a: argparse.Namespace):
    rows = sg.segments(files.recognizer_results(spark, files.manifest(spark, a.results)))
    if not a.metadata_path:
        return rows
    each = files.call_metadata(spark, a.metadata_path).select(clean_key("call_id").alias("call_id"), F.struct("subject_id", sg.flag("is_assessment").alias("is_assessment"), "day").alias("m"), "call_ts").where("call_id is not null")
    meta = each.groupBy("call_id").agg(F.max_by("m", F.struct("call_ts", "m")).alias("m")).select("call_id", "m.*")  # the last of a call's rows
    wanted = sg.CALL_TYPES[a.call_type]
    return sg.with_level(rows, meta if wanted is None else meta.where(F.col("is_assessment") == F.lit(wanted)), a.level)


def _calls(spark: SparkSession, a: argparse.Namespace):
    return files.calls_by_week(spark, a.metadata_file_path) if a.metadata_file_path else None


def _dictionary(spark: SparkSession, a: argparse.Namespace):
    return files.load_dictionary(spark, a.dictionary) if a.dictionary else LEXICON


def _providers(a: argparse.Namespace) -> Providers:
    return library_providers() if a.libraries else Providers()


def _with_id(df, level: str):
    """The keys of the level stay; together they are the id."""
    return df.withColumn("id", F.concat_ws("_", *(F.col(k).cast("string") for k in sg.LEVEL_KEYS[level])))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vocalith")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("features", "timing", "confidence"):
        p = jobs.add_parser(name)
        p.add_argument("--results", required=True, help="file that lists recognizer CSVs, one a line")
        p.add_argument("--output_dir", required=True)
        p.add_argument("--level", choices=["call", "day"], default="call")
        p.add_argument("--metadata_path")
        p.add_argument("--call_type", choices=list(sg.CALL_TYPES), default="all")
        if name == "features":
            p.add_argument("--feature_list", nargs="*", default=list(DEFAULT))
            p.add_argument("--dictionary", help=".dic file of word categories")
            p.add_argument("--libraries", action="store_true", help="use NLTK, truecase and textstat where they are installed")
        if name == "timing":
            p.add_argument("-d", "--duration_file_path")
    p = jobs.add_parser("aggregate")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--level", choices=["call", "day"], default="call")
    p.add_argument("--call_type", choices=list(sg.CALL_TYPES), default="all")
    p = jobs.add_parser("activity")
    p.add_argument("-i", "--input_path", required=True, help="timing features, one row a day or call")
    p.add_argument("-o", "--output_dir", required=True)
    p.add_argument("--level", choices=["call", "day"], default="day")
    p.add_argument("--call_type", choices=list(sg.CALL_TYPES), default="all")
    for name in ("alignments", "lines", "transcripts"):
        p = jobs.add_parser(name)
        p.add_argument(*(("-t", "--transcript_dir") if name == "transcripts" else ("-i", "--input_dir")), dest="input_dir", required=True)
        p.add_argument("-o", "--output_dir", required=True)
        p.add_argument("-l", "--level", choices=list(sg.LEVEL_KEYS), default="call")
        p.add_argument("-m", "--metadata_file_path")
        if name == "alignments":
            p.add_argument("-d", "--duration_file_path")
        if name == "transcripts":
            p.add_argument("-f", "--feature_type", choices=list(REGISTRY), required=True)
            p.add_argument("--dictionary", help=".dic file of word categories")
            p.add_argument("--libraries", action="store_true", help="use NLTK, truecase and textstat where they are installed")
    p = jobs.add_parser("topics")
    p.add_argument("-t", "--transcript_dir", required=True)
    p.add_argument("-w", "--min_word_count", type=int, default=50)
    p.add_argument("-s", "--stop_words", help="file of words to leave out, one a line")
    p.add_argument("-o", "--output_dir", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    let_workers_import(spark)
    if a.job == "features":
        for name, df in extract(_segments(spark, a), tuple(a.feature_list), _dictionary(spark, a), _providers(a)).items():
            sinks.write_features(df, a.output_dir, name)
    elif a.job == "timing":
        total = None
        if a.duration_file_path:
            total = files.call_durations(spark, a.duration_file_path).select(clean_key("call_id").alias("id"), "duration_sec").groupBy("id").agg(F.sum("duration_sec").alias("duration_s"))
        sinks.write_features(features.timing_features(features.timing_measures(_segments(spark, a)), total), a.output_dir, "timing")
    elif a.job == "confidence":
        sinks.write_features(features.confidence(_segments(spark, a), ["id"]), a.output_dir, "confidence")
    elif a.job == "aggregate":
        df = sg.split_day_id(files.timing_tables(spark, a.input_dir), a.level)
        sinks.write_features(sg.append([df]), a.output_dir, f"{a.level}_{a.call_type}_timing")
    elif a.job == "activity":
        df = sg.split_day_id(features.call_activity(files.timing_tables(spark, a.input_path)), a.level)
        sinks.write_features(df, a.output_dir, f"{a.level}_{a.call_type}_call_act")
    elif a.job == "alignments":
        totals = None
        if a.duration_file_path:  # seconds
            totals = files.call_durations(spark, a.duration_file_path).select(clean_key("call_id").alias("call_id"), F.col("duration").try_cast("double").alias("d")).groupBy("call_id").agg(F.sum("d").alias("duration_s"))
        df = features.alignment_timing(files.alignments(spark, a.input_dir).withColumn("call_id", clean_key("call_id")), _calls(spark, a), a.level, totals)
        sinks.write_features(_with_id(df, a.level), a.output_dir, "word_phone_timing", "parquet")
    elif a.job == "lines":
        scores = sg.at_level(files.confidence_lines(spark, a.input_dir).withColumn("call_id", clean_key("call_id")), _calls(spark, a), a.level)
        sinks.write_features(_with_id(features.confidence(scores, sg.LEVEL_KEYS[a.level], "conf"), a.level), a.output_dir, "asr_confidence", "parquet")
    elif a.job == "transcripts":
        rows = files.hypotheses(spark, a.input_dir).withColumn("call_id", clean_key("call_id"))
        df = transcript_features(rows, _calls(spark, a), a.level, a.feature_type, dictionary=_dictionary(spark, a), providers=_providers(a))
        sinks.write_features(_with_id(df, a.level), a.output_dir, a.feature_type, "parquet")
    else:
        start = F.coalesce(F.try_element_at(F.split("segment_id", "_"), F.lit(-2)).try_cast("bigint"), F.lit(0))
        rows = files.hypotheses(spark, a.transcript_dir).select(F.col("call_id").alias("id"), "hyp_no", F.col("hyp_no").alias("ord"), start.alias("tie"), tx.words("text").alias("ws"))
        corpus = topics.corpus(rows, files.stop_words(spark, a.stop_words) if a.stop_words else [], a.min_word_count, rule_lemma)
        bag = topics.trim_vocabulary(topics.bag_of_words(corpus))
        sinks.write_features(topics.sweep(bag, texts=topics.texts_in_shards(corpus)).withColumn("id", F.col("k")), a.output_dir, "topic_coherence")


if __name__ == "__main__":
    main()
