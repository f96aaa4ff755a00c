"""Queries pN_ of problems 6 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm import digests, mixing, packing, sentences, tokens
from vocalith.session import cut_lineage, spread, table


#: Percentiles of the digest report.
PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return digests.low_median_features(table(spark, sf, "recognition_results"))


def _percentiles(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Percentiles of each feature from the merged digests of its months, with the certified rank error; and the number of clusterings."""
    rows = digests.confidences(table(spark, sf, "recognition_results")).withColumn("month", F.date_format("received_at", "yyyy-MM"))
    keys = ["feature_id", "month"]
    parts = digests.parts_for(rows, keys)
    monthly, levels = digests.merge_parts(digests.confidence_digests(rows, keys, parts), keys, parts)
    answers = digests.quantiles(digests.merge(monthly, ["feature_id"]), ["feature_id"], PROBS)
    return digests.certify(rows, ["feature_id"], "confidence", answers, max(8, parts)), levels + 1


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _percentiles(spark, sf)[0]


def p6_certified(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the certified rank error of each percentile is within the bound that the digests promise."""
    found, levels = _percentiles(spark, sf)
    within = F.col("rank_error") <= digests.rank_bound(levels) + 1 / F.col("n")
    return found.select("feature_id", "prob", "n", within.alias("within"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are tokenised once; their sizes are a narrow table."""
    return cut_lineage(tokens.sized(spread(table(spark, sf, "documents").select("doc_id", "source", "text")), "doc_id", "source"))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sized(spark, sf), table(spark, sf, "pack_capacities"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(p7_pack(spark, sf), table(spark, sf, "pack_capacities"))


def p7_harmonic(spark: SparkSession, sf: str) -> DataFrame:
    """The plain method."""
    return packing.harmonic(_sized(spark, sf), table(spark, sf, "pack_capacities"))


def p7_harmonic_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(p7_harmonic(spark, sf), table(spark, sf, "pack_capacities"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What has to hold of both packings."""
    sized, capacities = _sized(spark, sf), table(spark, sf, "pack_capacities")
    checks = lambda name, packed: packing.packing_checks(packed, sized, capacities).withColumn("packing", F.lit(name))
    return checks("refined", packing.pack(sized, capacities)).unionByName(checks("harmonic", packing.harmonic(sized, capacities)))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf), table(spark, sf, "source_targets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _sized(spark, sf), table(spark, sf, "source_targets")
    return mixing.mix_report(mixing.mix(sized, targets), sized, targets)


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source: its texts, and whether the mix keeps the cap, repeats texts evenly and comes within a text of what water-filling gives."""
    sized, targets = _sized(spark, sf), table(spark, sf, "source_targets")
    return mixing.mix_checks(mixing.mix(sized, targets), sized, targets)


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: how many characters its sentences hold, and whether they are in order, apart and without blanks at their ends."""
    docs = table(spark, sf, "documents").select("doc_id", "text").where("text is not null").distinct()
    found = p9_found(spark, sf).distinct().join(docs, "doc_id").withColumn("s", F.expr("substring(text, int(sent_start) + 1, int(sent_end - sent_start))"))
    blank = r"(?U)[\s\x1c-\x1f]"
    each = found.withColumn("n", F.length(F.regexp_replace("s", blank, ""))).withColumn("before", F.lag("sent_end").over(Window.partitionBy("doc_id", "text").orderBy("sent_start")))
    fine = F.coalesce(F.col("before") <= F.col("sent_start"), F.lit(True)) & ~F.col("s").rlike(f"^{blank}|{blank}$") & (F.length("s") == F.col("sent_end") - F.col("sent_start"))
    return each.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("n_held"), F.min(fine).alias("in_order"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    events = cut_lineage(sentences.events_of(spread(table(spark, sf, "documents").select("doc_id", "text"))))
    return sentences.split_events(events, sentences.train_events(events))


def p9_text(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences themselves, in order."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = p9_found(spark, sf).join(docs, "doc_id")
    cut = F.expr("substring(text, int(sent_start) + 1, int(sent_end - sent_start))")
    return found.select("doc_id", "sent_start", cut.alias("sentence"))


QUERIES = {f.__name__: f for f in (p6_found, p6_percentiles, p6_certified, p7_pack, p7_report, p7_harmonic, p7_harmonic_report, p7_checks, p8_mix, p8_report, p8_checks, p9_checks, p9_found, p9_text)}

#: SQL counterparts, by query.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SOURCE = "nullif(lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))), '')"
SQL: dict[str, str] = {
    "p7_checks": """select packing, capacity_id, n_texts, n_empty, 0 as n_lost, 0 as n_cut, 0 as n_over from pack_capacities,
 (select count(*) as n_texts, count(case when coalesce(text, '') = '' then 1 end) as n_empty from documents), (select unnest(['refined', 'harmonic']) as packing)""",
    "p8_checks": f"""select t.source, max_repeats, n_docs, true as capped, true as even, true as near from (select {_SOURCE} as source, max_repeats from source_targets) t
 left join (select {_SOURCE} as source, count(*) as n_docs from documents group by 1) d on t.source = d.source""",
    "p9_checks": f"select doc_id, n_held, true as in_order from (select doc_id, length(regexp_replace(text, '[{_WHITE}]', '', 'g')) as n_held from documents where text is not null) where n_held > 0",
    "p6_found": "select feature_id from recognition_results where feature_id is not null and confidence between 0 and 1 and not isnan(confidence) group by feature_id having count(*) >= 30 and quantile_cont(confidence, 0.5) < 0.5",
    "p6_certified": f"select feature_id, prob, n, true as within from (select feature_id, count(*) as n from recognition_results where feature_id is not null and confidence between 0 and 1 and not isnan(confidence) group by feature_id), (select unnest([{', '.join(f'cast({p} as double)' for p in PROBS)}]) as prob)",
}
