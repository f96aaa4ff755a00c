"""Queries pN_ of problems 1 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions.keys import clean_key
from vocalith.operators import dewey, intervals, moments, orphans, rejects
from vocalith.functions.literals import with_word_list
from vocalith.session import table

def _timed(spark: SparkSession, sf: str):
    return [("metadata", table(spark, sf, "metadata"), "meta_id", "call_datetime", "loaded_at"), ("call_durations", table(spark, sf, "call_durations"), "dur_id", "call_datetime", "received_at")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return moments.normalise_sources(_timed(spark, sf), table(spark, sf, "sites"))


def p1_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The history estimated for each site from both tables, without credit for the declared one, which stands beside it."""
    sites = table(spark, sf, "sites")
    return moments.histories(moments.read_sources(_timed(spark, sf), sites), sites, trust=0.0).withColumnRenamed("entity", "site_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.speech_periods(table(spark, sf, "recognition_results"))


def _recognition_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The words and phones of good word timings; the row itself is the segment. Labels are of word and phone."""
    rows = table(spark, sf, "recognition_results").select(F.col("result_id").alias("parent_id"), F.coalesce(clean_key("audio_file_id"), F.lit("")).alias("audio_file_id"), F.coalesce("segment_number", F.lit(-1)).cast("bigint").alias("segment_number"), "word_timing")
    good = with_word_list(rows, "word_timing").drop("word_timing", "word_reason")
    root = good.select("parent_id", "audio_file_id", "segment_number", F.expr("case when words is not null then to_variant_object(named_struct('word_timing', words)) end").alias("root"))
    nodes = dewey.dewey_nodes(root, "root", (dewey.Level("word", "word_timing"), dewey.PAYLOAD_LEVELS[-1]))
    return nodes.withColumn("place", F.expr("concat(array(0, 0), label)"))


def _payload_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dewey.payload_nodes(table(spark, sf, "result_payloads")).withColumn("audio_file_id", F.coalesce(clean_key("audio_file_id"), F.lit(""))).withColumn("segment_number", F.coalesce("segment_number", F.lit(-1).cast("bigint")))
    # the segment's ordinal is left out of the place: channel, alternative, word, phone
    return nodes.withColumn("place", F.expr("case when size(label) > 1 then concat(slice(label, 1, 1), slice(label, 3, 9)) else label end"))


def _both(spark: SparkSession, sf: str, cases) -> DataFrame:
    named = lambda nodes, name: cases(nodes.withColumn("table_name", F.lit(name)))
    return named(_recognition_nodes(spark, sf), "recognition_results").unionByName(named(_payload_nodes(spark, sf), "result_payloads"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.coalesce(F.try_element_at("place", F.lit(i)), F.lit(-1)).cast("bigint")
    return _both(spark, sf, lambda nodes: nodes.where("path in ('word', 'phone')").select("table_name", "parent_id", "audio_file_id", at(1).alias("channel_no"), "segment_number", at(2).alias("alt_no"), at(3).alias("word_no"), at(4).alias("phone_no")))


#: The members of each flat table and their kinds.
MEMBERS = {
    "segment": {"offset": "bigint", "duration": "bigint"},
    "alternative": {"text": "string", "confidence": "double"},
    "word": {"Word": "string", "Offset": "bigint", "Duration": "bigint"},
    "phone": {"Ph": "string", "Offset": "bigint", "Duration": "bigint"},
}


def _flat(nodes: DataFrame, path: str) -> DataFrame:
    """The flat table of a schema path: keys, the node's label and its parent's, and the node's own members."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    values = [F.expr(f"try_variant_get(value, '$.{m}', '{kind}')").alias(m.lower()) for m, kind in MEMBERS[path].items()]
    return nodes.where(F.col("path") == path).withColumn("_up", dewey.parent_label()).select("table_name", "parent_id", "audio_file_id", "segment_number", text("label").alias("label"), text("_up").alias("parent_label"), *values)


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of both tables; a row of recognition_results is one, and its own record."""
    rows = table(spark, sf, "recognition_results").select(F.lit("recognition_results").alias("table_name"), F.col("result_id").alias("parent_id"), F.coalesce(clean_key("audio_file_id"), F.lit("")).alias("audio_file_id"), F.coalesce("segment_number", F.lit(-1)).cast("bigint").alias("segment_number"), F.lit("").alias("label"), F.lit(None).cast("string").alias("parent_label"), "offset", "duration")
    return rows.unionByName(_flat(_payload_nodes(spark, sf).withColumn("table_name", F.lit("result_payloads")), "segment"))


def p3_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Alternatives; only payloads have some."""
    return _flat(_payload_nodes(spark, sf).withColumn("table_name", F.lit("result_payloads")), "alternative")


def p3_words(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, lambda nodes: _flat(nodes, "word"))


def p3_phones(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, lambda nodes: _flat(nodes, "phone"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejects(*(table(spark, sf, t) for t in ("recognition_results", "conf_sym", "raw_results")))


def _no(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).where("false")


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The good records of raw_results; p4_loaded_words and p4_loaded_lines give those of the other two tables."""
    raw = table(spark, sf, "raw_results")
    return rejects.load_raw(raw, rejects.rejects(_no(spark, sf, "recognition_results"), _no(spark, sf, "conf_sym"), raw))


def p4_loaded_words(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of recognition_results with a good word timing or none."""
    return rejects.load_words(table(spark, sf, "recognition_results"))


def p4_loaded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The good lines of conf_sym."""
    lines = table(spark, sf, "conf_sym")
    return rejects.load_lines(lines, rejects.rejects(_no(spark, sf, "recognition_results"), lines, _no(spark, sf, "raw_results")))


def _orphans(spark: SparkSession, sf: str):
    children = {
        "recognition_results": (table(spark, sf, "recognition_results"), "result_id", "audio_file_id", "received_at"),
        "call_durations": (table(spark, sf, "call_durations"), "dur_id", "call_id", "received_at"),
        "conf_sym": (table(spark, sf, "conf_sym"), "line_id", "call_id", "received_at"),
    }
    return children, table(spark, sf, "metadata")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_rows(*_orphans(spark, sf))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, sf))


def p5_keys(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_keys(*_orphans(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_zones, p2_found, p3_found, p3_segments, p3_alternatives, p3_words, p3_phones, p4_found, p4_loaded, p4_loaded_words, p4_loaded_lines, p5_found, p5_report, p5_keys)}

def _sql() -> dict[str, str]:
    from vocalith.plans.moments_sql import p1_sql
    from vocalith.plans.nested_sql import nested_sql
    from vocalith.plans.reference import SQL_JSON, sql_key
    from vocalith.plans.rejects_sql import rejects_sql

    rows = f"""rows as (select result_id, {sql_key("audio_file_id")} as k, "offset" as off, duration, word_timing from recognition_results where {sql_key("audio_file_id")} is not null)"""
    spans = f"""iv as (select k, off as s, off + duration as e from rows where duration > 0 union all select k, w.o, w.o + w.d from (select k, unnest(list_transform(j, lambda r: {{'o': cast(r->>'$.Offset' as bigint), 'd': cast(r->>'$.Duration' as bigint)}})) as w from {SQL_JSON.format(rows="rows")}) where w.d > 0)"""
    marked = "mk as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from iv where s is not null)"
    periods = "per as (select k, min(s) as s, max(e) as e from (select *, sum(case when reach >= s then 0 else 1 end) over (partition by k order by s, e rows unbounded preceding) as n from mk) group by k, n)"
    p2 = f"with {rows}, {spans}, {marked}, {periods} select k as audio_file_id, 'period' as kind, s as start_tick, e as end_tick from per union all select k, 'gap', e, nxt from (select *, lead(s) over (partition by k order by s) as nxt from per) where nxt is not null"
    child = " union all ".join(f"select '{t}' as table_name, {i} as row_id, {sql_key(k)} as k, received_at as ts from {t}" for t, i, k in (("recognition_results", "result_id", "audio_file_id"), ("call_durations", "dur_id", "call_id"), ("conf_sym", "line_id", "call_id")))
    p5 = f"""with child as (select * from ({child}) where k is not null), par as (select {sql_key("call_id")} as k, loaded_at, deleted_at from metadata), st as (select table_name, row_id, ts, count(par.k) as n, count(case when loaded_at <= ts and (deleted_at is null or deleted_at > ts) then 1 end) as alive, count(case when loaded_at > ts then 1 end) as later
 from child left join par on child.k = par.k group by table_name, row_id, ts), orph as (select table_name, row_id, strftime(ts, '%Y-%m') as period_month, case when n = 0 then 'missing' when later = n then 'late' else 'deleted' end as reason from st where alive = 0)"""
    return {
        "p1_found": p1_sql(),
        "p2_found": p2,
        **nested_sql(sql_key, SQL_JSON, MEMBERS),
        **rejects_sql(),
        "p5_found": f"{p5} select * from orph",
        "p5_report": f"{p5} select table_name, period_month, reason, count(*) as n_rows from orph group by all",
        "p5_keys": f"with child as (select * from ({child}) where k is not null) select table_name, k as key, count(*) as n_rows from child where k not in (select k from (select {sql_key('call_id')} as k from metadata) where k is not null) group by all",
    }


#: SQL counterparts, by query; the others are held against brute force in the tests.
SQL: dict[str, str] = _sql()
