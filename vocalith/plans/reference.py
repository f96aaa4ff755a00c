"""Queries of the feature operators over the test tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.functions import text as tx
from vocalith.functions.keys import clean_key
from vocalith.functions.literals import with_word_list
from vocalith.functions.providers import CLOSED, ENDINGS, LEXICON, Providers
from vocalith.functions.stats import describe5, describe5_table
from vocalith.operators import features, graphs, topics
from vocalith.operators import segments as sg
from vocalith.plans import pipeline
from vocalith.plans.moments_sql import days_cte
from vocalith.plans.transcripts import transcript_features
from vocalith.session import spread, table
from vocalith.sources import files

#: Words that topics leave out.
STOP = ["the", "a", "to", "i", "and", "of", "it", "for", "in", "my", "was", "on"]

#: Fixed value: pairs of words that score above this are phrases of the test transcripts.
PHRASE_THRESHOLD = 1.5


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums differ in their last digits with the order of summation."""
    return df.select(*((F.round(f.name, 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recognition_results")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return sg.segments(spread(_results(spark, sf)), by_feature=False)


def _by_feature(spark: SparkSession, sf: str) -> DataFrame:
    return sg.segments(spread(_results(spark, sf)))


def _each(spark: SparkSession, sf: str) -> DataFrame:
    """Level segment: every row is its own group."""
    return spread(_results(spark, sf)).select(F.col("result_id").cast("string").alias("id"), "text")


def _metadata(spark: SparkSession, sf: str, call_type: str = "all") -> DataFrame:
    """Calls with the date that their call_datetime states; null where none of a call's rows states one."""
    rows = table(spark, sf, "metadata")
    return sg.metadata(rows, call_type).join(sg.call_days(rows, table(spark, sf, "sites")), "call_id", "left")


# text features


def verbosity_word_stats(spark, sf):
    return r6(features.word_stats(pipeline.prepared_sentences(_segments(spark, sf))))


def verbosity_syllables(spark, sf):
    return r6(features.syllable_stats(pipeline.prepared_sentences(_segments(spark, sf))))


def mattr(spark, sf):
    return r6(features.mattr(features.word_positions(_segments(spark, sf))))


def honore(spark, sf):
    return r6(features.honore(features.word_positions(_segments(spark, sf))))


def honore_by_feature(spark, sf):
    return r6(features.honore(features.word_positions(_by_feature(spark, sf))))


def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.clean("text")).alias("cleaned"))


def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("no", "s")).select("doc_id", F.col("no").cast("bigint").alias("no"), F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("digest"))


def liwc_fractions(spark, sf):
    return r6(pipeline.liwc(_segments(spark, sf)))


def pos_from_tags(spark, sf):
    sentences = _each(spark, sf).where("text is not null").withColumn("sent_no", F.lit(0))
    tagged = pipeline.tagged_tokens(sentences, Providers(truecase=lambda c: c))
    n = sentences.groupBy("id").agg(F.sum(F.size(tx.words("text"))).alias("n"))
    return r6(features.pos_features(tagged, n))


def pos_by_call(spark, sf):
    return r6(pipeline.pos(_segments(spark, sf)))


def graph_counts(spark, sf):
    return r6(graphs.graph_counts(graphs.edges(graphs.naive_tokens(_segments(spark, sf)))))


def graph_loops(spark, sf):
    return r6(graphs.graph_loops(graphs.edges(graphs.naive_tokens(_segments(spark, sf)))))


def graph_connectivity(spark, sf):
    return r6(graphs.graph_connectivity(graphs.edges(graphs.naive_tokens(_each(spark, sf).where("text is not null")))))


def graph_connectivity_call(spark, sf):
    """One graph a call."""
    return r6(graphs.graph_connectivity(graphs.edges(graphs.naive_tokens(_segments(spark, sf)))))


def graph_features_naive(spark, sf):
    """Counts, connectivity and paths of each call's word graph, and all of them over the call's characters."""
    return r6(graphs.graph_features(_segments(spark, sf)))


def graph_features(spark, sf):
    return r6(pipeline.graph(_segments(spark, sf)))


def non_verbal_ratios(spark, sf):
    docs = table(spark, sf, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("id"), "text")
    return r6(features.non_verbal(docs))


# timing and confidence


def ms_timing(spark, sf):
    total = sg.durations(table(spark, sf, "call_durations"))
    return r6(features.timing_features(features.timing_measures(_segments(spark, sf)), total, total_key="call_id"))


def ms_timing_day(spark, sf):
    meta = _metadata(spark, sf)
    rows = sg.with_level(_segments(spark, sf), meta, "day")
    total = meta.join(sg.durations(table(spark, sf, "call_durations")), "call_id").groupBy(sg.day_id().alias("id")).agg(F.sum("duration_s").alias("duration_s"))
    return r6(features.timing_features(features.timing_measures(rows), total))


def call_activity(spark, sf):
    return features.call_activity(ms_timing(spark, sf))


def call_activity_split(spark, sf):
    """Day ids taken apart again into subject and date."""
    return sg.split_day_id(features.call_activity(ms_timing_day(spark, sf)))


#: Ticks of 100 ns in a frame of an alignment.
_FRAME = 250_000


def _alignments(spark, sf):
    """Word timings of all segments as lines of alignments: a line a word, a line of silence before each that doesn't follow at once, and a second phone in words longer than half a second."""
    rows = spread(_results(spark, sf)).select(clean_key("audio_file_id").alias("call_id"), "result_id", F.coalesce("offset", F.lit(0)).alias("o"), F.coalesce("duration", F.lit(0)).alias("d"), "word_timing").where("call_id is not null")
    read = with_word_list(rows, "word_timing").where("size(words) > 0")
    seg = F.concat_ws("_", F.lit("s"), "call_id", (F.col("result_id") * 1000).cast("string"), (F.col("result_id") * 1000 + F.expr("d div 10000")).cast("string"))
    spans = F.expr(f"transform(words, w -> named_struct('s', (try_variant_get(w, '$.Offset', 'bigint') - o) div {_FRAME}, 'e', (try_variant_get(w, '$.Offset', 'bigint') + try_variant_get(w, '$.Duration', 'bigint') - o) div {_FRAME}, 'w', replace(try_variant_get(w, '$.Word', 'string'), ' ', '')))")
    lines = F.expr(
        """flatten(transform(spans, (x, i) -> concat(
             case when x.s > case when i = 0 then 0 else spans[i - 1].e end then array(concat_ws(' ', case when i = 0 then 0 else spans[i - 1].e end, x.s, 'p', 'q', 'sil')) else cast(array() as array<string>) end,
             case when x.e - x.s > 20 then array(concat_ws(' ', x.s, x.s + 20, 'p', 'q', x.w), concat_ws(' ', x.s + 20, x.e, 'p', 'q')) else array(concat_ws(' ', x.s, x.e, 'p', 'q', x.w)) end)))"""
    )
    return read.select("call_id", seg.alias("seg"), spans.alias("spans")).select("call_id", "seg", F.posexplode(lines).alias("i", "line"))


def _kaldi_timing(spark, sf, level: str):
    day = F.col("day").cast("date")
    meta = None if level in ("call", "segment") else _metadata(spark, sf).select("call_id", "subject_id", "day", F.date_format(F.date_trunc("week", day), "yyyy-MM-dd").alias("week"))
    return r6(features.alignment_timing(_alignments(spark, sf), meta, level, sg.durations(table(spark, sf, "call_durations"))))


def kaldi_timing(spark, sf):
    """Timing of alignments at level call, against the calls' durations."""
    return _kaldi_timing(spark, sf, "call")


def kaldi_timing_segment(spark, sf):
    return _kaldi_timing(spark, sf, "segment")


def kaldi_timing_day(spark, sf):
    return _kaldi_timing(spark, sf, "day")


def kaldi_timing_week(spark, sf):
    return _kaldi_timing(spark, sf, "week")


def kaldi_timing_subject(spark, sf):
    return _kaldi_timing(spark, sf, "subject")


def _as_hypotheses(spark, sf):
    """The cased and the plain transcript as two hypotheses, in the form of transcript files."""
    h = _hypotheses(spark, sf)
    return h.select(F.col("id").alias("call_id"), "hyp_no", F.concat_ws("_", F.lit("s"), "id", F.col("tie").cast("string"), (F.col("tie") + 1).cast("string")).alias("segment_id"), F.col("t").alias("text"))


def transcript_diversity_subject(spark, sf):
    """Lexical diversity of each subject's hypotheses, calls in order of day, mean over hypotheses."""
    meta = _metadata(spark, sf).select("call_id", "subject_id", "day")
    return r6(transcript_features(_as_hypotheses(spark, sf), meta, "subject", "lexical_diversity"))


def _word_scores(spark, sf):
    lines = table(spark, sf, "conf_sym").select(clean_key("call_id").alias("call_id"), F.split("conf_scores", " ").alias("f")).where("call_id is not null and size(f) = 6")
    return files.parse_confidence(lines)


def kaldi_confidence(spark, sf):
    """Word scores at level call."""
    return r6(features.confidence(_word_scores(spark, sf), sg.LEVEL_KEYS["call"], "conf"))


def kaldi_confidence_day(spark, sf):
    scores = _word_scores(spark, sf).join(_metadata(spark, sf).select("call_id", "subject_id", "day"), "call_id")
    return r6(features.confidence(scores, sg.LEVEL_KEYS["day"], "conf"))


def kaldi_confidence_subject(spark, sf):
    scores = _word_scores(spark, sf).join(_metadata(spark, sf).select("call_id", "subject_id"), "call_id")
    return r6(features.confidence(scores, sg.LEVEL_KEYS["subject"], "conf"))


def kaldi_confidence_week(spark, sf):
    meta = _metadata(spark, sf).select("call_id", "subject_id", F.date_format(F.date_trunc("week", F.col("day").cast("date")), "yyyy-MM-dd").alias("week"))
    return r6(features.confidence(_word_scores(spark, sf).join(meta, "call_id"), sg.LEVEL_KEYS["week"], "conf"))


def kaldi_confidence_segment(spark, sf):
    return r6(features.confidence(_word_scores(spark, sf), sg.LEVEL_KEYS["segment"], "conf"))


def confidence_stats(spark, sf):
    return r6(features.confidence(_segments(spark, sf), ["id"]))


def confidence_by_feature(spark, sf):
    return r6(features.confidence(_by_feature(spark, sf), ["id"]))


def describe5_lineitem(spark, sf):
    rows, keys = table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]
    prices = describe5_table(rows, keys, F.col("l_extendedprice"), "price")
    return r6(rows.groupBy(*keys).agg(*describe5(F.col("l_quantity"), "qty")).join(prices, keys))


# levels


def level_call(spark, sf):
    rows = sg.with_level(_segments(spark, sf), _metadata(spark, sf), "call")
    return rows.groupBy("id").agg(F.count("*").alias("n_segments"))


def level_day(spark, sf):
    rows = sg.with_level(_segments(spark, sf), _metadata(spark, sf), "day")
    return rows.groupBy("id").agg(F.count("*").alias("n_segments"))


def call_type_filter(spark, sf):
    return _metadata(spark, sf, "assessment").select("call_id", "subject_id", "is_assessment", "day")


def call_durations(spark, sf):
    return r6(sg.durations(table(spark, sf, "call_durations")))


# hypotheses and topics


def _hypotheses(spark, sf):
    """The cased and the plain transcript as two hypotheses of each segment."""
    rows = _segments(spark, sf)
    both = F.array(F.struct(F.lit(0).alias("hyp_no"), F.col("text").alias("t")), F.struct(F.lit(1).alias("hyp_no"), F.col("text_basic").alias("t")))
    return rows.select("id", "ord", "tie", F.explode(both).alias("h")).select("id", "ord", "tie", "h.hyp_no", "h.t").where("t is not null")


def hypothesis_mean(spark, sf):
    rows = _hypotheses(spark, sf).select(F.struct("id", "hyp_no").alias("id"), F.col("t").alias("text"))
    each = features.word_stats(rows).select("id.id", "id.hyp_no", "wc_mean", "total_count", "lw_count", "word_len")
    return r6(features.hypothesis_mean(each, ["wc_mean", "total_count", "lw_count", "word_len"]))


def _tokens(spark, sf):
    return _segments(spark, sf).where("text_basic is not null").select("id", tx.words("text_basic").alias("ws"))


def stopword_filter(spark, sf):
    kept = _tokens(spark, sf).withColumn("ws", topics.remove_stop_words(F.col("ws"), STOP))
    return kept.groupBy("id").agg(F.sum(F.size("ws")).cast("bigint").alias("n_words"))


def sound_filter(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", tx.words("text").alias("ws"))
    return topics.remove_non_verbal(docs).select("doc_id", F.size("ws").cast("bigint").alias("n_words"))


def min_words_filter(spark, sf):
    rows = _hypotheses(spark, sf).select("id", "hyp_no", tx.words("t").alias("ws"))
    return topics.enough_words(rows).groupBy("id").agg(F.count("*").alias("n_rows"))


def bag_of_words(spark, sf):
    return topics.bag_of_words(_tokens(spark, sf))


def vocab_trim(spark, sf):
    return topics.trim_vocabulary(topics.bag_of_words(_tokens(spark, sf))).groupBy("word").agg(F.sum("tf").cast("bigint").alias("tf"))


def phrase_scores(spark, sf):
    return r6(topics.phrases(_tokens(spark, sf), PHRASE_THRESHOLD))


def phrase_apply(spark, sf):
    rows = _segments(spark, sf).where("text_basic is not null").select(F.col("tie").alias("result_id"), tx.words("text_basic").alias("ws"))
    done = topics.apply_phrases(rows, topics.phrases(rows, PHRASE_THRESHOLD))
    return done.select("result_id", F.array_join("ws", " ").alias("text"))


def phrase_triples(spark, sf):
    """The second round: phrases of phrases."""
    rows = _segments(spark, sf).where("text_basic is not null").select(F.col("tie").alias("result_id"), tx.words("text_basic").alias("ws"))
    return topics.triples(rows, PHRASE_THRESHOLD).select("result_id", F.array_join("ws", " ").alias("text"))


def _bag(spark, sf):
    return topics.trim_vocabulary(topics.bag_of_words(topics.corpus(_tokens(spark, sf), STOP)))


def topics_lda(spark, sf):
    model, vocabulary = topics.train_topics(_bag(spark, sf), 5)
    return topics.topic_words(model, vocabulary)


def topic_coherence(spark, sf):
    bag = _bag(spark, sf)
    model, vocabulary = topics.train_topics(bag, 5)
    return topics.coherence(topics.topic_words(model, vocabulary), bag)


def topic_coherence_cv(spark, sf):
    """Coherence of the topics' words by their company in sliding windows over each call's words."""
    rows = _segments(spark, sf).where("text_basic is not null").select("id", "ord", "tie", tx.words("text_basic").alias("ws"))
    corpus = topics.corpus(rows, STOP)
    model, vocabulary = topics.train_topics(topics.trim_vocabulary(topics.bag_of_words(corpus)), 5)
    return topics.coherence_cv(topics.topic_words(model, vocabulary), topics.texts_in_shards(corpus))


def topic_sweep(spark, sf):
    return topics.sweep(_bag(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        verbosity_word_stats, verbosity_syllables, mattr, honore, honore_by_feature, clean_text, sentence_split, liwc_fractions, pos_from_tags, pos_by_call,
        graph_counts, graph_loops, graph_connectivity, graph_connectivity_call, graph_features_naive, graph_features, non_verbal_ratios,
        ms_timing, ms_timing_day, call_activity, call_activity_split, kaldi_timing, kaldi_timing_segment, kaldi_timing_day, kaldi_timing_week, kaldi_timing_subject, transcript_diversity_subject, kaldi_confidence, kaldi_confidence_day, kaldi_confidence_week, kaldi_confidence_subject, kaldi_confidence_segment, confidence_stats, confidence_by_feature, describe5_lineitem,
        level_call, level_day, call_type_filter, call_durations,
        hypothesis_mean, stopword_filter, sound_filter, min_words_filter, bag_of_words, vocab_trim, phrase_scores, phrase_apply, phrase_triples, topics_lda, topic_coherence, topic_coherence_cv, topic_sweep,
    )
}

# ---------------------------------------------------------------------------------------------------------------------
# SQL

_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '')"


def _sql_clean(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_''{_WS}]+', '', 'g')"


def _sql_sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))"


def _d5(v: str, p: str, names=("max", "min", "mean", "med", "std"), unit: float | None = None) -> str:
    f = (f"max({v})", f"min({v})", f"avg({v})", f"quantile_cont({v}, 0.5)", f"stddev_pop({v})")
    return ", ".join(f"round(cast({x} as double){'' if unit is None else f' * cast({unit!r} as double)'}, 6) + 0.0 as {p}_{n}" for x, n in zip(f, names))


def _ratio(a: str, b: str) -> str:
    return f"round(cast({a} as double) / nullif(cast({b} as double), 0), 6) + 0.0"


_SEG = f"""seg as (select {sql_key("audio_file_id")} as id, coalesce(seg_order, segment_number, -1) as ord, result_id as tie, text, text_basic, confidence, "offset" as off, duration, word_timing from recognition_results where {sql_key("audio_file_id")} is not null)"""
_FEAT = """seg as (select nullif(feature_id, '') as id, coalesce(seg_order, segment_number, -1) as ord, result_id as tie, text, text_basic, confidence from recognition_results where nullif(feature_id, '') is not null)"""
_SENT = f"""{_SEG}, joined as (select id, string_agg(coalesce(text, 'nan'), ' ' order by ord, tie) as t from seg group by id),
 sent as (select id, lower({_sql_clean("x")}) as s from (select id, unnest({_sql_sentences("t")}) as x from joined))"""
_WORDS = "words as (select id, string_split(string_agg(coalesce(text_basic, 'nan'), ' ' order by ord, tie), ' ') as ws from seg group by id)"
_META = f"""{days_cte(sql_key("call_id"))}, meta as (select m.*, day from (select k as call_id, arg_max(subject_id, (loaded_at, meta_id)) as subject_id, arg_max_null(flag, (loaded_at, meta_id)) as is_assessment
 from (select {sql_key("call_id")} as k, *, case when lower(trim(is_assessment)) in ('t','true','1','yes','y') then true when lower(trim(is_assessment)) in ('f','false','0','no','n') then false end as flag from metadata) where k is not null group by k) m left join days on m.call_id = days.k)"""
_DAY_ID = "concat_ws('_', subject_id, coalesce(day, 'NaT'))"
_DUR = f"""dur as (select k as call_id, coalesce(sum(ms), 0.0) * 1e-3 as duration_s from (select {sql_key("call_id")} as k, coalesce(duration_ms, duration) as ms from call_durations) where k is not null group by k)"""
_HONORE = "select id, round(100 * ln(n / (1 - v1 / (v + 1e-5))), 6) as HS from (select id, cast(sum(c) as double) as n, cast(count(*) as double) as v, cast(sum(case when c = 1 then 1 else 0 end) as double) as v1 from (select id, w, count(*) as c from (select id, unnest(ws) as w from words) group by id, w) group by id)"


def _tag_sql(w: str) -> str:
    low = f"lower({w})"
    cases = [f"when regexp_matches({w}, '^[0-9]') then 'CD'"]
    cases += [f"when {low} in ({', '.join(chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39) for m in members.split())}) then '{t}'" for t, members in CLOSED.items()]
    cases += [f"when regexp_matches({w}, '^[A-Z]') then 'NNP'"]
    cases += [f"when suffix({low}, '{e}') and length({w}) > {len(e) + 2} then '{t}'" for e, t in ENDINGS]
    return f"case {' '.join(cases)} else 'NN' end"


_CLASS_SQL = """case when tag = 'CC' then ['CC'] when tag = 'PRP' then ['NOUN','PNOUN'] when tag = 'PRP$' then ['NOUN','PSNOUN'] when tag like 'J%' then ['ADJ'] when tag like 'V%' then ['VERB']
 when tag like 'N%' then ['NOUN'] when tag like 'R%' then ['ADV'] when tag like 'D%' or tag like 'WD%' then ['DET'] when tag like 'U%' then ['INT'] when tag like 'I%' or tag like 'T%' then ['PREP'] when tag like 'WR%' then ['ADV']
 when tag like 'W%P' then ['NOUN','PNOUN'] when tag like 'W%' then ['PSNOUN'] else cast([] as varchar[]) end"""


def _pos_sql(base: str, source: str, text: str) -> str:
    counts = ", ".join(f"count(case when c = '{k}' then 1 end) as {k}" for k in features.POS_CLASSES)
    shares = ", ".join(f"{_ratio(f'coalesce(p.{k}, 0)', 'n')} as {k}" for k in features.POS_CLASSES)
    z = lambda k: f"coalesce(p.{k}, 0)"
    ratios = {"adj_ratio": (z("ADJ"), z("VERB")), "v_ratio": (z("NOUN"), z("VERB")), "n_ratio": (z("NOUN"), f"({z('VERB')} + {z('NOUN')})"), "pn_ratio": (z("PNOUN"), z("NOUN")), "sc_ratio": (z("PREP"), z("CC"))}
    return f"""with {base} tok as (select id, string_split({text}, ' ') as ws from {source}), n as (select id, sum(len(ws)) as n from tok group by id),
 tagged as (select id, {_tag_sql("w")} as tag from (select id, unnest(ws) as w from tok) where w <> ''), cls as (select id, unnest({_CLASS_SQL}) as c from tagged), p as (select id, {counts} from cls group by id)
 select n.id, {shares}, {', '.join(f'{_ratio(a, b)} as {k}' for k, (a, b) in ratios.items())} from n left join p on n.id = p.id"""


_NAIVE = rf"""tok as (select id, list_filter(regexp_split_to_array(lower({_sql_clean("coalesce(text, 'nan')")}), '[{_WS}]+'), lambda w: w <> '') as ws from seg),
 e0 as (select id, unnest(list_transform(range(1, len(ws)), lambda i: {{'src': ws[i], 'dst': ws[i + 1]}})) as p from tok where len(ws) > 1),
 e as (select id, p.src as src, p.dst as dst, count(*) as mult from e0 group by all)"""
_SINGLE = "alone as (select id, ws[1] as v from tok where len(ws) = 1)"
_EACH = "seg as (select cast(result_id as varchar) as id, text from recognition_results where text is not null)"


#: Good word timings of the test data as JSON. ``{rows}`` has a column word_timing; j is null for bad ones.
SQL_JSON = r"""(select *, case when js is not null and json_type(js) = 'ARRAY' and coalesce(list_bool_and(list_transform(cast(js as json[]), lambda r: json_type(r) = 'OBJECT' and coalesce(json_type(r, '$.Word') = 'VARCHAR', false)
 and coalesce(json_type(r, '$.Offset') = 'UBIGINT', false) and coalesce(json_type(r, '$.Duration') = 'UBIGINT', false))), true) then cast(js as json[]) end as j
 from (select *, case when json_valid(word_timing) then cast(word_timing as json) when json_valid(pj) then cast(pj as json) end as js
 from (select *, replace(replace(regexp_replace(replace(word_timing, '\''', chr(2)), '"([^"'']*)''([^"'']*)"', '"\1' || chr(2) || '\2"', 'g'), '''', '"'), chr(2), '''') as pj from {rows})))"""


SQL: dict[str, str] = {
    "verbosity_word_stats": f"""with {_SENT}, w as (select id, string_split(s, ' ') as ws from sent), c as (select id, len(ws) as n, len(list_filter(ws, lambda x: length(x) > 6)) as l, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as ch from w)
 select id, {_d5("n", "wc", ("max", "min", "mean", "median", "stdev"))}, cast(sum(n) as bigint) as total_count, {_ratio("sum(l)", "sum(n)")} as lw_count, {_ratio("sum(ch)", "sum(n)")} as word_len from c group by id""",
    "verbosity_syllables": f"""with {_SENT}, w as (select id, unnest(string_split(s, ' ')) as w from sent), c as (select id, case when w = '' then 0 else greatest(len(regexp_extract_all(lower(w), '[aeiouy]+')), 1) end as y from w)
 select id, {_d5("y", "syll", ("max", "min", "mean", "median", "stdev"))} from c group by id""",
    "mattr": f"""with {_SEG}, {_WORDS} select id, {", ".join(f"round(list_avg(list_transform(range(1, len(ws) - least({k}, len(ws)) + 2), lambda i: len(list_distinct(ws[i:i + least({k}, len(ws)) - 1])))) / least({k}, len(ws)), 6) as MATTR_{k}" for k in features.MATTR_WINDOWS)} from words""",
    "honore": f"with {_SEG}, {_WORDS} {_HONORE}",
    "honore_by_feature": f"with {_FEAT}, {_WORDS} {_HONORE}",
    "clean_text": f"select doc_id, md5({_sql_clean('text')}) as cleaned from documents",
    "sentence_split": f"""select doc_id, cast(no - 1 as bigint) as no, length(s) as n_chars, md5(s) as digest from (select doc_id, unnest(x) as s, generate_subscripts(x, 1) as no from (select doc_id, {_sql_sentences("text")} as x from documents where text is not null))""",
    "pos_from_tags": _pos_sql(f"{_EACH},", "seg", "text"),
    "graph_counts": f"""with {_SEG}, {_NAIVE}, {_SINGLE}, nodes as (select id, count(*) as n from (select id, src as v from e union select id, dst from e union select id, v from alone) group by id),
 s as (select id, sum(mult) as m, sum(mult - 1) as p, sum(case when src = dst then mult else 0 end) as l1, sum(case when src <> dst then 1 else 0 end) as pairs from e group by id)
 select nodes.id, n as num_nodes_naive, cast(coalesce(m, 0) as bigint) as num_edges_naive, {_ratio("2 * coalesce(m, 0)", "n")} as ave_degree_naive, cast(coalesce(p, 0) as bigint) as num_p_edges_naive, cast(coalesce(l1, 0) as bigint) as l1_naive, {_ratio("coalesce(pairs, 0)", "n * n")} as d_naive from nodes left join s on nodes.id = s.id""",
    "graph_loops": f"""with {_SEG}, {_NAIVE}, {_SINGLE}, x as (select * from e where src <> dst), l2 as (select a.id, sum(a.mult * b.mult) / 2 as l2 from x a join x b on a.id = b.id and a.dst = b.src and b.dst = a.src group by a.id),
 l3 as (select a.id, sum(a.mult * b.mult * c.mult) / 3 as l3 from x a join x b on a.id = b.id and a.dst = b.src join x c on b.id = c.id and b.dst = c.src and c.dst = a.src group by a.id), ids as (select distinct id from (select id from e union all select id from alone))
 select ids.id, round(cast(coalesce(l2, 0) as double), 6) as l2_naive, round(cast(coalesce(l3, 0) as double), 6) as l3_naive from ids left join l2 on ids.id = l2.id left join l3 on ids.id = l3.id""",
    "graph_connectivity": f"""with recursive {_EACH}, {_NAIVE}, {_SINGLE}, nodes as (select id, src as v from e union select id, dst from e union select id, v from alone),
 und as (select id, src as a, dst as b from e where src <> dst union select id, dst, src from e where src <> dst), dirr as (select distinct id, src as a, dst as b from e),
 walk(id, a, b, d) as (select id, v, v, 0 from nodes union select w.id, w.a, u.b, w.d + 1 from walk w join und u on w.id = u.id and w.b = u.a where w.d < 60),
 far as (select id, a, b, min(d) as d from walk group by all),
 reach(id, a, b) as (select id, v, v from nodes union select r.id, r.a, x.b from reach r join dirr x on r.id = x.id and r.b = x.a),
 strong as (select p.id, p.a, count(*) as n from reach p join reach q on p.id = q.id and p.a = q.b and p.b = q.a group by p.id, p.a),
 weak as (select id, a, count(*) as n, sum(d) as t, max(d) as m from far group by id, a)
 select w.id, max(w.n) as lcc_naive, max(s.n) as lsc_naive, cast(max(w.m) as bigint) as di_naive, round(coalesce(cast(sum(w.t) as double) / nullif(sum(w.n - 1), 0), 0), 6) as asp_naive from weak w join strong s on w.id = s.id and w.a = s.a group by w.id""",
    "non_verbal_ratios": f"""with t as (select coalesce(lower(trim(source)), 'none') as id, string_split(trim(coalesce(text, '')), ' ') as ws from documents) select id, {", ".join(f"{_ratio(f'''sum(len(list_filter(ws, lambda x: x = '{t}')))''', 'sum(len(ws))')} as {k}" for k, t in features.NON_VERBAL.items())} from t group by id""",
    "confidence_stats": f"with {_SEG} select id, {_d5('confidence', 'conf')} from seg where confidence is not null and not isnan(confidence) group by id",
    "confidence_by_feature": f"with {_FEAT} select id, {_d5('confidence', 'conf')} from seg where confidence is not null and not isnan(confidence) group by id",
    "describe5_lineitem": f"select l_returnflag, l_linestatus, {_d5('l_quantity', 'qty')}, {_d5('l_extendedprice', 'price')} from lineitem group by all",
    "level_call": f"with {_SEG}, {_META} select id, count(*) as n_segments from seg where id in (select call_id from meta) group by id",
    "level_day": f"with {_SEG}, {_META} select {_DAY_ID} as id, count(*) as n_segments from seg join meta on seg.id = meta.call_id group by 1",
    "call_type_filter": f"with {_META} select call_id, subject_id, is_assessment, day from meta where is_assessment",
    "call_durations": f"with {_DUR} select call_id, round(duration_s, 6) as duration_s from dur",
    "hypothesis_mean": f"""with {_SEG}, h as (select id, 0 as hyp, text as t from seg where text is not null union all select id, 1, text_basic from seg where text_basic is not null), w as (select id, hyp, string_split(t, ' ') as ws from h),
 f as (select id, hyp, avg(len(ws)) as wc_mean, sum(len(ws)) as total_count, sum(len(list_filter(ws, lambda x: length(x) > 6))) / cast(sum(len(ws)) as double) as lw_count, sum(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)) / cast(sum(len(ws)) as double) as word_len from w group by id, hyp)
 select id, round(avg(wc_mean), 6) as wc_mean, round(avg(total_count), 6) as total_count, round(avg(lw_count), 6) as lw_count, round(avg(word_len), 6) as word_len from f group by id""",
    "stopword_filter": f"""with {_SEG} select id, cast(sum(len(list_filter(string_split(text_basic, ' '), lambda w: w not in ({", ".join(f"'{w}'" for w in STOP)})))) as bigint) as n_words from seg where text_basic is not null group by id""",
    "sound_filter": """select doc_id, n_words from (select doc_id, len(list_filter(string_split(text, ' '), lambda w: w not in ('[laughter]', '[noise]', '<unk>'))) as n_words from documents where text is not null) where n_words > 0""",
    "min_words_filter": f"""with {_SEG}, h as (select id, 0 as hyp, text as t from seg where text is not null union all select id, 1, text_basic from seg where text_basic is not null), ok as (select distinct id from (select id, hyp, sum(len(string_split(t, ' '))) as n from h group by id, hyp) where n >= 50)
 select id, count(*) as n_rows from h where id in (select id from ok) group by id""",
    "bag_of_words": f"with {_SEG} select id, word, count(*) as tf from (select id, unnest(string_split(text_basic, ' ')) as word from seg where text_basic is not null) group by id, word",
    "vocab_trim": f"""with {_SEG}, bag as (select id, word, count(*) as tf from (select id, unnest(string_split(text_basic, ' ')) as word from seg where text_basic is not null) group by id, word), n as (select count(distinct id) as n from bag)
 select word, cast(sum(tf) as bigint) as tf from bag group by word having count(*) >= 5 and count(*) <= 0.6 * (select n from n)""",
    "phrase_scores": f"""with {_SEG}, tok as (select string_split(text_basic, ' ') as ws from seg where text_basic is not null), uni as (select w, count(*) as n from (select unnest(ws) as w from tok) group by w),
 bi as (select p.a as a, p.b as b, count(*) as n_ab from (select unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) as p from tok where len(ws) > 1) group by all), v as (select (select count(*) from uni) + (select count(*) from bi) as v)
 select * from (select bi.a, bi.b, n_ab, round((n_ab - 5) * cast(v as double) / (x.n * y.n), 6) as score from bi join uni x on bi.a = x.w join uni y on bi.b = y.w, v where n_ab > 5) where score > {PHRASE_THRESHOLD}""",
}

# breadth-first search that keeps the first distance of each pair, without a bound on the steps
SQL["graph_connectivity_call"] = f"""with recursive {_SEG}, {_NAIVE}, {_SINGLE}, nodes as (select id, src as v from e union select id, dst from e union select id, v from alone),
 und as (select id, src as a, dst as b from e where src <> dst union select id, dst, src from e where src <> dst), dirr as (select distinct id, src as a, dst as b from e),
 far(id, a, b, d) using key (id, a, b) as (select id, v, v, 0 from nodes union (select distinct f.id, f.a, u.b, f.d + 1 from far f join und u on f.id = u.id and f.b = u.a left join recurring.far r on r.id = f.id and r.a = f.a and r.b = u.b where r.d is null)),
 reach(id, a, b) as (select id, v, v from nodes union select r.id, r.a, x.b from reach r join dirr x on r.id = x.id and r.b = x.a),
 strong as (select p.id, p.a, count(*) as n from reach p join reach q on p.id = q.id and p.a = q.b and p.b = q.a group by p.id, p.a),
 weak as (select id, a, count(*) as n, sum(d) as t, max(d) as m from far group by id, a)
 select w.id, max(w.n) as lcc_naive, max(s.n) as lsc_naive, cast(max(w.m) as bigint) as di_naive, round(coalesce(cast(sum(w.t) as double) / nullif(sum(w.n - 1), 0), 0), 6) as asp_naive from weak w join strong s on w.id = s.id and w.a = s.a group by w.id"""
_GRAPH = ("num_nodes", "num_edges", "ave_degree", "num_p_edges", "l1", "d", "lcc", "lsc", "di", "asp")
_CONNECTED = SQL["graph_connectivity_call"].replace("round(coalesce(cast(sum(w.t) as double) / nullif(sum(w.n - 1), 0), 0), 6) as asp_naive", "coalesce(cast(sum(w.t) as double) / nullif(sum(w.n - 1), 0), 0) as asp_naive")
_COUNTED = SQL["graph_counts"].replace(_ratio("2 * coalesce(m, 0)", "n"), "cast(2 * coalesce(m, 0) as double) / n").replace(_ratio("coalesce(pairs, 0)", "n * n"), "cast(coalesce(pairs, 0) as double) / (n * n)")
SQL["graph_features_naive"] = f"""select id, {", ".join(f"{f'round({c}_naive, 6)' if c in ('ave_degree', 'd', 'asp') else f'{c}_naive'} as {c}_naive, {_ratio(f'{c}_naive', 'chars')} as {c}_naive_norm" for c in _GRAPH)}
 from ({_COUNTED}) join ({_CONNECTED}) using (id) join (with {_SEG} select id, sum(length({_sql_clean("coalesce(text, 'nan')")})) as chars from seg group by id) using (id)"""


def _phrase_sql(n: int, least: int = 5) -> str:
    """Round n of phrases: ``t{n-1}`` (result_id, ws) -> ``t{n}``; greedy from left to right, one step a word."""
    t = f"t{n - 1}"
    return f"""u{n} as (select w, count(*) as n from (select unnest(ws) as w from {t}) group by w),
 b{n} as (select p.a as a, p.b as b, count(*) as n_ab from (select unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) as p from {t} where len(ws) > 1) group by all),
 f{n} as (select b{n}.a, b{n}.b from b{n} join u{n} x on a = x.w join u{n} y on b = y.w, (select (select count(*) from u{n}) + (select count(*) from b{n}) as v) where n_ab > {least} and (n_ab - {least}) * cast(v as double) / (x.n * y.n) > {PHRASE_THRESHOLD}),
 g{n}(result_id, ws, i, done) as (select result_id, ws, 1, cast([] as varchar[]) from {t} union all select result_id, ws, case when f.a is not null then i + 2 else i + 1 end, list_append(done, case when f.a is not null then ws[i] || '_' || ws[i + 1] else ws[i] end)
 from g{n} left join f{n} f on f.a = ws[i] and f.b = ws[i + 1] where i <= len(ws)), t{n} as (select result_id, done as ws from g{n} where i > len(ws))"""


_T0 = f"t0 as (select tie as result_id, string_split(text_basic, ' ') as ws from seg where text_basic is not null)"
SQL["phrase_apply"] = f"with recursive {_SEG}, {_T0}, {_phrase_sql(1)} select result_id, array_to_string(ws, ' ') as text from t1"
SQL["phrase_triples"] = f"with recursive {_SEG}, {_T0}, {_phrase_sql(1)}, {_phrase_sql(2)} select result_id, array_to_string(ws, ' ') as text from t2"

for _level, _cols, _join in (("", "call_id", ""), ("_day", "subject_id, day", "join meta using (call_id)"), ("_week", "subject_id, week", "join (select *, strftime(date_trunc('week', cast(day as date)), '%Y-%m-%d') as week from meta) using (call_id)"), ("_subject", "subject_id", "join meta using (call_id)"), ("_segment", "segment_id", "")):
    _lines = f"""ln as (select {sql_key("call_id")} as call_id, string_split(conf_scores, ' ')[1] as segment_id, case when regexp_matches(string_split(conf_scores, ' ')[6], '{files.NUMBER}') then try_cast(string_split(conf_scores, ' ')[6] as double) end as conf from conf_sym where len(string_split(conf_scores, ' ')) = 6)"""
    SQL[f"kaldi_confidence{_level}"] = f"with {_META}, {_lines} select {_cols}, {_d5('conf', 'conf')} from ln {_join} where call_id is not null and conf is not null and not isnan(conf) group by {_cols}"

_MEASURES = f"""src as (select id, off, duration, word_timing from seg), lit as (select id, off, duration, list_transform(coalesce(j, cast([] as json[])), lambda r: {{'o': cast(r->>'$.Offset' as bigint), 'd': cast(r->>'$.Duration' as bigint)}}) as w from {SQL_JSON.format(rows="src")}),
 m as (select id, 'segments' as kind, cast(duration as double) as value from lit where duration is not null
 union all select id, 'wps', cast(len(w) as double) / nullif(duration * 1e-7, 0) from lit where len(w) > 0 and duration is not null and duration <> 0
 union all select id, 'words', unnest(list_transform(w, lambda x: cast(x.d as double))) from lit
 union all select id, 'silences', g from (select id, unnest(list_transform(range(1, len(w) + 2), lambda i: (case when i <= len(w) then w[i].o else off + duration end - case when i = 1 then off else w[i - 1].o + w[i - 1].d end)::double)) as g from lit where len(w) > 0) where g <> 0)"""


def _timing_sql(total: str) -> str:
    d5 = ", ".join(_d5(f"case when kind = '{k}' then value end", k, unit=features.TICKS.get(k)) for k in ("segments", "silences", "words", "wps"))
    n = lambda k: f"count(case when kind = '{k}' then 1 end)"
    s = lambda k: f"coalesce(sum(case when kind = '{k}' then value end), 0)"
    spoken, silent = f"({s('segments')} * cast(1e-7 as double))", f"({s('silences')} * cast(1e-7 as double))"
    return f"""f as (select id, {d5}, {silent} as sil, {spoken} as spk, {n("silences")} as sil_count, {n("segments")} as segment_count, {n("words")} as word_count, count(case when kind = 'segments' and value <= 1e7 then 1 end) as short_utt_count from m group by id),
 timing as (select f.* exclude (sil, spk), round(sil, 6) as sil_duration, round(spk, 6) as spk_duration, {_ratio("spk", "sil")} as spk_sil_ratio, {_ratio("sil_count", "spk")} as sps, {_ratio("word_count", "spk")} as wps, round(coalesce(t.duration_s, 0), 6) as total_duration,
 {_ratio("spk", "coalesce(t.duration_s, 0)")} as spk_ratio, {_ratio("sil", "coalesce(t.duration_s, 0)")} as sil_ratio, {_ratio("segment_count", "coalesce(t.duration_s, 0) / 60")} as segs_per_min, {_ratio("short_utt_count", "coalesce(t.duration_s, 0) / 60")} as short_utts_per_min
 from f left join {total} t on f.id = t.id)"""


_CALL_TOTAL = "(select call_id as id, duration_s from dur)"
_DAY_TOTAL = f"(select {_DAY_ID} as id, sum(duration_s) as duration_s from meta join dur using (call_id) group by 1)"
_BY_DAY = f"seg0 as (select * from seg), {_META}"
_ACTIVITY = ", ".join(features.CALL_ACTIVITY)
_SEG_DAY = _SEG.replace("seg as (select", "seg1 as (select", 1) + f", {_META}, seg as (select {_DAY_ID} as id, off, duration, word_timing from seg1 join meta on seg1.id = meta.call_id)"
SQL["ms_timing"] = f"with {_SEG}, {_DUR}, {_MEASURES}, {_timing_sql(_CALL_TOTAL)} select * from timing"
SQL["call_activity"] = f"with {_SEG}, {_DUR}, {_MEASURES}, {_timing_sql(_CALL_TOTAL)} select id, {_ACTIVITY} from timing"
SQL["ms_timing_day"] = f"with {_SEG_DAY}, {_DUR}, {_MEASURES}, {_timing_sql(_DAY_TOTAL)} select * from timing"
SQL["call_activity_split"] = f"with {_SEG_DAY}, {_DUR}, {_MEASURES}, {_timing_sql(_DAY_TOTAL)} select id, {_ACTIVITY}, regexp_replace(id, '_[^_]*$', '') as subject_id, regexp_extract(id, '([^_]*)$', 1) as date from timing"


def _kaldi_sql(level: str) -> str:
    keys = ", ".join(sg.LEVEL_KEYS[level])
    d5 = ", ".join(_d5(f"case when kind = '{k}' then value end", k, unit=1e-3 if k == "segments" else None) for k in ("segments", "silences", "words", "wps", "phones", "pps"))
    n = lambda k: f"count(case when kind = '{k}' then 1 end)"
    s = lambda k: f"coalesce(sum(case when kind = '{k}' then value end), 0)"
    meta = "" if level in ("call", "segment") else f"{_META}, wk as (select call_id, subject_id, day, strftime(date_trunc('week', cast(day as date)), '%Y-%m-%d') as week from meta),"
    joined = "" if level in ("call", "segment") else "join wk using (call_id)"
    total = {
        "segment": "select distinct segment_id, sd * 0.001 as t from r",
        "call": "select call_id, duration_s as t from dur",
    }.get(level, f"select {keys}, sum(duration_s) as t from (select distinct call_id, {keys} from r join wk using (call_id)) join dur using (call_id) group by {keys}")
    same = " and ".join(f"f.{k} is not distinct from t.{k}" for k in sg.LEVEL_KEYS[level])
    spk, sil, dur = "spk", "sil", "coalesce(t.t, 0)"
    return f"""with {meta} {_DUR}, kr as (select {sql_key("audio_file_id")} as k, result_id, coalesce("offset", 0) as o, coalesce(duration, 0) as d, word_timing from recognition_results),
 sp as (select k as call_id, concat_ws('_', 's', k, result_id * 1000, result_id * 1000 + d // 10000) as segment_id, d // 10000 as sd, list_transform(j, lambda x: {{'s': trunc((cast(x->>'$.Offset' as bigint) - o) / {_FRAME}), 'e': trunc((cast(x->>'$.Offset' as bigint) + cast(x->>'$.Duration' as bigint) - o) / {_FRAME})}}) as w
  from {SQL_JSON.format(rows="kr")} where k is not null and len(j) > 0),
 wd as (select call_id, segment_id, sd, i, w[i].s as s, w[i].e as e, case when i = 1 then 0 else w[i - 1].e end as pe, len(w) as nw, w from (select *, unnest(range(1, len(w) + 1)) as i from sp)),
 r as (select *, case when s > pe then s - pe end as sil, case when i = nw then case when e - s > 20 then e else e end else case when w[i + 1].s > e then e else w[i + 1].s end end as upto from wd),
 seg as (select call_id, segment_id, cast(arg_max(e, i) as double) * 25 / 1000 as sec, count(*) as nw, sum(case when e - s > 20 then 2 else 1 end) as np from r group by call_id, segment_id),
 m as (select call_id, segment_id, 'words' as kind, cast((upto - s) * 25 as double) as value from r union all select call_id, segment_id, 'silences', cast(sil * 25 as double) from r where sil is not null
 union all select call_id, segment_id, 'phones', cast((e - s) * 25 as double) from r where e - s <= 20 union all select call_id, segment_id, 'phones', 500.0 from r where e - s > 20 union all select call_id, segment_id, 'phones', cast((e - s - 20) * 25 as double) from r where e - s > 20
 union all select call_id, segment_id, 'segments', sec * 1000 from seg union all select call_id, segment_id, 'wps', nw / nullif(sec, 0) from seg union all select call_id, segment_id, 'pps', np / nullif(sec, 0) from seg),
 f as (select {keys}, {d5}, {s("silences")} * 1e-3 as sil, {s("segments")} * cast(1e-3 as double) as spk, {n("silences")} as sil_count, {n("segments")} as segment_count, {n("words")} as word_count, count(case when kind = 'segments' and value <= 1000 then 1 end) as short_utt_count, {n("phones")} as phone_count from m {joined} group by {keys}),
 t as ({total})
 select f.* exclude (sil, spk), round({sil}, 6) as sil_duration, round({spk}, 6) as spk_duration, {_ratio(spk, sil)} as spk_sil_ratio, {_ratio("sil_count", spk)} as sps, {_ratio("word_count", spk)} as wps, {_ratio("phone_count", spk)} as pps, round({dur}, 6) as total_duration,
 {_ratio(spk, dur)} as spk_ratio, {_ratio(sil, dur)} as sil_ratio, {_ratio("segment_count", dur + " / 60")} as segs_per_min, {_ratio("short_utt_count", dur + " / 60")} as short_utts_per_min from f left join t on {same}"""


for _level in sg.LEVEL_KEYS:
    SQL["kaldi_timing" if _level == "call" else f"kaldi_timing_{_level}"] = _kaldi_sql(_level)

SQL["transcript_diversity_subject"] = f"""with {_SEG}, {_META}, h as (select id, tie, 0 as hyp, text as t from seg where text is not null union all select id, tie, 1, text_basic from seg where text_basic is not null),
 words as (select subject_id as sub, hyp, string_split(string_agg(t, ' ' order by day nulls first, id, tie), ' ') as ws from h join meta on h.id = meta.call_id group by all),
 mt as (select sub, hyp, {", ".join(f"list_avg(list_transform(range(1, len(ws) - least({k}, len(ws)) + 2), lambda i: len(list_distinct(ws[i:i + least({k}, len(ws)) - 1])))) / least({k}, len(ws)) as m{k}" for k in features.MATTR_WINDOWS)} from words),
 hs as (select sub, hyp, 100 * ln(n / (1 - v1 / (v + 1e-5))) as hs from (select sub, hyp, cast(sum(c) as double) as n, cast(count(*) as double) as v, cast(sum(case when c = 1 then 1 else 0 end) as double) as v1 from (select sub, hyp, w, count(*) as c from (select sub, hyp, unnest(ws) as w from words) group by all) group by all))
 select sub as subject_id, {", ".join(f"round(avg(m{k}), 6) as MATTR_{k}" for k in features.MATTR_WINDOWS)}, round(avg(hs), 6) as HS from mt join hs using (sub, hyp) group by sub"""


def _liwc_sql() -> str:
    lex = ", ".join("('{}', {}, '{}')".format(p.rstrip("*"), "true" if p.endswith("*") else "false", c) for p, c in LEXICON)
    cats = sorted({c for _, c in LEXICON})
    sums = ", ".join(f"sum(case when category = '{c}' then c end) as {c}" for c in cats)
    return f"""with {_SENT}, lex(pattern, is_prefix, category) as (values {lex}), w as (select id, string_split(s, ' ') as ws from sent), n as (select id, sum(len(ws)) as n from w group by id),
 g as (select id, g, count(*) as c from (select id, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) as g from w) group by id, g),
 voc as (select distinct g from g), hits as (select g, category, case when is_prefix then length(pattern) end as len from voc join lex on (not is_prefix and g = pattern) or (is_prefix and starts_with(g, pattern))),
 best as (select g, min(len) as best from hits group by g), kept as (select distinct hits.g, category from hits join best on hits.g = best.g where best is null or len = best),
 s as (select id, {sums} from g join kept on g.g = kept.g group by id) select n.id, {", ".join(f"{_ratio(f'coalesce(s.{c}, 0)', 'n')} as {c}_liwc" for c in cats)} from n left join s on n.id = s.id"""


SQL["liwc_fractions"] = _liwc_sql()
SQL["pos_by_call"] = _pos_sql(f"{_SENT}, cased as (select id, case when s = lower(s) and s <> upper(s) then regexp_replace(upper(s[1]) || s[2:], '\\bi\\b', 'I', 'g') else s end as s from sent),", "cased", "s")
