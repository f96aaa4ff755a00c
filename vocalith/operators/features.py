"""Feature operators: DataFrame of segments or sentences in, one row an id out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions import text as tx
from vocalith.functions.literals import with_word_list
from vocalith.functions.stats import describe5, ratio
from vocalith.operators import segments as sg

#: Window sizes of the moving type-token ratio.
MATTR_WINDOWS = (10, 25, 50)
#: Words of one shard of a text's positions.
POSITIONS = 65_536
#: Words of at least so many characters are long.
LONG_WORD = 7
#: Tokens of sounds that are no words, and the feature each counts for.
NON_VERBAL = {"laughter": "[laughter]", "noise": "[noise]", "unk": "<unk>"}
#: Ticks of 100 ns to seconds and milliseconds; frames of 25 ms.
TICK_S, TICK_MS, FRAME_MS = 1e-7, 1e-4, 25
#: Places after the point with which scores are summed.
SCORE_PLACES = 18
#: Units of the measures of recognizer segments, which are counted in whole ticks.
TICKS = {"segments": TICK_S, "silences": TICK_MS, "words": TICK_MS}


# verbosity -----------------------------------------------------------------------------------------------------------


def word_stats(sentences: DataFrame) -> DataFrame:
    """Words per sentence (describe-5), their total, the share of long words and the mean word length. Empty tokens are words."""
    rows = sentences.select("id", tx.words("text").alias("w"))
    rows = rows.select("id", F.size("w").alias("n"), F.size(F.filter("w", lambda x: F.length(x) >= LONG_WORD)).alias("long"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))
    names = ("max", "min", "mean", "median", "stdev")
    return rows.groupBy("id").agg(*describe5(F.col("n"), "wc", names=names), F.sum("n").alias("total_count"), ratio(F.sum("long"), F.sum("n")).alias("lw_count"), ratio(F.sum("chars"), F.sum("n")).alias("word_len"))


def syllable_stats(sentences: DataFrame, syllables: Callable[[Column], Column] = tx.syllables) -> DataFrame:
    words = sentences.select("id", F.explode(tx.words("text")).alias("w"))
    return words.groupBy("id").agg(*describe5(syllables(F.col("w")), "syll", names=("max", "min", "mean", "median", "stdev")))


def verbosity(sentences: DataFrame, syllables: Callable[[Column], Column] = tx.syllables) -> DataFrame:
    return word_stats(sentences).join(syllable_stats(sentences, syllables), "id")


# lexical diversity ---------------------------------------------------------------------------------------------------


def word_positions(segments: DataFrame, text: str = "text_basic", null_text: str = "nan") -> DataFrame:
    """(id, j, w): the words of each id's segments joined in order, numbered from 0."""
    counted = segments.select("id", "ord", "tie", tx.words(tx.text_or_nan(text, null_text)).alias("ws")).where("ws is not null").withColumn("n", F.size("ws"))
    placed = tx.running_sum(counted, ["id"], "n", "start")
    return placed.select("id", "start", F.posexplode("ws").alias("i", "w")).select("id", (F.col("start") + F.col("i")).alias("j"), "w")


def mattr(positions: DataFrame, windows: tuple[int, ...] = MATTR_WINDOWS) -> DataFrame:
    """Mean share of distinct words over all windows of a size; a window longer than the text is the text.

    No window is formed: a word at j whose last occurrence was at p is the first of its kind in the windows that start
    after p and reach j, and those can be counted.
    """
    sized = positions.join(positions.groupBy("id").agg(F.count("*").alias("n")), "id")
    # only an occurrence within the largest window matters: positions are cut into shards that hold so many words before them, too
    back, shard = max(windows), F.floor(F.col("j") / POSITIONS)
    cut = F.when(F.pmod("j", F.lit(POSITIONS)) >= POSITIONS - back, F.array(shard, shard + 1)).otherwise(F.array(shard))
    sharded = sized.select("id", "j", "w", "n", F.explode(cut).alias("shard"))
    last = sharded.withColumn("p", F.lag("j").over(Window.partitionBy("id", "w", "shard").orderBy("j"))).where(F.floor(F.col("j") / POSITIONS) == F.col("shard"))

    def share(size: int) -> Column:
        w = F.least(F.lit(size), F.col("n"))
        first = F.greatest(F.coalesce(F.col("p") + 1, F.lit(0)), F.col("j") - w + 1, F.lit(0))
        hits = F.greatest(F.lit(0), F.least(F.col("j"), F.col("n") - w) - first + 1)
        return (F.sum(hits) / F.max(w * (F.col("n") - w + 1))).alias(f"MATTR_{size}")

    return last.groupBy("id").agg(*(share(s) for s in windows))


def honore(positions: DataFrame) -> DataFrame:
    """100 ln(N / (1 - V1 / (V + 1e-5))): all words, words used once, distinct words."""
    counts = positions.groupBy("id", "w").agg(F.count("*").alias("c")).groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("int")).alias("v1"))
    return counts.select("id", (100 * F.ln(F.col("n") / (1 - F.col("v1") / (F.col("v") + 1e-5)))).alias("HS"))


def lexical_diversity(segments: DataFrame, text: str = "text_basic") -> DataFrame:
    positions = word_positions(segments, text)
    return mattr(positions).join(honore(positions), "id")


# dictionary categories -----------------------------------------------------------------------------------------------


def liwc(sentences: DataFrame, lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """Share of words in each category of a dictionary (pattern, is_prefix, category): hits of words, pairs and triples of a sentence over words.

    A prefix pattern wins at its shortest over all others; exact patterns count else. A token counts once a category. The
    lexicon is one dictionary, bounded by its file.
    """
    # split once: inside a lambda an expression is evaluated per element
    sentences = sentences.select("id", tx.words("text").alias("ws"))
    tokens = F.col("ws")
    known = [r.pattern for r in lexicon.select("pattern").distinct().collect()]  # one dictionary
    # only tokens that begin as some pattern does are sent anywhere
    single, double = sorted({p[:1] for p in known if len(p) < 2}), sorted({p[:2] for p in known if len(p) >= 2})
    begins = lambda g: F.substring(g, 1, 2).isin(*double) | F.substring(g, 1, 1).isin(*single) if "" not in single else F.lit(True)
    grams = F.filter(F.concat(tokens, tx.ngrams(tokens, 2), tx.ngrams(tokens, 3)), begins)
    # equal tokens of an id are one row after the map-side half
    used = sentences.select("id", F.explode(grams).alias("g")).groupBy("id", "g").agg(F.count("*").alias("c"))
    # each different token is held against the dictionary once, whichever ids have it
    lex = lexicon.select("is_prefix", "pattern", "category").distinct()
    longest = max((len(p) for p in known), default=1)
    upto = F.greatest(F.least(F.length("g"), F.lit(longest)), F.lit(1))
    whole = F.array(F.struct(F.lit(False).alias("is_prefix"), F.col("g").alias("pattern")))
    starts = F.transform(F.sequence(F.lit(1), upto), lambda i: F.struct(F.lit(True).alias("is_prefix"), F.substring(F.col("g"), F.lit(1), i).alias("pattern")))
    tried = used.select("g").distinct().select("g", F.explode(F.concat(whole, starts)).alias("p")).select("g", "p.*")
    hits = tried.join(lex, ["is_prefix", "pattern"]).withColumn("len", F.when(F.col("is_prefix"), F.length("pattern")))
    kept = hits.withColumn("best", F.min("len").over(Window.partitionBy("g"))).where("best is null or len = best").select("g", "category").distinct()
    sums = used.join(kept, "g").groupBy("id").agg(*(F.sum(F.when(F.col("category") == c, F.col("c"))).alias(c) for c in categories))
    n = sentences.groupBy("id").agg(F.sum(F.size(tokens)).alias("n"))
    return n.join(sums, "id", "left").select("id", *(ratio(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.col("n")).alias(f"{c}_liwc") for c in categories))


# parts of speech -----------------------------------------------------------------------------------------------------

#: The classes of parts of speech.
POS_CLASSES = ("ADJ", "VERB", "NOUN", "ADV", "DET", "INT", "PREP", "CC", "PNOUN", "PSNOUN")


def pos_classes(tag: Column) -> Column:
    """array<string>: the classes of a Penn tag; empty for tags that count for none."""
    of = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(tag == "CC", of("CC"))
        .when(tag == "PRP", of("NOUN", "PNOUN"))
        .when(tag == "PRP$", of("NOUN", "PSNOUN"))
        .when(tag.startswith("J"), of("ADJ"))
        .when(tag.startswith("V"), of("VERB"))
        .when(tag.startswith("N"), of("NOUN"))
        .when(tag.startswith("R"), of("ADV"))
        .when(tag.startswith("D") | tag.startswith("WD"), of("DET"))
        .when(tag.startswith("U"), of("INT"))
        .when(tag.startswith("I") | tag.startswith("T"), of("PREP"))
        .when(tag.startswith("WR"), of("ADV"))
        .when(tag.startswith("W") & tag.endswith("P"), of("NOUN", "PNOUN"))
        .when(tag.startswith("W"), of("PSNOUN"))
        .otherwise(F.array().cast("array<string>"))
    )


def pos_features(tagged: DataFrame, n_words: DataFrame) -> DataFrame:
    """tagged (id, tag) and n_words (id, n: all tokens, empty ones too) -> shares of classes and ratios of their counts; null for a zero denominator."""
    classes = tagged.select("id", F.explode_outer(pos_classes(F.col("tag"))).alias("c"))
    counts = classes.groupBy("id").agg(*(F.count(F.when(F.col("c") == k, 1)).alias(k) for k in POS_CLASSES))
    full = n_words.join(counts, "id", "left").na.fill(0, list(POS_CLASSES))
    c = F.col
    ratios = {"adj_ratio": (c("ADJ"), c("VERB")), "v_ratio": (c("NOUN"), c("VERB")), "n_ratio": (c("NOUN"), c("VERB") + c("NOUN")), "pn_ratio": (c("PNOUN"), c("NOUN")), "sc_ratio": (c("PREP"), c("CC"))}
    return full.select("id", *(ratio(a, b).alias(k) for k, (a, b) in ratios.items()), *(ratio(c(k), c("n")).alias(f"{k}_p") for k in POS_CLASSES)).select("id", *(c(f"{k}_p").alias(k) for k in POS_CLASSES), *ratios)


# confidence and sounds -----------------------------------------------------------------------------------------------


def confidence(rows: DataFrame, keys: list[str], score: str = "confidence") -> DataFrame:
    """Describe-5 of scores; null and NaN are no scores, and a group of none has no row."""
    good = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    return good.groupBy(*keys).agg(*describe5(F.col(score), "conf", exact=SCORE_PLACES))


def non_verbal(rows: DataFrame, text: str = "text") -> DataFrame:
    """Share of laughter, noise and unknown tokens among the tokens of all segments of an id."""
    tokens = rows.select("id", tx.words(F.trim(F.coalesce(text, F.lit("")))).alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    counts = tokens.select("id", F.size("w").alias("n"), *(count(t).alias(k) for k, t in NON_VERBAL.items()))
    return counts.groupBy("id").agg(*(ratio(F.sum(k), F.sum("n")).alias(k) for k in NON_VERBAL))


# timing --------------------------------------------------------------------------------------------------------------


def timing_measures(segments: DataFrame) -> DataFrame:
    """(id, kind, value) of recognizer segments, in ticks: ``segments``, ``silences`` (zeros dropped, overlaps stay negative), ``words``; and the rate ``wps`` per second.

    Silences run from the segment's start to its first word, between words, and from the last word to the segment's end.
    A segment whose word timing can't be read, or is empty, has no words and no silences. All inside the row, no shuffle.
    """
    read = with_word_list(segments.select("id", "offset", "duration", "word_timing"), "word_timing", "_w", "_why")
    spans = F.expr("transform(coalesce(_w, cast(array() as array<variant>)), x -> named_struct('o', try_variant_get(x, '$.Offset', 'bigint'), 'd', try_variant_get(x, '$.Duration', 'bigint')))")
    rows = read.select("id", "offset", "duration", spans.alias("w")).withColumn("n", F.size("w"))
    starts = F.expr("concat(transform(w, x -> x.o), array(offset + duration))")
    ends = F.expr("concat(array(offset), transform(w, x -> x.o + x.d))")
    gaps = F.when(F.col("n") > 0, F.zip_with(starts, ends, lambda a, b: (a - b).cast("double")))
    seconds = F.col("duration") * TICK_S
    measure = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"))
    every = F.concat(
        F.array(measure("segments", F.col("duration")), measure("wps", F.when(F.col("n") > 0, ratio(F.col("n"), seconds)))),
        F.transform("w", lambda x: measure("words", x.d)),
        F.transform(F.coalesce(gaps, F.array().cast("array<double>")), lambda g: measure("silences", F.when(g != 0, g))),
    )
    return rows.select("id", F.explode(every).alias("m")).select("id", "m.kind", "m.value").where("value is not null")


def timing_features(measures: DataFrame, total: DataFrame | None = None, phones: bool = False, total_key: str = "id", units: dict[str, float] = TICKS) -> DataFrame:
    """One wide row an id: describe-5 of each kind (s, ms, ms), totals and rates; with ``total`` (id, duration_s) also shares of the call. ``units`` turns measures into seconds and milliseconds."""
    kind, v = F.col("kind"), F.col("value")
    kinds = ["segments", "silences", "words", "wps"] + (["phones", "pps"] if phones else [])
    aggs = [c for k in kinds for c in describe5(v, k, when=kind == k, unit=units.get(k))]
    count = lambda k: F.count(F.when(kind == k, 1))
    total_of = lambda k, unit: F.coalesce(F.sum(F.when(kind == k, v)), F.lit(0.0)) * (units.get(k, 1.0) * unit)
    spoken, silent = total_of("segments", 1.0), total_of("silences", 1e-3)
    aggs += [silent.alias("sil_duration"), spoken.alias("spk_duration"), ratio(spoken, silent).alias("spk_sil_ratio"), ratio(count("silences"), spoken).alias("sps"), ratio(count("words"), spoken).alias("wps")]
    aggs += [count("silences").alias("sil_count"), count("segments").alias("segment_count"), count("words").alias("word_count")]
    aggs += [F.count(F.when((kind == "segments") & (v * units.get("segments", 1.0) <= 1), 1)).alias("short_utt_count")]
    if phones:
        aggs += [ratio(count("phones"), spoken).alias("pps"), count("phones").alias("phone_count")]
    wide = measures.groupBy("id").agg(*aggs)
    if total is None:
        return wide
    full = wide.join(total.select(F.col(total_key).alias("id"), F.col("duration_s").alias("total_duration")), "id", "left").withColumn("total_duration", F.coalesce("total_duration", F.lit(0.0)))
    minutes = F.col("total_duration") / 60
    return full.withColumns(
        {
            "spk_ratio": ratio(F.col("spk_duration"), F.col("total_duration")),
            "sil_ratio": ratio(F.col("sil_duration"), F.col("total_duration")),
            "segs_per_min": ratio(F.col("segment_count"), minutes),
            "short_utts_per_min": ratio(F.col("short_utt_count"), minutes),
        }
    )


#: The columns of call activity.
CALL_ACTIVITY = ("segment_count", "segments_max", "segments_min", "segments_mean", "segments_med", "segments_std", "spk_duration", "spk_ratio", "total_duration", "word_count", "words_max", "words_min", "words_mean", "words_med", "words_std")


def call_activity(timing: DataFrame) -> DataFrame:
    return timing.select("id", *CALL_ACTIVITY)


def alignment_measures(lines: DataFrame) -> DataFrame:
    """(id, seg, kind, value) of word-phone alignments (id, seg, i, line): frames of 25 ms.

    A line with five fields opens a word, a silence or a noise; others go on with it. A word lasts until the next line of
    five fields, or to the segment's last frame. Phones are all lines but those that open a silence or a noise. A segment
    without words gives no segment, wps and pps rows, but its silences and phones stay.
    """
    f = F.split("line", " ")
    rows = lines.select("id", "seg", "i", F.try_element_at(f, F.lit(1)).try_cast("bigint").alias("s"), F.try_element_at(f, F.lit(2)).try_cast("bigint").alias("e"), F.try_element_at(f, F.lit(5)).alias("w"), (F.size(f) == 5).alias("opens")).where("s is not null and e is not null")
    sound = F.coalesce(F.col("opens") & F.col("w").isin("sil", "[noise]", "[laughter]"), F.lit(False))
    # one shuffle: a segment's lines from the last to the first, each with what follows it, and the segment's totals
    whole = Window.partitionBy("id", "seg")
    back = whole.orderBy(F.desc("i"))
    placed = rows.withColumn("sound", sound).withColumn("next", F.last(F.when(F.col("opens"), F.col("s")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))).withColumn("turn", F.row_number().over(back))
    placed = placed.withColumn("last", F.first("e").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nw", F.sum((F.col("opens") & ~F.col("sound")).cast("int")).over(whole)).withColumn("np", F.sum((~F.col("sound")).cast("int")).over(whole))
    sec = F.col("last") * FRAME_MS / 1000
    measure = lambda kind, v, when: F.when(when, F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value")))
    own = (F.col("e") - F.col("s")) * FRAME_MS
    per_segment = (F.col("turn") == 1) & (F.col("nw") > 0)
    each = F.array(
        measure("words", (F.coalesce("next", "last") - F.col("s")) * FRAME_MS, F.col("opens") & ~F.col("sound")),
        measure("silences", own, F.col("opens") & (F.col("w") == "sil")),
        measure("phones", own, ~F.col("sound")),
        measure("segments", sec, per_segment),
        measure("wps", ratio(F.col("nw"), sec), per_segment),
        measure("pps", ratio(F.col("np"), sec), per_segment),
    )
    return placed.select("id", "seg", F.explode(each).alias("m")).where("m is not null").select("id", "seg", "m.kind", "m.value")


def alignment_timing(lines: DataFrame, meta: DataFrame | None, level: str, totals: DataFrame | None = None) -> DataFrame:
    """Timing of word-phone alignments (call_id, seg, i, line) at a level of grouping: its keys, then the features; with ``totals`` (call_id, duration_s) also shares of the calls."""
    measures = alignment_measures(lines.withColumnRenamed("call_id", "id")).withColumnsRenamed({"id": "call_id", "seg": "segment_id"})
    # seconds are whole milliseconds, which add up exactly
    whole = F.when(F.col("kind") == "segments", F.round(F.col("value") * 1000)).otherwise(F.col("value"))
    placed = sg.at_level(measures, meta, level).withColumn("value", whole)
    made = timing_features(
        placed.select(F.struct(*sg.LEVEL_KEYS[level]).alias("id"), "kind", "value"),
        None if totals is None else sg.level_totals(sg.at_level(lines.select("call_id", F.col("seg").alias("segment_id")).distinct(), meta, level), level, totals),
        phones=True,
        units={"segments": 1e-3},
    )
    return made.select("id.*", *(c for c in made.columns if c != "id"))


def hypothesis_mean(features: DataFrame, names: list[str]) -> DataFrame:
    """(id, hyp_no, features) -> mean over hypotheses; null if any hypothesis lacks the feature."""
    return features.groupBy("id").agg(*(F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in names))
