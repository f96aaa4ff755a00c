"""The registry of feature sets, and runs of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.functions import text as tx
from vocalith.functions.providers import LEXICON, Providers, categories, lexicon
from vocalith.operators import features, graphs


def prepared_sentences(segments: DataFrame, text: str = "text", providers: Providers = Providers()) -> DataFrame:
    """Sentences of the joined text, without punctuation, in lower case."""
    return tx.joined_sentences(segments, text, split=providers.sentences).withColumn("text", F.lower(tx.clean("text")))


def tagged_tokens(sentences: DataFrame, providers: Providers) -> DataFrame:
    """(id, sent_no, i, w, tag); all-lower sentences are truecased first, empty tokens are left out."""
    s = F.col("text")
    cased = sentences.withColumn("text", F.when(tx.is_lower(s), providers.truecase(s)).otherwise(s))
    if providers.tag_all is None:
        tokens = cased.select("id", "sent_no", F.posexplode(tx.words("text")).alias("i", "w")).where("w <> ''")
        return tokens.withColumn("tag", providers.tag(F.col("w")))
    words = cased.select("id", "sent_no", F.filter(tx.words("text"), lambda w: w != "").alias("ws"))
    tagged = words.withColumn("tags", providers.tags(F.col("ws")))
    return tagged.select("id", "sent_no", F.posexplode(F.arrays_zip("ws", "tags")).alias("i", "x")).select("id", "sent_no", "i", F.col("x.ws").alias("w"), F.col("x.tags").alias("tag"))


def pos(segments: DataFrame, providers: Providers = Providers()) -> DataFrame:
    sentences = prepared_sentences(segments, providers=providers)
    return features.pos_features(tagged_tokens(sentences, providers), sentences.groupBy("id").agg(F.sum(F.size(tx.words("text"))).alias("n")))


def liwc(segments: DataFrame, rows=LEXICON, providers: Providers = Providers()) -> DataFrame:
    return features.liwc(prepared_sentences(segments, providers=providers), lexicon(segments.sparkSession, rows), categories(rows))


def verbosity(segments: DataFrame, providers: Providers = Providers()) -> DataFrame:
    return features.verbosity(prepared_sentences(segments, providers=providers), providers.syllables)


def graph(segments: DataFrame, providers: Providers = Providers(), norm_by: str = "chars", pos_graph_on: str = "lemma") -> DataFrame:
    """Naive, lemma and tag graphs. The tag graph is of the lemmas, or of the words with ``pos_graph_on='words'``."""
    s = tx.clean(tx.text_or_nan("text"))
    cased = segments.withColumn("_s", F.when(tx.is_lower(s), providers.truecase(s)).otherwise(s))
    split = F.filter(tx.words("_s"), lambda w: w != "")
    lemmas = cased.select("id", providers.lemmas(split).alias("ws"))
    tagged = (lemmas if pos_graph_on == "lemma" else cased.select("id", split.alias("ws"))).select("id", providers.tags(F.col("ws")).alias("ws"))
    return graphs.graph_features(segments, {"naive": graphs.naive_tokens(segments), "lemma": lemmas, "pos": tagged}, norm_by)


#: Feature sets by name: segments in, one row an id out.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "graph": graph,
    "lexical_diversity": features.lexical_diversity,
    "liwc": liwc,
    "pos": pos,
    "verbosity": verbosity,
    "confidence": lambda segments: features.confidence(segments, ["id"]),
    "non_verbal": features.non_verbal,
    "timing": lambda segments: features.timing_features(features.timing_measures(segments)),
}
#: The sets that are extracted if none is named.
DEFAULT = ("graph", "lexical_diversity", "liwc", "pos", "verbosity")


def extract(segments: DataFrame, names: tuple[str, ...] = DEFAULT, dictionary=LEXICON, providers: Providers = Providers()) -> dict[str, DataFrame]:
    """Feature tables by name; an unknown name is an error when the plan is built. ``dictionary`` has the categories, ``providers`` the language models."""
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown feature sets: {', '.join(unknown)}; there are {', '.join(REGISTRY)}")
    settings = {"liwc": {"rows": dictionary, "providers": providers}, "pos": {"providers": providers}, "graph": {"providers": providers}, "verbosity": {"providers": providers}}
    return {n: REGISTRY[n](segments, **settings.get(n, {})) for n in names}
