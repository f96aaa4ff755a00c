"""Language models of public libraries as providers: NLTK's tagger, lemmatiser and sentence splitter, truecase, textstat.

Each is an Arrow UDF that hands a whole batch of sentences to its library; every different sentence or word of a batch is
asked once. A library and its data have to be installed on all workers; ``available`` says which are.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.providers import Providers

#: The modules each model needs.
MODULES = {"tag": "nltk", "lemma": "nltk", "truecase": "truecase", "syllables": "textstat", "sentences": "nltk"}
#: First letters of Penn tags and the WordNet classes they stand for; all others are nouns.
WORDNET = {"J": "a", "V": "v", "N": "n", "R": "r"}


def available() -> dict[str, bool]:
    """Which models this machine has the library for."""
    return {k: importlib.util.find_spec(m) is not None for k, m in MODULES.items()}


def _once(values: list, ask) -> list:
    """``ask`` of all different values at once, and its answers in the place of each; null stays null."""
    different = list(dict.fromkeys(v for v in values if v is not None))
    answers = dict(zip(different, ask(different), strict=True))
    return [None if v is None else answers[v] for v in values]


def _sentences(batch: pd.Series) -> list:
    return [None if x is None else tuple(x) for x in batch]


def nltk_tags(tokens: Column) -> Column:
    """array<string> -> array<string>: Penn tags of the words of a sentence."""

    def tag(batch: pd.Series) -> pd.Series:
        import nltk

        return pd.Series(_once(_sentences(batch), lambda xs: [[t for _, t in s] for s in nltk.pos_tag_sents([list(x) for x in xs])]), dtype=object)

    return F.pandas_udf(tag, "array<string>")(tokens)


def nltk_lemmas(tokens: Column) -> Column:
    """array<string> -> array<string>: lemmas of the words of a sentence, in small letters, by their tags there."""

    def lemmas(batch: pd.Series) -> pd.Series:
        import nltk
        from nltk.stem import WordNetLemmatizer

        of = WordNetLemmatizer()
        ask = lambda xs: [[of.lemmatize(w.lower(), WORDNET.get(t[:1], "n")) for w, t in s] for s in nltk.pos_tag_sents([list(x) for x in xs])]
        return pd.Series(_once(_sentences(batch), ask), dtype=object)

    return F.pandas_udf(lemmas, "array<string>")(tokens)


def true_case(sentence: Column) -> Column:
    def case(batch: pd.Series) -> pd.Series:
        import truecase

        return pd.Series(_once(batch.tolist(), lambda xs: [truecase.get_true_case(x) if x else x for x in xs]), dtype=object)

    return F.pandas_udf(case, "string")(sentence)


def textstat_syllables(word: Column | str) -> Column:
    def count(batch: pd.Series) -> pd.Series:
        import textstat

        return pd.Series(_once(batch.tolist(), lambda xs: [int(textstat.syllable_count(x)) for x in xs]), dtype="Int64")

    return F.pandas_udf(count, "bigint")(F.col(word) if isinstance(word, str) else word)


def nltk_sentences(text: Column) -> Column:
    """string -> array<string>: sentences of a segment by the trained Punkt model; an empty text is one empty sentence."""

    def split(batch: pd.Series) -> pd.Series:
        import nltk

        return pd.Series(_once(batch.tolist(), lambda xs: [nltk.sent_tokenize(x) or [""] for x in xs]), dtype=object)

    return F.pandas_udf(split, "array<string>")(text)


def library_providers() -> Providers:
    """Models of the libraries that are there; the rules of ``Providers`` for the others."""
    have = available()
    chosen = {"tag_all": ("tag", nltk_tags), "lemma_all": ("lemma", nltk_lemmas), "truecase": ("truecase", true_case), "syllables": ("syllables", textstat_syllables), "sentences": ("sentences", nltk_sentences)}
    return Providers(**{name: f for name, (model, f) in chosen.items() if have[model]})
