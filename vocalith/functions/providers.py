"""Language models the features need: taggers, lemmatisers, truecasers and dictionaries.

Each default is a small stand-in made of rules, inside the JVM; a provider is a function of a Column, so a pandas UDF over a
real library takes its place: see ``libraries``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions.text import sentences, syllables

#: Closed word classes of English, by Penn tag.
CLOSED = {
    "PRP": "i you he she it we they me him us them myself",
    "PRP$": "my your his its our their",
    "DT": "the a an this that these those some any no every",
    "CC": "and or but nor yet",
    "IN": "of in on at by for with from about after before between during near until while because than if since through without along",
    "TO": "to",
    "MD": "can could will would should may might must can't won't",
    "WP": "who what whom",
    "WDT": "which",
    "WRB": "when where why how",
    "UH": "uh um yeah okay well oh hmm yes",
    "VBZ": "is has does",
    "VBP": "are have do am",
    "VBD": "was were had did",
}
#: Endings and their Penn tags, the first that fits.
ENDINGS = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("est", "JJS"), ("s", "NNS"))


def rule_tag(w: Column) -> Column:
    """Penn tag of one word, by closed classes and endings; a capital makes a name, a digit a number."""
    low = F.lower(w)
    tag = F.when(w.rlike("^[0-9]"), "CD")
    for name, members in CLOSED.items():
        tag = tag.when(low.isin(*members.split()), name)
    tag = tag.when(w.rlike("^[A-Z]"), "NNP")
    for end, name in ENDINGS:
        tag = tag.when(low.endswith(end) & (F.length(w) > len(end) + 2), name)
    return tag.otherwise("NN")


def rule_lemma(w: Column) -> Column:
    """Lower case, without a plural or past ending of longer words."""
    low = F.lower(w)
    return F.when(low.rlike(".{3,}ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike(".{3,}[^s]s$"), F.regexp_replace(low, "s$", "")).when(low.rlike(".{3,}ed$"), F.regexp_replace(low, "ed$", "")).otherwise(low)


def sentence_case(s: Column) -> Column:
    """Capital at the start, and for the word i."""
    return F.regexp_replace(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000_000)), r"\bi\b", "I")


@dataclass(frozen=True)
class Providers:
    tag: Callable[[Column], Column] = field(default=rule_tag)
    lemma: Callable[[Column], Column] = field(default=rule_lemma)
    truecase: Callable[[Column], Column] = field(default=sentence_case)
    syllables: Callable[[Column], Column] = field(default=syllables)
    sentences: Callable[[Column], Column] = field(default=sentences)
    #: Models that see a whole sentence (array of words in, array out) take the place of those for single words.
    tag_all: Callable[[Column], Column] | None = None
    lemma_all: Callable[[Column], Column] | None = None

    def tags(self, tokens: Column) -> Column:
        return self.tag_all(tokens) if self.tag_all else F.transform(tokens, self.tag)

    def lemmas(self, tokens: Column) -> Column:
        return self.lemma_all(tokens) if self.lemma_all else F.transform(tokens, self.lemma)


#: A small dictionary of our own with single words, prefixes (*), a pair and a triple of words: (pattern, category).
LEXICON = (
    ("i", "pronoun"), ("we", "pronoun"), ("she", "pronoun"), ("he", "pronoun"), ("they", "pronoun"), ("you", "pronoun"),
    ("work*", "work"), ("meeting", "work"), ("schedule", "work"), ("call*", "work"),
    ("sleep*", "body"), ("tired", "body"), ("medicine", "body"), ("nurse", "body"), ("clinic", "body"),
    ("you know", "filler"), ("i mean", "filler"), ("um", "filler"), ("uh", "filler"), ("like", "filler"), ("two weeks ago", "time"),
    ("night", "time"), ("morning", "time"), ("week*", "time"), ("before", "time"), ("after", "time"), ("lost", "affect"), ("calm*", "affect"), ("laugh*", "affect"), ("rough", "affect"),
)


def lexicon(spark: SparkSession, rows=LEXICON) -> DataFrame:
    """(pattern, is_prefix, category); a pattern that ends with * stands for all words that begin so."""
    made = [(p[:-1] if p.endswith("*") else p, p.endswith("*"), c) for p, c in rows]
    return spark.createDataFrame(made, "pattern string, is_prefix boolean, category string")


def categories(rows=LEXICON) -> list[str]:
    return sorted({c for _, c in rows})
