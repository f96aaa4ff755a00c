"""Adapters of libraries, with stand-ins of the same interface in their place."""

import importlib
import os
import sys

import pytest
from pyspark.sql import functions as F

from vocalith.functions import libraries
from vocalith.functions.providers import Providers
from vocalith.plans import pipeline

NLTK = """
def sent_tokenize(text):
    return [x.strip() for x in text.split('|') if x.strip()]

def pos_tag_sents(sentences):
    return [[(w, 'VBD' if w.endswith('ed') else 'PRP' if w in ('I', 'i') else 'NN') for w in s] for s in sentences]
"""
STEM = """
class WordNetLemmatizer:
    def lemmatize(self, word, pos='n'):
        return word[:-2] if pos == 'v' else word.rstrip('s')
"""


@pytest.fixture
def installed(spark, tmp_path, monkeypatch):
    for path, text in {"nltk/__init__.py": NLTK, "nltk/stem.py": STEM, "truecase.py": "def get_true_case(s): return s[:1].upper() + s[1:].replace(' i ', ' I ')", "textstat.py": "def syllable_count(w): return len(w)"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    monkeypatch.syspath_prepend(str(tmp_path))
    importlib.invalidate_caches()
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join((str(tmp_path), known))
    yield
    spark.sparkContext.environment["PYTHONPATH"] = known
    for m in ("nltk", "nltk.stem", "truecase", "textstat"):
        sys.modules.pop(m, None)


def test_adapters(spark, installed):
    assert all(libraries.available().values())
    df = spark.createDataFrame([(1, ["I", "walked", "dogs"], "then i walked"), (2, [], ""), (3, None, None), (4, ["I", "walked", "dogs"], "then i walked")], "n int, ws array<string>, s string")
    rows = {r.n: r for r in df.select("n", libraries.nltk_tags(F.col("ws")).alias("t"), libraries.nltk_lemmas(F.col("ws")).alias("l"), libraries.true_case(F.col("s")).alias("c"), libraries.textstat_syllables("s").alias("y")).collect()}
    assert rows[1].t == ["PRP", "VBD", "NN"] and rows[1].l == ["i", "walk", "dog"] and rows[1].c == "Then I walked" and rows[1].y == 13
    assert rows[4][1:] == rows[1][1:] and rows[2].t == [] and rows[2].c == "" and tuple(rows[3])[1:] == (None,) * 4


def test_features_with_libraries(spark, installed):
    segments = spark.createDataFrame([("x", 0, 0, "i walked dogs", "i walked dogs")], "id string, ord bigint, tie bigint, text string, text_basic string")
    made = pipeline.extract(segments, ("pos", "graph", "verbosity"), providers=libraries.library_providers())
    pos = made["pos"].first()
    assert pos.VERB == pytest.approx(1 / 3) and pos.NOUN == pytest.approx(2 / 3)
    graph = made["graph"].first()
    assert graph.num_nodes_lemma == 3 and graph.num_nodes_pos == 2  # i, walk, dog; all nouns but one
    assert made["verbosity"].first().syll_max == 6.0


def test_sentences_of_a_library(spark, installed):
    """Sentences run over segments where the library leaves the last one open."""
    rows = [("x", 0, 0, "one two | three", None), ("x", 1, 1, "four. | five", None), ("x", 2, 2, "", None), ("x", 3, 3, None, None)]
    segments = spark.createDataFrame(rows, "id string, ord bigint, tie bigint, text string, text_basic string")
    found = pipeline.prepared_sentences(segments, providers=libraries.library_providers()).orderBy("sent_no").collect()
    assert [r.text.split() for r in found] == [["one", "two"], ["three", "four"], ["five", "nan"]]


def test_without_libraries():
    if not any(libraries.available().values()):
        assert libraries.library_providers() == Providers()
