"""Corpus preparation, phrases, topics and their coherence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions import text as tx
from vocalith.operators.features import NON_VERBAL
from vocalith.session import cut_lineage, drop_shuffles


def remove_stop_words(tokens: Column, stop: list[str]) -> Column:
    """Exact and case-sensitive; repeated words stay repeated."""
    return F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens


def remove_non_verbal(rows: DataFrame, tokens: str = "ws") -> DataFrame:
    """Without sounds; segments that are empty then are dropped."""
    return rows.withColumn(tokens, F.filter(tokens, lambda w: ~w.isin(*NON_VERBAL.values()))).where(F.size(tokens) > 0)


def enough_words(rows: DataFrame, least: int = 50, tokens: str = "ws", key: str = "id") -> DataFrame:
    """All rows of a key of which at least one hypothesis (hyp_no, if there) has ``least`` words."""
    by = [key, "hyp_no"] if "hyp_no" in rows.columns else [key]
    long = rows.groupBy(*by).agg(F.sum(F.size(tokens)).alias("n")).where(F.col("n") >= least).select(key).distinct()
    return rows.join(long, key, "left_semi")


def bag_of_words(rows: DataFrame, tokens: str = "ws", key: str = "id") -> DataFrame:
    return rows.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


def trim_vocabulary(bag: DataFrame, least_docs: int = 5, most_share: float = 0.6, keep: int = 100_000, key: str = "id") -> DataFrame:
    """Words in at least ``least_docs`` documents and at most ``most_share`` of them; the ``keep`` most frequent of these."""
    n = bag.agg(F.countDistinct(key)).scalar()
    df = bag.groupBy("word").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= least_docs) & (F.col("df") <= most_share * n)).orderBy(F.desc("df"), "word").limit(keep)
    return bag.join(kept.select("word"), "word", "left_semi")


def phrases(rows: DataFrame, threshold: float = 10.0, min_count: int = 5, tokens: str = "ws") -> DataFrame:
    """(a, b, n_ab, score): pairs with (n_ab - min_count) V / (n_a n_b) above the threshold, V distinct words and pairs."""
    single = rows.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    near = F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.struct(F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + 1).alias("b"))))
    pair = rows.select(F.explode(near).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    size = single.agg(F.count("*")).scalar() + pair.agg(F.count("*")).scalar()
    frequent = pair.where(F.col("n_ab") > min_count)
    counted = frequent.join(single.toDF("a", "n_a"), "a").join(single.toDF("b", "n_b"), "b")
    score = (F.col("n_ab") - min_count) * size / (F.col("n_a") * F.col("n_b"))
    return counted.withColumn("score", score).where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def apply_phrases(rows: DataFrame, found: DataFrame, tokens: str = "ws") -> DataFrame:
    """Greedy, from left to right: two words that are a phrase become one, joined by an underscore.

    The phrases are joined by their pairs of words, so there may be any number of them. Rows find their phrases by a digest
    of their own words, which is the same wherever it is computed: equal rows share one search. Null and empty token lists
    stay as they are.
    """
    digest = F.md5(F.to_json(F.struct(F.col(tokens).alias("t"))))
    keyed = rows.withColumn("_text", digest)
    lists = keyed.where(F.size(tokens) > 1).groupBy("_text").agg(F.first(tokens).alias("ws"))
    near = lists.select("_text", F.posexplode(F.arrays_zip(F.slice("ws", 1, F.size("ws") - 1).alias("a"), F.slice("ws", 2, F.size("ws") - 1).alias("b"))).alias("i", "p")).select("_text", "i", "p.a", "p.b")
    hits = near.join(found.select("a", "b").distinct(), ["a", "b"], "left_semi")
    # of a run of neighbouring hits every other one is taken, from its first
    run = Window.partitionBy("_text").orderBy("i")
    placed = hits.withColumn("run", F.col("i") - F.row_number().over(run))
    taken = placed.withColumn("first", F.min("i").over(Window.partitionBy("_text", "run"))).where("(i - first) % 2 = 0")
    at = taken.groupBy("_text").agg(F.array_sort(F.collect_list("i")).alias("_at"))
    # a slice before each phrase, the phrase, and the rest after the last: the words are copied once
    merged = F.expr(
        f"""concat(flatten(transform(sequence(0, size(_at) - 1), k -> concat(
              slice({tokens}, case when k = 0 then 1 else _at[k - 1] + 3 end, _at[k] - case when k = 0 then 0 else _at[k - 1] + 2 end),
              array(concat_ws('_', {tokens}[_at[k]], {tokens}[_at[k] + 1]))))),
            slice({tokens}, element_at(_at, -1) + 3, size({tokens})))"""
    )
    joined = keyed.join(at, "_text", "left")
    return joined.withColumn(tokens, F.when(F.col("_at").isNotNull(), merged).otherwise(F.col(tokens))).drop("_text", "_at").select(*rows.columns)


def triples(rows: DataFrame, threshold: float = 10.0, min_count: int = 5, tokens: str = "ws") -> DataFrame:
    """Rows with phrases of two words joined, then those of two such units: the second round makes up to four words one."""
    pairs = apply_phrases(rows, phrases(rows, threshold, min_count, tokens), tokens)
    return apply_phrases(pairs, phrases(pairs, threshold, min_count, tokens), tokens)


def corpus(rows: DataFrame, stop: list[str], least: int = 50, lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, ws): sounds off, short calls out, stop words off, words of a call together as a bag; with ``lemma`` each word as its lemma."""
    kept = enough_words(remove_non_verbal(rows), least)
    plain = kept.withColumn("ws", remove_stop_words(F.col("ws"), stop))
    return plain if lemma is None else plain.withColumn("ws", F.transform("ws", lemma))


@dataclass(frozen=True)
class Vectors:
    """Documents as vectors of counts, and the words that their places stand for."""

    features: DataFrame
    vocabulary: list[str]


def vectors(bag: DataFrame, key: str = "id") -> Vectors:
    """Trimmed bags of words as vectors, made once; all words count, and are numbered by Spark."""
    from pyspark.ml.feature import CountVectorizer

    docs = bag.groupBy(key).agg(F.flatten(F.collect_list(F.array_repeat("word", F.col("tf").cast("int")))).alias("ws"))
    counted = CountVectorizer(inputCol="ws", outputCol="features", vocabSize=2**31 - 1).fit(docs)
    return Vectors(cut_lineage(counted.transform(docs).select("features")), counted.vocabulary)


def train_topics(bag: DataFrame | Vectors, k: int, iterations: int = 10, seed: int = 1, key: str = "id"):
    """(LDA model, vocabulary) of trimmed bags of words, or of their ``vectors`` if several models are trained."""
    from pyspark.ml.clustering import LDA

    made = bag if isinstance(bag, Vectors) else vectors(bag, key)
    return LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(made.features), made.vocabulary


def topic_words(model, vocabulary: list[str], top: int = 10) -> DataFrame:
    """(topic, rank, word, weight)."""
    rows = model.describeTopics(top).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")).select("topic", "rank", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    names = rows.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, word string")
    return rows.join(names, "i").select("topic", "rank", "word", "weight")


def coherence(topics: DataFrame, bag: DataFrame, key: str = "id") -> DataFrame:
    """(topic, npmi): mean normalised pointwise mutual information of a topic's words over documents. Pairs that never meet count -1.

    The topics' words are a short list. A document is the set of those that it holds; the pairs that a topic asks for are
    made in its row and counted before anything is sent.
    """
    listed: dict[int, list[str]] = {}
    for r in topics.select("topic", "rank", "word").orderBy("topic", "rank").collect():  # a few words a topic
        listed.setdefault(r.topic, []).append(r.word)
    spark = topics.sparkSession
    if not listed:
        return spark.createDataFrame([], "topic int, npmi double")
    n = bag.agg(F.countDistinct(key)).scalar()
    words = sorted({w for ws in listed.values() for w in ws})
    number = {w: i for i, w in enumerate(words)}
    names = spark.createDataFrame(list(number.items()), "word string, w int")
    docs = bag.join(names, "word").groupBy(key).agg(F.collect_set("w").alias("ws"))
    lists = F.array(*(F.struct(F.lit(t).alias("topic"), F.array(*(F.lit(number[w]) for w in ws)).alias("asked")) for t, ws in listed.items()))
    held = docs.select("ws", F.explode(lists).alias("t")).select("t.topic", F.array_intersect("t.asked", "ws").alias("p"))
    both = F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> named_struct('w1', x, 'w2', y))))")
    met = held.select("topic", F.explode(both).alias("x")).groupBy("topic", F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2")).agg(F.count("*").alias("c12"))
    single = docs.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    asked = spark.createDataFrame([(t, number[x], number[y]) for t, ws in listed.items() for i, x in enumerate(ws) for y in ws[i + 1 :]], "topic int, w1 int, w2 int")
    full = asked.join(met, ["topic", "w1", "w2"], "left").join(single.toDF("w1", "c1"), "w1").join(single.toDF("w2", "c2"), "w2").withColumn("n", n)
    p12 = F.col("c12") / F.col("n")
    npmi = F.when(F.col("c12").isNull(), -1.0).when(F.col("c12") == F.col("n"), 1.0).otherwise(F.ln(p12 * F.col("n") * F.col("n") / (F.col("c1") * F.col("c2"))) / -F.ln(p12))
    return full.groupBy("topic").agg(F.avg(npmi).alias("npmi"))


#: Words of a sliding window of the c_v measure, and what is added to its shares.
CV_WINDOW, CV_EPSILON = 110, 1e-12


#: Windows of a text that one row starts.
CV_SHARD = 16_384


def texts_in_shards(rows: DataFrame, tokens: str = "ws", key: str = "id", size: int = CV_WINDOW) -> DataFrame:
    """(key, shard, tokens): the words of a key's rows (ord, tie, tokens), one after another, in shards that overlap by a window, so that no text is ever one row."""
    placed = tx.running_sum(rows.where(F.size(tokens) > 0).select(F.col(key).alias("k"), "ord", "tie", tokens, F.size(tokens).alias("n")), ["k"], "n", "start")
    words = placed.select("k", "start", F.posexplode(tokens).alias("i", "w")).select("k", (F.col("start") + F.col("i")).alias("j"), "w")
    shard = F.floor(F.col("j") / CV_SHARD)
    both = F.when((F.pmod("j", F.lit(CV_SHARD)) < size - 1) & (shard > 0), F.array(shard, shard - 1)).otherwise(F.array(shard))
    held = words.select("k", "j", "w", F.explode(both).alias("shard")).groupBy("k", "shard").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("x"))
    return held.select(F.col("k").alias(key), "shard", F.transform("x", lambda y: y.w).alias(tokens))


def window_counts(rows: DataFrame, words: list[str], tokens: str = "ws", size: int = CV_WINDOW) -> DataFrame:
    """(a, b, n): sliding windows that hold both words, a = b: that word; a and b null: all windows. A text shorter than a window is one.

    Each row is a text, or a shard of one (``texts_in_shards``). Where a word holds is a set of window starts, made per text from its places; texts are counted in batches and only
    counts of ``words``, a bounded list, leave them.
    """
    number = {w: i for i, w in enumerate(words)}
    schema = "a int, b int, n bigint"
    shard, limit = (F.col("shard"), CV_SHARD) if "shard" in rows.columns else (F.lit(0).cast("bigint"), 2**62)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, whole = np.zeros((len(words), len(words)), np.int64), 0
        for batch in batches:
            for shard, ws in zip(batch["shard"], batch[tokens]):
                if ws is None or not len(ws):
                    continue
                n = min(limit, max(1 if shard == 0 else 0, len(ws) - size + 1))
                if not n:
                    continue
                whole += n
                places: dict[int, list[int]] = {}
                for j, w in enumerate(ws):
                    if w in number:
                        places.setdefault(number[w], []).append(j)
                if not places:
                    continue
                own = sorted(places)
                edges = np.zeros((len(own), n + 1), np.int32)
                for k, i in enumerate(own):
                    at = np.array(places[i])
                    np.add.at(edges[k], np.clip(at - size + 1, 0, n), 1)
                    np.add.at(edges[k], np.clip(at + 1, 0, n), -1)
                held = (np.cumsum(edges[:, :n], axis=1) > 0).astype(np.float64)
                sums[np.ix_(own, own)] += (held @ held.T).astype(np.int64)
        a, b = np.nonzero(np.triu(sums))
        yield pd.DataFrame({"a": [*a, None], "b": [*b, None], "n": [*sums[a, b], whole]}).astype({"a": "Int32", "b": "Int32"})

    return rows.select(shard.alias("shard"), tokens).mapInPandas(count, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))


def coherence_cv(topics: DataFrame, rows: DataFrame, tokens: str = "ws", size: int = CV_WINDOW) -> DataFrame:
    """(topic, c_v): mean cosine of each word's vector of normalised mutual information with the sum of the topic's vectors.

    Texts are the rows, or shards of texts (``texts_in_shards``). Only the topics' words and their counts of pairs, bounded by topics x words squared, come to the driver.
    """
    listed = {}
    for r in topics.orderBy("topic", "rank").collect():  # a few words a topic
        listed.setdefault(r.topic, []).append(r.word)
    words = sorted({w for ws in listed.values() for w in ws})
    counts = np.zeros((len(words), len(words)))
    whole = 0
    for r in window_counts(rows, words, tokens, size).collect():
        if r.a is None:
            whole = r.n
        else:
            counts[r.a, r.b] = counts[r.b, r.a] = r.n
    out = []
    p = counts / max(whole, 1)
    for topic, ws in listed.items():
        i = [words.index(w) for w in ws]
        both, single = p[np.ix_(i, i)], np.diag(p)[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.log((both + CV_EPSILON) / np.outer(single, single)) / -np.log(both + CV_EPSILON)
        npmi = np.nan_to_num(npmi, nan=0.0, posinf=0.0, neginf=0.0)
        total = npmi.sum(axis=0)
        length = np.linalg.norm(npmi, axis=1) * np.linalg.norm(total)
        cosine = np.divide(npmi @ total, length, out=np.zeros(len(i)), where=length > 0)
        out.append((int(topic), float(cosine.mean())))
    return topics.sparkSession.createDataFrame(out, "topic int, c_v double")


def sweep(bag: DataFrame, ks: range = range(2, 40, 5), iterations: int = 5, texts: DataFrame | None = None) -> DataFrame:
    """(k, npmi): mean coherence for each number of topics; with ``texts`` (see ``coherence_cv``) c_v instead. Each is taken to its one row before the next, so plans don't add up on the driver."""
    bag = cut_lineage(bag)
    texts = None if texts is None else cut_lineage(texts)
    measure = "npmi" if texts is None else "c_v"
    made = vectors(bag)
    rows = []
    for k in ks:
        model, vocabulary = train_topics(made, k, iterations)
        found = topic_words(model, vocabulary)
        scored = coherence(found, bag) if texts is None else coherence_cv(found, texts)
        rows.append((k, scored.agg(F.avg(measure)).first()[0]))
        del model, found, scored
        drop_shuffles(bag)  # those of one number of topics, before the next
    return bag.sparkSession.createDataFrame(rows, f"k int, {measure} double")
