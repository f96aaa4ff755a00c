"""Tokens, n-grams, cleaning and sentences of a text column, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stays when punctuation goes: letters, digits, underscore, apostrophe and white space.
_PUNCTUATION = r"(?U)[^\p{L}\p{N}_'\s\x1c-\x1f]+"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def words(c: Column | str) -> Column:
    """Split at every single space; empty tokens stay, and an empty text is one empty token."""
    return F.split(c, " ")


def words_any_space(c: Column | str) -> Column:
    """Lower case, split at any white space, without empty tokens."""
    return F.filter(F.split(F.lower(c), _SPACE), lambda w: w != "")


def clean(c: Column | str) -> Column:
    """Without punctuation except apostrophes; what stood around it stays as it was."""
    return F.regexp_replace(c, _PUNCTUATION, "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by spaces; empty if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def sentences(c: Column | str) -> Column:
    """Split where white space follows a full stop, exclamation or question mark."""
    return F.split(c, r"(?<=[.!?])\s+")


def is_lower(c: Column) -> Column:
    """At least one cased character and none in upper case."""
    return (c == F.lower(c)) & (c != F.upper(c))


def syllables(w: Column | str) -> Column:
    """Groups of vowels, at least one for a word with a letter: a stand-in for a syllable dictionary."""
    groups = F.size(F.regexp_extract_all(F.lower(w), F.lit("([aeiouy]+)"), F.lit(1)))
    return F.when(F.length(w) == 0, 0).otherwise(F.greatest(groups, F.lit(1)))


def text_or_nan(c: str, null_text: str = "nan") -> Column:
    """A missing transcript is the word ``nan``, or stays null with ``null_text='skip'``."""
    return F.coalesce(F.col(c), F.lit("nan")) if null_text == "nan" else F.col(c)


#: Ties of one bucket of a running sum: rows of one order value are summed in buckets of so many tie numbers.
TIE_BUCKET = 65_536
#: Orders of one shard of a running sum.
ORDER_SHARD = 4096


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, last: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key before this one, in order of ord, tie and ``last``.

    A key may hold most of the rows, so there are three levels: rows are summed in buckets of (ord, tie), buckets in shards
    of neighbouring orders; each bucket sums its own rows, and the sums of the shard's earlier buckets and of the key's
    earlier shards are added.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col("tie") / F.lit(TIE_BUCKET)))
    at = [*keys, "ord", "_bucket"]
    kind = df.schema["ord"].dataType
    shard = F.floor(F.col("ord") / ORDER_SHARD) if isinstance(kind, T.NumericType) else F.col(f"ord.{kind.names[0]}") if isinstance(kind, T.StructType) else F.col("ord")
    totals = bucketed.groupBy(*at).agg(F.sum(value).alias("_sum")).withColumn("_shard", shard)
    earlier = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy(*keys, "_shard").agg(F.sum("_sum").alias("_sum"))
    first = shards.select(*keys, F.col("_shard").alias("_of"), F.coalesce(F.sum("_sum").over(earlier(keys, "_shard")), F.lit(0)).alias("_first"))
    inner = totals.withColumn("_inner", F.coalesce(F.sum("_sum").over(earlier([*keys, "_shard"], "ord", "_bucket")), F.lit(0))).withColumn("_of", F.col("_shard"))
    same = [inner[k].eqNullSafe(first[k]) for k in (*keys, "_of")]
    starts = inner.join(first, same).select(*(inner[c].alias(f"_at_{c}") for c in at), (F.col("_first") + F.col("_inner")).alias("_start"))
    within = Window.partitionBy(*at).orderBy("tie", *([last] if last else [])).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    placed = local.join(starts, [local[c].eqNullSafe(starts[f"_at_{c}"]) for c in at])
    return placed.withColumn(out, F.col("_start") + F.col("_local")).drop("_bucket", "_local", "_start", *(f"_at_{c}" for c in at))


def joined_sentences(segments: DataFrame, text: str = "text", null_text: str = "nan", split: Callable[[Column], Column] = sentences) -> DataFrame:
    """(id, sent_no, text): the sentences of each id's segments, joined in order with a space. ``split`` takes a segment apart.

    A sentence may run over several segments. Segments are split where they stand; the pieces of a sentence find each
    other by the number of sentence ends before them, so no group is collected, only a sentence is.
    """
    cut = segments.select("id", "ord", "tie", split(text_or_nan(text, null_text)).alias("_cut"))
    pieces = cut.select("id", "ord", "tie", (F.size("_cut") - 1).alias("_last"), F.posexplode("_cut").alias("i", "piece")).where("i = 0 or piece <> ''")
    marked = pieces.withColumn("closes", ((F.col("i") < F.col("_last")) | F.col("piece").rlike(r"[.!?]$")).cast("int")).drop("_last")
    placed = running_sum(marked, ["id"], "closes", "sent_no", "i")
    joined = placed.groupBy("id", "sent_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tie", "i", "piece"))), lambda x: x.piece), " ").alias("text"))
    return joined.withColumn("text", F.when(F.col("sent_no") > 0, F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text")))
