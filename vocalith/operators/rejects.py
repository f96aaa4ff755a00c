"""Problem 4: rows that fail to parse, apart from the valid rows and with the reason.

Structural checks (quoting, number of fields) are made row by row. Values are not: each table first becomes *cells*
(table, row, kind, value); each distinct value of a kind is cast once, the few that cannot be cast form a dictionary of
invalid values with reasons, and that is joined back to the cells by a 128-bit digest of the value. A value that a third
of all rows share is one row after the map-side half of the distinct; on the way back the dictionary is repeated per salt
so that its rows spread over tasks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.functions.literals import with_word_list

#: Reasons in the order in which the first that applies is given.
REASONS = ("quoting", "column_count", "value")
#: The fields of a raw result record.
RAW_FIELDS = ("audio_file_id", "segment_number", "text", "text_basic", "confidence", "offset", "duration", "word_timing")
RAW_KINDS = {"segment_number": "digits", "confidence": "unit", "offset": "digits", "duration": "digits", "word_timing": "words_or_empty"}

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

_csv_type = T.StructType([T.StructField("closed", T.BooleanType()), T.StructField("fields", T.ArrayType(T.StringType()))])


def split_record(line: str | None) -> tuple[bool | None, list[str] | None]:
    """One CSV record's fields; closed is False if a quoted field isn't closed right before a comma or the end."""
    if line is None:
        return None, None
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            scan = at + 1
            while (end := line.find('"', scan)) >= 0 and line.startswith('"', end + 1):
                scan = end + 2
            if end < 0 or (end + 1 < n and line[end + 1] != ","):
                return False, None
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= n:
            return True, fields
        at += 1


@F.pandas_udf(_csv_type)
def _split_records(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_record(x) for x in lines], columns=["closed", "fields"])


_split_once = _split_records.asNondeterministic()  # else a filter on its result would run it twice


def raw_records(df: DataFrame, row_id: str = "raw_id", line: str = "line") -> DataFrame:
    """row_id, structural ``reason`` (null if sound) and the record's ``fields``. A null line has one empty field."""
    return (
        df.select(F.col(row_id).alias("row_id"), _split_once(F.coalesce(line, F.lit(""))).alias("r"))
        .select("row_id", F.col("r.closed").alias("closed"), F.col("r.fields").alias("fields"))
        .withColumn("reason", F.when(~F.col("closed"), "quoting").when(F.size("fields") != len(RAW_FIELDS), "column_count"))
        .drop("closed")
    )


def _cells(df: DataFrame, table: str, **kinds: Column) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k.split("__")[0]).alias("kind"), v.alias("value")) for k, v in kinds.items()))
    return df.select(F.lit(table).alias("table_name"), "row_id", F.explode(pairs).alias("c")).select("table_name", "row_id", "c.kind", "c.value").where(F.col("value").isNotNull())


def _only(df: DataFrame, reason: Column, *keep: str) -> DataFrame:
    """Rows with a reason. Made as a generator, through which no filter is pushed: a pushed one would repeat the cast, and before the values are made distinct."""
    found = F.filter(F.array(F.struct(reason.alias("reason"))), lambda x: x.reason.isNotNull())
    return df.select(*keep, F.explode(found).alias("x")).select(*keep, "x.reason")


def invalid_plain(values: DataFrame) -> DataFrame:
    """(kind, value), each once -> those that can't be cast: (kind, value, reason)."""
    segment = F.split("value", "_")
    first, last = F.expr("try_cast(element_at(split(value, '_'), -2) as decimal(38,0))"), F.expr("try_cast(element_at(split(value, '_'), -1) as decimal(38,0))")
    ok = (
        F.when(F.col("kind") == "digits", F.col("value").rlike(r"^[0-9]+$"))
        .when(F.col("kind") == "unit", F.col("value").rlike(_NUMBER) & F.coalesce(F.col("value").try_cast("double").between(0, 1), F.lit(False)))
        .when(F.col("kind") == "segment", (F.size(segment) == 4) & F.col("value").rlike(r"_[0-9]+_[0-9]+$") & F.coalesce(first < last, F.lit(False)))
    )
    return _only(values, F.when(~ok, "value"), "kind", "value")


def invalid_words(values: DataFrame) -> DataFrame:
    """The same for word timings; kind ``words_or_empty`` may be blank, and what is wrong with it is a wrong value of its record."""
    blank = (F.col("kind") == "words_or_empty") & (F.trim("value") == "")
    read = with_word_list(values, "value")
    return _only(read, F.when(blank, None).when(F.col("kind") == "words", F.col("word_reason")).when(F.col("word_reason").isNotNull(), F.lit("value")), "kind", "value")


def reject_cells(plain: DataFrame, words: DataFrame, salts: int = 8) -> DataFrame:
    """Cells (table_name, row_id, kind, value) -> (table_name, row_id, reason) of those whose value is in the dictionary."""
    wrong = invalid_plain(plain.select("kind", "value").distinct()).unionByName(invalid_words(words.select("kind", "value").distinct()))
    keyed = wrong.select("kind", F.md5("value").alias("digest"), "reason", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cells = plain.unionByName(words).select("table_name", "row_id", "kind", F.md5("value").alias("digest"), F.pmod(F.hash("table_name", "row_id"), F.lit(salts)).alias("salt"))
    return cells.join(keyed, ["kind", "digest", "salt"]).select("table_name", "row_id", "reason")


def rejects(recognition: DataFrame, conf_sym: DataFrame, raw: DataFrame, salts: int = 8) -> DataFrame:
    """(table_name, row_id, reason): every row that can't be loaded, once, with the first reason of REASONS.

    Null word_timing and null conf_scores state nothing to parse: the first is no reject, the second has not six fields.
    Extra columns are ignored; empty tables give no rows.
    """
    timings = _cells(recognition.select(F.col("result_id").alias("row_id"), "word_timing"), "recognition_results", words=F.col("word_timing"))
    parts = F.split(F.coalesce("conf_scores", F.lit("")), " ")
    lines = conf_sym.select(F.col("line_id").alias("row_id"), parts.alias("p"))
    line_count = lines.where(F.size("p") != 6).select(F.lit("conf_sym").alias("table_name"), "row_id", F.lit("column_count").alias("reason"))
    line_cells = _cells(lines.where(F.size("p") == 6), "conf_sym", segment=F.col("p")[0], unit=F.col("p")[5])
    records = raw_records(raw)
    structural = records.where("reason is not null").select(F.lit("raw_results").alias("table_name"), "row_id", "reason")
    sound = records.where("reason is null")
    fields = {f"{kind}__{name}": F.col("fields")[RAW_FIELDS.index(name)] for name, kind in RAW_KINDS.items()}
    words = {k: v for k, v in fields.items() if k.startswith("words")}
    plain = line_cells.unionByName(_cells(sound, "raw_results", **{k: v for k, v in fields.items() if k not in words}))
    values = reject_cells(plain, timings.unionByName(_cells(sound, "raw_results", **words)), salts)
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    found = reduce(DataFrame.unionByName, (line_count, structural, values))
    return found.groupBy("table_name", "row_id").agg(F.min_by("reason", rank).alias("reason"))


#: A word of a loaded word timing. Ticks are as long as the checks let them be (38 digits); ``record`` is the whole record as JSON, where it has more keys.
_WORD = """named_struct('word', try_variant_get(r, '$.Word', 'string'), 'offset', try_variant_get(r, '$.Offset', 'decimal(38,0)'), 'duration', try_variant_get(r, '$.Duration', 'decimal(38,0)'),
    'record', case when size(map_keys(try_variant_get(r, '$', 'map<string,variant>'))) > 3 then to_json(r) end)"""


def _with_words(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` as an array of typed words in place of the literal; rows whose literal is bad are left out, null texts stay null."""
    kept = [c for c in df.columns if c != text]
    read = with_word_list(df, text, "_words", "_reason")
    good = F.filter(F.array(F.struct(F.col("_reason").alias("reason"), F.expr(f"transform(_words, r -> {_WORD})").alias("words"))), lambda x: x.reason.isNull())
    return read.select(*kept, F.explode(good).alias("_x")).select(*(F.col("_x.words").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))


def load_words(recognition: DataFrame) -> DataFrame:
    """The recognition rows that ``rejects`` doesn't list, word_timing as typed words."""
    return _with_words(recognition, "word_timing")


def load_lines(conf_sym: DataFrame, rejected: DataFrame) -> DataFrame:
    """The valid lines of conf_sym, conf_scores as its fields: segment_id with its start and end, confidence, and in ``middle`` the four texts between, which nothing is said of."""
    good = conf_sym.join(rejected.where("table_name = 'conf_sym'").select(F.col("row_id").alias("line_id")), "line_id", "left_anti")
    f = F.split("conf_scores", " ")
    at = lambda i: F.try_element_at(F.split(f[0], "_"), F.lit(i)).try_cast("decimal(38,0)")
    kept = [F.col(f"`{c}`") for c in conf_sym.columns if c != "conf_scores"]
    return good.select(*kept, f[0].alias("segment_id"), at(3).alias("segment_start"), at(4).alias("segment_end"), F.slice(f, 2, 4).alias("middle"), f[5].try_cast("double").alias("confidence"))


def load_raw(raw: DataFrame, rejected: DataFrame) -> DataFrame:
    """The valid raw records with typed columns; ``rejected`` is what ``rejects`` gave.

    A number of more than 38 digits fits no integer type: its column is null and its digits stand in ``long_digits`` under
    its name. A blank word timing is null.
    """
    good = raw_records(raw).where("reason is null").join(rejected.where("table_name = 'raw_results'").select("row_id"), "row_id", "left_anti")
    kinds = {"segment_number": "decimal(38,0)", "confidence": "double", "offset": "decimal(38,0)", "duration": "decimal(38,0)"}
    typed = good.select(F.col("row_id").alias("raw_id"), *(F.col("fields")[i].try_cast(kinds.get(name, "string")).alias(name) for i, name in enumerate(RAW_FIELDS)), "fields")
    long = F.filter(F.array(*(F.struct(F.lit(name).alias("key"), F.when(F.col(name).isNull(), F.col("fields")[RAW_FIELDS.index(name)]).alias("value")) for name, kind in RAW_KINDS.items() if kind == "digits")), lambda x: x.value.isNotNull())
    blank = F.when(F.trim("word_timing") != "", F.col("word_timing"))
    return _with_words(typed.withColumn("word_timing", blank).withColumn("long_digits", F.map_from_entries(long)).drop("fields"), "word_timing")
