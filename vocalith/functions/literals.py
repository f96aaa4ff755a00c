"""List-of-record literals (JSON or Python notation) as variants, without leaving the JVM.

``with_word_list`` adds the elements of the list and what is wrong with the text. The text is parsed as JSON with either
kind of quotes; only texts that fail are rewritten (None/True/False outside strings) and parsed once more. The text is
wrapped as ``[text, sentinel]`` so that trailing or surplus brackets cannot pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SENTINEL = 716039151
_OPTIONS = "map('allowSingleQuotes','true','allowBackslashEscapingAnyCharacter','true')"
#: The keys each record of a word timing must have, and their kinds.
WORD_KEYS = {"Word": "text", "Offset": "ticks", "Duration": "ticks"}

_MASKS = (("\\\\\\\\", "\x02"), ("\\\\'", "\x03"), ('\\\\"', "\x04"))
_UNMASK = (("\x02", "\\\\"), ("\x03", "\\'"), ("\x04", '\\"'))
_CONSTANTS = (("None", "null"), ("True", "true"), ("False", "false"))


def json_notation(c: Column) -> Column:
    """Python constants outside strings in JSON's spelling; strings stay as they are.

    Escapes are masked first so that a string is simply all up to its next quote; no pattern needs a stack that grows
    with the text.
    """
    for pair, mask in _MASKS:
        c = F.regexp_replace(c, pair, mask)
    for word, new in _CONSTANTS:
        c = F.regexp_replace(c, rf"('[^']*+'|\"[^\"]*+\")|\b{word}\b", "$1\x01")
        c = F.replace(F.regexp_replace(c, r"(['\"])\x01", "$1"), F.lit("\x01"), F.lit(new))
    for mask, pair in _UNMASK:
        c = F.replace(c, F.lit(mask), F.lit(pair))
    return c


def _parse(text: str) -> str:
    return f"from_json(concat('[', {text}, ',{_SENTINEL}]'), 'variant', {_OPTIONS})"


def _ticks_ok(key: str) -> str:
    kind = f"schema_of_variant(try_variant_get(r, '$.{key}', 'variant'))"
    return (
        f"(({kind} = 'BIGINT' and coalesce(try_variant_get(r, '$.{key}', 'bigint') >= 0, false))"
        f" or ({kind} rlike '^DECIMAL.(19|[23][0-9]),0.$' and coalesce(try_variant_get(r, '$.{key}', 'decimal(38,0)') >= 0, false)))"
    )


def _record_code() -> str:
    """0 good, 1 bad value, 2 a key is missing, 3 no record."""
    missing = " or ".join(f"try_variant_get(r, '$.{k}', 'variant') is null" for k in WORD_KEYS)
    good = " and ".join(_ticks_ok(k) if kind == "ticks" else f"schema_of_variant(try_variant_get(r, '$.{k}', 'variant')) = 'STRING'" for k, kind in WORD_KEYS.items())
    return f"case when {missing} then case when coalesce(schema_of_variant(r), '') like 'OBJECT%' then 2 else 3 end when {good} then 0 else 1 end"


def with_list(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out`` array<variant>: the elements of the one list literal in ``text``; null if it is none."""
    return (
        df.withColumn("_v1", F.expr(_parse(f"`{text}`")))
        .withColumn("_v2", F.when(F.col("_v1").isNull() & F.col(text).isNotNull(), json_notation(F.col(text))))
        .withColumn("_v3", F.coalesce(F.col("_v1"), F.expr(f"case when _v2 is not null then {_parse('_v2')} end")))
        .withColumn(
            out,
            F.expr(
                f"case when try_variant_get(_v3, '$[1]', 'bigint') = {_SENTINEL} and try_variant_get(_v3, '$[2]', 'variant') is null"
                " then try_variant_get(_v3, '$[0]', 'array<variant>') end"
            ),
        )
        .drop("_v1", "_v2", "_v3")
    )


def with_word_list(df: DataFrame, text: str, out: str = "words", reason: str = "word_reason") -> DataFrame:
    """Adds ``out`` (array<variant>, null unless the literal is good) and ``reason``.

    reason: null for a good literal or a null text; ``quoting`` for no list literal of records, ``column_count`` if a
    record lacks a key of WORD_KEYS, ``value`` if one has a value of the wrong kind. An empty list is good; an empty text
    is not a literal.
    """
    return (
        with_list(df, text, "_items")
        .withColumn("_worst", F.expr(f"coalesce(array_max(transform(_items, r -> {_record_code()})), 0)"))
        .withColumn(
            reason,
            F.expr(f"case when `{text}` is null then null when _items is null or _worst = 3 then 'quoting' when _worst = 2 then 'column_count' when _worst = 1 then 'value' end"),
        )
        .withColumn(out, F.expr(f"case when {reason} is null then _items end"))
        .drop("_items", "_worst")
    )
