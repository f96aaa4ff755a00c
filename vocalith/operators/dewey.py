"""Problem 3: deeply nested records as related flat tables.

Every node of a record gets a Dewey label: the ordinals on the way from the root. One chain of generators walks all
levels: at each level a row stands for the node itself (ordinal -1, where the label ends) and for each of its children,
so one pass over the input yields the nodes of every level. A parent's label is the child's without its last ordinal;
nodes of one schema path form one flat table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.functions.literals import with_list


@dataclass(frozen=True)
class Level:
    """One level of nesting. member: the name of the child array in its parent; an object there is an array of one.

    through: the parent stands for this level itself (one child, ordinal 0) if it lacks ``member`` but has this one.
    literal: a text there is a list literal.
    """

    name: str
    member: str
    through: str | None = None
    literal: bool = False


#: The levels of a recognizer's payload, from the record down.
PAYLOAD_LEVELS = (
    Level("channel", "channels", through="segments"),
    Level("segment", "segments"),
    Level("alternative", "nbest", through="word_timing"),
    Level("word", "word_timing", literal=True),
    Level("phone", "Phones"),
)


def _children(value: str, level: Level) -> str:
    member = f"try_variant_get({value}, '$.{level.member}', 'variant')"
    listed = f"try_variant_get({value}, '$.{level.member}', 'array<variant>')"
    one = f"case when try_cast({member} as map<string,variant>) is not null then array({member}) end"
    options = [listed, one]
    if level.literal:
        options.insert(1, "_literal")
    if level.through:
        options.append(f"case when ({member} is null or is_variant_null({member})) and try_variant_get({value}, '$.{level.through}', 'variant') is not null then array({value}) end")
    return f"coalesce({', '.join(options)}, cast(array() as array<variant>))"


def dewey_nodes(df: DataFrame, root: str, levels: tuple[Level, ...], carry: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Turns each row of ``df`` into its nodes: ``label`` array<int>, ``path`` (level name) and ``value`` variant, beside the row's other columns.

    Null elements are counted in ordinals but are no nodes; elements that are no objects are none either. A null or
    unreadable root has no nodes. A node carries its own value and nothing of its ancestors but what ``carry`` names: per
    level a column and the expression over ``_at`` that fills it there and below.
    """
    carry = carry or {}
    df = df.withColumn("_at", F.col(root)).withColumn("value", F.col(root)).drop(root).withColumn("label", F.expr("cast(array() as array<int>)")).withColumn("path", F.lit("record"))
    for name, expression in carry.values():
        df = df.withColumn(name, F.expr(f"case when false then {expression} end"))
    for level in levels:
        if level.literal:
            df = with_list(df.withColumn("_text", F.expr(f"case when schema_of_variant(try_variant_get(_at, '$.{level.member}', 'variant')) = 'STRING' then try_variant_get(_at, '$.{level.member}', 'string') end")), "_text", "_literal").drop("_text")
        df = df.withColumn("_kids", F.expr(f"case when _at is null then cast(array() as array<variant>) else {_children('_at', level)} end"))
        keep = [F.col(f"`{c}`") for c in df.columns if c not in ("_kids", "_literal")]
        df = df.select(*keep, F.posexplode(F.expr("concat(array(cast(null as variant)), _kids)")).alias("_pos", "_kid"))
        # position 0 is the node itself: the walk goes no deeper on that row
        df = (
            df.where("_pos = 0 or schema_of_variant(_kid) like 'OBJECT%'")
            .withColumn("label", F.when(F.col("_pos") > 0, F.concat("label", F.array(F.col("_pos") - 1))).otherwise(F.col("label")))
            .withColumn("path", F.when(F.col("_pos") > 0, F.lit(level.name)).otherwise(F.col("path")))
            .withColumn("value", F.coalesce("_kid", "value"))
            .withColumn("_at", F.col("_kid"))
        )
        if level.name in carry:
            name, expression = carry[level.name]
            df = df.withColumn(name, F.when(F.col("_pos") > 0, F.expr(expression)).otherwise(F.col(name)))
        df = df.drop("_pos", "_kid")
    return df.drop("_at")


def parent_label(label: str = "label"):
    """The parent's label, by truncation; empty for a child of the record, null for the record itself."""
    return F.expr(f"case when size({label}) > 0 then slice({label}, 1, size({label}) - 1) end")


def payload_nodes(payloads: DataFrame) -> DataFrame:
    """Nodes of result_payloads; ``result`` around the record is taken off. Unreadable or null payloads have none."""
    read = payloads.select(F.col("payload_id").alias("parent_id"), F.expr("try_parse_json(payload)").alias("_doc"))
    root = read.withColumn("root", F.expr("case when try_cast(try_variant_get(_doc, '$.result', 'variant') as map<string,variant>) is not null then try_variant_get(_doc, '$.result', 'variant') else _doc end")).drop("_doc")
    number = {"segment": ("segment_number", "try_variant_get(_at, '$.segment_number', 'bigint')")}
    return dewey_nodes(root.withColumn("audio_file_id", F.expr("try_variant_get(root, '$.audio_file_id', 'string')")), "root", PAYLOAD_LEVELS, number)
