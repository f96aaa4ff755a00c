"""Writers of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The file each feature set is written to.
FILES = {"graph": "graph_features", "lexical_diversity": "lexical_diversity_features", "liwc": "liwc_features", "pos": "pos_features", "verbosity": "verbosity_features", "confidence": "asr_conf_features", "timing": "timing_features", "non_verbal": "non_verbal_features"}


def write_features(df: DataFrame, output_dir: str, name: str, fmt: str = "csv", one_file: bool = False, per_id: bool = False) -> str:
    """id first; CSV with header or Parquet, in ``output_dir/<file of name>``. ``per_id`` writes a folder an id."""
    path = f"{output_dir.rstrip('/')}/{FILES.get(name, name)}"
    out = df.select("id", *(F.col(f"`{c}`") for c in df.columns if c != "id"))
    writer = (out.coalesce(1) if one_file else out).write.mode("overwrite")
    if per_id:
        writer = writer.partitionBy("id")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
    return path
