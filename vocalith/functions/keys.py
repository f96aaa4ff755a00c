"""Keys that are written untidily."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of keys: ASCII controls, blanks and the Unicode spaces.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_key(c: Column | str) -> Column:
    """Trimmed (tabs too), upper case; null for null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.regexp_replace(c, _EDGE, "")), F.lit(""))
