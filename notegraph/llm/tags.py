"""Tags as the pair and frequency operators compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_form(tag: Column) -> Column:
    """Blanks trimmed, a leading # dropped, lower case."""
    trimmed = F.regexp_replace(tag, r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(trimmed, r"^#", ""), r"(?U)^\s+|\s+$", ""))
