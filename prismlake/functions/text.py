"""Text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trim_unicode(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
