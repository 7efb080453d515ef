"""Paths of files as listings have them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain_path(path: Column) -> Column:
    """A file's path as listings have it; Spark's metadata percent-encodes it."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")
