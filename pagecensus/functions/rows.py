"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def rows_of(table: DataFrame, keep: Sequence[str], array: str, item: str, pos: str = "pos") -> DataFrame:
    """One row per element of ``array``, with its position from 0.

    The plain ``posexplode`` makes Spark filter on the array's size first. That filter moves down to
    the scan and evaluates the array's expression there a second time, which doubles the work when
    the array comes from a document. The outer form does not, and its empty rows are dropped here.
    """
    exploded = table.selectExpr(*keep, f"posexplode_outer({array}) AS ({pos}, {item})")
    return exploded.where(f"{pos} IS NOT NULL")
