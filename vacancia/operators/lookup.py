"""Joins to a side that has one row per key, safe against hot and missing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key; inner or left.

    Rows without a key match nothing, so they are set apart and not shuffled. A key that holds many
    rows lies in one shuffle partition of ``left``, which adaptive execution splits; each part meets
    the same few rows of ``right``. For a left join ``left`` is read twice and should be cheap to read.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"left or inner, not {how}")
    joined = left.filter(F.col(key).isNotNull()).join(right, key, how)
    if how == "inner":
        return joined
    return joined.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
