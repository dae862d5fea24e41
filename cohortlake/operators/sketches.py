"""Approximate quantiles as stored sketches that merge: a report at any level reads the sketches, not the facts.

KLL sketches of size ``k``: the rank of what they return is off by about 2.3 / k ** 0.9 of the rows with 99 percent
confidence (:func:`rank_error`), whatever they were merged from.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 400


def rank_error(k: int = SIZE) -> float:
    """Bound of the rank error, as a share of the rows, with 99 percent confidence."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, keys: list[str], x: str, k: int = SIZE) -> DataFrame:
    """(keys, n, sketch) of the doubles in ``x``; nulls are left out, a group of nulls has no sketch."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(x).cast("double"), k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], k: int = SIZE) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: Mapping[str, float]) -> DataFrame:
    """(keys, n, a column for each of ``wanted``)."""
    return sketches.select(*keys, "n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in wanted.items()))
