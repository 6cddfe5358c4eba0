"""Counts that add up: sketches of each load, kept beside it and merged for any span of loads without reading the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two: 4,096 give a standard error of 1.6 %.
LG = 12
#: Values that a top list keeps track of.
TRACKED = 10_000


def error_bound(lg: int = LG, deviations: float = 4.0) -> float:
    """The relative error that an estimate stays under, but for a chance of some in 100,000 at four deviations."""
    return deviations * 1.04 / 2 ** (lg / 2)


def of_loads(rows: DataFrame, load: str, by: list[str], value: str, lg: int = LG) -> DataFrame:
    """(load, by, rows, distinct as a sketch): a row for each load and group. Null values count as rows only."""
    return rows.groupBy(load, *by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(value, lg).alias("sketch"))


def merged(loads: DataFrame, by: list[str], most: Column | None = None) -> DataFrame:
    """(by, rows, distinct): over all loads given, or those that `most` picks. A value that several loads hold counts once."""
    picked = loads if most is None else loads.where(most)
    return picked.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def tops_of_loads(rows: DataFrame, load: str, value: str, tracked: int = TRACKED) -> DataFrame:
    """(load, top): the state of a top list for each load. Exact as long as a load has no more than `tracked` values."""
    return rows.groupBy(load).agg(F.expr(f"approx_top_k_accumulate({value}, {int(tracked)})").alias("top"))


def top(loads: DataFrame, k: int, tracked: int = TRACKED) -> DataFrame:
    """(item, count) of the k most frequent values over all loads given."""
    both = loads.agg(F.expr(f"approx_top_k_combine(top, {int(tracked)})").alias("top"))
    return both.select(F.explode(F.expr(f"approx_top_k_estimate(top, {int(k)})")).alias("e")).select("e.item", "e.count")
