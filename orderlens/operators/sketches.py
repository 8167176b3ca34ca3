"""Sketches per day that can be merged: distinct counts and quantiles beside the exact answers.

A day's states are small and are made once. Any span of days is answered by merging its states,
without reading a line again. The merged state stands for all rows of the span; what it
estimates depends a little on the order of merging, within the error. The exact answers stay where they are (``kpi``, ``quality``, ``delivery``).

* Distinct counts: HyperLogLog states with 2^LG_K registers, relative standard error about
  1.04 / sqrt(2^LG_K), so 1.6 % at 12.
* Quantiles of amounts, whose values are not bounded and fit no histogram: KLL states, rank error
  about 1.33 % at K = 200 with 99 % confidence, whatever the values.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
K = 200


def daily_distinct(rows: DataFrame, day: str, columns: list[str], lg_k: int = LG_K) -> DataFrame:
    """One state per day and column: (day, column_name, state, n_rows)."""
    wide = rows.groupBy(F.col(day).alias("day")).agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns],
        F.count(F.lit(1)).alias("n_rows"))
    return wide.unpivot(["day", "n_rows"], columns, "column_name", "state")


def distinct_of(states: DataFrame, *by: str | Column) -> DataFrame:
    """(by, column_name, estimate): the states merged, over all days or per ``by``."""
    return states.groupBy(*by, "column_name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("state")).alias("estimate"))


def daily_quantiles(rows: DataFrame, day: str, amount: str, by: list[str] = [], k: int = K) -> DataFrame:
    """One state per day and ``by``: (day, by, state, n_rows) of the amounts that are there."""
    value = F.col(amount).cast("double")
    return rows.filter(value.isNotNull()).groupBy(F.col(day).alias("day"), *by).agg(
        F.kll_sketch_agg_double(value, F.lit(k)).alias("state"), F.count(F.lit(1)).alias("n_rows"))


def quantiles_of(states: DataFrame, shares: list[float], *by: str | Column) -> DataFrame:
    """(by, share, value): quantiles of the merged states."""
    merged = states.groupBy(*by).agg(F.kll_merge_agg_double("state").alias("state"))
    names = [c for c in merged.columns if c != "state"]
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("state", F.lit(s)).alias("value"))
                      for s in shares])
    return merged.select(*names, F.explode(pairs).alias("one")).select(*names, "one.*")


def between(states: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """The states of a span of days, both ends included."""
    if first is not None:
        states = states.filter(F.col("day") >= F.lit(first))
    return states if last is None else states.filter(F.col("day") <= F.lit(last))


def write_states(states: DataFrame, path: str) -> None:
    """Store the states of some days: a folder per year, days in order. A day that was stored before
    is a state of its own, which merges like any other."""
    states.withColumn("year", F.year("day")).hint("rebalance", F.col("year")).sortWithinPartitions(
        "day").write.mode("append").partitionBy("year").parquet(path)
