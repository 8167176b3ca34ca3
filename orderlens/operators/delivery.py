"""Delivery days per ship mode against the mode's own 75th percentile.

Everything here starts from a histogram of orders and lines per ship mode and
day count. Its size is bounded by the day domain, not by the data, so exact
percentiles, averages and the share above the benchmark all come from one pass
over the orders, and no benchmark has to be joined back to order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import percent, ratio


def delivery_histogram(orders: DataFrame) -> DataFrame:
    """Orders and lines per ship mode and day count, from order rows or cube cells."""
    n = F.sum("n_orders") if "n_orders" in orders.columns else F.count(F.lit(1))
    lines = [F.sum("n_lines").alias("n_lines")] if "n_lines" in orders.columns else []
    return orders.groupBy("ship_mode", "delivery_days").agg(n.alias("n_orders"), *lines)


def _benchmarked(histogram: DataFrame, weight: str) -> DataFrame:
    """Each histogram row with the 75th percentile of its ship mode."""
    known = F.when(F.col("delivery_days").isNotNull(), F.col(weight)).otherwise(0)
    p75 = F.percentile("delivery_days", 0.75, known)
    return histogram.withColumn("p75", p75.over(Window.partitionBy("ship_mode")))


def _orders() -> Column:
    return F.sum("n_orders")


def _mean_days() -> Column:
    known = F.when(F.col("delivery_days").isNotNull(), F.col("n_orders"))
    return ratio(F.sum(F.col("delivery_days") * F.col("n_orders")), F.sum(known))


def _over() -> Column:
    return F.sum(F.when(F.col("delivery_days") > F.col("p75"), F.col("n_orders")).otherwise(0))


def delivery_performance(orders: DataFrame) -> DataFrame:
    """Benchmark taken over lines: an order counts once per line it has."""
    marked = _benchmarked(delivery_histogram(orders), "n_lines")
    return marked.groupBy("ship_mode").agg(
        _orders().alias("total_orders"),
        _mean_days().alias("avg_delivery_days"),
        F.round(F.max("p75"), 2).alias("internal_benchmark_days"),
        _over().alias("orders_over_benchmark"),
        percent(_over(), _orders()).alias("pct_over_benchmark"),
    ).orderBy(F.desc_nulls_last("avg_delivery_days"), "ship_mode")


def delivery_benchmark(orders: DataFrame) -> DataFrame:
    """Benchmark taken over orders: every order counts once."""
    marked = _benchmarked(delivery_histogram(orders), "n_orders")
    return marked.groupBy("ship_mode").agg(
        _orders().alias("total_orders"),
        _mean_days().alias("avg_delivery_days"),
        F.max("p75").alias("benchmark_days"),
        percent(_over(), _orders()).alias("pct_over_benchmark"),
    ).orderBy("ship_mode")


def slowest_ship_mode(orders: DataFrame) -> DataFrame:
    return delivery_benchmark(orders).orderBy(
        F.desc_nulls_last("avg_delivery_days"), "ship_mode").limit(1)


def worst_benchmark_mode(orders: DataFrame) -> DataFrame:
    return delivery_benchmark(orders).orderBy(
        F.desc_nulls_last("pct_over_benchmark"), "ship_mode").limit(1)


def delivery_boxplot(orders: DataFrame) -> DataFrame:
    """Five-number summary per ship mode over orders, with the 1.5 IQR fences:
    the whiskers end at the last value inside the fence.
    """
    histogram = delivery_histogram(orders).filter(F.col("delivery_days").isNotNull())
    quartiles = F.percentile("delivery_days", [0.25, 0.5, 0.75], F.col("n_orders"))
    spread = (
        histogram.withColumn("q", quartiles.over(Window.partitionBy("ship_mode")))
        .withColumn("reach", 1.5 * (F.col("q")[2] - F.col("q")[0]))
    )
    days = F.col("delivery_days")
    inside = (days >= F.col("q")[0] - F.col("reach")) & (days <= F.col("q")[2] + F.col("reach"))
    return spread.groupBy("ship_mode").agg(
        _orders().alias("n_orders"),
        F.min(days).alias("min_days"),
        F.max(F.col("q")[0]).alias("q1_days"),
        F.max(F.col("q")[1]).alias("median_days"),
        F.max(F.col("q")[2]).alias("q3_days"),
        F.max(days).alias("max_days"),
        F.min(F.when(inside, days)).alias("lower_whisker"),
        F.max(F.when(inside, days)).alias("upper_whisker"),
        F.sum(F.when(~inside, F.col("n_orders")).otherwise(0)).alias("n_outliers"),
    ).orderBy("ship_mode")
