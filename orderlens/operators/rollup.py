"""Rollups by any attribute and the order-grain frame behind the order KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import count_where, is_loss, money_sum, percent, ratio
from orderlens.schema import ORDER_ATTRIBUTES


def _sums(lines: DataFrame) -> list[Column]:
    """Line count and the sums of the measures that are present."""
    build = {
        "sales": [F.sum("sales").alias("sum_sales")],
        "profit": [F.sum("profit").alias("sum_profit"),
                   count_where(is_loss(F.col("profit"))).alias("n_loss_lines")],
        "discount": [F.sum("discount").alias("sum_discount")],
    }
    sums = [F.count(F.lit(1)).alias("n_lines")]
    for measure, columns in build.items():
        sums += columns if measure in lines.columns else []
    return sums


def order_rollup(lines: DataFrame) -> DataFrame:
    """One row per order: its attributes, line count and summed measures.

    Groups by the order attributes that are present. Apply filters before, since a
    category filter removes lines inside an order.
    """
    keys = ["order_id"] + [c for c in ORDER_ATTRIBUTES if c in lines.columns]
    return lines.groupBy(*keys).agg(*_sums(lines))


def order_parts(lines: DataFrame, *keys: str) -> DataFrame:
    """One row per order and ``keys``, such as the sub-categories an order spans.
    Counting its rows per key counts distinct orders."""
    return lines.groupBy("order_id", *keys).agg(*_sums(lines))


def _revenue(frame: DataFrame, keys: tuple[str, ...], orders: Column,
             sales: str, profit: str) -> DataFrame:
    totals = frame.groupBy(*keys).agg(
        orders.alias("total_orders"),
        money_sum(sales).alias("total_revenue"),
        money_sum(profit).alias("total_profit"),
    )
    # The margin divides the totals as shown, that is after rounding.
    margin = percent(F.col("total_profit"), F.col("total_revenue"))
    return totals.withColumn("profit_margin_pct", margin).orderBy(
        F.desc_nulls_last("total_revenue"), *keys)


def revenue_by(lines: DataFrame, *keys: str) -> DataFrame:
    """Orders, revenue, profit and margin by line attributes such as category."""
    return _revenue(lines, keys, F.count_distinct("order_id"), "sales", "profit")


def revenue_by_order_attribute(orders: DataFrame, *keys: str) -> DataFrame:
    """The same from the order frame, for attributes constant per order, or from
    order parts: counting rows replaces the distinct count."""
    return _revenue(orders, keys, F.count(F.lit(1)), "sum_sales", "sum_profit")


def orders_by_location(orders: DataFrame) -> DataFrame:
    """Orders and revenue by state with the state's rank inside its region."""
    stats = orders.groupBy("region", "state").agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum("sum_sales").alias("revenue"))
    by_revenue = Window.partitionBy("region").orderBy(F.desc_nulls_last("revenue"))
    return stats.select(
        "region", "state", "total_orders",
        F.round("revenue", 2).alias("total_revenue"),
        F.rank().over(by_revenue).alias("rank_within_region"),
    ).orderBy("region", F.desc_nulls_last("total_revenue"), "state")


def aov_by_segment_region(orders: DataFrame) -> DataFrame:
    """Average order value by segment and region, averaged over orders."""
    stats = orders.groupBy("segment", "region").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count("sum_sales").alias("valued"), F.sum("sum_sales").alias("revenue"))
    return stats.select(
        "segment", "region", "total_orders",
        ratio(F.col("revenue"), F.col("valued")).alias("avg_order_value"),
        F.round("revenue", 2).alias("total_revenue"),
    ).orderBy(F.desc_nulls_last("avg_order_value"), "segment", "region")
