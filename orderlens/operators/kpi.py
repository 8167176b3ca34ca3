"""Headline KPIs, each as a one-row frame, with their grain named.

Line-grain KPIs take lines, order-grain KPIs take the order frame. KPIs that
divide return 0 on an empty input; sums and means return NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.measures import (
    count_where, is_loss, money_sum, or_zero, percent, ratio,
)


def total_orders(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_distinct("order_id").alias("total_orders"))


def total_revenue(lines: DataFrame) -> DataFrame:
    return lines.agg(money_sum("sales").alias("total_revenue"))


def total_profit(lines: DataFrame) -> DataFrame:
    return lines.agg(money_sum("profit").alias("total_profit"))


def average_order_value(lines: DataFrame) -> DataFrame:
    value = ratio(F.sum("sales"), F.count_distinct("order_id"))
    return lines.agg(or_zero(value).alias("average_order_value"))


def profit_margin_pct(lines: DataFrame) -> DataFrame:
    return lines.agg(or_zero(percent(F.sum("profit"), F.sum("sales"))).alias("profit_margin_pct"))


def _loss_rate(frame: DataFrame, profit: str, name: str) -> DataFrame:
    rate = percent(count_where(is_loss(F.col(profit))), F.count(F.lit(1)))
    return frame.agg(or_zero(rate).alias(name))


def loss_making_line_rate(lines: DataFrame) -> DataFrame:
    """Share of lines with negative profit."""
    return _loss_rate(lines, "profit", "loss_making_line_rate")


def loss_making_order_rate(orders: DataFrame) -> DataFrame:
    """Share of orders whose lines together lose money."""
    return _loss_rate(orders, "sum_profit", "loss_making_order_rate")


def mean_over_lines(days: str = "delivery_days", weight: str = "n_lines") -> Column:
    """Mean of an order attribute as if taken over the order's lines."""
    known = F.when(F.col(days).isNotNull(), F.col(weight))
    return ratio(F.sum(F.col(days) * F.col(weight)), F.sum(known))


def average_delivery_days(orders: DataFrame) -> DataFrame:
    """Mean days from order to shipment over lines, not over orders."""
    return orders.agg(mean_over_lines().alias("average_delivery_days"))


def kpi_summary(orders: DataFrame) -> DataFrame:
    """All headline figures from one pass over the order frame.

    The order frame makes the distinct count a row count and serves the
    order-grain loss rate without reading the lines a second time.
    """
    n = F.count(F.lit(1))
    n_lines = F.sum("n_lines")
    return orders.agg(
        n.alias("total_orders"),
        F.coalesce(n_lines, F.lit(0)).alias("total_order_lines"),
        money_sum("sum_sales").alias("total_revenue"),
        money_sum("sum_profit").alias("total_profit"),
        ratio(F.sum("sum_sales"), n).alias("avg_order_value"),
        mean_over_lines().alias("avg_delivery_days"),
        percent(F.sum("n_loss_lines"), n_lines).alias("loss_making_line_pct"),
        percent(count_where(F.col("sum_profit") < 0), n).alias("loss_making_order_pct"),
        percent(F.sum("sum_profit"), F.sum("sum_sales")).alias("overall_profit_margin_pct"),
    )


def headline_metrics(orders: DataFrame) -> DataFrame:
    """The five figures on top of the dashboard."""
    n = F.count(F.lit(1))
    return orders.agg(
        n.alias("total_orders"),
        money_sum("sum_sales").alias("total_revenue"),
        or_zero(ratio(F.sum("sum_sales"), n)).alias("average_order_value"),
        or_zero(percent(count_where(F.col("sum_profit") < 0), n)).alias("loss_making_order_rate"),
        mean_over_lines().alias("average_delivery_days"),
    )
