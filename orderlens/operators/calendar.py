"""Demand over time, from the order frame wherever the key is the order's date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import money_sum

ORDERS = ("total_orders", "total_revenue")


def _demand(orders: DataFrame, *keys) -> DataFrame:
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_orders"), money_sum("sum_sales").alias("total_revenue"))


def demand_by_month(orders: DataFrame) -> DataFrame:
    """Calendar month 1 to 12 over all years."""
    return _demand(orders, F.month("order_date").alias("order_month")).orderBy("order_month")


def demand_by_weekday(orders: DataFrame) -> DataFrame:
    """Day of the week, Sunday first."""
    number = (F.dayofweek("order_date") - 1).alias("day_number")
    name = F.date_format("order_date", "EEEE").alias("day_of_week")
    return _demand(orders, number, name).orderBy("day_number").select("day_of_week", *ORDERS)


def monthly_trend(orders: DataFrame) -> DataFrame:
    month = F.date_format("order_date", "yyyy-MM").alias("month")
    return _demand(orders, month).orderBy("month")


def month_seasonality(orders: DataFrame) -> DataFrame:
    return orders.groupBy(
        F.month("order_date").alias("month_num"),
        F.date_format("order_date", "MMM").alias("month_name"),
    ).agg(F.count(F.lit(1)).alias("total_orders")).orderBy("month_num")


def category_month_trend(lines: DataFrame) -> DataFrame:
    month = F.date_format("order_date", "yyyy-MM").alias("month")
    return lines.groupBy(month, "category").agg(
        money_sum("sales").alias("total_revenue")).orderBy("month", "category")


def peak_months(orders: DataFrame, n: int = 2) -> DataFrame:
    """The months with most orders; ranks at most twelve rows."""
    busiest = Window.orderBy(F.desc("total_orders"))
    return (
        demand_by_month(orders).withColumn("demand_rank", F.dense_rank().over(busiest))
        .filter(F.col("demand_rank") <= n).orderBy("demand_rank", "order_month")
    )
