"""Revenue, margin and discount questions at line grain."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import (
    count_where, discount_band, is_loss, money_sum, or_zero, percent, ratio,
)
from orderlens.plans.reuse import compute_once, one_row

# Upper edges of the discount bands and the deep-discount limit.
BAND_EDGES = ("0.2", "0.4")
DEEP_DISCOUNT = "0.4"

def revenue_by_category(lines: DataFrame) -> DataFrame:
    return lines.groupBy("category", "sub_category").agg(
        F.count(F.lit(1)).alias("total_line_items"),
        money_sum("sales").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        percent(F.sum("profit"), F.sum("sales")).alias("profit_margin_pct"),
        ratio(F.sum("discount"), F.count("discount"), 3).alias("avg_discount"),
    ).orderBy(F.desc_nulls_last("total_revenue"), "category", "sub_category")


def loss_by_discount_band(parts: DataFrame, *keys: str,
                          edges: tuple[str, ...] = BAND_EDGES) -> DataFrame:
    """Loss-making lines by discount band, within ``keys`` such as segment, from lines
    already summed per order and discount (n_lines, n_loss_lines, sum_profit).
    """
    loss, rows = F.sum("n_loss_lines"), F.sum("n_lines")
    band = discount_band(F.col("discount"), edges)
    return parts.withColumn("discount_band", band).groupBy(*keys, "discount_band").agg(
        rows.alias("total_line_items"),
        loss.alias("loss_making_lines"),
        percent(loss, rows).alias("loss_making_line_rate_pct"),
        money_sum("sum_profit").alias("net_profit"),
    ).orderBy(F.desc("loss_making_line_rate_pct"), *keys, "discount_band")


def category_performance(lines: DataFrame) -> DataFrame:
    """Sub-categories ranked by revenue and, worst first, by margin.

    The two rankings run over one row per sub-category of the product taxonomy.
    """
    stats = lines.groupBy("sub_category", "category").agg(
        money_sum("sales").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        percent(F.sum("profit"), F.sum("sales")).alias("margin_pct"),
    )
    by_revenue = Window.orderBy(F.desc_nulls_last("total_revenue"))
    by_margin = Window.orderBy(F.asc_nulls_last("margin_pct"))
    return stats.select(
        "*",
        F.rank().over(by_revenue).alias("revenue_rank"),
        F.rank().over(by_margin).alias("margin_rank_worst_first"),
    ).orderBy("revenue_rank", "sub_category", "category")


def rank_divergence(lines: DataFrame, top_revenue: int = 10, bottom_margin: int = 10) -> DataFrame:
    """Sub-categories that lead on revenue and trail on margin at once."""
    return category_performance(lines).filter(
        (F.col("revenue_rank") <= top_revenue)
        & (F.col("margin_rank_worst_first") <= bottom_margin))


def top_products(lines: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` product names with most revenue."""
    return (
        lines.groupBy("product_name").agg(
            F.sum("sales").alias("revenue"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("profit").alias("total_profit"))
        .orderBy(F.desc_nulls_last("revenue"), "product_name").limit(n)
        .select("product_name", F.round("revenue", 2).alias("total_revenue"),
                "total_quantity", "total_profit")
    )


def revenue_share(lines: DataFrame, key: str = "category") -> DataFrame:
    stats = compute_once(lines.groupBy(key).agg(F.sum("sales").alias("revenue")))
    whole = one_row(stats.agg(F.sum("revenue").alias("revenue")))
    return stats.select(
        key, F.round("revenue", 2).alias("total_revenue"),
        ratio(F.col("revenue"), whole["revenue"], 6).alias("revenue_share"),
    ).orderBy(F.desc_nulls_last("revenue_share"), key)


def deep_discount_loss(lines: DataFrame, limit: str = DEEP_DISCOUNT) -> DataFrame:
    """Lines discounted beyond ``limit``: how many, their loss rate, the overall one."""
    deep = F.col("discount") > F.lit(Decimal(limit))
    loss = is_loss(F.col("profit"))
    n_deep = F.coalesce(count_where(deep), F.lit(0))
    return lines.agg(
        n_deep.alias("n_lines"),
        or_zero(percent(count_where(deep & loss), n_deep)).alias("loss_line_rate"),
        or_zero(percent(count_where(loss), F.count(F.lit(1)))).alias("baseline_loss_line_rate"),
    )


def deep_discount_concentration(lines: DataFrame, limit: str = DEEP_DISCOUNT) -> DataFrame:
    """Where the deeply discounted lines sit, largest sub-category first."""
    stats = compute_once(
        lines.filter(F.col("discount") > F.lit(Decimal(limit)))
        .groupBy("sub_category").agg(F.count(F.lit(1)).alias("n_lines")))
    whole = one_row(stats.agg(F.sum("n_lines").alias("n_lines")))
    return stats.select(
        "sub_category", "n_lines",
        ratio(F.col("n_lines"), whole["n_lines"], 6).alias("share"),
    ).orderBy(F.desc("n_lines"), "sub_category")


def avg_discount_by_state(orders: DataFrame) -> DataFrame:
    return orders.groupBy("state").agg(
        ratio(F.sum("sum_discount"), F.sum("n_lines"), 4).alias("avg_discount")
    ).orderBy(F.desc_nulls_last("avg_discount"), "state")


def discount_vs_rest(orders: DataFrame) -> DataFrame:
    """Mean discount of each state beside that of all other states.

    The rest is the total less the state, so no state is compared row by row.
    """
    stats = compute_once(orders.groupBy("state").agg(
        F.sum("sum_discount").alias("discounts"), F.sum("n_lines").alias("n")))
    return with_rest(stats).select(
        "state", "avg_discount", "other_states_avg_discount").orderBy("state")


def with_rest(stats: DataFrame) -> DataFrame:
    """Adds both means to a computed frame with ``discounts`` and ``n`` per state."""
    whole = one_row(stats.agg(F.sum("discounts").alias("discounts"), F.sum("n").alias("n")))
    return stats.withColumn("whole", whole).select(
        *stats.columns,
        ratio(F.col("discounts"), F.col("n"), 4).alias("avg_discount"),
        ratio(F.col("whole.discounts") - F.col("discounts"), F.col("whole.n") - F.col("n"), 4)
        .alias("other_states_avg_discount"),
    )


def worst_margin_subcategory(revenue: DataFrame) -> DataFrame:
    """The weakest row of a revenue rollup by sub-category."""
    return revenue.orderBy(F.asc_nulls_last("profit_margin_pct"), "sub_category").limit(1)
