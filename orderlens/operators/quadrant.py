"""Volume against performance: which segments are large and do badly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.measures import EXACT, count_where, is_loss, money_sum, percent
from orderlens.operators.kpi import mean_over_lines
from orderlens.plans.reuse import compute_once, one_row

# The four labels.
PRIORITY = "High Volume / Poor Performance - PRIORITY"
BENCHMARK = "High Volume / Good Performance - BENCHMARK"
INVESTIGATE = "Low Volume / Poor Performance - INVESTIGATE"
LOW_PRIORITY = "Low Volume / Good Performance - LOW PRIORITY"


def classify(stats: DataFrame, volume: str, rate: str, label: str = "quadrant") -> DataFrame:
    """Label each segment against the median volume and the unweighted mean rate.

    ``rate`` is compared as rounded, against the mean of the rounded rates; both
    comparisons count a tie as high. Adds ``median_volume`` and ``mean_rate``.

    The segment frame feeds both its rows and its thresholds, so it is computed
    once. The thresholds are one row, passed on as a scalar; the median keeps one
    counter per distinct volume, at most sqrt(2 * orders) of them.
    """
    stats = compute_once(stats)
    overall = one_row(stats.agg(
        F.median(volume).alias("median_volume"),
        F.sum(rate).alias("rate_sum"),
        F.count(rate).alias("n"),
    ))
    known = stats.withColumn("overall", overall)
    high = F.col(volume) >= F.col("overall.median_volume")
    # rate >= mean, multiplied out so that a tie is exact.
    poor = F.col(rate) * F.col("overall.n") >= F.col("overall.rate_sum")
    quadrant = (
        F.when(high & poor, PRIORITY)
        .when(high & ~poor, BENCHMARK)
        .when(~high & poor, INVESTIGATE)
        .otherwise(LOW_PRIORITY)
    )
    return known.select(
        *stats.columns,
        quadrant.alias(label),
        F.col("overall.median_volume").alias("median_volume"),
        F.try_divide(F.col("overall.rate_sum").cast(EXACT), F.col("overall.n").cast(EXACT))
        .alias("mean_rate"),
    )


def order_cells(orders: DataFrame) -> DataFrame:
    """Orders as cells of one order each, the shape ``order_cube`` sums up."""
    return orders.select(
        "state", "region", "ship_mode", "delivery_days",
        F.lit(1).cast("bigint").alias("n_orders"),
        F.when(is_loss(F.col("sum_profit")), 1).otherwise(0).alias("n_loss_orders"),
        "n_lines", "sum_sales", "sum_profit", "sum_discount",
    )


def order_cube(orders: DataFrame) -> DataFrame:
    """Orders summed to state, ship mode and day count, computed once.

    Serves state and delivery questions alike from one pass over the orders; its
    size is bounded by states x ship modes x the day domain.
    """
    keys = ["state", "region", "ship_mode", "delivery_days"]
    cells = order_cells(orders)
    return compute_once(cells.groupBy(*keys).agg(*[
        F.sum(c).alias(c) for c in cells.columns if c not in keys]))


def location_stats(cells: DataFrame, delivery_grain: str = "order") -> DataFrame:
    """Orders, revenue, order loss rate, delivery days and discounts by state."""
    weight = "n_orders" if delivery_grain == "order" else "n_lines"
    return cells.groupBy("state", "region").agg(
        F.sum("n_orders").alias("total_orders"),
        money_sum("sum_sales").alias("total_revenue"),
        percent(F.sum("n_loss_orders"), F.sum("n_orders")).alias("loss_rate_pct"),
        mean_over_lines(weight=weight).alias("avg_delivery_days"),
        F.sum("sum_discount").alias("sum_discount"),
        F.sum("n_lines").alias("n_lines"),
    )


def location_performance(orders: DataFrame) -> DataFrame:
    """States by quadrant; delivery days averaged over orders."""
    stats = location_stats(order_cells(orders), "order").select(
        "state", "region", "total_orders", "total_revenue",
        F.col("loss_rate_pct").alias("order_loss_rate_pct"), "avg_delivery_days")
    ranked = classify(stats, "total_orders", "order_loss_rate_pct", "performance_segment")
    return ranked.drop("median_volume", "mean_rate").orderBy(
        F.desc("total_orders"), "state", "region")


def location_performance_lines(orders: DataFrame) -> DataFrame:
    """States by quadrant with both thresholds; delivery days averaged over lines."""
    return rank_states(order_cells(orders)).drop("sum_discount", "n_lines")


def rank_states(cells: DataFrame) -> DataFrame:
    ranked = classify(location_stats(cells, "line"), "total_orders", "loss_rate_pct")
    return (
        ranked.withColumnsRenamed({"median_volume": "median_orders", "mean_rate": "avg_loss_rate"})
        .orderBy(F.desc("total_orders"), "state", "region")
    )


def bottleneck_segments(parts: DataFrame, min_orders: int = 5,
                        priority_first: bool = True) -> DataFrame:
    """State x sub-category segments by quadrant, at line grain because an order
    can span sub-categories. Takes order parts by state and sub-category. Thin
    segments go before the thresholds are taken.
    """
    stats = parts.groupBy("state", "sub_category").agg(
        F.count(F.lit(1)).alias("order_volume"),
        percent(F.sum("n_loss_lines"), F.sum("n_lines")).alias("line_loss_rate_pct"),
        money_sum("sum_profit").alias("total_profit"),
    ).filter(F.col("order_volume") >= min_orders)
    ranked = classify(stats, "order_volume", "line_loss_rate_pct").select(
        "state", "sub_category", "order_volume", "line_loss_rate_pct", "total_profit",
        F.round("median_volume", 1).alias("overall_median_volume"),
        F.round("mean_rate", 2).alias("overall_avg_line_loss_rate"),
        "quadrant",
    )
    first = [F.when(F.col("quadrant") == PRIORITY, 0).otherwise(1)] if priority_first else []
    return ranked.orderBy(*first, F.desc("order_volume"), "state", "sub_category")


def only_priority(ranked: DataFrame, label: str = "quadrant") -> DataFrame:
    return ranked.filter(F.col(label) == PRIORITY)


def top_states(ranked: DataFrame, n: int = 10, by: str = "total_orders") -> DataFrame:
    """The first ``n`` states by ``by``, shown from low to high revenue."""
    return ranked.orderBy(F.desc(by), "state", "region").limit(n).orderBy(
        "total_revenue", "state", "region")


def states_by_loss_rate(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("loss_rate_pct"), "state", "region")


def priority_states(ranked: DataFrame) -> DataFrame:
    return only_priority(ranked).orderBy(F.desc("total_orders"), "state", "region")


def priority_segments(segments: DataFrame, n: int = 15) -> DataFrame:
    return only_priority(segments).orderBy(
        F.desc("order_volume"), "state", "sub_category").limit(n)
