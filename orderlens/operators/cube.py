"""Several rollups from one pass over the lines.

Orders in parts of one category, sub-category and discount are all that the rollups by product,
by order attribute and by discount band need. GROUPING SETS add them up per order and key, so that an order counts
once for each key; the keys of one kind are then added up over the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.measures import discount_band, money_sum, percent
from orderlens.operators.commerce import BAND_EDGES

PRODUCT_KEYS = ["category", "sub_category"]
ORDER_KEYS = ["segment", "region", "state", "ship_mode"]
BAND = "discount_band"
SEGMENT_BAND = "segment, discount_band"
MEASURES = ["n_lines", "n_loss_lines", "sum_sales", "sum_profit"]


def rollups(parts: DataFrame, edges: tuple[str, ...] = BAND_EDGES) -> DataFrame:
    """(grouping, key, discount_band, total_orders, total_line_items, loss_making_lines,
    total_revenue, total_profit): a row per key of each grouping, from order parts with
    ORDER_KEYS, PRODUCT_KEYS, discount and MEASURES.
    """
    columns = ["order_id", *PRODUCT_KEYS, *ORDER_KEYS, BAND]
    sets = {"category": ["category"], "sub_category": ["sub_category"], "order": ORDER_KEYS,
            SEGMENT_BAND: ["segment", BAND], BAND: [BAND]}
    banded = parts.withColumn(BAND, discount_band(F.col("discount"), edges))
    per_order = banded.groupingSets(
        [[F.col("order_id"), *map(F.col, keys)] for keys in sets.values()], *columns).agg(
            F.grouping_id().alias("which"), *[F.sum(m).alias(m) for m in MEASURES])

    def number(keys: list[str]) -> int:
        """What grouping_id gives for a set: a bit for each column that is not in it."""
        return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in ["order_id", *keys])

    def entry(name: str, key: str | None, band: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("grouping"), (F.col(key) if key else none).alias("key"),
                        (F.col(BAND) if band else none).alias(BAND))

    entries = {"category": [entry("category", "category", False)],
               "sub_category": [entry("sub_category", "sub_category", False)],
               "order": [entry(k, k, False) for k in ORDER_KEYS],
               SEGMENT_BAND: [entry(SEGMENT_BAND, "segment", True)], BAND: [entry(BAND, None, True)]}
    chosen = F.coalesce(*[F.when(F.col("which") == number(keys), F.array(*entries[name]))
                          for name, keys in sets.items()])
    return (per_order.select(F.explode(chosen).alias("one"), *MEASURES).select("one.*", *MEASURES)
            .groupBy("grouping", "key", BAND).agg(
                F.count(F.lit(1)).alias("total_orders"), F.sum("n_lines").alias("total_line_items"),
                F.sum("n_loss_lines").alias("loss_making_lines"), money_sum("sum_sales").alias("total_revenue"),
                money_sum("sum_profit").alias("total_profit")))


def revenue_of(cube: DataFrame, key: str) -> DataFrame:
    """The rollup by one key, as ``rollup.revenue_by``."""
    margin = percent(F.col("total_profit"), F.col("total_revenue"))
    return cube.filter(F.col("grouping") == key).select(
        F.col("key").alias(key), "total_orders", "total_revenue", "total_profit",
        margin.alias("profit_margin_pct")).orderBy(F.desc_nulls_last("total_revenue"), key)


def bands_of(cube: DataFrame, by_segment: bool) -> DataFrame:
    """The discount bands, within segments or over all lines, as ``commerce.loss_by_discount_band``."""
    rows = cube.filter(F.col("grouping") == (SEGMENT_BAND if by_segment else BAND))
    keys = [F.col("key").alias("segment")] if by_segment else []
    rate = percent(F.col("loss_making_lines"), F.col("total_line_items"))
    return rows.select(*keys, BAND, "total_line_items", "loss_making_lines", rate.alias("loss_making_line_rate_pct"),
                       F.col("total_profit").alias("net_profit")).orderBy(
        F.desc("loss_making_line_rate_pct"), *(["segment"] if by_segment else []), BAND)
