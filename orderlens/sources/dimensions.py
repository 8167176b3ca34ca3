"""The star schema: building it from clean lines, and the flat view over it.

How its tables are stored, loaded and read is in ``star.py``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import is_loss
from orderlens.operators.quality import check_columns
from orderlens.schema import LOAD_COLUMNS

# The natural key of a place; the postal code may be missing.
PLACE = ["city", "state", "postal_code"]
PLACE_COLUMNS = ["city", "state", "region", "country", "postal_code"]
#: The year of the order, by which stored headers and items lie in folders.
YEAR = "order_year"
HEADER_COLUMNS = ["customer_id", "order_date", "ship_date", "ship_mode", "delivery_days"]


def first_per_key(frame: DataFrame, key: list[str], columns: list[str],
                  tie: str | None = None) -> DataFrame:
    """The row that comes first for each key: by ``tie``, then by content.

    Equal rows are folded first, map-side, keeping the lowest tie; only keys with
    conflicting rows have anything left to decide. A key that holds a large part
    of the rows never has to be sorted in one task, as a row number would.
    """
    lowest = [F.min(tie).alias("tie")] if tie else []
    rows = frame.groupBy(*key, *columns).agg(*lowest) if lowest else frame.select(
        *key, *columns).distinct()
    if not columns:
        return rows.select(*key)
    order = F.struct(*(["tie"] if tie else []), *columns)
    return rows.groupBy(*key).agg(F.min(order).alias("first")).select(
        *key, *[F.col(f"first.{c}").alias(c) for c in columns])


def _present(lines: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in lines.columns]


def dense_ids(rows: DataFrame, key: list[str], name: str, after: Column | int = 0) -> DataFrame:
    """Adds numbers without gaps that follow ``after``, one for each row of a different key.

    Two passes: the rows are counted in 65,536 ranges of a digest of the key, and numbered inside
    their range from where the range starts. So no task sorts or numbers all of them, and the
    numbers depend on the keys alone, not on how the rows are dealt out. Different keys of one digest are told
    apart by the key itself.
    """
    text = F.concat_ws("|", *[
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in key])
    marked = rows.withColumn("digest__", F.md5(text.cast("binary"))).withColumn(
        "range__", F.substring("digest__", 1, 4))
    earlier = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = (marked.groupBy("range__").agg(F.count(F.lit(1)).alias("rows__"))
              .select("range__", F.coalesce(F.sum("rows__").over(earlier), F.lit(0)).alias("start__")))
    place = F.row_number().over(Window.partitionBy("range__").orderBy("digest__", *key))
    return (marked.withColumn("place__", place).join(starts, "range__")
            .withColumn(name, (F.col("start__") + F.col("place__") + after).cast("bigint"))
            .select(name, *rows.columns))


def dim_locations(lines: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per place, numbered from 1. A load gives places it stores numbers of its own."""
    key = _present(lines, PLACE)
    others = [c for c in _present(lines, PLACE_COLUMNS) if c not in key]
    places = dense_ids(first_per_key(lines, key, others, tie), key, "location_id")
    return places.select("location_id", *_present(lines, PLACE_COLUMNS))


def dim_customers(lines: DataFrame, tie: str | None = None) -> DataFrame:
    return first_per_key(lines, ["customer_id"], ["customer_name", "segment"], tie)


def dim_products(lines: DataFrame, tie: str | None = None) -> DataFrame:
    return first_per_key(
        lines, ["product_id"], ["product_name", "category", "sub_category"], tie)


def sold_products(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Products that some line holds; of the lines, one per product is moved from a task."""
    return products.join(lines.select("product_id").distinct(), "product_id", "left_semi")


def order_headers(lines: DataFrame, locations: DataFrame,
                  tie: str | None = None) -> DataFrame:
    """One row per order with its location id looked up by the natural key."""
    key = _present(lines, PLACE)
    headers = first_per_key(lines, ["order_id"], HEADER_COLUMNS + key, tie)
    place = locations.select("location_id", *[F.col(c).alias(f"stored_{c}") for c in key])
    return headers.join(place, same_key(key)).select(
        "order_id", "customer_id", "location_id", "order_date", "ship_date", "ship_mode",
        "delivery_days")


def same_key(key: list[str]) -> Column:
    """A row's key equals that of a stored row; a missing part, such as a postal code, equals a
    missing part.
    """
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in key])


def fact_order_items(lines: DataFrame, key: list[str]) -> DataFrame:
    return lines.select(
        *key, *[c for c in ("order_id", "product_id") if c not in key],
        "sales", "quantity", "discount", "profit")


def build_star(lines: DataFrame, item_key: list[str] | None = None,
               required: list[str] = LOAD_COLUMNS) -> dict[str, DataFrame]:
    """All five tables from clean lines; the lowest row id wins a conflict. A frame without
    one of the ``required`` columns is refused before any job runs.
    """
    check_columns(lines, required)
    item_key = item_key or ["row_id"]
    tie = item_key[0] if item_key == ["row_id"] else None
    locations = dim_locations(lines, tie)
    return {
        "locations": locations,
        "customers": dim_customers(lines, tie),
        "products": dim_products(lines, tie),
        "orders": order_headers(lines, locations, tie),
        "order_items": fact_order_items(lines, item_key),
    }


def star_view(star: dict[str, DataFrame]) -> DataFrame:
    """The flat view: items with their order, customer, location and product.

    Customers and places join the headers first, one row per order, before the
    items do. Sides are broadcast or not by their size. Stored tables are joined by the
    order's year as well, so that a filter on the headers decides which folders of items are read.
    """
    places = star["locations"].drop("country", "postal_code")
    orders = star["orders"].join(star["customers"], "customer_id").join(
        places, "location_id").drop("location_id")
    by = ["order_id"] + [YEAR] * all(YEAR in star[t].columns for t in ("orders", "order_items"))
    flat = star["order_items"].join(star["products"], "product_id").join(orders, by).drop(YEAR)
    return flat.withColumn("is_loss_line", is_loss(F.col("profit")))


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str],
             tie: str | None = None) -> DataFrame:
    """Rows whose key is not stored yet, one per key: insert, on conflict do nothing."""
    others = [c for c in incoming.columns if c not in key]
    if not others:
        # Rows that are all key meet the stored keys as they are folded, in one shuffle.
        both = incoming.withColumn("old__", F.lit(0)).unionByName(existing.select(*key).withColumn("old__", F.lit(1)))
        return both.groupBy(*key).agg(F.max("old__").alias("old__")).filter("old__ = 0").select(*incoming.columns)
    fresh = first_per_key(incoming, key, others, tie)
    stored = existing.select(*[F.col(c).alias(f"stored_{c}") for c in key])
    return fresh.join(stored, same_key(key), "left_anti").select(*incoming.columns)


def load_audit(star: dict[str, DataFrame]) -> DataFrame:
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        for name, frame in star.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")
