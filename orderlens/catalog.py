"""Every question bound to the base tables of one folder.

Parameters that depend on the data: these tables discount by 0 to 10 percent,
so the bands end at 4 and 8 percent and "deep" means more than 8 percent.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.measures import present
from orderlens.operators import (
    calendar, commerce, cube, delivery, filters, findings, kpi, moments, profile, quadrant, quality,
    rollup, sketches,
)
from orderlens.operators.dashboard import ORDER_FRAME
from orderlens.plans import order_frame
from orderlens.plans.reuse import release
from orderlens.schema import NUMERIC, STAR_KEYS, TEXT_LENGTHS
from orderlens.session import scratch_path, tune
from orderlens.sources import files, star
from orderlens.sources.gate import gate_report
from orderlens.sources.warehouse import LINE_COLUMNS, Warehouse

BANDS = ("0.04", "0.08")
DEEP = "0.08"
ITEM_KEY = ["order_id", "line_number"]

# The selection used by the filtered queries.
SELECTION = filters.Filters(
    regions=("ASIA", "EUROPE"), categories=("ECONOMY", "SMALL"),
    ship_modes=("1-URGENT", "2-HIGH", "5-LOW"),
    start=date(1996, 1, 1), end=date(1999, 12, 31))

Query = Callable[[Warehouse], DataFrame]
QUERIES: dict[str, Query] = {}


def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, path: str) -> DataFrame:
        # What earlier questions kept is not needed by this one.
        release()
        return present(build(Warehouse.gated(tune(spark), path)))
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(build) for name, build in QUERIES.items()}


# -- KPIs ---------------------------------------------------------------------------

QUERIES |= {
    "total_orders": lambda w: kpi.total_orders(w.lines("order_id")),
    "total_revenue": lambda w: kpi.total_revenue(w.lines("sales")),
    "total_profit": lambda w: kpi.total_profit(w.lines("profit")),
    "average_order_value": lambda w: kpi.average_order_value(w.lines("order_id", "sales")),
    "profit_margin_pct": lambda w: kpi.profit_margin_pct(w.lines("sales", "profit")),
    "loss_making_line_rate": lambda w: kpi.loss_making_line_rate(w.lines("profit")),
    "loss_making_order_rate": lambda w: kpi.loss_making_order_rate(w.orders("sum_profit")),
    "average_delivery_days": lambda w: kpi.average_delivery_days(
        w.orders("delivery_days", "n_lines")),
    "kpi_summary": lambda w: kpi.kpi_summary(w.orders(
        "delivery_days", "n_lines", "n_loss_lines", "sum_sales", "sum_profit")),
    "headline_metrics": lambda w: kpi.headline_metrics(w.orders(
        "delivery_days", "n_lines", "sum_sales", "sum_profit", filters=SELECTION)),
}

# -- rollups and rankings ---------------------------------------------------------------


def _by_product(w: Warehouse) -> DataFrame:
    return w.lines("order_id", "category", "sub_category", "sales", "profit")


def _by_part(key: str) -> Query:
    return lambda w: rollup.revenue_by_order_attribute(
        w.orders("sum_sales", "sum_profit", by=(key,)), key)


def _by_order(key: str) -> Query:
    return lambda w: rollup.revenue_by_order_attribute(
        w.orders(key, "sum_sales", "sum_profit"), key)


QUERIES |= {
    "orders_by_location": lambda w: rollup.orders_by_location(
        w.orders("region", "state", "sum_sales")),
    "aov_by_segment_region": lambda w: rollup.aov_by_segment_region(
        w.orders("segment", "region", "sum_sales")),
    "revenue_by_category_margin": lambda w: commerce.revenue_by_category(w.lines(
        "category", "sub_category", "sales", "profit", "discount")),
    "revenue_by_category": _by_part("category"),
    "revenue_by_sub_category": _by_part("sub_category"),
    "revenue_by_segment": _by_order("segment"),
    "revenue_by_region": _by_order("region"),
    "revenue_by_state": _by_order("state"),
    "revenue_by_ship_mode": _by_order("ship_mode"),
    "category_performance": lambda w: commerce.category_performance(_by_product(w)),
    "rank_divergence": lambda w: commerce.rank_divergence(_by_product(w), 40, 40),
    "top_products": lambda w: commerce.top_products(
        w.lines("product_name", "sales", "quantity", "profit")),
    "revenue_share": lambda w: commerce.revenue_share(_by_product(w)),
    "worst_margin_subcategory": lambda w: commerce.worst_margin_subcategory(
        _by_part("sub_category")(w)),
}



def _by_discount(w: Warehouse, *keys: str) -> DataFrame:
    """Orders in parts of one discount each."""
    return w.orders(*keys, "n_lines", "n_loss_lines", "sum_profit", by=("discount",))


def _rollups(w: Warehouse) -> DataFrame:
    return cube.rollups(w.orders("order_id", *cube.ORDER_KEYS, *cube.MEASURES,
                                 by=(*cube.PRODUCT_KEYS, "discount")), BANDS)


QUERIES |= {"rollups_in_one_pass": _rollups}

# -- discounts ------------------------------------------------------------------------

QUERIES |= {
    "loss_by_discount_band": lambda w: commerce.loss_by_discount_band(
        _by_discount(w, "segment"), "segment", edges=BANDS),
    "loss_by_discount_band_total": lambda w: commerce.loss_by_discount_band(
        _by_discount(w), edges=BANDS),
    "deep_discount_loss": lambda w: commerce.deep_discount_loss(
        w.lines("discount", "profit"), DEEP),
    "deep_discount_concentration": lambda w: commerce.deep_discount_concentration(
        w.lines("discount", "sub_category"), DEEP),
    "avg_discount_by_state": lambda w: commerce.avg_discount_by_state(
        w.orders("state", "sum_discount", "n_lines")),
    "discount_vs_rest": lambda w: commerce.discount_vs_rest(
        w.orders("state", "sum_discount", "n_lines")),
}

# -- quadrants ------------------------------------------------------------------------


def _location_orders(w: Warehouse) -> DataFrame:
    return w.orders(*ORDER_FRAME)


def _segments(w: Warehouse, **options) -> DataFrame:
    parts = w.orders("state", "n_lines", "n_loss_lines", "sum_profit", by=("sub_category",))
    return quadrant.bottleneck_segments(parts, **options)


def _plain_segments(w: Warehouse, **options) -> DataFrame:
    return _segments(w, priority_first=False, **options).drop(
        "overall_median_volume", "overall_avg_line_loss_rate")


QUERIES |= {
    "location_performance": lambda w: quadrant.location_performance(_location_orders(w)),
    "location_performance_lines": lambda w: quadrant.location_performance_lines(
        _location_orders(w)).withColumn("avg_loss_rate", F.round("avg_loss_rate", 6)),
    "bottleneck_segments": lambda w: _segments(w),
    "bottleneck_segments_min_orders": lambda w: _plain_segments(w, min_orders=12),
    "top_states": lambda w: _state_view(quadrant.top_states(_ranked(w))),
    "states_by_loss_rate": lambda w: _state_view(quadrant.states_by_loss_rate(_ranked(w))),
    "priority_states": lambda w: _state_view(quadrant.priority_states(_ranked(w))),
    "priority_segments": lambda w: quadrant.priority_segments(_plain_segments(w)),
}


def _ranked(w: Warehouse) -> DataFrame:
    return quadrant.location_performance_lines(_location_orders(w))


def _state_view(ranked: DataFrame) -> DataFrame:
    return ranked.drop("median_orders", "avg_loss_rate")


# -- delivery and calendar ----------------------------------------------------------

QUERIES |= {
    "delivery_performance": lambda w: delivery.delivery_performance(
        w.orders("ship_mode", "delivery_days", "n_lines")),
    "delivery_benchmark": lambda w: delivery.delivery_benchmark(
        w.orders("ship_mode", "delivery_days")),
    "slowest_ship_mode": lambda w: delivery.slowest_ship_mode(
        w.orders("ship_mode", "delivery_days")),
    "worst_benchmark_mode": lambda w: delivery.worst_benchmark_mode(
        w.orders("ship_mode", "delivery_days")),
    "delivery_boxplot": lambda w: delivery.delivery_boxplot(
        w.orders("ship_mode", "delivery_days")),
    "demand_by_month": lambda w: calendar.demand_by_month(w.orders("order_date", "sum_sales")),
    "demand_by_weekday": lambda w: calendar.demand_by_weekday(w.orders("order_date", "sum_sales")),
    "monthly_trend": lambda w: calendar.monthly_trend(w.orders("order_date", "sum_sales")),
    "month_seasonality": lambda w: calendar.month_seasonality(w.orders("order_date")),
    "category_month_trend": lambda w: calendar.category_month_trend(w.orders(
        "order_date", "sum_sales", by=("category",)).withColumnRenamed("sum_sales", "sales")),
    "peak_months": lambda w: calendar.peak_months(w.orders("order_date", "sum_sales")),
}

# -- filters, findings, profiling -----------------------------------------------------


def _evidence(w: Warehouse) -> findings.Evidence:
    return findings.gather(
        w.orders(*ORDER_FRAME), w.lines("sub_category", "sales", "profit", "discount"), DEEP)


QUERIES |= {
    "filter_lines": lambda w: w.lines(*LINE_COLUMNS, filters=SELECTION),
    "filter_domains": lambda w: filters.filter_domains(
        w.orders("region", "ship_mode", "order_date", by=("category",))),
    "findings": lambda w: findings.findings(_evidence(w)),
    "insights": lambda w: findings.insights(_evidence(w)),
    "histogram_sales": lambda w: profile.histogram(w.lines("sales"), "sales"),
    "histogram_profit": lambda w: profile.histogram(w.lines("profit"), "profit"),
    "loss_line_share": lambda w: profile.loss_line_share(w.lines("profit")),
    "value_counts": lambda w: profile.value_counts(
        w.orders("region", "ship_mode", "segment", "n_lines", by=("category", "sub_category")),
        weight="n_lines"),
    "sample_lines": lambda w: profile.sample_lines(w.lines(
        *ITEM_KEY, "product_id", "quantity", "discount", "sales", "category", "profit")),
    "correlation_matrix": lambda w: moments.correlations(w.order_moments(), NUMERIC),
    "head_lines": lambda w: profile.head(
        w.lines(*ITEM_KEY, "product_id", "quantity", "sales"), 10,
        *ITEM_KEY, "product_id", "quantity", "sales"),
}

# -- sketches and the stored order frame ----------------------------------------------


def _distinct_by_year(w: Warehouse) -> DataFrame:
    """Exact counts by year, and whether the merged states of the days are within four
    standard errors of them.
    """
    columns = ["customer_id", "order_id"]
    orders = w.orders("order_date", *columns)
    year = F.year("day").alias("order_year")
    states = sketches.daily_distinct(orders, "order_date", columns)
    exact = orders.groupBy(F.year("order_date").alias("order_year")).agg(
        *[F.count_distinct(c).alias(c) for c in columns]).unpivot(["order_year"], columns, "column_name", "n_distinct")
    error = F.abs(F.col("estimate") - F.col("n_distinct"))
    bound = F.col("n_distinct") * F.lit(4 * 1.04 / 2 ** (sketches.LG_K / 2)) + 1
    return exact.join(sketches.distinct_of(states, year), ["order_year", "column_name"]).select(
        "order_year", "column_name", "n_distinct", (error <= bound).alias("within_bound"))


def _quantiles_by_year(w: Warehouse) -> DataFrame:
    """Whether the quartiles of the merged states of a year's days are within two percent of
    their rank among all lines of the year.
    """
    lines = w.lines("order_date", "sales")
    found = sketches.quantiles_of(sketches.daily_quantiles(lines, "order_date", "sales"), [0.25, 0.5, 0.75],
                                  F.year("day").alias("order_year"))
    value = F.col("sales").cast("double")
    ranked = lines.withColumn("order_year", F.year("order_date")).join(found, "order_year").groupBy(
        "order_year", "share").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg((value < F.col("value")).cast("double")).alias("below"),
            F.avg((value <= F.col("value")).cast("double")).alias("upto"))
    slack = F.lit(0.02) + F.lit(1.0) / F.col("n_rows")
    return ranked.select("order_year", "share", "n_rows", (
        (F.col("below") <= F.col("share") + slack) & (F.col("upto") >= F.col("share") - slack)).alias("within_bound"))


def _refreshed_orders(w: Warehouse) -> DataFrame:
    """The stored order frame after two batches, the second with late lines of orders that the
    first one holds, and a replay.
    """
    path = scratch_path(w.spark, "orders")
    lines = w.lines("order_id", *order_frame.ATTRIBUTES, "line_ship_date", "line_number", "sales", "profit",
                    "discount").withColumnRenamed("line_ship_date", "ship_date")
    early = (F.col("order_date") < F.lit(date(1998, 1, 1))) & (F.col("line_number") <= 3)
    for name, batch in (("a", lines.filter(early)), ("b", lines.filter(~early)), ("a", lines.filter(early))):
        order_frame.refresh(batch, path, name)
    return order_frame.scan(w.spark, path)


QUERIES |= {
    "distinct_by_year": _distinct_by_year,
    "sales_quantiles_by_year": _quantiles_by_year,
    "refreshed_orders": _refreshed_orders,
}

# -- quality ----------------------------------------------------------------------------

# Headings of the raw form of these tables.
RAW_HEADINGS = {
    "order_id": "Order ID", "line_number": " Line-Number", "order_date": "Order Date",
    "ship_date": "Ship Date", "ship_mode": "Ship Mode", "customer_id": "Customer ID",
    "customer_name": "Customer Name", "segment": "Segment", "state": "State",
    "region": "Region", "category": "Category", "sub_category": "Sub-Category",
    "product_id": "Product ID", "product_name": "Product Name", "sales": "Sales", "quantity": "Quantity",
    "discount": "Discount", "profit": "Profit ",
}


def raw_lines(w: Warehouse) -> DataFrame:
    """The lines as a raw export: headings, text dates and padded categories.
    Shipments of pending orders carry no parseable date.
    """
    lines = w.lines(*RAW_HEADINGS, "order_status")

    def text(day: str):
        return F.date_format(day, quality.RAW_DATE_FORMAT)

    pending = F.col("order_status") == "P"
    raw = lines.withColumns({
        "order_date": text("order_date"),
        "ship_date": F.when(pending, "pending").otherwise(text("ship_date")),
        "region": F.concat(F.lit(" "), "region"),
        "category": F.concat("category", F.lit("  ")),
    })
    return raw.select(*[F.col(c).alias(h) for c, h in RAW_HEADINGS.items()])


def resent_lines(w: Warehouse) -> DataFrame:
    """The raw export in which every line that is not pending was sent twice."""
    copies = F.when(F.col("Ship Date") == "pending", 1).otherwise(2)
    return raw_lines(w).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def _clean_lines(w: Warehouse) -> DataFrame:
    return quality.clean(raw_lines(w))


def _rule_lines(w: Warehouse) -> DataFrame:
    return w.lines(*ITEM_KEY, "order_date", "ship_date", "delivery_days", "sales", "quantity",
                   "discount")


def _base_star(w: Warehouse) -> dict[str, DataFrame]:
    """The stored tables, looking nothing up that could hide a row without a parent. Headers know
    whether their customer and its place were found.
    """
    nation = w.table("nation").selectExpr(
        "n_nationkey AS location_id", "n_name AS state", "n_regionkey AS region_id")
    items = w.table("lineitem")
    shipped = items.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.max("l_shipdate").cast("date").alias("ship_date"))
    places = nation.select("location_id", F.lit(True).alias("place_found")).distinct()
    customers = w.customers().select("customer_id", "location_id", F.lit(True).alias("customer_found"))
    headers = w.base_headers().join(shipped, "order_id").join(customers, "customer_id", "left").join(
        places, "location_id", "left")
    return {
        "locations": nation.join(w.regions(), "region_id", "left"),
        "customers": w.customers(),
        "products": w.products(),
        "orders": quality.derive_delivery_days(headers),
        "order_items": w.items().drop("line_ship_date"),
    }


def _constraints(w: Warehouse) -> DataFrame:
    tables = _base_star(w)
    return quality.constraint_violations(
        tables,
        keys={"locations": ["location_id"], "customers": ["customer_id"],
              "products": ["product_id"], "orders": ["order_id"], "order_items": ITEM_KEY},
        not_null={
            "locations": ["state", "region"],
            "customers": ["customer_id", "customer_name", "segment"],
            "products": ["product_id", "product_name", "category", "sub_category"],
            "orders": ["order_id", "customer_id", "order_date", "ship_date", "ship_mode",
                       "delivery_days"],
            "order_items": ["order_id", "product_id", "sales", "quantity", "discount"],
        },
        checks={"orders": ["delivery_days >= 0", "ship_date >= order_date"],
                "products": ["price in hundredths"],
                "order_items": ["sales >= 0", "quantity > 0", "discount between 0 and 1",
                                "whole quantity", "amounts in hundredths"]},
        lengths={t: {c: TEXT_LENGTHS[c] for c in columns} for t, columns in {
            "locations": ["state", "region"], "customers": ["customer_name", "segment"],
            "products": ["product_name", "category", "sub_category"],
            "orders": ["ship_mode"]}.items()},
        references=[("locations", "region_id", "regions"), ("customers", "location_id", "locations"),
                    ("orders", "customer_id", "customers"), ("orders", "location_id", "locations"),
                    ("order_items", "order_id", "orders"), ("order_items", "product_id", "products")],
        # Every stored order is a parent, also one that has no lines.
        parents={"regions": w.regions(), "orders": w.base_headers()},
        found={("orders", "customer_id"): "customer_found", ("orders", "location_id"): "place_found"},
        # The lines' keys without a parent that counts hold those without any.
        counted=w.gate and {("order_items", "order_id"): w.gate.keys("line_order"),
                            ("order_items", "product_id"): w.gate.keys("line_product")},
    )


QUERIES |= {
    "normalize_columns": lambda w: quality.normalize_columns(raw_lines(w)),
    "dedup_lines": lambda w: quality.dedup_report(resent_lines(w)),
    "null_profile": lambda w: quality.null_profile(_clean_lines(w)),
    "parse_dates": lambda w: quality.parse_dates(
        quality.normalize_columns(raw_lines(w)), "order_date", "ship_date").select(
            *ITEM_KEY, "order_date", "ship_date"),
    "quality_flag": lambda w: quality.quality_flag_counts(quality.quality_flag(
        w.orders("order_date", "ship_date", "n_lines")), weight="n_lines"),
    "derive_delivery_days": lambda w: quality.derive_delivery_days(
        w.lines(*ITEM_KEY, "order_date", "ship_date")),
    "range_checks": lambda w: quality.range_checks(w.lines("quantity", "sales", "discount")),
    "categorical_profile": lambda w: quality.categorical_profile(
        quality.normalize_columns(raw_lines(w))),
    "derive_loss_flag": lambda w: quality.derive_loss_flag(w.lines(*ITEM_KEY, "profit")),
    "cleaning_report": lambda w: quality.cleaning_report(resent_lines(w)),
    "clean_lines": _clean_lines,
    "constraint_violations": _constraints,
    "gate_report": lambda w: gate_report(w.gate),
    "quarantine_lines": lambda w: quality.quarantine_lines(_rule_lines(w))[1],
    "accepted_lines": lambda w: quality.quarantine_lines(_rule_lines(w))[0],
    "duplicate_keys": lambda w: quality.duplicate_keys(w.lines(*ITEM_KEY), *ITEM_KEY),
    "order_fd_check": lambda w: quality.order_fd_check(
        w.lines("order_id", "state", "ship_mode", "delivery_days", "line_ship_date"),
        ["state", "ship_mode", "delivery_days", "line_ship_date"]),
    "dataset_overview": lambda w: quality.dataset_overview(
        w.lines("order_id", "order_date"), len(LINE_COLUMNS)),
    "column_types": lambda w: quality.column_types(w.lines()),
}

# -- star schema and files ----------------------------------------------------------------


def _new_customers(w: Warehouse) -> DataFrame:
    """Customers of orders since 1999 who had none before."""
    customers = w.orders("customer_id", "customer_name", "segment", "order_date")
    late = F.col("order_date") >= F.lit(date(1999, 1, 1))
    existing = customers.filter(~late).select("customer_id").distinct()
    return star.new_rows(
        customers.filter(late).drop("order_date"), existing, ["customer_id"])


def _stored_customers(w: Warehouse) -> DataFrame:
    """The customers of orders before 1999 stored as a table, those since then appended where
    absent, twice, and the table read back.
    """
    customers = w.orders("customer_id", "customer_name", "segment", "order_date")
    late = F.col("order_date") >= F.lit(date(1999, 1, 1))
    columns = ["customer_id", "customer_name", "segment"]
    path = scratch_path(w.spark, "customers")
    star.dim_customers(customers.filter(~late)).select(*columns).write.parquet(path)
    for _ in range(2):
        star.append_new_rows(customers.filter(late).select(*columns), path, ["customer_id"])
    return w.spark.read.parquet(path)


def _loaded_star(w: Warehouse) -> dict[str, DataFrame]:
    """The five tables as a load builds them, each from the narrowest lines that
    hold its columns; order attributes come from the order frame."""
    headers = w.orders("order_id", "state", "region", *star.HEADER_COLUMNS)
    return {
        "locations": star.dim_locations(w.orders("state", "region")),
        "customers": star.dim_customers(w.orders("customer_id", "customer_name", "segment")),
        "products": star.dim_products(w.lines(
            "product_id", "product_name", "category", "sub_category")),
        # Looked up among all places, which read no order.
        "orders": star.order_headers(headers, star.dim_locations(w.locations())),
        "order_items": star.fact_order_items(w.lines(
            *ITEM_KEY, "product_id", "sales", "quantity", "discount", "profit"), ITEM_KEY),
    }


def _stored_star(w: Warehouse) -> str:
    """The five tables stored. The facts are read twice, once per grain: the order frame is
    written first, and the items go to their table as they are read.
    """
    folder = scratch_path(w.spark, "star")
    orders = _order_grain(w, scratch_path(w.spark, "grains"))
    tables = _star_of(w, orders, _grain_items(w, ITEM_KEY), stored=False)
    star.write_star(tables, folder, STAR_KEYS | {"order_items": ITEM_KEY}, stage=False, only_sold=True)
    return folder


def _again(w: Warehouse, path: str, frame: DataFrame) -> DataFrame:
    """A frame written and read back."""
    frame.write.parquet(path)
    return w.spark.read.schema(frame.schema).parquet(path)


def _order_grain(w: Warehouse, path: str) -> DataFrame:
    """The order frame, written and read back. Orders meet their lines' totals before their
    customers, so that no name is moved by order.
    """
    buyers = w.customers().join(w.locations(), "location_id").drop("location_id")
    orders = w.orders("order_id", *star.HEADER_COLUMNS).join(buyers, "customer_id")
    columns = ["order_id", "state", "region", "customer_name", "segment", *star.HEADER_COLUMNS]
    return _again(w, f"{path}/orders", orders.select(*columns))


def _grain_items(w: Warehouse, key: list[str]) -> DataFrame:
    return w.lines(*dict.fromkeys([*key, "product_id", "sales", "quantity", "discount", "profit"]))


def _two_grains(w: Warehouse, key: list[str], **parts: Column) -> tuple[DataFrame, DataFrame]:
    """The order frame and the items, written and read back. ``parts`` are conditions on orders:
    the items get a column for each, whether their order meets it.
    """
    path = scratch_path(w.spark, "grains")
    orders, items = _order_grain(w, path), _grain_items(w, key)
    if parts:
        items = items.join(orders.groupBy("order_id").agg(*[
            F.coalesce(F.max(met), F.lit(False)).alias(part) for part, met in parts.items()]), "order_id")
    return orders, _again(w, f"{path}/items", items)


def _star_of(w: Warehouse, orders: DataFrame, lines: DataFrame, stored: bool = True) -> dict[str, DataFrame]:
    """The tables of some orders and their lines; a product is stored with its first sale. Lines
    that are not ``stored`` are read only for the items: all products are given then.
    """
    # Stored, so that their size is known when headers look them up: few are broadcast.
    path = scratch_path(w.spark, "places")
    star.dim_locations(orders).write.parquet(path)
    locations = w.spark.read.parquet(path)
    products = star.sold_products(w.products(), lines) if stored else w.products()
    return {
        "locations": locations,
        "customers": star.dim_customers(orders),
        "products": star.dim_products(products),
        "orders": star.order_headers(orders, locations),
        "order_items": star.fact_order_items(lines, ITEM_KEY),
    }


#: Lines have no key of their own in these tables; whole items are told apart.
WHOLE_ITEM = [*ITEM_KEY, "product_id", "sales", "quantity", "discount", "profit"]


def _loaded_batches(w: Warehouse) -> str:
    """The star loaded in two batches: the orders before 1998 of states before K, then the
    others and, once more, all of 1997; after that the first batch is replayed.
    """
    folder = scratch_path(w.spark, "batches")
    keys = STAR_KEYS | {"order_items": WHOLE_ITEM}
    early = (F.col("order_date") < F.lit(date(1998, 1, 1))) & (F.col("state") < "K")
    late = ~early | (F.col("order_date") >= F.lit(date(1997, 1, 1)))
    # Dealt to the batches once, not looked up by order for each.
    orders, lines = _two_grains(w, WHOLE_ITEM, early=early, late=late)

    def part(batch: int) -> None:
        some = orders.filter(early if batch == 0 else late)
        own = lines.filter("early" if batch == 0 else "late")
        star.load_star(_star_of(w, some, own), folder, keys, batch, stage=False)

    for batch in (0, 1, 0):
        part(batch)
    return folder


def _order_headers(w: Warehouse) -> DataFrame:
    """Headers with the place their location id points to."""
    places = star.dim_locations(w.locations())
    return _loaded_star(w)["orders"].join(places, "location_id").drop("location_id")


RAW_TEST_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADINGS.values()])


def _raw_csv(w: Warehouse) -> DataFrame:
    """The raw export written as Latin-1 CSV and scanned back."""
    path = scratch_path(w.spark, "raw-csv")
    raw_lines(w).write.option("header", True).option("encoding", "ISO-8859-1").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    scanned = quality.normalize_columns(files.scan_raw_csv(w.spark, path, RAW_TEST_SCHEMA))
    whole = ("order_id", "line_number", "customer_id", "product_id")
    return quality.parse_numbers(scanned).withColumns({c: F.col(c).cast("long") for c in whole})


def _clean_table(w: Warehouse, fmt: str) -> DataFrame:
    """The clean table written and scanned back."""
    path = scratch_path(w.spark, f"clean-{fmt}")
    clean = _clean_lines(w)
    files.write_clean(clean, path, fmt)
    return files.scan_clean(w.spark, path, clean.schema, fmt)


QUERIES |= {
    "order_lines": lambda w: w.lines(),
    "dim_locations": lambda w: _loaded_star(w)["locations"].drop("location_id"),
    "dim_customers": lambda w: _loaded_star(w)["customers"],
    "dim_products": lambda w: _loaded_star(w)["products"],
    "order_headers": _order_headers,
    "fact_order_items": lambda w: _loaded_star(w)["order_items"],
    "append_new_rows": _new_customers,
    "append_stored": _stored_customers,
    "load_audit": lambda w: star.load_audit(star.scan_star(w.spark, _stored_star(w))),
    "scan_star_view": lambda w: star.star_view(
        star.scan_star(w.spark, _stored_star(w), with_year=True)).select(*LINE_COLUMNS),
    "scan_star_filtered": lambda w: star.scan_lines(w.spark, _stored_star(w), SELECTION).select(*LINE_COLUMNS),
    "load_batches": lambda w: star.star_view(
        star.scan_star(w.spark, _loaded_batches(w), with_year=True)).select(*LINE_COLUMNS),
    "batch_audit": lambda w: star.batch_audit(w.spark, _loaded_batches(w)),
    "place_ids": lambda w: star.scan_star(w.spark, _loaded_batches(w))["locations"],
    "scan_raw_csv": _raw_csv,
    "clean_and_report": lambda w: files.clean_and_report(
        resent_lines(w), scratch_path(w.spark, "clean-reported")),
    "write_clean": lambda w: _clean_table(w, "parquet"),
    "scan_clean": lambda w: _clean_table(w, "csv"),
}
