"""Order lines over the base tables of one folder.

The tables are read as a star: ``lineitem`` holds the items, ``orders`` the
headers, ``customer``/``nation``/``region`` the buyer and place, ``part`` the
product. Every frame is built from the columns a question asks for.

All questions share one population: the lines whose product, order, customer, nation
and region exist. A table that serves columns is joined. One that only decides the
population is not read: the gate of the folder (``sources/gate.py``) knows the few keys
without a parent, and these are left out. A warehouse without a gate asks such a table for
its keys, as a semi join. ``quality.constraint_violations`` counts what falls outside.

Money is computed in whole ten-thousandths and turned into a decimal once, which
is exact and avoids decimal arithmetic per row. Schemas are declared, so opening a
table reads no footer.

No join is hinted: Spark broadcasts a side whose size it knows to be below its
threshold and sort-merges otherwise, with hot keys split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderlens.functions.measures import count_where
from orderlens.operators import moments
from orderlens.operators.filters import NO_FILTERS, Filters, keep
from orderlens.schema import MONEY, RATE
from orderlens.session import set_folder
from orderlens.sources.gate import Gate, open_gate

ITEM = ["order_id", "line_number", "product_id", "sales", "quantity", "discount",
        "line_ship_date"]
COST = ["profit", "is_loss_line"]
PRODUCT = ["product_name", "category", "sub_category"]
HEADER = ["order_date", "ship_mode", "customer_id", "order_status"]
SHIPPING = ["ship_date", "delivery_days"]
CUSTOMER = ["customer_name", "segment"]
LOCATION = ["state", "region"]

LINE_COLUMNS = [
    "order_id", "line_number", "order_date", "ship_date", "delivery_days", "ship_mode",
    "customer_id", "customer_name", "segment", "state", "region", "product_id",
    "product_name", "category", "sub_category", "sales", "quantity", "discount",
    "profit", "is_loss_line",
]

# Fixed value: percent of the retail price that counts as cost.
COST_PERCENT = 80

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def _hundredths(column: str) -> str:
    """A price or rate with two decimals as a whole number."""
    return f"floor({column} * 100 + 0.5D)"


def _decimal(units: str, kind: DecimalType) -> str:
    """Whole units back to a decimal; a value too large for the type fails."""
    unit = f"0.{1:0{kind.scale}d}BD"
    return f"CAST(CAST({units} AS DECIMAL(14,0)) * {unit} AS {kind.simpleString()})"


# What a line sells for, in ten-thousandths.
SALES_UNITS = f"({_hundredths('l_extendedprice')} * (100 - {_hundredths('l_discount')}))"

MEASURES = ["n_lines", "sum_sales", "sum_profit", "n_loss_lines", "sum_discount"]


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, gate: Gate | None = None):
        self.spark = spark
        self.path = path
        self.gate = gate

    @classmethod
    def gated(cls, spark: SparkSession, path: str) -> Warehouse:
        """A warehouse that leaves out the keys its gate knows. The gate is made when the
        tables are first opened in this state, which takes one pass over their key columns. A
        session that names no shared folder can keep none: there the tables are joined.
        """
        if not set_folder(spark):
            return cls(spark, path)
        return cls(spark, path, open_gate(spark, path, cls(spark, path).table))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}.parquet")

    # -- star tables ---------------------------------------------------------

    def items(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS line_number",
            "l_partkey AS product_id",
            f"{SALES_UNITS} AS sales_units",
            f"{_decimal(SALES_UNITS, MONEY)} AS sales",
            "CAST(l_quantity AS INT) AS quantity",
            f"{_hundredths('l_discount')} AS discount_units",
            f"{_decimal(_hundredths('l_discount'), RATE)} AS discount",
            "CAST(l_shipdate AS DATE) AS line_ship_date",
            "l_extendedprice AS stored_price", "l_discount AS stored_discount",
            "l_quantity AS stored_quantity",
        )

    def products(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS category",
            "p_brand AS sub_category",
            f"{_hundredths('p_retailprice')} * {COST_PERCENT} AS cost_units",
            "p_retailprice AS retail_price",
        )

    def customers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS customer_id", "c_name AS customer_name",
            "c_mktsegment AS segment", "c_nationkey AS location_id")

    def locations(self) -> DataFrame:
        nation = self.table("nation").selectExpr(
            "n_nationkey AS location_id", "n_name AS state", "n_regionkey AS region_id")
        return nation.join(self.regions(), "region_id").select("location_id", "state", "region")

    def regions(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey AS region_id", "r_name AS region")

    def base_headers(self) -> DataFrame:
        """The order headers as stored, whether or not their customer exists."""
        return self.table("orders").selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id",
            "CAST(o_orderdate AS DATE) AS order_date",
            "o_orderpriority AS ship_mode", "o_orderstatus AS order_status")

    def headers(self, columns: list[str]) -> DataFrame:
        """order_id plus the order-constant ``columns``, except the shipping dates, of the
        orders whose customer has a known place.
        """
        place = any(c in LOCATION for c in columns)
        headers, customers = self.base_headers(), self.customers()
        if place:
            customers = customers.join(self.locations(), "location_id")
        elif self.gate:
            headers = self.gate.keep(headers, "order_customer", "customer_id")
        else:
            customers = customers.join(self.locations().select("location_id"), "location_id", "left_semi")
        if place or any(c in CUSTOMER for c in columns):
            frame = headers.join(customers, "customer_id")
        elif self.gate:
            frame = headers
        else:
            frame = headers.join(customers.select("customer_id"), "customer_id", "left_semi")
        return frame.select("order_id", *[c for c in columns if c != "order_id"])

    # -- line grain ----------------------------------------------------------

    def lines(self, *columns: str, filters: Filters = NO_FILTERS) -> DataFrame:
        """One row per order line with exactly ``columns`` (default: all)."""
        wanted = list(columns) or LINE_COLUMNS
        line_cond = filters.line_conditions()
        needed = list(dict.fromkeys(
            wanted + (filters.line_columns() if line_cond else [])))
        items = self.known_items(any(c in PRODUCT + COST for c in needed))
        frame = keep(items, line_cond)
        header = [c for c in needed if c in HEADER + CUSTOMER + LOCATION]
        ships = any(c in SHIPPING for c in needed)
        extra = filters.order_columns() + (["order_date"] if ships else [])
        columns_needed = list(dict.fromkeys(header + extra))
        orders = keep(self.headers(columns_needed), filters.order_conditions())
        if ships:
            shipped = self.known_items(False)
            if filters.order_columns():
                shipped = shipped.join(orders.select("order_id"), "order_id", "left_semi")
            orders = orders.join(_shipping(shipped), "order_id").withColumns(_shipping_columns())
        return self.of_known_orders(frame, orders, bool(columns_needed)).select(*wanted)

    def of_known_orders(self, frame: DataFrame, orders: DataFrame, with_columns: bool) -> DataFrame:
        """Lines or order totals of existing orders, joined to them or only checked."""
        if not with_columns and self.gate:
            return self.gate.keep(frame, "line_order", "order_id")
        return frame.join(orders, "order_id", "inner" if with_columns else "left_semi")

    def known_items(self, with_products: bool) -> DataFrame:
        """Items of existing products, joined to them or only checked against them."""
        if not with_products and self.gate:
            return self.gate.keep(self.items(), "line_product", "product_id")
        if not with_products:
            known = self.table("part").selectExpr("p_partkey AS product_id")
            return self.items().join(known, "product_id", "left_semi")
        joined = self.items().join(self.products(), "product_id")
        units = "(sales_units - cost_units * quantity)"
        return joined.selectExpr(
            "*", f"{units} AS profit_units", f"{_decimal(units, MONEY)} AS profit",
            f"coalesce({units} < 0, false) AS is_loss_line")

    # -- order grain ---------------------------------------------------------

    def orders(self, *columns: str, by: tuple[str, ...] = (),
               filters: Filters = NO_FILTERS) -> DataFrame:
        """One row per order that has lines, with exactly ``columns``.

        ``by`` splits orders into parts by product attributes, which become columns
        too: one row per order and, say, sub-category.

        Same result as ``rollup.order_rollup(self.lines(...))`` or, with ``by``,
        ``rollup.order_parts``, but lines are summed per order before any order attribute is joined: headers meet one
        row per order instead of one per line, and a hot order has already been
        folded by the map-side combine.
        """
        wanted = list(columns)
        measures = [c for c in wanted if c in MEASURES]
        header = [c for c in wanted if c in HEADER + CUSTOMER + LOCATION]
        ships = any(c in SHIPPING for c in wanted)
        if ships and by:
            raise ValueError("the shipping dates belong to the order, not to its parts")

        items = self.known_items(bool(by or filters.categories) or any(
            m in ("sum_profit", "n_loss_lines") for m in measures))
        extra = filters.order_columns() + (["order_date"] if ships else [])
        needed = list(dict.fromkeys(header + extra))
        headers = keep(self.headers(needed), filters.order_conditions())
        if filters.order_columns():
            items = items.join(headers.select("order_id"), "order_id", "left_semi")
        kept = None
        if filters.categories:
            if ships:
                # The ship date belongs to the whole order, so lines outside the
                # filter still count for it and only their measures are left out.
                kept = F.col("category").isin(*filters.categories)
            else:
                items = keep(items, filters.line_conditions())
        totals = _order_totals(items, by, measures, ships, kept)
        totals = self.of_known_orders(totals, headers, bool(needed))
        if ships:
            totals = totals.withColumns(_shipping_columns())
        return totals.select(*wanted, *by)


    def order_moments(self) -> DataFrame:
        """Sums and products of sales, quantity, discount, profit and delivery days per order, in
        whole units, from one pass over the lines: see ``operators/moments.py``.
        """
        line_columns = ["sales", "quantity", "discount", "profit"]
        items = self.known_items(True).selectExpr(
            "order_id", "sales_units AS sales", "quantity", "discount_units AS discount",
            "profit_units AS profit", "line_ship_date")
        sums = moments.line_sums(items, ["order_id"], line_columns, [F.max("line_ship_date").alias("shipped")])
        # An order has a row per pattern of missing values, so one as a rule.
        whole = Window.partitionBy("order_id")
        sums = sums.withColumn("ship_date", F.max("shipped").over(whole))
        headers = self.headers(["order_date"])
        placed = sums.join(headers, "order_id").withColumns(_shipping_columns())
        return moments.with_order_column(placed, line_columns, "delivery_days")

    def priced(self, lines: DataFrame) -> DataFrame:
        """Lines that hold product_id, sales and quantity, joined to their product and with
        the profit.
        """
        units = "(cast(sales * 10000 as bigint) - cost_units * quantity)"
        return lines.join(self.products(), "product_id").selectExpr(
            *lines.columns, *PRODUCT, f"{_decimal(units, MONEY)} AS profit")


def _shipping(items: DataFrame) -> DataFrame:
    """Day the last line of each order shipped. Aggregated before it is joined,
    so that an order with very many lines never has to fit one task's window.
    """
    return items.groupBy("order_id").agg(F.max("line_ship_date").alias("ship_date"))


def _shipping_columns() -> dict[str, Column]:
    return {"delivery_days": F.date_diff("ship_date", "order_date")}


def _order_totals(items: DataFrame, by: tuple[str, ...], measures: list[str], ships: bool,
                  kept: Column | None) -> DataFrame:
    """Lines summed per order and ``by``; ``kept`` leaves the measures of other lines out.

    Money is added as whole units and fractions, each in 64 bits, and put together
    per order: exact like a decimal sum, at the cost of an integer one. The whole
    part overflows, and then fails, only beyond 9e18.
    """
    def total(expression: str) -> Column:
        value = F.expr(expression)
        return F.sum(value if kept is None else F.when(kept, value))

    count = F.count(F.lit(1)) if kept is None else F.count(F.when(kept, 1))
    loss = F.col("is_loss_line") if kept is None else F.col("is_loss_line") & kept
    build = {
        "n_lines": {"n_lines": count},
        "sum_sales": {"sales_whole": total("sales_units div 10000"),
                      "sales_rest": total("sales_units % 10000")},
        "sum_profit": {"profit_whole": total("profit_units div 10000"),
                       "profit_rest": total("profit_units % 10000")},
        "n_loss_lines": {"n_loss_lines": count_where(loss)},
        "sum_discount": {"discount_units": total("discount_units")},
    }
    finish = {
        "sum_sales": _money("sales_whole", "sales_rest"),
        "sum_profit": _money("profit_whole", "profit_rest"),
        "sum_discount": "CAST(CAST(discount_units AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(20,2))",
    }
    wanted = list(measures)
    if "n_lines" not in wanted and (kept is not None or not (wanted or ships)):
        wanted.append("n_lines")
    aggregates = {name: column for m in wanted for name, column in build[m].items()}
    if ships:
        aggregates["ship_date"] = F.max("line_ship_date")
    totals = items.groupBy("order_id", *by).agg(*[c.alias(name) for name, c in aggregates.items()])
    if kept is not None:
        totals = totals.filter(F.col("n_lines") > 0)
    dates = ["ship_date"] if ships else []
    return totals.selectExpr("order_id", *by, *dates, *[f"{finish.get(m, m)} AS {m}" for m in wanted])


def _money(whole: str, rest: str) -> str:
    return (f"CAST(CAST({whole} AS DECIMAL(20,0)) + CAST({rest} AS DECIMAL(18,0)) * 0.0001BD "
            "AS DECIMAL(24,4))")
