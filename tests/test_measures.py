"""Rounding, ratios and the integer money arithmetic against Python decimals."""

import random
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from orderlens.functions.measures import discount_band, percent, present, ratio
from orderlens.sources.warehouse import Warehouse


def half_up(value, places):
    return value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def test_ratios_round_half_up_exactly(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-10**6, 10**6), rng.choice((1, 3, 8, 16, 400, 20_000, 999_983)))
             for _ in range(2_000)] + [(5, 0), (0, 7), (1, 20_000), (3, 20_000)]
    frame = spark.createDataFrame(pairs, "a BIGINT, b BIGINT").select(
        "a", "b", ratio(F.col("a"), F.col("b")).alias("r"),
        percent(F.col("a"), F.col("b"), 3).alias("p"))
    for row in frame.collect():
        if row.b == 0:
            assert row.r is None and row.p is None
        else:
            assert row.r == half_up(Decimal(row.a) / row.b, 2)
            assert row.p == half_up(Decimal(100 * row.a) / row.b, 3)


def test_money_is_exact(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 10**9), rng.randint(0, 100), rng.randint(1, 10**6 - 1) % 50 + 1, i % 7)
            for i in range(3_000)]
    prices = [rng.randint(1, 999_999) for _ in range(7)]

    def save(name, **columns):
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")

    save("lineitem", l_orderkey=[r[0] % 11 for r in rows], l_partkey=[r[3] for r in rows],
         l_suppkey=[0] * len(rows), l_linenumber=pa.array(range(len(rows)), pa.int32()),
         l_quantity=[float(r[2]) for r in rows], l_extendedprice=[r[0] / 100 for r in rows],
         l_discount=[r[1] / 100 for r in rows])
    save("part", p_partkey=list(range(7)), p_name=["x"] * 7, p_brand=["x"] * 7, p_type=["x"] * 7,
         p_size=pa.array([1] * 7, pa.int32()), p_retailprice=[p / 100 for p in prices])

    save("orders", o_orderkey=list(range(11)), o_custkey=[1] * 11, o_orderstatus=["F"] * 11,
         o_totalprice=[0.0] * 11, o_orderdate=[datetime(2024, 1, 1)] * 11, o_orderpriority=["x"] * 11)
    save("customer", c_custkey=[1], c_name=["x"], c_nationkey=pa.array([1], pa.int32()),
         c_acctbal=[0.0], c_mktsegment=["x"])
    save("nation", n_nationkey=pa.array([1], pa.int32()), n_name=["x"],
         n_regionkey=pa.array([1], pa.int32()))
    save("region", r_regionkey=pa.array([1], pa.int32()), r_name=["x"])

    w = Warehouse(spark, str(tmp_path))
    cent = Decimal("0.01")
    expected, per_order = {}, {}
    for i, (price, off, quantity, part) in enumerate(rows):
        sales = price * cent * (1 - off * cent)
        profit = sales - Decimal("0.8") * prices[part] * cent * quantity
        expected[i] = (sales, profit, off * cent)
        total = per_order.setdefault(price % 11, [Decimal(0)] * 3)
        per_order[price % 11] = [t + v for t, v in zip(total, expected[i])]
    got = {r.line_number: (r.sales, r.profit, r.discount)
           for r in w.lines("line_number", "sales", "profit", "discount").collect()}
    assert got == expected
    sums = {r.order_id: [r.sum_sales, r.sum_profit, r.sum_discount] for r in w.orders(
        "order_id", "sum_sales", "sum_profit", "sum_discount").collect()}
    assert sums == per_order


def test_bands_follow_their_edges(spark):
    frame = spark.sql("SELECT CAST(x AS DECIMAL(4,2)) AS d FROM VALUES (0), (0.04), (0.05), (0.5) t(x)")
    labels = [r[0] for r in frame.select(discount_band(F.col("d"), ("0.04", "0.08", "0.1"))).collect()]
    assert labels == ["0% (no discount)", "1-4%", "5-8%", "11%+"]


def test_output_types(spark):
    frame = present(spark.sql("SELECT 1 AS a, CAST(1 AS DECIMAL(9,2)) AS b, 'x' AS c, 1L AS d"))
    assert dict(frame.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"}
