"""Parts that add up: moments, several rollups in one pass, sketches, the stored order frame."""

from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens import catalog
from orderlens.operators import commerce, cube, moments, profile, rollup, sketches
from orderlens.plans import order_frame
from orderlens.sources.warehouse import Warehouse

SF_DIR = "/root/testdata/sf0.001"


def cells(frame):
    return {(r.column_x, r.column_y): r.correlation for r in frame.collect()}


@pytest.mark.parametrize("offset", [0, 10 ** 9])
def test_correlations_with_missing_values(spark, offset):
    """A mean a thousand million times the spread costs no digit."""
    rng = np.random.default_rng(1)
    rows = [(int(k % 7), None if k % 5 == 0 else offset + int(rng.integers(0, 9)),
             None if k % 4 == 0 else offset + int(rng.integers(0, 9)) + k % 3, None if k % 7 == 3 else k % 7)
            for k in range(400)]
    frame = spark.createDataFrame(rows, "o long, a long, b long, d long")
    sums = moments.line_sums(frame, ["o"], ["a", "b"], [F.min("d").alias("d")], dict.fromkeys("ab", offset))
    got = cells(moments.correlations(moments.with_order_column(sums, ["a", "b"], "d"), ["a", "b", "d"]))
    data = {c: np.array([np.nan if r[i + 1] is None else r[i + 1] - (offset if c != "d" else 0) for r in rows])
            for i, c in enumerate("abd")}
    for x in "abd":
        for y in "abd":
            both = ~np.isnan(data[x]) & ~np.isnan(data[y])
            assert got[x, y] == pytest.approx(np.corrcoef(data[x][both], data[y][both])[0, 1], abs=1.1e-6)


def test_correlations_of_constant_columns_are_null(spark):
    frame = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 5, None)], "o long, a long, b long")
    got = cells(moments.correlations(moments.line_sums(frame, ["o"], ["a", "b"]), ["a", "b"]))
    assert got["a", "a"] is None and got["a", "b"] is None and got["b", "b"] == 1.0
    one = cells(moments.correlations(moments.line_sums(frame.limit(1), ["o"], ["a", "b"]), ["a", "b"]))
    none = cells(moments.correlations(moments.line_sums(frame.limit(0), ["o"], ["a", "b"]), ["a", "b"]))
    assert set(one.values()) == {None} and set(none.values()) <= {None}


def test_moments_of_orders_equal_the_lines(spark):
    w = Warehouse.gated(spark, SF_DIR)
    columns = ["sales", "quantity", "discount", "profit", "delivery_days"]
    assert cells(moments.correlations(w.order_moments(), columns)) == cells(
        profile.correlation_matrix(w.lines(*columns)))


def rows(frame):
    return sorted((tuple(sorted(r.asDict().items())) for r in frame.collect()), key=repr)


def test_one_pass_gives_the_separate_rollups(spark):
    w = Warehouse.gated(spark, SF_DIR)
    parts = w.orders("order_id", *cube.ORDER_KEYS, *cube.MEASURES, by=(*cube.PRODUCT_KEYS, "discount"))
    together = cube.rollups(parts, catalog.BANDS).cache()
    for key in cube.ORDER_KEYS:
        want = rollup.revenue_by_order_attribute(w.orders(key, "sum_sales", "sum_profit"), key)
        assert rows(cube.revenue_of(together, key)) == rows(want)
    for key in cube.PRODUCT_KEYS:
        want = rollup.revenue_by_order_attribute(w.orders("sum_sales", "sum_profit", by=(key,)), key)
        assert rows(cube.revenue_of(together, key)) == rows(want)
    for keys in ((), ("segment",)):
        want = commerce.loss_by_discount_band(
            w.orders(*keys, "n_lines", "n_loss_lines", "sum_profit", by=("discount",)), *keys, edges=catalog.BANDS)
        assert rows(cube.bands_of(together, bool(keys))) == rows(want)
    together.unpersist()


def test_a_missing_key_is_a_group_of_its_own(spark):
    schema = ("order_id long, category string, sub_category string, segment string, region string, state string, "
              "ship_mode string, discount decimal(4,2), n_lines long, n_loss_lines long, sum_sales decimal(24,4), "
              "sum_profit decimal(24,4)")
    ten = Decimal(10)
    parts = spark.createDataFrame([(1, None, "a", "s", None, "x", "m", Decimal("0.1"), 2, 1, ten, -ten),
                                   (1, "c", "b", "s", None, "x", "m", Decimal("0.1"), 1, 0, ten, ten)], schema)
    found = {(r.grouping, r.key, r.discount_band is None): (r.total_orders, r.total_line_items)
             for r in cube.rollups(parts).collect()}
    assert found["category", None, True] == (1, 2) and found["category", "c", True] == (1, 1)
    assert found["region", None, True] == (1, 3) and found["state", "x", True] == (1, 3)
    assert found["segment, discount_band", "s", False] == (1, 3) and found["discount_band", None, False] == (1, 3)


def days(spark, n=20_000):
    return spark.range(n).selectExpr(
        "date_add(DATE '2020-01-01', cast(id % 700 as int)) AS day", "id % 4321 AS who",
        "CASE WHEN id % 11 > 0 THEN exp(pmod(xxhash64(id), 1000) / 50.0) END AS amount")


def test_a_year_of_states_is_the_merge_of_its_days(spark, tmp_path):
    frame = days(spark)
    path = str(tmp_path / "states")
    sketches.write_states(sketches.daily_distinct(frame, "day", ["who"]), path)
    stored = spark.read.parquet(path)
    year = F.year("day").alias("y")
    merged = {r.y: r.estimate for r in sketches.distinct_of(stored, year).collect()}
    at_once = {r.y: r.estimate for r in frame.groupBy(year).agg(F.hll_sketch_estimate(
        F.hll_sketch_agg(F.col("who").cast("string"), sketches.LG_K)).alias("estimate")).collect()}
    exact = {r.y: r.n for r in frame.groupBy(year).agg(F.count_distinct("who").alias("n")).collect()}
    for y in exact:
        assert merged[y] == pytest.approx(at_once[y], rel=0.02)
        assert abs(merged[y] - exact[y]) <= 4 * 1.04 / 64 * exact[y]
    # A day that is stored again adds nothing to a distinct count.
    sketches.write_states(sketches.daily_distinct(frame.limit(2000), "day", ["who"]), path)
    again = {r.y: r.estimate for r in sketches.distinct_of(spark.read.parquet(path), year).collect()}
    assert again == pytest.approx(merged, rel=0.02)


def test_spans_read_only_their_years(spark, tmp_path):
    path = str(tmp_path / "states")
    sketches.write_states(sketches.daily_distinct(days(spark, 3000), "day", ["who"]), path)
    span = sketches.between(spark.read.parquet(path).filter("year = 2021"), date(2021, 2, 1), date(2021, 2, 10))
    assert span.count() == 10
    assert "PartitionFilters: [isnotnull(year" in span._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_within_their_rank_error(spark):
    frame = days(spark)
    states = sketches.daily_quantiles(frame, "day", "amount")
    found = {r.share: r.value for r in sketches.quantiles_of(states, [0.1, 0.5, 0.75, 0.99]).collect()}
    values = np.sort([r.amount for r in frame.filter("amount IS NOT NULL").collect()])
    for share, value in found.items():
        low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        assert low / len(values) - 0.02 <= share <= high / len(values) + 0.02


LINE = ("order_id string, order_date date, ship_mode string, customer_id string, segment string, state string, "
        "region string, ship_date date, sales decimal(14,4), profit decimal(14,4), discount decimal(4,2)")


def order_lines(spark, numbers, shift=0):
    return spark.createDataFrame([
        (f"O{k:03}", date(2015 + k % 4, 1 + k % 12, 3), "m", f"c{k % 5}", "s", f"st{k % 6}", "r",
         date(2015 + k % 4, 1 + k % 12, 5 + shift), Decimal(k + shift), Decimal(k % 3 - 1), Decimal("0.1")) for k in numbers], LINE)


def frame_rows(spark, path):
    columns = ["order_id", *order_frame.ATTRIBUTES, "ship_date", *order_frame.SUMS, "delivery_days"]
    return sorted(map(tuple, order_frame.scan(spark, path).select(*columns).collect()))


def test_a_refreshed_frame_equals_one_built_at_once(spark, tmp_path):
    batches = [order_lines(spark, range(40)), order_lines(spark, range(30, 60), 2), order_lines(spark, [3, 3, 7], 4)]
    for number, lines in enumerate(batches):
        order_frame.refresh(lines, f"{tmp_path}/steps", str(number))
    whole = batches[0].unionAll(batches[1]).unionAll(batches[2])
    order_frame.refresh(whole, f"{tmp_path}/once", "all")
    assert frame_rows(spark, f"{tmp_path}/steps") == frame_rows(spark, f"{tmp_path}/once")
    assert len(frame_rows(spark, f"{tmp_path}/steps")) == 60


def test_only_touched_years_are_written(spark, tmp_path):
    path = str(tmp_path)
    order_frame.refresh(order_lines(spark, range(40)), path, "a")
    before = order_frame.current(spark, path)["years"]
    assert order_frame.refresh(order_lines(spark, [4, 8], 3), path, "late") == ["2015"]
    after = order_frame.current(spark, path)["years"]
    assert {y for y in after if after[y] != before[y]} == {"2015"}
    assert order_frame.clean_up(spark, path) == 1 and len(frame_rows(spark, path)) == 40


def test_a_replayed_batch_is_not_added_twice(spark, tmp_path):
    path = str(tmp_path)
    for name in ("a", "b", "a", "b"):
        order_frame.refresh(order_lines(spark, range(10 if name == "a" else 20)), path, name)
    assert sum(r[8] for r in frame_rows(spark, path)) == 30


def test_a_killed_refresh_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    order_frame.refresh(order_lines(spark, range(10)), path, "a")
    before = frame_rows(spark, path)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(order_frame, "_mark", killed)
    with pytest.raises(RuntimeError, match="killed"):
        order_frame.refresh(order_lines(spark, range(20)), path, "b")
    assert frame_rows(spark, path) == before
    monkeypatch.undo()
    order_frame.refresh(order_lines(spark, range(20)), path, "b")
    assert sum(r[8] for r in frame_rows(spark, path)) == 30


def test_a_late_line_with_another_date_stays_with_its_order(spark, tmp_path):
    path = str(tmp_path)
    order_frame.refresh(order_lines(spark, [4]), path, "a")
    late = order_lines(spark, [4], 9).withColumn("order_date", F.lit(date(2030, 1, 1)))
    assert order_frame.refresh(late, path, "b") == ["2015"]
    (row,) = frame_rows(spark, path)
    assert row[1].year == 2015 and row[8] == 2 and row[7].day == 14
