"""The stored star: layout by order, loads in batches, replays, and what a load reads."""

import glob
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from orderlens.operators.filters import Filters
from orderlens.operators.quality import clean
from orderlens.sources import star


def plan_of(frame):
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return frame._jdf.queryExecution().executedPlan().toString()


def orders_of(raw, numbers, **columns):
    """Clean lines, two of each order, from 2014 on with the order's number."""
    rows = []
    for k in numbers:
        for j in range(2):
            rows.append({"Row ID": 2 * k + j, "Order ID": f"O-{k:04}", "Order Date": f"1/{k % 28 + 1}/{2014 + k % 4}",
                         "Ship Date": f"2/{k % 28 + 1}/{2014 + k % 4}", "State": f"S{k % 7}", "City": f"C{k % 11}",
                         "Customer ID": f"U-{k % 13:02}", "Product ID": f"P-{j}-{k % 5}"} | columns)
    return clean(raw(*rows))


def contents(spark, folder):
    return {t: sorted(map(repr, f.collect())) for t, f in star.scan_star(spark, folder, with_year=True).items()}


def test_batches_add_up_to_one_load(raw, spark, tmp_path):
    first, second = orders_of(raw, range(30)), orders_of(raw, range(20, 50))
    for number, lines in enumerate((first, second)):
        assert star.load_star(star.build_star(lines), f"{tmp_path}/two") == number
    star.load_star(star.build_star(first.unionByName(second).distinct()), f"{tmp_path}/one")
    views = [star.star_view(star.scan_star(spark, f"{tmp_path}/{d}", with_year=True)) for d in ("one", "two")]
    assert sorted(map(tuple, views[0].collect())) == sorted(map(tuple, views[1].collect()))
    assert views[0].count() == 100


def test_ids_are_dense_and_kept(raw, spark, tmp_path):
    star.load_star(star.build_star(orders_of(raw, range(5))), str(tmp_path))
    before = {r.location_id: tuple(r) for r in star.scan_star(spark, str(tmp_path))["locations"].collect()}
    star.load_star(star.build_star(orders_of(raw, range(3, 40))), str(tmp_path))
    after = {r.location_id: tuple(r) for r in star.scan_star(spark, str(tmp_path))["locations"].collect()}
    assert sorted(before) == list(range(1, len(before) + 1))
    assert sorted(after) == list(range(1, len(after) + 1)) and len(after) > len(before)
    assert {k: after[k] for k in before} == before


def test_numbers_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(3000).selectExpr("cast(id % 1000 as string) AS city", "CASE WHEN id % 3 > 0 THEN id % 3 END AS postal_code")
    rows = rows.distinct()
    ids = [{(r.city, r.postal_code): r.location_id for r in star.dense_ids(
        rows.repartition(n), ["city", "postal_code"], "location_id", 10).collect()} for n in (1, 7)]
    assert ids[0] == ids[1] and sorted(ids[0].values()) == list(range(11, 11 + rows.count()))


def test_replays_change_nothing(raw, spark, tmp_path):
    batches = [star.build_star(orders_of(raw, r)) for r in (range(20), range(10, 30), range(25, 40))]
    for number, batch in enumerate(batches):
        star.load_star(batch, str(tmp_path), batch=number)
    before = contents(spark, str(tmp_path))
    audit = sorted(map(tuple, star.batch_audit(spark, str(tmp_path)).collect()))
    for number in (1, 0, 2, 2):
        star.load_star(batches[number], str(tmp_path), batch=number)
        assert contents(spark, str(tmp_path)) == before
    assert sorted(map(tuple, star.batch_audit(spark, str(tmp_path)).collect())) == audit
    assert ("orders", 0, 20) in audit and ("orders", 1, 10) in audit and ("orders", 2, 10) in audit


@pytest.mark.parametrize("killed_at", ["customers", "orders", "order_items"])
def test_a_load_killed_between_tables_is_not_seen_and_can_be_replayed(raw, spark, tmp_path, monkeypatch, killed_at):
    first, second = star.build_star(orders_of(raw, range(10))), star.build_star(orders_of(raw, range(5, 20)))
    star.load_star(first, str(tmp_path))
    before = contents(spark, str(tmp_path))
    write = star.write_batch

    def killed(rows, folder, table, *more):
        if table == killed_at:
            raise RuntimeError("killed")
        write(rows, folder, table, *more)

    monkeypatch.setattr(star, "write_batch", killed)
    with pytest.raises(RuntimeError, match="killed"):
        star.load_star(second, str(tmp_path))
    assert contents(spark, str(tmp_path)) == before
    monkeypatch.undo()
    assert star.load_star(second, str(tmp_path)) == 1
    star.load_star(first, f"{tmp_path}/whole")
    star.load_star(second, f"{tmp_path}/whole")
    assert contents(spark, str(tmp_path)) == contents(spark, f"{tmp_path}/whole")


def test_a_batch_before_loaded_ones_is_refused(raw, spark, tmp_path):
    lines = star.build_star(orders_of(raw, range(3)))
    star.load_star(lines, str(tmp_path), batch=5)
    with pytest.raises(ValueError, match="batch 4"):
        star.load_star(lines, str(tmp_path), batch=4)


def test_late_lines_lie_with_their_order(raw, spark, tmp_path):
    """A line that comes in a later batch, with another date than the stored header's."""
    star.load_star(star.build_star(orders_of(raw, [3])), str(tmp_path))
    late = clean(raw({"Row ID": 99, "Order ID": "O-0003", "Order Date": "5/5/2020", "Ship Date": "5/6/2020"}))
    star.load_star(star.build_star(late), str(tmp_path))
    view = star.star_view(star.scan_star(spark, str(tmp_path), with_year=True)).filter("row_id = 99").collect()
    assert [r.order_date.year for r in view] == [2017]


def test_a_load_reads_only_files_that_can_hold_its_keys(raw, spark, tmp_path):
    folder = str(tmp_path)
    for r in (range(0, 40), range(40, 80), range(80, 120)):
        star.load_star(star.build_star(orders_of(raw, r)), folder)
    batch = orders_of(raw, range(85, 90))
    for table, column in (("orders", "order_id"), ("order_items", "row_id")):
        ranges = star.key_ranges(batch, column)
        files = star.files_holding(spark, folder, table, [0, 1, 2], column, ranges)
        assert files and all("batch=2" in f for f in files)
        near = star.stored_near(spark, folder, table, [0, 1, 2], column, ranges)
        assert near.count() == (5 if table == "orders" else 10)
        # The scan of the files is given the ranges too, which skips row groups.
        assert f"GreaterThanOrEqual({column}" in plan_of(near)
    assert star.files_holding(spark, folder, "orders", [0, 1, 2], "order_id", [("P", "Q")]) == []


def test_dates_choose_folders_and_headers_choose_the_items(raw, spark, tmp_path):
    folder = str(tmp_path)
    lines = orders_of(raw, range(60))
    star.write_star(star.build_star(lines), folder)
    chosen = Filters(start=date(2015, 1, 1), end=date(2016, 6, 30), regions=("West",))
    found = star.scan_lines(spark, folder, chosen)
    want = lines.filter("order_date BETWEEN DATE '2015-01-01' AND DATE '2016-06-30'")
    assert sorted(r.row_id for r in found.collect()) == sorted(r.row_id for r in want.collect())
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[(.*?)\], PushedFilters", plan_of(found))
    years = {("items" if "row_id" in columns else "orders"): filters for columns, filters in scans if "order_year" in columns}
    assert all(f"order_year#" in f and ">= 2015" in f and "<= 2016" in f for f in years.values()) and len(years) == 2
    # A filter on the headers alone reaches the items' folders while the question runs.
    by_mode = star.star_view(star.scan_star(spark, folder, with_year=True)).filter("ship_date = DATE '2015-02-02'")
    assert "dynamicpruning" in plan_of(by_mode)


def test_orders_are_in_order_inside_files(raw, spark, tmp_path):
    star.write_star(star.build_star(orders_of(raw, range(200))), str(tmp_path))
    for path in glob.glob(f"{tmp_path}/order_items/batch=0/order_year=*/part-*"):
        keys = [r.order_id for r in spark.read.parquet(path).collect()]
        assert keys == sorted(keys)


def test_a_year_that_holds_most_rows_is_many_files(spark, tmp_path):
    """Also where one order holds most of that year."""
    rows = spark.range(40_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "O-1").otherwise(F.concat(F.lit("O-"), "id")).alias("order_id"),
        F.lit(2015).alias(star.YEAR))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star.write_batch(rows, str(tmp_path), "order_items", 0, ["row_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{tmp_path}/order_items/batch=0/order_year=2015/part-*")
    counts = [spark.read.parquet(f).count() for f in files]
    assert len(files) > 4 and max(counts) < 2 * sum(counts) / len(counts)


def test_lines_without_a_load_column_are_refused(raw):
    lines = orders_of(raw, [1])
    with pytest.raises(ValueError, match="postal_code"):
        star.build_star(lines.drop("postal_code"))


def test_an_append_reads_the_ranges_of_its_keys(raw, spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id AS k", "id * 2 AS v").write.parquet(path)
    batch = spark.range(990, 1010).selectExpr("id AS k", "-id AS v")
    for _ in range(2):
        star.append_new_rows(batch, path, ["k"])
    rows = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(rows) == 1010 and rows[995] == 1990 and rows[1005] == -1005


def test_rows_that_are_all_key_meet_stored_ones_in_one_shuffle(spark):
    incoming = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b"), (None, None), (2, "c")], "x INT, y STRING")
    existing = spark.createDataFrame([(1, None, 0), (None, "b", 0), (None, "b", 1), (3, "d", 0)], "x INT, y STRING, z INT")
    fresh = star.new_rows(incoming, existing, ["x", "y"])
    assert "Join" not in plan_of(fresh) and plan_of(fresh).count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, map(tuple, fresh.collect()))) == ["(1, 'a')", "(2, 'c')", "(None, None)"]


def test_items_of_a_stored_table_are_not_staged(raw, spark, tmp_path, monkeypatch):
    staged, seen = star.staged, []
    monkeypatch.setattr(star, "staged", lambda tables, *more: seen.append(sorted(tables)) or staged(tables, *more))
    for number, stage in ((0, False), (1, True)):
        star.load_star(star.build_star(orders_of(raw, range(10 * number, 10 * number + 15))), str(tmp_path), stage=stage)
    assert seen == [["customers", "locations", "orders", "products"],
                    ["customers", "locations", "order_items", "orders", "products"]]
    assert star.scan_star(spark, str(tmp_path))["order_items"].count() == 50
