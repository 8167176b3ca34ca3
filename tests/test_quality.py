from datetime import date

import pytest

from orderlens.operators import quality
from orderlens.schema import CLEAN_SCHEMA, LOAD_COLUMNS, RAW_COLUMNS


def counts(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}


def test_missing_columns_fail_before_any_job(raw):
    quality.check_columns(raw({}), RAW_COLUMNS)
    with pytest.raises(ValueError, match="Postal Code"):
        quality.check_columns(raw({}).drop("Postal Code"), RAW_COLUMNS)
    with pytest.raises(ValueError, match="delivery_days"):
        quality.check_columns(quality.normalize_columns(raw({})), LOAD_COLUMNS)


def test_names():
    assert quality.clean_name(" Sub-Category ") == "sub_category"
    assert quality.clean_name("Row ID") == "row_id"


def test_exact_duplicates_go_and_repeated_content_stays(raw, one):
    frame = raw({"Row ID": 1}, {"Row ID": 1}, {"Row ID": 2}, {"Row ID": 3, "City": "Else"})
    assert quality.dedup_lines(frame).count() == 3
    assert one(quality.dedup_report(frame)) == {"n_rows": 4, "n_distinct": 3, "n_removed": 1}
    assert one(quality.duplicate_keys(frame, "Row ID")) == {"n_keys": 1, "n_repeats": 1}


def test_dates_that_do_not_parse_become_null(raw):
    frame = quality.normalize_columns(raw(
        {"Order Date": "11/8/2016"}, {"Order Date": "11/08/2016"},
        {"Order Date": "13/45/2016"}, {"Order Date": ""}))
    days = [r.order_date for r in quality.parse_dates(frame, "order_date").orderBy("row_id").collect()]
    assert days == [date(2016, 11, 8), date(2016, 11, 8), None, None]


def test_shipment_before_order_is_flagged_and_kept(raw):
    frame = quality.clean(raw({}, {"Ship Date": "11/7/2016"}, {"Ship Date": None}))
    found = {r.row_id: (r.data_quality_flag, r.delivery_days) for r in frame.collect()}
    assert found == {1: ("ok", 3), 2: ("ship_before_order", -1), 3: ("ok", None)}
    assert counts(quality.quality_flag_counts(frame), "data_quality_flag", "n") == {
        "ok": 2, "ship_before_order": 1}
    good, bad = quality.quarantine_lines(frame)
    assert {r.row_id for r in good.collect()} == {1, 3}
    assert [r.broken_rules for r in bad.collect()] == ["delivery_days >= 0; ship_date >= order_date"]


def test_clean_table_has_the_declared_shape(raw):
    frame = quality.clean(raw({"Region": " West "}, {"Profit": "-1"}))
    assert set(frame.columns) == set(CLEAN_SCHEMA.fieldNames())
    assert {f.name: f.dataType for f in frame.schema} == {
        f.name: f.dataType for f in CLEAN_SCHEMA}
    rows = sorted(frame.collect(), key=lambda r: r.row_id)
    assert [r.region for r in rows] == ["West", "West"]
    assert [r.is_loss_line for r in rows] == [False, True]


def test_padded_categories_are_one_value(raw):
    frame = quality.normalize_columns(raw({"Region": " West"}, {"Region": "West "}, {}))
    assert counts(quality.categorical_profile(frame), "column_name", "n_distinct")["region"] == 1


def test_ranges(raw):
    frame = quality.normalize_columns(raw(
        {"Quantity": 0}, {"Sales": "0"}, {"Sales": "-1"}, {"Discount": "1.2"}, {}))
    assert counts(quality.range_checks(frame), "check_name", "n_bad") == {
        "quantity<=0": 1, "sales<=0": 2, "discount outside [0,1]": 1}


def test_null_profile_and_types(raw):
    frame = quality.normalize_columns(raw({"Postal Code": None}, {}))
    nulls = counts(quality.null_profile(frame), "column_name", "n_null")
    assert nulls.pop("postal_code") == 1 and set(nulls.values()) == {0}
    types = {r.column_name: (r.data_type, r.n_values) for r in quality.column_types(frame).collect()}
    assert types["postal_code"] == ("string", 1) and types["sales"] == ("decimal(14,4)", 2)


def test_report_counts_what_remains_after_deduplication(raw):
    frame = raw({"Row ID": 1, "Postal Code": None}, {"Row ID": 1, "Postal Code": None},
                {"Order Date": "x", "Profit": "-2"}, {"Ship Date": "11/1/2016", "Quantity": 0})
    found = {(r.check_name, r.column_name): r.n_rows for r in quality.cleaning_report(frame).collect()}
    assert found["rows read", None] == 4
    assert found["duplicate rows removed", None] == 1
    assert found["missing values", "postal_code"] == 1
    assert found["missing values", "order_date"] == 0
    assert found["unparseable dates", "order_date"] == 1
    assert found["ship_date before order_date", None] == 1
    assert found["quantity<=0", None] == 1
    assert found["loss-making lines", None] == 1
    assert found["distinct values after trimming", "region"] == 1


def test_report_of_nothing(raw):
    report = quality.cleaning_report(raw({}).filter("false"))
    assert {r.n_rows for r in report.collect()} == {0}


def test_attributes_that_vary_within_an_order(raw):
    frame = quality.normalize_columns(raw(
        {"Order ID": "a", "State": "x"}, {"Order ID": "a", "State": "y"},
        {"Order ID": "b", "State": "x"}))
    found = counts(quality.order_fd_check(frame, ["state", "ship_mode"]), "column_name", "n_orders")
    assert found == {"state": 1, "ship_mode": 0}


def test_constraints(raw, spark):
    from orderlens.sources import star
    frame = quality.clean(raw(
        {"Sales": "-1", "Quantity": 0, "Discount": "1.5", "Ship Mode": "x" * 31}, {"Order ID": "O-2", "Ship Date": "1/1/2016"},
        {"Row ID": 2, "Order ID": "O-3", "Product ID": "P-9"}))
    tables = star.build_star(frame)
    tables["products"] = tables["products"].filter("product_id <> 'P-9'")
    found = counts(quality.constraint_violations(
        tables, keys={"order_items": ["row_id"], "locations": ["location_id"],
                      "orders": ["order_id"]},
        lengths={"orders": {"ship_mode": 30}},
        not_null={"orders": ["order_id"], "order_items": ["sales"]},
        checks={"orders": ["delivery_days >= 0"],
                "order_items": ["sales >= 0", "quantity > 0", "discount between 0 and 1"]},
        references=[("order_items", "product_id", "products"), ("order_items", "order_id", "orders")],
    ), "rule", "n_violations")
    assert found == {
        "orders.order_id not null": 0, "orders: delivery_days >= 0": 1,
        "order_items.sales not null": 0, "order_items: sales >= 0": 1,
        "order_items: quantity > 0": 1, "order_items: discount between 0 and 1": 1,
        "orders.ship_mode at most 30 characters": 1, "orders unique (order_id)": 0,
        "order_items unique (row_id)": 1, "locations unique (location_id)": 0,
        "order_items.product_id references products": 1,
        "order_items.order_id references orders": 0}


def test_texts_without_a_slash_are_not_tried_as_dates(spark):
    """A failed attempt to read a date costs many times what a date does."""
    texts = ["1/2/1997", "01/02/1997", "12/31/1998", "13/1/1997", "2/30/1997", "pending", "", "1/2", " 1/2/1997", None]
    frame = spark.createDataFrame([(t,) for t in texts], "day STRING")
    found = quality.parse_dates(frame, "day")
    assert [r.day for r in found.collect()] == [date(1997, 1, 2), date(1997, 1, 2), date(1998, 12, 31)] + [None] * 7
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()
