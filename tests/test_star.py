from datetime import date

import pytest

from orderlens.operators.quality import cleaning_report, clean, normalize_columns
from orderlens.schema import CLEAN_SCHEMA, RAW_SCHEMA, STAR_TABLES, star_schema
from orderlens.sources import files, star


def test_star_round_trip_gives_the_flat_lines_back(raw, spark, tmp_path):
    frame = clean(raw({}, {"Order ID": "O-2", "State": "South", "Product ID": "P-2"},
                      {"Order ID": "O-2", "State": "South", "Profit": "-3"}))
    tables = star.build_star(frame)
    assert {name: t.columns for name, t in tables.items()} == STAR_TABLES
    star.write_star(tables, str(tmp_path))
    view = star.star_view(star.scan_star(spark, str(tmp_path)))
    shared = [c for c in view.columns]
    assert set(frame.columns) - set(shared) == {"country", "postal_code", "data_quality_flag"}
    assert sorted(map(tuple, view.select(*shared).collect())) == sorted(
        map(tuple, frame.select(*shared).collect()))
    audit = {r.table_name: r.n_rows for r in star.load_audit(tables).collect()}
    assert audit == {"locations": 2, "customers": 1, "products": 2, "orders": 2, "order_items": 3}


def test_missing_postal_code_is_a_place_of_its_own(raw):
    frame = clean(raw({"Postal Code": None}, {"Order ID": "O-2", "Postal Code": "02101"}))
    tables = star.build_star(frame)
    places = {r.postal_code: r.location_id for r in tables["locations"].collect()}
    assert set(places) == {None, "02101"}
    assert {r.order_id: r.location_id for r in tables["orders"].collect()} == {
        "O-1": places[None], "O-2": places["02101"]}


def test_first_row_wins_a_conflict(raw):
    frame = clean(raw({"Row ID": 7, "Customer Name": "Zoe"}, {"Row ID": 3, "Customer Name": "Mia"},
                      {"Row ID": 9, "Customer Name": "Ada"}))
    assert [r.customer_name for r in star.dim_customers(frame, "row_id").collect()] == ["Mia"]
    # Without an order of arrival the content decides, the same on every run.
    assert [r.customer_name for r in star.dim_customers(frame).collect()] == ["Ada"]


def test_append_adds_only_unknown_keys_and_repeats_add_nothing(spark, tmp_path):
    path = str(tmp_path / "customers")
    columns = "customer_id STRING, customer_name STRING"
    spark.createDataFrame([("a", "old"), ("b", "old")], columns).write.parquet(path)
    batch = spark.createDataFrame([("b", "new"), ("c", "new"), ("c", "other")], columns)
    for _ in range(2):
        star.append_new_rows(batch, path, ["customer_id"])
        rows = {(r.customer_id, r.customer_name) for r in spark.read.parquet(path).collect()}
        assert rows == {("a", "old"), ("b", "old"), ("c", "new")}


def test_loading_the_star_twice_changes_nothing(raw, spark, tmp_path):
    folder = str(tmp_path)
    first = clean(raw({}, {"Order ID": "O-2"}))
    second = clean(raw({}, {"Order ID": "O-2"}, {"Order ID": "O-3", "Customer ID": "C-2"}))
    star.create_star(spark, folder)
    for lines, orders, items in ((first, 2, 2), (first, 2, 2), (second, 3, 3)):
        star.load_star(star.build_star(lines), folder)
        stored = star.scan_star(spark, folder)
        assert stored["orders"].count() == orders and stored["order_items"].count() == items
    assert {f.name: f.dataType for f in stored["orders"].schema} == {
        f.name: f.dataType for f in star_schema("orders")}
    star.create_star(spark, folder)
    assert star.scan_star(spark, folder)["orders"].count() == 0


def write_csv(path, *rows, header=None):
    header = header or ",".join(f.name for f in RAW_SCHEMA)
    path.write_bytes("\n".join([header, *rows]).encode("latin-1"))


ROW = ('1,O-1,11/8/2016,11/11/2016,Second,C-1,Ada,Consumer,Land,Town,North,02101,West,P-1,Office,'
       'Paper,"Caf\xe9 ""big"", red",261.96,2,0.2,41.9136')


def test_raw_csv_in_latin1(spark, tmp_path):
    write_csv(tmp_path / "raw.csv", ROW)
    row = files.scan_raw_csv(spark, str(tmp_path / "raw.csv")).collect()[0]
    assert row["Product Name"] == 'Caf\xe9 "big", red'
    assert row["Postal Code"] == "02101" and str(row["Profit"]) == "41.9136"
    table = clean(files.scan_raw_csv(spark, str(tmp_path / "raw.csv"))).collect()[0]
    assert (table.order_date, table.delivery_days) == (date(2016, 11, 8), 3)


def test_columns_in_another_order_are_read_by_name(spark, tmp_path):
    names = [f.name for f in RAW_SCHEMA]
    city, state = names.index("City"), names.index("State")
    names[city], names[state] = names[state], names[city]
    write_csv(tmp_path / "raw.csv", ROW, header=",".join(names))
    row = files.scan_raw_csv(spark, str(tmp_path / "raw.csv")).collect()[0]
    assert (row["City"], row["State"]) == ("North", "Town")


@pytest.mark.parametrize("change", ["swap", "leave out"])
def test_a_second_file_with_another_header_fails(spark, tmp_path, change):
    names = [f.name for f in RAW_SCHEMA]
    header = ",".join(n for n in names if n != "City")
    if change == "swap":
        header = ",".join(names).replace("City,State", "State,City")
    (tmp_path / "raw").mkdir()
    write_csv(tmp_path / "raw" / "a.csv", ROW)
    write_csv(tmp_path / "raw" / "b.csv", ROW, header=header)
    with pytest.raises(Exception, match="(?i)header|column|heading"):
        files.scan_raw_csv(spark, str(tmp_path / "raw")).collect()


def test_numbers_are_read_exactly_or_counted(spark, tmp_path):
    bad = ROW.replace("261.96,2,", "1.23456,oops,")
    write_csv(tmp_path / "raw.csv", ROW, bad)
    raw = files.scan_raw_csv(spark, str(tmp_path / "raw.csv"))
    got = {str(r.sales): r.quantity for r in clean(raw).collect()}
    assert got == {"261.9600": 2, "None": None}
    found = {(r.check_name, r.column_name): r.n_rows for r in cleaning_report(raw).collect()}
    assert found["unparseable numbers", "sales"] == found["unparseable numbers", "quantity"] == 1
    assert found["missing values", "quantity"] == found["unparseable numbers", "profit"] == 0


def test_raw_csv_without_a_heading_fails(spark, tmp_path):
    header = ",".join(f.name for f in RAW_SCHEMA).replace("Postal Code", "Zip")
    write_csv(tmp_path / "raw.csv", ROW, header=header)
    with pytest.raises(ValueError, match="Postal Code"):
        files.scan_raw_csv(spark, str(tmp_path / "raw.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_clean_table_round_trip(raw, spark, tmp_path, fmt):
    frame = clean(raw({}, {"Order Date": "1/2/2017", "Ship Date": None, "Postal Code": None}))
    path = str(tmp_path / fmt)
    for _ in range(2):
        files.write_clean(frame.select(*CLEAN_SCHEMA.fieldNames()), path, fmt)
    back = files.scan_clean(spark, path, fmt=fmt).select(*CLEAN_SCHEMA.fieldNames())
    assert [f.dataType for f in back.schema] == [f.dataType for f in CLEAN_SCHEMA]
    assert sorted(map(repr, back.collect())) == sorted(
        map(repr, frame.select(*CLEAN_SCHEMA.fieldNames()).collect()))


def test_date_filter_prunes_year_folders(raw, spark, tmp_path):
    frame = clean(raw({}, {"Order Date": "1/2/2017", "Ship Date": "1/4/2017"}))
    path = str(tmp_path / "clean")
    files.write_clean(frame, path)
    assert {p.name for p in (tmp_path / "clean").glob("order_year=*")} == {
        "order_year=2016", "order_year=2017"}
    later = files.scan_clean(spark, path, years=(2017, 2017))
    assert later.count() == 1 and later.columns == CLEAN_SCHEMA.fieldNames()
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_normalized_raw_frame_keeps_values(raw):
    assert normalize_columns(raw({})).collect()[0].sub_category == "Paper"


def test_only_sold_products_are_stored(raw, spark, tmp_path):
    """Products follow the stored items; of the items, one row per product and task is moved."""
    frame = clean(raw({}, {"Order ID": "O-2", "Product ID": "P-2"}, {"Order ID": "O-3", "Product ID": "P-3"}))
    tables = star.build_star(frame)
    tables["order_items"] = tables["order_items"].filter("product_id <> 'P-3'")
    star.write_star(tables, str(tmp_path), only_sold=True)
    stored = star.scan_star(spark, str(tmp_path))
    sold = {r.product_id for r in tables["order_items"].collect()}
    assert len(sold) == 2 and {r.product_id for r in stored["products"].collect()} == sold
    plan = star.sold_products(tables["products"], stored["order_items"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [product_id" in plan.split("LeftSemi")[1]


def test_the_load_writes_items_once_and_moves_no_name_by_order(spark, monkeypatch):
    """Items go to their table as they are read; the order frame meets customers last."""
    from orderlens import catalog
    from orderlens.sources.warehouse import Warehouse

    written = []
    again = catalog._again
    monkeypatch.setattr(catalog, "_again", lambda w, path, frame: written.append((path, frame)) or again(w, path, frame))
    w = Warehouse.gated(spark, "/root/testdata/sf0.001")
    stored = star.scan_star(spark, catalog._stored_star(w))
    assert [path.rsplit("/", 1)[1] for path, _ in written] == ["orders"]
    plan = written[0][1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (customer_id") < plan.index("Join Inner, (order_id")
    assert stored["order_items"].count() == w.lines("order_id").count()
