"""Findings, insights, dashboard frames and profiles."""

from datetime import date
from decimal import Decimal

import pytest

from orderlens.operators import findings, kpi, profile, rollup
from orderlens.operators.dashboard import Dashboard
from orderlens.operators.filters import Filters
from orderlens.sources.warehouse import Warehouse

SF_DIR = "/root/testdata/sf0.001"


def report(lines, *rows):
    frame = lines(*rows)
    return findings.gather(rollup.order_rollup(frame), frame)


def order(n, **columns):
    return [columns | {"order_id": f"{columns.get('state', 'S')}{i}"} for i in range(n)]


def test_findings_follow_the_data(lines):
    found = report(
        lines, *order(5, state="x", profit="-4", discount="0.5", sub_category="bad"),
        *order(2, state="y", sub_category="fine", delivery_days=1),
        {"order_id": "late", "state": "y", "sub_category": "fine", "delivery_days": 99})
    rows = findings.findings(found).collect()
    assert [(r.finding_no, r.subject) for r in rows] == [(1, "x"), (2, "bad"), (3, "bad"), (4, "slow")]
    assert rows[0].evidence == ("loss-making orders 100.0% of 5 (mean of states 50.0%); "
                                "mean discount 50.0% (other states 0.0%)")
    assert rows[2].evidence == ("lines over 40% discount: 5, loss-making 100.0% (all lines 62.5%); "
                                "largest share 100.0%")
    assert rows[3].value == 12.5 and rows[3].baseline == 3
    assert findings.insights(found).count() == 5


def test_conditional_findings_stay_out(lines):
    found = report(lines, *order(6, state="x"), *order(5, state="y", profit="-1"))
    assert [r.finding_no for r in findings.findings(found).collect()] == [2, 4]
    assert [r.insight_no for r in findings.insights(found).collect()] == [2, 4, 5]


def test_no_rows_no_findings(lines):
    frame = lines({}).filter("false")
    found = findings.gather(rollup.order_rollup(frame), frame)
    assert findings.findings(found).count() == 0
    assert findings.insights(found).count() == 0


def test_dashboard_frames_agree_with_each_other(spark):
    w = Warehouse(spark, SF_DIR)
    chosen = Filters(regions=("ASIA", "EUROPE"), start=date(1996, 1, 1))
    board = Dashboard(w, chosen, limit="0.08", min_orders=1)
    overview, operations, product = board.overview(), board.operations(), board.product()
    head = overview["headline"].collect()[0]
    total = head.total_orders
    assert total == w.lines("order_id", filters=chosen).distinct().count() > 0
    # Keys that are constant per order split the orders.
    for frame in (overview["trend"], operations["states"], operations["seasonality"],
                  operations["delivery"]):
        assert sum(r.total_orders for r in frame.collect()) == total
    revenue = sum(r.total_revenue for r in overview["category_revenue"].collect())
    assert abs(revenue - head.total_revenue) < 1
    assert product["top_products"].count() == 10
    assert abs(sum(r.revenue_share for r in product["category_share"].collect()) - 1) < Decimal("1e-4")
    assert product["margins"].count() == 25 and product["category_trend"].count() > 6
    assert overview["insights"].count() >= 4 and overview["top_states"].count() == 10
    assert board.business_insights()["findings"].count() >= 3
    assert operations["priority_segments"].count() <= 15


def test_filtered_summary_equals_summary_of_filtered_lines(spark, one):
    w = Warehouse(spark, SF_DIR)
    chosen = Filters(categories=("ECONOMY",), ship_modes=("2-HIGH",))
    columns = ["order_id", "delivery_days", "sales", "profit", "discount"]
    direct = kpi.kpi_summary(w.orders(
        "delivery_days", "n_lines", "n_loss_lines", "sum_sales", "sum_profit", filters=chosen))
    again = kpi.kpi_summary(rollup.order_rollup(w.lines(*columns, filters=chosen)))
    assert one(direct) == one(again)


@pytest.mark.parametrize("n", [0, 1, 7, 50])
def test_sample_is_exact_and_repeatable(spark, n):
    frame = spark.range(40).selectExpr("id", "id % 3 AS x")
    first = [tuple(r) for r in profile.sample_lines(frame, n, seed=1).collect()]
    assert len(set(first)) == len(first) == min(n, 40)
    assert first == [tuple(r) for r in profile.sample_lines(frame.repartition(7), n, seed=1).collect()]
    if n == 7:
        assert first != [tuple(r) for r in profile.sample_lines(frame, n, seed=2).collect()]


def test_sample_of_equal_rows(spark):
    frame = spark.range(30).selectExpr("1 AS x")
    assert profile.sample_lines(frame, 10).count() == 10


def test_histogram_keeps_every_row_and_the_maximum_in_the_last_bin(lines):
    frame = lines(*[{"sales": str(v)} for v in range(0, 61)])
    rows = profile.histogram(frame, "sales", 60).collect()
    assert sum(r.n for r in rows) == 61
    assert (rows[-1].bin, rows[-1].n, rows[0].bin_start, rows[-1].bin_end) == (60, 2, 0, 60)


def test_histogram_of_one_value(lines, one):
    row = one(profile.histogram(lines({"sales": "5"}, {"sales": "5"}), "sales"))
    assert (row["bin"], row["n"]) == (1, 2)


def test_value_counts_sum_to_the_rows(lines):
    frame = lines({}, {"region": "Q"}, {"segment": "B"})
    totals = {}
    for r in profile.value_counts(frame).collect():
        totals[r.column_name] = totals.get(r.column_name, 0) + r.n
    assert set(totals.values()) == {3} and len(totals) == 5


def test_correlations_are_symmetric(lines):
    frame = lines(*[{"sales": str(i), "quantity": 10 - i, "profit": str(i * i % 7),
                     "discount": f"0.0{i}", "delivery_days": i % 4} for i in range(1, 9)])
    cells = {(r.column_x, r.column_y): r.correlation
             for r in profile.correlation_matrix(frame).collect()}
    assert len(cells) == 25 and cells["sales", "quantity"] == -1 and cells["profit", "profit"] == 1
    assert all(cells[a, b] == cells[b, a] for a, b in cells)


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_correlation_with_constant_columns(lines, rows):
    frame = lines(*[{"sales": str(i), "quantity": 3, "profit": str(-i)} for i in range(max(rows, 1))])
    cells = {(r.column_x, r.column_y): r.correlation
             for r in profile.correlation_matrix(frame.limit(rows)).collect()}
    assert len(cells) == 25 and cells["quantity", "quantity"] is None and cells["sales", "quantity"] is None
    assert cells["sales", "profit"] == (-1 if rows > 1 else None)
