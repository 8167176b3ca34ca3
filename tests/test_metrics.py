from datetime import date

import pytest

from orderlens.operators import calendar, commerce, delivery, kpi, quadrant, rollup
from orderlens.operators.filters import Filters, filter_domains, filter_lines, has_rows


def order_frame(frame):
    return rollup.order_rollup(frame)


def test_mixed_order_is_half_lossy_by_line_and_not_by_order(lines, one):
    frame = lines({"sub_category": "a", "profit": "10"}, {"sub_category": "b", "profit": "-4"})
    assert one(kpi.loss_making_line_rate(frame))["loss_making_line_rate"] == 50
    assert one(kpi.loss_making_order_rate(order_frame(frame)))["loss_making_order_rate"] == 0


def test_loss_order(lines, one):
    frame = lines({"profit": "10"}, {"profit": "-14"})
    assert one(kpi.loss_making_line_rate(frame))["loss_making_line_rate"] == 50
    assert one(kpi.loss_making_order_rate(order_frame(frame)))["loss_making_order_rate"] == 100


def test_empty_input_gives_zero_for_ratios_and_null_for_sums(lines, one):
    frame = lines({}).filter("false")
    orders = order_frame(frame)
    assert one(kpi.total_orders(frame))["total_orders"] == 0
    assert one(kpi.average_order_value(frame))["average_order_value"] == 0
    assert one(kpi.profit_margin_pct(frame))["profit_margin_pct"] == 0
    assert one(kpi.loss_making_line_rate(frame))["loss_making_line_rate"] == 0
    assert one(kpi.loss_making_order_rate(orders))["loss_making_order_rate"] == 0
    assert one(kpi.total_revenue(frame))["total_revenue"] is None
    assert one(kpi.average_delivery_days(orders))["average_delivery_days"] is None
    summary = one(kpi.kpi_summary(orders))
    assert summary["total_orders"] == 0 and summary["total_order_lines"] == 0
    assert summary["avg_order_value"] is None and summary["loss_making_line_pct"] is None
    assert not has_rows(frame)


def test_zero_revenue(lines, one):
    frame = lines({"sales": "0", "profit": "-5"}, {"sub_category": "b", "order_id": "o2"})
    assert one(kpi.profit_margin_pct(frame.filter("sales = 0")))["profit_margin_pct"] == 0
    margins = {r.sub_category: r.profit_margin_pct
               for r in commerce.revenue_by_category(frame).collect()}
    assert margins == {"sub": None, "b": 10}
    ranks = {r.sub_category: r.margin_rank_worst_first
             for r in commerce.category_performance(frame).collect()}
    assert ranks == {"b": 1, "sub": 2}


def test_summary_agrees_with_the_single_kpis(lines, one):
    frame = lines(
        {"profit": "-3", "sales": "33.335"}, {"delivery_days": 3},
        {"order_id": "o2", "delivery_days": 9, "profit": "2.005"})
    orders = order_frame(frame)
    summary = one(kpi.kpi_summary(orders))
    assert summary["total_revenue"] == one(kpi.total_revenue(frame))["total_revenue"]
    assert summary["avg_order_value"] == one(kpi.average_order_value(frame))["average_order_value"]
    # Line-weighted: (3 + 3 + 9) / 3.
    assert summary["avg_delivery_days"] == 5
    assert summary["loss_making_line_pct"] == one(
        kpi.loss_making_line_rate(frame))["loss_making_line_rate"]


def test_money_rounds_half_up(lines, one):
    assert str(one(kpi.total_revenue(lines({"sales": "1.005"})))["total_revenue"]) == "1.01"
    assert str(one(kpi.total_profit(lines({"profit": "-1.005"})))["total_profit"]) == "-1.01"


def test_unknown_profit_is_no_loss(lines, one):
    frame = lines({"profit": None}, {"profit": "-1"})
    assert one(kpi.loss_making_line_rate(frame))["loss_making_line_rate"] == 50


def test_band_edges_belong_to_the_lower_band(lines, one):
    frame = lines(*[{"discount": d} for d in ("0", "0.01", "0.2", "0.21", "0.4", "0.41")])
    parts = rollup.order_parts(frame, "segment", "discount")
    bands = {r.discount_band: r.total_line_items
             for r in commerce.loss_by_discount_band(parts).collect()}
    assert bands == {"0% (no discount)": 1, "1-20%": 2, "21-40%": 2, "41%+": 1}
    assert one(commerce.deep_discount_loss(frame))["n_lines"] == 1
    by_segment = commerce.loss_by_discount_band(parts, "segment").collect()
    assert sum(r.total_line_items for r in by_segment) == 6


def test_band_labels_show_their_edges(lines):
    parts = rollup.order_parts(lines(*[{"discount": d} for d in ("0.05", "0.12", "0.13", "0.3")]), "discount")
    bands = {r.discount_band for r in commerce.loss_by_discount_band(parts, edges=("0.125", "0.2")).collect()}
    assert bands == {"1-12.5%", ">12.5-20%", "21%+"}


def test_deep_discount_without_such_lines(lines, one):
    row = one(commerce.deep_discount_loss(lines({"profit": "-1"})))
    assert (row["n_lines"], row["loss_line_rate"], row["baseline_loss_line_rate"]) == (0, 0, 100)
    assert commerce.deep_discount_concentration(lines({})).count() == 0


def test_shares_sum_to_one(lines):
    frame = lines({"category": "a", "sales": "1"}, {"category": "b", "sales": "2"},
                  {"category": "c", "sales": "5"})
    shares = [r.revenue_share for r in commerce.revenue_share(frame).collect()]
    assert [float(s) for s in shares] == [0.625, 0.25, 0.125]


def test_p75_differs_between_line_and_order_grain(lines, one):
    slow = [{"order_id": "s", "delivery_days": 9}] * 5
    fast = [{"order_id": f"f{i}", "delivery_days": i} for i in (1, 2, 3)]
    orders = order_frame(lines(*slow, *fast))
    by_line = one(delivery.delivery_performance(orders))
    by_order = one(delivery.delivery_benchmark(orders))
    assert by_line["internal_benchmark_days"] == 9 and by_line["orders_over_benchmark"] == 0
    assert by_order["benchmark_days"] == 4.5 and by_order["pct_over_benchmark"] == 25
    # Both average over orders: (9 + 1 + 2 + 3) / 4.
    assert by_line["avg_delivery_days"] == by_order["avg_delivery_days"]
    assert float(by_order["avg_delivery_days"]) == 3.75


def test_boxplot_fences(lines, one):
    frame = lines(*[{"order_id": str(i), "delivery_days": d}
                    for i, d in enumerate((1, 2, 3, 4, 5, 40))])
    box = one(delivery.delivery_boxplot(order_frame(frame)))
    assert (box["q1_days"], box["median_days"], box["q3_days"]) == (2.25, 3.5, 4.75)
    assert (box["lower_whisker"], box["upper_whisker"], box["max_days"]) == (1, 5, 40)
    assert box["n_outliers"] == 1


def test_quadrant_ties_count_as_high(spark):
    stats = spark.createDataFrame(
        [("a", 1, "10.00"), ("b", 2, "20.00"), ("c", 3, "30.00")], "seg STRING, n INT, r STRING"
    ).selectExpr("seg", "n", "CAST(r AS DECIMAL(7,2)) AS r")
    labels = {r.seg: r.quadrant for r in quadrant.classify(stats, "n", "r").collect()}
    assert labels == {"a": quadrant.LOW_PRIORITY, "b": quadrant.PRIORITY, "c": quadrant.PRIORITY}


def test_quadrant_tie_with_a_mean_no_float_holds(spark):
    stats = spark.range(3).selectExpr("id AS seg", "id AS n", "CAST(0.1 AS DECIMAL(7,2)) AS r")
    assert {r.quadrant for r in quadrant.classify(stats, "n", "r").collect()} == {
        quadrant.PRIORITY, quadrant.INVESTIGATE}


def segment(state, sub, n, loss=0):
    return [{"order_id": f"{state}{sub}{i}", "state": state, "sub_category": sub,
             "profit": "-1" if i < loss else "1"} for i in range(n)]


def parts(frame):
    return rollup.order_parts(frame, "state", "sub_category")


def test_thin_segments_leave_before_the_thresholds(lines):
    frame = lines(*segment("x", "a", 4, 4), *segment("x", "b", 5, 1), *segment("y", "a", 6, 3))
    rows = quadrant.bottleneck_segments(parts(frame)).collect()
    assert [(r.state, r.sub_category) for r in rows] == [("y", "a"), ("x", "b")]
    # Mean of 20 and 50 percent: the thin segment's 100 percent is gone.
    assert float(rows[0].overall_avg_line_loss_rate) == 35
    assert rows[0].overall_median_volume == 5.5
    assert rows[0].quadrant == quadrant.PRIORITY and rows[1].quadrant == quadrant.LOW_PRIORITY


def test_low_priority_does_not_pass_for_priority(lines):
    frame = lines(*segment("x", "a", 6, 0), *segment("y", "a", 5, 5))
    rows = quadrant.bottleneck_segments(parts(frame))
    assert {r.quadrant for r in rows.collect()} == {quadrant.BENCHMARK, quadrant.INVESTIGATE}
    assert quadrant.priority_segments(rows).count() == 0


def test_locations_on_either_delivery_grain(lines, one):
    frame = lines(*[{"order_id": "a", "delivery_days": 2}] * 3, {"order_id": "b", "delivery_days": 6})
    orders = order_frame(frame)
    assert float(one(quadrant.location_performance(orders))["avg_delivery_days"]) == 4
    by_line = one(quadrant.location_performance_lines(orders))
    assert float(by_line["avg_delivery_days"]) == 3
    assert by_line["median_orders"] == 2 and by_line["avg_loss_rate"] == 0


def test_rank_ties_share_a_rank(lines):
    frame = lines({"state": "a", "order_id": "1"}, {"state": "b", "order_id": "2"},
                  {"state": "c", "order_id": "3", "sales": "7"})
    ranks = {r.state: r.rank_within_region
             for r in rollup.orders_by_location(order_frame(frame)).collect()}
    assert ranks == {"a": 1, "b": 1, "c": 3}


def test_margin_of_the_rollup_divides_rounded_totals(lines, one):
    frame = lines({"sales": "0.014", "profit": "0.006"})
    assert float(one(rollup.revenue_by(frame, "category"))["profit_margin_pct"]) == 100
    assert float(one(commerce.revenue_by_category(frame))["profit_margin_pct"]) == 42.86


def test_line_and_order_rollups_agree(lines):
    frame = lines({"state": "a"}, {"state": "a"}, {"state": "b", "order_id": "o2", "profit": "-1"})
    assert (rollup.revenue_by(frame, "state").collect()
            == rollup.revenue_by_order_attribute(order_frame(frame), "state").collect())


def test_parts_count_an_order_once_per_key(lines):
    frame = lines({}, {}, {"sub_category": "b", "profit": "-1"}, {"order_id": "o2"})
    assert (rollup.revenue_by(frame, "sub_category").collect()
            == rollup.revenue_by_order_attribute(
                rollup.order_parts(frame, "sub_category"), "sub_category").collect())


def test_weekdays_start_on_sunday(lines):
    frame = lines({"order_id": "a", "order_date": date(2024, 1, 6)},
                  {"order_id": "b", "order_date": date(2024, 1, 7)})
    days = [r.day_of_week for r in calendar.demand_by_weekday(order_frame(frame)).collect()]
    assert days == ["Sunday", "Saturday"]


def test_months(lines):
    frame = lines({"order_id": "a", "order_date": date(2023, 11, 1)},
                  {"order_id": "b", "order_date": date(2024, 11, 2)},
                  {"order_id": "c", "order_date": date(2024, 3, 2)})
    orders = order_frame(frame)
    assert [(r.month, r.total_orders) for r in calendar.monthly_trend(orders).collect()] == [
        ("2023-11", 1), ("2024-03", 1), ("2024-11", 1)]
    assert [(r.month_num, r.month_name, r.total_orders)
            for r in calendar.month_seasonality(orders).collect()] == [(3, "Mar", 1), (11, "Nov", 2)]
    assert [(r.order_month, r.demand_rank) for r in calendar.peak_months(orders, 1).collect()] == [
        (11, 1)]


def test_discount_beside_all_other_states(lines):
    frame = lines({"order_id": "a", "state": "x", "discount": "0.1"},
                  {"order_id": "b", "state": "y", "discount": "0.3"},
                  {"order_id": "c", "state": "z", "discount": "0.5"})
    rows = {r.state: (float(r.avg_discount), float(r.other_states_avg_discount))
            for r in commerce.discount_vs_rest(order_frame(frame)).collect()}
    assert rows == {"x": (0.1, 0.4), "y": (0.3, 0.3), "z": (0.5, 0.2)}


def test_only_state_has_no_others(lines, one):
    row = one(commerce.discount_vs_rest(order_frame(lines({"discount": "0.1"}))))
    assert row["other_states_avg_discount"] is None


def test_filters_combine_and_include_both_date_ends(lines):
    frame = lines({"order_id": "a"}, {"order_id": "b", "region": "Q"},
                  {"order_id": "c", "order_date": date(2024, 2, 1)},
                  {"order_id": "d", "category": "other"})
    assert filter_lines(frame, Filters()).count() == 4
    chosen = Filters(regions=("R",), categories=("cat",), start=date(2024, 1, 5),
                     end=date(2024, 2, 1))
    assert {r.order_id for r in filter_lines(frame, chosen).collect()} == {"a", "c"}
    single = Filters(ship_modes=("slow",), start=date(2024, 2, 1), end=date(2024, 2, 1))
    assert [r.order_id for r in filter_lines(frame, single).collect()] == ["c"]


def test_filter_domains(lines):
    frame = lines({}, {"region": "Q", "order_date": date(2023, 5, 1)}, {"ship_mode": None})
    offered = [(r.field, r.value) for r in filter_domains(frame).collect()]
    assert offered == [
        ("category", "cat"), ("order_date", "2023-05-01"), ("order_date", "2024-01-05"),
        ("region", "Q"), ("region", "R"), ("ship_mode", "slow")]


@pytest.mark.parametrize("n", [1, 2])
def test_top_products(lines, n):
    frame = lines({"product_name": "a", "sales": "5"}, {"product_name": "b", "sales": "3"},
                  {"product_name": "b", "sales": "4", "quantity": 7})
    top = commerce.top_products(frame, n).collect()
    assert [(r.product_name, r.total_quantity) for r in top] == [("b", 8), ("a", 1)][:n]
