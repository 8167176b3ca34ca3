"""The frames behind the four dashboard pages, for one set of filters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from orderlens.operators import calendar, commerce, delivery, findings, kpi, quadrant, rollup
from orderlens.operators.filters import NO_FILTERS, Filters
from orderlens.sources.warehouse import Warehouse

ORDER_FRAME = ("state", "region", "ship_mode", "delivery_days", "n_lines", "sum_sales",
               "sum_profit", "sum_discount")


class Dashboard:
    """Each page returns its frames by name.

    State, delivery and finding frames share the order cube and the sub-category
    totals, which are computed when the first page asks for them; the other frames
    read only the columns they show, when they are shown.
    """

    def __init__(self, warehouse: Warehouse, filters: Filters = NO_FILTERS,
                 limit: str = commerce.DEEP_DISCOUNT, min_orders: int = 5):
        self.warehouse = warehouse
        self.filters = filters
        self.limit = limit
        self.min_orders = min_orders

    def _lines(self, *columns: str) -> DataFrame:
        return self.warehouse.lines(*columns, filters=self.filters)

    def _orders(self, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
        return self.warehouse.orders(*columns, by=by, filters=self.filters)

    def _revenue_by(self, key: str) -> DataFrame:
        return rollup.revenue_by_order_attribute(
            self._orders("sum_sales", "sum_profit", by=(key,)), key)

    @cached_property
    def found(self) -> findings.Evidence:
        return findings.gather(
            self._orders(*ORDER_FRAME),
            self._lines("sub_category", "sales", "profit", "discount"), self.limit)

    def overview(self) -> dict[str, DataFrame]:
        return {
            "headline": kpi.headline_metrics(self._orders(*ORDER_FRAME)),
            "trend": calendar.monthly_trend(self._orders("order_date", "sum_sales")),
            "top_states": quadrant.top_states(self.found.states),
            "category_revenue": self._revenue_by("category"),
            "insights": findings.insights(self.found),
        }

    def operations(self) -> dict[str, DataFrame]:
        parts = self._orders(
            "state", "n_lines", "n_loss_lines", "sum_profit", by=("sub_category",))
        segments = quadrant.bottleneck_segments(parts, self.min_orders, priority_first=False)
        return {
            "states": self.found.states,
            "states_by_loss_rate": quadrant.states_by_loss_rate(self.found.states),
            "seasonality": calendar.month_seasonality(self._orders("order_date")),
            "delivery": delivery.delivery_benchmark(self.found.cube),
            "priority_segments": quadrant.priority_segments(segments),
        }

    def product(self) -> dict[str, DataFrame]:
        return {
            "category_share": commerce.revenue_share(self._lines("category", "sales")),
            "margins": self._revenue_by("sub_category"),
            "top_products": commerce.top_products(
                self._lines("product_name", "sales", "quantity", "profit")),
            "category_trend": calendar.category_month_trend(
                self._lines("order_date", "category", "sales")),
        }

    def business_insights(self) -> dict[str, DataFrame]:
        return {"findings": findings.findings(self.found)}
