"""Findings and headline insights, worded from the data of the moment.

Each statement is a one-row frame that is empty when its condition does not
hold; their union is the report. Nothing is collected on the way.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.measures import count_where, is_loss, or_zero, percent, plain
from orderlens.operators.commerce import DEEP_DISCOUNT, with_rest
from orderlens.operators.delivery import slowest_ship_mode, worst_benchmark_mode
from orderlens.operators.quadrant import order_cube, priority_states, rank_states
from orderlens.plans.reuse import compute_once


@dataclass(frozen=True)
class Evidence:
    """The aggregated frames all statements draw on, each computed once."""

    cube: DataFrame
    states: DataFrame
    subcategories: DataFrame
    limit: str


def gather(orders: DataFrame, lines: DataFrame, limit: str = DEEP_DISCOUNT) -> Evidence:
    """Two passes over the facts: the order cube and the sub-category totals."""
    cube = order_cube(orders)
    deep = F.col("discount") > F.lit(Decimal(limit))
    loss = is_loss(F.col("profit"))
    subcategories = compute_once(lines.groupBy("sub_category").agg(
        F.sum("sales").alias("revenue"), F.sum("profit").alias("profit"),
        F.count(F.lit(1)).alias("n_lines"), count_where(loss).alias("n_loss"),
        count_where(deep).alias("n_deep"), count_where(deep & loss).alias("n_deep_loss")))
    return Evidence(cube, rank_states(cube), subcategories, limit)


# -- the facts behind the statements --------------------------------------------

def _top_priority(found: Evidence) -> DataFrame:
    """The largest priority state with its discount beside all other states'."""
    by_state = with_rest(found.states.groupBy("state").agg(
        F.sum("sum_discount").alias("discounts"), F.sum("n_lines").alias("n")))
    return priority_states(found.states).limit(1).join(
        by_state.select("state", "avg_discount", "other_states_avg_discount"), "state")


def _worst_margin(found: Evidence) -> DataFrame:
    revenue, profit = F.round("revenue", 2), F.round("profit", 2)
    return found.subcategories.select(
        "sub_category", revenue.alias("total_revenue"),
        percent(profit, revenue).alias("profit_margin_pct"),
    ).orderBy(F.asc_nulls_last("profit_margin_pct"), "sub_category").limit(1)


def _deep_discount(found: Evidence) -> DataFrame:
    totals = found.subcategories.agg(
        F.sum("n_deep").alias("n"),
        percent(F.sum("n_deep_loss"), F.sum("n_deep")).alias("loss_rate"),
        percent(F.sum("n_loss"), F.sum("n_lines")).alias("baseline"),
        # Most deep-discount lines first, the name decides a tie.
        F.min(F.struct((-F.col("n_deep")).alias("negative"), "sub_category")).alias("top"),
    ).filter(F.col("n") > 0)
    return totals.select(
        "n", "loss_rate", "baseline", F.col("top.sub_category").alias("sub_category"),
        percent(-F.col("top.negative"), F.col("n")).alias("share"))


def _overall(found: Evidence) -> DataFrame:
    return found.cube.agg(
        F.sum("n_orders").alias("total_orders"), F.round(F.sum("sum_sales"), 2).alias("revenue"),
        or_zero(percent(F.sum("sum_profit"), F.sum("sum_sales"))).alias("margin"),
    ).filter(F.col("total_orders") > 0)


# -- wording ----------------------------------------------------------------------

def _pct(name: str | Column) -> Column:
    """One decimal, rounded half up from the exact value."""
    value = F.col(name) if isinstance(name, str) else name
    return F.concat(F.round(value, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))


def _whole(name: str) -> Column:
    return F.format_number(F.round(F.col(name), 0).cast("decimal(24,0)"), 0)


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _finding(frame: DataFrame, number: int, subject: Column, evidence: Column, value: str,
             baseline: str | None, n: str | None) -> DataFrame:
    empty = F.lit(None)
    return frame.select(
        F.lit(number).alias("finding_no"),
        subject.alias("subject"),
        evidence.alias("evidence"),
        F.round(value, 6).cast("double").alias("value"),
        (F.round(baseline, 6) if baseline else empty).cast("double").alias("baseline"),
        (F.col(n) if n else empty).cast("bigint").alias("n"),
    )


def findings(found: Evidence) -> DataFrame:
    """Up to four findings: what they are about, the figures, and the value beside its baseline.
    They state numbers only; causes and actions are for the reader.
    """
    limit = f"{plain(Decimal(found.limit) * 100)}%"
    state, part, mode = F.col("state"), F.col("sub_category"), F.col("ship_mode")
    rows = [
        _finding(
            _top_priority(found), 1, state,
            _say("loss-making orders ", _pct("loss_rate_pct"), " of ", _whole("total_orders"),
                 " (mean of states ", _pct("avg_loss_rate"), "); mean discount ",
                 _pct(F.col("avg_discount") * 100), " (other states ",
                 _pct(F.col("other_states_avg_discount") * 100), ")"),
            "loss_rate_pct", "avg_loss_rate", "total_orders"),
        _finding(
            _worst_margin(found), 2, part,
            _say("margin ", _pct("profit_margin_pct"), " on revenue ", _whole("total_revenue"),
                 ", lowest of the sub-categories"),
            "profit_margin_pct", None, None),
        _finding(
            _deep_discount(found), 3, part,
            _say(f"lines over {limit} discount: ", _whole("n"), ", loss-making ",
                 _pct("loss_rate"), " (all lines ", _pct("baseline"), "); largest share ",
                 _pct("share")),
            "loss_rate", "baseline", "n"),
        _finding(
            worst_benchmark_mode(found.cube), 4, mode,
            _say("orders over the 75th percentile of ",
                 F.round("benchmark_days", 0).cast("bigint").cast("string"), " days: ",
                 _pct("pct_over_benchmark"), " of ", _whole("total_orders")),
            "pct_over_benchmark", "benchmark_days", "total_orders"),
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("finding_no")


def insights(found: Evidence) -> DataFrame:
    """Up to five headline sentences for the overview page."""
    limit = f"{plain(Decimal(found.limit) * 100)}%"

    def line(frame: DataFrame, number: int, text: Column) -> DataFrame:
        return frame.select(F.lit(number).alias("insight_no"), text.alias("insight"))

    rows = [
        line(_top_priority(found), 1, _say(
            F.col("state"), ": loss-making orders ", _pct("loss_rate_pct"), " of ",
            _whole("total_orders"), " (mean of states ", _pct("avg_loss_rate"),
            "), mean discount ", _pct(F.col("avg_discount") * 100))),
        line(_worst_margin(found), 2, _say(
            F.col("sub_category"), ": margin ", _pct("profit_margin_pct"), " on revenue ",
            _whole("total_revenue"))),
        line(_deep_discount(found), 3, _say(
            f"Over {limit} discount: loss-making ", _pct("loss_rate"), " of ", _whole("n"), " lines")),
        line(slowest_ship_mode(found.cube), 4, _say(
            F.col("ship_mode"), ": mean delivery ",
            F.round("avg_delivery_days", 1).cast("decimal(20,1)").cast("string"),
            " days, over its benchmark ", _pct("pct_over_benchmark"), " of orders")),
        line(_overall(found), 5, _say(
            "All: margin ", _pct("margin"), ", orders ", _whole("total_orders"), ", revenue ",
            _whole("revenue"))),
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("insight_no")
