"""Column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide enough for sums over the whole fact table, narrow enough that a quotient
# keeps ten decimal places before it is rounded.
EXACT = T.DecimalType(24, 4)


def ratio(num: Column, den: Column, places: int = 2, times: int = 1) -> Column:
    """``times * num / den`` rounded half up in exact decimals; NULL when den is 0."""
    top = num.cast(EXACT)
    if times != 1:
        top = top * F.lit(times)
    return F.round(F.try_divide(top, den.cast(EXACT)), places)


def percent(num: Column, den: Column, places: int = 2) -> Column:
    return ratio(num, den, places, times=100)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(T.DecimalType(1, 0)))


def money_sum(value: str | Column) -> Column:
    return F.round(F.sum(value), 2)


def count_where(condition: Column) -> Column:
    """Rows that meet a condition: 0 when none do, NULL over an empty input."""
    return F.sum(F.when(condition, 1).otherwise(0))


def is_loss(profit: Column) -> Column:
    """Negative profit; an unknown profit is not a loss."""
    return F.coalesce(profit < 0, F.lit(False))


def discount_band(discount: Column, edges: tuple[str, ...]) -> Column:
    """Label of the discount band, upper edges included.

    ``edges`` are decimal texts, so that 0.2 is compared as exactly 0.2.
    """
    label = F.when(discount == 0, F.lit("0% (no discount)"))
    low = Decimal(0)
    for edge in edges:
        high = Decimal(edge) * 100
        label = label.when(discount <= F.lit(Decimal(edge)), F.lit(f"{_above(low)}-{plain(high)}%"))
        low = high
    return label.otherwise(F.lit(f"{_above(low)}%+"))


def plain(number: Decimal) -> str:
    """A number without trailing zeros: 40, 12.5."""
    return f"{number.normalize():f}"


def _above(percent: Decimal) -> str:
    """Where the band above a whole percentage starts; above another one it starts at once."""
    return plain(percent + 1) if percent == percent.to_integral_value() else f">{plain(percent)}"


def present(frame: DataFrame) -> DataFrame:
    """Plain output types: decimals as DOUBLE and whole numbers as BIGINT."""
    out = []
    for field in frame.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint").alias(field.name)
        out.append(column)
    return frame.select(*out)
