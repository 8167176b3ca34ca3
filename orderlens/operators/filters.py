"""The shared filter set: regions, categories, ship modes and a date range."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Empty lists and missing dates filter nothing; both date ends are included."""

    regions: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    ship_modes: tuple[str, ...] = ()
    start: date | None = None
    end: date | None = None

    def order_conditions(self) -> list[Column]:
        """Conditions on attributes that hold for a whole order."""
        found = []
        if self.regions:
            found.append(F.col("region").isin(*self.regions))
        if self.ship_modes:
            found.append(F.col("ship_mode").isin(*self.ship_modes))
        if self.start is not None:
            found.append(F.col("order_date") >= F.lit(self.start))
        if self.end is not None:
            found.append(F.col("order_date") <= F.lit(self.end))
        return found

    def line_conditions(self) -> list[Column]:
        """Conditions that may keep some lines of an order and drop others."""
        return [F.col("category").isin(*self.categories)] if self.categories else []

    def order_columns(self) -> list[str]:
        used = []
        if self.regions:
            used.append("region")
        if self.ship_modes:
            used.append("ship_mode")
        if self.start is not None or self.end is not None:
            used.append("order_date")
        return used

    def line_columns(self) -> list[str]:
        return ["category"] if self.categories else []


NO_FILTERS = Filters()


def keep(frame: DataFrame, conditions: list[Column]) -> DataFrame:
    return frame.filter(reduce(Column.__and__, conditions)) if conditions else frame


def filter_lines(lines: DataFrame, filters: Filters) -> DataFrame:
    """Lines that meet every filter; Catalyst pushes each one into its own scan."""
    return keep(lines, filters.order_conditions() + filters.line_conditions())


def filter_domains(lines: DataFrame) -> DataFrame:
    """What the filter widgets offer: (field, value), one row per choice and the
    first and last order date. One pass; only combinations of choices are spread over fields.
    """
    choices = ["region", "category", "ship_mode"]
    per_value = (
        lines.groupBy(*choices)
        .agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))
        .unpivot(["first_day", "last_day"], choices, "field", "value")
        .groupBy("field", "value")
        .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    )
    # From here on one row per choice. The dates of one field cover all lines.
    day = F.lit("order_date").alias("field")
    entries = F.array(
        F.struct("field", "value", F.col("value").alias("choice")),
        *[F.struct(day, F.when(F.col("field") == choices[0], F.col(d).cast("string")).alias("value"),
                   F.lit(None).cast("string").alias("choice"))
          for d in ("first_day", "last_day")],
    )
    return (
        per_value.select(F.explode(entries).alias("entry")).select("entry.*")
        .filter(F.col("value").isNotNull())
        .groupBy("field", "choice").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .select("field", F.explode(F.array_distinct(F.array("low", "high"))).alias("value"))
        .orderBy("field", "value")
    )


def has_rows(lines: DataFrame) -> bool:
    """Guard for callers that must stop on an empty selection."""
    return not lines.isEmpty()
