"""Correlations from one Gram aggregate: sums and cross products, added per order first.

Lines are added up per order and per pattern of missing values before any order attribute is
joined, so headers meet about one row per order. The rows of all orders are then added up
per pattern, and a pair of columns takes the patterns that hold both. A value that is near the
mean can be taken off each column (``shifts``): correlations do not change, and nothing is lost
where a mean is very large against the spread.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums(pairs: list[tuple[str, str]], columns: list[str]) -> list[str]:
    return [f"s_{c}" for c in columns] + [f"p_{a}_{b}" for a, b in pairs]


def line_sums(lines: DataFrame, key: list[str], columns: list[str], more: list[Column] = [],
              shifts: dict[str, float] = {}) -> DataFrame:
    """Rows, sums and products of ``columns`` per key and pattern: bit i of ``pattern`` is set where
    column i holds a value.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    near = lines.withColumns({f"x_{c}": F.coalesce(
        F.col(c).cast("double") - F.lit(float(shifts.get(c, 0))), F.lit(0.0)) for c in columns})
    pattern = reduce(Column.__add__, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)])
    return near.groupBy(*key, pattern.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x_{c}").alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"p_{a}_{b}") for a, b in pairs], *more)


def with_order_column(sums: DataFrame, columns: list[str], name: str, shift: float = 0.0) -> DataFrame:
    """The sums with one more column, whose value holds for all lines of a row."""
    bit = 1 << len(columns)
    value = F.coalesce(F.col(name).cast("double") - F.lit(float(shift)), F.lit(0.0))
    return sums.withColumns({
        "pattern": F.col("pattern") + F.when(F.col(name).isNotNull(), bit).otherwise(0),
        f"s_{name}": value * F.col("n"), f"p_{name}_{name}": value * value * F.col("n"),
        **{f"p_{c}_{name}": F.col(f"s_{c}") * value for c in columns}})


def correlations(sums: DataFrame, columns: list[str]) -> DataFrame:
    """(column_x, column_y, correlation) of all pairs, both ways; NULL, also on the diagonal,
    where a column is constant or fewer than two rows hold both values.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    patterns = sums.groupBy("pattern").agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _sums(pairs, columns)])

    def total(value: str, a: str, b: str) -> Column:
        both = (1 << columns.index(a)) | (1 << columns.index(b))
        return F.coalesce(F.sum(F.when(F.col("pattern").bitwiseAND(both) == both, F.col(value))), F.lit(0)).cast("double")

    wide = patterns.agg(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), total("n", a, b).alias("n"),
                 total(f"s_{a}", a, b).alias("x"), total(f"s_{b}", a, b).alias("y"),
                 total(f"p_{a}_{a}", a, b).alias("xx"), total(f"p_{b}_{b}", a, b).alias("yy"),
                 total(f"p_{a}_{b}", a, b).alias("xy")).alias(f"{a}|{b}") for a, b in pairs])
    cells = wide.select(F.explode(F.array(*[f"`{a}|{b}`" for a, b in pairs])).alias("pair")).select("pair.*")

    def spread(x: str, y: str, xy: str) -> Column:
        """n times the covariance; zero where it is below what the sums can tell apart."""
        products = F.col(xy) * F.col("n")
        about = products - F.col(x) * F.col(y)
        return F.when(F.abs(about) > F.abs(products) * F.lit(1e-13), about).otherwise(F.lit(0.0))

    spreads = cells.select("a", "b", spread("x", "x", "xx").alias("vx"), spread("y", "y", "yy").alias("vy"),
                           spread("x", "y", "xy").alias("vxy"))
    value = F.round(F.try_divide("vxy", F.sqrt("vx") * F.sqrt("vy")), 6)
    both_ways = F.array(F.struct("a", "b"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return (spreads.select(F.explode(F.array_compact(both_ways)).alias("cell"), value.alias("correlation"))
            .select(F.col("cell.a").alias("column_x"), F.col("cell.b").alias("column_y"), "correlation")
            .orderBy("column_x", "column_y"))
