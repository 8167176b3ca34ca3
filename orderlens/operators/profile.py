"""Distributions and relations of the order-line columns."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.measures import count_where, is_loss, percent
from orderlens.plans.reuse import one_row
from orderlens.schema import CATEGORICAL, NUMERIC


def histogram(lines: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between minimum and maximum, the maximum in the last bin."""
    values = lines.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    limits = one_row(values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = (F.col("limits.hi") - F.col("limits.lo")) / F.lit(float(bins))
    position = F.try_divide(F.col("x") - F.col("limits.lo"), width)
    number = F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1)) + 1
    start = F.col("limits.lo") + (F.col("bin") - 1) * width
    end = F.col("limits.lo") + F.col("bin") * width
    return (
        values.withColumn("limits", limits)
        .groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("limits", limits)
        .select("bin", F.round(start, 6).alias("bin_start"), F.round(end, 6).alias("bin_end"),
                "n", F.round(F.log10("n"), 6).alias("log10_n"))
        .orderBy("bin")
    )


def loss_line_share(lines: DataFrame) -> DataFrame:
    loss = count_where(is_loss(F.col("profit")))
    return lines.agg(
        F.coalesce(loss, F.lit(0)).alias("loss_making_lines"),
        percent(loss, F.count(F.lit(1))).alias("pct_of_lines"))


def value_counts(lines: DataFrame, columns: list[str] | None = None,
                 weight: str | None = None) -> DataFrame:
    """Rows per value of several columns. Rows are counted per combination first, so the
    spreading over columns sees one row per combination. ``weight`` holds how many lines a
    row stands for.
    """
    columns = columns or CATEGORICAL
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        lines.groupBy(*columns).agg(rows.alias("n"))
        .unpivot(["n"], columns, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.sum("n").alias("n"))
        .orderBy("column_name", F.desc("n"), "value")
    )


def sample_lines(lines: DataFrame, n: int = 2000, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement, the same on every run.

    Rows are ordered by a seeded digest of their content and the first ``n`` kept. Where the
    sample ends is found in two steps: rows are counted per group of four leading digits,
    then, inside the group that the sample ends in, per group of eight. Equal rows share a
    digest and are folded to one with a count. So the final sort gets ``n`` rows and those of
    one group in four billion, whatever the number of copies.
    """
    columns = lines.columns
    text = [F.col(c).cast("string") for c in columns]
    keyed = lines.withColumn("digest", F.md5(F.concat_ws("|", F.lit(str(seed)), *text)))
    end = _sample_end(keyed.select("digest"), 8, n)
    folded = (keyed.filter(F.substring("digest", 1, 8) <= end["lead"])
              .groupBy("digest", *columns).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("copies")))
    return (folded.orderBy("digest", *columns).limit(n)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .orderBy("digest", *columns).limit(n).select(*columns))


def _sample_end(digests: DataFrame, digits: int, n: int) -> Column:
    """(lead, before): the group of leading digits in which the n-th smallest digest lies, and
    the rows before it. The groups counted are those inside the end of the coarser grouping,
    65,536 at most.
    """
    before = F.lit(0)
    if digits > 4:
        coarse = _sample_end(digests, digits - 4, n)
        digests = digests.filter(F.substring("digest", 1, digits - 4) == coarse["lead"])
        before = coarse["before"]
    counts = digests.groupBy(F.substring("digest", 1, digits).alias("lead")).agg(
        F.count(F.lit(1)).alias("k"))
    earlier = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0)) + before)
    last = F.max(F.struct("lead", "before")).alias("end")
    return one_row(reached.filter(F.col("before") < n).agg(last))["end"]


def correlation_matrix(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson coefficients in long form, all pairs from one aggregate; NULL, also on the
    diagonal, where a column is constant or fewer than two rows hold both values.
    """
    columns = columns or NUMERIC
    pairs = list(combinations_with_replacement(columns, 2))
    values = lines.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def both(a: str, b: str, value: Column) -> Column:
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), value)

    wide = values.agg(*[
        F.struct(F.covar_pop(a, b).alias("xy"),
                 F.stddev_pop(both(a, b, F.col(a))).alias("x"),
                 F.stddev_pop(both(a, b, F.col(b))).alias("y")).alias(f"{a}|{b}")
        for a, b in pairs])
    cells = [(a, b, F.try_divide(F.col(f"`{a}|{b}`.xy"), F.col(f"`{a}|{b}`.x") * F.col(f"`{a}|{b}`.y")))
             for a, b in pairs]
    cells += [(b, a, value) for a, b, value in cells if a != b]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_x"), F.lit(b).alias("column_y"),
                 F.round(value, 6).alias("correlation"))
        for a, b, value in cells
    ])).alias("cell")).select("cell.*").orderBy("column_x", "column_y")


def head(frame: DataFrame, n: int, *order: str) -> DataFrame:
    """First rows under an explicit order."""
    return frame.orderBy(*order).limit(n)
