"""Cleaning, validation and profiling of raw order lines.

Nothing is filled in and nothing dropped but exact duplicate rows; what is
wrong is counted and flagged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.measures import count_where, is_loss
from orderlens.schema import CATEGORICAL, RAW_TYPES

# The raw date format (one or two digits) and the quality flags.
RAW_DATE_FORMAT = "M/d/yyyy"
FLAG_OK = "ok"
FLAG_SHIP_BEFORE_ORDER = "ship_before_order"


# -- column names -------------------------------------------------------------

def check_columns(frame: DataFrame, expected: list[str]) -> None:
    """Fail before any job runs when a required column is missing."""
    missing = [c for c in expected if c not in frame.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")


def clean_name(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


#: The number columns of the raw form, by their clean names.
NUMBERS = {clean_name(c): kind for c, kind in RAW_TYPES.items()}


def normalize_columns(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[clean_name(c) for c in frame.columns])


def column_types(frame: DataFrame) -> DataFrame:
    """Type of every column and how many values it holds."""
    return _per_column(frame, lambda c: F.count(c), "n_values", with_type=True)


# -- counts per column --------------------------------------------------------

def _per_column(frame: DataFrame, measure, name: str, with_type: bool = False) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    fields = frame.schema.fields
    wide = frame.agg(*[measure(F.col(f"`{f.name}`")).alias(f"m{i}") for i, f in enumerate(fields)])
    cells = []
    for i, f in enumerate(fields):
        parts = [F.lit(f.name).alias("column_name")]
        if with_type:
            parts.append(F.lit(f.dataType.simpleString()).alias("data_type"))
        cells.append(F.struct(*parts, F.col(f"m{i}").cast("bigint").alias(name)))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def _nulls(value: Column) -> Column:
    return F.coalesce(count_where(value.isNull()), F.lit(0))


def null_profile(frame: DataFrame) -> DataFrame:
    return _per_column(frame, _nulls, "n_null")


def dataset_overview(lines: DataFrame, n_columns: int | None = None) -> DataFrame:
    """Size and date range. ``n_columns`` is the width of the whole table where
    ``lines`` holds only the columns read here."""
    return lines.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_columns or len(lines.columns)).alias("n_columns"),
        F.count_distinct("order_id").alias("n_orders"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )


# -- duplicates ---------------------------------------------------------------

def dedup_lines(frame: DataFrame) -> DataFrame:
    return frame.dropDuplicates()


def dedup_report(frame: DataFrame) -> DataFrame:
    """Rows before and after removing exact duplicates."""
    copies = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_removed"),
    )


def duplicate_keys(frame: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and the rows beyond the first of each."""
    repeated = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_repeats"),
    )


def order_fd_check(lines: DataFrame, attributes: list[str]) -> DataFrame:
    """Orders in which an attribute that should be constant takes several values.

    Equal rows are folded first, which leaves one row of every consistent order.
    Minimum against maximum then decides all attributes in one aggregate, where
    distinct counts would multiply the rows by the attributes.
    """
    kept = lines.select("order_id", *attributes).distinct()
    spans = kept.groupBy("order_id").agg(*[
        (F.min(a) != F.max(a)).alias(a) for a in attributes])
    return _per_column(
        spans.drop("order_id"), lambda c: F.coalesce(count_where(c), F.lit(0)), "n_orders")


# -- numbers and dates --------------------------------------------------------

def parse_numbers(frame: DataFrame) -> DataFrame:
    """Text to number for the columns that hold numbers; NULL for what is no number or does
    not fit its type exactly. Columns that hold numbers already stay as they are.
    """
    def exact(column: str, kind: T.DataType) -> Column:
        wide = F.trim(F.col(column)).try_cast(T.DecimalType(38, 12))
        narrow = wide.try_cast(kind)
        return F.when(narrow.cast(T.DecimalType(38, 12)) == wide, narrow)

    texts = {f.name for f in frame.schema if isinstance(f.dataType, T.StringType)}
    return frame.withColumns({
        c: exact(c, kind) for c, kind in NUMBERS.items() if c in texts})


def parse_dates(frame: DataFrame, *columns: str) -> DataFrame:
    """Text to date; what does not parse becomes NULL. A text without the slash of the format
    is not tried: a failed attempt costs many times what a date does.
    """
    def date(column: str) -> Column:
        parsed = F.try_to_date(F.col(column), RAW_DATE_FORMAT)
        return F.when(F.contains(column, F.lit("/")), parsed) if column in texts else parsed

    texts = {f.name for f in frame.schema if isinstance(f.dataType, T.StringType)}
    return frame.withColumns({c: date(c) for c in columns})


def derive_delivery_days(frame: DataFrame) -> DataFrame:
    return frame.withColumn("delivery_days", F.date_diff("ship_date", "order_date"))


def quality_flag(frame: DataFrame) -> DataFrame:
    """Flags a shipment dated before its order; an unknown date is not flagged."""
    early = F.col("ship_date") < F.col("order_date")
    return frame.withColumn(
        "data_quality_flag", F.when(early, FLAG_SHIP_BEFORE_ORDER).otherwise(FLAG_OK))


def quality_flag_counts(frame: DataFrame, weight: str | None = None) -> DataFrame:
    """Lines per flag; ``weight`` holds how many lines a row stands for."""
    return frame.groupBy("data_quality_flag").agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).orderBy(F.desc("n"), "data_quality_flag")


def derive_loss_flag(frame: DataFrame) -> DataFrame:
    return frame.withColumn("is_loss_line", is_loss(F.col("profit")))


# -- values -------------------------------------------------------------------

def _range_rules() -> dict[str, Column]:
    discount = F.col("discount")
    return {
        "quantity<=0": F.col("quantity") <= 0,
        "sales<=0": F.col("sales") <= 0,
        "discount outside [0,1]": (discount < 0) | (discount > 1),
    }


def range_checks(frame: DataFrame) -> DataFrame:
    flags = frame.select(*[rule.alias(name) for name, rule in _range_rules().items()])
    return _per_column(
        flags, lambda c: F.coalesce(count_where(c), F.lit(0)), "n_bad"
    ).withColumnRenamed("column_name", "check_name")


def trim_categories(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return frame.withColumns({c: F.trim(c) for c in columns or CATEGORICAL})


def categorical_profile(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per categorical column after trimming.

    The values are combined map-side, so only distinct ones are shuffled.
    """
    columns = columns or CATEGORICAL
    values = trim_categories(frame.select(*columns), columns).unpivot(
        [], columns, "column_name", "value")
    return values.distinct().groupBy("column_name").agg(
        F.count("value").alias("n_distinct")).orderBy("column_name")


# -- the whole cleaning step ----------------------------------------------------

def clean(raw: DataFrame) -> DataFrame:
    """Raw order lines to the clean table, as one lazy plan."""
    frame = parse_numbers(dedup_lines(normalize_columns(raw)))
    frame = parse_dates(frame, "order_date", "ship_date")
    frame = quality_flag(derive_delivery_days(frame))
    return derive_loss_flag(trim_categories(frame))


#: A check of one row: its step, name, column and what it finds in the row.
Check = tuple[int, str, str | None, Column]


def _kept_rows(raw: DataFrame) -> tuple[DataFrame, list[Check]]:
    """The rows that remain without duplicates, cleaned, beside the number of their ``copies`` and
    their raw dates and numbers; and the checks of a row.
    """
    frame = normalize_columns(raw)
    columns = frame.columns
    kept = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    dates, numbers = ["order_date", "ship_date"], [c for c in NUMBERS if c in columns]
    parsed = parse_numbers(parse_dates(
        kept.withColumns({f"raw_{c}": F.col(c) for c in dates + numbers}), *dates))
    cleaned = derive_loss_flag(trim_categories(quality_flag(derive_delivery_days(parsed))))

    checks: list[Check] = []
    for c in columns:
        before = F.col(f"raw_{c}") if c in dates + numbers else F.col(c)
        checks.append((2, "missing values", c, before.isNull()))
    checks += [(3, "unparseable dates", c, F.col(c).isNull()) for c in dates]
    checks += [(4, "unparseable numbers", c, F.col(f"raw_{c}").isNotNull() & F.col(c).isNull())
               for c in numbers]
    checks.append((5, "ship_date before order_date", None, F.col("ship_date") < F.col("order_date")))
    checks += [(6, name, None, rule) for name, rule in _range_rules().items()]
    checks.append((8, "loss-making lines", None, is_loss(F.col("profit"))))
    return cleaned, checks


ROWS_READ = (1, "rows read", None)
ROWS_REMOVED = (1, "duplicate rows removed", None)
VALUES = (7, "distinct values after trimming")
REPORT_COLUMNS = "step INT, check_name STRING, column_name STRING, n_rows BIGINT"


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def cleaning_report(raw: DataFrame) -> DataFrame:
    """What the cleaning finds: (step, check_name, column_name, n_rows).

    One pass: the rows are grouped to drop duplicates, and the findings are counted on what
    remains, per combination of categories first. So the distinct values are taken from one row per
    combination.
    """
    kept, checks = _kept_rows(raw)
    counts = {"read": F.sum("copies"), "removed": F.sum(F.col("copies") - 1)}
    counts |= {f"c{i}": count_where(rule) for i, (*_, rule) in enumerate(checks)}
    combined = kept.groupBy(*CATEGORICAL).agg(*[value.alias(name) for name, value in counts.items()])
    about = [ROWS_READ, ROWS_REMOVED, *[tuple(a) for *a, _ in checks]]
    found = [(*a, _zero(F.sum(name))) for a, name in zip(about, counts)]
    found += [(*VALUES, c, F.count_distinct(c)) for c in CATEGORICAL]
    wide = combined.agg(*[value.alias(f"m{i}") for i, (*_, value) in enumerate(found)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(step).alias("step"), F.lit(name).alias("check_name"),
                 F.lit(column).cast("string").alias("column_name"), F.col(f"m{i}").alias("n_rows"))
        for i, (step, name, column, _) in enumerate(found)
    ])).alias("cell")).select("cell.*").orderBy("step", "check_name", "column_name")


class ObservedCleaning:
    """The clean table and what the cleaning found, from one job over one scan of the raw lines.

    ``write(sink)`` hands the clean rows to the sink, which writes them in one action; the figures
    of ``cleaning_report`` are counted as the rows pass. They are counted in the tasks that write
    (``passing``), behind the last shuffle: a task that is run again replaces its figures there, while
    those of an earlier stage could count twice. Up to that shuffle a row carries its findings as the
    bits of whole numbers.

    The distinct values of a column are counted by a sketch of bounded size, which is exact up to
    ``most_values`` values; a column with more of them is counted from the written table.
    """

    #: Findings in one whole number.
    BITS = 60

    def __init__(self, raw: DataFrame, most_values: int = 2000):
        kept, self.checks = _kept_rows(raw)
        self.spark, self.most_values = raw.sparkSession, most_values
        self.columns = [c for c in kept.columns if c != "copies" and not c.startswith("raw_")]
        groups = [self.checks[i:i + self.BITS] for i in range(0, len(self.checks), self.BITS)]
        self.marks = [f"found_{i}" for i in range(len(groups))]
        bits = [reduce(Column.__add__, [F.when(rule, F.lit(1 << k)).otherwise(0).cast("bigint")
                                        for k, (*_, rule) in enumerate(group)]) for group in groups]
        self.rows = kept.select(*self.columns, "copies", *[b.alias(m) for b, m in zip(bits, self.marks)])
        self.observation = Observation()

    def passing(self, rows: DataFrame) -> DataFrame:
        """The rows as they are written, counted as they pass; the findings end here."""
        values = {"read": F.sum("copies"), "removed": F.sum(F.col("copies") - 1)}
        for i in range(len(self.checks)):
            mark, bit = self.marks[i // self.BITS], 1 << (i % self.BITS)
            values[f"c{i}"] = count_where(F.col(mark).bitwiseAND(F.lit(bit)) != 0)
        for c in CATEGORICAL:
            top = f"approx_top_k({c}, {self.most_values + 2}, {4 * self.most_values + 8})"
            values[f"v_{c}"] = F.expr(f"size(filter({top}, x -> x.item IS NOT NULL))")
        return rows.observe(self.observation, *[v.alias(k) for k, v in values.items()]).drop(
            "copies", *self.marks)

    def report(self, written: DataFrame) -> DataFrame:
        """The report, once the rows have been written; ``written`` is the table read back."""
        found = self.observation.get
        rows = [(*ROWS_READ, found["read"] or 0), (*ROWS_REMOVED, found["removed"] or 0)]
        rows += [(*about, found[f"c{i}"] or 0) for i, (*about, _) in enumerate(self.checks)]
        values = {c: max(found[f"v_{c}"] or 0, 0) for c in CATEGORICAL}
        many = [c for c, n in values.items() if n > self.most_values]
        rows += [(*VALUES, c, n) for c, n in values.items() if c not in many]
        table = self.spark.createDataFrame(rows, REPORT_COLUMNS)
        if many:
            counted = categorical_profile(written, many).select(
                F.lit(VALUES[0]).alias("step"), F.lit(VALUES[1]).alias("check_name"), "column_name",
                F.col("n_distinct").alias("n_rows"))
            table = table.unionByName(counted)
        return table.orderBy("step", "check_name", "column_name")


# -- constraints ----------------------------------------------------------------

def line_rules() -> dict[str, Column]:
    """Rules a line must meet to enter the star schema."""
    return {
        "delivery_days >= 0": F.col("delivery_days") >= 0,
        "ship_date >= order_date": F.col("ship_date") >= F.col("order_date"),
        "sales >= 0": F.col("sales") >= 0,
        "quantity > 0": F.col("quantity") > 0,
        "discount between 0 and 1": F.col("discount").between(0, 1),
    }


def stored_rules() -> dict[str, Column]:
    """What the exact arithmetic takes for granted of the stored prices and quantities."""
    def hundredths(column: str) -> Column:
        return F.abs(F.col(column) * 100 - F.round(F.col(column) * 100)) <= 1e-6

    return line_rules() | {
        "whole quantity": F.col("stored_quantity") == F.round("stored_quantity"),
        "amounts in hundredths": hundredths("stored_price") & hundredths("stored_discount"),
        "price in hundredths": hundredths("retail_price"),
    }


def _broken(rule: Column) -> Column:
    """A CHECK is broken only when it is false; NULL passes."""
    return F.coalesce(~rule, F.lit(False))


def quarantine_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines a load would accept, and the others with the rules they break."""
    names = F.array_compact(F.array(*[
        F.when(_broken(rule), F.lit(name)) for name, rule in line_rules().items()]))
    marked = lines.withColumn("broken_rules", F.array_join(names, "; "))
    good = marked.filter(F.col("broken_rules") == "").drop("broken_rules")
    return good, marked.filter(F.col("broken_rules") != "")


def constraint_violations(tables: dict[str, DataFrame], keys: dict[str, list[str]],
                          not_null: dict[str, list[str]], checks: dict[str, list[str]],
                          lengths: dict[str, dict[str, int]],
                          references: list[tuple[str, str, str]],
                          parents: dict[str, DataFrame] | None = None,
                          found: dict[tuple[str, str], str] | None = None,
                          counted: dict[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """Violations per rule: (rule, n_violations).

    A key is broken by every row beyond the first, a reference by every row whose
    value has no parent; ``parents`` holds what a reference points to where that is
    not one of the tables. All rules of one table but its references share a pass:
    flags are summed per key, which the uniqueness check groups by anyway. For a
    reference the rows are counted per value first, so a hot value meets the parents once.

    Two kinds of references need no pass of their own: where the table has met its parents already
    and a column is true where there was one (``found``), and where (key, n_rows) of the values that
    may have none are known (``counted``).
    """
    parents = tables | (parents or {})
    found, counted = found or {}, counted or {}
    parts = []
    for table, key in keys.items():
        known = {f"{table}.{column} references {parent}": F.col(column).isNotNull() & F.col(found[child, column]).isNull()
                 for child, column, parent in references if child == table and (child, column) in found}
        parts.append(_table_violations(
            tables[table], table, key, not_null.get(table, []), checks.get(table, []),
            lengths.get(table, {}), known))
    for child, column, parent in references:
        if (child, column) in found:
            continue
        if (child, column) in counted:
            per_value = counted[child, column].select(F.col("key").alias(column), F.col("n_rows").alias("k"))
        else:
            per_value = tables[child].filter(F.col(column).isNotNull()).groupBy(column).agg(
                F.count(F.lit(1)).alias("k"))
        orphans = per_value.join(parents[parent].select(column), column, "left_anti")
        parts.append(orphans.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_violations")).select(
            F.lit(f"{child}.{column} references {parent}").alias("rule"), "n_violations"))
    return reduce(DataFrame.unionByName, parts).orderBy("rule")


def _table_violations(frame: DataFrame, table: str, key: list[str], not_null: list[str],
                      checks: list[str], lengths: dict[str, int], references: dict[str, Column]) -> DataFrame:
    rules = stored_rules()
    flags = {f"{table}.{c} not null": F.col(c).isNull() for c in not_null}
    flags |= {f"{table}: {name}": _broken(rules[name]) for name in checks}
    flags |= {f"{table}.{c} at most {n} characters": _broken(F.length(c) <= n)
              for c, n in lengths.items()}
    flags |= references
    per_key = frame.groupBy(*key).agg(
        (F.count(F.lit(1)) - 1).alias("repeats"),
        *[count_where(flag).alias(f"f{i}") for i, flag in enumerate(flags.values())])
    sums = [F.sum("repeats").alias("repeats")]
    sums += [F.sum(f"f{i}").alias(f"f{i}") for i in range(len(flags))]
    labels = {f"{table} unique ({', '.join(key)})": "repeats"}
    labels |= {name: f"f{i}" for i, name in enumerate(flags)}
    cells = F.array(*[
        F.struct(F.lit(name).alias("rule"),
                 F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_violations"))
        for name, c in labels.items()])
    return per_key.agg(*sums).select(F.explode(cells).alias("cell")).select("cell.*")
