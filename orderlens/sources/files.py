"""Reading and writing order-line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from orderlens.operators.quality import ObservedCleaning, check_columns
from orderlens.schema import CLEAN_SCHEMA, RAW_SCHEMA


#: Partition column of the stored clean table.
YEAR = StructField("order_year", IntegerType())


def scan_raw_csv(spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA) -> DataFrame:
    """Raw export: CSV with a header in Latin-1, in which every byte decodes. All values are
    text; ``quality.clean`` reads numbers and dates and counts what it cannot read.

    The columns are matched to the header by name, so a missing heading fails before any
    job runs and their order does not matter. The files of a folder must have one header:
    a file whose header differs from the first one's fails when it is read.
    """
    options = {"header": True, "encoding": "ISO-8859-1", "escape": '"'}
    first = spark.read.options(**options).csv(path)
    check_columns(first, [f.name for f in schema])
    # Without enforceSchema every file's own header is held against the schema.
    text = spark.read.options(**options, enforceSchema=False).schema(first.schema).csv(path)
    return text.select(*[F.col(f"`{f.name}`") for f in schema])


def scan_clean(spark: SparkSession, path: str, schema: StructType = CLEAN_SCHEMA,
               fmt: str = "parquet", years: tuple[int, int] | None = None) -> DataFrame:
    """Clean table, Parquet by default; CSV dates are ISO. ``years`` keeps the orders of the
    first to the last year given, reading only their folders of a Parquet table.
    """
    if fmt == "parquet":
        # Declared, so that the folder's partition column is no column of the table.
        table = spark.read.schema(StructType([*schema, YEAR])).parquet(path)
        if years:
            table = table.filter(F.col(YEAR.name).between(*years))
        return table.select(*schema.fieldNames())
    table = spark.read.schema(schema).option("header", True).option(
        "dateFormat", "yyyy-MM-dd").option("escape", '"').csv(path)
    return table.filter(F.year("order_date").between(*years)) if years else table


def write_clean(clean: DataFrame, path: str, fmt: str = "parquet", passing=None) -> None:
    """Overwrite the clean table. Parquet is split by order year, so that a date
    filter skips whole folders; rebalancing keeps files even when one year holds
    most rows, where a plain repartition would write that year in one task. ``passing``
    changes the rows on their way from that shuffle to the files.
    """
    if fmt == "parquet":
        frame = clean.withColumn("order_year", F.year("order_date")).hint("rebalance", F.col("order_year"))
        (passing(frame) if passing else frame).write.mode("overwrite").partitionBy("order_year").parquet(path)
    else:
        frame = clean.hint("rebalance") if passing else clean
        (passing(frame) if passing else frame).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def clean_and_report(raw: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the clean table of raw lines and return its report, from one job."""
    cleaning = ObservedCleaning(raw)
    write_clean(cleaning.rows, path, fmt, cleaning.passing)
    schema = cleaning.rows.select(*cleaning.columns).schema
    return cleaning.report(scan_clean(raw.sparkSession, path, schema, fmt))
