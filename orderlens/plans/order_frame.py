"""A stored order frame that a batch of lines refreshes.

The frame holds the sums of every order, which can be added to: line counts, amounts and
the last ship date. A batch is summed per order, and only the years of the orders that it touches
are read, added to and written as a new version; all other folders stay as they are. What counts is
the list of folders in the newest marker, which is written last, with the batches that it holds: a
refresh that was killed has changed nothing, and a batch that is held already is not added twice.
One refresh at a time; versions that no marker names are removed by ``clean_up``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.measures import count_where, is_loss
from orderlens.session import hadoop_path

#: What holds for a whole order; of an order stored before, its stored values stay.
ATTRIBUTES = ["order_date", "ship_mode", "customer_id", "segment", "state", "region"]
SUMS = ["n_lines", "sum_sales", "sum_profit", "n_loss_lines", "sum_discount"]
YEAR, MARKERS = "order_year", "_versions"


def partial(lines: DataFrame) -> DataFrame:
    """The sums of some lines per order: what can be added to."""
    return lines.groupBy("order_id").agg(
        F.min(F.struct(*ATTRIBUTES)).alias("attributes"), F.max("ship_date").alias("ship_date"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("sales").alias("sum_sales"), F.sum("profit").alias("sum_profit"),
        count_where(is_loss(F.col("profit"))).alias("n_loss_lines"), F.sum("discount").alias("sum_discount"),
    ).select("order_id", *[F.col(f"attributes.{c}").alias(c) for c in ATTRIBUTES], "ship_date", *SUMS)


def current(spark: SparkSession, path: str) -> dict:
    """The newest marker: the folder of each year, the batches held, the columns; empty at first."""
    where, fs = hadoop_path(spark, f"{path}/{MARKERS}")
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(where)] if fs.exists(where) else []
    if not numbers:
        return {"version": -1, "years": {}, "batches": [], "schema": None}
    stream = fs.open(hadoop_path(spark, f"{path}/{MARKERS}/{max(numbers)}")[0])
    found = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    return found


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The order frame as it is now, with the delivery days."""
    return _read(spark, path, current(spark, path)).withColumn(
        "delivery_days", F.date_diff("ship_date", "order_date"))


def _read(spark: SparkSession, path: str, state: dict, years: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    folders = [f"{path}/{folder}" for year, folder in state["years"].items() if years is None or year in years]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def refresh(lines: DataFrame, path: str, batch: str) -> list[str]:
    """Add a batch of lines; the years that were written anew, none where the batch is held."""
    spark = lines.sparkSession
    state = current(spark, path)
    if batch in state["batches"]:
        return []
    version = state["version"] + 1
    columns = partial(lines)
    state["schema"] = state["schema"] or json.loads(columns.schema.json())
    base = f"v{version}"

    # The batch's own sums are read twice: for the years they touch and to be added.
    columns.write.mode("overwrite").parquet(f"{path}/{base}/batch")
    own = spark.read.schema(columns.schema).parquet(f"{path}/{base}/batch")
    # An order stays in the year it was stored in, whatever date a late line has.
    ends = own.agg(F.min("order_id").alias("low"), F.max("order_id").alias("high")).first()
    everything = _read(spark, path, state).filter(F.col("order_id").between(ends["low"], ends["high"]))
    known = everything.select("order_id", F.year("order_date").alias("stored_year")).join(
        own.select("order_id"), "order_id", "left_semi")
    dated = own.join(known, "order_id", "left").withColumn(YEAR, F.coalesce("stored_year", F.year("order_date")))
    touched = [str(r[0]) for r in dated.select(YEAR).distinct().collect()]

    stored = _read(spark, path, state, touched)
    both = stored.withColumn("late", F.lit(0)).unionByName(own.withColumn("late", F.lit(1)))
    first = F.min_by(F.struct(*ATTRIBUTES), "late").alias("attributes")
    merged = both.groupBy("order_id").agg(
        first, F.max("ship_date").alias("ship_date"), *[F.sum(c).alias(c) for c in SUMS]).select(
        "order_id", *[F.col(f"attributes.{c}").alias(c) for c in ATTRIBUTES], "ship_date",
        *[F.col(c).cast(T.StructType.fromJson(state["schema"])[c].dataType).alias(c) for c in SUMS])
    merged.withColumn(YEAR, F.year("order_date")).hint("rebalance", F.col(YEAR)).write.mode(
        "overwrite").partitionBy(YEAR).parquet(f"{path}/{base}/years")

    # A date that is missing has a folder of that name.
    names = {"None": "__HIVE_DEFAULT_PARTITION__"}
    state["years"] |= {y: f"{base}/years/{YEAR}={names.get(y, y)}" for y in touched}
    state |= {"version": version, "batches": [*state["batches"], batch]}
    _mark(spark, f"{path}/{MARKERS}/{version}", state)
    where, fs = hadoop_path(spark, f"{path}/{base}/batch")
    fs.delete(where, True)
    return sorted(touched)


def _mark(spark: SparkSession, path: str, state: dict) -> None:
    where, fs = hadoop_path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()


def clean_up(spark: SparkSession, path: str) -> int:
    """Remove folders that the newest marker does not name, once nobody reads them; how many."""
    named = set(current(spark, path)["years"].values())
    where, fs = hadoop_path(spark, path)
    gone = 0
    for version in fs.listStatus(where):
        name = version.getPath().getName()
        years = hadoop_path(spark, f"{path}/{name}/years")[0]
        if not name.startswith("v") or not fs.exists(years):
            continue
        for folder in fs.listStatus(years):
            if folder.isDirectory() and f"{name}/years/{folder.getPath().getName()}" not in named:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone
