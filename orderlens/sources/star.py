"""The stored star schema: loaded in batches, laid out by order, read where it can matter.

A table is a folder with one folder per batch. Headers and items lie below that in a folder per
year of the order, and inside it in files that each hold one range of orders, in order. So a date
filter skips folders, a filter on orders skips files and row groups, and a year or an order that
holds most rows is still many files.

Every batch has the ranges of keys of its files beside it. A load compares the keys of its rows
with those files only that hold keys of its own ranges, so what it reads follows the batch and not
what is stored.

A batch is written whole, table by table, into folders that carry its number, and counts once its
marker is written, which comes last: the five tables appear together, as after one
transaction. A batch adds the keys that no earlier batch holds. Loading it again compares with the
same earlier batches and overwrites the same folders, so a replay changes nothing, also after
a load was killed between two tables. Batches are loaded in the order of their numbers, by one
writer at a time; the lines of a number that counts stay the same.

Places are numbered without gaps, going on from the highest number of the earlier batches.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators.filters import Filters, filter_lines
from orderlens.schema import STAR_KEYS, STAR_TABLES, star_schema
from orderlens.session import hadoop_path
from orderlens.sources.dimensions import (  # noqa: F401  (what is built and what is stored, together)
    HEADER_COLUMNS, PLACE, PLACE_COLUMNS, YEAR, build_star, dense_ids, dim_customers, dim_locations,
    dim_products, fact_order_items, first_per_key, load_audit, new_rows, order_headers, same_key, sold_products,
    star_view,
)

#: Ranges that the keys of a batch are cut into to find the files that may hold them.
RANGES = 16
MARKERS, SCHEMAS, KEY_RANGES, STAGING = "_batches", "_schemas", "_ranges", "_staging"


# -- batches ------------------------------------------------------------------

def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that count, ascending."""
    where, fs = hadoop_path(spark, f"{folder}/{MARKERS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def commit(spark: SparkSession, folder: str, batch: int) -> None:
    """From now on the batch counts."""
    where, fs = hadoop_path(spark, f"{folder}/{MARKERS}/{batch}")
    fs.create(where, True).close()


def batch_path(folder: str, table: str, batch: int) -> str:
    return f"{folder}/{table}/batch={batch}"


# -- layout -------------------------------------------------------------------

def stored_schema(spark: SparkSession, folder: str, table: str) -> T.StructType:
    """Columns of a stored table, with those that its folders stand for."""
    where, fs = hadoop_path(spark, f"{folder}/{SCHEMAS}/{table}")
    stream = fs.open(where)
    kept = T.StructType.fromJson(json.loads(bytes(stream.readAllBytes())))
    stream.close()
    return kept.add("batch", T.IntegerType())


def write_batch(rows: DataFrame, folder: str, table: str, batch: int, key: list[str]) -> None:
    """Overwrite a table's part of a batch: headers and items by year and order, others by key."""
    by = [YEAR] if YEAR in rows.columns else []
    order = list(dict.fromkeys([*by, *(["order_id"] if by else []), *key]))
    where, fs = hadoop_path(rows.sparkSession, f"{folder}/{SCHEMAS}/{table}")
    out = fs.create(where, True)
    out.write(bytearray(rows.schema.json().encode()))
    out.close()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy(*by).parquet(batch_path(folder, table, batch))


def read_batches(spark: SparkSession, folder: str, table: str, among: list[int],
                 paths: list[str] | None = None) -> DataFrame:
    """What batches hold of a table, or some of their files."""
    schema = stored_schema(spark, folder, table)
    paths = [batch_path(folder, table, b) for b in among] if paths is None else paths
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{table}").parquet(*paths)


def key_ranges(rows: DataFrame, column: str) -> list[tuple]:
    """The lowest and highest key in each of RANGES ranges."""
    dealt = rows.select(column).repartitionByRange(RANGES, column)
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(column).alias("low"), F.max(column).alias("high"))
    return [(r["low"], r["high"]) for r in found.collect() if r["low"] is not None]


def inside(column: str, ranges: list[tuple]) -> Column:
    return reduce(Column.__or__, [F.col(column).between(low, high) for low, high in ranges], F.lit(False))


def file_ranges(spark: SparkSession, folder: str, table: str, batch: int, column: str) -> str:
    """Where the lowest and highest key of every file of a batch are kept: counted when first
    asked for, anew after the batch was written again.
    """
    def written(path: str) -> int:
        where, fs = hadoop_path(spark, f"{path}/_SUCCESS")
        return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else -1

    path, data = f"{folder}/{KEY_RANGES}/{table}/batch={batch}", batch_path(folder, table, batch)
    if written(path) <= written(data):
        read_batches(spark, folder, table, [batch]).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(column).alias("low"), F.max(column).alias("high")).write.mode("overwrite").parquet(path)
    return path


def files_holding(spark: SparkSession, folder: str, table: str, among: list[int], column: str,
                  ranges: list[tuple]) -> list[str]:
    """Files of these batches that may hold a key of one of the ranges."""
    if not among or not ranges:
        return []
    known = spark.read.parquet(*[file_ranges(spark, folder, table, b, column) for b in among])
    touched = [(F.col("low") <= high) & (F.col("high") >= low) for low, high in ranges]
    return [r["file"] for r in known.filter(reduce(Column.__or__, touched)).select("file").collect()]


def stored_near(spark: SparkSession, folder: str, table: str, among: list[int], column: str,
                ranges: list[tuple]) -> DataFrame:
    """Stored rows of these batches whose key lies in one of the ranges."""
    files = files_holding(spark, folder, table, among, column, ranges)
    return read_batches(spark, folder, table, among, files).filter(inside(column, ranges))


# -- loading ------------------------------------------------------------------

def load_star(star: dict[str, DataFrame], folder: str, keys: dict[str, list[str]] = STAR_KEYS,
              batch: int | None = None, stage: bool = True) -> int:
    """Add what is new of all five tables as one batch, the next one by default; its number.
    A number that counts already is a replay. The items are staged with the others, unless
    they come from a stored table.
    """
    spark = star["orders"].sparkSession
    counted = batches(spark, folder)
    batch = max(counted, default=-1) + 1 if batch is None else batch
    if batch not in counted and any(b > batch for b in counted):
        raise ValueError(f"batch {batch} comes before one that was loaded")
    earlier = [b for b in counted if b < batch]
    star = star | staged({t: f for t, f in star.items() if stage or t != "order_items"}, folder, batch)

    def fresh(table: str, rows: DataFrame, key: list[str], ranges: list[tuple] | None = None) -> DataFrame:
        """The rows whose key no earlier batch holds."""
        if not earlier:
            return new_rows(rows, rows.limit(0), key)
        ranges = key_ranges(rows, key[0]) if ranges is None else ranges
        return new_rows(rows, stored_near(spark, folder, table, earlier, key[0], ranges), key)

    def load(table: str) -> None:
        write_batch(fresh(table, star[table], keys[table]), folder, table, batch, keys[table])

    with ThreadPoolExecutor(2) as pool:
        apart = [pool.submit(load, table) for table in ("customers", "products")]

        places = star["locations"]
        key = [c for c in PLACE if c in places.columns]
        ranges = key_ranges(places, key[0])
        added = fresh("locations", places.drop("location_id"), key, ranges)
        highest = read_batches(spark, folder, "locations", earlier).agg(
            F.max("location_id")).first()[0] if earlier else 0
        write_batch(dense_ids(added, key, "location_id", F.lit(highest or 0)).select(*places.columns),
                    folder, "locations", batch, key)

        # Headers point to the stored number of their place.
        known = stored_near(spark, folder, "locations", [*earlier, batch], key[0], ranges)
        numbers = places.select(F.col("location_id").alias("own_id"), *key).join(
            known.select("location_id", *[F.col(c).alias(f"stored_{c}") for c in key]), same_key(key))
        orders = star["orders"].withColumnRenamed("location_id", "own_id").join(
            numbers.select("own_id", "location_id"), "own_id").select(*star["orders"].columns)
        ranges = key_ranges(star["orders"], "order_id")
        write_batch(fresh("orders", orders, keys["orders"], ranges).withColumn(YEAR, F.year("order_date")),
                    folder, "orders", batch, keys["orders"])

        # Items lie in the year of their stored header.
        years = stored_near(spark, folder, "orders", [*earlier, batch], "order_id", ranges)
        items = fresh("order_items", star["order_items"], keys["order_items"]).join(
            years.select("order_id", YEAR), "order_id", "left")
        write_batch(items.select(*star["order_items"].columns, YEAR), folder, "order_items", batch,
                    keys["order_items"])
        for one in apart:
            one.result()
    commit(spark, folder, batch)
    where, fs = hadoop_path(spark, f"{folder}/{STAGING}/batch={batch}")
    fs.delete(where, True)
    return batch


def staged(star: dict[str, DataFrame], folder: str, batch: int) -> dict[str, DataFrame]:
    """The tables of a batch as they came, computed once: every later step reads them again."""
    def stage(table: str, frame: DataFrame) -> DataFrame:
        path = f"{folder}/{STAGING}/batch={batch}/{table}"
        frame.write.mode("overwrite").parquet(path)
        return frame.sparkSession.read.schema(frame.schema).parquet(path)

    with ThreadPoolExecutor(len(star)) as pool:
        return dict(zip(star, pool.map(stage, star.keys(), star.values())))


def write_star(star: dict[str, DataFrame], folder: str, keys: dict[str, list[str]] = STAR_KEYS,
               stage: bool = True, only_sold: bool = False) -> None:
    """Store the tables, all their rows, as the first batch of a folder and replace what was stored.
    The items are staged, since clustering reads them twice, unless they come from a stored table or
    are read again for less than writing them takes. Of the products, ``only_sold`` stores those that
    the stored items hold.
    """
    spark = star["orders"].sparkSession
    where, fs = hadoop_path(spark, f"{folder}/{MARKERS}")
    fs.delete(where, True)
    items = star["order_items"]
    if stage:
        items = staged({"order_items": items}, folder, 0)["order_items"]
    keyed = {**keys, "locations": [c for c in PLACE if c in star["locations"].columns]}
    rows = {t: star[t] for t in ("locations", "customers", *["products"] * (not only_sold))}
    rows["orders"] = star["orders"].withColumn(YEAR, F.year("order_date"))
    # The tables do not depend on each other; items need the headers' years.
    with ThreadPoolExecutor(len(rows)) as pool:
        list(pool.map(lambda t: write_batch(rows[t], folder, t, 0, keyed[t]), rows))
    years = read_batches(spark, folder, "orders", [0]).select("order_id", YEAR)
    write_batch(items.join(years, "order_id", "left").select(*star["order_items"].columns, YEAR),
                folder, "order_items", 0, keyed["order_items"])
    if only_sold:
        sold = sold_products(star["products"], read_batches(spark, folder, "order_items", [0]))
        write_batch(sold, folder, "products", 0, keyed["products"])
    commit(spark, folder, 0)
    where, fs = hadoop_path(spark, f"{folder}/{STAGING}")
    fs.delete(where, True)


def create_star(spark: SparkSession, folder: str) -> None:
    """Empty tables of the declared types, replacing what was stored."""
    write_star({t: spark.createDataFrame([], star_schema(t)) for t in STAR_TABLES}, folder)


def append_new_rows(incoming: DataFrame, path: str, key: list[str], tie: str | None = None) -> None:
    """Append the new rows to a single stored table. Running it again adds nothing. The table is
    read, then appended to: one writer at a time. Of the stored keys those in the ranges that
    the batch's keys take up are read; row groups outside are skipped.
    """
    stored = incoming.sparkSession.read.parquet(path).select(*key)
    existing = stored.filter(inside(key[0], key_ranges(incoming, key[0])) | F.col(key[0]).isNull())
    new_rows(incoming, existing, key, tie).write.mode("append").parquet(path)


# -- reading ------------------------------------------------------------------

def scan_star(spark: SparkSession, folder: str, with_year: bool = False) -> dict[str, DataFrame]:
    """The five tables; headers and items ``with_year`` of the order, the column of their folders."""
    counted = batches(spark, folder)
    star = {t: read_batches(spark, folder, t, counted).drop("batch") for t in STAR_TABLES}
    return star if with_year else {t: frame.drop(YEAR) for t, frame in star.items()}


def scan_lines(spark: SparkSession, folder: str, filters: Filters) -> DataFrame:
    """The flat view of the lines that meet the filters. Dates choose folders of headers and
    items, other filters on headers choose folders of items as the headers are read.
    """
    star = scan_star(spark, folder, with_year=True)
    for table in ("orders", "order_items"):
        if filters.start is not None:
            star[table] = star[table].filter(F.col(YEAR) >= filters.start.year)
        if filters.end is not None:
            star[table] = star[table].filter(F.col(YEAR) <= filters.end.year)
    return filter_lines(star_view(star), filters)


def batch_audit(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, batch, n_rows) of the batches that count; a batch without new rows has none."""
    counted = batches(spark, folder)
    counts = [read_batches(spark, folder, t, counted).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(t).alias("table_name"), "batch", "n_rows") for t in STAR_TABLES]
    return reduce(DataFrame.unionAll, counts).orderBy("table_name", "batch")
