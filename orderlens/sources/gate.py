"""The load-time gate: which keys of a folder's base tables have no parent that counts.

Every question counts the lines whose product, order, customer, nation and region exist. The
gate finds the keys that break this once, as soon as a folder is first opened, and keeps them as
small sets. A question then leaves these keys out instead of checking all lines against whole
tables, and where there are none it checks nothing: no line is moved for a column of ``lineitem``
alone.

Three sets are kept, each with the number of rows that hold a key:

* ``line_product``: products of lines that are in no product table,
* ``line_order``: orders of lines that are no order of a customer with a known place,
* ``order_customer``: customers of orders that are no customer with a known place.

A missing key is counted with its set and left out by a filter.

A gate belongs to one state of the tables: their files' number and size and the times of
their last change and last commit are part of its name. After any load the name is another one, so that a stale
gate is never found; the next question finds the keys anew. Its marker is written last, so a
gate whose making was interrupted is not found either.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import hadoop_path, shared_folder

#: Tables whose state a gate depends on.
CHECKED = ["region", "nation", "customer", "part", "orders", "lineitem"]
SETS = ["line_product", "line_order", "order_customer"]


@dataclass(frozen=True)
class KeySet:
    """Keys without a parent, and the rows whose key is missing."""

    n_keys: int
    n_missing: int


@dataclass(frozen=True)
class Gate:
    spark: SparkSession
    path: str
    sets: dict[str, KeySet]

    def keys(self, name: str) -> DataFrame:
        """(key, n_rows) of a set."""
        return self.spark.read.schema("name STRING, key BIGINT, n_rows BIGINT").parquet(self.path).filter(
            (F.col("name") == name) & F.col("key").isNotNull()).select("key", "n_rows")

    def keep(self, frame: DataFrame, name: str, column: str) -> DataFrame:
        """The rows whose key has a parent."""
        found = self.sets[name]
        if found.n_missing:
            frame = frame.filter(F.col(column).isNotNull())
        if found.n_keys:
            frame = frame.join(self.keys(name).select(F.col("key").alias(column)), column, "left_anti")
        return frame


def table_state(spark: SparkSession, path: str) -> list:
    """Number and size of a table's files, and when it was last changed and committed to."""
    where, fs = hadoop_path(spark, path)
    status, summary = fs.getFileStatus(where), fs.getContentSummary(where)
    commit = hadoop_path(spark, f"{path}/_SUCCESS")[0] if status.isDirectory() else None
    committed = fs.getFileStatus(commit).getModificationTime() if commit and fs.exists(commit) else 0
    return [summary.getFileCount(), summary.getLength(), status.getModificationTime(), committed]


def gate_folder(spark: SparkSession, path: str) -> str:
    state = {t: table_state(spark, f"{path}/{t}.parquet") for t in CHECKED}
    name = hashlib.sha256(json.dumps([path, state], sort_keys=True).encode()).hexdigest()[:24]
    return f"{shared_folder(spark)}/gate-{name}"


def missing_parents(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, key, n_rows) of all three sets. Rows are counted per key before they meet the parents,
    so a hot key is one row there. Each set reads its own key column of the rows, once.
    """
    def missing(name: str, table: str, column: str, parents: DataFrame, key: str) -> DataFrame:
        counted = tables[table].groupBy(F.col(column).cast("long").alias("key")).agg(
            F.count(F.lit(1)).alias("n_rows"))
        known = parents.select(F.col(key).cast("long").alias("key"))
        return counted.join(known, "key", "left_anti").select(F.lit(name).alias("name"), "key", "n_rows")

    places = tables["nation"].join(
        tables["region"].select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    customers = tables["customer"].join(
        places.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    orders = tables["orders"].join(
        customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return reduce(DataFrame.unionAll, [
        missing("line_product", "lineitem", "l_partkey", tables["part"], "p_partkey"),
        missing("line_order", "lineitem", "l_orderkey", orders, "o_orderkey"),
        missing("order_customer", "orders", "o_custkey", customers, "c_custkey")])


def open_gate(spark: SparkSession, path: str, table: Callable[[str], DataFrame]) -> Gate:
    """The gate of the tables as they are now: found, or made and kept for later questions. Only
    then are the tables opened.
    """
    folder = gate_folder(spark, path)
    marker, fs = hadoop_path(spark, f"{folder}/marker.json")
    if not fs.exists(marker):
        keys = f"{folder}/keys-{os.urandom(6).hex()}"
        missing_parents({t: table(t) for t in CHECKED}).write.parquet(keys)
        schema = "name STRING, key BIGINT, n_rows BIGINT"
        counts = spark.read.schema(schema).parquet(keys).groupBy("name").agg(
            F.count("key").alias("n_keys"), F.sum(F.when(F.col("key").isNull(), F.col("n_rows"))).alias("n_missing"))
        found = {r["name"]: [r["n_keys"], r["n_missing"] or 0] for r in counts.collect()}
        out = fs.create(marker, True)
        out.write(bytearray(json.dumps({"keys": keys, "sets": found}).encode()))
        out.close()
        fs.deleteOnExit(hadoop_path(spark, folder)[0])
    stream = fs.open(marker)
    kept = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    sets = {name: KeySet(*kept["sets"].get(name, [0, 0])) for name in SETS}
    return Gate(spark, kept["keys"], sets)


def gate_report(gate: Gate) -> DataFrame:
    """(key_set, n_keys, n_rows): keys without a parent and the rows that hold one, a missing key
    among the rows only.
    """
    rows = gate.spark.read.schema("name STRING, key BIGINT, n_rows BIGINT").parquet(gate.path)
    found = rows.groupBy("name").agg(F.count("key").alias("n_keys"), F.sum("n_rows").alias("n_rows"))
    names = gate.spark.createDataFrame([(n,) for n in SETS], "name STRING")
    return names.join(found, "name", "left").select(
        F.col("name").alias("key_set"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows")).orderBy("key_set")
