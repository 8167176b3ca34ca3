"""The clean table and its report from one job."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from orderlens.operators import quality
from orderlens.schema import CATEGORICAL
from orderlens.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def messy(raw):
    """Duplicates, missing and unparseable values, early shipments, padded categories."""
    one = {"Row ID": 1}
    return raw(one, one, one, {"Ship Date": "pending"}, {"Ship Date": "11/1/2016"}, {"Quantity": 0, "Sales": "-1"},
               {"Region": " West ", "Segment": None}, {"Region": "East", "Discount": "1.5"}, {"Profit": "-2"},
               {"Customer Name": None, "Profit": None}, {"Order Date": None}, {"Postal Code": None, "Sub-Category": "X"})


def report(frame):
    return sorted((r.step, r.check_name, r.column_name or "", r.n_rows) for r in frame.collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_report_and_table_equal_the_two_questions(spark, messy, tmp_path, fmt):
    found = files.clean_and_report(messy, str(tmp_path / "t"), fmt)
    assert report(found) == report(quality.cleaning_report(messy))
    want = quality.clean(messy)
    back = files.scan_clean(spark, str(tmp_path / "t"), want.schema, fmt)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, want.collect()))


def test_no_rows(spark, messy, tmp_path):
    nothing = messy.filter("false")
    assert report(files.clean_and_report(nothing, str(tmp_path / "t"))) == report(quality.cleaning_report(nothing))


def test_a_column_of_many_values_is_counted_from_the_table(spark, messy, tmp_path, monkeypatch):
    many = messy.withColumn("State", F.col("Row ID").cast("string")).withColumn("Category", F.concat(F.lit("c"), "Row ID"))
    path = str(tmp_path / "t")
    cleaning = quality.ObservedCleaning(many, most_values=3)
    files.write_clean(cleaning.rows, path, passing=cleaning.passing)
    back = files.scan_clean(spark, path, cleaning.rows.select(*cleaning.columns).schema)
    assert report(cleaning.report(back)) == report(quality.cleaning_report(many))


def test_one_scan_and_figures_from_the_writing_tasks(spark, messy, tmp_path):
    """The figures are taken above the last exchange, in the tasks that write."""
    path = str(tmp_path / "raw")
    messy.write.parquet(path)
    raw = spark.read.schema(messy.schema).parquet(path)
    cleaning = quality.ObservedCleaning(raw)
    frame = cleaning.passing(cleaning.rows.withColumn("order_year", F.year("order_date")).hint("rebalance", F.col("order_year")))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", text)) == 1
    assert text.index("CollectMetrics") < text.index("Exchange")
    assert set(frame.columns) == {*cleaning.columns, "order_year"}


RETRY = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from orderlens.operators import quality
from orderlens.sources import files
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate())
raw = spark.read.schema({schema!r}).parquet({path!r})
cleaning = quality.ObservedCleaning(raw)
def passing(rows):
    counted = cleaning.passing(rows)
    def fail_once(batches):
        yield from batches
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
    return counted.mapInArrow(fail_once, counted.schema)
files.write_clean(cleaning.rows, {out!r}, passing=passing)
table = spark.read.parquet({out!r})
print("FIGURES", cleaning.observation.get["read"], cleaning.observation.get["removed"], table.count())
"""


def test_a_task_that_is_run_again_counts_once(messy, tmp_path):
    """Every writing task fails after it has counted all its rows, and is run again."""
    path, out = str(tmp_path / "raw"), str(tmp_path / "out")
    messy.repartition(4).write.parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messy.schema)
    done = subprocess.run([sys.executable, "-c", RETRY.format(root=ROOT, schema=ddl, path=path, out=out)],
                          capture_output=True, text=True, timeout=300)
    assert "FIGURES 12 2 10" in done.stdout, done.stderr[-2000:]


def test_categorical_columns_are_all_reported(messy):
    steps = [r.column_name for r in quality.cleaning_report(messy).collect() if r.step == 7]
    assert sorted(steps) == sorted(CATEGORICAL)
