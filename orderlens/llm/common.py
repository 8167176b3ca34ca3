"""What several operators need: shared-folder tables, document rows, global numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words end at these characters: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage with a table
    that outlives any executor. Its shuffle files go at once, the table with the session.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Python workers get few rows at once: any of them may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (a missing text is empty); other columns only if asked for."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(column: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as remainder 0."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(text.cast("string").cast("binary")) % divisor, F.lit(0))


def numbered(frame: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Adds the row's number in the global order (from 0) without one sorting task: rows are
    dealt by ranges of the order, numbered in their range, and moved by the rows before it.
    The only global window sees one row per range.
    """
    part = f"{name}__part"
    dealt = stored(
        frame.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
        .withColumn(part, F.spark_partition_id()), "ranges")
    before = F.sum("rows__").over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = (dealt.groupBy(part).agg(F.count("*").alias("rows__"))
               .select(part, F.coalesce(before, F.lit(0)).alias("before__")))
    own = F.row_number().over(
        Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return (dealt.withColumn(name, own).join(offsets, part)
            .withColumn(name, F.col(name) - 1 + F.col("before__")).drop(part, "before__"))


def in_arrow(frame: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str,
             rows: int = 512) -> DataFrame:
    """mapInArrow with a function from a piece of at most ``rows`` rows to named columns."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(work(batch.slice(start, rows)), kinds)

    return frame.mapInArrow(run, schema)
