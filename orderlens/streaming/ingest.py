"""Loading raw files as they arrive: the batch cleaning and the insert-if-absent
load, run per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderlens.operators.quality import check_columns, clean
from orderlens.plans.reuse import shared
from orderlens.schema import CLEAN_SCHEMA, LOAD_COLUMNS, RAW_COLUMNS
from orderlens.sources.star import append_new_rows

TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw CSV files of a folder as a stream of text columns, like the batch scan. Each
    file's header must be the declared one: another order or a missing heading fails.
    """
    return (
        spark.readStream.schema(TEXT_SCHEMA).option("header", True).option("enforceSchema", False)
        .option("encoding", "ISO-8859-1").option("escape", '"').csv(folder)
    )


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Clean each batch of new files and append the rows not stored yet.

    A batch replayed after a failure finds its rows stored and adds nothing, so
    every line lands once. Runs until the files present are loaded, then stops.
    """
    columns = CLEAN_SCHEMA.fieldNames()
    spark.createDataFrame([], CLEAN_SCHEMA).write.mode("ignore").parquet(table)

    def load(batch: DataFrame, _: int) -> None:
        # The batch is read for its keys and for its rows.
        cleaned = clean(batch)
        check_columns(cleaned, LOAD_COLUMNS)
        with shared(cleaned.select(*columns)) as rows:
            append_new_rows(rows, table, ["row_id"])

    return (
        read_raw_stream(spark, folder).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
