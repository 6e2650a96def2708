"""A judgment log as a stream: lines come in, each key goes out once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tiltmeter.operators.cells import first_by_key
from tiltmeter.sources.appends import numbered
from tiltmeter.sources.records import JUDGMENT, judged_lines

TABLE = T.StructType([*JUDGMENT.fields, T.StructField("batch", T.LongType())])


def log_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Whole lines of all files of a folder with their file and its time; truncated ones are left out."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("recursiveFileLookup", True)
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = reader.load(folder).select("value", meta("file_modification_time").alias("written"), meta("file_path").alias("file"), meta("file_block_start").alias("block"))
    return judged_lines(lines).select("r.*", "written", "file", "block")


def _table(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.schema(TABLE).parquet(target)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Append to a Parquet table what its log folder has gained, each key once; may be run again at any time.

    The first row of a key in the log's order goes in; rows without a key all do. What is known is the
    table's own key column, of which a batch looks up its keys, so no state grows beside the table. A
    batch writes its own partition anew and looks at earlier ones only: done twice, it gives the same rows.
    """

    def add(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        lines = numbered(rows.withColumn("line", F.monotonically_increasing_id()), folder)
        fresh = first_by_key(lines, ["append", "written", "file", "block", "line"])
        if (table := _table(session, target)) is not None:
            asked = rows.where("key <> ''").select("key").distinct()
            known = table.where(F.col("batch") < batch).select("key").join(asked, "key", "left_semi")
            fresh = fresh.join(known, "key", "left_anti")
        fresh.select(*JUDGMENT.names).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch}")

    query = log_stream(spark, folder, files_per_batch).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_counts(spark: SparkSession, target: str) -> DataFrame:
    """Verdicts by judge and axis of an ingested table so far, as a stream for a complete-mode sink; state is the counts alone."""
    rows = spark.readStream.schema(TABLE).parquet(target)
    return rows.groupBy("judge_id", "axis", "verdict").agg(F.count(F.lit(1)).alias("n"))
