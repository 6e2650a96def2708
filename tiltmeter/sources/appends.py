"""A log that grows by appends, whose order is written down and not read off file times.

Beside the data lies a commit table, one small file for each append: its number and the files that it wrote. A number is
taken by creating its file, which fails where it exists, so two writers never share one, and a copy of the folder keeps the
order. Files that no commit names (other programs' logs, or data of a writer that died between both steps) are read as well,
after all appends, in the order of their times and names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.sources import files

COMMITS = "_appends"
COMMIT = "append long, tag string, files array<string>"
#: What files without a commit have in place of a number.
UNNUMBERED = 2**63 - 1
#: The order of a log: appends by number, files without one by their times, then lines by their place.
LOG_ORDER = ["append", "written", "pos"]


def commits(spark: SparkSession, log: str) -> DataFrame:
    """``append, tag, files`` of all appends."""
    at = f"{log.rstrip('/')}/{COMMITS}"
    return spark.read.schema(COMMIT).json(at) if files.exists(at) else spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, log: str, tag: str) -> bool:
    return not commits(spark, log).where(F.col("tag") == tag).isEmpty()


def append(rows: DataFrame, log: str, tag: str = "") -> int:
    """Add ``rows`` as compressed JSON lines in one append, and give its number; a ``tag`` that was committed before adds nothing (-1).

    Readers see the rows of a task when it commits; their number follows when all have.
    """
    spark, log = rows.sparkSession, log.rstrip("/")
    if tag and is_committed(spark, log, tag):
        return -1
    part = f"data-{uuid.uuid4().hex}"
    rows.write.json(f"{log}/{part}", compression="gzip")
    own = [f"{part}/{n}" for n in files.names(f"{log}/{part}")]
    taken = files.names(f"{log}/{COMMITS}")
    number = int(taken[-1].partition(".")[0]) + 1 if taken else 0
    while not files.write_new(f"{log}/{COMMITS}/{number:012d}.json", json.dumps({"append": number, "tag": tag, "files": own})):
        number += 1
    return number


def numbered(lines: DataFrame, log: str) -> DataFrame:
    """``lines(file, written, ...)`` of a log with the number of their append; the time counts only where there is none."""
    named = commits(lines.sparkSession, log).select(F.col("append").alias("__append"), F.explode("files").alias("__name"))
    name: Column = F.substring_index("file", "/", -2)
    joined = lines.withColumn("__name", name).join(named, "__name", "left")
    known = F.col("__append").isNotNull()
    return joined.withColumn("append", F.coalesce("__append", F.lit(UNNUMBERED))).withColumn(
        "written", F.when(~known, F.col("written"))
    ).drop("__append", "__name")
