"""Sources: item pools, logs of judgments and reports, all with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.columns import SPACE, fixed, signed_gap, strip
from tiltmeter.operators.pool import DOMAINS
from tiltmeter.sources import files
from tiltmeter.sources.appends import LOG_ORDER, numbered

ITEM_FIELDS = ("id", "domain", "question", "correct", "wrong", "notes")
ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ITEM_FIELDS])
BLOCKS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("label", "text")]))
_KINDS = {"rep": T.IntegerType(), "temperature": T.DoubleType(), "blocks": BLOCKS, "is_correct": T.BooleanType(), "latency_ms": T.DoubleType()}
#: One line of the judgment log; fields without another kind are strings.
JUDGMENT = T.StructType(
    [
        T.StructField(c, _KINDS.get(c, T.StringType()))
        for c in (
            "item_id", "axis", "condition", "judge_id", "rep", "temperature", "prompt_template", "preferred", "blocks",
            "extra_instruction", "raw", "verdict", "is_correct", "latency_ms", "model_version", "error", "key",
        )
    ]
)


class BadInput(ValueError):
    """A source that does not hold what it should."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``file``, its time ``written``, and their place ``pos``, an order that survives partitions.

    Ids grow within a block of a file, and blocks have their offset, so a file's lines keep their order
    however it is split. Folders within the folder are read too.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    read = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", meta("file_path").alias("file"), meta("file_modification_time").alias("written"),
        meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    return read.where(F.col("value").rlike(f"[^{SPACE[1:]}")).withColumn("pos", F.struct("file", "block", "line")).drop("block", "line")


def load_items(spark: SparkSession, path: str, comments: bool = True, check_domains: bool = True) -> DataFrame:
    """A pool of items; blank lines and (with ``comments``) lines starting with # are skipped.

    A line that is no JSON object, lacks a field or names an unknown domain fails the query that reads it.
    """
    lines = _lines(spark, path)
    if comments:
        lines = lines.where(~F.startswith(strip(F.col("value")), F.lit("#")))
    made = lines.withColumn("r", F.from_json("value", T.StructType([*ITEM.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    lacks = F.lit(False)
    for c in ITEM_FIELDS[:-1]:
        lacks = lacks | F.col(f"r.{c}").isNull()
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull() | lacks
    if check_domains:
        wrong = wrong | ~F.col("r.domain").isin(*DOMAINS)
    said = F.concat(F.lit("bad item line: "), F.substring("value", 1, 120))
    checked = made.withColumn("r", F.when(wrong, F.raise_error(said).cast(made.schema["r"].dataType)).otherwise(F.col("r")))
    return checked.select(*[F.col(f"r.{c}").alias(c) for c in ITEM_FIELDS[:-1]], F.coalesce("r.notes", F.lit("")).alias("notes"), "file", "pos")


def load_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Items that may lack fields, and their place ``pos``; a line that is no JSON object lacks all of them."""
    made = _lines(spark, path).withColumn("r", F.from_json("value", ITEM))
    return made.select("r.*", F.struct("written", "pos").alias("pos"))


def load_domain_files(spark: SparkSession, folder: str) -> DataFrame:
    """Items of one file for each domain; a missing domain is the file's name."""
    lines = _lines(spark, f"{folder.rstrip('/')}/*.jsonl")
    made = lines.withColumn("r", F.from_json("value", ITEM, {"mode": "FAILFAST"}))
    named = F.coalesce("r.domain", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    return made.select(*[(named if c == "domain" else F.col(f"r.{c}")).alias(c) for c in ITEM_FIELDS], "pos")


def pool_records(items: DataFrame) -> DataFrame:
    """``(item_id, domain, signed_length_gap)`` of each item; a pool without items fails the query."""
    none = items.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.raise_error(F.lit("item pool is empty")).cast("string").alias("item_id"), F.lit("").alias("domain"), F.lit(0.0).alias("signed_length_gap")
    )
    rows = items.select(F.col("id").alias("item_id"), "domain", signed_gap(F.col("correct"), F.col("wrong")).alias("signed_length_gap"))
    return rows.unionByName(none)


def judged_lines(lines: DataFrame, fields: T.StructType = JUDGMENT) -> DataFrame:
    """``lines(value, ...)`` that hold a whole judgment, as ``r``; a line is parsed once, however many of its fields are read."""
    made = fixed(lines, r=F.from_json("value", fields, {"mode": "PERMISSIVE"}))
    return made.where("r is not null and r.verdict is not null and r.item_id is not null")


def load_log(spark: SparkSession, path: str, fields: Sequence[str] = tuple(JUDGMENT.names)) -> DataFrame:
    """All whole lines of a judgment log in order; a truncated line is left out. Correctness is derived anew.

    Of other columns than ``fields``, only those that correctness and wholeness are told by are there.
    """
    kinds = T.StructType([f for f in JUDGMENT if f.name in {*fields, "item_id", "verdict", "preferred"}])
    sound = judged_lines(numbered(_lines(spark, path), path), kinds)
    kept = sound.select(*[F.col(f"r.{c}").alias(c) for c in kinds.names if c != "is_correct"], "file", *LOG_ORDER)
    for c in {"extra_instruction", "model_version", "error", "key"} & set(kinds.names):
        kept = kept.withColumn(c, F.coalesce(c, F.lit("")))
    return kept.withColumn("is_correct", F.col("verdict") == F.col("preferred"))


def load_manifest(path: str) -> dict | None:
    """A manifest, or None where there is none or it can't be read."""
    try:
        return json.loads(files.read_text(path))
    except (OSError, ValueError):
        return None


def report_rows(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """Cells of the markdown table under a heading, one array for each row."""
    text = spark.read.text(path, wholetext=True)
    section = F.split_part(F.concat(F.lit("\n"), "value"), F.lit(f"\n## {heading}\n"), F.lit(2))
    body = F.split_part(section, F.lit("\n## "), F.lit(1))
    lines = text.select(F.posexplode(F.split(body, "\n")).alias("pos", "line")).where("line like '|%|' and line not rlike '^[|: -]+$'")
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), strip)
    return lines.select("pos", cells.alias("cells"))
