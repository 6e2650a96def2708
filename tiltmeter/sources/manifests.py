"""Manifests of all runs of a folder as a table, and what each run has otherwise than another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = ("schema", "items_sha256", "judges", "code_commit")
#: Settings that don't change what the data mean.
PLACES = ("config.folder", "config.name", "config.resume")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, field, value`` of all ``*_manifest.json`` files; values that are no text are JSON. What can't be read is left out."""
    shape = "run_id string, " + ", ".join(f"{c} string" for c in TOP) + ", config map<string, string>"
    read = spark.read.text(f"{folder.rstrip('/')}/*_manifest.json", wholetext=True).select(F.from_json("value", shape).alias("m"))
    own = F.map_from_arrays(F.array(*map(F.lit, TOP)), F.array(*[F.col(f"m.{c}") for c in TOP]))
    config = F.transform_keys(F.coalesce("m.config", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("config."), k))
    found = read.where("m.run_id is not null").select("m.run_id", F.explode(F.map_concat(own, config)).alias("field", "value"))
    return found.where(F.col("value").isNotNull() & ~F.col("field").isin(*PLACES))


def differences(found: DataFrame, run_id: str) -> DataFrame:
    """``run_id, field, wanted, value`` where a run differs from the run ``run_id``; null where one of them lacks the field.

    An unknown commit agrees with any. The run that others are held against is one manifest: its fields are repeated for each
    other run and meet that run's fields in a full outer join, so any number of runs is compared at once.
    """
    ours = [F.struct(F.lit(r.field).alias("field"), F.lit(r.value).alias("wanted")) for r in found.where(F.col("run_id") == run_id).collect()]
    others = found.where(F.col("run_id") != run_id)
    every = F.array(*ours) if ours else F.array().cast("array<struct<field:string,wanted:string>>")
    wanted = others.select("run_id").distinct().select("run_id", F.inline(every))
    both = wanted.join(others, ["run_id", "field"], "full_outer").where(~F.col("wanted").eqNullSafe(F.col("value")))
    unknown = (F.col("field") == "code_commit") & F.coalesce((F.col("wanted") == "unknown") | (F.col("value") == "unknown"), F.lit(True))
    return both.where(~unknown).select("run_id", "field", "wanted", "value")
