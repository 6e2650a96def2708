"""The grid of trials, and what of it is still to be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.operators.axes import presentations, rival
from tiltmeter.operators.prompts import check_templates

CONDITIONS = ("base", "perturbed", "noise_a", "noise_b")


def trial_key() -> Column:
    """Identity of a trial; the temperature is no part of it."""
    return F.concat_ws("|", "item_id", "axis", "condition", "judge_id", "prompt_template", "rep")


def judges_table(spark, judges: list[tuple[str, str]]) -> DataFrame:
    """Judges as ``(judge_id, family)`` with the family each is set against."""
    return spark.createDataFrame(judges, "judge_id string, family string").withColumn("rival_family", rival(F.col("family")))


def trials(
    items: DataFrame, judges: DataFrame, axes: list[str], templates: list[str], reps: int, temperature: float = 0.7,
    noise: bool = True,
) -> DataFrame:
    """Every item under every judge, axis, condition, template and repeat, with its presentation and key.

    ``judges`` is the list of judges of a run; it is broadcast. The rest of the grid is exploded from
    literals, so nothing is shuffled.
    """
    named = items.join(F.broadcast(judges))
    shown = presentations(named, axes, noise, F.col("family"), F.col("rival_family"))
    return (
        shown.withColumn("prompt_template", F.explode(F.array(*[F.lit(t) for t in check_templates(templates)])))
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumnRenamed("id", "item_id")
        .withColumn("temperature", F.lit(float(temperature)))
        .withColumn("extra_instruction", F.lit(""))
        .withColumn("key", trial_key())
    )


def key_counts(grid: DataFrame, by: list[str]) -> DataFrame:
    """Trials ``n`` and distinct ``keys`` of a grid by some of its columns.

    A key names its item (it is what stands before the last five bars), so keys are told apart item by item and summed: where the
    grid was dealt by ``item_id``, no key is shuffled.
    """
    counted = grid.groupBy("item_id", *by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))
    return counted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


def expected_calls(items: int, judges: int, axes: int, templates: int, reps: int, noise: bool = True) -> int:
    """Size of the grid without building it."""
    return items * judges * axes * templates * reps * (4 if noise else 2)


def pending(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Trials whose key the log lacks.

    Keys are merged and never broadcast: a grid is exploded from items, and Spark takes its size for that of the items.
    """
    return grid.join(log.select("key").where("key <> ''").hint("merge"), "key", "left_anti")
