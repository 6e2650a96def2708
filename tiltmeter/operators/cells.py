"""From judgments to cells: paired outcomes by item, and rates over them.

A judgment counts if its verdict is A or B, whatever its error says. Two conditions of a trial meet in
one conditional aggregation, so no self-join is needed, and all judges, axes and templates are done at
once. ``by`` are the columns that are kept apart: judge and axis, or the template as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.columns import ratio
from tiltmeter.functions.numeric import cohens_h

BY = ["judge_id", "axis"]
BY_TEMPLATE = ["judge_id", "prompt_template", "axis"]


def scorable() -> Column:
    return F.col("verdict").isin("A", "B")


def correct() -> Column:
    return F.col("verdict") == F.col("preferred")


def first_by_key(log: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key in the log's order; rows without a key are all kept."""
    # Rows without a key are numbered apart, each for itself, so the log is read once and they crowd no task.
    keyless = F.col("key").isNull() | (F.col("key") == "")
    apart = log.withColumn("__apart", F.when(keyless, F.monotonically_increasing_id() + 1).otherwise(0))
    first = Window.partitionBy("key", "__apart").orderBy(*order)
    return apart.withColumn("__n", F.row_number().over(first)).where("__n = 1 or __apart > 0").drop("__n", "__apart")


def outcomes(judgments: DataFrame) -> DataFrame:
    """One row for each trial with the outcome under each condition (null if it was not judged A or B), and how many
    judgments under base and perturbed there were (``n_base, n_pert``) and how many of them were correct (``k_base, k_pert``)."""
    ok = lambda c: F.max(F.when(F.col("condition") == c, correct().cast("int"))).alias(c)
    return (
        judgments.where(scorable())
        .groupBy("judge_id", "axis", "item_id", "prompt_template", "rep")
        .agg(*[ok(c) for c in ("base", "perturbed", "noise_a", "noise_b")], *_tallies())
    )


def _tallies() -> list[Column]:
    good = correct().cast("long")
    pick = lambda c: F.col("condition") == c
    return [F.sum(F.when(pick(c), good).otherwise(0)).alias(f"k_{s}") for c, s in (("base", "base"), ("perturbed", "pert"))] + [
        F.sum(pick(c).cast("long")).alias(f"n_{s}") for c, s in (("base", "base"), ("perturbed", "pert"))
    ]


def _counted(x: str, y: str, prefix: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return [
        F.sum(both.cast("long")).alias(f"{prefix}n"),
        F.sum((both & (F.col(x) == 1) & (F.col(y) == 0)).cast("long")).alias(f"{prefix}b"),
        F.sum((both & (F.col(x) == 0) & (F.col(y) == 1)).cast("long")).alias(f"{prefix}c"),
    ]


TALLIES = ("k_base", "k_pert", "n_base", "n_pert")


def counted_cells(judgments: DataFrame, by: list[str] = BY) -> DataFrame:
    """As ``cells``, with each item's tallies under base and perturbed, and items that have nothing else."""
    return outcomes(judgments).groupBy(*by, "item_id").agg(
        *_counted("base", "perturbed", ""), *_counted("noise_a", "noise_b", "n"), *[F.sum(c).alias(c) for c in TALLIES]
    )


def cells(judgments: DataFrame, by: list[str] = BY) -> DataFrame:
    """``n, b, c`` of base against perturbed and ``nn, nb, nc`` of the two noise conditions for each item."""
    return counted_cells(judgments, by).where("n > 0 or nn > 0").drop(*TALLIES)


#: What stands for all templates together in ``cells_by_all``.
POOLED = "(all)"


def cells_by_all(judgments: DataFrame) -> DataFrame:
    """Cells by judge, template and axis, and those of all templates together under ``POOLED``: judgments are shuffled once.

    Trials are grouped once; their outcomes are expanded to both grouping sets and summed before the second shuffle.
    """
    sets = [[*BY_TEMPLATE, "item_id"], [*BY, "item_id"]]
    keys = [F.col(c) for c in (*BY_TEMPLATE, "item_id")]
    counted = outcomes(judgments).groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.grouping("prompt_template").alias("pooled"), *_counted("base", "perturbed", ""), *_counted("noise_a", "noise_b", "n"), *[F.sum(c).alias(c) for c in TALLIES]
    )
    return counted.withColumn("prompt_template", F.when(F.col("pooled") == 1, POOLED).otherwise(F.col("prompt_template"))).drop("pooled")


def totals(cell_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """Counts, net bias, flip rate, both directions and effect size over the items."""
    summed = cell_table.where("n > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("c").alias("c")
    )
    n, b, c = F.col("n"), F.col("b"), F.col("c")
    return summed.select(
        *by, "n_items", "n", "b", "c",
        ratio(b - c, n).alias("net_bias"), ratio(b + c, n).alias("flip_rate"),
        ratio(b, n).alias("p_wrong"), ratio(c, n).alias("p_right"), cohens_h(ratio(b, n), ratio(c, n)).alias("h"),
    )


def noise_floor(cell_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """Share of wrong flips, and of all flips, between two identical conditions."""
    return cell_table.where("nn > 0").groupBy(*by).agg(
        F.sum("nn").alias("nn"), F.sum("nb").alias("nb"), F.sum("nc").alias("nc")
    ).select(
        *by, "nn", "nb", "nc", ratio(F.col("nb"), F.col("nn")).alias("noise_floor"),
        ratio(F.col("nb") + F.col("nc"), F.col("nn")).alias("noise_self_disagreement"),
    )


def accuracy(judgments: DataFrame, by: list[str] = BY) -> DataFrame:
    """Accuracy and count of scorable judgments under base and perturbed; (0, 0) for none."""
    return rates_of(judgments.where(scorable()).groupBy(*by).agg(*_tallies()), by)


def counted_accuracy(cell_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """The same from ``counted_cells``."""
    return rates_of(cell_table.groupBy(*by).agg(*[F.sum(c).alias(c) for c in TALLIES]), by)


def rates_of(tallied: DataFrame, by: list[str]) -> DataFrame:
    return tallied.select(
        *by, ratio(F.col("k_base"), F.col("n_base")).alias("acc_base"), "n_base",
        ratio(F.col("k_pert"), F.col("n_pert")).alias("acc_pert"), "n_pert",
    )


def quality(judgments: DataFrame) -> DataFrame:
    """For each judge: rows, parse failures, ties, errors with rates, upper median latency, accuracy."""
    is_ = lambda v: (F.col("verdict") == v).cast("long")
    counted = judgments.where("judge_id is not null").groupBy("judge_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_("PARSE_FAIL")).alias("parse_fails"), F.sum(is_("TIE")).alias("ties"),
        F.sum((F.coalesce("error", F.lit("")) != "").cast("long")).alias("errors"),
        F.sum((scorable() & correct()).cast("long")).alias("k"), F.sum(scorable().cast("long")).alias("scorable"),
        F.collect_set(F.when(F.col("model_version") != "", F.col("model_version"))).alias("versions"),
    )
    judge = Window.partitionBy("judge_id")
    upto, half = F.sum("n").over(judge.orderBy("latency_ms")), F.floor(F.sum("n").over(judge) / 2)
    placed = counted.withColumn("upto", upto).withColumn("half", half)
    sums = ("n", "parse_fails", "ties", "errors", "k", "scorable")
    summed = placed.groupBy("judge_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions"),
        F.max(F.when(F.expr("upto > half and upto - n <= half"), F.col("latency_ms"))).alias("median_latency_ms"),
    )
    n = F.col("n")
    return summed.select(
        "judge_id", "n", "parse_fails", ratio(F.col("parse_fails"), n).alias("parse_fail_rate"), "ties",
        ratio(F.col("ties"), n).alias("tie_rate"), "errors", ratio(F.col("errors"), n).alias("error_rate"),
        "median_latency_ms", ratio(F.col("k"), F.col("scorable")).alias("accuracy"), "versions",
    )
