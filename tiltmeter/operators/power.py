"""Power and calibration: exact on the rates of given cells, or by simulation, where every simulated test is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltmeter.functions.columns import hex_number, uniform
from tiltmeter.functions.numeric import binomial_upper_bound, cohens_h, delta_for_h, log_choose, mcnemar_exact
from tiltmeter.operators.cells import BY
from tiltmeter.operators.inference import ALPHA, BITS, RESAMPLES, SEED
from tiltmeter.operators.resampling import resamples

HYPOTHESES, NOISE_FLOOR = 7, 0.15


def item_rates(cells: DataFrame, by: list[str] = BY) -> DataFrame:
    """``n_items, p_wrong, p_right``: shares of items that flip to wrong or to right on balance; repeats of an item count as one."""
    d = F.col("b") - F.col("c")
    return cells.where("n > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg((d > 0).cast("double")).alias("p_wrong"), F.avg((d < 0).cast("double")).alias("p_right")
    )


def noise_rates(cells: DataFrame, by: list[str] = BY) -> DataFrame:
    """``floor``: share of items on which two identical conditions disagree on balance."""
    return cells.where("nn > 0").groupBy(*by).agg(F.avg((F.col("nb") != F.col("nc")).cast("double")).alias("floor"))


def exact_power(rates: DataFrame, n_items: int, alpha: float = ALPHA / HYPOTHESES) -> DataFrame:
    """``rates(p_wrong, p_right, ...)`` with ``power``: the probability that McNemar's test of ``n_items`` items rejects.

    Items flip to wrong, to right or not at all (a trinomial), and all outcomes that reject are summed: nothing is drawn.
    There are n (n + 1) / 2 outcomes, joined by their counts, whatever the number of rates.
    """
    spark, n = rates.sparkSession, F.lit(n_items)
    both = spark.range(n_items + 1).select(F.col("id").cast("int").alias("b")).withColumn("c", F.explode(F.sequence(F.lit(0), n - F.col("b"))))
    rejecting = both.where(mcnemar_exact(F.col("b"), F.col("c")) < alpha)
    ways = log_choose(n, F.col("b") + F.col("c")) + log_choose(F.col("b") + F.col("c"), F.col("b"))
    rejecting = rejecting.withColumn("ways", ways)
    named = rates.withColumn("__rate", F.struct("p_wrong", "p_right")).withColumn("b", F.explode(F.sequence(F.lit(0), n)))
    log = lambda k, p: F.when(k == 0, 0.0).when(p > 0, k * F.log(F.when(p > 0, p)))
    wrong, right = F.col("p_wrong"), F.col("p_right")
    none = F.greatest(1 - wrong - right, F.lit(0.0))
    chance = F.exp(F.col("ways") + log(F.col("b"), wrong) + log(F.col("c"), right) + log(n - F.col("b") - F.col("c"), none))
    summed = named.join(rejecting, "b").groupBy(*rates.columns).agg(F.sum(F.coalesce(chance, F.lit(0.0))).alias("power"))
    return summed


def detectable(floors: DataFrame, n_items: int, target: float = 0.8, steps: int = 60, alpha: float = ALPHA / HYPOTHESES) -> DataFrame:
    """``floors(floor, ...)`` with ``least_h``, the least effect of a grid that ``n_items`` items detect with the power ``target``.

    Flips of a total share ``floor`` are redirected step by step, from evenly split to all wrong; null where no step suffices.
    """
    grid = floors.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    moved = F.col("floor") * F.col("step") / steps
    grid = grid.withColumn("p_wrong", (F.col("floor") + moved) / 2).withColumn("p_right", (F.col("floor") - moved) / 2)
    found = exact_power(grid, n_items, alpha).withColumn("h", cohens_h(F.col("p_wrong"), F.col("p_right")))
    return found.groupBy(*floors.columns).agg(F.min(F.when(F.col("power") >= target, F.col("h"))).alias("least_h"))


def null_rejections(cells: DataFrame, by: list[str] = BY, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``by, seed, observed, rejected`` for ``BITS`` data sets without any bias, made of the given cells.

    Under each seed every item's difference gets a sign from one bit of its hash, which keeps all that cells are and takes
    the bias away. Signs don't change the distribution that the sign-flip test draws from, so all seeds share one set of
    resamples: the test rejects beyond the resample of rank alpha (n + 1).
    """
    used = cells.where("n > 0").withColumn("d", (F.col("b") - F.col("c")).cast("long"))
    bits = hex_number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("null"), *by, "item_id")), 12)
    signed = used.where("d <> 0").withColumn("bits", bits).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))))
    sums = signed.groupBy(*by, "seed").agg(F.abs(F.sum(F.expr("(1 - 2 * CAST(shiftright(bits, seed) & 1 AS BIGINT)) * d"))).alias("observed"))
    rank = int(-(-alpha * (n + 1) // 1)) - 1
    drawn = resamples(cells, by, n, {"perm": seed, "boot": seed, "gate": seed}).where("stream = 'perm'").select(*by, F.abs("s0").alias("s"))
    at = drawn.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"))))
    return sums.join(at.where(F.col("at") == rank).select(*by, "s"), by).select(*by, "seed", "observed", (F.col("observed") > F.col("s")).alias("rejected"))


def power_grid(
    spark: SparkSession, effects: list[float], sizes: list[int], n_sims: int = 4000, seed: int = 7,
    noise_floor: float = NOISE_FLOOR, alpha: float = ALPHA, m: int = HYPOTHESES,
) -> DataFrame:
    """Share of simulated experiments that reject, for each effect size and number of items.

    Replicates of an item are taken as fully correlated, so they don't enter.
    """
    rows = [(h, n, (noise_floor + d) / 2) for h in effects for n in sizes for d in [delta_for_h(h, noise_floor)]]
    grid = spark.createDataFrame(rows, "effect_h double, n_items int, p_wrong double")
    u = uniform(seed, "power", F.col("n_items"), F.col("sim"), F.col("item"))
    drawn = grid.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).withColumn(
        "item", F.explode(F.sequence(F.lit(0), F.col("n_items") - 1))
    ).withColumn("u", u)
    tests = drawn.groupBy("effect_h", "n_items", "sim").agg(
        F.sum((F.col("u") < F.col("p_wrong")).cast("int")).alias("b"),
        F.sum(((F.col("u") >= F.col("p_wrong")) & (F.col("u") < noise_floor)).cast("int")).alias("c"),
    )
    hit = mcnemar_exact(F.col("b"), F.col("c")) < alpha / m
    return tests.groupBy("effect_h", "n_items").agg(
        F.count(F.lit(1)).alias("sims"), F.sum(hit.cast("long")).alias("hits")
    ).withColumn("power", F.col("hits") / F.col("sims"))


def min_detectable_h(spark: SparkSession, n_items: int, target: float = 0.8, n_sims: int = 1000, passes: int = 3, points: int = 16) -> float:
    """Smallest effect size that reaches the power, narrowed down over grids of effects, one job each."""
    low, high = 0.01, 1.2
    for _ in range(passes):
        tried = [low + (high - low) * i / points for i in range(points + 1)]
        power = {r["effect_h"]: r["power"] for r in power_grid(spark, tried, [n_items], n_sims).collect()}
        above = [h for h in tried if power[h] >= target]
        high = above[0] if above else high
        low = max([h for h in tried if h < high], default=low)
    return (low + high) / 2


def items_needed(spark: SparkSession, effects: list[float], sizes: list[int], target: float = 0.8, n_sims: int = 4000) -> DataFrame:
    """``(effect_h, n_items)``: the least of the sizes that reaches the power for each effect; null where none does."""
    reached = F.when(F.col("power") >= target, F.col("n_items"))
    return power_grid(spark, effects, sizes, n_sims).groupBy("effect_h").agg(F.min(reached).alias("n_items"))


def false_positives(results: DataFrame, confidence: float = 0.95, alpha: float = ALPHA, by: tuple[str, ...] = ()) -> DataFrame:
    """Rejections over all tests (of each group), and how many chance allows."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("tests"), F.sum(F.col("rejected").cast("long")).alias("rejections")).withColumn(
        "accept_up_to", binomial_upper_bound(F.col("tests"), F.lit(alpha), F.lit(confidence))
    )
