"""Statistical functions as columns; what Spark lacks is folded over short sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_TERMS = 160


def erf(x: Column) -> Column:
    """The error function by its series of positive terms; 1 beyond 6."""
    z = F.least(F.abs(x), F.lit(6.0))
    start = F.struct(z.alias("term"), z.alias("total"))
    step = lambda acc, n: F.struct(
        (acc["term"] * F.lit(2.0) * z * z / (F.lit(2.0) * n + 1)).alias("term"),
        (acc["total"] + acc["term"] * F.lit(2.0) * z * z / (F.lit(2.0) * n + 1)).alias("total"),
    )
    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, step, lambda acc: acc["total"])
    return F.signum(x) * F.least(F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * total, F.lit(1.0))


def normal_cdf(x: Column) -> Column:
    return (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0)))) / 2


def cohens_h(p1: Column, p2: Column) -> Column:
    arc = lambda p: F.lit(2.0) * F.asin(F.sqrt(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))
    return arc(p1) - arc(p2)


def cohens_h_var(n: Column) -> Column:
    return F.when(n > 0, F.lit(1.0) / n.cast("double")).otherwise(F.lit(float("inf")))


def log_choose(n: Column, k: Column) -> Column:
    """Log of a binomial coefficient, as a sum of logs over the shorter side."""
    short = F.least(k, n - k).cast("int")
    return F.aggregate(
        F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, i: acc + F.log((n - short + i).cast("double")) - F.log(i.cast("double")),
    )


def binom_pmf(k: Column, n: Column, p: Column) -> Column:
    """Binomial probability; 0 outside the range."""
    sure = F.when(p <= 0, (k == 0).cast("double")).when(p >= 1, (k == n).cast("double"))
    inner = F.exp(log_choose(n, k) + k * F.log(p) + (n - k) * F.log(F.lit(1.0) - p))
    return F.when((k < 0) | (k > n), F.lit(0.0)).otherwise(F.coalesce(sure, inner))


def mcnemar_exact(b: Column, c: Column, exact_up_to: int = 500) -> Column:
    """Two-sided McNemar p of discordant counts; a corrected normal beyond ``exact_up_to`` of them."""
    n, low = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), F.least(n, F.lit(exact_up_to))).alias("p"), F.lit(0.0).alias("total"))
    tail = F.aggregate(
        F.sequence(F.lit(0), low),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * (n - k).cast("double") / (k + 1).cast("double")).alias("p"), (acc["total"] + acc["p"]).alias("total")
        ),
        lambda acc: acc["total"],
    )
    chi = F.abs(F.abs((b - c).cast("double")) - 1) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    wide = F.when(chi == 0, F.lit(1.0)).otherwise(F.lit(2.0) * (F.lit(1.0) - normal_cdf(chi)))
    return F.when(n == 0, F.lit(1.0)).when(n > exact_up_to, wide).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))


def binomial_upper_bound(n: Column, p: Column, confidence: Column) -> Column:
    """Smallest count whose binomial distribution function reaches the confidence (0 < p < 1)."""
    start = F.struct(
        F.pow(F.lit(1.0) - p, n).alias("pmf"), F.lit(0.0).alias("upto"), F.lit(None).cast("int").alias("found")
    )

    def step(acc: Column, k: Column) -> Column:
        upto = acc["upto"] + acc["pmf"]
        return F.struct(
            (acc["pmf"] * (n - k).cast("double") / (k + 1).cast("double") * p / (F.lit(1.0) - p)).alias("pmf"),
            upto.alias("upto"),
            F.coalesce(acc["found"], F.when(upto >= confidence, k)).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda acc: F.coalesce(acc["found"], n.cast("int")))


def delta_for_h(h: float, floor: float) -> float:
    """The net bias whose effect size is ``h`` when flips of a total share ``floor`` are only redirected."""

    def reached(delta: float) -> bool:
        wrong, right = (floor + delta) / 2, (floor - delta) / 2
        return 2 * (math.asin(math.sqrt(min(1.0, wrong))) - math.asin(math.sqrt(max(0.0, right)))) >= h

    low, width = 0.0, floor
    for _ in range(200):
        width /= 2
        if not reached(low + width):
            low += width
    return low
