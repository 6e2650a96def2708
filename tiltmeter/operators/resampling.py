"""Resamples that any engine can redo, from counts of equal cells.

Items with equal cells are interchangeable, so a resample is drawn for each class of them and not for each item. Of m items
whose difference is k, Binomial(m, 1/2) keep their sign. Of m equal items, a Poisson(m) number of copies enters a resample:
each item is drawn a Poisson(1) number of times, the bootstrap for data that no single task counts. Its resamples are of k items on
average only, which a ratio of sums does not see (``inference.counted_resamples`` draws exactly k). Both are found by
inversion: a hash of (seed, stream, keys, resample) is looked up in the distribution function of m, a table that is made once for
each m. Nothing is collected, and the work does not grow with items.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.columns import ratio
from tiltmeter.functions.numeric import cohens_h
from tiltmeter.operators.cells import BY

#: A hash is six numbers of ten hex digits.
DIGITS, DRAWS = 10, 6
#: Hashes of a class that are dealt to tasks together.
BLOCK = 200


def distributions(sizes: DataFrame) -> DataFrame:
    """``binomial, m, low, upto`` for distinct ``(binomial, m)``: ``upto[i]`` is the probability of at most ``low + i``, over all
    counts within nine deviations and twenty."""
    m, fair = F.col("m").cast("double"), F.col("binomial")
    centre, reach = F.floor(F.when(fair, m / 2).otherwise(m)), F.ceil(F.when(fair, 4.5 * F.sqrt(m)).otherwise(9 * F.sqrt(m))) + 20
    low, high = F.greatest(centre - reach, F.lit(0)), F.when(fair, F.least(centre + reach, F.col("m"))).otherwise(centre + reach)
    counts = sizes.select("binomial", "m", low.alias("low"), F.explode(F.sequence(low, high)).alias("x"))
    x = F.col("x").cast("double")
    ahead = F.when(F.col("x") == F.col("low"), 0.0).when(fair, F.log((m - x + 1) / F.greatest(x, F.lit(1.0)))).otherwise(F.log(m / F.greatest(x, F.lit(1.0))))
    each = Window.partitionBy("binomial", "m")
    upto = each.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shape = counts.withColumn("log", F.sum(ahead).over(upto))
    shape = shape.withColumn("p", F.exp(F.col("log") - F.max("log").over(each)))
    shape = shape.withColumn("upto", F.sum("p").over(upto) / F.sum("p").over(each))
    return shape.groupBy("binomial", "m", "low").agg(F.array_sort(F.collect_list(F.struct("x", "upto")))["upto"].alias("upto"))


def inverted(head: str, block: int, low: int, upto: np.ndarray) -> np.ndarray:
    """The counts of a block of resamples of one class, by inversion of its distribution."""
    hashes = b"".join(hashlib.sha256(f"{head}|{at}".encode()).digest()[: DRAWS * DIGITS // 2] for at in range(block * BLOCK, (block + 1) * BLOCK))
    u = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, DIGITS // 2) @ 256 ** np.arange(DIGITS // 2 - 1, -1, -1) / 16**DIGITS
    return low + np.minimum(np.searchsorted(upto, u, side="right"), len(upto) - 1)


def _classes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Classes of equal items with how many they are, for signs, effect sizes and the gate."""
    used = cells.where("n > 0")
    none = F.lit(0.0)

    def of(rows: DataFrame, stream: str, keys: list[Column], values: list[Column]) -> DataFrame:
        named = [v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]
        return rows.groupBy(*by, F.concat_ws(",", *[k.cast("string") for k in keys]).alias("key"), *named).agg(F.count(F.lit(1)).alias("m")).withColumn("stream", F.lit(stream))

    d = F.abs(F.col("b") - F.col("c"))
    n, b, c, nn, nb = (F.col(x) for x in ("n", "b", "c", "nn", "nb"))
    signs = of(used.where("b <> c"), "perm", [d], [d, none, none])
    flips = of(used, "boot", [n, b, c], [n, b, c])
    apart = ratio(b, n) - ratio(nb, nn)
    shared = of(used.where("nn > 0 and item_id <> ''"), "gate", [F.round(apart * 1e9).cast("long")], [F.round(apart, 12), F.lit(1.0), none])
    return signs.unionByName(flips).unionByName(shared)


def resamples(cells: DataFrame, by: list[str], n: int, seeds: dict[str, int]) -> DataFrame:
    """``stream, r`` and the sums ``s0, s1, s2`` of each resample; ``seeds`` by stream."""
    classes = _classes(cells, by).withColumn("binomial", F.col("stream") == "perm")
    known = distributions(classes.select("binomial", "m").distinct())
    per = BLOCK * DRAWS
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n // per) - 1)))
    seed = F.lit(None).cast("string")
    for stream, value in seeds.items():
        seed = F.when(F.col("stream") == stream, F.lit(str(value))).otherwise(seed)
    head = F.concat_ws("|", seed, "stream", *by, "key").alias("head")
    dealt = classes.join(known, ["binomial", "m"]).select(*by, "stream", "binomial", "m", "low", "upto", head, "v0", "v1", "v2", blocks.alias("block"))

    def sums(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, group = int(key[-1]), group.sort_values("head")
        total = np.zeros((per, 3))
        for r in group.itertuples():
            x = inverted(r.head, block, r.low, r.upto)
            total += np.outer(2 * x - r.m if r.binomial else x, (r.v0, r.v1, r.v2))
        kept = np.arange(block * per, min(n, (block + 1) * per))
        return pd.DataFrame(dict(zip([*by, "stream"], key[:-1], strict=True)) | {"r": kept} | {f"s{i}": total[: len(kept), i] for i in range(3)})

    kinds = dict(dealt.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "stream string, r int, s0 double, s1 double, s2 double"])
    return dealt.groupBy(*by, "stream", "block").applyInPandas(sums, shape)


def resampled(cells: DataFrame, by: list[str] = BY, n: int = 10_000, alpha: float = 0.05, seed: int = 20260830, gate_seed: int = 20260831) -> DataFrame:
    """``observed_d`` and the two-sided ``p`` of the sign flips, the ends ``h_lo, h_hi`` of the effect size, and the ends
    ``ci_lo, ci_hi`` of the difference to the noise (null where no item has both), for each group that has pairs."""
    low, high = int(alpha / 2 * n), min(n - 1, -int(-(1 - alpha / 2) * n // 1) - 1)
    d = (F.col("b") - F.col("c")).cast("long")
    seen = cells.where("n > 0").groupBy(*by).agg(F.sum(d).alias("observed_d"), F.max(F.abs(d)).alias("most"))
    sums = resamples(cells, by, n, {"perm": seed, "boot": seed, "gate": gate_seed})
    h = cohens_h(ratio(F.col("s1"), F.col("s0")), ratio(F.col("s2"), F.col("s0")))
    value = F.when(F.col("stream") == "perm", F.abs("s0")).when(F.col("stream") == "boot", h).otherwise(F.round(ratio(F.col("s0"), F.col("s1")), 12))
    ranked = sums.select(*by, "stream", value.alias("value")).withColumn("at", F.row_number().over(Window.partitionBy(*by, "stream").orderBy("value")) - 1)
    pick = lambda stream, at: F.max(F.when((F.col("stream") == stream) & (F.col("at") == at), F.col("value")))
    hits = F.sum(((F.col("stream") == "perm") & (F.col("value") >= F.abs("observed_d"))).cast("long"))
    found = ranked.join(seen, by).groupBy(*by, "observed_d", "most").agg(
        hits.alias("hits"), pick("boot", low).alias("h_lo"), pick("boot", high).alias("h_hi"), pick("gate", low).alias("ci_lo"), pick("gate", high).alias("ci_hi")
    )
    p = F.when(F.col("most") == 0, F.lit(1.0)).otherwise((F.col("hits") + 1).cast("double") / (n + 1))
    return found.select(*by, "observed_d", p.alias("p"), "h_lo", "h_hi", "ci_lo", "ci_hi")
