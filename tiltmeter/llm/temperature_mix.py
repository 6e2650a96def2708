"""Mixing sources to target weights by temperature, with DataFrame functions only.

The weight of a source is its share of all tokens to the power of an exponent (0: all sources alike,
1: the shares as they are), normalised. The exponent is the largest that still meets a target
entropy, raised if needed to the least one that keeps every source within a repetition limit; both
are found by bisection, with several exponents tried in each pass over the small table of sources.

The weights are then realised under a token budget: each source gets its quota in passes over its
documents. A pass takes the blocks of a source in a pseudo-random order and the documents of a block
in another. All passes but the last are whole; the last one ends with the document that fills the
quota. Where it ends is found from sums over blocks and then inside one block, so no source is ever
gathered in one task; the choice is then a plain filter on each document.

Defined results: a null text has no tokens; null is a source of its own; sources without tokens get
weight 0 and none of their rows; rows with equal id and text (null ids too) have one place in a
permutation and are drawn together; an empty table gives no rows. Other
columns are kept whatever their names, but those that start with ``mix_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.shared import stored

#: Exponents tried in a pass, passes, and documents in a block on average.
GRID, PASSES, BLOCK = 16, 9, 1000


def tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The exponent for ``sources(source, n_tokens)``; the repetition limit overrides the entropy."""
    used = sources.where("n_tokens > 0")
    total, count = used.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    if not total:
        return 1.0
    share = F.col("n_tokens").cast("double") / F.lit(float(total))
    ratio = float(budget if budget is not None else total) / float(total)

    def bisect(holds, rising: bool) -> float:
        """Border of a condition on [0, 1] that holds for large exponents if ``rising``, else for small ones."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            step = (hi - lo) / GRID
            tried = [lo + step * i for i in range(GRID + 1)]
            row = (
                used.select(share.alias("p"), F.explode(F.array(*[F.lit(x) for x in tried])).alias("x"))
                .groupBy("x")
                .agg(
                    F.sum(F.pow("p", F.col("x"))).alias("z"),
                    F.sum(F.pow("p", F.col("x")) * F.log("p")).alias("zl"),
                    F.max(F.pow("p", F.col("x") - 1)).alias("most"),
                )
                .orderBy("x")
                .collect()
            )
            good = [holds(r["x"], r["z"], r["zl"], r["most"]) for r in row]
            if rising:
                if good[0]:
                    return lo
                if not good[-1]:
                    return hi
                i = good.index(True)
            else:
                if good[-1]:
                    return hi
                if not good[0]:
                    return lo
                i = good.index(False)
            lo, hi = tried[i - 1], tried[i]
        return hi if rising else lo

    best = 1.0
    if entropy_share is not None:
        goal = entropy_share * math.log(count)
        best = bisect(lambda x, z, zl, most: math.log(z) - x * zl / z >= goal - 1e-12, rising=False)
    if max_repeats is not None:
        least = bisect(lambda x, z, zl, most: ratio * most / z <= max_repeats + 1e-12, rising=True)
        best = max(best, least)
    return round(best, 6)


def quotas(
    sources: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None, budget: int | None = None
) -> DataFrame:
    """``sources(source, n_tokens, n_docs)`` with ``weight``, ``quota`` tokens, whole ``passes`` and ``rest`` tokens."""
    x = exponent(sources, entropy_share, max_repeats, budget)
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    share = F.col("n_tokens").cast("double") / F.lit(float(max(total, 1)))
    raised = F.when(F.col("n_tokens") > 0, F.pow(share, F.lit(x))).otherwise(F.lit(0.0))
    weighed = sources.withColumn("raised", raised)
    norm = weighed.agg(F.sum("raised")).first()[0] or 1.0
    quota = F.floor(F.col("raised") / F.lit(float(norm)) * F.lit(float(budget)) + 0.5).cast("long")
    return (
        weighed.withColumn("weight", F.round(F.col("raised") / F.lit(float(norm)), 9))
        .withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("quota") / F.greatest("n_tokens", F.lit(1)))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("n_tokens"))
        .drop("raised")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 11,
) -> DataFrame:
    """The drawn rows: all columns of ``docs`` with ``mix_tokens``, ``mix_pass``, ``mix_block``, ``mix_order``, ``mix_weight``."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")))
    named = docs.select(  # the row is carried as one struct, so that no name of its own can clash
        F.struct(*docs.columns).alias("__row"), tokens(F.col(text_col)).alias("t"), key.alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("__src"),
    )
    light = stored(named.select("__src", "k", "t"), "mix-light")
    sources = stored(
        quotas(
            light.groupBy(F.col("__src").alias("source")).agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")),
            entropy_share, max_repeats, budget,
        ).withColumn("n_blocks", F.greatest(F.lit(1), F.floor(F.col("n_docs") / BLOCK)).cast("long")),
        "mix-sources",
    )
    per_source = sources.select(F.col("source").alias("__src"), "n_blocks", "passes", "rest", "weight")
    block = F.conv(F.substring("k", 1, 8), 16, 10).cast("long") % F.col("n_blocks")
    # of the last pass: blocks in order, then the block in which it ends, then the document
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("passes").cast("string"), F.col("__src"), F.col("block").cast("string")))
    inner = F.md5(F.concat_ws("|", F.col("passes").cast("string"), F.col("k")))
    last = light.join(per_source, "__src").where("rest > 0").withColumn("block", block)
    blocks = last.groupBy("__src", "passes", "rest", "block").agg(F.sum("t").alias("bt")).withColumn("turn", turn)
    in_turn = Window.partitionBy("__src").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        blocks.withColumn("upto", F.sum("bt").over(in_turn))
        .where("upto >= rest and upto - bt < rest")
        .select("__src", "block", "turn", (F.col("rest") - (F.col("upto") - F.col("bt"))).alias("need"))
    )
    inside = last.join(ends, ["__src", "block"]).withColumn("inner", inner)
    in_block = Window.partitionBy("__src", "block").orderBy("inner").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.groupBy("__src", "block", "turn", "need", "inner").agg(F.sum("t").alias("t"))
        .withColumn("upto", F.sum("t").over(in_block))
        .where("upto >= need and upto - t < need")
        .select("__src", F.col("turn").alias("cut_turn"), F.col("inner").alias("cut_inner"))
    )
    plan = stored(per_source.join(cuts, "__src", "left"), "mix-plan")

    drawn = named.join(plan, "__src").withColumn("block", block)
    in_last = (F.col("rest") > 0) & ((turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (inner <= F.col("cut_inner"))))
    drawn = drawn.withColumn("n", F.col("passes") + F.when(F.coalesce(in_last, F.lit(False)), 1).otherwise(0)).where("n > 0")
    drawn = drawn.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    order = F.md5(F.concat_ws("|", F.col("mix_pass").cast("string"), F.col("k")))
    turn_of = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("mix_pass").cast("string"), F.col("__src"), F.col("block").cast("string")))
    return drawn.select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if not c.startswith("mix_")], F.col("t").alias("mix_tokens"), "mix_pass", turn_of.alias("mix_block"), order.alias("mix_order"),
        F.col("weight").alias("mix_weight"),
    )
