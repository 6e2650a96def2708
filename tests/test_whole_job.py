"""Queries and operators do the whole job: full resamples, all items."""

import math
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import inference as I
from tiltmeter.queries import QUERIES

CELL = "judge_id string, axis string, item_id string, n long, b long, c long, nn long, nb long, nc long"


def test_axis_results_reject_a_planted_bias(spark, sf_dir):
    got = {(r.judge_id, r.axis): r for r in QUERIES["axis_results"](spark, sf_dir).collect()}
    assert got["hash-biased", "verbose_cot"].verdict == "systematic bias confirmed"
    assert got["hash-biased", "verbose_cot"].p == pytest.approx(1 / (I.RESAMPLES + 1), abs=1e-9)
    assert not any(r.rejected for (judge, _), r in got.items() if judge == "hash-neutral")


def test_counted_resamples_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    n, nn = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    b = rng.binomial(n, 0.35)
    c, nb = rng.binomial(n - b, 0.3), rng.binomial(nn, 0.1)
    rows = [("j", "a", f"i{i}", *map(int, (n[i], b[i], c[i], nn[i], nb[i], 0))) for i in range(60)] + [("j", "none", "x", 0, 0, 0, 3, 1, 0)]
    table = spark.createDataFrame(rows, CELL)
    got = {r.axis: r for r in I.counted_resamples(table).collect()}
    assert tuple(got["none"])[2:] == (None,) * 6
    d, a = b - c, got["a"]
    spread = np.abs((rng.choice([-1, 1], (40_000, 60)) * d).sum(1))
    assert a.observed_d == d.sum() and a.p == pytest.approx((spread >= abs(d.sum())).mean(), abs=0.01)
    pick = rng.integers(0, 60, (40_000, 60))
    angle = lambda x: 2 * np.arcsin(np.sqrt(x[pick].sum(1) / n[pick].sum(1)))
    for values, ends in ((angle(b) - angle(c), (a.h_lo, a.h_hi)), ((b / n - nb / nn)[pick].mean(1), (a.ci_lo, a.ci_hi))):
        assert ends == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), abs=0.03)
    again = table.repartition(7).withColumn("nc", F.col("nc"))
    assert sorted(map(repr, I.counted_resamples(again).collect())) == sorted(map(repr, got.values()))


def test_exact_permutation_of_many_items(spark):
    made = lambda axis, ones, b: spark.range(ones).selectExpr(
        "'j' judge_id", f"'{axis}' axis", "string(id) item_id", "4L n", f"if(id < {b}, 1L, 0L) b", f"if(id < {b}, 0L, 1L) c", "0L nn", "0L nb", "0L nc"
    )
    many, b = 20_000, 10_150
    table = made("one", many, b).unionByName(made("two", 60, 38)).unionByName(
        made("two", 50, 30).withColumns({"item_id": F.concat(F.lit("x"), "item_id"), "b": F.col("b") * 3, "c": F.col("c") * 3})
    )
    got = {r.axis: r for r in I.permutation_p_exact(table).collect()}
    tail, term = 0, comb(many, b)
    for i in range(b, b + 1500):  # later terms are below 1e-50 of the first
        tail, term = tail + 2 * term, term * (many - i) // (i + 1)
    assert got["one"].observed_d == 300 and got["one"].p == pytest.approx(tail / 2**many, rel=1e-9)
    seen = 16 + 3 * 10
    hits = sum(comb(60, i) * comb(50, j) for i in range(61) for j in range(51) if abs(2 * i - 60 + 3 * (2 * j - 50)) >= seen)
    assert got["two"].observed_d == seen and got["two"].p == pytest.approx(hits / 2**110, rel=1e-9)


def test_exact_permutation_is_fast_for_millions_of_items():
    assert I._exact_p({}, 0) == 1.0
    p = I._exact_p({1: 3_000_000, 2: 1_000_000, 3: 300_000, 4: 60_000}, 6_000)
    sd = (3_000_000 + 4 * 1_000_000 + 9 * 300_000 + 16 * 60_000) ** 0.5
    assert p == pytest.approx(2 * (1 - 0.5 * (1 + math.erf(5_999 / sd / 2**0.5))), rel=1e-3)


def test_any_statistic_by_bags(spark):
    rng = np.random.default_rng(3)
    values = rng.exponential(1.0, 3_000)
    rows = spark.createDataFrame([("all", f"i{i}", float(v)) for i, v in enumerate(values)] + [("one", "x", 2.0), ("one", "y", None), (None, "z", 1.0)], "g string, item string, v double")

    def mean(x, w):
        return float((x * w).sum() / w.sum())

    plain = {r.g: r for r in I.bootstrap_any(rows, ["g"], "item", "v", mean, n=400, bag=5_000).collect()}
    bags = {r.g: r for r in I.bootstrap_any(rows.repartition(5), ["g"], "item", "v", mean, n=400, bag=500).collect()}
    error = values.std() / len(values) ** 0.5
    for got in (plain, bags):
        assert tuple(got["one"]) == ("one", 1, 2.0, 2.0, 2.0) and tuple(got[None])[1:] == (1, 1.0, 1.0, 1.0)
        a = got["all"]
        assert a.n_items == 3_000 and a.estimate == pytest.approx(values.mean(), abs=1e-9)
        assert (a.lo, a.hi) == pytest.approx((values.mean() - 1.96 * error, values.mean() + 1.96 * error), abs=0.4 * error)


def test_any_statistic_of_groups_of_any_size(spark):
    """Ends within the error of half a bin, and of the draws' own noise, of the plain bootstrap on a million rows."""
    def mean(x, w):
        return float((x * w).sum() / w.sum())

    def median(x, w):
        order = np.argsort(x, kind="stable")
        return float(x[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)])

    size, n = 1_000_000, 400
    rows = spark.range(size).select(F.lit("g").alias("g"), (-F.log((F.col("id") + 0.5) / size)).alias("v"))
    values = -np.log((np.arange(size) + 0.5) / size)
    for stat, spread in ((mean, values.std() / size**0.5), (median, 1 / size**0.5)):  # of an exponential law
        got = I.bootstrap_binned(rows, ["g"], "v", stat, n=n).first()
        assert got["n_items"] == size and got["error"] == pytest.approx((values.max() - values.min()) / 8_192)
        centre = stat(values, np.ones(size))
        assert abs(got["estimate"] - centre) <= got["error"] + 1e-9
        assert abs(got["ci_lo"] - (centre - 1.96 * spread)) <= got["error"] + 0.4 * spread
        assert abs(got["ci_hi"] - (centre + 1.96 * spread)) <= got["error"] + 0.4 * spread


def test_binned_bootstrap_equals_the_plain_one_on_whole_bins_and_defines_odd_groups(spark):
    def mean(x, w):
        return float((x * w).sum() / w.sum())

    table = [("all", float(v)) for v in (1, 3, 5, 7) for _ in range(v)]  # four bins of width 1.5, a value in each
    table += [("one", 2.0), ("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None), (None, 1.0)]
    rows = spark.createDataFrame(table, "g string, v double")
    got = {r.g: r for r in I.bootstrap_binned(rows, ["g"], "v", mean, n=250, bins=4, block=100).collect()}
    again = {r.g: r for r in I.bootstrap_binned(rows.repartition(7), ["g"], "v", mean, n=250, bins=4, block=100).collect()}
    assert got == again and set(got) == {"all", "one", None}
    assert tuple(got["one"])[1:] == (1, 2.0, 2.0, 2.0, 0.0) and tuple(got[None])[1:] == (1, 1.0, 1.0, 1.0, 0.0)
    whole = np.repeat([1.75, 3.25, 4.75, 6.25], [1, 3, 5, 7])  # the middles of the bins
    assert got["all"]["n_items"] == 16 and got["all"]["error"] == 0.75 and got["all"]["estimate"] == whole.mean()
    plain = np.sort([np.random.default_rng(i).choice(whole, 16).mean() for i in range(4_000)])
    assert abs(got["all"]["ci_lo"] - plain[100]) < 0.25 and abs(got["all"]["ci_hi"] - plain[3_899]) < 0.25
    assert I.bootstrap_binned(rows.limit(0), ["g"], "v", mean, n=10).count() == 0
    far = 2**53 + 1  # no double
    keys = spark.createDataFrame([(far, 1.0), (far + 1, 2.0), (None, 3.0)], "k long, v double")
    assert {r.k: r.estimate for r in I.bootstrap_binned(keys, ["k"], "v", mean, n=10).collect()} == {far: 1.0, far + 1: 2.0, None: 3.0}
