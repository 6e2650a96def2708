import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import columns as C
from tiltmeter.functions import numeric as N
from tiltmeter.operators import cells as K
from tiltmeter.operators import inference as I
from tiltmeter.operators import power as W
from tiltmeter.operators.axes import taxonomy
from tiltmeter.operators import resampling as D

CELL = "judge_id string, axis string, item_id string, n long, b long, c long, nn long, nb long, nc long"


def table(spark, rows):
    """rows: (axis, n, b, c, nn, nb, nc)"""
    return spark.createDataFrame([("j", r[0], f"i{i}", *r[1:]) for i, r in enumerate(rows)], CELL)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("x", [-7.0, -2.5, -0.3, 0.0, 0.7, 1.96, 4.2, 9.0])
def test_normal_cdf(spark, x):
    assert one(spark, p=N.normal_cdf(F.lit(x))).p == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-12)


@pytest.mark.parametrize("b,c", [(0, 0), (15, 15), (25, 5), (30, 10), (400, 300), (300, 300)])
def test_mcnemar(spark, b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        want = 1.0
    elif n > 500:
        want = 2 * (1 - 0.5 * (1 + math.erf(abs(abs(b - c) - 1) / math.sqrt(n) / math.sqrt(2))))
    else:
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert one(spark, p=N.mcnemar_exact(F.lit(b), F.lit(c))).p == pytest.approx(want, abs=1e-9)


def test_binomial(spark):
    for k, n, p in [(3, 10, 0.2), (0, 5, 0.5), (6, 5, 0.5), (-1, 5, 0.5), (40, 80, 0.5), (5, 5, 1.0)]:
        want = 0.0 if not 0 <= k <= n else math.comb(n, k) * p**k * (1 - p) ** (n - k)
        assert one(spark, x=N.binom_pmf(F.lit(k), F.lit(n), F.lit(p))).x == pytest.approx(want, rel=1e-9)
    assert one(spark, k=N.binomial_upper_bound(F.lit(24), F.lit(0.05), F.lit(0.95))).k == 3


def test_effect_sizes(spark):
    assert one(spark, h=N.cohens_h(F.lit(0.3), F.lit(0.1))).h == pytest.approx(2 * math.asin(math.sqrt(0.3)) - 2 * math.asin(math.sqrt(0.1)))
    d = N.delta_for_h(0.3, 0.15)
    assert 2 * (math.asin(math.sqrt((0.15 + d) / 2)) - math.asin(math.sqrt((0.15 - d) / 2))) == pytest.approx(0.3)


def test_permutation_null_and_signal(spark):
    rows = [("null", 10, 5, 5, 0, 0, 0)] * 8 + [("strong", 10, 8, 2, 0, 0, 0)] * 8 + [("empty", 10, 0, 0, 0, 0, 0)] * 2
    p = {r.axis: (r.observed_d, r.p) for r in I.permutation_p(table(spark, rows), n=960).collect()}
    assert p["null"] == (0, 1.0) and p["empty"] == (0, 1.0)
    assert p["strong"][0] == 48 and p["strong"][1] < 0.05


def test_exact_permutation_equals_all_signs(spark):
    diffs = [3, -1, 2, 2, 0, 1]
    rows = [("a", 10, max(d, 0), max(-d, 0), 0, 0, 0) for d in diffs]
    total = abs(sum(diffs))
    hits = sum(abs(sum(s * d for s, d in zip(signs, diffs, strict=True))) >= total for signs in itertools.product((1, -1), repeat=len(diffs)))
    assert I.permutation_p_exact(table(spark, rows)).first().p == pytest.approx(hits / 2 ** len(diffs))


def test_bootstraps_bracket_the_effect(spark):
    rows = [("a", 20, 6 + i % 3, 2, 0, 0, 0) for i in range(40)]
    h = K.totals(table(spark, rows)).first().h
    for f in (I.bootstrap_h, I.poisson_bootstrap_h):
        ends = f(table(spark, rows), n=400).first()
        assert ends.ci_lo < h < ends.ci_hi and ends.ci_hi - ends.ci_lo < 0.2


def test_results_do_not_depend_on_partitions(spark):
    rows = table(spark, [("a", 20, 5 + i % 4, 3, 20, i % 3, 2) for i in range(30)])
    for f in (lambda t: I.permutation_p(t, n=96), lambda t: I.bootstrap_h(t, n=50), lambda t: I.noise_gate(t, n=50)):
        assert f(rows.repartition(1)).collect() == f(rows.repartition(7)).collect()


GATES = [
    ([("a", 20, 15, 1, 20, 2, 10)] * 5, True), ([("a", 20, 10, 10, 20, 10, 10)] * 5, False), ([("a", 20, 2, 10, 20, 10, 2)] * 5, False),
]


@pytest.mark.parametrize("rows,above", GATES)
def test_noise_gate(spark, rows, above):
    assert I.noise_gate(table(spark, rows), n=100).first().above_noise is above


def test_noise_floor_is_the_wrong_direction_only(spark):
    got = K.noise_floor(table(spark, [("a", 20, 10, 2, 20, 2, 10)] * 5)).first()
    assert (got.noise_floor, got.noise_self_disagreement) == (pytest.approx(0.1), pytest.approx(0.6))


def test_gate_without_noise_is_missing_and_does_not_block(spark):
    assert I.noise_gate(table(spark, [("a", 20, 15, 1, 0, 0, 0)] * 5), n=50).count() == 0
    assert one(spark, v=I.verdict(F.lit(True), F.lit(None).cast("boolean"))).v == "systematic bias confirmed"
    assert one(spark, v=I.verdict(F.lit(True), F.lit(False))).v.startswith("significant but BELOW")


@pytest.mark.parametrize("ps,adjusted,rejected", [
    ([0.001, 0.04, 0.03], [0.003, 0.06, 0.06], [True, False, False]), ([0.04, 0.04], [0.08, 0.08], [False, False]),
    ([0.4, 0.5], [0.8, 0.8], [False, False]), ([0.001, 0.02, 0.4], [0.003, 0.04, 0.4], [True, True, False]),
])
def test_holm(spark, ps, adjusted, rejected):
    df = spark.createDataFrame([("j", i, p) for i, p in enumerate(ps)], "judge_id string, axis_order int, p double")
    got = I.holm(df, ["judge_id"], "axis_order").orderBy("axis_order").collect()
    assert [r.p_adjusted for r in got] == pytest.approx(adjusted) and [r.rejected for r in got] == rejected


def test_random_effects(spark):
    df = spark.createDataFrame([("j", "a", 0.5, 0.05)] * 20, "judge_id string, axis string, effect double, variance double")
    got = I.dersimonian_laird(df).first()
    assert got.pooled == pytest.approx(0.5) and got.tau_sq == pytest.approx(0) and got.se == pytest.approx(0.05)
    none = I.dersimonian_laird(spark.createDataFrame([("j", "a", 0.5, 0.0)], df.schema)).first()
    assert (none.pooled, none.p_meta, none.k) == (0.0, 1.0, 1)


def test_power_rises_and_false_positives_are_bounded(spark):
    power = {r.effect_h: r.power for r in W.power_grid(spark, [0.1, 0.7], [150], 40).collect()}
    assert power[0.7] > 0.9 > power[0.1]
    tests = spark.createDataFrame([(i < 2,) for i in range(24)], "rejected boolean")
    got = W.false_positives(tests).first()
    assert (got.tests, got.rejections, got.accept_up_to) == (24, 2, 3)


def test_uniform_is_stable_and_spread(spark):
    got = spark.range(2000).select(C.uniform("s", F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(got[0] - 0.5) < 0.03 and 0 <= got[1] < 0.01 and 0.99 < got[2] < 1
    assert taxonomy(spark).where("confirmatory").count() == 7


def mixed_cells(spark, items=300):
    rng = random.Random(3)
    rows = []
    for axis, tilt in (("length", 0.3), ("format", 0.0)):
        for _ in range(items):
            draw = lambda n, p, q: [sum(x) for x in zip(*[(u < p, p <= u < p + q) for u in (rng.random() for _ in range(n))], strict=True)] if n else [0, 0]
            n, nn = rng.choice([0, 3, 4, 4]), rng.choice([0, 4])
            rows.append((axis, n, *draw(n, 0.2 + tilt, 0.2), nn, *draw(nn, 0.15, 0.15)))
    return table(spark, rows)


def test_inversion_gives_the_distributions(spark):
    sizes = spark.createDataFrame([(f, m) for f in (True, False) for m in (1, 2, 7, 400, 30_000)], "binomial boolean, m long")
    for r in D.distributions(sizes).collect():
        x = np.concatenate([D.inverted(f"h{r.binomial}", b, r.low, np.array(r.upto)) for b in range(25)])
        mean, var = (r.m / 2, r.m / 4) if r.binomial else (r.m, r.m)
        assert r.upto == sorted(r.upto) and r.upto[-1] == pytest.approx(1, abs=1e-12) and len(x) == 30_000
        assert x.mean() == pytest.approx(mean, abs=5 * (var / len(x)) ** 0.5) and x.var() == pytest.approx(var, rel=0.06)
        if r.m <= 7:
            at = 0.5**r.m if r.binomial else math.exp(-r.m)
            assert r.low == 0 and r.upto[0] == pytest.approx(at, rel=1e-9) and (x == 0).mean() == pytest.approx(at, abs=0.01)


def test_resamples_agree_with_exact_draws_and_do_not_depend_on_partitions(spark):
    cells = mixed_cells(spark)
    got = {r.axis: r for r in D.resampled(cells).collect()}
    assert sorted(map(tuple, D.resampled(cells.repartition(7, "item_id")).collect())) == sorted(map(tuple, got.values()))
    exact = {r.axis: r.p for r in I.permutation_p_exact(cells).collect()}
    for r in I.counted_resamples(cells).collect():
        mine = got[r.axis]
        assert mine.observed_d == r.observed_d and abs(mine.p - exact[r.axis]) < 0.02
        assert all(abs(mine[c] - r[c]) < 0.02 for c in ("h_lo", "h_hi", "ci_lo", "ci_hi"))
    few = {r.axis: r for r in D.resampled(table(spark, [("a", 2, 1, 1, 0, 0, 0), ("b", 0, 0, 0, 2, 1, 0), ("c", 4, 4, 0, 4, 0, 0)]), n=100).collect()}
    assert set(few) == {"a", "c"} and few["a"].p == 1.0 and few["a"].ci_lo is None and few["c"].ci_hi == 1.0


def test_power_is_the_sum_over_outcomes(spark):
    n, p, q = 12, 0.45, 0.05
    wanted = 0.0
    for b in range(n + 1):
        for c in range(n + 1 - b):
            k = min(b, c)
            tail = min(1, 2 * sum(math.comb(b + c, i) for i in range(k + 1)) / 2 ** (b + c)) if b + c else 1
            if tail < 0.05 / 7:
                wanted += math.comb(n, b) * math.comb(n - b, c) * p**b * q**c * (1 - p - q) ** (n - b - c)
    rates = spark.createDataFrame([("x", p, q), ("none", 0.0, 0.0), ("all", 1.0, 0.0)], "name string, p_wrong double, p_right double")
    got = {r.name: r.power for r in W.exact_power(rates, n).collect()}
    assert got["x"] == pytest.approx(wanted, abs=1e-12) and got["none"] == 0.0 and got["all"] == pytest.approx(1.0)
    floors = spark.createDataFrame([("j", 0.15), ("k", 0.01)], "name string, floor double")
    least = {r.name: r.least_h for r in W.detectable(floors, 150).collect()}
    assert 0.3 < least["j"] < 0.6 and least["k"] is None


def test_null_data_are_rejected_as_often_as_chance_allows(spark):
    found = W.null_rejections(mixed_cells(spark))
    counts = W.false_positives(found).first()
    assert counts.tests == 96 and counts.rejections <= counts.accept_up_to


def test_grouping_sets_equal_both_passes(spark):
    rng = random.Random(1)
    rows = [
        ("j", "length", f"i{rng.randrange(20)}", rng.choice(["t1", "t2"]), rng.randrange(2), c, rng.choice(["A", "B", "TIE"]), "A")
        for c in ("base", "perturbed", "noise_a", "noise_b") for _ in range(150)
    ]
    log = spark.createDataFrame(rows, "judge_id string, axis string, item_id string, prompt_template string, rep int, condition string, verdict string, preferred string")
    both = K.cells_by_all(log)
    pick = lambda df: sorted(map(tuple, df.select(*K.BY, "item_id", "n", "b", "c", "nn", "nb", "nc", *K.TALLIES).collect()))
    assert pick(both.where(F.col("prompt_template") == K.POOLED)) == pick(K.counted_cells(log))
    assert pick(both.where("prompt_template = 't1'")) == pick(K.counted_cells(log.where("prompt_template = 't1'"), K.BY_TEMPLATE))
    accuracy = lambda df: {tuple(r) for r in df.select("judge_id", "axis", "acc_base", "n_base", "acc_pert", "n_pert").collect()}
    assert accuracy(K.counted_accuracy(K.counted_cells(log))) == accuracy(K.accuracy(log))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # judgments once, then what is left of them as partial sums
