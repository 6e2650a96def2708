"""Every audit query with SQL of its own gives the rows that DuckDB gives."""

import duckdb
import pytest

from tiltmeter.queries import ORACLE, QUERIES

TABLES = "documents benchmark".split()


def normal(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    wanted = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert normal(tuple(r) for r in got.select(*cols).collect()) == normal(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_all_resamples_find_the_planted_bias(spark, sf_dir):
    """At the operators' own number of resamples the sampled p is the exact one, and Holm's first step can be passed."""
    exact = {(r.judge_id, r.axis): r for r in QUERIES["permutation_p_exact"](spark, sf_dir).collect()}
    sampled = {(r.judge_id, r.axis): r for r in QUERIES["permutation_p"](spark, sf_dir).collect()}
    assert exact.keys() == sampled.keys()
    for key, r in sampled.items():
        assert r.observed_d == exact[key].observed_d and abs(r.p - exact[key].p) < 0.03
    rows = {(r.judge_id, r.axis): r for r in QUERIES["holm_verdicts"](spark, sf_dir).collect()}
    assert rows["hash-biased", "verbose_cot"].rejected and rows["hash-biased", "verbose_cot"].p < 0.001
    assert sum(r.rejected for (judge, _), r in rows.items() if judge == "hash-neutral") <= 1
