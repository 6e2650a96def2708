"""Steps that all audit queries share read and shuffle no more than they must; spans of draws equal a plain loop."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tiltmeter import queries as Q
from tiltmeter.operators import cells as K
from tiltmeter.operators import inference as I
from tiltmeter.operators.prompts import parse_verdict
from tiltmeter.operators.trials import key_counts, trial_key
from tiltmeter.sources import appends
from tiltmeter.sources import bridge as B
from tiltmeter.sources import records as S
from tiltmeter.streaming.ingest import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_shuffle_items_and_no_judgments(spark, sf_dir):
    assert plan(Q.cell_table(spark, sf_dir)).count("Exchange ") == 1


def test_verdicts_are_those_of_the_answers(spark, sf_dir):
    judged = B.hash_judgments(spark, sf_dir).where("item_id like '%7'")
    differ = judged.where(parse_verdict(F.col("raw")) != F.col("verdict"))
    assert differ.count() == 0 and judged.select("raw").distinct().count() == 13


def test_grid_is_exploded_from_numbers_and_keeps_its_verdicts(spark, sf_dir):
    assert "inline(" not in plan(B.hash_grid(spark, sf_dir))
    grid = B.hash_grid(spark, sf_dir).where("item_id like '%7'")
    assert grid.where(F.col("key") != trial_key()).count() == 0
    plain = B.judged_by_hash(grid.drop("__limits", "__bias")).select("key", F.col("verdict").alias("wanted"))
    both = B.judged_by_hash(grid).join(plain, "key", "full")
    assert both.where("verdict is distinct from wanted").count() == 0 and both.count() == grid.count() > 0


def test_grid_counts_make_no_texts_and_shuffle_no_keys(spark, sf_dir):
    told = plan(Q.QUERIES["trial_grid_counts"](spark, sf_dir)).replace(" ", "")
    assert "regexp_replace" not in told and told.count("Exchangehashpartitioning") == 2
    rows = [("d1", "a", "x"), ("d1", "a", "x"), ("d1", "a", "y"), ("d2", "a", "z"), ("d2", "b", "z")]
    counted = key_counts(spark.createDataFrame(rows, "item_id string, axis string, key string"), ["axis"])
    assert {(r.axis, r.n, r["keys"]) for r in counted.collect()} == {("a", 4, 3), ("b", 1, 1)}


def test_quality_and_first_by_key_read_once(spark, sf_dir):
    assert plan(Q.QUERIES["quality_metrics"](spark, sf_dir)).count("Scan parquet") == 1
    assert plan(Q.QUERIES["dedup_first_by_key"](spark, sf_dir)).count("Scan parquet") == 1


def test_signs_multiply_no_rows(spark):
    cells = spark.createDataFrame([("j", "a", f"d{i}", 4, i % 3, 1) for i in range(50)], "judge_id string, axis string, item_id string, n long, b long, c long")
    assert "46,47" not in plan(I.permutation_p(cells, n=96)).replace(" ", "")


def test_draws_over_several_spans_equal_a_loop(spark):
    k = I.SPAN + 3_000
    rows = spark.range(k).select(F.lit("j").alias("judge_id"), F.lit("a").alias("axis"), F.format_string("%07d", "id").alias("item_id"), "id", (F.col("id") / 8).alias("half"))
    got = {r.r: (r.id, r.half) for r in I._resampled(rows, K.BY, ["id", "half"], 2, 5, "s").collect()}
    drawn = Counter()
    for r in range(2):
        for slot in range(k):
            drawn[r] += int(int(hashlib.md5(f"5|s|j|a|{r}|{slot}".encode()).hexdigest()[:13], 16) / 2**52 * k)
    assert got == {r: (drawn[r], drawn[r] / 8) for r in range(2)}


def test_logs_are_written_compressed(spark, tmp_path):
    log = str(tmp_path / "log")
    appends.append(spark.createDataFrame([("k", "A")], "key string, verdict string"), log)
    written = [f for f in (tmp_path / "log").glob("data-*/part-*")]
    assert written and all(f.name.endswith(".json.gz") for f in written)
    assert spark.read.json(str(written[0])).count() == 1


def test_pending_trials_broadcast_no_keys(spark, sf_dir):
    """Spark takes an exploded grid for as small as its items, so it would hand all keys to the driver."""
    pending = Q.QUERIES["pending_trials_anti_join"](spark, sf_dir)
    assert pending.collect()
    final = plan(pending).partition("Initial Plan")[0]
    assert "BroadcastExchange" not in final and "SortMergeJoin" in final


def logged(spark, tmp_path):
    log, line = str(tmp_path / "log"), '{"item_id":"i","judge_id":"j","verdict":"A","preferred":"A","key":"k","rep":1}'
    appends.append(spark.read.json(spark.createDataFrame([(line,)], "value string").rdd.map(lambda r: r.value)), log)
    return log


def test_a_stream_of_a_log_parses_a_line_once(spark, tmp_path):
    log = logged(spark, tmp_path)
    assert "regexp" not in plan(appends.numbered(spark.read.text(log).selectExpr("value", "_metadata.file_path as file", "1 as written"), log))
    told = S.judged_lines(spark.read.text(log)).select("r.*")._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("from_json(") == 1
    ingest(spark, log, str(tmp_path / "table"), str(tmp_path / "state"))
    assert [(r.key, r.verdict, r.rep) for r in spark.read.parquet(str(tmp_path / "table")).collect()] == [("k", "A", 1)]


def test_a_log_is_parsed_once_and_only_as_far_as_asked(spark, tmp_path):
    log = logged(spark, tmp_path)
    read = K.first_by_key(S.load_log(spark, log), S.LOG_ORDER).groupBy("judge_id", "axis", "verdict").count()
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    some = S.load_log(spark, log, ["judge_id", "key"])
    told = K.first_by_key(some, S.LOG_ORDER)._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("from_json(") == 1 and "StructField(raw" not in told and "regexp" not in told
    assert set(some.columns) == {"item_id", "judge_id", "verdict", "preferred", "key", "is_correct", "file", *S.LOG_ORDER}
    whole = S.load_log(spark, log)
    assert whole.select(*some.columns).collect() == some.collect() and whole.first().rep == 1
