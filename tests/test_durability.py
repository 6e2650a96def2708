"""What a run leaves behind: on any store, after a kill, an interrupt, or a copy of its log."""

import json
import os
import shutil
import signal
import threading

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import cells as K
from tiltmeter.operators import report as O
from tiltmeter.plans.experiment import ConfigConflict, Experiment, RunConfig
from tiltmeter.sources import appends, bridge, files, manifests
from tiltmeter.sources import records as S

GOOD = "A statement that is right, number {}."
ITEMS = [(f"i{i}", "fact", f"Question {i}?", GOOD.format(i), f"Another statement, number {i}.") for i in range(4)]


@pytest.fixture(params=["plain", "uri"])
def make(request, spark, tmp_path):
    """Experiments in one folder, named as a plain path or as a URI."""
    folder = str(tmp_path) if request.param == "plain" else f"file://{tmp_path}"
    fields = ("id", "domain", "question", "correct", "wrong")
    (tmp_path / "items.jsonl").write_text("".join(json.dumps(dict(zip(fields, r, strict=True))) + "\n" for r in ITEMS))
    items = spark.createDataFrame(ITEMS, fields)

    def of(answer=bridge.judged_by_hash, batch=12, **changes):
        config = RunConfig(**({"items_path": f"{folder}/items.jsonl", "axes": ("length", "format"), "reps": 1, "folder": folder, "name": "run"} | changes))
        return Experiment(spark, config, items, [("hash-biased", "alpha")], answer, commit="c1", batch=batch)

    return of


def log_of(spark, run):
    return S.load_log(spark, run.paths["raw"])


def test_another_experiment_is_refused_and_nothing_is_lost(spark, make):
    run = make()
    assert run.run() and log_of(spark, run).count() == run.expected_calls() == 32
    before = sorted(tuple(r) for r in log_of(spark, run).select("key", "verdict").collect())
    with pytest.raises(ConfigConflict, match="reps"):
        make(reps=2).run()
    assert make().run() and sorted(tuple(r) for r in log_of(spark, run).select("key", "verdict").collect()) == before
    again = make(reps=2, resume=False)
    again.run()
    assert log_of(spark, again).count() == 64
    folder = again.config.folder.removeprefix("file://")
    aside = [n for n in os.listdir(folder) if ".replaced-" in n]
    assert len(aside) == 1 and S.load_log(spark, f"{folder}/{aside[0]}").count() == 32  # what was replaced is kept beside
    assert not os.listdir(f"{folder}/_work")


def test_a_killed_run_loses_one_batch_at_most(spark, make):
    calls = []

    def breaks(rows):
        calls.append(rows.count())
        if len(calls) == 3:
            raise RuntimeError("killed")
        return bridge.judged_by_hash(rows)

    run = make(breaks)
    with pytest.raises(Exception, match="killed"):
        run.run()
    assert log_of(spark, run).count() == sum(calls[:2]) > 0
    asked = []

    def counts(rows):
        asked.append(rows.count())
        return bridge.judged_by_hash(rows)

    rest = make(counts)
    assert rest.run() and sum(asked) == 32 - sum(calls[:2])
    log = log_of(spark, rest)
    assert log.count() == 32 == log.select("key").distinct().count()
    assert rest.judgments().count() == 32


def test_an_interrupt_lets_the_batch_finish(spark, make):
    seen = []

    def interrupts(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            os.kill(os.getpid(), signal.SIGINT)
        return bridge.judged_by_hash(rows)

    before = signal.getsignal(signal.SIGINT)
    run = make(interrupts)
    assert run.run() is False and signal.getsignal(signal.SIGINT) is before
    assert len(seen) == 1 and log_of(spark, run).count() == seen[0] < 32
    stop = threading.Event()
    stop.set()
    assert make().run(stop) is False and log_of(spark, run).count() == seen[0]
    assert make().run() is True and log_of(spark, run).count() == 32


def test_a_batch_is_appended_once(spark, tmp_path):
    rows = spark.range(5).selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as {f.name}" if f.name not in ("item_id", "verdict") else f"'x' as {f.name}" for f in S.JUDGMENT])
    at = f"{tmp_path}/log"
    assert [O.write_log(rows, at, True, tag) for tag in ("a#0", "a#1", "a#0", "")] == [0, 1, -1, 2]
    assert S.load_log(spark, at).count() == 15
    assert [r.append for r in appends.commits(spark, at).orderBy("append").collect()] == [0, 1, 2]


def test_order_survives_copies_and_lost_times(spark, tmp_path):
    line = lambda verdict: spark.createDataFrame([("i", "j", verdict, "A", "k")], "item_id string, judge_id string, verdict string, preferred string, key string")
    at, copy = tmp_path / "log", tmp_path / "copy"
    for verdict in ("A", "B", "TIE", "B"):
        appends.append(line(verdict), str(at))
    shutil.copytree(at, copy)
    (copy / "foreign.json").write_text(json.dumps({"item_id": "i", "judge_id": "j", "verdict": "PARSE_FAIL", "preferred": "A", "key": "k"}) + "\n")
    for turn, folder in enumerate((at, copy)):
        files.set_times(str(folder), 0)
        log = S.load_log(spark, str(folder))
        assert [r.verdict for r in log.orderBy(*S.LOG_ORDER).collect()] == ["A", "B", "TIE", "B", *["PARSE_FAIL"] * turn]
        assert [r.verdict for r in K.first_by_key(log, S.LOG_ORDER).collect()] == ["A"]


def test_small_files(spark, tmp_path):
    for at in (f"{tmp_path}/a/b.txt", f"file://{tmp_path}/a/c.txt"):
        assert not files.exists(at)
        with pytest.raises(OSError):
            files.read_text(at)
        assert files.write_new(at, "één\n") and not files.write_new(at, "two") and files.read_text(at) == "één\n"
        files.write_text(at, "two")
        assert files.read_text(at) == "two" and files.sha256(at) == "3fc4ccfe745870e2c0d99f71f30ff0656c8dedd41cc1d7d3d376b0dbe685e2f3"
    assert files.names(f"{tmp_path}/a") == ["b.txt", "c.txt"] and files.names(f"{tmp_path}/none") == []
    whole = files.sha256(f"{tmp_path}/a")
    files.write_text(f"{tmp_path}/a/c.txt", "other")
    assert len(whole) == 64 and files.sha256(f"{tmp_path}/a") != whole and files.sha256(f"{tmp_path}/none") == ""
    assert S.load_manifest(f"{tmp_path}/a/b.txt") is None and S.load_manifest(f"{tmp_path}/none") is None


def test_a_pool_in_many_files_keeps_its_order(spark, tmp_path):
    """Files by name are the pool in order, and no task writes it all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        pool = spark.range(500).selectExpr("'p' || id as id", "'fact' as domain", "'q' as question", "'c' as correct", "'w' as wrong", "'' as notes", "(id * 37) % 500 as turn", "0 as domain_rank")
        O.write_items(pool, f"{tmp_path}/pool")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = files.names(f"{tmp_path}/pool")
    assert len(names) > 2
    got = [json.loads(x)["id"] for n in names for x in (tmp_path / "pool" / n).read_text().splitlines()]
    assert got == [r.id for r in pool.orderBy("turn").collect()]
    assert [r.id for r in S.load_items(spark, f"{tmp_path}/pool").orderBy("pos").collect()] == got
    assert max(r["n"] for r in spark.read.text(f"{tmp_path}/pool").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) < 400


def test_manifests_of_a_folder(spark, make):
    run = make()
    run.run()
    for name, changes in (("same", {}), ("reps", {"reps": 3}), ("axes", {"axes": ("length",)})):
        other = make(name=name, **changes)
        O.write_json(other.paths["manifest"], other.manifest() | ({"code_commit": "unknown"} if name == "same" else {"code_commit": "c2"}))
    files.write_text(f"{run.config.folder}/torn_manifest.json", "{")
    found = manifests.differences(manifests.entries(spark, run.config.folder), "run")
    got = {(r.run_id, r.field): (r.wanted, r.value) for r in found.collect()}
    assert got == {
        ("reps", "config.reps"): ("1", "3"), ("axes", "config.axes"): ('["length","format"]', '["length"]'),
        ("reps", "code_commit"): ("c1", "c2"), ("axes", "code_commit"): ("c1", "c2"),
    }
