import json

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import columns as C
from tiltmeter.operators import axes as X
from tiltmeter.operators import cells as K
from tiltmeter.operators import judges as J
from tiltmeter.operators import pool as P
from tiltmeter.operators import prompts as R
from tiltmeter.operators import report as O
from tiltmeter.operators import trials as T
from tiltmeter.plans.experiment import ConfigConflict, Experiment, RunConfig
from tiltmeter.sources import bridge as B
from tiltmeter.sources import records as S
from tiltmeter.streaming.ingest import ingest, running_counts

ITEMS = [
    (f"x{i:02}", "fact", f"What is the answer to question number {i}, and why?", f"It is this one. It follows from the second rule. Case {i}.", f"It is that one. It does not follow at all. Case {i}.")
    for i in range(12)
]
FIELDS = "id string, domain string, question string, correct string, wrong string"


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, FIELDS)


@pytest.mark.parametrize("raw,verdict", [
    ("VERDICT: A\nREASON: x", "A"), ("verdict - **b**", "B"), ("**VERDICT:** B", "B"), ("VERDICT: TIE", "TIE"), ("B", "B"), (" a ", "PARSE_FAIL"),
    ("", "PARSE_FAIL"), (None, "PARSE_FAIL"), ("I prefer A because", "PARSE_FAIL"), ("VERDICT: A then VERDICT: B", "A"), ("VERDICT: Apple", "PARSE_FAIL"),
])
def test_parse_verdict(spark, raw, verdict):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(R.parse_verdict(F.col("raw"))).first()[0] == verdict


def test_position_is_pinned_and_truth_follows_the_text(items):
    shown = X.presentations(items, ["position", "abstention"], noise=True)
    rows = shown.where("axis = 'position'").collect()
    assert {(r.condition, r.preferred) for r in rows} == {("base", "A"), ("perturbed", "B"), ("noise_a", "A"), ("noise_b", "A")}
    for r in shown.collect():
        text = {b.label: b.text for b in r.blocks}[r.preferred]
        assert text == (X.ABSTENTION if r.axis == "abstention" and r.condition == "perturbed" else r.correct)


def test_perturbations_add_no_numbers_and_the_control_is_long_enough(items):
    t = X.Texts(*[F.col(c) for c in ("id", "question", "correct", "wrong")], F.lit("Own"), F.lit("Rival"))
    for axis in ("length", "authority", "format", "length_matched_control"):
        audited = items.select(X.audit_leakage(F.col("wrong"), X.AXES[axis](t)[1]).alias("a"))
        assert not any(r.a.suspect for r in audited.collect()), axis
    both = items.select(F.length(X.AXES["length_matched_control"](t)[1]).alias("a"), F.length(X.AXES["verbose_cot"](t)[1]).alias("b")).collect()
    assert all(r.a >= r.b for r in both)


def test_markdown(spark):
    got = spark.createDataFrame([("One. Two! Three?",), ("Only one",)], "t string").select(X.markdown(F.col("t"))).collect()
    assert got[0][0] == "## Answer\n\n**One.**\n\n### Supporting points\n\n- Two!\n- Three?\n"
    assert got[1][0] == "## Answer\n\n**Only one**\n"


def test_unknown_names_are_refused():
    with pytest.raises(KeyError):
        X.check_axes(["nope"])
    with pytest.raises(KeyError):
        R.check_templates(["nope"])


def test_grid_size_and_pending(spark, items):
    grid = T.trials(items, T.judges_table(spark, [("j", "Claude")]), ["length", "format"], ["v1_standard", "v2_cot"], 3)
    assert grid.count() == T.expected_calls(12, 1, 2, 2, 3) == grid.select("key").distinct().count()
    assert T.pending(grid, grid.where("rep = 0")).count() == grid.where("rep > 0").count()
    assert grid.select("rival_family").distinct().first()[0] == "GPT-5.2"


def test_surface_score_and_competence(spark):
    text = "Clearly, this is so.\\n\\n- I am not confident. " + "x" * 600
    row = spark.createDataFrame([(text.replace("\\n", "\n"), "why?")], "t string, q string")
    score = lambda label, **w: row.select(J.surface_score(F.col("t"), F.lit(label), F.lit("Own"), w)).first()[0]
    assert score("A") == 0.0 and score("A", position=0.5) == 0.5 and score("B", position=0.5) == 0.0
    assert score("B", length=0.2, authority=0.3, format=0.1, abstention=0.4) == pytest.approx(0.2)
    assert score("B", verbose_cot=1.0, self_preference=1.0) == 0.0
    assert row.select(J.item_competence(F.lit(""), 0.6, 0.2)).first()[0] == 0.6
    assert 0.4 <= row.select(J.item_competence(F.col("q"), 0.6, 0.2)).first()[0] <= 0.8


def test_transport_retries_and_redacts():
    slept, answers = [], iter([(429, "busy"), (500, "key SECRET"), (200, '{"response": "VERDICT: A"}')])
    t = J.Transport(lambda *a: next(answers), retries=3, sleep=slept.append, secrets=("SECRET",))
    assert t.post("u", {}, {}) == ({"response": "VERDICT: A"}, "") and slept == [1.5, 3.0]
    t = J.Transport(lambda *a: (500, "key SECRET"), retries=2, sleep=slept.append, secrets=("SECRET",))
    assert t.post("u", {}, {}) == (None, "HTTP 500: key [redacted]")
    calls = []
    t = J.Transport(lambda *a: calls.append(1) or (401, "no"), sleep=slept.append)
    assert t.post("u", {}, {})[0] is None and len(calls) == 1
    assert J.Transport(lambda *a: (200, "<html>")).post("u", {}, {}) == (None, "answer is not JSON")


def test_opaque_judge_stage(spark):
    prompts = spark.createDataFrame([("k1", "say A", 0.7), ("k2", "fail", 0.7)], "key string, prompt string, temperature double")

    def transport():
        def send(url, payload, headers):
            return (400, "bad") if payload["prompt"] == "fail" else (200, json.dumps({"response": "VERDICT: A"}))
        return J.Transport(send)

    got = {r.key: (r.verdict, r.error) for r in J.ask_all(prompts, J.HttpJudge("ollama", "http://x", "m", transport)).collect()}
    assert got == {"k1": ("A", ""), "k2": ("PARSE_FAIL", "HTTP 400: bad")}


def test_item_source_skips_comments_and_fails_on_bad_lines(spark, tmp_path):
    row = dict(zip(("id", "domain", "question", "correct", "wrong"), ITEMS[0], strict=True))
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("# note\n\n" + json.dumps(row) + "\n")
    bad.write_text(json.dumps(row) + "\n" + json.dumps({**row, "domain": "poetry"}) + "\n")
    assert S.load_items(spark, str(good)).select("id", "notes").collect() == [("x00", "")]
    with pytest.raises(Exception, match="bad item line"):
        S.load_items(spark, str(bad)).collect()


def test_pool_gates(spark, items):
    extra = [("x00", "fact", "q", "same text here", "same text here"), ("y", "fact", "q", "a" * 50 + "!", "A" * 50), ("z", "fact", "q", "short", "a" * 1300)]
    pool = items.unionByName(spark.createDataFrame(extra, FIELDS))
    assert P.schema_errors(pool).collect() == [("x00", "duplicate id")]
    assert sorted(tuple(r) for r in P.trivial_errors(pool).collect() if r.id in ("x00", "y", "z")) == [
        ("x00", "identical"), ("y", "differ only by case/punctuation"), ("z", "too long"), ("z", "too short"),
    ]
    assert P.gate(pool).first().passed is False


def test_audit_counts_only_accepted_rows_as_seen(spark):
    long = "A sentence that is long enough to be taken."
    rows = [(0, "What is the first question?", long, long), (1, "What is the first question?", long, long + " Not so."), (2, "what is the FIRST question", long, long + " Not at all."), (3, None, long, long)]
    got = {r.seq: r.reason for r in P.audit(spark.createDataFrame(rows, "seq long, question string, correct string, wrong string")).collect()}
    assert got == {0: "answers identical", 1: None, 2: "duplicate", 3: "missing field"}


def test_interleave_and_offsets(spark):
    pool = spark.createDataFrame([(f"{d}{i}", d, i) for d in ("fact", "logic") for i in range(3)], "id string, domain string, pos int")
    got = P.interleaved(pool, ("logic", "fact")).orderBy("turn", "domain_rank").select("id").collect()
    assert [r.id for r in got] == ["logic0", "fact0", "logic1", "fact1", "logic2", "fact2"]
    assert {r["offset"] for r in P.mark_offsets(pool).collect()} == {-0.325, 0.0, 0.325}


def test_first_by_key_and_upper_median(spark):
    log = spark.createDataFrame([("a", 0, "A"), ("a", 1, "B"), ("", 2, "A"), ("", 3, "B")], "key string, pos int, verdict string")
    assert sorted(tuple(r) for r in K.first_by_key(log, ["pos"]).collect()) == [("", 2, "A"), ("", 3, "B"), ("a", 0, "A")]
    rows = [("j", float(x), "A", "A", "", "m") for x in (0, 1, 2, 3)]
    judged = spark.createDataFrame(rows, "judge_id string, latency_ms double, verdict string, preferred string, error string, model_version string")
    assert K.quality(judged).first().median_latency_ms == 2.0


def test_formats(spark):
    row = spark.createDataFrame([(0.1234, float("nan"), 0.5)], "a double, b double, c double")
    got = row.select(C.interval(F.col("a"), F.col("c")), C.interval(F.col("a"), F.col("b")), C.percent(F.col("a")), C.finite(F.col("b")), C.redacted(F.lit("x.y k"), ["x.y", ""])).first()
    assert tuple(got) == ("[+0.123, +0.500]", "n/a", "12.3%", None, "[redacted] k")
    text = O.embed_section("body", "fig", "one")
    assert O.embed_section(text, "fig", "one") == text and "two" in O.embed_section(text, "fig", "two")


@pytest.fixture
def experiment(spark, items, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join(json.dumps(dict(zip(("id", "domain", "question", "correct", "wrong"), r, strict=True))) for r in ITEMS))

    def make(**changes):
        config = RunConfig(**({"items_path": str(path), "axes": ("length", "verbose_cot"), "reps": 2, "folder": str(tmp_path), "name": "run"} | changes))
        return Experiment(spark, config, items, [("hash-biased", "alpha")], B.judged_by_hash, commit="c1")

    return make


def test_run_resume_report(experiment, spark):
    run = experiment()
    run.run()
    assert run.judgments().count() == run.expected_calls()
    experiment().run()  # nothing is pending, nothing is doubled
    assert S.load_log(spark, run.paths["raw"]).count() == run.expected_calls()
    with pytest.raises(ConfigConflict):
        experiment(seed=1).run()
    with pytest.raises(ConfigConflict):
        other = experiment()
        other.commit = "c2"
        other.run()
    text = run.write_report(n=48)
    assert "`length`" in text and json.loads(open(run.paths["summary"]).read())["results"]
    assert run.check_report(n=48).count() == 0
    shown = spark.read.option("header", True).csv(run.paths["results"]).collect()
    assert {r.axis for r in shown} == {"length", "verbose_cot"} and all(r.verdict for r in shown)
    with open(run.paths["report"], "w") as out:
        out.write("\n".join(x.replace("| 12 |", "| 11 |") if x.startswith("| `length`") else x for x in text.split("\n") if "`verbose_cot`" not in x))
    conflicts = {(r.axis, r.column) for r in run.check_report(n=48).collect()}
    assert {("verbose_cot", c) for c in O.CHECKED} <= conflicts
    assert experiment(name="").id != experiment(name="", reps=3).id == experiment(name="", reps=3, folder="/else").id


def test_log_with_faults_and_stream(spark, experiment, tmp_path):
    run = experiment(name="faulty")
    run.run()
    folder = tmp_path / "log"
    lines = [r.value for r in spark.read.option("recursiveFileLookup", True).text(run.paths["raw"]).collect()]
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(lines[:50] + lines[:5]) + "\n" + lines[50][:40])
    assert S.load_log(spark, str(folder)).count() == 55
    target, state = str(tmp_path / "table"), str(tmp_path / "state")
    ingest(spark, str(folder), target, state)
    (folder / "b.jsonl").write_text("\n".join(lines[40:]) + "\n")
    ingest(spark, str(folder), target, state, files_per_batch=1)
    table = spark.read.parquet(target)
    assert table.count() == len(lines) == table.select("key").distinct().count()
    (folder / "c.jsonl").write_text("\n".join(json.dumps({**json.loads(x), "key": ""}) for x in lines[:3]) + "\n")
    ingest(spark, str(folder), target, state)
    assert spark.read.parquet(target).where("key = ''").count() == 3
    stream = running_counts(spark, target).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("counts").groupBy().sum("n").first()[0] == len(lines) + 3


def test_first_append_wins_whatever_the_files_are_called(spark, tmp_path):
    import os

    line = lambda verdict: json.dumps({"item_id": "i", "judge_id": "j", "verdict": verdict, "preferred": "A", "key": "k"})
    for name, verdict, at in (("z.json", "A", 1_000), ("a.json", "B", 2_000)):
        (tmp_path / name).write_text(line(verdict) + "\n" + line("TIE") + "\n")
        os.utime(tmp_path / name, (at, at))
    log = S.load_log(spark, str(tmp_path))
    assert [r.verdict for r in K.first_by_key(log, S.LOG_ORDER).collect()] == ["A"]
    assert [r.verdict for r in log.orderBy(*S.LOG_ORDER).collect()] == ["A", "TIE", "B", "TIE"]


def test_ranks_do_not_depend_on_buckets(spark):
    rows = spark.range(200).selectExpr("if(id % 7 = 0, null, string(id % 3)) as domain", "id * 31 % 200 as pos")
    rank = lambda bucket: {tuple(r) for r in P.ranked(rows, "domain", F.col("pos"), bucket, "rank").collect()}
    assert len(rank(F.lit(0))) == 200 and rank(F.lit(0)) == rank(F.floor(F.col("pos") / 16))


def test_report_rows_are_held_against_results(spark):
    results = spark.createDataFrame(
        [("length", 9, 0.5, 0.25, 0.52, 0.1, 0.9), ("format", 4, 0.5, 0.5, 0.0, None, None), ("none", 0, 0.0, 0.0, 0.0, None, None)],
        "axis string, n long, p_wrong double, p_right double, h double, h_lo double, h_hi double",
    )
    row = lambda axis, n, ci: [f"`{axis}`", "H", n, "", "", "", "50.0%", "25.0%" if axis == "length" else "50.0%", "", "", "+0.520" if axis == "length" else "+0.000", ci, *[""] * 4]
    table = lambda *rows: spark.createDataFrame([(r,) for r in rows], "cells array<string>")
    good = row("length", "9", "[+0.100, +0.900]"), row("format", "4", "n/a")
    assert O.report_conflicts(results, table(*good, row("other", "1", "n/a"))).count() == 0
    got = O.report_conflicts(results, table(row("length", "8", "n/a"), good[1][:-1])).collect()
    assert {(r.axis, r.column, r.found) for r in got} == {("length", "n", "8"), ("length", "ci", "n/a"), *(("format", c, None) for c in O.CHECKED)}
    flags = spark.createDataFrame([(True, None), (True, False), (False, True), (None, None)], "rejected boolean, above_noise boolean")
    assert [r.bias for r in O.bias_flag(flags).collect()] == [True, False, False, False]
    numbers = spark.range(5)
    assert O.first_lines(numbers, F.col("id"), ["id"], 2) == ["0", "1", "... and 3 more"] and O.first_lines(numbers, F.col("id"), ["id"], 5) == list("01234")


def test_candidates_are_appended_and_accepted_ones_replaced(spark, tmp_path):
    long = "A sentence that is long enough to be taken."
    rows = spark.createDataFrame([(0, "What is the first question?", long, long + " No."), (1, "Which?", long, long)], "seq long, question string, correct string, wrong string")
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "kept")
    O.append_candidates(rows, raw)
    O.append_candidates(rows, raw)
    assert spark.read.json(raw).count() == 4
    for _ in range(2):
        O.write_accepted(P.audit(rows), kept)
    assert [r.question for r in spark.read.json(kept).collect()] == ["What is the first question?"]


def test_records_of_an_empty_pool_fail(spark, items):
    assert S.pool_records(items).count() == len(ITEMS)
    with pytest.raises(Exception, match="item pool is empty"):
        S.pool_records(items.where("false")).collect()
