"""Commands, from domain files to a report; the judge is a small server of the test."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tiltmeter.__main__ import main
from tiltmeter.operators import judges as J
from tiltmeter.operators import power as W
from tiltmeter.plans.experiment import consented
from tiltmeter.sources import records as S

GOOD = "The second statement holds because the first one implies it, as shown in case {}."
BAD = "The second statement fails because the first one denies it, as shown in case {}."


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(got["prompt"])
            new = [{"question": "Which of both statements is true here?", "correct": GOOD, "wrong": BAD}]
            text = f"Here: {json.dumps(new)}" if "JSON array" in got["prompt"] else "VERDICT: A"
            body = json.dumps({"response": text}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def _domains(folder, per_domain=2):
    folder.mkdir()
    for domain in ("logic", "fact"):
        rows = [{"id": f"{domain}{i}", "question": f"Is statement {i} of {domain} true?", "correct": GOOD.format(i), "wrong": BAD.format(i)} for i in range(per_domain)]
        (folder / f"{domain}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(folder)


def test_pool_is_built_and_validated(spark, tmp_path):
    said, out = [], str(tmp_path / "pool")
    folder = _domains(tmp_path / "in")
    assert main(["build", folder, out], spark, said.append) == 0
    ids = [r.id for r in S.load_items(spark, out).orderBy("pos").collect()]
    assert ids == ["logic0", "fact0", "logic1", "fact1"]
    assert main(["validate", out], spark, said.append) == 0 and said[-1] == "PASS"
    assert main(["validate", out, "--strict"], spark, said.append) == 1
    (tmp_path / "in" / "fact.jsonl").write_text('{"id": "logic0", "question": "q", "correct": "c", "wrong": "w"}\n' * 45)
    assert main(["build", folder, out], spark, said.append) == 1 and said[-1].endswith("... and 5 more")


def test_candidates_are_generated_and_audited(spark, service, tmp_path):
    url, asked = service
    (tmp_path / "brief.txt").write_text("Write questions about logic.")
    said, raw, kept = [], str(tmp_path / "raw"), str(tmp_path / "kept")
    made = ["generate", raw, "--brief", str(tmp_path / "brief.txt"), "--domain", "logic", "--rounds", "2", "--url", url, "--model", "m"]
    assert main(made, spark, said.append) == 0 and len(asked) == 2
    assert main(["audit", raw, kept], spark, said.append) == 0
    assert [(r.id[:4], r.domain, r.notes) for r in S.load_items(spark, kept).collect()] == [("gen-", "logic", "")]
    assert any("(duplicate)" in line for line in said)
    assert main(["audit", raw, str(tmp_path / "none"), "--against", kept], spark, said.append) == 0
    assert spark.read.schema(S.ITEM).json(str(tmp_path / "none")).count() == 0


def test_run_is_previewed_then_reported(spark, service, tmp_path):
    url, asked = service
    said, items = [], str(tmp_path / "pool.jsonl")
    rows = [{"id": f"i{i}", "domain": "fact", "question": f"Is {i} even?", "correct": GOOD.format(i), "wrong": BAD.format(i)} for i in range(4)]
    (tmp_path / "pool.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    call = ["run", items, "--axes", "position", "length", "--reps", "1", "--out", str(tmp_path), "--name", "r", "--url", url, "--model", "m", "--resamples", "50"]
    assert main([*call, "--dry-run"], spark, said.append) == 0 and not asked
    assert main(call, spark, said.append) == 0 and len(asked) == 4 * 2 * 4
    assert any(line.startswith("[BIAS]") or line.startswith("[  . ]") for line in said)
    assert main(call, spark, said.append) == 0 and len(asked) == 4 * 2 * 4
    assert "calls still to be made: 0" in said[-4] or any("calls still to be made: 0" in s for s in said)


def test_consent_and_limit_of_a_whole_run(spark):
    assert consented("ollama", 9, ask=lambda _: "n") and consented("openai", 9, yes=True)
    assert consented("openai", 9, ask=lambda _: " Y ") and not consented("anthropic", 9, ask=lambda _: "")
    waits = spark.sparkContext.accumulator(0.0)

    def transport():
        return J.Transport(lambda *a: (200, json.dumps({"response": "VERDICT: B"})), sleep=waits.add)

    asked = spark.range(8).selectExpr("string(id) as key", "'p' as prompt", "0.5D as temperature", "id as more")
    judge = J.HttpJudge("ollama", "http://x", "m", transport, per_minute=60.0, tasks=2)
    got = J.ask_all(asked, judge)
    assert got.rdd.getNumPartitions() == 2
    assert {(r.more, r.verdict) for r in got.collect()} == {(i, "B") for i in range(8)}
    assert 15.0 < waits.value <= 16.0  # 8 calls, each of which takes its task 2 seconds


def test_items_needed(spark):
    got = {r.effect_h: r.n_items for r in W.items_needed(spark, [0.05, 0.7], [10, 60, 100], n_sims=100).collect()}
    assert got[0.05] is None and got[0.7] in (60, 100)
