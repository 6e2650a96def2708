"""A run from items to verdicts: its identity, what may be resumed, and its results as DataFrames."""

from __future__ import annotations

import hashlib
import json
import signal
import subprocess
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.operators import axes as axis_table
from tiltmeter.operators import cells, inference, report, trials
from tiltmeter.operators.judges import PAID, HttpJudge, ask_all
from tiltmeter.operators.prompts import TEMPLATES, prompt
from tiltmeter.sources import files
from tiltmeter.sources.records import JUDGMENT, LOG_ORDER, load_log, load_manifest, report_rows

SCHEMA = 3


class ConfigConflict(RuntimeError):
    """Data of another experiment lies where this one would go on."""


@dataclass(frozen=True)
class RunConfig:
    """What a run is; the order of the axes is part of it."""

    items_path: str
    axes: tuple[str, ...] = axis_table.CONFIRMATORY
    reps: int = 5
    temperature: float = 0.7
    templates: tuple[str, ...] = ("v1_standard",)
    seed: int = 20260830
    noise: bool = True
    folder: str = "results"
    name: str = ""
    resume: bool = True

    def pilot(self) -> RunConfig:
        """Two axes, one template, one repeat."""
        return RunConfig(**{**asdict(self), "axes": self.axes[:2], "templates": self.templates[:1], "reps": 1})


def code_commit() -> str:
    """Twelve digits of the commit, or unknown."""
    try:
        got = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent)
        return got.stdout.strip()[:12] or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def run_id(config: RunConfig, items_sha256: str, judges: list[dict]) -> str:
    """Hash of all that changes what the data mean; neither places nor times nor the code's commit."""
    meaning = {
        "schema": SCHEMA, "axes": list(config.axes), "reps": config.reps, "temperature": config.temperature,
        "templates": list(config.templates), "seed": config.seed, "noise_floor": config.noise, "items_sha256": items_sha256,
        "judges": sorted(judges, key=lambda j: json.dumps(j, sort_keys=True)),
    }
    return hashlib.sha256(json.dumps(meaning, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def manifest_differences(old: dict, new: dict) -> list[str]:
    """What two manifests disagree in; an unknown commit agrees with any."""
    found = [k for k in ("schema", "items_sha256", "judges") if old.get(k) != new.get(k)]
    a, b = old.get("config", {}), new.get("config", {})
    found += [f"config.{k}" for k in sorted({*a, *b}) if a.get(k) != b.get(k) and k not in ("folder", "name", "resume")]
    commits = {old.get("code_commit", "unknown"), new.get("code_commit", "unknown")}
    return found + (["code_commit"] if len(commits) > 1 and "unknown" not in commits else [])


def consented(service: str, calls: int, yes: bool = False, ask: Callable[[str], str] = input) -> bool:
    """Whether calls may be made: a service that bills them needs a yes, given beforehand or when asked."""
    if service not in PAID or yes:
        return True
    return ask(f"{service} bills each of up to {calls:,} calls. Go on? [y/N] ").strip().lower() in ("y", "yes")


@contextmanager
def interrupt_drains(stop: threading.Event) -> Iterator[None]:
    """Within it, the first interrupt asks to stop after what is under way; a second one interrupts as usual."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    before = signal.getsignal(signal.SIGINT)

    def asked(*_) -> None:
        stop.set()
        signal.signal(signal.SIGINT, before)

    signal.signal(signal.SIGINT, asked)
    try:
        yield
    finally:
        signal.signal(signal.SIGINT, before)


def answered_by(judge: HttpJudge) -> Callable[[DataFrame], DataFrame]:
    """Trials answered by an opaque judge, as ``Experiment`` takes it."""

    def answer(grid: DataFrame) -> DataFrame:
        said = F.element_at(F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair]), F.col("prompt_template"))
        shown = prompt(F.col("question"), F.col("blocks"), said, F.col("extra_instruction"))
        return ask_all(grid.withColumn("prompt", shown), judge)

    return answer


@dataclass
class Experiment:
    """Items and judges under a configuration. ``answer`` turns pending trials into judgments."""

    spark: SparkSession
    config: RunConfig
    items: DataFrame
    judges: list[tuple[str, str]]
    answer: Callable[[DataFrame], DataFrame]
    identities: list[dict] = field(default_factory=list)
    commit: str | None = None
    #: Trials that are judged and appended together: what a killed run may lose.
    batch: int = 2_000

    def __post_init__(self) -> None:
        self.items_sha256 = report.file_sha256(self.config.items_path)
        self.identities = self.identities or [{"judge_id": j, "family": f} for j, f in self.judges]
        self.id = self.config.name or run_id(self.config, self.items_sha256, self.identities)
        self.paths = report.run_paths(self.config.folder, self.id)

    def manifest(self) -> dict:
        return {
            "run_id": self.id, "schema": SCHEMA, "created_utc": datetime.now(UTC).isoformat(timespec="seconds"),
            "config": json.loads(json.dumps(asdict(self.config))), "items_sha256": self.items_sha256, "judges": self.identities,
            "code_commit": code_commit() if self.commit is None else self.commit,
        }

    def expected_calls(self) -> int:
        c = self.config
        return trials.expected_calls(self.items.count(), len(self.judges), len(c.axes), len(c.templates), c.reps, c.noise)

    def grid(self) -> DataFrame:
        c = self.config
        judges = trials.judges_table(self.spark, self.judges)
        return trials.trials(self.items.select("id", "question", "correct", "wrong"), judges, list(c.axes), list(c.templates), c.reps, c.temperature, c.noise)

    def check_resumable(self) -> dict:
        """The manifest to go on with; refuses data of another experiment."""
        new = self.manifest()
        if not self.config.resume or not files.exists(self.paths["raw"]):
            return new
        old = load_manifest(self.paths["manifest"])
        if old is None:
            raise ConfigConflict("data without a manifest")
        if found := manifest_differences(old, new):
            raise ConfigConflict("the data there differ in " + ", ".join(found))
        return {**new, "created_utc": old["created_utc"]}

    def resumes(self) -> bool:
        return self.config.resume and files.exists(self.paths["raw"])

    def pending(self) -> DataFrame:
        """Trials that a run would judge: all, or those that the log lacks."""
        return trials.pending(self.grid(), load_log(self.spark, self.paths["raw"])) if self.resumes() else self.grid()

    def preview(self) -> list[str]:
        """What a run would do, and how many calls it takes at most; nothing is judged or written."""
        c = self.config
        return [
            f"judges: {', '.join(j for j, _ in self.judges)}", f"axes: {', '.join(c.axes)}", f"templates: {', '.join(c.templates)}",
            f"repeats: {c.reps}, conditions: {4 if c.noise else 2}", f"calls in all: {self.expected_calls():,}",
            f"calls still to be made: {self.pending().count():,}" if self.resumes() else "nothing is judged yet",
        ]

    def run(self, stop: threading.Event | None = None) -> bool:
        """Judge what the log lacks, a batch at a time; whether all was judged. The manifest is written before any data.

        Pending trials are written as files of a batch each and come back as a stream. Each micro-batch is one append of the
        log, tagged with the run and the batch, so that a batch that is done over after a failure of the driver's appends
        nothing twice. A run that is killed loses the batch under way; the next run takes up what the log lacks. An interrupt,
        or ``stop``, lets the batch under way finish and be appended, and ends the run there.
        """
        stop = stop or threading.Event()
        manifest = self.check_resumable()
        pending = self.pending()
        work = f"{self.config.folder.rstrip('/')}/_work/{self.id}-{uuid.uuid4().hex}"
        pending.repartition(max(1, -(-self.expected_calls() // self.batch))).write.parquet(f"{work}/pending")
        if files.exists(self.paths["raw"]) and not self.config.resume:
            files.set_aside(self.paths["raw"])
        report.write_json(self.paths["manifest"], manifest)
        busy = threading.Event()

        def judge(rows: DataFrame, number: int) -> None:
            if stop.is_set():
                return
            busy.set()
            try:
                judged = self.answer(rows).withColumn("is_correct", F.col("verdict") == F.col("preferred"))
                report.write_log(judged.select(*JUDGMENT.names), self.paths["raw"], append=True, tag=f"{work}#{number}")
            finally:
                busy.clear()

        stream = self.spark.readStream.schema(pending.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/pending")
        with interrupt_drains(stop):
            query = stream.writeStream.foreachBatch(judge).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
            while not query.awaitTermination(0.5):
                if stop.is_set() and not busy.is_set():  # batches that begin now are passed over
                    query.stop()
        done = not stop.is_set()
        files.remove(work)
        return done

    def judgments(self) -> DataFrame:
        return cells.first_by_key(load_log(self.spark, self.paths["raw"]), LOG_ORDER)

    def analyse(self, n: int = inference.RESAMPLES, by_template: bool = False) -> DataFrame:
        axes = axis_table.taxonomy(self.spark).where(F.col("axis").isin(*self.config.axes))
        return inference.axis_results(self.judgments(), axes, cells.BY_TEMPLATE if by_template else cells.BY, n)

    def write_report(self, n: int = inference.RESAMPLES) -> str:
        """Summary and report; only a line for each judge and axis reaches the driver."""
        judgments = self.judgments()
        split_up = len(self.config.templates) > 1
        if split_up:  # all templates together, and each, from one pass
            axes = axis_table.taxonomy(self.spark).where(F.col("axis").isin(*self.config.axes))
            both = files.stored(inference.all_results(judgments, axes, n), "results")
            each = both.where(F.col("prompt_template") != cells.POOLED)
            found = both.where(F.col("prompt_template") == cells.POOLED).drop("prompt_template")
        else:
            found = files.stored(self.analyse(n), "results")
        lines = found.withColumn("line", report.results_line(found)).orderBy("judge_id", "axis_order").select("judge_id", "line").collect()
        tables: dict[str, list[str]] = {}
        for r in lines:
            tables.setdefault(r["judge_id"], []).append(r["line"])
        per_judge = {r["judge_id"]: r.asDict() for r in cells.quality(judgments).collect()}
        split: dict[str, list[str]] = {}
        if split_up:
            for r in each.withColumn("line", report.results_line(each)).orderBy("prompt_template", "judge_id", "axis_order").collect():
                split.setdefault(f"{r['judge_id']} / {r['prompt_template']}", []).append(r["line"])
        versions = sorted({v for r in per_judge.values() for v in r["versions"]})
        config = {**asdict(self.config)}
        card = report.harness_card(config, self.id, self.items.count(), [j for j, _ in self.judges], versions, self.items_sha256)
        text = report.report_text(card, {j: report.quality_text(r) for j, r in per_judge.items()}, tables, split)
        files.write_text(self.paths["report"], text)
        report.write_csv(found, self.paths["results"])
        rows = [json.loads(x) for x in report.public_rows(found).toJSON().collect()]
        report.write_json(self.paths["summary"], {"manifest": self.manifest(), "results": rows})
        return text

    def check_report(self, n: int = inference.RESAMPLES) -> DataFrame:
        """``judge_id, axis, column, wanted, found`` where the report that was written differs from the log's results.

        Results don't depend on when they are computed, so ``n`` must be the report's.
        """
        found = files.stored(self.analyse(n), "results")
        each = [
            report.report_conflicts(found.where(F.col("judge_id") == judge), report_rows(self.spark, self.paths["report"], judge)).withColumn("judge_id", F.lit(judge))
            for judge, _ in self.judges
        ]
        conflicts = each[0]
        for more in each[1:]:
            conflicts = conflicts.unionByName(more)
        return conflicts.select("judge_id", "axis", "column", "wanted", "found")
