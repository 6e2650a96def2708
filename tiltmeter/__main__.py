"""Commands over pools, candidates, power and runs: ``python -m tiltmeter COMMAND --help``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tiltmeter.functions.columns import fingerprint
from tiltmeter.operators import axes, inference, judges, pool, power, prompts, report
from tiltmeter.plans.experiment import Experiment, RunConfig, answered_by, consented
from tiltmeter.sources import files, records

SHOWN_ERRORS, SHOWN_REJECTIONS = 40, 20
Say = Callable[[str], None]


def build(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Interleaves one file for each domain into a pool."""
    items = records.load_domain_files(spark, args.folder).where(F.col("domain").isin(*args.domains))
    counts = {r["domain"]: r["n"] for r in pool.domain_counts(items).collect()}
    for domain in args.domains:
        say(f"{domain:<14} {counts.get(domain, 0):>6} items")
    twice = report.first_lines(pool.schema_errors(items), F.concat_ws(": ", "id", "error"), ["id", "error"], SHOWN_ERRORS)
    if twice:
        say("\n".join(twice))
        return 1
    turns = pool.interleaved(items, tuple(args.domains))
    if args.shuffle:
        drawn = F.md5(F.concat_ws("|", F.lit(str(args.shuffle)), F.col("id")))
        report.write_items(turns.withColumn("drawn", drawn), args.out, ("drawn",))
    else:
        report.write_items(turns, args.out)
    gaps = pool.gap_stats(items).first()
    say(f"{gaps['n']} items in {args.out}; mean length gap {gaps['mean_gap']:+.4f}, largest {gaps['max_gap'] or 0:.3f}")
    return 0


def validate(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Counts, length balance, hints and errors of a pool; fails where the gate does."""
    items = records.load_drafts(spark, args.path)
    for r in pool.domain_counts(items).orderBy("domain").collect():
        say(f"{r['domain'] or '(none)':<16} {r['n']:>6}")
    figures = pool.gate(items, args.strict).first()
    say(f"items {figures['n']}, mean length gap {figures['mean_gap']:+.3f}, over the cap {100 * (figures['over_share'] or 0):.1f}%")
    for r in pool.worst_gaps(items.where("correct is not null and wrong is not null")).collect():
        say(f"  {r['id']} {r['gap']:+.3f}")
    for r in pool.leakage_hints(items).collect():
        say(f"  ! {r['warning']}")
    errors = pool.schema_errors(items).unionByName(pool.trivial_errors(items))
    for line in report.first_lines(errors, F.concat_ws(": ", "id", "error"), ["id", "error"], SHOWN_ERRORS):
        say(f"  x {line}")
    say("PASS" if figures["passed"] else "FAIL")
    return 0 if figures["passed"] else 1


def generate(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Asks a model for candidates, one prompt for each round, and appends them to a folder."""
    if not consented(args.service, args.rounds, args.yes):
        say("nothing was asked")
        return 1
    brief = files.read_text(args.brief)
    asked = spark.range(args.rounds).select(
        F.concat(F.lit(f"{brief}\n\nReply with a JSON array of {args.n} objects with question, correct and wrong. Round "), F.col("id") + 1).alias("prompt"),
        F.lit(args.temperature).alias("temperature"),
    )
    answers = judges.ask_all(asked, _judge(args)).select(F.inline(pool.candidates_of(F.col("raw"))))
    report.append_candidates(answers.withColumn("domain", F.lit(args.domain)), args.out)
    say(f"candidates appended to {args.out}; audit them next")
    return 0


def audit(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Takes or rejects candidates."""
    candidates = records.load_drafts(spark, args.candidates).drop("id").withColumnRenamed("pos", "seq")
    known = None
    if args.against:
        known = records.load_drafts(spark, args.against).select(fingerprint(F.coalesce("question", F.lit(""))).alias("fp"))
    audited = pool.audit(candidates, known)
    report.write_accepted(audited, args.out)
    counts = audited.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("accepted").cast("long")), F.lit(0)).alias("taken")).first()
    say(f"accepted {counts['taken']} of {counts['n']} in {args.out}")
    line = F.format_string("%s (%s)", F.substring(F.coalesce("question", F.lit("?")), 1, 40), F.col("reason"))
    for rejected in report.first_lines(audited.where("not accepted"), line, ["seq"], SHOWN_REJECTIONS):
        say(f"  {rejected}")
    return 0


def power_tables(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Items needed for each effect, the least effect that a pool detects, and the power at a small effect."""
    say("| h | items needed |\n|---|---:|")
    needed = power.items_needed(spark, args.effects, args.sizes, n_sims=args.sims)
    for r in needed.orderBy("effect_h").collect():
        say(f"| {r['effect_h']:.1f} | {r['n_items'] or f'>{max(args.sizes)}'} |")
    say("\n| items | least h at 80% power |\n|---|---:|")
    for n in args.pools:
        say(f"| {n} | {power.min_detectable_h(spark, n, n_sims=args.sims):.3f} |")
    say("\n| items | power at h = 0.2 |\n|---|---:|")
    for r in power.power_grid(spark, [0.2], args.pools, args.sims).orderBy("n_items").collect():
        say(f"| {r['n_items']} | {100 * r['power']:.1f}% |")
    return 0


def _judge(args: argparse.Namespace) -> judges.HttpJudge:
    key = os.environ.get(args.key_from, "") if args.key_from else ""

    def transport() -> judges.Transport:
        return judges.Transport(judges.http_send, secrets=(key,))

    return judges.HttpJudge(args.service, args.url, args.model, transport, args.per_minute or None, judges.key_headers(args.service, key))


def run(spark: SparkSession, args: argparse.Namespace, say: Say) -> int:
    """Judges a pool and writes its report; goes on where an earlier run stopped."""
    config = RunConfig(
        items_path=args.items, axes=tuple(axes.check_axes(args.axes)), reps=args.reps, temperature=args.temperature,
        templates=tuple(prompts.check_templates(args.templates)), seed=args.seed, folder=args.out, name=args.name, resume=not args.no_resume,
    )
    config = config.pilot() if args.pilot else config
    judge = _judge(args)
    items = records.load_items(spark, args.items)
    experiment = Experiment(spark, config, items, [(args.model, args.family or args.model)], answered_by(judge), [judge.identity()])
    say("\n".join(experiment.preview()))
    if args.dry_run:
        say("dry run: nothing was asked")
        return 0
    if not consented(args.service, experiment.expected_calls(), args.yes):
        say("nothing was asked")
        return 1
    experiment.run()
    experiment.write_report(args.resamples)
    for r in report.bias_flag(experiment.analyse(args.resamples)).orderBy("judge_id", "axis_order").collect():
        flag = "BIAS" if r["bias"] else "  . "
        say(f"[{flag}] {r['judge_id']} {r['axis']:<24} net {r['net_bias']:+.3f} h {r['h']:+.3f} p_adj {r['p_adjusted']:.4f} {r['verdict']}")
    say(f"report: {experiment.paths['report']}")
    return 0


def _service(command: argparse.ArgumentParser, temperature: float) -> None:
    command.add_argument("--service", choices=sorted(judges.SERVICES), default="ollama")
    command.add_argument("--url", required=True)
    command.add_argument("--model", required=True)
    command.add_argument("--key-from", default="", help="environment variable that holds the service's key")
    command.add_argument("--per-minute", type=float, default=0.0, help="calls a minute of the whole run; 0: no limit")
    command.add_argument("--temperature", type=float, default=temperature)
    command.add_argument("--yes", action="store_true", help="calls may be billed; don't ask")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tiltmeter", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, does: Callable, *paths: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=does.__doc__)
        command.set_defaults(does=does)
        for path in paths:
            command.add_argument(path)
        return command

    one = add("build", build, "folder", "out")
    one.add_argument("--domains", nargs="*", default=list(pool.DOMAINS))
    one.add_argument("--shuffle", type=int, default=0, help="seed of a final shuffle; 0 keeps the interleaved order")
    add("validate", validate, "path").add_argument("--strict", action="store_true", help="the pool must have its full size")
    one = add("generate", generate, "out")
    one.add_argument("--brief", required=True, help="file with the prompt that says what is wanted")
    one.add_argument("--domain", choices=pool.DOMAINS, required=True)
    one.add_argument("--n", type=int, default=40)
    one.add_argument("--rounds", type=int, default=3)
    _service(one, 0.8)
    add("audit", audit, "candidates", "out").add_argument("--against", default="", help="a pool whose questions count as taken")
    one = add("power", power_tables)
    one.add_argument("--effects", type=float, nargs="*", default=[0.2, 0.3, 0.5, 0.8])
    one.add_argument("--sizes", type=int, nargs="*", default=list(range(20, 700, 10)))
    one.add_argument("--pools", type=int, nargs="*", default=[40, 80, 120, 200, 300])
    one.add_argument("--sims", type=int, default=1000)
    one = add("run", run, "items")
    one.add_argument("--axes", nargs="*", default=list(axes.CONFIRMATORY))
    one.add_argument("--templates", nargs="*", default=["v1_standard"])
    one.add_argument("--reps", type=int, default=5)
    one.add_argument("--seed", type=int, default=axes.SEED)
    one.add_argument("--family", default="", help="the judge's family; its model's name where not given")
    one.add_argument("--out", default="results")
    one.add_argument("--name", default="")
    one.add_argument("--resamples", type=int, default=inference.RESAMPLES)
    for flag in ("--pilot", "--dry-run", "--no-resume"):
        one.add_argument(flag, action="store_true")
    _service(one, 0.7)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say: Say = print) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("tiltmeter").getOrCreate()
    return args.does(session, args, say)


if __name__ == "__main__":
    sys.exit(main())
