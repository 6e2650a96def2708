"""Reports: tables as text columns, exports, and the small files a driver writes."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.columns import finite, interval, percent, signed, strip
from tiltmeter.sources import appends, files

# The table's head; readers of reports look for its columns by place.
HEAD = (
    "| Axis | Hyp | pairs | items | acc base | acc pert | P(→wrong) | P(→right) | flips | net bias | Cohen h | 95% CI "
    "| p | p_adj | noise ▸wrong | verdict |\n|---|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|---|---:|---:|---:|---|"
)
#: Columns of an axis result that may be exported.
EXPORTED = (
    "axis", "hypothesis", "n_items", "n", "b", "c", "net_bias", "flip_rate", "p_wrong", "p_right", "h", "h_lo", "h_hi", "p",
    "p_adjusted", "rejected", "noise_floor", "above_noise", "verdict",
)


def results_line(results: DataFrame) -> Column:
    """One row of the table; a noise floor of 0 shows as a dash, and so do missing accuracies."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    acc = lambda c: F.coalesce(percent(F.col(c)), F.lit("—")) if c in results.columns else F.lit("—")
    floor = F.when(F.coalesce("noise_floor", F.lit(0.0)) == 0, "—").otherwise(percent(F.col("noise_floor")))
    cells = [
        F.concat(F.lit("`"), "axis", F.lit("`")), F.col("hypothesis"), F.col("n").cast("string"), F.col("n_items").cast("string"),
        acc("acc_base"), acc("acc_pert"), percent(F.col("p_wrong")), percent(F.col("p_right")), percent(F.col("flip_rate")),
        signed(F.col("net_bias")), signed(F.col("h")), interval(F.col("h_lo"), F.col("h_hi")), four("p"), four("p_adjusted"),
        floor, F.coalesce("verdict", F.lit("—")),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


#: Columns of a table row that must agree with the results they stand for, by their place.
CHECKED = {"n": 2, "p_wrong": 6, "p_right": 7, "h": 10, "ci": 11}


def report_conflicts(results: DataFrame, table: DataFrame) -> DataFrame:
    """``(axis, column, wanted, found)`` where a report's table (``cells``, one array for each row) differs from one judge's results.

    Axes without pairs aren't checked; an axis that the table lacks, or a row of another width, conflicts
    in every column with ``found`` null. Rows of axes without results are of no account.
    """
    wanted = {
        "n": F.col("n").cast("string"), "p_wrong": percent(F.col("p_wrong")), "p_right": percent(F.col("p_right")),
        "h": signed(F.col("h")), "ci": interval(F.col("h_lo"), F.col("h_hi")),
    }
    sound = table.where(F.size("cells") == HEAD.split("\n")[0].count("|") - 1)
    shown = sound.select(F.regexp_extract(F.get("cells", F.lit(0)), "^`(.*)`$", 1).alias("axis"), "cells")
    pair = lambda name: F.struct(F.lit(name).alias("column"), wanted[name].alias("wanted"), F.get("cells", F.lit(CHECKED[name])).alias("found"))
    each = results.where("n > 0").join(shown, "axis", "left").select("axis", F.inline(F.array(*map(pair, CHECKED))))
    return each.where(~F.col("wanted").eqNullSafe(F.col("found")))


def bias_flag(results: DataFrame) -> DataFrame:
    """With ``bias``: the corrected test rejects, and the noise gate, where there is one, is passed."""
    return results.withColumn("bias", F.coalesce("rejected", F.lit(False)) & F.coalesce("above_noise", F.lit(True)))


def first_lines(rows: DataFrame, line: Column, order: list[str], k: int) -> list[str]:
    """The first ``k`` lines in an order, and how many more there are."""
    total = rows.count()
    shown = [r[0] for r in rows.orderBy(*order).limit(k).select(line.cast("string")).collect()]
    return shown + ([f"... and {total - k} more"] if total > k else [])


def with_missing_axes(results: DataFrame, axes: DataFrame, judges: DataFrame) -> DataFrame:
    """A row for every judge and configured axis, with zero counts where there is no result."""
    wanted = judges.select("judge_id").join(F.broadcast(axes.select("axis", "axis_order", "hypothesis")))
    rest = [c for c in results.columns if c not in ("judge_id", "axis", "axis_order", "hypothesis")]
    joined = wanted.join(results.select("judge_id", "axis", *rest), ["judge_id", "axis"], "left")
    for c in ("n_items", "n", "b", "c"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    return joined


def public_rows(results: DataFrame) -> DataFrame:
    """The exported columns, numbers that are not finite as null."""
    kinds = dict(results.dtypes)
    return results.select("judge_id", *[(finite(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c)) for c in EXPORTED if c in kinds])


def write_csv(results: DataFrame, path: str) -> None:
    """The exported columns as CSV with a head, in place of an earlier export."""
    public_rows(results).write.mode("overwrite").option("header", True).csv(path)


def write_log(judgments: DataFrame, path: str, append: bool, tag: str = "") -> int:
    """One more append of the judgment log, or a new log; what lay there is then set aside. A ``tag`` is appended once."""
    if not append and files.exists(path):
        files.set_aside(path)
    return appends.append(judgments.withColumn("latency_ms", F.bround("latency_ms", 2)), path, tag)


def write_items(items: DataFrame, path: str, order: tuple[str, ...] = ("turn", "domain_rank")) -> None:
    """A pool in its order (interleaved, if not told otherwise) as JSON lines.

    The order is dealt to tasks by range: files by name, and lines by place, are the pool in order, however many files there are.
    """
    dealt = items.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(F.to_json(F.struct("id", "domain", "question", "correct", "wrong", "notes")).alias("value")).write.mode("overwrite").text(path)


_CANDIDATE = ("question", "correct", "wrong", "domain", "notes")


def append_candidates(candidates: DataFrame, path: str) -> None:
    """Raw candidates added to a folder of JSON lines; what lies there stays."""
    candidates.select(*[c for c in _CANDIDATE if c in candidates.columns]).write.mode("append").json(path)


def write_accepted(audited: DataFrame, path: str) -> None:
    """The accepted rows of an audit as items of a pool, in place of the folder's earlier ones."""
    given = {c: F.col(c) if c in audited.columns else F.lit(None).cast("string") for c in _CANDIDATE}
    item = [F.concat(F.lit("gen-"), "fp").alias("id"), F.coalesce(given["domain"], F.lit("fact")).alias("domain")]
    item += [strip(given[c]).alias(c) for c in ("question", "correct", "wrong")] + [F.coalesce(given["notes"], F.lit("")).alias("notes")]
    audited.where("accepted").select(*item).write.mode("overwrite").json(path)


def run_paths(folder: str, run_id: str) -> dict[str, str]:
    return {k: f"{folder}/{run_id}_{k}{e}" for k, e in (("raw", ".jsonl"), ("summary", ".json"), ("manifest", ".json"), ("report", ".md"), ("results", ".csv"))}


def harness_card(config: dict, run_id: str, n_items: int, judges: list[str], versions: list[str], items_sha256: str) -> str:
    rows = [
        ("run id", f"`{run_id}`"), ("generated (UTC)", datetime.now(UTC).isoformat(timespec="seconds")), ("items", n_items),
        ("axes", ", ".join(config["axes"])), ("replicates per condition", config["reps"]), ("temperature", config["temperature"]),
        ("prompt templates", ", ".join(config["templates"])),
        ("noise floor", "yes (2 unperturbed repeats)" if config["noise"] else "no"), ("seed", config["seed"]),
        ("judge ids", ", ".join(judges)), ("model version strings", ", ".join(versions) or "not reported"),
        ("item set", f"`{config['items_path']}` ({n_items} items)"), ("item set sha256[:12]", f"`{items_sha256[:12] or 'unreadable'}`"),
    ]
    return "\n".join(["| field | value |", "|---|---|", *[f"| {a} | {b} |" for a, b in rows]])


def quality_text(row: dict) -> str:
    if not row or not row.get("n"):
        return "_no judgments recorded_"
    share = lambda k: f"{row[k]} ({100 * row[k] / row['n']:.1f}%)"
    rows = [
        ("judgments recorded", row["n"]), ("parse failures", share("parse_fails")), ("ties", share("ties")),
        ("transport errors", row["errors"]), ("median latency", f"{row['median_latency_ms']:.0f} ms"),
        ("overall accuracy", f"{100 * row['accuracy']:.1f}%"),
    ]
    return "\n".join(["| metric | value |", "|---|---|", *[f"| {a} | {b} |" for a, b in rows]])


def report_text(card: str, quality: dict[str, str], tables: dict[str, list[str]], by_template: dict[str, list[str]]) -> str:
    parts = ["# Audit report", "", "## Disclosure", "", card, ""]
    for judge, lines in tables.items():
        parts += [f"## {judge}", "", quality.get(judge, ""), "", "\n".join([HEAD, *lines]), ""]
    if len(by_template) > 1:
        parts += ["## By template", ""]
        for name, lines in by_template.items():
            parts += [f"### {name}", "", "\n".join([HEAD, *lines]), ""]
    return "\n".join(parts)


def embed_section(text: str, name: str, body: str) -> str:
    """The text with the marked section replaced, or added at the end; doing it again changes nothing."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    section = f"{begin}\n{body}\n{end}"
    pattern = re.compile(re.escape(begin) + r".*?" + re.escape(end), re.DOTALL)
    return pattern.sub(lambda _: section, text) if pattern.search(text) else f"{text.rstrip()}\n\n{section}\n"


def file_sha256(path: str) -> str:
    """Hash of a pool's bytes; empty where it can't be read."""
    return files.sha256(path)


def write_json(path: str, value: dict) -> None:
    files.write_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=str))
