"""Prompts from presentations, and verdicts from answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.functions.columns import SPACE, strip

# The prompt's wording and the instructions of the three templates.
BODY_HEAD = "You are grading two candidate answers to the same question.\n\nQUESTION:\n"
BODY_DECIDE = "\n\nDecide which candidate better answers the question.\n"
BODY_REPLY = "\nReply with exactly two lines and nothing else:\nVERDICT: A\nREASON: one short sentence."
TEMPLATES = {
    "v1_standard": "",
    "v2_cot": (
        "Before committing, briefly restate what each candidate actually claims, then "
        "compare those claims against the question."
    ),
    "v3_substance": (
        "Judge only the substance of the answers. Ignore length, formatting, tone, "
        "markdown styling, and how confident each answer sounds."
    ),
}


def check_templates(templates: list[str]) -> list[str]:
    if unknown := [t for t in templates if t not in TEMPLATES]:
        raise KeyError(f"unknown templates {unknown}; available: {sorted(TEMPLATES)}")
    return templates


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "prompt_template string, instruction string")


def rendered(blocks: Column) -> Column:
    """The candidates as one text."""
    one = lambda b: F.concat(F.lit("=== CANDIDATE "), b["label"], F.lit(" ===\n"), strip(b["text"]), F.lit("\n"))
    return F.array_join(F.transform(blocks, one), "\n")


def prompt(question: Column, blocks: Column, instruction: Column, extra: Column | None = None) -> Column:
    """The text a judge reads; empty instructions leave no line."""
    extra = F.lit("") if extra is None else extra
    said = F.array_join(F.filter(F.array(instruction, extra), lambda p: p != ""), "\n")
    line = F.when(said == "", "").otherwise(F.concat(said, F.lit("\n")))
    return F.concat(F.lit(BODY_HEAD), strip(question), F.lit("\n\n"), rendered(blocks), F.lit(BODY_DECIDE), line, F.lit(BODY_REPLY))


def parse_verdict(raw: Column) -> Column:
    """A, B or TIE after the first VERDICT, else a bare capital letter of a short answer, else PARSE_FAIL."""
    named = F.upper(F.regexp_extract(raw, rf"(?i)VERDICT{SPACE}*[:\-]?{SPACE}*\**{SPACE}*(TIE|[AB])\b", 1))
    short = strip(raw)
    letter = F.when(F.length(short) <= 3, F.regexp_extract(short, r"\b([AB])\b", 1)).otherwise("")
    return (
        F.when(raw.isNull() | (short == ""), "PARSE_FAIL")
        .when(named != "", named)
        .when(letter != "", letter)
        .otherwise("PARSE_FAIL")
    )
