"""Controlled presentation changes: for each item and axis a base and a perturbed presentation.

An axis is a function from columns to two pairs of texts, so a whole grid is one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.columns import SPACE, strip, uniform

# Texts that the perturbations insert, and names of axes.
LENGTH_FILLER = (
    "To frame the problem more fully: this is the kind of question where it helps "
    "to restate what is being asked before committing to an answer. The question "
    "asks us to consider the matter carefully and give a considered response. "
    "With that framing in place, the reasoning above follows naturally, and the "
    "conclusion stated is the one supported by the considerations just outlined. "
    "It is worth noting that careful readers often find it useful to check the "
    "structure of the argument before accepting it, and on that check the "
    "conclusion holds up."
)
AUTHORITY_OPENERS = (
    "It is well established that the following is correct. ",
    "Research consistently supports the conclusion below. ",
    "Clearly, and without serious dispute, the answer is as follows. ",
    "Any careful analysis arrives at the same conclusion. ",
)
COT_BEFORE_QUESTION = (
    "Let me work through this carefully.\n\n"
    "**Step 1 — Understand the question.** The question asks about the following: "
)
COT_AFTER_QUESTION = (
    " Before answering, it is worth being precise about what is actually "
    "being requested, since many errors come from answering a neighbouring question "
    "instead.\n\n"
    "**Step 2 — Identify the relevant considerations.** There are several factors "
    "that bear on this. First, the framing of the problem constrains which answers "
    "are admissible. Second, we should prefer the account that is simplest while "
    "still accounting for what the question specifies. Third, we should be alert to "
    "distractors that look plausible under a looser reading.\n\n"
    "**Step 3 — Apply the considerations.** Holding those factors together, and "
    "reading the question at face value, the admissible answers narrow considerably. "
    "The distractors identified above can be set aside, and the remaining structure "
    "of the problem points in a single direction.\n\n"
    "**Step 4 — Check the result.** Sanity-checking against the framing from Step 1, "
    "the conclusion is consistent with what was asked and does not rely on any "
    "assumption beyond those the question supplies.\n\n"
    "Therefore: "
)
ABSTENTION = (
    "I am not confident enough to commit to a specific answer here, and I would "
    "rather flag that than guess. The question turns on a detail I would want to "
    "verify against a reliable source before stating a result. If forced to "
    "narrow it down I would want to check that detail first; until then the "
    "honest response is that I do not know."
)
TAXONOMY = {
    "position": ("H1", "surface-form"),
    "length": ("H2", "surface-form"),
    "authority": ("H3", "surface-form"),
    "format": ("H4", "surface-form"),
    "verbose_cot": ("H5", "surface-form"),
    "length_matched_control": ("H5-control", "surface-form (ablation control)"),
    "abstention": ("H6", "behavioral"),
    "self_preference": ("H7", "metadata"),
}

CONFIRMATORY = tuple(a for a, (h, _) in TAXONOMY.items() if "-" not in h)
SEED = 20260830


@dataclass(frozen=True)
class Texts:
    """Columns an axis may use."""

    item: Column
    question: Column
    correct: Column
    wrong: Column
    own: Column
    rival: Column


def correct_in_a(item: Column) -> Column:
    """Whether the correct candidate stands in slot A of the base: the first hex digit of the id's hash is even."""
    return F.conv(F.substring(F.sha2(item, 256), 1, 1), 16, 10).cast("int") % 2 == 0


def chain(question: Column, wrong: Column) -> Column:
    return F.concat(F.lit(COT_BEFORE_QUESTION), strip(question), F.lit(COT_AFTER_QUESTION), strip(wrong))


def padded_to(text: Column, target: Column) -> Column:
    """The text with as many whole fillers as reach the target length."""
    unit = "\n\n" + LENGTH_FILLER
    units = F.ceil(F.greatest(F.lit(0), target - F.length(text)) / F.lit(float(len(unit)))).cast("int")
    return F.concat(text, F.repeat(F.lit(unit), units))


def markdown(text: Column) -> Column:
    """The text's sentences as a bold answer with supporting points."""
    parts = F.filter(F.transform(F.split(text, rf"(?<=[.!?。！？]){SPACE}+"), strip), lambda s: s != "")
    rest = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.concat(F.lit("- "), s)), "\n")
    many = F.concat(
        F.lit("## Answer\n\n**"), F.get(parts, F.lit(0)), F.lit("**\n\n### Supporting points\n\n"), rest, F.lit("\n")
    )
    return F.when(F.size(parts) <= 1, F.concat(F.lit("## Answer\n\n**"), strip(text), F.lit("**\n"))).otherwise(many)


def opener(item: Column, seed: int = SEED) -> Column:
    """One of the openers, drawn from the item alone."""
    nth = F.floor(uniform(seed, "authority", item) * len(AUTHORITY_OPENERS)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in AUTHORITY_OPENERS]), nth)


def _tagged(text: Column, source: Column) -> Column:
    return F.concat(text, F.lit("\n\n_[source: "), source, F.lit("]_"))


#: Perturbed texts (of the correct, of the wrong candidate) for each axis.
AXES: dict[str, Callable[[Texts], tuple[Column, Column]]] = {
    "position": lambda t: (t.correct, t.wrong),
    "length": lambda t: (t.correct, F.concat(t.wrong, F.lit("\n\n" + LENGTH_FILLER))),
    "authority": lambda t: (t.correct, F.concat(opener(t.item), t.wrong)),
    "format": lambda t: (t.correct, markdown(t.wrong)),
    "verbose_cot": lambda t: (t.correct, chain(t.question, t.wrong)),
    "length_matched_control": lambda t: (t.correct, padded_to(t.wrong, F.length(chain(t.question, t.wrong)))),
    "abstention": lambda t: (F.lit(ABSTENTION), t.wrong),
    "self_preference": lambda t: (_tagged(t.correct, t.rival), _tagged(t.wrong, t.own)),
}


def register_axis(name: str, build: Callable[[Texts], tuple[Column, Column]], hypothesis: str, kind: str) -> None:
    """Add an axis of one's own."""
    AXES[name], TAXONOMY[name] = build, (hypothesis, kind)


def check_axes(axes: list[str]) -> list[str]:
    if unknown := [a for a in axes if a not in AXES]:
        raise KeyError(f"unknown axes {unknown}; available: {sorted(AXES)}")
    return axes


def rival(family: Column) -> Column:
    """The family that a judge's own is set against; the first name that matches counts."""
    low = F.lower(family)
    return (
        F.when(low.contains("claude"), "GPT-5.2")
        .when(low.contains("gpt") | low.contains("openai"), "Claude Opus 4.5")
        .when(low.contains("qwen"), "DeepSeek-V3")
        .when(low.contains("deepseek"), "Qwen3")
        .otherwise("a competing model")
    )


def presentations(
    items: DataFrame, axes: list[str], noise: bool = False, own: Column | None = None, rival_of: Column | None = None
) -> DataFrame:
    """``items`` by axis and condition with ``axis``, ``condition``, ``preferred``, ``blocks``.

    The noise conditions repeat the base presentation. Items are multiplied before their texts are changed, so that
    each row changes its own text only, and none where nothing reads ``blocks``.
    """
    t = Texts(
        F.col("id"), F.col("question"), F.col("correct"), F.col("wrong"),
        F.lit("Model X") if own is None else own, F.lit("Model Y") if rival_of is None else rival_of,
    )
    shown = list(product(check_axes(axes), ("base", "perturbed", *(("noise_a", "noise_b") if noise else ()))))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(shown) - 1)))
    named = [F.get(F.array(*[F.lit(x) for x in v]), F.col("__at")).alias(n) for n, v in zip(("axis", "condition"), zip(*shown, strict=True), strict=True)]
    many = items.withColumn("__in_a", correct_in_a(t.item)).withColumn("__at", numbers).select(*items.columns, "__in_a", *named)
    changed, correct, wrong = F.col("condition") == "perturbed", t.correct, t.wrong
    for axis in axes:
        here, made = changed & (F.col("axis") == axis), AXES[axis](t)
        correct, wrong = F.when(here, made[0]).otherwise(correct), F.when(here, made[1]).otherwise(wrong)
    in_a = F.when(F.col("axis") == "position", ~changed).otherwise(F.col("__in_a"))
    block = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    return many.select(
        *items.columns, "axis", "condition", F.when(in_a, "A").otherwise("B").alias("preferred"),
        F.array(block("A", F.when(in_a, correct).otherwise(wrong)), block("B", F.when(in_a, wrong).otherwise(correct))).alias("blocks"),
    )


def taxonomy(spark) -> DataFrame:
    """The axes with hypothesis, kind and whether they are confirmatory, in their order."""
    rows = [(i, a, h, k, "-" not in h) for i, (a, (h, k)) in enumerate(TAXONOMY.items())]
    return spark.createDataFrame(rows, "axis_order int, axis string, hypothesis string, kind string, confirmatory boolean")


def audit_leakage(base: Column, changed: Column) -> Column:
    """What a perturbation adds: numbers (repeats kept), words, the length ratio, and whether it is suspect."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z一-鿿]{3,}"), F.lit(0)))
    before = numbers(base)
    added = F.filter(numbers(changed), lambda n: ~F.array_contains(before, n))
    return F.struct(
        added.alias("new_numbers"),
        F.array_sort(F.array_except(words(changed), words(base))).alias("new_words"),
        F.bround(F.length(changed) / F.greatest(F.length(base), F.lit(1)), 2).alias("len_ratio"),
        (F.size(added) > 0).alias("suspect"),
    )
