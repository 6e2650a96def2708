"""The item pool: order, gates, hints, and the audit of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.columns import fingerprint, ratio, signed_gap, squeezed, strip, words_only

MIN_CHARS, MAX_CHARS, GAP_CAP, GAP_SHARE, MEAN_GAP, MIN_ITEMS = 40, 1200, 0.15, 0.10, 0.05, 150
DOMAINS = ("arithmetic", "logic", "code", "fact", "constraint")
# Wording that gives one side away.
HEDGES = r"(?i)\b(however|whereas|note that|strictly|importantly|careful)\b"
ADMISSIONS = r"(?i)\b(I'?m not sure|I don'?t know|unclear|cannot determine)\b"
MARKERS = ("as an ai", "i cannot", "it depends on your perspective")


def ranked(rows: DataFrame, by: str, order: Column, bucket: Column, name: str) -> DataFrame:
    """A gapless rank from 0 within each value of ``by``, without sorting such a value in one task.

    ``bucket`` must not fall where ``order`` rises: rows are numbered within their bucket, and only counts
    of buckets are summed up along the order.
    """
    made = rows.withColumn("__bucket", bucket)
    counts = made.groupBy(by, "__bucket").agg(F.count(F.lit(1)).alias("__count"))
    before = counts.withColumn("__before", F.sum("__count").over(Window.partitionBy(by).orderBy("__bucket")) - F.col("__count"))
    inside = made.withColumn("__n", F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(order)))
    same = F.col("l.__bucket").eqNullSafe(F.col("r.__bucket")) & F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}"))
    joined = inside.alias("l").join(before.select(by, "__bucket", "__before").alias("r"), same)
    return joined.select("l.*", (F.col("r.__before") + F.col("l.__n") - 1).alias(name)).drop("__bucket", "__n")


def interleaved(items: DataFrame, domains: tuple[str, ...] = DOMAINS, order: str = "pos", bucket: Column | None = None) -> DataFrame:
    """Round robin over the domains in their order: ``turn`` within the domain, then the domain.

    Large pools need a ``bucket`` (see ``ranked``), such as a range of ``order`` or its file and block;
    without one, each domain is one bucket.
    """
    rank = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    turns = ranked(items, "domain", F.col(order), F.lit(0) if bucket is None else bucket, "turn")
    return turns.withColumn("domain_rank", F.element_at(rank, F.col("domain")))


def shuffled(items: DataFrame, seed: int) -> DataFrame:
    """A pseudo-random order by the hash of seed and id."""
    return items.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"))))


def schema_errors(items: DataFrame) -> DataFrame:
    """``(id, error)`` for missing fields and ids that occur again (once for each repetition)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing key '{c}'")) for c in ("id", "domain", "question", "correct", "wrong")]))
    lacking = items.select("id", F.explode(missing).alias("error"))
    again = items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "id", F.explode(F.array_repeat(F.lit("duplicate id"), (F.col("n") - 1).cast("int"))).alias("error")
    )
    return lacking.unionByName(again)


def trivial_errors(items: DataFrame) -> DataFrame:
    """``(id, error)`` for candidates that are the same, too short or too long, or differ in case and final marks only."""
    made = items.where("correct is not null and wrong is not null").select("id", squeezed(F.col("correct")).alias("c"), squeezed(F.col("wrong")).alias("w"))
    c, w = F.col("c"), F.col("w")
    bare = lambda x: F.regexp_replace(F.lower(x), "[.!]+$", "")
    errors = F.when(c == w, F.array(F.lit("identical"))).otherwise(
        F.array_compact(
            F.array(
                F.when((F.length(c) < MIN_CHARS) | (F.length(w) < MIN_CHARS), "too short"),
                F.when((F.length(c) > MAX_CHARS) | (F.length(w) > MAX_CHARS), "too long"),
                F.when(bare(c) == bare(w), "differ only by case/punctuation"),
            )
        )
    )
    return made.select("id", F.explode(errors).alias("error"))


def gaps(items: DataFrame) -> DataFrame:
    return items.withColumn("gap", signed_gap(F.col("correct"), F.col("wrong")))


def gap_stats(items: DataFrame) -> DataFrame:
    """Items, mean and largest gap, and how many lie over the cap or to either side."""
    g = F.col("gap")
    return gaps(items).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(g), F.lit(0.0)).alias("mean_gap"), F.max(F.abs(g)).alias("max_gap"),
        F.coalesce(F.sum((F.abs(g) > GAP_CAP).cast("long")), F.lit(0)).alias("over_cap"),
        F.coalesce(F.sum((g > 0.02).cast("long")), F.lit(0)).alias("longer_correct"),
        F.coalesce(F.sum((g < -0.02).cast("long")), F.lit(0)).alias("longer_wrong"),
    )


def worst_gaps(items: DataFrame, k: int = 8) -> DataFrame:
    """The items with the largest gaps, ties in pool order."""
    return gaps(items).orderBy(F.abs("gap").desc(), "pos").limit(k)


def leakage_rates(items: DataFrame) -> DataFrame:
    """Shares of items with surface cues on either side."""
    c, w = F.col("correct"), F.col("wrong")
    digits = lambda x: F.regexp_count(x, F.lit("[0-9]"))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    return items.agg(
        share(c.rlike(HEDGES)).alias("hedge_correct"), share(w.rlike(HEDGES)).alias("hedge_wrong"),
        share(digits(c) > digits(w)).alias("digits_correct"), share(digits(w) > digits(c)).alias("digits_wrong"),
        share(lines(c) > lines(w)).alias("lines_correct"), share(lines(w) > lines(c)).alias("lines_wrong"),
        share(c.rlike(ADMISSIONS)).alias("admits"),
    )


def leakage_hints(items: DataFrame) -> DataFrame:
    """One row for each warning."""
    apart = lambda a, b, limit: F.abs(F.col(a) - F.col(b)) > limit
    return leakage_rates(items).select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(apart("hedge_correct", "hedge_wrong", 0.25), "hedging-language imbalance"),
                    F.when(apart("digits_correct", "digits_wrong", 0.30), "numeric-density asymmetry"),
                    F.when(apart("lines_correct", "lines_wrong", 0.30), "line-count asymmetry"),
                    F.when(F.col("admits") > 0.05, "correct answers express uncertainty"),
                )
            )
        ).alias("warning")
    )


def gate(items: DataFrame, strict: bool = False) -> DataFrame:
    """One row: error counts, balance figures and whether the pool passes."""
    errors = schema_errors(items).unionByName(trivial_errors(items)).agg(F.count(F.lit(1)).alias("errors"))
    both = gap_stats(items).join(errors)
    share = ratio(F.col("over_cap"), F.col("n"))
    passes = (F.col("errors") == 0) & (F.abs("mean_gap") <= MEAN_GAP) & (share <= GAP_SHARE)
    if strict:
        passes = passes & (F.col("n") >= MIN_ITEMS)
    return both.select("n", "errors", "mean_gap", share.alias("over_share"), passes.alias("passed"))


def audit(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Each of ``candidates(seq, question, correct, wrong)`` with ``fp``, ``accepted`` and the first ``reason`` against it.

    A question repeats another only if that one was accepted: a row that fails for another reason does
    not make later ones duplicates. ``existing`` has fingerprints ``fp`` of accepted questions.
    """
    q, c, w = (strip(F.coalesce(F.col(x), F.lit(""))) for x in ("question", "correct", "wrong"))
    made = candidates.select("*", q.alias("q"), c.alias("c"), w.alias("w")).withColumn("fp", fingerprint(F.col("q")))
    q, c, w = F.col("q"), F.col("c"), F.col("w")
    lr = F.length(c) / F.greatest(F.length(w), F.lit(1))
    missing = F.col("question").isNull() | F.col("correct").isNull() | F.col("wrong").isNull()
    first = F.when(missing, "missing field").when((q == "") | (c == "") | (w == ""), "empty field")
    marker = F.lit(None).cast("string")
    for m in reversed(MARKERS):
        marker = F.when(F.contains(F.lower(c), F.lit(m)) | F.contains(F.lower(w), F.lit(m)), f"contains '{m}'").otherwise(marker)
    later = (
        F.when(words_only(c) == words_only(w), "answers identical")
        .when((lr < 0.5) | (lr > 2.0), F.concat(F.lit("answer length ratio "), F.format_string("%.2f", lr)))
        .when((F.length(q) < 15) | (F.length(c) < 25) | (F.length(w) < 25), "too short")
        .otherwise(marker)
    )
    made = made.withColumn("first", first).withColumn("later", later)
    good = F.col("first").isNull() & F.col("later").isNull()
    known = F.lit(False)
    if existing is not None:
        made = made.join(existing.select("fp").distinct().withColumn("known", F.lit(True)), "fp", "left")
        known = F.coalesce("known", F.lit(False))
    accepted_at = made.where(good).groupBy("fp").agg(F.min("seq").alias("winner"))
    made = made.join(accepted_at, "fp", "left")
    repeats = known | F.coalesce(F.col("winner") < F.col("seq"), F.lit(False))
    reason = F.coalesce("first", F.when(repeats, "duplicate"), "later")
    return made.select(*candidates.columns, "fp", reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())


def domain_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def mark_offsets(items: DataFrame, width: float = 0.65) -> DataFrame:
    """Horizontal offsets of marks: rank of the id's hash within its domain, spread over a width."""
    hashed = F.sha2("id", 256)
    ranks = ranked(items, "domain", hashed, F.substring(hashed, 1, 3), "__rank").alias("l")
    sizes = domain_counts(items).withColumnRenamed("n", "__size").alias("r")
    both = ranks.join(sizes, F.col("l.domain").eqNullSafe(F.col("r.domain"))).select("l.*", "__size")
    return both.withColumn("offset", (F.col("__rank") / F.greatest(F.col("__size") - 1, F.lit(1)) - 0.5) * width).drop("__rank", "__size")


def candidates_of(answer: Column) -> Column:
    """The JSON array between the first and the last bracket of a generated text; empty without one."""
    kind = "array<struct<question:string,correct:string,wrong:string,domain:string,notes:string>>"
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), kind)
    return F.coalesce(found, F.array().cast(kind))
