"""Toxic passages by maximum-scoring segments of token log-odds.

A token's log-odds compare its shares among the documents of the two classes. Counts are smoothed by
Dirichlet priors in levels: the prior of a prefix is the estimate of the prefix one letter shorter,
and that of a whole word the estimate of its longest prefix, so rare forms of a known stem inherit
its odds; a prefix counts its words but for the most toxic one. Where the odds differ clearly from even
(by likelihood ratio), on either side, they count; other tokens are taken as even. A token's score is its
log-odds and ``BACKGROUND``, the log of the odds of toxic passages before any token is seen. A linear scan
(Ruzzo and Tompa) finds all maximal scoring segments of a text. A segment of score s in n tokens is
expected ``K n exp(-lambda s)`` times by chance; lambda solves the usual moment equation over clean
texts and K is fitted to their best segments. Segments with an expectation below ``SIGNIFICANT`` are
toxic passages. A document's statistic is the sum of their surpluses over that level, and a logistic
fit turns it into a score.

The lexicon is fitted on a bounded sample (``labelled.PER_CLASS`` rows of each class); its counts are
summed in Spark, and what passes the evidence limits is broadcast. lambda, K and the logistic are fitted on
texts that their lexicon has not seen: the sample is dealt into ``PARTS`` by a hash of the text, and each part is
scanned with the lexicon of the others. Texts are scanned where they lie.

Defined results: a null or empty text has no segments and gets the score of the offset alone; repeated
rows are scored each; a null id is not held out; without labels of both classes no token is toxic and
every score is the share of label 1 (0.5 without labels); other columns are kept as they are, but
those named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.labelled import calibrated, class_weights, fold, labelled_sample, sigmoid
from tiltmeter.llm.shared import hand_back_memory, stored

TOKEN = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8
#: Weight of a prior in documents; least toxic documents and least evidence in standard errors of a lexicon entry.
PRIOR, LEAST_TEXTS, ERRORS = 2.0, 4, 4.0
BACKGROUND = -0.6
#: Parts of the sample; each is scanned with the lexicon of the others.
PARTS = 3
#: Shares are kept this far from 0 and 1.
LEAST_SHARE = 0.001
SIGNIFICANT, THRESHOLD, WORD_CACHE = 0.05, 0.3, 100_000


def levels(word: str) -> list[str]:
    """Features of a word from the shortest prefix to the whole word (marked by a final dot)."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "."]


def evidence(toxic: float, clean: float, share: float) -> float:
    """Signed root of the likelihood ratio against the share of toxic documents; exact enough at small counts."""
    n = toxic + clean
    gain = sum(c * np.log(c / (n * p)) for c, p in ((toxic, share), (clean, 1 - share)) if c)
    return float(np.sqrt(2 * max(gain, 0.0)) * (1 if toxic > n * share else -1))


def lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Scores of features from (toxic, clean) document counts; only of those whose odds differ clearly from even."""
    if not toxic or not clean:
        return {}
    scale_t, scale_c = min(toxic, clean) / toxic, min(toxic, clean) / clean
    share: dict[str, float] = {"": 0.5}
    found: dict[str, float] = {}
    for feature in sorted(counts, key=lambda f: (len(f.rstrip(".")), f.endswith("."))):
        stem = feature.rstrip(".")
        parent = (stem if len(stem) <= LONGEST else stem[:LONGEST]) if feature.endswith(".") else feature[:-1]
        while parent and parent not in share:
            parent = parent[:-1]
        a, b = counts[feature][0] * scale_t, counts[feature][1] * scale_c
        q = (a + PRIOR * share[parent]) / (a + b + PRIOR)
        q = share[feature] = min(max(q, LEAST_SHARE), 1 - LEAST_SHARE)
        clear = evidence(*counts[feature], toxic / (toxic + clean))
        if (counts[feature][0] >= LEAST_TEXTS and q > 0.5 and clear >= ERRORS) or (q < 0.5 and clear <= -ERRORS):
            found[feature] = float(np.log(q / (1 - q))) + BACKGROUND
    return found


class Scorer(dict):
    """Scores of tokens; a token takes the score of its most specific known feature."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.lexicon = known

    def __missing__(self, token: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        word = token.lower()
        got = next((self.lexicon[f] for f in reversed(levels(word)) if f in self.lexicon), BACKGROUND)
        self[token] = got
        return got


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time."""
    if not len(scores):
        return []
    upto = np.cumsum(scores)
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    before: list[int] = []  # for each open segment, the nearest one to its left with a smaller sum before it
    for i in np.flatnonzero(scores > 0):
        start, end, left, right = int(i), int(i) + 1, float(upto[i] - scores[i]), float(upto[i])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = before[j]
            if j < 0 or out[j][3] >= right:
                before.append(j)
                out.append((start, end, left, right))
                break
            start, left = out[j][0], out[j][2]
            del out[j:], before[j:]
    return [(s, e, r - l) for s, e, l, r in out]


class Model:
    """Lexicon, extreme-value parameters and the logistic."""

    def __init__(self, known: dict[str, float], counts: dict[int, int]):
        share = (counts[1] + 0.5) / (counts[0] + counts[1] + 1)
        self.lexicon, self.rate, self.scale = known, 1.0, 0.1
        self.slope, self.offset = 0.0, float(np.log(share / (1 - share)))

    def fit_chance(self, best: list[float], tokens: list[int], score_counts: dict[float, int]) -> None:
        """lambda and K from the tokens and the best segments of clean texts."""
        values = np.array(sorted(score_counts))
        weight = np.array([score_counts[v] for v in values.tolist()], dtype=float)
        if not len(values) or values[-1] <= 0:
            return
        weight /= weight.sum()
        low, high = 1e-6, 50.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if float(weight @ np.exp(np.minimum(mid * values, 600))) < 1 else (low, mid)
        self.rate = low
        hit = [np.exp(-self.rate * b) * n for b, n in zip(best, tokens, strict=True) if n]
        # the chance of no segment above b is exp(-K n exp(-lambda b)): the mean of n exp(-lambda b) is 1 / K
        self.scale = float(1 / max(1e-9, np.mean(hit))) if hit else 0.1

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments (start, end, score, expectation)."""
        n = len(scores)
        found = []
        for start, end, score in segments(scores):
            expected = self.scale * n * float(np.exp(-self.rate * score))
            if expected < SIGNIFICANT:
                found.append((start, end, score, expected))
        return found

    def statistic(self, scores: np.ndarray) -> float:
        """Sum of the surpluses of significant segments, on a root scale; 0 without any."""
        total = sum(np.log(SIGNIFICANT / max(e, 1e-300)) for *_, e in self.passages(scores))
        return float(np.sqrt(total))

    def score(self, scores: np.ndarray) -> float:
        return float(sigmoid(np.array(self.slope * self.statistic(scores) + self.offset)))


def token_scores(text: str | None, scorer: Scorer) -> np.ndarray:
    return np.array([scorer[w] for w in TOKEN.findall(text or "")], dtype=float)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out: int) -> Model:
    sample, counts = labelled_sample(docs, labels, label_col, id_col, text_col, folds, held_out)
    sample = stored(sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")), "toxic-sample")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label, part in zip(batch["text"], batch["label"], batch["part"], strict=True):
                words = sorted(set(TOKEN.findall(text.lower())))
                yield pd.DataFrame({"part": part, "word": words, "toxic": int(label), "clean": 1 - int(label)})

    words = (
        sample.select("text", "label", "part").mapInPandas(spell, "part int, word string, toxic long, clean long")
        .groupBy("part", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # lexicon PARTS is learned from all parts, lexicon i from all but part i
    learning = F.filter(F.sequence(F.lit(0), F.lit(PARTS)), lambda x: x != F.col("part"))
    words = words.select(F.explode(learning).alias("lex"), "word", "toxic", "clean").groupBy("lex", "word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    sizes = {(p, c): 0 for p in range(PARTS) for c in (0, 1)}
    sizes |= {(r["part"], r["label"]): r["count"] for r in sample.groupBy("part", "label").count().collect()}
    of = [[sum(n for (p, c), n in sizes.items() if c == label and p != lex) for label in (0, 1)] for lex in range(PARTS + 1)]
    if not all(of[PARTS]):
        return Model({}, counts)
    share = F.element_at(F.array(*[F.lit((t + 0.5) / (t + c + 1)) for c, t in of]), F.col("lex") + 1)
    n, gain = F.col("toxic") + F.col("clean"), lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / (n * p))).otherwise(0.0)
    # at most what the bounded sample holds; the lexicon's own limits are the finer ones
    rows = feature_counts(words).where((n > 0) & (gain("toxic", share) + gain("clean", 1 - share) >= ERRORS**2 / 4)).collect()
    found: list[dict[str, tuple[int, int]]] = [{} for _ in of]
    for r in rows:
        found[r["lex"]][r["feature"]] = (r["toxic"], r["clean"])
    lexicons = [lexicon(found[lex], t, c) for lex, (c, t) in enumerate(of)]
    known = lexicons[PARTS]
    model = Model(known, counts)
    held = docs.sparkSession.sparkContext.broadcast(lexicons)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(known) for known in held.value]
        for batch in batches:
            out = []
            for text, label, part in zip(batch["text"], batch["label"], batch["part"], strict=True):
                scores = token_scores(text, scorers[part])
                seen, times = np.unique(scores, return_counts=True)
                out.append((label, len(scores), [s for *_, s in segments(scores)], seen.tolist(), times.tolist()))
            yield pd.DataFrame(out, columns=["label", "n", "found", "seen", "times"])

    scanned = stored(
        sample.select("text", "label", "part").mapInPandas(
            scan, "label int, n int, found array<double>, seen array<double>, times array<long>"
        ),
        "toxic-scanned",
    )
    clean = scanned.where("label = 0")
    pairs = clean.select(F.explode(F.arrays_zip("seen", "times")).alias("p")).groupBy("p.seen").agg(F.sum("p.times").alias("times"))
    score_counts = {r["seen"]: r["times"] for r in pairs.collect()}
    for v in set(known.values()):  # a token that no clean text of the sample holds may still occur
        score_counts[v] = score_counts.get(v, 0) + 1
    tops = sorted((r["n"], r["best"]) for r in clean.select("n", F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best")).collect())
    model.fit_chance([b for _, b in tops], [n for n, _ in tops], score_counts)
    over = F.transform("found", lambda x: x * model.rate + (np.log(SIGNIFICANT) - np.log(model.scale)) - F.ln("n"))
    total = F.aggregate(F.filter(over, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    fitted = sorted((r["x"], r["label"]) for r in scanned.select(F.sqrt(total).alias("x"), "label").collect())
    x, y = np.array([x for x, _ in fitted]), np.array([label for _, label in fitted], dtype=int)
    model.slope, model.offset = calibrated(x, y.astype(float), class_weights(y, counts))
    return model


def feature_counts(words: DataFrame) -> DataFrame:
    """Counts of each lexicon's whole words, and of prefixes without the most toxic word of each: one word says nothing about others."""
    top = F.least(F.length("word"), F.lit(LONGEST))
    prefixes = F.when(top >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), top), lambda k: F.substring("word", F.lit(1), k)))
    shared = (
        words.select("lex", F.explode(prefixes).alias("feature"), "toxic", "clean")
        .groupBy("lex", "feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max(F.struct("toxic", "clean")).alias("top"))
        .select("lex", "feature", (F.col("toxic") - F.col("top.toxic")).alias("toxic"), (F.col("clean") - F.col("top.clean")).alias("clean"))
    )
    return words.select("lex", F.concat("word", F.lit(".")).alias("feature"), "toxic", "clean").unionByName(shared)


def judged_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct for each text: ``score``, ``n_passages`` and ``worst`` (the least expected segment, as words)."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_passages int, worst string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        scorer = Scorer(model.lexicon)
        for texts in batches:
            score, count, worst = [], [], []
            for text in texts:
                words = TOKEN.findall(text or "")
                values = np.array([scorer[w] for w in words], dtype=float)
                found = model.passages(values) if (values > 0).any() else []
                score.append(model.score(values) if found else float(sigmoid(np.array(model.offset))))
                count.append(len(found))
                top = min(found, key=lambda f: f[3], default=None)
                worst.append(" ".join(words[top[0] : top[1]]) if top else None)
            yield pd.DataFrame({"score": score, "n_passages": count, "worst": worst})
        hand_back_memory()

    return judge(text)


def classify(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    folds: int = 4, held_out: int = 2,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted``, ``n_passages`` and ``worst``."""
    model = fit(docs, labels, label_col, id_col, text_col, folds, held_out)
    return (
        docs.withColumn("held_out", F.coalesce(fold(id_col, folds) == held_out, F.lit(False)))
        .withColumn("__judged", judged_column(docs.sparkSession, model, F.col(text_col)))
        .withColumn("score", F.col("__judged.score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        .withColumn("n_passages", F.col("__judged.n_passages"))
        .withColumn("worst", F.col("__judged.worst"))
        .drop("__judged")
    )
