"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes.

A text is read as words. Each word has a form (case, digits, what marks it ends in, length) and a flag
for whether the pair of it and the word before has stood in the text already. Features say which
n-grams of forms with flags, up to ``LONGEST``, occur in the text, and which words. Each indicator is
scaled by the log ratio of its smoothed shares in the two classes; the vectors are brought to unit
length, and dual coordinate descent fits the L1-loss support vector machine. A logistic fit on a part
of the sample that the machine has not seen, weighted to the class shares of all training rows, turns
margins into scores.

The model is fitted on the driver from a bounded sample (``labelled.PER_CLASS`` rows of each class)
and broadcast (``SPACE`` numbers); every text is scored where it lies.

Defined results: a null or empty text has no features and gets the score of the offset alone; repeated
rows are scored each; a null id is not held out; without labels of both classes every score is the
share of label 1 (0.5 without labels); other columns are kept as they are, but ``held_out``, ``score``
and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.labelled import calibrated, class_weights, fold, labelled_sample, sigmoid
from tiltmeter.llm.shared import hand_back_memory

SPACE = 1 << 18
LONGEST = 6
#: A feature must occur in so many texts of the sample.
LEAST_TEXTS = 5
COST, EPOCHS, THRESHOLD, WORD_CACHE = 1.0, 20, 0.3, 100_000


def form(word: str) -> int:
    """Form of a word in five bits: case or kind (3), and what it ends in (2)."""
    core = word.strip(".,;:!?\"'()*$%&#|")
    if not core:
        kind = 0
    elif core.isdigit():
        kind = 1
    elif not any(c.isalpha() for c in core):
        kind = 2
    elif len(core) > 1 and core.isupper():
        kind = 3
    elif core[0].isupper() and core[1:] == core[1:].lower():
        kind = 4
    elif core == core.lower():
        kind = 5 if len(core) < 15 else 6
    else:
        kind = 7
    end = word[len(word.rstrip("!?*$%&#|@~^=_<>")) :]
    return kind * 4 + (0 if not end else 1 if len(end) == 1 else 2 if len(end) == 2 else 3)


class _Words(dict):
    """Hash of a word with its form in the lowest five bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) & ~31) | form(word)
        return got


def features(text: str, known: dict[str, int]) -> np.ndarray:
    """The indicators of a text as sorted distinct numbers below ``SPACE``."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    pair = np.empty_like(h)
    pair[0] = 0
    pair[1:] = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    seen = np.ones(len(h), dtype=np.uint64)
    seen[np.unique(pair, return_index=True)[1]] = 0
    token = (h & np.uint64(31)) * np.uint64(2) + seen
    found, gram = [(h >> np.uint64(5)) % np.uint64(SPACE // 2)], token
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(token) < n:
                break
            gram = gram[:-1] * np.uint64(64) + token[n - 1 :]
        mixed = (np.unique(gram) * np.uint64(8) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(40)) % np.uint64(SPACE // 2) + np.uint64(SPACE // 2))
    return np.unique(np.concatenate(found)).astype(np.int32)


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the offset) by dual coordinate descent; ``y`` is -1 or 1."""
    w, alpha, rng = np.zeros(SPACE + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) for _, v in rows])
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            at, value = rows[i]
            slope = y[i] * float(w[at] @ value) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


def scaled(found: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indicators times log ratios at unit length, and the constant feature."""
    value = ratio[found]
    used = value != 0
    found, value = found[used], value[used]
    length = np.sqrt(value @ value)
    return np.append(found, SPACE), np.append(value / length if length else value, 1.0)


class Model:
    """Weights of the scaled indicators and the logistic that follows."""

    def __init__(self, sample: list[np.ndarray], y: np.ndarray, counts: dict[int, int]):
        total = counts[0] + counts[1]
        self.ratio, self.weights, self.slope, self.offset = np.zeros(SPACE), np.zeros(SPACE + 1), 0.0, 0.0
        share = (counts[1] + 0.5) / (total + 1)
        self.offset = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return
        fitted = np.arange(len(y)) % 5 != 0
        texts = {c: np.zeros(SPACE) for c in (0, 1)}
        for found, c in zip(sample, y, strict=True):
            texts[int(c)][found] += 1
        self.ratio = np.log((texts[1] + 1) / (texts[1] + 1).sum()) - np.log((texts[0] + 1) / (texts[0] + 1).sum())
        self.ratio[texts[0] + texts[1] < min(LEAST_TEXTS, len(y) // 10 + 1)] = 0
        rows = [scaled(f, self.ratio) for f in sample]
        balance = {c: len(y) / 2 / max(1, int((y == c).sum())) for c in (0, 1)}
        cost = COST * np.array([balance[int(c)] for c in y])
        sign = np.where(y == 1, 1.0, -1.0)
        keep = np.flatnonzero(fitted)
        self.weights = fit_hinge([rows[i] for i in keep], sign[keep], cost[keep])
        rest = np.flatnonzero(~fitted)
        margin = np.array([float(self.weights[at] @ v) for at, v in (rows[i] for i in rest)])
        self.slope, self.offset = calibrated(margin, y[rest].astype(float), class_weights(y[rest], counts))

    def score(self, found: np.ndarray) -> float:
        at, value = scaled(found, self.ratio)
        return float(sigmoid(np.array(self.slope * float(self.weights[at] @ value) + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out: int) -> Model:
    sample, counts = labelled_sample(docs, labels, label_col, id_col, text_col, folds, held_out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            yield pd.DataFrame(
                {"id": batch["id"], "label": batch["label"], "found": [features(t, known).tobytes() for t in batch["text"]]}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInPandas(run, f"id {kind}, label int, found binary").collect()
    got = sorted(got, key=lambda r: xxhash.xxh3_64_intdigest(str(r["id"])))
    y = np.array([r["label"] for r in got], dtype=int)
    return Model([np.frombuffer(r["found"], dtype=np.int32) for r in got], y, counts)


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, model = _Words(), held.value
        for texts in batches:
            yield pd.Series([model.score(features(t or "", known)) for t in texts], dtype=float)
        hand_back_memory()

    return score(text)


def classify(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    folds: int = 5, held_out: int = 0,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    model = fit(docs, labels, label_col, id_col, text_col, folds, held_out)
    return (
        docs.withColumn("held_out", F.coalesce(fold(id_col, folds) == held_out, F.lit(False)))
        .withColumn("score", score_column(docs.sparkSession, model, F.col(text_col)))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
