"""Groups of spelling variants: words one edit apart, each rare one led back to the frequent word that it is a form of.

Pairs come from an inverted index of positional q-grams of padded words. One edit leaves all but a few of a word's grams in
place, shifted by at most one, so the first of those that a pair has in common, in the order of rarity, is among the few rarest
of both: words meet in cells (length of the longer word, gram, place) of these alone, and no pair is lost. Within a cell the
postings of a word's grams under the limits of length and place are merged through a heap, the longest lists looked up instead;
what reaches the overlap that one edit leaves is verified letter by letter. A pair that meets in several cells goes out in
the first of them. Cells are dealt to tasks by hash, and a cell of many words is split into squares of its blocks, so a
task's memory is bounded whatever the words are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.shared import broadcast_if_small, stored

LEAST_LENGTH, LEAST_COUNT = 6, 5
Q = 3
#: How many times as frequent the word must be that another is a form of.
RATIO = 5
#: Words of one cell that a task compares at once; rows of the index for each task.
BLOCK, SHARD_ROWS = 4_000, 40_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """Maximal runs of Latin letters of at least so many code points, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, lose: int | None = 199) -> DataFrame:
    """``word, n`` of all words of ``docs(doc_id, text)`` that are long and frequent enough.

    With ``lose``, every run whose crc32 together with its document's id is divisible by it loses a letter, a known share of
    misspellings to find again. Runs too short for a word are never looked at, as losing a letter makes them shorter still.
    """
    word = F.col("run")
    found = docs.select("doc_id", F.explode(runs(F.col("text"), least)).alias("run"))
    if lose:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
        at = F.pmod(h, F.char_length("run").cast("long")).cast("int")
        without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(h % lose == 0, without).otherwise(word)
    words = found.select(word.alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def grams(word: str, q: int = Q) -> list[str]:
    """All grams of a padded word; a gram's place is its index."""
    padded = "\x01" * (q - 1) + word + "\x02" * (q - 1)
    return [padded[i : i + q] for i in range(len(padded) - q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def rarest(word: str, frequency: dict[str, int], k: int) -> list[tuple[str, int]]:
    """The ``k`` rarest grams with their places; ties by gram, then place."""
    found = [(frequency[g], g, at) for at, g in enumerate(grams(word))]
    return [(g, at) for _, g, at in sorted(found)[:k]]


def _indexed(words: DataFrame, frequency: dict[str, int]) -> DataFrame:
    """Rows of the index: each word under its rarest grams, among the words of its length and, shifted or not, of one more."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for word in frame["word"]:
                rare, size = rarest(word, frequency, Q + 1), len(word)
                keys = "\t".join(f"{g}{at}" for g, at in rare)
                out += [(f"{size}{g}{at}", word, keys, True) for g, at in rare]
                # A gram that stands at two places in a row, one shifted, the other not, names the same cell twice.
                out += [(cell, word, keys, False) for cell in {f"{size + 1}{g}{at + d}" for g, at in rare[:Q] for d in (0, 1)}]
            yield pd.DataFrame(out, columns=["cell", "word", "keys", "long"])

    return words.select("word").mapInPandas(rows, "cell string, word string, keys string, long boolean")


class Cell:
    """Words of one length that share a gram at one place, with the postings of all their grams."""

    def __init__(self, words: list[tuple[str, str]]):
        self.words = sorted(words)
        self.lists: dict[tuple[str, int], list[int]] = defaultdict(list)
        self.places = []
        for i, (word, _) in enumerate(self.words):
            at = [(g, place) for place, g in enumerate(grams(word))]
            self.places.append(set(at))
            for key in at:
                self.lists[key].append(i)

    def near(self, word: str, after: int = 0) -> Iterator[int]:
        """Places of the words that are one edit from ``word``, which is as long as they are or one letter shorter."""
        size = len(self.words[0][0])
        shifts = (0,) if len(word) == size else (0, 1)
        keys = [[(g, at + d) for d in shifts] for at, g in enumerate(grams(word))]
        least = size - 1  # grams in common that one edit leaves
        short = len(keys) - least + 1
        # A word with the overlap misses few lists, so it is in one of the shortest: those are merged, the others looked up.
        keys.sort(key=lambda k: sum(len(self.lists.get(x, ())) for x in k))
        merged = heapq.merge(*(self.lists[x] for k in keys[:short] for x in k if x in self.lists))
        rest = keys[short:]
        for i, hits in groupby(merged):
            if i < after:
                continue
            seen, have = sum(1 for _ in hits), self.places[i]
            for left, k in enumerate(rest):
                if seen + len(rest) - left < least:
                    break
                seen += any(x in have for x in k)
            if seen >= least and one_edit(word, self.words[i][0]):
                yield i


def _first_common(keys: str, other: str, shifts: tuple[int, ...]) -> str:
    """The first cell, in the order of a word's rare grams, that another word is in as well."""
    have = set(other.split("\t"))
    for key in keys.split("\t"):
        gram, at = key[:Q], int(key[Q:])
        for d in shifts:
            if f"{gram}{at + d}" in have:
                return f"{gram}{at + d}"
    return ""


def _pairs_of(cell: str, long: list[tuple[str, str]], others: list[tuple[str, str]], short: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Near pairs of a cell that no earlier cell has: of ``long`` with ``others`` of the same length, and with ``short``."""
    made = Cell(long)
    key = cell[len(str(len(long[0][0]))) :]
    for word, keys in others:
        for i in made.near(word, after=bisect_right(made.words, word, key=lambda w: w[0])):
            if _first_common(keys, made.words[i][1], (0,)) == key:
                yield word, made.words[i][0]
    for word, keys in short:
        for i in made.near(word):
            if _first_common("\t".join(keys.split("\t")[:Q]), made.words[i][1], (0, 1)) == key:
                yield word, made.words[i][0]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of distinct ``word``s that are exactly one edit apart, each once.

    The grams' frequencies are as many as the alphabet has grams, whatever the number of words; they go to all tasks.
    """
    padded = F.concat(F.lit("\x01" * (Q - 1)), "word", F.lit("\x02" * (Q - 1)))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") + Q - 1), lambda i: F.substr(padded, i, F.lit(Q)))).alias("gram")
    frequency = {r[0]: r[1] for r in words.select(each).groupBy("gram").agg(F.count(F.lit(1))).collect()}
    index = stored(_indexed(words, frequency), "spelling-index")
    hot = stored(index.where("long").groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK), "spelling-hot")
    blocks = F.coalesce(F.ceil(F.col("k") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int")
    dealt = index.join(broadcast_if_small(hot), "cell", "left").withColumn("blocks", blocks).withColumn("own", own)
    # A square (i, j) of a cell's blocks has the long words of block i, and those of block j and the short ones of block j to ask for.
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_long = F.transform(all_, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("listed")))
    as_other = F.transform(all_, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("listed")))
    squares = F.when(~F.col("long"), as_other).when(F.col("blocks") == 1, F.slice(as_long, 1, 1)).otherwise(F.concat(as_long, as_other))
    placed = dealt.select("cell", "word", "keys", "long", "blocks", F.inline(squares))
    tasks = max(1, -(-index.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(tasks)).alias("shard")

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cell, _, _), rows in _grouped(frame):
            long = [(w, k) for w, k, is_long, listed, _ in rows if is_long and listed]
            if not long:
                continue
            one = rows[0][4] == 1
            others = long if one else [(w, k) for w, k, is_long, listed, _ in rows if is_long and not listed]
            short = [(w, k) for w, k, is_long, _, _ in rows if not is_long]
            if len(others) + len(short) > 1 or others != long:
                out += _pairs_of(cell, long, others, short)
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.groupBy(shard).applyInPandas(pairs, "a string, b string")


def _grouped(frame: pd.DataFrame) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each square."""
    found: dict[tuple, list[tuple]] = defaultdict(list)
    columns = [frame[c].tolist() for c in ("cell", "i", "j", "word", "keys", "long", "listed", "blocks")]
    for cell, i, j, *row in zip(*columns, strict=True):
        found[cell, i, j].append(tuple(row))
    yield from found.items()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where following forms ends. Pointers are doubled until none moves.

    A form is at least ``RATIO`` times as frequent as its word, so chains are short and have no cycles.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, lose: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id, text)`` with enough letters and occurrences.

    ``form`` is the near word of largest n (of ties the first in code-point order) if it is ``RATIO`` times as frequent, else
    null; ``root`` follows forms to the last. Null and empty texts have no words; repeated rows count each; a null id counts as
    an empty text where ``lose`` asks for ids; an empty table has no rows; other columns are not read.
    """
    words = stored(word_counts(docs.select("doc_id", "text"), lose=lose), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = named.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    found = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.b")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    ended = roots(found.where("form is not null"))
    return found.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
