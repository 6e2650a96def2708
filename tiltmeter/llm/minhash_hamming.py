"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds its distinct word shingles. Its signature has ``VALUES`` MinHash values of
``BITS`` bits. Two signatures are compared by the number of values in which they differ. The values
are split into chunks of ``PER_CHUNK``; if two signatures differ in at most ``DISTANCE`` values, some
chunk differs in at most ``CHUNK_ERRORS`` of its values (pigeonhole), so each document is filed under
every chunk with every choice of that many values left out, and every such pair shares a key. At
Jaccard similarity 0.8 a pair lies beyond ``DISTANCE`` with a probability of about 2 in 100,000, at
0.85 of less than one in ten million.

Before a pair leaves a join, two further tests sort out what is less similar, in the join itself. The
parities of ``ODD`` bins into which the shingles are dealt differ in at most as many places as the sets
differ, so they bound the similarity from above and lose nothing. Where sets are too large for the bins
(over ``ODD_SIZE`` shingles), 16 bits of each of the ``SKETCH`` least shingle hashes are intersected as
well: for sets of at most that size this is again a bound, for larger ones an estimate, taken
``SKETCH_ERRORS`` standard errors low. Hardly any pair under the threshold passes; what is left is
proposed, and a link is confirmed on the full sets.

No group is expanded into all its pairs:

1. Documents with the same words in the same order form a class; one member stands for it.
2. In every key's bucket, each class is compared with one hub of the bucket only, for ``HUBS`` hubs one
   after another: the least class, then others by a hash. What the sets confirm is joined into components.
3. Buckets that lie in one component are done. In the others, pairs from different components are
   compared as well; each pair is taken under the first key that it shares, and leaves the join only
   if all tests allow a link.
4. Where more than ``CROWD`` classes stand under an open key (texts that share a long passage, but are no
   copies), they meet under rare shingles instead: all shingles of those classes are ordered by the number
   of classes that hold them, and the first one that two linked sets have in common lies among the rarest of
   both, so close to the front that enough can follow. Nothing is lost by it: both ways give the same links.
   Components meet before their members do, so no two members of one component are compared.
   So each pair that the signatures propose is either confirmed, refuted, or already in one component.

Defined results: a null, empty or white-space text has an empty set (``n_shingles`` 0) and is linked
with nothing; fewer words than a shingle form one shingle; repeated rows and ties share a component;
rows with a null id are linked with nothing and have a null component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.shared import broadcast_if_small, components, hand_back_memory, small_batches, stored

VALUES, BITS, PER_CHUNK, CHUNK_ERRORS = 40, 14, 4, 1
CHUNKS = VALUES // PER_CHUNK
DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
ODD, ODD_SIZE = 512, 300
ODD_LANES = [f"o{j}" for j in range(ODD // 64)]
SKETCH, SKETCH_ERRORS = 2048, 5.5
HUBS = 2
#: Classes under an open key beyond which pairs are sought under rare shingles.
CROWD = 200
LANE = BITS + 1  # a value and a free bit above it
LANES = [f"s{j}" for j in range(CHUNKS)]
FULL = sum((2**BITS - 1) << (LANE * i) for i in range(PER_CHUNK))
FREE = sum(1 << (LANE * i + BITS) for i in range(PER_CHUNK))
WORD_CACHE = 100_000
#: Texts, and pairs of texts, that a Python worker holds at once.
BATCH_TEXTS, BATCH_PAIRS = 1000, 250
_BLOCK = 256
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
_PLACES = np.arange(PER_CHUNK, dtype=np.int64) * LANE


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], k: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Hashes of the distinct shingles of at least one word, in ascending order."""
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = max(1, len(words) - k + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        shingles = _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(shingles)


def signature(words: list[bytes], k: int, hashes: dict[bytes, int]) -> tuple[int, list[int], np.ndarray]:
    """Number of distinct shingles, signature and parities packed into longs (``LANES``, ``ODD_LANES``), and the sketch."""
    shingles = shingle_hashes(words, k, hashes)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(short), _BLOCK):
        part = short[None, at : at + _BLOCK] ^ _FLIP[:, None]
        part *= _MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    values = _mixed(least.astype(np.uint64))
    coarse = (values & np.uint64(2**BITS - 1)).astype(np.int64).reshape(CHUNKS, PER_CHUNK)
    odd = np.bincount((shingles & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    lanes = (coarse << _PLACES).sum(axis=1).tolist() + np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    sketch = shingles[: SKETCH if len(shingles) > ODD_SIZE else 0] >> np.uint64(16) & np.uint64(0xFFFF)
    sketch = np.unique(sketch.astype(np.uint16).view(np.int16))
    return len(shingles), lanes, sketch


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id``, ``n_shingles``, ``words_key`` (equal for equal word sequences), the packed chunks and the ``sketch``."""

    @F.pandas_udf("n_shingles long, words_key string, " + ", ".join(f"{c} long" for c in LANES + ODD_LANES) + ", sketch array<smallint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for texts in batches:
            sizes, keys, packed, sketches = [], [], [], []
            for text in texts:
                words = words_of(text)
                n, lanes, sketch = signature(words, k, hashes) if words else (0, [0] * len(LANES + ODD_LANES), np.zeros(0, np.int16))
                sizes.append(n)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest())
                packed.append(lanes)
                sketches.append(sketch)
            lanes = np.array(packed, dtype=np.int64).reshape(len(texts), len(LANES + ODD_LANES))
            columns = {"n_shingles": sizes, "words_key": keys} | {c: lanes[:, j] for j, c in enumerate(LANES + ODD_LANES)}
            yield pd.DataFrame(columns | {"sketch": pd.Series(sketches, dtype=object)})
        hand_back_memory()

    return docs.select(F.col(id_col).alias("id"), sign(F.col(text_col)).alias("s")).select("id", "s.*")


def chunk_keys() -> list[Column]:
    """A key for each chunk and each value of it that is left out."""
    keys = []
    for j, c in enumerate(LANES):
        for out in range(PER_CHUNK):
            kept = F.col(c).bitwiseAND(F.lit(~((2**LANE - 1) << (LANE * out)) & (2**63 - 1)))
            keys.append(F.xxhash64(F.lit(j * PER_CHUNK + out), kept))
    return keys


def chunk_distances(a: str, b: str) -> list[Column]:
    """In how many values each chunk of aliases ``a`` and ``b`` differs."""
    return [
        F.bit_count(((F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) + F.lit(FULL)).bitwiseAND(F.lit(FREE)))
        for c in LANES
    ]


def near(a: str, b: str, percent: int) -> Column:
    """Whether the signatures and the sizes of aliases ``a`` and ``b`` allow a link."""
    coarse = chunk_distances(a, b)
    return can_reach(a, b, percent) & (sum(coarse[1:], coarse[0]) <= DISTANCE)


def first_shared(a: str, b: str, key: Column) -> Column:
    """Whether ``key`` (its number) is the first key that aliases ``a`` and ``b`` share; on arrays, since few pairs get here."""
    apart = F.zip_with(
        f"{a}.chunks", f"{b}.chunks", lambda x, y: F.bit_count((x.bitwiseXOR(y) + F.lit(FULL)).bitwiseAND(F.lit(FREE)))
    )
    chunk = F.floor(key / PER_CHUNK)
    return (F.array_position(F.transform(apart, lambda d: d <= CHUNK_ERRORS), F.lit(True)) == chunk + 1) & (
        (F.get(apart, chunk.cast("int")) > 0) | (key % PER_CHUNK == 0)
    )


def can_reach(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be that similar at all."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def parities_allow(a: str, b: str, percent: int) -> Column:
    """Whether the parities of aliases ``a`` and ``b`` differ in no more places than sets of that similarity can."""
    apart = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ODD_LANES]
    return sum(apart[1:], apart[0]) * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def sketches_allow(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of aliases ``a`` and ``b`` allow that similarity.

    A link needs ``percent / (100 + percent)`` of both sizes in common. Different shingles may share their 16
    bits: that only adds to the intersection, but for those of one sketch, which are counted and added.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    hidden = lambda x: F.least(F.col(f"{x}.n"), F.lit(SKETCH)) - F.size(F.col(f"{x}.sketch"))
    common = F.size(F.array_intersect(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"))) + F.least(hidden(a), hidden(b))
    most, needed = F.greatest(na, nb), (na + nb) * percent / (100 + percent)
    share = F.least(needed / most, F.lit(1.0))
    estimated = SKETCH * share - SKETCH_ERRORS * F.sqrt(SKETCH * share * (1 - share) + 1)
    return (F.least(na, nb) <= ODD_SIZE) | (common >= F.when(most <= SKETCH, needed - 1e-6).otherwise(estimated))


def under_rare_shingles(crowd: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``(x, y)`` of ``crowd(cls, comp)`` from different components whose sets may reach ``percent``.

    ``texts(cls, text)`` holds the texts of the classes; rows may repeat, and texts that share an id are taken each. In the common order of shingles (by holders, then by hash),
    the first one that two sets share has all others that they share behind it in both. A set's place of it is
    therefore among the first ``n - needed + 1``, where the overlap needed is at least ``percent`` of a larger
    set, and ``2 * percent / (100 + percent)`` of a smaller one. Shingles of one class only take places, but meet nothing.
    """

    @F.pandas_udf("array<long>")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _WordHashes()
        for batch in batches:
            words = [words_of(t) for t in batch]
            yield pd.Series([shingle_hashes(w, k, hashes).view(np.int64) if w else [] for w in words], dtype=object)
        hand_back_memory()

    # not to be moved below the join that picks the texts
    spell = spell.asNondeterministic()
    with small_batches(texts.sparkSession, BATCH_PAIRS):
        spelled = texts.select("cls", F.xxhash64("text").alias("text_key"), spell("text").alias("shingles"))
        held = stored(
            spelled.select("cls", "text_key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")),
            "minhash-spelled",
        )
    holders = held.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    met = held.join(holders, "shingle").groupBy("cls", "text_key").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("holders", "shingle"))).alias("common")
    )
    places = crowd.join(met, "cls")
    place = F.col("n") - F.col("shared") + F.col("nth") + 1
    as_larger = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    as_smaller = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent) - 1e-9) + 1
    front = stored(
        places.select("cls", "n", "comp", F.size("common").alias("shared"), F.posexplode("common").alias("nth", "s"))
        .where(place <= as_larger)
        .select("cls", "n", "comp", F.col("s.shingle").alias("shingle"), place.alias("place"), (place <= as_smaller).alias("early")),
        "minhash-front",
    )
    comps = front.groupBy("shingle", "comp").agg(F.max("early").alias("early"))
    meet = comps.where("early").select("shingle", F.col("comp").alias("cx")).join(
        comps.select("shingle", F.col("comp").alias("cy")), "shingle").where("cx <> cy")
    side = lambda c: front.select("shingle", F.col("comp").alias(f"c{c}"), *[F.col(f).alias(f"{f}_{c}") for f in ("cls", "n", "place", "early")])
    behind = F.least(F.expr("n_x - place_x"), F.expr("n_y - place_y")) + 1
    return (
        meet.join(side("x").where("early_x"), ["shingle", "cx"])
        .join(side("y"), ["shingle", "cy"])
        .where("n_x < n_y or (n_x = n_y and cls_x < cls_y)")
        .where((F.col("n_x") * 100 >= F.col("n_y") * percent) & (behind * (100 + percent) >= F.expr("n_x + n_y") * percent))
        .select(F.least("cls_x", "cls_y").alias("x"), F.greatest("cls_x", "cls_y").alias("y"))
        .distinct()
    )


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose full shingle sets reach ``percent`` Jaccard similarity."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "minhash-ids")
    texts = texts.join(broadcast_if_small(ids), "id", "left_semi")
    with_texts = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last, last_set, good = None, set(), []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                if tb != last:
                    last, last_set = tb, shingle_set(tb, k)
                other = shingle_set(ta, k)
                both = len(other & last_set)
                good.append(100 * both >= percent * (len(other) + len(last_set) - both))
            yield batch.loc[good, ["a", "b"]]
        hand_back_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return with_texts.select("a", "b", "ta", "tb").mapInPandas(run, f"a {kind}, b {kind}").distinct()


def more_joined(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """``joined(id, component_id)`` after further ``links(a, b)``; only components are linked anew, not ids."""
    if joined is None:
        return components(links)
    comp = lambda c: joined.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}"))
    met = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    higher = stored(components(met), "minhash-higher")
    above = higher.select(F.col("id").alias("component_id"), F.col("component_id").alias("top"))
    moved = joined.join(above, "component_id", "left").select("id", F.coalesce("top", "component_id").alias("component_id"))
    return stored(moved.unionByName(higher.join(joined, "id", "left_anti")), "minhash-joined")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (least id reachable), ``kept``."""
    spark = docs.sparkSession
    with small_batches(spark, BATCH_TEXTS):
        rows = stored(signatures(docs, id_col, text_col, shingle), "minhash-rows")
    classes = stored(
        rows.where("n_shingles > 0 and id is not null")
        .groupBy("words_key")
        .agg(F.min("id").alias("cls"), F.min("n_shingles").alias("n"), *[F.min(c).alias(c) for c in LANES + ODD_LANES]),
        "minhash-classes",
    )
    keys = classes.select("cls", F.posexplode(F.array(*chunk_keys())).alias("nth", "key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    filed = stored(keys.join(shared, "key"), "minhash-filed")
    # all that is compared of the classes that share a key with another one
    drawn = rows.select(F.col("id").alias("cls"), "words_key", "sketch")
    compared = stored(
        classes.join(filed.select("cls").distinct(), "cls", "left_semi").join(drawn, ["cls", "words_key"])
        .drop("words_key").dropDuplicates(["cls"]).withColumn("chunks", F.array(*LANES)),
        "minhash-compared",
    )

    def unconfirmed(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
        return stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        with small_batches(spark, BATCH_PAIRS):
            return stored(confirmed(pairs, docs, id_col, text_col, shingle, percent), "minhash-links")

    def still_open(joined: DataFrame | None) -> DataFrame:
        """The filed classes with their components, without the keys whose classes lie in one component."""
        if joined is None:
            return filed.withColumn("comp", F.col("cls"))
        placed = stored(
            filed.join(joined.select(F.col("id").alias("cls"), "component_id"), "cls", "left").select(
                "key", "nth", "cls", F.coalesce("component_id", "cls").alias("comp")
            ),
            "minhash-placed",
        )
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return placed.join(several.select("key"), "key")

    a, b = compared.alias("a"), compared.alias("b")
    alike = near("a", "b", percent) & parities_allow("a", "b", percent)
    exact = sketches_allow("a", "b", percent)

    def tests_allow(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``(x, y)`` that all tests allow to be links, as ``(a, b)``."""
        return (
            pairs.join(a, F.col("x") == F.col("a.cls"))
            .join(b, (F.col("y") == F.col("b.cls")) & alike & exact)
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )

    tested = joined = None
    for turn in range(HUBS):
        placed = still_open(joined)
        order = F.struct(F.xxhash64(F.lit(turn), "cls") if turn else F.lit(0), "cls", "comp")
        hubs = placed.groupBy("key").agg(F.min(order).alias("h")).select("key", F.col("h.cls").alias("hub"), F.col("h.comp").alias("hub_comp"))
        around = placed.join(hubs, "key").where("comp <> hub_comp").select(F.least("hub", "cls").alias("x"), F.greatest("hub", "cls").alias("y"))
        pairs = unconfirmed(
            tests_allow(around.distinct()),
            tested,
        )
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not pairs.isEmpty():
            joined = more_joined(joined, links_of(pairs))

    placed = stored(still_open(joined), "minhash-open")
    crowded = stored(placed.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "minhash-crowded")
    rest = placed.join(crowded, "key", "left_anti").join(compared, "cls")
    left, right = rest.alias("a"), rest.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp"))
    found = left.join(right, meet & alike & first_shared("a", "b", F.col("a.nth")) & exact).select(
        F.col("a.cls").alias("a"), F.col("b.cls").alias("b")
    )
    if not crowded.isEmpty():
        crowd = stored(placed.join(crowded, "key", "left_semi").select("cls", "comp").distinct(), "minhash-crowd")
        texts = docs.select(F.col(id_col).alias("cls"), F.col(text_col).alias("text"))
        texts = texts.join(broadcast_if_small(crowd.select("cls")), "cls", "left_semi")
        found = found.unionByName(tests_allow(under_rare_shingles(crowd, texts, shingle, percent))).distinct()
    pairs = unconfirmed(found, tested)
    if not pairs.isEmpty():
        joined = more_joined(joined, links_of(pairs))

    if joined is None:
        joined = classes.select(F.col("cls").alias("id"), F.col("cls").alias("component_id"))
    member = rows.drop("sketch").join(classes.select("words_key", "cls"), "words_key", "left")
    return member.join(joined.select(F.col("id").alias("cls"), "component_id"), "cls", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "cls", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
