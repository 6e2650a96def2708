"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned so that the signs of the rotated, centred vectors make balanced binary codes
that stay close to the vectors (ITQ). They are fitted on at most ``SAMPLE`` vectors, the ones with the
least hash of their id; every vector is coded and filed. The code is cut into chunks, and each chunk is
the index of a Hamming table: codes that differ in fewer bits than there are chunks share one. Chunks have
about as many bits as the largest group has bits in its row count, so a bucket holds a few unrelated rows
whatever the size; there are as many chunks (and rotations) as a pair at the threshold needs to share
one with probability ``RECALL``, by the angle that it has after centring. A pair is taken in the first
chunk that it shares, if the whole codes are within a radius that pairs at the threshold hardly ever leave,
and reranked with the original vectors in double precision. Only codes are filed and joined; vectors are
fetched for the pairs that are left.

Equal vectors of one label form a class and are counted, not paired.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, or has
a null label or id, is linked with nothing; vectors of different lengths are never linked; repeated
rows count as further vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.shared import components, stored

#: Bits of a rotation's code.
CODE_BITS = 63
#: Probability that a pair at the threshold shares a chunk, and standard errors of the radius around its mean distance.
RECALL, RADIUS_ERRORS = 0.995, 6.0
#: Unrelated rows that a bucket of the largest group holds on average, and the bits of a chunk at least and at most.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 4, 6, 31
#: Most of the mean's square length that is taken off: beyond it near pairs would no longer be near.
MOST_CENTRED = 0.7
#: Vectors that rotations are fitted on, and the rounds of fitting.
SAMPLE, ROUNDS = 10_000, 20


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tables:
    """Sizes of the Hamming tables for groups of up to ``rows`` vectors whose bits differ with ``rate`` at the threshold."""

    def __init__(self, rows: int, rate: float):
        self.bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
        shared = (1 - rate) ** self.bits
        self.chunks = math.ceil(math.log(1 - RECALL) / math.log(1 - shared))
        self.per_word = CODE_BITS // self.bits
        self.words = -(-self.chunks // self.per_word)
        total = self.words * CODE_BITS
        self.radius = math.ceil(total * rate + RADIUS_ERRORS * math.sqrt(total * rate * (1 - rate)))


def centre(x: np.ndarray, min_cosine: float) -> tuple[np.ndarray, float]:
    """What is taken off unit vectors, and the rate at which bits of a pair at ``min_cosine`` then differ."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    square = float(mean @ mean)
    part = 1.0 if square <= MOST_CENTRED else 1 - math.sqrt(1 - MOST_CENTRED / square)
    off = (2 * part - part * part) * square
    return part * mean, math.acos(max(-1.0, min(1.0, (min_cosine - off) / (1 - off)))) / math.pi


def fit_rotation(x: np.ndarray, mean: np.ndarray, seed: int) -> np.ndarray:
    """A projection (dimensions x bits) learned from unit vectors."""
    dim, rng = x.shape[1], np.random.default_rng(seed)
    centred = x - mean
    basis = np.eye(dim)
    if len(x) > 1:
        basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    basis = basis[:, :CODE_BITS]
    if dim < CODE_BITS:  # fewer dimensions than bits: spread them over all bits first
        basis = basis @ np.linalg.qr(rng.normal(size=(CODE_BITS, dim)))[0].T
    rotation = np.linalg.qr(rng.normal(size=(CODE_BITS, CODE_BITS)))[0]
    v = centred @ basis
    for _ in range(ROUNDS if len(x) > CODE_BITS else 0):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return basis @ rotation


def codes(x: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """A word of bits for each vector and rotation."""
    centred, places = unit(x) - mean, np.arange(CODE_BITS, dtype=np.int64)
    return np.stack([((centred @ r >= 0).astype(np.int64) << places).sum(axis=1) for r in rotations], axis=1)


def usable(vector: str, label: str, id_: str) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.col(label).isNotNull() & F.col(id_).isNotNull() & (F.size(vector) > 0) & sound
        & F.exists(vector, lambda x: x != 0)
    )


def near_pairs(classes: DataFrame, min_cosine: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ids in ``classes(id, grp, vector)`` with that cosine within a group."""
    id_type = classes.schema["id"].dataType.simpleString()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    by_dim: dict[int, list] = {}
    for (vector,) in sample:
        by_dim.setdefault(len(vector), []).append(vector)
    samples = {dim: unit(np.array(rows, dtype=float)) for dim, rows in by_dim.items()}
    centres = {dim: centre(x, min_cosine) for dim, x in samples.items()}
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    rate = max([r for _, r in centres.values()], default=0.5)
    t = Tables(largest, rate)
    models = {
        dim: (centres[dim][0], [fit_rotation(x, centres[dim][0], seed) for seed in range(t.words)]) for dim, x in samples.items()
    }
    words = [f"c{w}" for w in range(t.words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), t.words), dtype=np.int64)
            lengths = batch["vector"].map(len).to_numpy()
            for dim in np.unique(lengths):
                if dim not in models:  # a length that the sample lacks
                    models[dim] = (np.zeros(dim), [fit_rotation(np.zeros((0, dim)), np.zeros(dim), seed) for seed in range(t.words)])
                out[lengths == dim] = codes(np.stack(batch["vector"][lengths == dim]).astype(float), *models[dim])
            yield batch[["id", "grp"]].assign(**{c: out[:, w] for w, c in enumerate(words)})

    kinds = f"id {id_type}, grp {classes.schema['grp'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in words)
    coded = stored(classes.select("id", "grp", "vector").mapInPandas(run, kinds), "itq-codes")

    low = 2**t.bits - 1
    keys = [
        F.shiftright(words[j // t.per_word], j % t.per_word * t.bits).bitwiseAND(F.lit(low)) for j in range(t.chunks)
    ]
    filed = coded.select("id", "grp", *words, F.posexplode(F.array(*keys)).alias("j", "key"))
    apart = [F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in words]
    distance = [F.bit_count(x) for x in apart]
    shift = F.array(*[F.lit(j % t.per_word * t.bits) for j in range(t.chunks)])
    word = F.array(*[F.lit(j // t.per_word) for j in range(t.chunks)])
    # on arrays, since few pairs get here
    differ = F.zip_with(word, shift, lambda w, n: F.call_function("shiftright", F.get(F.array(*apart), w), n).bitwiseAND(F.lit(low)))
    first = F.array_position(differ, F.lit(0).cast("long")) - 1
    pairs = stored(
        filed.alias("a").join(
            filed.alias("b"),
            (F.col("a.grp") == F.col("b.grp")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.key") == F.col("b.key"))
            & (F.col("a.id") < F.col("b.id")) & (sum(distance[1:], distance[0]) <= t.radius) & (first == F.col("a.j")),
        ).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")),
        "itq-pairs",
    )
    vector = lambda c: classes.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}"))
    both = pairs.join(vector("b"), "b").join(vector("a"), "a").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column(2), batch.column(3)
            n = len(batch)
            good = np.zeros(n, dtype=bool)
            dims = np.diff(va.offsets.to_numpy())
            same = dims == np.diff(vb.offsets.to_numpy())
            if n and same.all() and (dims == dims[0]).all():
                xa, xb = (v.flatten().to_numpy().astype(float).reshape(n, dims[0]) for v in (va, vb))
                good = np.einsum("ij,ij->i", unit(xa), unit(xb)) >= min_cosine
            else:
                for i in np.flatnonzero(same):
                    xa, xb = (unit(np.array([v[int(i)].as_py()], dtype=float)) for v in (va, vb))
                    good[i] = float((xa * xb).sum()) >= min_cosine
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(rerank, f"a {id_type}, b {id_type}")


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    min_cosine: float = 0.93,
) -> DataFrame:
    """One row per row: id, ``n_links`` (other vectors linked directly), ``component_id``, ``kept``."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = rows.where(usable("vector", "label", "id"))
    same = stored(
        good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "itq-classes"
    )
    links = stored(near_pairs(same.withColumnRenamed("label", "grp"), min_cosine), "itq-links")
    copies = same.select(F.col("id").alias("b"), "copies")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(copies, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
    joined = components(links)
    of_class = (
        same.select(F.col("id").alias("cls"), "label", "vector", "copies")
        .join(linked, "cls", "left")
        .join(joined.select(F.col("id").alias("cls"), "component_id"), "cls", "left")
    )
    ok = usable("vector", "label", "id")
    return (
        rows.withColumn("k", F.when(ok, F.xxhash64("vector")))
        .join(
            of_class.select(
                "cls", F.col("label").alias("l2"), F.col("vector").alias("v2"), F.xxhash64("vector").alias("k2"),
                "copies", "others", F.col("component_id").alias("c"),
            ),
            (F.col("k") == F.col("k2")) & (F.col("label") == F.col("l2")) & (F.col("vector") == F.col("v2")),
            "left",
        )
        .select(
            F.col("id").alias(id_col),
            (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("c", "cls", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
