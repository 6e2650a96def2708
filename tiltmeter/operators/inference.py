"""Inference over cells, for all judges and axes (and templates) at once.

Random numbers are hashes of (seed, stream, keys), so results don't depend on partitions or order.
Permutation signs come from the bits of one hash for each item and 48 resamples. The published
sequence of a call-order generator is therefore met in distribution, not draw by draw.

Equal cells are interchangeable, so ``counted_resamples`` draws how often each distinct cell occurs:
the same distribution, and its work grows with distinct cells, not with items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions import hashes
from tiltmeter.functions.columns import ratio, uniform
from tiltmeter.functions.numeric import cohens_h, normal_cdf
from tiltmeter.operators.cells import BY, BY_TEMPLATE, POOLED, cells_by_all, counted_accuracy, counted_cells, noise_floor, totals
from tiltmeter.operators.resampling import resampled
from tiltmeter.sources.files import stored

SEED, GATE_SEED, RESAMPLES, ALPHA = 20260830, 20260831, 10_000, 0.05
BITS = 48


def _draws(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def permutation_p(cell_table: DataFrame, by: list[str] = BY, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Two-sided p of the summed differences when each item's sign is flipped at random: (hits + 1) / (n + 1)."""
    used = cell_table.where("n > 0").withColumn("d", (F.col("b") - F.col("c")).cast("long"))
    seen = used.groupBy(*by).agg(F.sum("d").alias("observed"), F.max(F.abs("d")).alias("most"))
    flipped = (
        _flipped_sums(used.where("d <> 0"), by, -(-n // BITS), seed)
        .groupBy(*by, "block")
        .agg(*[F.sum(f"s{pos}").alias(f"s{pos}") for pos in range(BITS)])
        .select(*by, "block", F.posexplode(F.array(*[f"s{pos}" for pos in range(BITS)])).alias("pos", "total"))
        .where(F.col("block") * BITS + F.col("pos") < n)
    )
    hits = flipped.join(seen, by).groupBy(*by).agg(
        F.sum((F.abs("total") >= F.abs("observed")).cast("long")).alias("hits")
    )
    p = F.when(F.col("most") == 0, F.lit(1.0)).otherwise((F.coalesce("hits", F.lit(n)) + 1).cast("double") / (n + 1))
    return seen.join(hits, by, "left").select(*by, F.col("observed").alias("observed_d"), p.alias("p"))


#: Groups whose sums a task holds at once.
GROUPS_AT_ONCE = 256


def _flips(texts: list[bytes], d: np.ndarray, starts: np.ndarray, blocks: int) -> np.ndarray:
    """Sums ``(groups, blocks, BITS)`` of ``d`` under the signs of the hashes of ``text|block``; groups begin at ``starts``."""
    total = np.zeros((len(starts), blocks, BITS))
    group = np.searchsorted(starts, np.arange(len(texts)), side="right") - 1
    d = d.astype(np.float32 if np.abs(d).sum() < 2**24 else np.float64)
    lengths = np.array([len(t) for t in texts])
    for low, high in hashes.by_digits(0, blocks):
        digits = len(str(low))
        sizes = np.array([hashes.size(n + 1 + digits) for n in lengths])
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            frames = np.frombuffer(bytearray().join([hashes.framed(texts[i] + b"|" + b"0" * digits) for i in some]), dtype=np.uint8).reshape(-1, size)
            cuts = np.flatnonzero(np.diff(group[some], prepend=-1, append=len(starts)))
            lanes = np.arange(len(some))
            for block in range(low, high):
                for j, digit in enumerate(str(block).encode()):
                    frames[lanes, lengths[some] + 1 + j] = digit
                flipped = np.unpackbits(hashes.md5(frames)[:, :6], axis=1).astype(d.dtype)
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    part = d[some[at:end]]
                    total[group[some[at]], block] += part.sum() - 2 * (part @ flipped[at:end])[::-1]
    return total


def _flipped_sums(used: DataFrame, by: list[str], blocks: int, seed: int) -> DataFrame:
    """``block, s0, s1, ...``: sums of ``d`` under the signs of each block's bits, for each group and part of the items.

    The hashes of many items are made side by side, and only sums leave a task.
    """
    kinds = dict(used.dtypes)
    text = F.concat_ws("|", F.lit(str(seed)), F.lit("perm"), *by, "item_id").alias("__text")
    parts = int(used.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = used.select(*by, text, "d").repartition(parts, "__text")
    names = [f"s{pos}" for pos in range(BITS)]

    def told(held: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, total in held.items():
            yield pd.DataFrame(dict(zip(by, key, strict=True)) | {"block": range(blocks)} | dict(zip(names, total.astype(np.int64).T, strict=True)))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            group = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            frame, starts = frame.iloc[order], np.flatnonzero(np.diff(group[order], prepend=-1))
            total = _flips([t.encode() for t in frame["__text"]], frame["d"].to_numpy(), starts, blocks)
            for key, part in zip(frame[by].iloc[starts].itertuples(index=False, name=None), total, strict=True):
                held[key] = held[key] + part if key in held else part
            if len(held) > GROUPS_AT_ONCE:
                yield from told(held)
                held = {}
        yield from told(held)

    return dealt.mapInPandas(sums, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "block int", *(f"{s} long" for s in names)]))


def _binomial(m: int) -> tuple[np.ndarray, int]:
    """Probabilities of Binomial(m, 1/2) and the first count they stand for; left out is what no double can hold."""
    mode, reach = m // 2, int((380 * m) ** 0.5) + 64
    up = np.arange(mode, min(m, mode + reach), dtype=float)
    down = np.arange(mode, max(0, mode - reach), -1, dtype=float)
    right, left = np.cumprod((m - up) / (up + 1)), np.cumprod(down / (m - down + 1))
    pmf = np.concatenate([left[::-1], [1.0], right])
    return pmf / pmf.sum(), mode - len(left)


def _exact_p(sizes: dict[int, int], observed: int) -> float:
    """P(abs(sum) >= abs(observed)) where each of ``sizes[k]`` items adds k or -k.

    ``pmf[i]`` stands for a sum of ``low + 2 * i``; one step of a size is k places.
    """
    pmf, low = np.ones(1), 0
    for k, m in sorted(sizes.items()):
        steps, first = _binomial(m)
        wide = np.zeros(len(pmf) + k * (len(steps) - 1))
        for r in range(min(k, len(pmf))):  # places that are apart by other than a multiple of k don't meet
            part = np.convolve(pmf[r::k], steps)
            wide[r :: k][: len(part)] += part
        pmf, low = wide, low + k * (2 * first - m)
        held = np.flatnonzero(pmf)
        pmf, low = pmf[held[0] : held[-1] + 1], low + 2 * int(held[0])
    sums = low + 2 * np.arange(len(pmf))
    return float(min(1.0, np.sort(pmf[np.abs(sums) >= abs(observed)]).sum()))


def permutation_p_exact(cell_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """The same p without sampling: the exact distribution of the signed sum.

    Items enter as counts of equal differences, whose signed sums are binomial; a group is one row of as
    many counts as there are sizes, and its distribution is as long as the square root of the items.
    """
    used = cell_table.where("n > 0").withColumn("d", (F.col("b") - F.col("c")).cast("long"))
    sizes = used.groupBy(*by, F.abs("d").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.sum("d").alias("s"))
    packed = sizes.groupBy(*by).agg(F.sum("s").alias("observed"), F.array_sort(F.collect_list(F.struct("k", "m"))).alias("sizes"))

    @F.pandas_udf("double")
    def exact(k: pd.Series, m: pd.Series, observed: pd.Series) -> pd.Series:
        found = ({int(x): int(y) for x, y in zip(a, b, strict=True) if x} for a, b in zip(k, m, strict=True))
        return pd.Series([_exact_p(x, int(o)) for x, o in zip(found, observed, strict=True)])

    return packed.select(*by, F.col("observed").alias("observed_d"), exact("sizes.k", "sizes.m", "observed").alias("p"))


def _generator(seed: int, stream: str, key: str) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.md5(f"{seed}|{stream}|{key}".encode()).hexdigest(), 16))


def _ends(n: int, alpha: float) -> tuple[int, int]:
    return int(alpha / 2 * n), min(n - 1, -int(-(1 - alpha / 2) * n // 1) - 1)


def _drawn_sums(rng: np.random.Generator, times: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` over as many items as there are, drawn with replacement; each row of them occurs ``times``."""
    step = max(1, 1_000_000 // len(times))
    return np.concatenate([rng.multinomial(times.sum(), times / times.sum(), min(step, n - at)) @ values for at in range(0, n, step)])


def _angle(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.sqrt(np.clip(part / whole, 0, 1)))


def counted_resamples(cell_table: DataFrame, by: list[str] = BY, n: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """``observed_d`` and ``p`` as of ``permutation_p``, ``h_lo`` and ``h_hi`` as of ``bootstrap_h``, and the ends
    ``ci_lo`` and ``ci_hi`` of ``noise_gate``, all from counts of equal cells (null where there are no items)."""
    counts = ["n", "b", "c", "nn", "nb", "nc"]
    paired = F.coalesce(F.col("item_id") != "", F.lit(False)).cast("long")
    tally = cell_table.groupBy(*by, *[F.col(c).cast("long").alias(c) for c in counts], paired.alias("paired")).agg(F.count(F.lit(1)).alias("m"))
    cols = [*counts, "paired", "m"]
    packed = tally.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("cells"))
    low, high = _ends(n, alpha)

    def one(key: str, *arrays: np.ndarray) -> tuple:
        at = dict(zip(cols, (np.asarray(a, dtype=np.int64) for a in arrays), strict=True))
        out: list = [None] * 6
        used = {k: v[at["n"] > 0] for k, v in at.items()}
        if len(used["m"]):
            d = used["b"] - used["c"]
            observed, rng = int((d * used["m"]).sum()), _generator(SEED, "perm", key)
            total = np.zeros(n, dtype=np.int64)
            for k in np.unique(np.abs(d[d != 0])):
                m = int(used["m"][np.abs(d) == k].sum())
                total += k * (2 * rng.binomial(m, 0.5, n) - m)
            out[:2] = observed, (int((np.abs(total) >= abs(observed)).sum()) + 1) / (n + 1) if d.any() else 1.0
            sums = _drawn_sums(_generator(SEED, "boot", key), used["m"], np.stack([used[c] for c in "nbc"], 1), n)
            out[2:4] = np.sort(_angle(sums[:, 1], sums[:, 0]) - _angle(sums[:, 2], sums[:, 0]))[[low, high]]
        both = {k: v[(at["n"] > 0) & (at["nn"] > 0) & (at["paired"] > 0)] for k, v in at.items()}
        if len(both["m"]):
            diff = both["b"] / both["n"] - both["nb"] / both["nn"]
            sums = _drawn_sums(_generator(GATE_SEED, "gate", key), both["m"], diff[:, None], n)[:, 0]
            out[4:] = np.sort(np.round(sums / both["m"].sum(), 12))[[low, high]]
        return tuple(out)

    names = ["observed_d", "p", "h_lo", "h_hi", "ci_lo", "ci_hi"]

    @F.pandas_udf("observed_d long, p double, h_lo double, h_hi double, ci_lo double, ci_hi double")
    def resample(key: pd.Series, n_: pd.Series, b: pd.Series, c: pd.Series, nn: pd.Series, nb: pd.Series, nc: pd.Series, paired: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = [one(*r) for r in zip(key, n_, b, c, nn, nb, nc, paired, m, strict=True)]
        return pd.DataFrame(rows, columns=names).astype({"observed_d": "Int64"})

    found = packed.withColumn("found", resample(F.concat_ws("|", *by), *[F.col(f"cells.{c}") for c in cols]))
    return found.select(*by, *[F.col(f"found.{c}").alias(c) for c in names])


def _order_statistics(draws: DataFrame, by: list[str], value: str, n: int, alpha: float) -> DataFrame:
    """The draws at the two ends of the interval, by rank and without interpolation."""
    low, high = _ends(n, alpha)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    ranked = draws.withColumn("__at", at)
    return ranked.groupBy(*by).agg(
        F.max(F.when(F.col("__at") == low, F.col(value))).alias("ci_lo"), F.max(F.when(F.col("__at") == high, F.col(value))).alias("ci_hi")
    )


#: Places of a group whose values are told in one row, two bytes a place; resamples that a task draws together.
SPAN, TOGETHER = 1 << 16, 100


def _places(head: str, resamples: range, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Resamples and which of ``k`` items stand at their slots, piece by piece: ``uniform`` of the hashes of ``head|r|slot``, times k."""
    for low, high in hashes.by_digits(0, k):
        for at in range(low, high, hashes.LANES):
            slots = hashes.decimals(np.arange(at, min(high, at + hashes.LANES)))
            step = hashes.LANES // len(slots)
            for first, last in hashes.by_digits(resamples.start, resamples.stop):
                for r in range(first, last, step):
                    some = np.arange(r, min(last, r + step))
                    text = f"{head}|{r}|{low}".encode()
                    frames = np.tile(np.frombuffer(hashes.framed(text), dtype=np.uint8), (len(some) * len(slots), 1))
                    end = len(text) - slots.shape[1]
                    frames[:, end : len(text)] = np.tile(slots, (len(some), 1))
                    frames[:, end - 1 - len(str(r)) : end - 1] = hashes.decimals(some).repeat(len(slots), 0)
                    u = (hashes.md5(frames)[:, :8].copy().view(">u8")[:, 0] >> np.uint64(12)) / float(2**52)
                    yield some.repeat(len(slots)), (u * k).astype(np.int64)


def _resampled(items: DataFrame, by: list[str], values: list[str], n: int, seed: int, stream: str) -> DataFrame:
    """Sums of ``values`` over as many items as there are, drawn with replacement, for each of ``n`` resamples.

    A task draws some resamples of a group and looks up their items: it has two bytes for each item of the group and
    the distinct values of each span of them. No draw is shuffled.
    """
    kinds = {c: t if t == "double" else "bigint" for c, t in items.dtypes if c in values} | {c: t for c, t in items.dtypes if c in by}
    numbered = items.select(*by, *values, (F.row_number().over(Window.partitionBy(*by).orderBy("item_id")) - 1).alias("idx"))
    found = numbered.select(*by, F.expr(f"idx div {SPAN}").cast("int").alias("span"), F.expr(f"idx % {SPAN}").cast("int").alias("at"), *values)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alike = rows.sort_values("at").groupby(values, sort=False)
        codes, distinct = alike.ngroup().to_numpy(dtype="<u2"), alike.head(1)
        return pd.DataFrame([[*key, codes.tobytes(), *[distinct[v].to_numpy() for v in values]]], columns=[*by, "span", "codes", *values])

    lists = ", ".join(f"`{v}` array<{kinds[v]}>" for v in values)
    told = found.groupBy(*by, "span").applyInPandas(packed, f"{keys}, span int, codes binary, {lists}")
    head = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *by).alias("head")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of partitions is given: by bytes, these small tables would all end in one task.
    dealt = told.select("*", head, F.explode(F.sequence(F.lit(0), F.lit(-(-n // TOGETHER) - 1))).alias("part")).repartition(parts, *by, "part")

    def sums(key: tuple, spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.sort_values("span")
        offsets = np.cumsum([0, *[len(x) for x in spans[values[0]]][:-1]])
        codes = np.concatenate([np.frombuffer(c, dtype="<u2") + np.int32(o) for c, o in zip(spans["codes"], offsets, strict=True)])
        table = {v: np.concatenate(list(spans[v])) for v in values}
        resamples = range(key[-1] * TOGETHER, min(n, (key[-1] + 1) * TOGETHER))
        total = {v: np.zeros(len(resamples)) for v in values}
        for r, places in _places(spans["head"].iloc[0], resamples, len(codes)):
            drawn = codes[places]
            for v in values:
                total[v] += np.bincount(r - resamples.start, weights=table[v][drawn], minlength=len(resamples))
        sized = {v: total[v] if kinds[v] == "double" else total[v].astype(np.int64) for v in values}
        return pd.DataFrame(dict(zip(by, key[:-1], strict=True)) | {"r": resamples} | sized)

    return dealt.groupBy(*by, "part").applyInPandas(sums, ", ".join([keys, "r int", *(f"`{v}` {kinds[v]}" for v in values)]))


def bootstrap_h(cell_table: DataFrame, by: list[str] = BY, n: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Interval of the effect size when whole items are resampled."""
    sums = _resampled(cell_table.where("n > 0"), by, ["n", "b", "c"], n, seed, "boot")
    draws = sums.select(*by, cohens_h(ratio(F.col("b"), F.col("n")), ratio(F.col("c"), F.col("n"))).alias("h"))
    return _order_statistics(draws, by, "h", n, alpha)


def poisson_bootstrap_h(cell_table: DataFrame, by: list[str] = BY, n: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """As ``bootstrap_h``, each item drawn a Poisson number of times: no numbering and no join, for very many items."""
    cuts, total, term = [], 0.0, 0.36787944117144233
    for i in range(12):
        total += term
        cuts.append(total)
        term /= i + 1
    u = uniform(seed, "poisson", *[F.col(c) for c in by], F.col("item_id"), F.col("r"))
    times = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col("u") >= cuts[0], 1).otherwise(0))
    sums = (
        cell_table.where("n > 0").withColumn("r", _draws(n)).withColumn("u", u).withColumn("w", times).where("w > 0")
        .groupBy(*by, "r").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in ("n", "b", "c")])
    )
    draws = sums.select(*by, cohens_h(ratio(F.col("b"), F.col("n")), ratio(F.col("c"), F.col("n"))).alias("h"))
    return _order_statistics(draws, by, "h", n, alpha)


def bootstrap_any(
    rows: DataFrame, by: list[str], item: str, value: str, stat: Callable[[np.ndarray, np.ndarray], float],
    n: int = RESAMPLES, bag: int = 2_000, seed: int = SEED, alpha: float = ALPHA,
) -> DataFrame:
    """``estimate, lo, hi`` of any statistic ``stat(values, weights)`` for each group.

    Hashes of ``item`` deal a group to bags of about ``bag`` rows. Each bag draws resamples of the whole
    group's size over its own rows, and the bags' ends are averaged (a bag of little bootstraps), so no
    task holds more than a bag. A group that fits one bag gets the plain bootstrap. Null values are left
    out; a group without values has no row. ``item`` names a row within its group: equal names share a bag.
    """
    found = rows.where(F.col(value).isNotNull()).select(*by, F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    sizes = found.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    dealt = found.alias("l").join(sizes.alias("r"), same).select("l.*", "size").withColumn(
        "bag", F.pmod(F.xxhash64(F.lit(seed), "item"), F.ceil(F.col("size") / bag))
    )
    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rows long, estimate double, lo double, hi double"])
    lo_at, hi_at = _ends(n, alpha)

    def resample(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item", "value"], kind="stable")
        values, size = group["value"].to_numpy(), int(group["size"].iloc[0])
        rng = _generator(seed, "any", "|".join(map(str, key)))
        share = np.full(len(values), 1.0 / len(values))
        drawn = np.sort([stat(values, rng.multinomial(size, share)) for _ in range(n)])
        whole = stat(values, np.ones(len(values), dtype=np.int64))
        return pd.DataFrame([[*key[:-1], len(values), whole, drawn[lo_at], drawn[hi_at]]], columns=[*by, "rows", "estimate", "lo", "hi"])

    bags = dealt.groupBy(*by, "bag").applyInPandas(resample, schema)
    part = lambda c: (F.sum(F.col(c) * F.col("rows")) / F.sum("rows")).alias(c)
    return bags.groupBy(*by).agg(F.sum("rows").alias("n_items"), *map(part, ("estimate", "lo", "hi")))


def bootstrap_binned(
    rows: DataFrame, by: list[str], value: str, stat: Callable[[np.ndarray, np.ndarray], float],
    n: int = RESAMPLES, bins: int = 4_096, block: int = 100, seed: int = SEED, alpha: float = ALPHA,
) -> DataFrame:
    """``n_items, estimate, ci_lo, ci_hi, error`` of ``stat(values, weights)`` for each group, whatever its size.

    A group's values become counts of at most ``bins`` bins of equal width between its least and largest value,
    each told as its middle. Counts are summed before they are shuffled, and blocks of resamples are drawn from
    them by separate tasks (multinomial, as many rows as the group has), so no task holds more than ``bins`` numbers
    and no group is hot. Each value moves by at most ``error``, half a bin; a statistic that moves by no more than
    its values do (mean, quantile, trimmed mean) therefore has its estimate, and each end of the plain bootstrap's
    interval over the same draws, within ``error``. Where a group has at most one value, ``error`` is 0.

    Null, NaN and infinite values are left out; a group without others has no row; null is a group of its own.
    Draws come from (seed, the group's counts, block), so they don't depend on partitions or order.
    """
    number = F.col(value).cast("double")
    found = rows.select(*by, number.alias("__v")).where(F.col("__v").isNotNull() & (F.abs("__v") < float("inf")))
    # halves first: the distance of two doubles may be no double
    ends = found.groupBy(*by).agg(F.min("__v").alias("__low"), ((F.max("__v") / 2 - F.min("__v") / 2) / bins).alias("__half"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.lit(True))
    place = F.floor((F.col("__v") / 2 - F.col("__low") / 2) / F.col("__half"))
    at = F.when(F.col("__half") > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (
        found.alias("l").join(ends.alias("r"), same).select("l.*", "__low", "__half")
        .withColumn("__bin", at.cast("int")).groupBy(*by, "__low", "__half", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    )
    whole = counts.groupBy(*by, "__low", "__half").agg(F.sort_array(F.collect_list(F.struct("__bin", "__n"))).alias("__bins"))
    # groups go through Python by a text of their keys, which are then looked up: null and long keys stay what they are
    key = F.to_json(F.struct(F.lit(0).alias("__0"), *by))
    table = stored(whole.withColumn("__key", key), "binned-counts")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                place = np.array([b["__bin"] for b in row["__bins"]], dtype=float)
                times = np.array([b["__n"] for b in row["__bins"]], dtype=np.int64)
                values = row["__low"] + (2 * place + 1) * row["__half"]
                rng = _generator(seed, "binned", f"{row['__block']}|{row['__low']!r}|{row['__half']!r}|{times.tolist()}")
                some = min(block, n - row["__block"] * block)
                drawn = [float(stat(values, w)) for w in rng.multinomial(times.sum(), times / times.sum(), some)]
                head = {"__key": row["__key"], "n_items": int(times.sum()), "error": row["__half"], "estimate": float(stat(values, times))}
                yield pd.DataFrame([head | {"drawn": d} for d in drawn])

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1)))
    spread = table.select("__key", "__low", "__half", "__bins").withColumn("__block", blocks).repartition("__key", "__block")
    draws = spread.mapInPandas(draw, "__key string, n_items long, error double, estimate double, drawn double")
    found = _order_statistics(draws, ["__key", "n_items", "error", "estimate"], "drawn", n, alpha)
    return table.select(*by, "__key").join(found, "__key").select(*by, "n_items", "estimate", "ci_lo", "ci_hi", "error")


def noise_gate(cell_table: DataFrame, by: list[str] = BY, n: int = RESAMPLES, seed: int = GATE_SEED, alpha: float = ALPHA) -> DataFrame:
    """Interval of the item-wise difference in wrong flips between perturbation and noise; above if it lies over 0.

    Without shared items the totals are compared; groups without noise cells are missing here, so that
    their gate is null and blocks nothing.
    """
    shared = cell_table.where("n > 0 and nn > 0 and item_id <> ''").withColumn(
        "diff", ratio(F.col("b"), F.col("n")) - ratio(F.col("nb"), F.col("nn"))
    ).withColumn("one", F.lit(1))
    sums = _resampled(shared, by, ["diff", "one"], n, seed, "gate")
    draws = sums.select(*by, F.round(F.col("diff") / F.col("one"), 12).alias("diff"))
    return gated(cell_table, _order_statistics(draws, by, "diff", n, alpha), by)


def gated(cell_table: DataFrame, ends: DataFrame, by: list[str] = BY) -> DataFrame:
    """The noise gate from the ``ends`` of its interval (``ci_lo``, ``ci_hi``)."""
    floors = noise_floor(cell_table, by).join(totals(cell_table, by).select(*by, "p_wrong"), by)
    return floors.join(ends, by, "left").select(
        *by, "noise_floor", "noise_self_disagreement",
        F.coalesce("ci_lo", "noise_floor").alias("noise_lo"), F.coalesce("ci_hi", "noise_floor").alias("noise_hi"),
        F.when(F.col("ci_lo").isNotNull(), F.col("ci_lo") > 0).otherwise(F.col("p_wrong") > F.col("noise_floor")).alias("above_noise"),
    )


def effects(cell_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """Effect size and variance of each item."""
    return cell_table.where("n > 0").select(
        *by, cohens_h(ratio(F.col("b"), F.col("n")), ratio(F.col("c"), F.col("n"))).alias("effect"),
        (F.lit(1.0) / F.col("n")).alias("variance"),
    )


def dersimonian_laird(effect_table: DataFrame, by: list[str] = BY) -> DataFrame:
    """Random-effects pooling of ``effect``s with ``variance``s: two aggregations, no pass over items on the driver."""
    v, e = F.col("variance"), F.col("effect")
    w = F.when(v > 0, F.lit(1.0) / F.when(v > 0, v)).otherwise(0.0)
    one = effect_table.withColumn("w", w).groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * e).alias("swe"),
        F.sum(F.col("w") * e * e).alias("swee"), F.sum(F.col("w") * F.col("w")).alias("sww"),
    )
    sw, df = F.col("sw"), (F.col("k") - 1).cast("double")
    safe = F.when(sw > 0, sw)
    q = F.greatest(F.col("swee") - F.col("swe") * F.col("swe") / safe, F.lit(0.0))
    spare = sw - F.col("sww") / safe
    tau = F.when((spare > 0) & (df > 0), F.greatest(F.lit(0.0), (F.col("q") - df) / F.when(spare > 0, spare))).otherwise(0.0)
    one = one.withColumn("q", q).withColumn("tau_sq", tau)
    two = effect_table.join(one.select(*by, "tau_sq"), by)
    total = v + F.col("tau_sq")
    ws = F.when(total > 0, F.lit(1.0) / F.when(total > 0, total)).otherwise(0.0)
    two = two.withColumn("ws", ws).groupBy(*by).agg(F.sum("ws").alias("sws"), F.sum(F.col("ws") * e).alias("swse"))
    both = one.join(two, by)
    ok, sws = sw > 0, F.when(F.col("sws") > 0, F.col("sws"))
    pooled, se = F.col("swse") / sws, F.sqrt(F.lit(1.0) / sws)
    i_sq = F.when((F.col("q") > 0) & (df > 0), F.greatest(F.lit(0.0), (F.col("q") - df) / F.when(F.col("q") > 0, F.col("q")) * 100)).otherwise(0.0)
    nothing = F.lit(float("nan"))
    rows = both.select(*by, "k", "q", "tau_sq", i_sq.alias("i_sq"), ok.alias("ok"), pooled.alias("pooled"), se.alias("se"))
    keep = lambda c, other=0.0: F.when(F.col("ok"), c).otherwise(other)
    z = F.when(F.col("se") > 0, F.col("pooled") / F.when(F.col("se") > 0, F.col("se"))).otherwise(0.0)
    return rows.withColumn("z", z).select(
        *by, "k", keep(F.col("pooled")).alias("pooled"), keep(F.col("se")).alias("se"), keep(F.col("z")).alias("z"),
        keep(F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("z"))), 1.0).alias("p_meta"), keep(F.col("tau_sq")).alias("tau_sq"),
        keep(F.col("q")).alias("q"), keep(F.col("i_sq")).alias("i_sq"),
        keep(F.col("pooled") - 1.96 * F.col("se"), nothing).alias("meta_lo"), keep(F.col("pooled") + 1.96 * F.col("se"), nothing).alias("meta_hi"),
    )


def holm(results: DataFrame, family: list[str], order: str, p: str = "p", alpha: float = ALPHA) -> DataFrame:
    """Adjusted p and rejection within each family: the running maximum of (m - rank) p, stopping at the first failure."""
    rank = Window.partitionBy(*family).orderBy(p, order)
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = results.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*family))).withColumn("__r", F.row_number().over(rank) - 1)
    left = (F.col("__m") - F.col("__r")).cast("double")
    ranked = ranked.withColumn("__adj", left * F.col(p)).withColumn("__ok", (F.col(p) <= F.lit(alpha) / left).cast("int"))
    return (
        ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("__adj").over(upto)))
        .withColumn("rejected", F.min("__ok").over(upto) == 1)
        .drop("__m", "__r", "__adj", "__ok")
    )


def verdict(rejected: Column, above: Column) -> Column:
    """A missing gate does not block a finding; only a gate that failed does."""
    return (
        F.when(~rejected, "no significant net bias")
        .when(F.coalesce(~above, F.lit(False)), "significant but BELOW noise floor (not reported as a finding)")
        .otherwise("systematic bias confirmed")
    )


def corrected(results: DataFrame, by: list[str] = BY, order: str = "axis_order", alpha: float = ALPHA) -> DataFrame:
    """Holm over the confirmatory axes of each judge (and template); the others are tested alone, strictly."""
    group = [c for c in by if c != "axis"]
    family = holm(results.where("confirmatory"), group, order, alpha=alpha)
    alone = results.where("not confirmatory").withColumn("p_adjusted", F.col("p")).withColumn("rejected", F.col("p") < alpha)
    return family.unionByName(alone).withColumn("verdict", verdict(F.col("rejected"), F.col("above_noise")))


def axis_results(judgments: DataFrame, axes: DataFrame, by: list[str] = BY, n: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """Everything known about each judge and axis, with corrected verdicts; ``axes`` is ``axes.taxonomy``.

    Judgments are read once: the cells, which all statistics come from, are stored.
    """
    return _results(stored(counted_cells(judgments, by), "cells"), axes, by, n, alpha)


def all_results(judgments: DataFrame, axes: DataFrame, n: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """The results of all templates together (under ``POOLED``) and of each template, from one pass over the judgments."""
    return _results(stored(cells_by_all(judgments), "cells"), axes, BY_TEMPLATE, n, alpha)


def _results(table: DataFrame, axes: DataFrame, by: list[str], n: int, alpha: float) -> DataFrame:
    drawn = stored(resampled(table, by, n, alpha, SEED, GATE_SEED), "resampled")
    found = (
        totals(table, by)
        .join(drawn.select(*by, "observed_d", "p", "h_lo", "h_hi"), by)
        .join(dersimonian_laird(effects(table, by), by), by, "left")
        .join(gated(table, drawn.select(*by, "ci_lo", "ci_hi"), by), by, "left")
        .join(F.broadcast(axes), "axis")
    )
    shown = counted_accuracy(table, by)
    if "prompt_template" in by:  # rows by template carry no accuracies
        shown = shown.where(F.col("prompt_template") == POOLED)
    found = found.join(shown, by, "left")
    return corrected(found, by, alpha=alpha)
