"""Fingerprints, shards, mixtures and near copies against plain Python."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tiltmeter.llm import label_sharding, minhash_hamming, order_minhash, temperature_mix
from tiltmeter.llm.shared import components

MASK = 2**64 - 1


def chained(values, seed=42):
    """xxhash64 of a row: each value's hash is the seed of the next one."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, Long) else struct.pack("<i", v)
        seed = xxhash.xxh64(data, seed=seed & MASK).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


class Long(int):
    pass


def brute_fingerprint(text):
    words = [Long(chained([w])) for w in re.split(r"[ \t-\r]+", text)]
    k, seen, cells = order_minhash.K, {}, {}
    for place in range(max(0, len(words) - k) + 1):
        kmer = (chained(words[place : place + k]) & MASK) >> 32
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        value = (chained([Long(kmer), nth]) & MASK) >> 32
        cell = value >> (32 - order_minhash.CELL_BITS)
        cells[cell] = min(cells.get(cell, (1 << 70, 0)), (value, place))
    chosen = [cells[min((c for c in cells if c >= cell), default=min(cells))] for cell in range(order_minhash.CELLS)]
    out = ""
    for t in range(order_minhash.TUPLES):
        a, b = chosen[2 * t], chosen[2 * t + 1]
        first, second = (a, b) if a[1] <= b[1] else (b, a)
        out += f"{(chained([t, Long(first[0]), Long(second[0])]) & MASK) >> 32:08X}"
    return out


def test_order_minhash_equals_brute_force(spark, documents, prose):
    more = [(20 + i, prose(n, 30 + i), "en", "a", 0) for i, n in enumerate((2, 3, 4, 64, 200))] + [(30, "a b a b " * 200, "en", "a", 0)]
    df = documents.select("doc_id", "text", "lang", "source", "n_chars", "id", "n").unionByName(
        spark.createDataFrame(more, documents.select("doc_id", "text", "lang", "source", "n_chars").schema).selectExpr("*", "'x' as id", "'y' as n")
    )
    got = order_minhash.fingerprints(df).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = []
    near = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / order_minhash.TUPLES
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edit = text[: len(text) - third] + after[:third]
        a, b, c = brute_fingerprint(text), brute_fingerprint(edit), brute_fingerprint(after)
        wanted.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert order_minhash.fingerprints(df.limit(0)).count() == 0
    single = order_minhash.fingerprints(df.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_order_minhash_sees_order(spark, prose):
    words = prose(300, 1).split()
    swapped = words[150:] + words[:150]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped))], "doc_id long, text string")
    a, b = (r.fingerprint for r in order_minhash.fingerprints(df).orderBy("doc_id").collect())
    same = sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / order_minhash.TUPLES
    assert 0.2 < same < 0.85  # nearly all k-mers are the same, but half the pairs changed places


def test_shards_are_even_gapless_and_keep_groups(spark, documents, prose):
    rows = [(i, prose(5, i // 3 if i < 240 else i + 1000)) for i in range(800)] + [(900 + i, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("shard", F.lit("x"))
    got = label_sharding.shard_documents(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = dict(rows)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    groups = {}
    for r in got:
        groups.setdefault(text[r.doc_id], []).append(r.shard)
    small = [s for t, s in groups.items() if len(s) == 3]
    assert len(small) == 80 and sum(len(set(s)) == 1 for s in small) >= 64  # the hot group fills one shard
    assert max(groups["hot"].count(s) for s in range(8)) >= 100
    odd = label_sharding.shard_documents(documents).collect()
    assert len(odd) == documents.count() and len({(r.shard, r.slot) for r in odd}) == len(odd)
    assert label_sharding.shard_documents(documents.limit(0)).count() == 0


def test_granted_moves_respect_room():
    limits, sizes = label_sharding.granted([(0, 1, 0, 5), (0, 1, 1, 5), (1, 0, 0, 4), (2, 1, 0, 9)], {0: 10, 1: 10, 2: 10}, 11)
    assert limits == {(0, 1): 0, (1, 0): 0, (2, 1): -1} and sizes == {0: 9, 1: 11, 2: 10}


def brute_classes(rows, k, percent):
    sets = [(i, minhash_hamming.shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return sorted((str(i), len(s), str(root(i) if i is not None and s else i), i is None or not s or root(i) == i) for i, s in sets)


def near_copies(prose, n, seed):
    words = prose(80, seed).split()
    out = []
    for i in range(n):
        w = list(words)
        for j in range(i % 4):
            w[(7 * i + 13 * j) % len(w)] = f"w{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, documents, prose, k):
    more = [(100 + 50 * s + i, t) for s in range(6) for i, t in enumerate(near_copies(prose, 30, s))]
    shared = prose(30, 99)  # a passage that many documents hold
    more += [(1000 + i, f"{prose(60, 500 + i)} {shared}") for i in range(40)]
    df = documents.select("doc_id", "text", "n", "key").unionByName(
        spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x' as n", "'y' as key")
    )
    got = minhash_hamming.near_duplicates(df, shingle=k).collect()
    wanted = brute_classes([(r.doc_id, r.text) for r in df.collect()], k, 80)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == wanted
    assert minhash_hamming.near_duplicates(df.limit(0)).count() == 0


def crowd_of_texts(seed, n):
    """Texts around two passages that many share: some near copies of each other, most of them not."""
    rng = random.Random(seed)
    passages = [[f"{p}{i}" for i in range(60)] for p in "pq"]
    texts = []
    for i in range(n):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 10, 12, 14, 20, 40]))]
        words = rng.choice(passages)[: rng.choice([40, 50, 60])] + own
        if i % 3 == 2:  # an earlier text with words changed or left out
            words = texts[rng.randrange(i)].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
            words = words[rng.randrange(3) :]
        texts.append(" ".join(words))
    return texts


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    texts = crowd_of_texts(3, 150)
    rows = [*enumerate(texts), (150, texts[0]), (150, texts[0]), (151, None), (152, "")]
    sets = {i: minhash_hamming.shingle_set(t, 4) for i, t in rows}
    comps = {i: i // 40 for i in sets}
    crowd = spark.createDataFrame(list(comps.items()), "cls long, comp long")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(r.x, r.y) for r in minhash_hamming.under_rare_shingles(crowd, df.withColumnRenamed("doc_id", "cls"), 4, 80).collect()]
    linked, met = set(), set()
    for (i, a), (j, b) in itertools.combinations([s for s in sets.items() if s[1]], 2):
        both = len(a & b)
        if comps[i] != comps[j]:
            met |= {(i, j)} if both else set()
            linked |= {(i, j)} if 100 * both >= 80 * (len(a) + len(b) - both) else set()
    assert len(pairs) == len(set(pairs)) and linked and linked <= set(pairs) <= met and len(pairs) < len(met) / 4
    monkeypatch.setattr(minhash_hamming, "CROWD", 2)
    monkeypatch.setattr(minhash_hamming, "HUBS", 0)  # so that every link is left to the crowded keys
    got = minhash_hamming.near_duplicates(df, shingle=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_classes(rows, 4, 80)


def test_large_sets_at_the_threshold_are_proposed(spark):
    """The estimated sketch test, for sets too large for exact bounds: pairs just above the threshold by plain counts."""
    rng, rows = np.random.default_rng(8), []
    for i in range(300):
        n = int(rng.integers(2100, 9000))
        percent = 80 + (i % 3)
        common = -(-2 * n * percent // (100 + percent))
        drawn = np.unique(rng.integers(0, 2**64, 3 * n, dtype=np.uint64))
        rng.shuffle(drawn)
        for side, own in (("a", drawn[n : 2 * n - common]), ("b", drawn[2 * n : 3 * n - common])):
            part = np.sort(np.concatenate([drawn[:common], own]))
            sketch = np.unique((part[: minhash_hamming.SKETCH] >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16))
            rows.append((i, side, len(part), sketch.tolist()))
    df = spark.createDataFrame(rows, "pair int, side string, n long, sketch array<smallint>")
    a, b = (df.where(F.col("side") == s).alias(s) for s in "ab")
    got = a.join(b, F.col("a.pair") == F.col("b.pair")).select(minhash_hamming.sketches_allow("a", "b", 80).alias("ok")).collect()
    assert len(got) == 300 and sum(r.ok for r in got) >= 0.99 * len(got)


def test_distances_match_plain_counts(spark):
    words = [minhash_hamming.words_of(t) for t in ("a b c d e f g h i j k l", "a b c d e f g h i j k m")]
    sigs = [minhash_hamming.signature(w, 4, minhash_hamming._WordHashes()) for w in words]
    cols = minhash_hamming.LANES + minhash_hamming.ODD_LANES
    schema = "cls int, n long, " + ", ".join(f"{c} long" for c in cols)
    a, b = (spark.createDataFrame([(i, s[0], *s[1])], schema).alias("ab"[i]) for i, s in enumerate(sigs))
    got = a.crossJoin(b).select(*[d.alias(f"d{j}") for j, d in enumerate(minhash_hamming.chunk_distances("a", "b"))]).first()
    lane = lambda x, i: x >> (minhash_hamming.LANE * i) & (2**minhash_hamming.BITS - 1)
    wanted = [sum(lane(x, i) != lane(y, i) for i in range(4)) for x, y in zip(sigs[0][1][:10], sigs[1][1][:10], strict=True)]
    assert list(got) == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component_id for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(df.limit(0)).count() == 0


def sources(spark, tokens):
    return spark.createDataFrame([(s, t, 1) for s, t in tokens.items()], "source string, n_tokens long, n_docs long")


def test_exponent_meets_entropy_or_repeats(spark):
    tokens = {"a": 9000, "b": 700, "c": 250, "d": 50}
    entropy = lambda x: -sum(w * math.log(w) for w in [t**x / sum(u**x for u in tokens.values()) for t in tokens.values()])
    x = temperature_mix.exponent(sources(spark, tokens), 0.9, None, None)
    assert 0 < x < 1 and entropy(x) == pytest.approx(0.9 * math.log(4), abs=1e-4)
    y = temperature_mix.exponent(sources(spark, tokens), 0.9, 2.0, None)
    quotas = {r.source: r.quota / tokens[r.source] for r in temperature_mix.quotas(sources(spark, tokens), 0.9, 2.0).collect()}
    assert y > x and max(quotas.values()) == pytest.approx(2.0, abs=0.05)
    assert temperature_mix.exponent(sources(spark, tokens), 0.1, None, None) == 1.0
    assert temperature_mix.exponent(sources(spark, {}), 0.9, 2.0, None) == 1.0


def test_mix_fills_quotas_with_whole_passes(spark, documents, prose):
    rows = [(i, prose(20 + i % 7, i), "big") for i in range(400)] + [(1000 + i, prose(10, i), "small") for i in range(30)] + [(2000, None, "void"), (2001, "", "void"), (2002, prose(9, 1), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("k", F.lit(1)).withColumn("passes", F.lit(2))
    drawn = temperature_mix.mix(df, entropy_share=0.9, max_repeats=3.0).collect()
    assert set(drawn[0].asDict()) >= {"doc_id", "text", "source", "k", "passes", "mix_pass"}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    plan = {r.source: r for r in temperature_mix.quotas(
        df.groupBy("source").agg(F.sum(temperature_mix.tokens(F.col("text"))).alias("n_tokens"), F.count("*").alias("n_docs")), 0.9, 3.0
    ).collect()}
    assert "void" not in {r.source for r in drawn}
    for source in ("big", "small", None):
        mine = [r for r in drawn if r.source == source]
        total, p = sum(size[r.doc_id] for r in mine), plan[source]
        assert p.quota <= total < p.quota + 30
        for n in range(p.passes):
            assert sorted(r.doc_id for r in mine if r.mix_pass == n) == sorted(r[0] for r in rows if r[2] == source)
        last = [r for r in mine if r.mix_pass == p.passes]
        assert len({r.doc_id for r in last}) == len(last)
    assert temperature_mix.mix(documents).count() > 0 and temperature_mix.mix(documents.limit(0)).count() == 0


def test_mix_draws_the_rows_of_a_plain_version(spark, prose, monkeypatch):
    """Every drawn row and pass, with its block and order, from a budget over several blocks of a source."""
    monkeypatch.setattr(temperature_mix, "BLOCK", 25)
    rows = [(i, prose(20 + i % 7, i), "big") for i in range(200)] + [(1000 + i, prose(10, i), "small") for i in range(60)] + [(None, prose(8, 2), None), (2000, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seed, share, repeats, budget = 5, 0.95, 3.0, 6_000
    md5 = lambda *parts: hashlib.md5("|".join(str(x) for x in parts if x is not None).encode()).hexdigest()
    by: dict = {}
    for i, text, source in rows:
        key = md5(seed, i, chained([] if text is None else [text]))
        by.setdefault("-" if source is None else f"={source}", []).append((key, len((text or "").split()), i))
    tokens = {s: sum(t for _, t, _ in found) for s, found in by.items()}
    total = sum(tokens.values())
    sources = spark.createDataFrame([(s, t, len(by[s])) for s, t in tokens.items()], "source string, n_tokens long, n_docs long")
    x = temperature_mix.exponent(sources, share, repeats, budget)
    norm = sum((t / total) ** x for t in tokens.values() if t)
    wanted = []
    for s, found in by.items():
        if not tokens[s]:
            continue
        passes, rest = divmod(math.floor((tokens[s] / total) ** x / norm * budget + 0.5), tokens[s])
        block = lambda k, n=max(1, len(found) // 25): int(k[:8], 16) % n
        place = lambda k, n: (md5(seed, n, s, block(k)), md5(n, k))  # noqa: E731, B023
        for n in range(passes):
            wanted += [(i, n, *place(k, n)) for k, _, i in found]
        for k, t, i in sorted(found, key=lambda r: place(r[0], passes)):
            if rest <= 0:
                break
            wanted.append((i, passes, *place(k, passes)))
            rest -= t
    got = [(r.doc_id, r.mix_pass, r.mix_block, r.mix_order) for r in temperature_mix.mix(df, entropy_share=share, max_repeats=repeats, budget=budget, seed=seed).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_quiet_hubs_do_not_end_propagation(spark):
    from tiltmeter.llm import label_sharding as S

    shards, seed = 4, 5
    drawn = spark.range(400).select("id", (S.draw(seed, F.col("id")) % shards).cast("int").alias("s")).collect()
    ids = [i for t in range(shards) for i in [r.id for r in drawn if r.s == t][: 12 if t == 0 else 5]]
    nodes = spark.createDataFrame([(i, 1) for i in ids], "id long, rows long")
    links = spark.createDataFrame([(ids[0], i) for i in ids[1:]], "a long, b long")  # the hub lies where most copies lie
    assert {r.shard for r in S.propagate(nodes, links, shards, len(ids), seed).collect()} == {0}
