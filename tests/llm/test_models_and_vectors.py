"""Classifiers by held-out accuracy, embeddings and the pipeline against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tiltmeter.llm import itq_dedup, minhash_hamming, nbsvm_quality, prefix_bpe, temperature_mix, toxic_segments
from tiltmeter.llm.queries import piece_model, queries


def held_out_accuracy(df, labels, column, folds, part):
    rows = df.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == part for r in rows)
    return sum(r.predicted == r[column] for r in rows) / len(rows), len(rows)


@pytest.fixture(scope="module")
def larger(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    got = nbsvm_quality.classify(docs, labels)
    accuracy, n = held_out_accuracy(got, labels, "quality", 5, 0)
    assert n > 40 and accuracy >= 0.93
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    got = toxic_segments.classify(docs, labels)
    accuracy, n = held_out_accuracy(got, labels, "toxic", 4, 2)
    assert n > 40 and accuracy >= 0.9
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("classify,column", [(nbsvm_quality.classify, "quality"), (toxic_segments.classify, "toxic")])
def test_classifiers_take_odd_tables(spark, documents, classify, column):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (9, None), (1, 1)], f"doc_id long, {column} int").withColumn("text", F.lit("x"))
    got = classify(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    none = classify(documents, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert classify(documents.limit(0), labels).count() == 0


def plain_toxicity(rows):
    """The toxicity model done over in plain Python: (lexicon, lambda, K, statistics and weights of the training rows)."""
    m = toxic_segments
    train = [(t, y, (xxhash.xxh64(t.encode(), seed=42).intdigest() ^ 1 << 63) - (1 << 63)) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    train = [(t, y, h % m.PARTS) for t, y, h in train]

    def learn(texts):
        totals = [sum(y == c for _, y in texts) for c in (0, 1)]
        words = {}
        for t, y in texts:
            for w in set(m.TOKEN.findall(t.lower())):
                words.setdefault(w, [0, 0])[y] += 1
        counts = {w + ".": tuple(c) for w, c in words.items()}
        for k in range(m.SHORTEST, m.LONGEST + 1):
            for prefix in {w[:k] for w in words if len(w) >= k}:
                those = sorted((c[1], c[0]) for w, c in words.items() if w.startswith(prefix))[:-1]
                counts[prefix] = (sum(c for _, c in those), sum(t for t, _ in those))
        p, even, known = (totals[1] + 0.5) / (sum(totals) + 1), {"": 0.5}, {}
        weigh = lambda c, p: sum(x * math.log(x / (sum(c) * q)) for x, q in zip(c, (1 - p, p), strict=True) if x)
        for f in sorted(counts, key=lambda f: (f.endswith("."), len(f))):
            c = counts[f]
            if not sum(c) or weigh(c, p) < m.ERRORS**2 / 4:
                continue
            word = f.rstrip(".")
            up = next(word[:k] for k in range(min(m.LONGEST, len(word)) - (not f.endswith(".")), -1, -1) if k == 0 or word[:k] in even and word[:k] != f)
            a, b = (x * min(totals) / n for x, n in zip(c, totals, strict=True))
            q = min(max((b + m.PRIOR * even[up]) / (a + b + m.PRIOR), m.LEAST_SHARE), 1 - m.LEAST_SHARE)
            if not f.endswith("."):
                even[f] = q
            share = totals[1] / sum(totals)
            if 2 * weigh(c, share) >= m.ERRORS**2 and (q > 0.5 and c[1] > sum(c) * share and c[1] >= m.LEAST_TEXTS or q < 0.5 and c[1] <= sum(c) * share):
                known[f] = math.log(q / (1 - q)) + m.BACKGROUND
        return known

    def scored(text, known):
        out = []
        for w in m.TOKEN.findall(text.lower()):
            at = [w + "."] + [w[:k] for k in range(min(m.LONGEST, len(w)), m.SHORTEST - 1, -1)]
            out.append(next((known[f] for f in at if f in known), m.BACKGROUND))
        return out

    final = learn([(t, y) for t, y, _ in train])
    parts = [learn([(t, y) for t, y, q in train if q != part]) for part in range(m.PARTS)]
    scores = [scored(t, parts[part]) for t, _, part in train]
    clean = [s for s, (_, y, _) in zip(scores, train, strict=True) if y == 0]
    values = [v for s in clean for v in s] + list(set(final.values()))
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(math.exp(min(600, mid * v)) for v in values) < len(values) else (low, mid)
    best = lambda s: max((x for *_, x in m.segments(np.array(s))), default=0.0)
    k = len(clean) / sum(len(s) * math.exp(-low * best(s)) for s in clean)

    def statistic(s):
        over = [math.log(m.SIGNIFICANT / (k * len(s))) + low * x for *_, x in m.segments(np.array(s))]
        return math.sqrt(sum(o for o in over if o > 0))

    return final, low, k, [(statistic(s), y) for s, (_, y, _) in zip(scores, train, strict=True)], lambda t: statistic(scored(t, final))


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(6)
    mild, vile = [f"mild{i:02d}word" for i in range(60)], ["vilesome", "vilest", "grimly", "grimmer", "foulness"]
    rows = []
    for i in range(420):
        words = [rng.choice(mild) for _ in range(rng.randrange(15, 50))]
        y = int(i % 4 == 0)
        if y:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(vile) for _ in range(rng.randrange(2, 6))]
        else:
            words += ["pleasantly"] * (i % 3) + (["vilest"] if i % 50 == 1 else [])
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    final, rate, k, fitted, statistic = plain_toxicity(rows)
    assert min(final.values()) < toxic_segments.BACKGROUND < 0 < max(final.values())
    model = toxic_segments.fit(docs, labels, "toxic", "doc_id", "text", 4, 2)
    assert model.lexicon == pytest.approx(final) and (model.rate, model.scale) == pytest.approx((rate, k))
    p = [1 / (1 + math.exp(-model.slope * x - model.offset)) for x, _ in fitted]
    # the logistic is where its slightly shrunk likelihood has no slope; the sample holds all rows, so they weigh the same
    assert sum((y - q) * x for q, (x, y) in zip(p, fitted, strict=True)) == pytest.approx(1e-3 * model.slope, abs=1e-5)
    assert sum(y - q for q, (_, y) in zip(p, fitted, strict=True)) == pytest.approx(1e-3 * model.offset, abs=1e-5)
    for r in toxic_segments.classify(docs, labels).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.slope * statistic(r.text) - model.offset)))


def test_segments_equal_brute_force():
    """Repeatedly take the best segment out and go on to both sides (Ruzzo and Tompa's definition)."""

    def brute(scores, at=0):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return brute(scores[:i], at) + [(at + i, at + j)] + brute(scores[j:], at + j)

    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.integers(-5, 6, rng.integers(0, 14)).astype(float) + rng.random() / 7
        assert [(s, e) for s, e, _ in toxic_segments.segments(scores)] == brute(list(scores))


def test_hinge_model_separates():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(200):
        label = 1.0 if i % 2 else -1.0
        at = np.append(rng.choice(50, 5, replace=False) + (0 if label > 0 else 50), nbsvm_quality.SPACE)
        rows.append((at, np.append(np.ones(5), 1.0)))
        y.append(label)
    w = nbsvm_quality.fit_hinge(rows, np.array(y), np.ones(200))
    assert all(y[i] * float(w[a] @ v) > 0 for i, (a, v) in enumerate(rows))


def brute_vectors(rows, least):
    def usable(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    good = [(i, np.array(v, dtype=float), label) for i, v, label in rows if usable(i, v, label)]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            (i, v, p), (j, w, q) = good[a], good[b]
            if p == q and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((str(i), links[i], str(root(i)), i is None or root(i) == i) for i, _, _ in rows)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for group in range(40):
        centre = rng.normal(size=32)
        for _ in range(6):
            near = centre + rng.normal(size=32) * (0.1 if group % 2 else 0.9)
            rows.append((n, [float(x) for x in near.astype("f4")], group % 3))
            n += 1
    rows += [(n + i, list(rows[i][1]), rows[i][2]) for i in range(20)]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as id", "'y' as code", "1 as copies")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in itq_dedup.near_duplicate_vectors(df).collect())
    assert got == brute_vectors(rows, 0.93)
    assert itq_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_codes_are_balanced():
    rng = np.random.default_rng(5)
    x = itq_dedup.unit(rng.normal(size=(4000, 64)))
    mean, rate = itq_dedup.centre(x, 0.93)
    assert rate == pytest.approx(np.arccos(0.93) / np.pi, abs=0.005)
    code = itq_dedup.codes(x, mean, [itq_dedup.fit_rotation(x, mean, 1)])[:, 0]
    shares = [((code >> b) & 1).mean() for b in range(itq_dedup.CODE_BITS)]
    assert 0.4 < min(shares) and max(shares) < 0.6


@pytest.mark.parametrize("common", [0.0, 1.0])
def test_recall_at_the_threshold(spark, common):
    """Ids divisible by 50 against all rows by brute force; vectors share a common direction more or less."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 64)) / 8 + common * np.eye(64)[0]
    x = itq_dedup.unit(base)
    turned = rng.normal(size=x.shape)
    turned -= (turned * x).sum(axis=1, keepdims=True) * x
    cosine = rng.uniform(0.93, 0.95, len(x))[:, None]
    rows = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * itq_dedup.unit(turned)])
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(rows)], "id long, vector array<double>, grp int")
    got = {(r.a, r.b) for r in itq_dedup.near_pairs(df, 0.93).collect()}
    unit = itq_dedup.unit(rows)
    near = unit @ unit.T >= 0.93
    wanted = {(min(i, j), max(i, j)) for i in range(0, len(rows), 20) for j in np.flatnonzero(near[i]).tolist() if i != j}
    assert len(wanted) >= 30 and len(wanted & got) >= 0.97 * len(wanted)
    assert all(near[i, j] for i, j in got)


def test_pipeline_equals_its_stages_done_plainly(spark, sf_dir):
    """Each stage's decisions are redone on its input: scores one by one, near copies by brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf_dir).collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = nbsvm_quality.fit(docs, labels, "quality", "doc_id", "text", 5, 0)
    known = nbsvm_quality._Words()
    assert sorted(kept) == sorted(r.doc_id for r in docs.collect() if model.score(nbsvm_quality.features(r.text, known)) >= 0.3)

    from tests.llm.test_documents import brute_classes

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    single = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(int(i) for i, *_, keep in brute_classes(rows, 5, 80) if keep)

    out = corpus_pipeline.run(spark, sf_dir).collect()
    coder = prefix_bpe.PrefixCoder(prefix_bpe.read_vocabulary(piece_model()))
    text = dict(rows)
    assert out and all(r.ids == ",".join(map(str, coder.encode(text[r.doc_id]))) for r in out[:40])
    assert temperature_mix.mix(single).select(columns).columns == columns


def test_pipeline_stages_take_odd_tables(spark, documents, sf_dir):
    odd = documents.withColumns({c: F.lit(7) for c in ("mix_order", "score", "predicted", "held_out", "worst", "__judged", "k", "t", "id")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            got = stage(spark, df, sf_dir)
            rows = got.collect()
            if name != "sentencepiece":
                assert got.columns == df.columns and all(r.score == 7 and r.mix_order == 7 for r in rows)
            if name in ("quality", "toxicity", "sentencepiece"):
                assert len(rows) <= df.count()


def test_repeated_rows_leave_one(spark, documents):
    got = corpus_pipeline.one_of_each(spark, documents, "").collect()
    ids = [r.doc_id for r in got]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11] and ids.count(None) == 1


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert minhash_hamming.DISTANCE == 19 and len(corpus_pipeline.STAGES) == 5
