"""Spelling variants, URL filters and Merkle manifests against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiltmeter.llm import merkle_manifest, spelling_variants, url_filter

# ---- spelling variants -----------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, lose):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if lose and h % lose == 0 else run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 6 and k >= 5}
    by = {w: [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(w, x)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return out


def words_near_each_other(rng, bases):
    """Words of few letters, with every kind of edit at every place, so that cells are crowded."""
    out = set()
    for _ in range(bases):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 9)))
        at = rng.randrange(len(word) + 1)
        out |= {word, word[:at] + rng.choice("abéz") + word[at:], word[:at] + rng.choice("aéz") + word[at + 1 :], word[:at] + word[at + 1 :]}
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("block", [4000, 7])
def test_near_pairs_are_all_and_once(spark, monkeypatch, block):
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    monkeypatch.setattr(spelling_variants, "SHARD_ROWS", 900)
    words = words_near_each_other(random.Random(block), 120)
    got = [(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in spelling_variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    wanted = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 2 and near(a, b)}
    assert len(wanted) > 300 and len(got) == len(set(got)) and set(got) == wanted


def test_a_rare_gram_at_two_places_in_a_row_gives_a_pair_once(spark):
    words = [f"{a}mnqqrs{b}" for a in "abcdefgh" for b in "tuvwx"] + ["amnqqqqrst", "aumnqqqqrst"]
    found = spelling_variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    got = sorted(tuple(sorted(r)) for r in found)
    assert got == sorted((a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and near(a, b))


def test_variants_equal_brute_force(spark, documents):
    rng = random.Random(5)
    words = words_near_each_other(rng, 40)
    rows = [(i, " ".join(rng.choices(words, weights=[1 + 40 * (j % 9 == 0) for j in range(len(words))], k=150)) + ". 7Éa-ÉABÇDEF×x") for i in range(40)]
    rows += [(r.doc_id, r.text) for r in documents.collect()] + [(None, "abcdefg " * 9), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "'y' as form", "2 as cell")
    for lose in (199, 7, None):
        got = [tuple(r) for r in spelling_variants.variants(docs, lose=lose).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_variants(rows, lose)
        assert sum(r[1] is not None for r in got) > 5
    assert spelling_variants.variants(docs.where("false"), lose=199).count() == 0


def test_roots_follow_chains(spark):
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e"), ("y", "x")]
    got = dict(tuple(r) for r in spelling_variants.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "e" for w, _ in chain}


# ---- URL filters -----------------------------------------------------------------------------------------------------

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("bare.org", "block")]
URLS = [
    "http://a.example.com/en/1?x=/fr/", "https://WWW.Example.COM/en/2", "http://b.www.example.com/en/3#t", "http://example.com/fr/", "http://com/", "http://notcom/en",
    "http://xexample.com/en/1", "http://m.example.net/es/9", "http://example.net/en/9", "http://m.example.net/fr", "ftp://u:p@host.org:80/de/a", "http://bare.org", "http://x.bare.org/any",
    "no scheme/at/all", "", None, "http://", "http://é.com/ü", "x://y.com?q", "http://a.com/\nb#c", "http://a.com:80/en/", "http://d.example.org/es/4",
]


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def brute_rule(host, path, rules):
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


def rule_frame(spark, rules=RULES):
    return spark.createDataFrame(rules, "rule string, verdict string")


@pytest.mark.parametrize("bytes_", [64_000, 0])
def test_rules_equal_brute_force(spark, monkeypatch, bytes_):
    """Looked up within the row and joined: the same rows."""
    monkeypatch.setattr(url_filter, "RULE_BYTES", bytes_)
    monkeypatch.setattr(url_filter, "STEPS", 1)
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string").selectExpr("*", "'c' as host", "3 as bucket", "'l' as label")
    got = {r.page_id: r for r in url_filter.judge(urls, rule_frame(spark)).collect()}
    assert len(got) == len(URLS) + 3
    for i, url in enumerate(URLS + URLS[:3]):
        rule, verdict = brute_rule(*brute_parts(url), RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (*brute_parts(url), rule), url
        assert got[i].verdict == verdict or (rule is None and got[i].verdict in ("allow", "block")) and got[i].bucket == 3


def plain_fit(rows, steps):
    """The same descent with dicts."""
    buckets = sorted({b for f, _ in rows for b in f})
    total = Counter(label for _, label in rows)
    w = {b: 0.0 for b in [*buckets, -1]}
    at = dict(w)
    for step in range(steps):
        slope = Counter()
        for f, label in rows:
            z = at[-1] + sum(at[b] for b in f) / math.sqrt(max(1, len(f)))
            g = (1 / (1 + math.exp(-z)) - label) * 0.5 / total[label]
            slope[-1] += g
            for b in f:
                slope[b] += g / math.sqrt(max(1, len(f)))
        moved = {b: a - 2.0 * (slope[b] + (url_filter.SHRINK * a if b >= 0 else 0.0)) for b, a in at.items()}
        at = {b: m + step / (step + 3) * (m - w[b]) for b, m in moved.items()}
        w = moved
    return w


def labelled_urls(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeklmnorst") for _ in range(rng.randrange(4, 9)))
    return [
        (f"{word()}.{rng.choice(['win', 'bet'])}{word()}.com" if spam else f"{word()}.edu", f"/{word()}/{rng.choice(['casino', 'slots'])}" if spam and i % 3 else f"/{word()}/paper", spam)
        for i in range(n) for spam in (0, 1)
    ]


def test_model_equals_plain_descent_and_generalises(spark):
    rows = labelled_urls(60, 1)
    frame = spark.createDataFrame(rows, "host string, path string, label int")
    got = url_filter.fit(frame, steps=25)
    found = [(r.f, r.label) for r in url_filter.training_table(frame).select(url_filter.features(F.col("host"), F.col("path")).alias("f"), "label").collect()]
    assert len(found) > 110
    wanted = plain_fit(found, 25)
    assert max(abs(got[b if b >= 0 else url_filter.BUCKETS] - v) for b, v in wanted.items()) < 1e-6
    other = spark.createDataFrame(labelled_urls(200, 2), "host string, path string, label int")
    score = url_filter._logit(url_filter.features(F.col("host"), F.col("path")), got) > 0
    assert other.where(score == (F.col("label") == 1)).count() >= 0.95 * 400


def test_url_features_and_training_sample(spark):
    rows = [("abc", "/d"), ("", ""), ("a", "/"), ("aaaaaaa", "")]
    frame = spark.createDataFrame(rows, "host string, path string")
    got = [set(r[0]) for r in frame.select(url_filter.features(F.col("host"), F.col("path"))).collect()]
    grams = lambda t, k: {(k, f"^{t}$"[i : i + n]) for n in url_filter.NGRAMS for i in range(len(t) + 3 - n)}
    flat = sorted({g for h, p in rows for g in grams(h, "h") | grams(p, "p")})
    bucket = {(r.k, r.g): r.b for r in spark.createDataFrame(flat, "k string, g string").select("k", "g", F.pmod(F.xxhash64("k", "g"), F.lit(url_filter.BUCKETS)).alias("b")).collect()}
    assert got == [{bucket[g] for g in grams(h, "h") | grams(p, "p")} for h, p in rows]
    many = spark.range(5000).selectExpr("concat('h', id % 1700) as host", "'/' as path", "cast(id % 2 as int) as label")
    sample = [tuple(r) for r in url_filter.training_table(many, 100).collect()]
    assert len(sample) == len(set(sample)) and 150 < len(sample) <= 200


def test_url_filter_takes_odd_tables(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    judged = url_filter.judge(urls, rule_frame(spark, [("nothing.net/", "block")])).collect()
    assert [(r.verdict, r.score) for r in judged] == [("allow", 0.5)] * 2  # no labelled rows of both kinds
    assert url_filter.judge(urls.where("false"), rule_frame(spark)).count() == 0
    table = spark.createDataFrame([("http://bad.org/x", 1), ("http://good.com/y", 0), (None, None)], "url string, label int")
    got = {r.url: r.verdict for r in url_filter.judge(urls, rule_frame(spark, [("nothing.net/", "block")]), table).collect()}
    assert got["http://a.org/x"] == "block"


# ---- Merkle manifests ------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(levels, at, arity):
    for nodes in levels[:-1]:
        run = at // arity * arity
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])
        at //= arity


def plain_manifest(rows, arity):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, levels_of([plain_leaf(r) for r in own], arity)))
    top = levels_of([levels[-1][0] for _, levels in trees], arity)
    out = []
    for i, (own, levels) in enumerate(trees):
        for j, r in enumerate(own):
            steps = [*siblings(levels, j, arity), *siblings(top, i, arity)]
            out.append((r[0], r[1], plain_leaf(r), levels[-1][0], top[-1][0], tuple(steps)))
    return out


@pytest.mark.parametrize(("arity", "part", "fan", "tasks"), [(3, 20_000, 32, 4), (3, 4, 2, 3), (2, 3, 3, 7), (5, 1, 2, 2)])
def test_manifest_equals_brute_force(spark, documents, monkeypatch, arity, part, fan, tasks):
    monkeypatch.setattr(merkle_manifest, "PART_LEAVES", part)
    monkeypatch.setattr(merkle_manifest, "FAN", fan)
    rng = random.Random(arity * part)
    rows = [tuple(r[c] for c in merkle_manifest.FIELDS) for r in documents.collect()]
    rows += [(2**60 + rng.randrange(40), rng.choice([None, "", "a", "b", "é", "z" * 9]), None, None, f"t\n{i % 7}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' as leaf", "1 as part", "2 as at", "'c' as tree")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        found = merkle_manifest.manifest(docs, arity, carry="text").select("*", merkle_manifest.verified(F.col("leaf"), F.col("steps"), F.col("root")).alias("ok")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    key = lambda r: repr(r)
    got = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in found), key=key)
    assert got == sorted(plain_manifest(rows, arity), key=key)
    assert all(r.ok for r in found) and Counter(r.carried for r in found) == Counter(r[4] for r in rows)


def test_manifest_of_few_rows(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle_manifest.manifest(spark.createDataFrame([], shape)).count() == 0
    one = merkle_manifest.manifest(spark.createDataFrame([(None, None, None, None, None)], shape)).first()
    assert one.leaf == one.subroot == one.root == sha("-----") and one.steps == []
    three = merkle_manifest.manifest(spark.createDataFrame([(7, "s", "en", 1, "x")] * 3, shape)).collect()
    assert len(three) == 3 and {r.root for r in three} == {sha(3 * plain_leaf((7, "s", "en", 1, "x")))}


def test_tampering_is_seen(spark):
    rows = [(i, "s", "en", 3, f"line {i}\nmore") for i in range(20)]
    found = merkle_manifest.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    forged = found.select(merkle_manifest.verified(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("steps"), F.col("root")).alias("ok"))
    assert not any(r.ok for r in forged.collect())
