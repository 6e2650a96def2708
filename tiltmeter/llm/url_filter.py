"""URL filters: rules of hosts and paths, and for the rest a logistic regression on hashed character n-grams.

Only DataFrame functions are used. A URL's features are the buckets of the n-grams of its host and of its path, each with marks
at its ends; their weights are fitted by accelerated gradient descent over a small labelled table, whose gradient is one
aggregation for each step and has no more rows than there are buckets. To score is a projection: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.shared import broadcast_if_small, stored

NGRAMS = (3, 4, 5)
BUCKETS = 8192
#: Labelled URLs of each label that a model is fitted on, at most.
TRAINING_URLS = 2048
STEPS, SHRINK = 40, 1e-4
#: Rules that are looked up within a row, by their bytes; more of them are joined.
RULE_BYTES = 64_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, in lower case (A-Z only); else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ngrams(text: Column, kind: str) -> list[Column]:
    """Buckets of the n-grams of a text between marks, for each n."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        last = F.char_length(marked) - n + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.pmod(F.xxhash64(F.lit(kind), F.substr(marked, at, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return [of(n) for n in NGRAMS]


def features(host_: Column, path_: Column) -> Column:
    """Distinct buckets of a URL."""
    return F.array_distinct(F.flatten(F.array(*_ngrams(host_, "h"), *_ngrams(path_, "p"))))


# ---- rules -----------------------------------------------------------------------------------------------------------


def rules_table(rules: DataFrame) -> DataFrame:
    """Rules ``(rule, verdict)`` with their host and path; a rule is a host, a slash and the beginning of a path; without a slash it is a host."""
    at = F.coalesce(F.nullif(F.instr("rule", "/"), F.lit(0)), F.char_length("rule") + 1)
    split = rules.select(
        "rule", "verdict", F.translate(F.substr("rule", F.lit(1), at - 1), UPPER, LOWER).alias("rule_host"), F.substr("rule", at).alias("rule_path")
    )
    return split.where("rule_host <> ''")


def _suffixes(host_: Column) -> Column:
    """A host and the domains that it lies in."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with ``hit``, a struct of the longest rule that fits and its verdict, or null.

    A rule fits its host and all subdomains if the path starts with its path. Of rules of one length the first in code-point
    order counts. Few rules are looked up within the row; many are first joined with the distinct hosts.
    """
    table = stored(rules_table(rules), "url-rules")
    entry = F.struct((-F.char_length("rule")).alias("short"), "rule", "verdict", "rule_host", "rule_path")
    size = table.agg(F.sum(F.octet_length("rule") + F.octet_length("verdict") + 16)).first()[0] or 0
    first = lambda fits: F.get(F.filter("__rules", fits), F.lit(0))
    if size <= RULE_BYTES:
        listed = [tuple(r) for r in table.select(entry.alias("e")).select("e.rule", "e.verdict", "e.rule_host", "e.rule_path", "e.short").collect()]
        listed.sort(key=lambda r: (r[4], r[0].encode()))
        made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule", "verdict", "rule_host", "rule_path"), r[:4], strict=True)]) for r in listed])
        known = made if listed else F.array().cast("array<struct<rule:string,verdict:string,rule_host:string,rule_path:string>>")
        inside = lambda r: (F.col("host") == r["rule_host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["rule_host"]))
        hit = first(lambda r: inside(r) & F.startswith(F.col("path"), r["rule_path"]))
        return urls.withColumn("__rules", known).withColumn("hit", F.when(hit.isNotNull(), F.struct(hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))).drop("__rules")
    by_host = table.groupBy("rule_host").agg(F.array_sort(F.collect_list(entry)).alias("__own"))
    hosts = urls.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host"))
    found = hosts.join(by_host, "rule_host").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("__own"))).alias("__rules"))
    hit = first(lambda r: F.startswith(F.col("path"), r["rule_path"]))
    joined = urls.join(broadcast_if_small(stored(found, "url-hosts")), "host", "left")
    return joined.withColumn("hit", F.when(hit.isNotNull(), F.struct(hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))).select(*urls.columns, "hit")


# ---- the model -------------------------------------------------------------------------------------------------------


def training_table(labelled: DataFrame, most: int = TRAINING_URLS) -> DataFrame:
    """At most ``most`` distinct ``(host, path)`` of each ``label``, drawn by hash: for each of ``most`` buckets, the least hash."""
    drawn = F.xxhash64("host", "path")
    return (
        labelled.where("label is not null").groupBy("label", F.pmod(drawn, F.lit(most)).alias("bucket"))
        .agg(F.min(F.struct(drawn.alias("h"), "host", "path")).alias("u")).select(F.col("label").cast("int").alias("label"), "u.host", "u.path")
    )


def _weights(values: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{v:.9g}" for v in values) + "]"), "array<double>")


def _logit(found: Column, weights: list[float]) -> Column:
    """The bias, which is the last weight, and the sum of weights over the features, each row of them scaled to length one."""
    w = _weights(weights)
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(w, f))
    return F.get(w, F.lit(BUCKETS)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))


def fit(labelled: DataFrame, steps: int = STEPS, shrink: float = SHRINK, most: int = TRAINING_URLS) -> list[float]:
    """Weights by bucket, the bias last, of ``labelled(host, path, label)``, label 1 against 0; both labels weigh the same.

    Nesterov's gradient descent on the logistic loss, whose curvature is at most a half as features have length one and the
    bias is one more. Without rows of both labels all weights are 0.
    """
    train = stored(training_table(labelled, most).withColumn("f", features(F.col("host"), F.col("path"))), "url-train")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [0.0] * (BUCKETS + 1)
    if set(counts) != {0, 1}:
        return weights
    share = F.when(F.col("label") == 1, F.lit(0.5 / counts[1])).otherwise(F.lit(0.5 / counts[0]))
    at, rate = list(weights), 2.0
    for step in range(steps):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit(F.col("f"), at)))
        away = train.select("f", ((p - F.col("label")) * share).alias("g"), F.sqrt(F.size("f").cast("double")).alias("norm"))
        each = away.select(F.explode(F.array_append("f", F.lit(BUCKETS))).alias("bucket"), "g", "norm")
        pull = F.when(F.col("bucket") == BUCKETS, F.col("g")).otherwise(F.col("g") / F.greatest("norm", F.lit(1.0)))
        slope = {r[0]: r[1] for r in each.groupBy("bucket").agg(F.sum(pull).alias("g")).collect()}
        moved = [a - rate * (slope.get(b, 0.0) + (shrink * a if b < BUCKETS else 0.0)) for b, a in enumerate(at)]
        at = [m + step / (step + 3) * (m - w) for m, w in zip(moved, weights, strict=True)]
        weights = moved
    return weights


def judge(urls: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, score, verdict``: the verdict of the longest rule that fits, else the model's.

    ``labelled(url, label)`` is the small labelled table, label 1 for URLs to block; without it, the URLs that a rule decides
    are the labelled ones, so that the model carries the rules on to hosts and paths that they don't name. ``score`` is the
    model's probability of block, above a half blocked. Null URLs and those without ``://`` have an empty host and path, which
    no rule fits; repeated rows are judged each and alike; an empty table has no rows. Columns of these names are replaced.
    """
    named = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict", "hit")]
    own = {c: f"__u{i}" for i, c in enumerate(named)}
    rows = urls.select(named).withColumnsRenamed(own)
    rows = rows.withColumn("host", host(F.col(own[url]))).withColumn("path", path(F.col(own[url])))
    hit = ruled(rows, rules)
    if labelled is None:
        shown = hit.where("hit is not null").select("host", "path", (F.col("hit.verdict") == "block").cast("int").alias("label"))
    else:
        shown = labelled.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    logit = _logit(F.col("__f"), fit(shown))
    scored = hit.withColumn("__f", features(F.col("host"), F.col("path"))).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    back = [F.col(new).alias(c) for c, new in own.items()]
    return scored.select(*back, "host", "path", F.col("hit.rule").alias("rule"), "score", verdict.alias("verdict"))

