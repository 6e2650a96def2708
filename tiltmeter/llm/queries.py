"""The queries of the corpus operators, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm import itq_dedup, label_sharding, license_scan, merkle_manifest, minhash_hamming, nbsvm_quality, order_minhash, prefix_bpe, spelling_variants, temperature_mix, toxic_segments, url_filter, warc_salvage
from tiltmeter.llm.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Place of the public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = label_sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = nbsvm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = temperature_mix.mix(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "mix_tokens", "mix_pass", "mix_block", "mix_order", "mix_weight")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxic_segments.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", "n_passages", "worst")


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc_salvage.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc_salvage.read_archives(spark, path).where("kind = 'record'")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    whole = F.col("warc_type") == "response"
    return read.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, warc_salvage.base32_of_hex(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), lose=199)


#: Rules of the URL filter.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in URL_RULES])))
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = merkle_manifest.leaf_hash(*[text if c == "text" else F.col(c) for c in merkle_manifest.FIELDS])
    found = merkle_manifest.manifest(docs.select(*merkle_manifest.FIELDS, shown.alias("shown")), carry="shown")
    folded = found.withColumn("folded_root", merkle_manifest.fold(F.col("carried"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof_text(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_itq_near_dedup, op3_label_sharding, op4_nbsvm_quality, op5_license_scan, op6_temperature_mix, op7_minhash_near_dedup, op8_sentencepiece, op9_toxic_segments, op10_warc_salvage, op11_spelling_variants, op12_url_filter, op13_merkle_manifest)}


#: Base 32 of SHA-1, five hex digits at a time, and the first page of each payload.
OP10_SQL = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, strlen(h)::BIGINT as n, sha1(h) as s from p),
f as (select s, min(page_id) as m from d group by s)
select page_id, n as payload_bytes, translate((select string_agg(lpad(to_base(('0x'||substr(s, 1+5*i, 5))::BIGINT, 32), 4, '0'), '' order by i) from range(8) t(i)),
 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
 case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to from d join f using (s)"""

#: All pairs of a label, then the least id that links reach.
OP2_SQL = """with recursive v as (select vec_id, embedding::DOUBLE[] as e, label from embeddings where label is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
 where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
r as (select vec_id as id, vec_id as top from embeddings union select l.b, r.top from r join l on l.a = r.id)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, (select min(top) from r where r.id = vec_id) as component_id,
 vec_id = (select min(top) from r where r.id = vec_id) as kept from embeddings"""

#: Shingles as four words joined by spaces; texts of fewer words are one shingle.
OP7_SQL = r"""with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)::BIGINT), lambda i: array_to_string(w[i:i+3], ' '))) as g, len(w) as n from t),
c as (select doc_id, case when n = 0 then 0 else len(g) end::BIGINT as n_shingles, g, n from s), x as (select doc_id, n_shingles, unnest(g) as k from c where n > 0),
p as (select a.doc_id as a, b.doc_id as b, a.n_shingles as na, b.n_shingles as nb, count(*) as k2 from x a join x b on a.k = b.k and a.doc_id <> b.doc_id group by all),
l as (select a, b from p where 100 * k2 >= 80 * (na + nb - k2)),
r as (select doc_id as id, doc_id as top from c union select l.b, r.top from r join l on l.a = r.id), m as (select id, min(top) as top from r group by id)
select doc_id, n_shingles, top as component_id, doc_id = top as kept from c join m on m.id = doc_id"""


#: crc32 of the bytes of x, from the table of its polynomial.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda j: j::BIGINT)),
 lambda c, j: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"""
CRC = lambda x, at: f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({x})), lambda j: ('0x'||substr(hex(encode({x})), 2*j+1, 2))::BIGINT)), lambda c, b: xor(({at})[(xor(c, b) & 255) + 1], c >> 8)))"

#: Each source's nodes as one list, level by level; then the list of the sources' roots; proofs and folds along the way.
OP13_SQL = f"""with recursive k as (select {CRC_TABLE} as tab),
d as (select row_number() over (order by source nulls first, doc_id nulls first) as r, doc_id, source, text, lang, n_chars, case when doc_id is not null and ({CRC('doc_id::VARCHAR', 'tab')}) & 1 = 0 then replace(text, chr(10), '') else text end as shown from documents, k),
l as (select r, doc_id, source, {{leaf}} as leaf, {{changed}} as changed from d),
p as (select *, row_number() over (partition by source order by r) - 1 as i from l),
t as (select source, 0 as level, list(leaf order by i) as nodes from p group by source
 union all select source, level + 1, list_transform(range(((len(nodes) + 2) // 3)::BIGINT), lambda j: sha256(array_to_string(nodes[3*j+1:3*j+3], ''))) from t where len(nodes) > 1),
s as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as i, level as high from t where len(nodes) = 1),
u as (select 0 as level, list(subroot order by i) as nodes from s
 union all select level + 1, list_transform(range(((len(nodes) + 2) // 3)::BIGINT), lambda j: sha256(array_to_string(nodes[3*j+1:3*j+3], ''))) from u where len(nodes) > 1),
f as (select r, leaf, changed as at, '' as proof, p.source, p.i, 0 as level, s.high, s.i as si, 0 as up from p join s on s.source is not distinct from p.source
 union all select f.r, f.leaf, case when f.level < f.high or len(u.nodes) > 1 then sha256({{around}}) else f.at end, f.proof||{{beside}}, f.source, case when f.level < f.high then f.i // 3 else case when f.level = f.high then f.si else f.i end // 3 end,
  f.level + 1, f.high, f.si, case when f.level < f.high then 0 else f.up + 1 end
  from f left join t on f.level < f.high and t.level = f.level and t.source is not distinct from f.source left join u on f.level >= f.high and u.level = f.up
  where f.level < f.high or len(u.nodes) > 1)
select p.doc_id, p.leaf, s.subroot, root, sha256(f.proof) as proof_sha256, f.at as folded_root, f.at = root as verified
 from p join s on s.source is not distinct from p.source join (select nodes[1] as root from u where len(nodes) = 1) on true
 join (select *, row_number() over (partition by r order by level desc) as last from f) f on f.r = p.r and f.last = 1"""
#: Letters beyond ASCII are put on single bytes before edits are counted.
OP11_SQL = f"""with recursive k as (select {CRC_TABLE} as tab), o as (select coalesce(doc_id::VARCHAR, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
c as (select id||':'||run as x, run, count(*) as m from o group by all), h as (select run, m, {CRC('x', 'tab')} as h from c, k),
w as (select case when h % 199 = 0 then substr(run, 1, h % length(run))||substr(run, h % length(run) + 2) else run end as word, sum(m)::BIGINT as n from h group by 1),
v as (select word, n, length(word) as size, translate(word, (select string_agg(chr(192 + i::INT), '' order by i) from range(64) t(i)), (select string_agg(chr(33 + i::INT), '' order by i) from range(64) t(i))) as s from w where length(word) >= 6 and n >= 5),
e as (select a.word, a.n, b.word as other, b.n as m from v a join v b on b.size between a.size - 1 and a.size + 1 and a.word <> b.word and levenshtein(a.s, b.s) = 1),
b as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from e group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 5 * v.n then other end as form, case when m >= 5 * v.n then m end as form_n from v left join b using (word)),
r as (select word, word as root, 0 as hops from f union all select r.word, f.form, hops + 1 from r join f on f.word = r.root where f.form is not null),
last as (select word, arg_max(root, hops) as root from r group by word)
select word, form, root, n, n_near, form_n from f join last using (word)"""

_SIZED = lambda c: f"coalesce(strlen({c}::VARCHAR)||':'||{c}::VARCHAR, '-')"
_NODES = "(case when f.level < f.high then t.nodes else u.nodes end)"
_AT = "(case when f.level = f.high then f.si else f.i end)"
OP13_SQL = OP13_SQL.format(
    leaf="sha256(" + "||".join(map(_SIZED, ("doc_id", "source", "lang", "n_chars", "text"))) + ")",
    changed="sha256(" + "||".join(map(_SIZED, ("doc_id", "source", "lang", "n_chars", "shown"))) + ")",
    around=f"array_to_string({_NODES}[{_AT} // 3 * 3 + 1:{_AT}], '')||f.at||array_to_string({_NODES}[{_AT} + 2:{_AT} // 3 * 3 + 3], '')",
    beside=f"array_to_string({_NODES}[{_AT} // 3 * 3 + 1:{_AT}], '')||array_to_string({_NODES}[{_AT} + 2:{_AT} // 3 * 3 + 3], '')",
)


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": OP11_SQL, "op13_merkle_manifest": OP13_SQL, "op2_itq_near_dedup": OP2_SQL, "op7_minhash_near_dedup": OP7_SQL, "op10_warc_salvage": OP10_SQL}
