import gzip
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tiltmeter.llm import license_scan, prefix_bpe, warc_salvage

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixCoder(prefix_bpe.read_vocabulary(MODEL))


def strange_texts(n):
    rng = random.Random(5)
    parts = ["the", "tion", " ", "  ", "\n", "\t", "▁", "é", "中", "😀", "...", "$$$", "a", "aa", "1", "==", "<s>", "　", "x" * 9, "ing.", "!"]
    for _ in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
    yield from ("", " ", " " * 37, "▁▁", "a" * 5000, "\x00", "﻿z", "ab " * 3000)


def test_coder_equals_the_library(library, coder):
    for text in strange_texts(3000):
        ids = library.encode(text)
        assert coder.encode(text) == ids, text
        assert coder.encode_decode(text)[2] == library.decode(ids) == coder.decode(ids), text


def test_only_altered_texts_are_kept_beside_their_ids(library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "CACHE_CHUNKS", 3)
    coder = prefix_bpe.PrefixCoder(prefix_bpe.read_vocabulary(MODEL))
    for text in ("one two  three", "four five six seven", "\u00e9\u2603 \U0001f600 x\u2581y", "  a\n b "):
        ids = library.encode(text)
        assert coder.encode_decode(text) == (",".join(map(str, ids)), len(ids), library.decode(ids))
    assert not coder.odd and not coder.altered
    for _ in range(2):  # half a pair of surrogates has no UTF-8, so it is written as a question mark
        for k in range(6):
            assert coder.encode_decode(f"z{k} q\ud800r{k} one")[2] == f"z{k} q?r{k} one"
    assert coder.encode_decode("one two")[2] == "one two" and coder.altered and len(coder.odd) <= 4


def test_words_of_a_batch_are_encoded_side_by_side(library, monkeypatch):
    rng = random.Random(8)
    syllables = ["tion", "the", "er", "ü", "é", "ing", "sch", "aa", "0", "中", ".\n", "$$$", "X", "☃"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 4000, 40)] + [None, "", *strange_texts(500)]
    want = [(",".join(map(str, ids)), len(ids), library.decode(ids) if ids else "") for ids in (library.encode(t or "") for t in texts)]
    monkeypatch.setattr(prefix_bpe, "OUT_CHARS", 3000)
    for chunks, pairs in ((60_000, 500_000), (50, 300)):  # the second forgets all the time
        monkeypatch.setattr(prefix_bpe, "CACHE_CHUNKS", chunks)
        monkeypatch.setattr(prefix_bpe, "CACHE_PAIRS", pairs)
        coder = prefix_bpe.PrefixCoder(prefix_bpe.read_vocabulary(MODEL))
        parts = list(prefix_bpe._in_parts(texts))
        assert [t for part in parts for t in part] == texts and len(parts) > 10
        assert [got for part in parts[:8] for got in coder.encode_decode_all(part)] == want[: sum(map(len, parts[:8]))]
        assert not coder.rows  # no row of a table was made for one word alone
        assert [got for part in parts for got in coder.encode_decode_all(part)] == want
    assert coder.encode_decode_all(["q\ud800r one", "one two"]) == [coder.encode_decode("q\ud800r one"), coder.encode_decode("one two")]
    assert coder.altered and coder.encode_decode("q\ud800r one")[2] == "q?r one"


def test_encode_documents(spark, documents, library):
    got = prefix_bpe.encode_documents(documents, MODEL).select("text", "ids", "n_tokens", "decoded", "score").collect()
    assert len(got) == documents.count()
    for r in got:
        ids = library.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.decoded, r.score) == (",".join(map(str, ids)), len(ids), library.decode(ids) if ids else "", "extra")
    assert prefix_bpe.encode_documents(documents.limit(0), MODEL).count() == 0


def brute_places(words, template, k=license_scan.SHINGLE, least=license_scan.CONTAINMENT):
    """Copies of a template from left to right, on tuples of words of the whole text."""
    runs = lambda w: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    text, wanted = runs(words), Counter(runs(template))
    out, i, span = [], 0, sum(wanted.values()) * 5 // 4 + 1
    while i < len(text):
        seen, last, j = Counter(), i, i
        while text[i] in wanted and j < min(len(text), i + span):
            if text[j] in wanted:
                if seen[text[j]] == wanted[text[j]]:
                    break
                seen[text[j]] += 1
                last = j
            j += 1
        if len(seen) >= least * len(wanted):
            out.append((round(len(seen) / len(wanted), 9), i))
            i = last
        i += 1
    return out


def brute_hits(text):
    words = license_scan.words_of(text)
    return sorted(
        (name, share, at)
        for name, template in license_scan.TEMPLATES.items()
        for share, at in brute_places(words, license_scan.words_of(template))
    )


def test_license_scan_equals_brute_force(spark, documents, prose, sf_dir):
    texts = license_scan.TEMPLATES
    planted = [(100 + i, f"{prose(40, i)} {t} {prose(40, i + 50)}") for i, t in enumerate(texts.values())]
    part = " ".join(texts["mit-grant"].split()[:-2])
    half = " ".join(texts["mit-grant"].split()[:12])
    copies = [" ".join([texts[t], *gap] * 3) for t in ("mit-grant", "gpl-later", "bsd-redistribution", "bsd-3-full") for gap in ([], ["x"], ["x", "y", "z"])]
    planted += [(300 + i, f"{prose(i, i)} {t} {prose(20, i)}") for i, t in enumerate(copies)]
    planted += [(200, f"{prose(700, 9)} {part} {prose(700, 8)}"), (201, half), (202, texts["mit"] + " " + prose(30, 7) + " " + texts["mit"])]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    df = df.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    got = {}
    for r in license_scan.scan_licenses(df.withColumn("license", F.lit("x"))).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.containment, r.first_word))
    wanted = {r.doc_id: h for r in df.collect() if (h := brute_hits(r.text))}
    assert {i: sorted(hits) for i, hits in got.items()} == wanted
    assert 200 in got and 201 not in got
    assert license_scan.scan_licenses(df.where("doc_id = 202")).count() == 2
    table = spark.createDataFrame([("one", texts["mit"]), ("none", None)], "license string, text string")
    assert {r.license for r in license_scan.scan_licenses(df.where("doc_id = 202"), table).collect()} == {"one"}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [2_000_000, -1])
def test_archives_round_trip(spark, tmp_path, bound):
    rows = [(1, "http://a b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nodd\r\n\r\n"), (6, "u", "é" * 3000), (None, "u", "é" * 3000), (7, "u", "own"), (7, "u", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("sha", F.lit("y"))
    warc_salvage.write_archives(df, f"file://{tmp_path}/w", revisit_bytes=bound)
    got = warc_salvage.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    by = sorted((r.record_id, r.warc_type, r.refers_to or "") for r in got)
    urn = "<urn:page:{}>".format
    assert by == sorted([
        (urn(1), "response", ""), (urn(2), "revisit", urn(1)), (urn(3), "response", ""), (urn(4), "revisit", urn(3)), (urn(5), "response", ""),
        (urn(6), "response", ""), (urn(""), "revisit", urn(6)), (urn(7), "response", ""), (urn(7), "response", ""),
    ])
    payload = {r.record_id: bytes(r.payload) for r in got if r.warc_type == "response"}
    assert payload[urn(5)] == rows[4][2].encode() and payload[urn(6)] == ("é" * 3000).encode() and payload[urn(3)] == b""
    warc_salvage.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc_salvage.read_archives(spark, f"file://{tmp_path}/none").where("kind = 'record'").count() == 0


def record(i, body=b"hello"):
    digest = warc_salvage.base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_salvage_recovers_what_follows_damage():
    a, b, c = record(1), record(2, b"x" * 50), record(3)
    damaged = a + b.replace(b"x" * 10, b"y" * 10) + c
    found = list(warc_salvage.salvage(damaged))
    assert [(r["kind"], r["start"], r["length"]) for r in found] == [("record", 0, len(a)), ("gap", len(a), len(b)), ("record", len(a) + len(b), len(c))]
    assert found[1]["note"] == "block digest differs"
    short = a + b[: len(b) // 2] + c
    assert [r.get("record_id") for r in warc_salvage.salvage(short)] == ["<urn:page:1>", None, "<urn:page:3>"]
    assert [r["kind"] for r in warc_salvage.salvage(b"junk" + a + b"junk")] == ["gap", "record", "gap"]
    assert list(warc_salvage.salvage(b"")) == []


def test_salvage_of_gzip_members():
    a, b, c = (gzip.compress(record(i, bytes([65 + i]) * 400)) for i in (1, 2, 3))
    broken = bytearray(b)
    broken[len(b) // 2] ^= 255
    found = list(warc_salvage.salvage(a + bytes(broken) + c))
    assert [r["kind"] for r in found] == ["record", "gap", "record"]
    assert sum(r["length"] for r in found) == len(a) + len(b) + len(c)
    assert [r["kind"] for r in warc_salvage.salvage(a + c[:-5])] == ["record", "gap"]


def test_base32(spark):
    want = warc_salvage.base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert spark.range(1).select(warc_salvage.base32_of_hex(F.sha1(F.lit("abc").cast("binary")))).first()[0] == want


def test_long_urls_many_members_and_the_shuffled_path(spark, tmp_path):
    rows = [(i, "http://a/" + "x" * (100_000 if i == 3 else i), "<p>" * (200_000 if i == 5 else i % 7)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = []
    for name, limit in (("sent", 10**9), ("moved", -1)):
        path = f"{tmp_path}/{name}"
        warc_salvage.write_archives(pages, path, revisit_bytes=limit)
        got = warc_salvage.read_archives(spark, path).collect()
        assert {r.kind for r in got} == {"record"}
        read.append(sorted((r.record_id, r.target_uri, r.warc_type, r.refers_to or "", bytes(r.payload)) for r in got))
    assert read[0] == read[1] and len(read[0]) == 60
    whole = {r[0]: r[4] for r in read[0] if r[2] == "response"}
    assert all(whole[r[3] or r[0]].decode() == rows[int(r[0][10:-1])][2] for r in read[0])
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "sent").glob("part-*")))
    plain = [r for r in warc_salvage.salvage(data) if r["kind"] == "record"]
    one = data[: plain[0]["length"]]
    members = b"".join(gzip.compress(one) for _ in range(1000))
    assert [r["kind"] for r in warc_salvage.salvage(members)] == ["record"] * 1000
    big = gzip.compress(data)  # one member of many records, its end cut off, then a sound one
    got = list(warc_salvage.salvage(big[:-9] + gzip.compress(one)))
    assert [r["kind"] for r in got] == ["gap", "record"]
    held, warc_salvage.HELD_BYTES = warc_salvage.HELD_BYTES, 1000
    try:
        assert [r["payload"] for r in warc_salvage.salvage(big)] == [r["payload"] for r in plain]
    finally:
        warc_salvage.HELD_BYTES = held
