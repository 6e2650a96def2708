"""Texts hashed side by side have the digests of hashlib; the queries by item draw all resamples with them."""

import hashlib

import numpy as np
import pytest

from tiltmeter.functions import hashes
from tiltmeter.operators import inference as I
from tiltmeter.queries import ORACLE, QUERIES


@pytest.mark.parametrize("length", [0, 1, 55, 56, 63, 64, 119, 120, 200])
def test_digests(length):
    texts = [bytes(r) for r in np.random.default_rng(length).integers(0, 256, (40, length), dtype=np.uint8)]
    frames = np.frombuffer(b"".join(map(hashes.framed, texts)), dtype=np.uint8).reshape(len(texts), hashes.size(length))
    assert [bytes(d) for d in hashes.md5(frames)] == [hashlib.md5(t).digest() for t in texts]


def test_places_equal_a_loop():
    k, head, wanted = 1_234, "7|s|é", {}
    for r in range(8, 12):
        wanted[r] = sorted(int(int(hashlib.md5(f"{head}|{r}|{slot}".encode()).hexdigest()[:13], 16) / 2**52 * k) for slot in range(k))
    got = {r: [] for r in wanted}
    for rs, places in I._places(head, range(8, 12), k):
        for r, place in zip(rs, places, strict=True):
            got[int(r)].append(int(place))
    assert {r: sorted(p) for r, p in got.items()} == wanted


def test_flips_equal_a_loop():
    texts, d = [f"s|{'x' * (i % 60)}{i}".encode() for i in range(40)], np.arange(40) % 5 - 2
    total = I._flips(texts, d, np.array([0, 25]), 12)
    for g, span in enumerate((range(25), range(25, 40))):
        for block in (0, 9, 11):
            bits = [int(hashlib.md5(texts[i] + f"|{block}".encode()).hexdigest()[:12], 16) for i in span]
            assert list(total[g, block]) == [sum((1 - 2 * (b >> pos & 1)) * d[i] for i, b in zip(span, bits, strict=True)) for pos in range(I.BITS)]


def rows(spark, sf_dir, name):
    return {(r.judge_id, r.axis): r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name, ends", [("bootstrap_h_ci", ("ci_lo", "ci_hi")), ("noise_gate", ("noise_lo", "noise_hi"))])
def test_intervals_by_item_are_as_fine_as_all_resamples(spark, sf_dir, name, ends):
    """Ends of 40 draws lie up to half a deviation off."""
    item, counted = rows(spark, sf_dir, f"{name}_by_item"), rows(spark, sf_dir, name)
    for key, r in counted.items():
        for end in ends:
            assert abs(item[key][end] - r[end]) < 0.05 * (r[ends[1]] - r[ends[0]])
    assert "range(40)" not in ORACLE[f"{name}_by_item"]


def test_verdicts_by_item_come_from_all_signs(spark, sf_dir):
    found = rows(spark, sf_dir, "holm_verdicts_by_item")
    assert found["hash-biased", "verbose_cot"].p == pytest.approx(1 / (I.RESAMPLES + 1), abs=1e-9)
    assert all(r.p * (I.RESAMPLES + 1) == pytest.approx(round(r.p * (I.RESAMPLES + 1)), abs=1e-3) for r in found.values())
    assert "range(40)" not in ORACLE["holm_verdicts_by_item"] and "/193" not in ORACLE["holm_verdicts_by_item"]
