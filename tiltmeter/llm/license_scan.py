"""Licence scans: MinHash bands over overlapping text windows, confirmed by exact containment.

Each template is a set of word shingles. Templates are sorted into sizes by powers of two; for each
size that occurs, a text is read in windows of that many shingles that overlap by three quarters, so
some window holds at least half of what a whole copy of the template shares with it. A window and a
template whose signatures agree in any band of one MinHash value are a candidate; with ``HASHES``
bands, a window with Jaccard similarity 1/3 to a template is missed with a probability of
``(2/3) ** HASHES``, 6 in 100,000. Around candidates, copies are found from left to right: a copy goes on
until a shingle occurs more often than in the template, so the next copy may follow at once; the share of
the template's shingles that it holds is counted exactly.

Templates are given; they are broadcast and their number and size are those of the parameter. Texts
are scanned where they lie.

Defined results: a null or empty text has no hits; a template of fewer words than a shingle is one
shingle; each template is reported once for each place (``places``); copies of different templates may
overlap; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.license_texts import TEMPLATES

SHINGLE, HASHES, CONTAINMENT, WORD_CACHE = 5, 24, 0.8, 400_000
WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20240301)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_SPAN = 512


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return got


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingle_hashes(words: list[str], known: dict[str, int], k: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``k`` words in order (one run for fewer words)."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) + h[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The hash values of shingles under each hash function."""
    values = shingles[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
    values ^= values >> np.uint64(31)
    return values * np.uint64(0xD6E8FEB86659FD93)


class Templates:
    """Signatures of the templates by size, and their shingle sets."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(t for t in templates if words_of(templates[t]))
        known = _Words()
        self.by_size = {}
        self.counts: dict[str, dict[int, int]] = {}  # how often a template holds each of its shingles
        self.lengths: dict[str, int] = {}
        anchors: set[int] = set()
        for name in self.names:
            every = shingle_hashes(words_of(templates[name]), known)
            found, times = np.unique(every, return_counts=True)
            self.counts[name], self.lengths[name] = dict(zip(found.tolist(), times.tolist(), strict=True)), len(every)
            size = 1 << int(np.ceil(np.log2(len(found))))
            under = minima(found)
            signature = under.min(axis=1)
            anchors.update(found[under.argmin(axis=1)].tolist())
            bands = self.by_size.setdefault(size, [{} for _ in range(HASHES)])
            for j, value in enumerate(signature.tolist()):
                bands[j].setdefault(value, set()).add(name)
        self.anchors = np.array(sorted(anchors), dtype=np.uint64)
        self.values = {
            size: [np.array(sorted(b), dtype=np.uint64) for b in bands] for size, bands in self.by_size.items()
        }

    def candidates(self, shingles: np.ndarray) -> set[tuple[str, int, int]]:
        """(template, first, end) of windows of shingles whose signature agrees in a band.

        A band can agree only where a text holds the very shingle that is minimal in the template, so
        signatures are computed around such shingles only.
        """
        out: set[tuple[str, int, int]] = set()
        near = np.searchsorted(self.anchors, shingles)
        spots = np.flatnonzero(self.anchors[np.minimum(near, len(self.anchors) - 1)] == shingles) if len(self.anchors) else []
        longest = max(self.by_size, default=1)
        stop = 0
        for spot in spots:
            if spot < stop:
                continue
            start = max(0, int(spot) - longest) // longest * longest  # windows keep their places in the text
            stop = int(spot) + _SPAN
            self._windows(shingles, start, stop, longest, out)
        return out

    def _windows(self, shingles: np.ndarray, start: int, stop: int, longest: int, out: set) -> None:
        part = minima(shingles[start : stop + longest])
        for size, bands in self.by_size.items():
            step = max(1, size // 4)
            wide = part if step == 1 else np.minimum.reduceat(part, np.arange(0, part.shape[1], step), axis=1)
            width = 1
            while width < size // step:  # minima of twice as many blocks; the last ones hold what is left
                further = np.concatenate([wide[:, width:], np.full((HASHES, min(width, wide.shape[1])), 2**64 - 1, dtype=np.uint64)], axis=1)
                wide, width = np.minimum(wide, further[:, : wide.shape[1]]), 2 * width
            for j, values in enumerate(self.values[size]):
                for w in np.flatnonzero(np.isin(wide[j], values)).tolist():
                    first = start + w * step
                    for name in bands[j][int(wide[j, w])]:
                        out.add((name, first, min(len(shingles), first + size)))

    def hits(self, text: str | None, known: dict[str, int], least: float = CONTAINMENT) -> list[tuple[str, float, int]]:
        """(template, containment, first word) of each confirmed place."""
        shingles = shingle_hashes(words_of(text), known)
        regions: dict[str, list[list[int]]] = {}
        for name, first, end in sorted(self.candidates(shingles)):
            around = reach(self.lengths[name])
            low, high = max(0, first - around), min(len(shingles), end + around)
            found = regions.setdefault(name, [])
            if found and low <= found[-1][1]:
                found[-1][1] = max(found[-1][1], high)
            else:
                found.append([low, high])
        out = []
        for name, found in regions.items():
            for low, high in found:
                out += [(name, share, low + at) for share, at in places(shingles[low:high], self.counts[name], self.lengths[name], least)]
        return sorted(out, key=lambda hit: (hit[0], hit[2]))


def reach(length: int) -> int:
    """How many shingles a copy of a template of ``length`` shingles may extend over."""
    return length + length // 4 + 1


def places(shingles: np.ndarray, counts: dict[int, int], length: int, least: float) -> list[tuple[float, int]]:
    """(containment, start) of the copies of a template, given how often it holds each shingle, left to right.

    A copy starts at a shingle of the template and goes on, over at most ``reach(length)`` shingles, until one
    occurs more often than in the template. What holds less than ``least`` of the distinct shingles is no copy, and
    the next one is tried; after a copy, the search goes on behind its last shingle.
    """
    at = np.flatnonzero(np.isin(shingles, np.fromiter(counts, dtype=np.uint64, count=len(counts))))
    values = shingles[at].tolist()
    out, i = [], 0
    while i < len(at):
        seen: dict[int, int] = {}
        j = i
        while j < len(at) and at[j] < at[i] + reach(length):
            now = seen.get(values[j], 0) + 1
            if now > counts[values[j]]:
                break
            seen[values[j]] = now
            j += 1
        if len(seen) >= least * len(counts):
            out.append((len(seen) / len(counts), int(at[i])))
            i = j
        else:
            i += 1
    return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    least: float = CONTAINMENT,
) -> DataFrame:
    """One row for each place of a template in a text: id, ``license``, ``containment``, ``first_word``.

    ``templates`` are texts by name, or a small table ``(license, text)``.
    """
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.select("license", "text").collect()}
    held = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, known = Templates(held.value), _Words()
        for batch in batches:
            rows = [
                (i, name, round(share, 9), start)
                for i, text in zip(batch["id"], batch["text"], strict=True)
                for name, share, start in found.hits(text, known, least)
            ]
            out = pd.DataFrame(rows, columns=["id", "license", "containment", "first_word"])
            yield out.astype({"id": batch["id"].dtype}) if rows else out.astype({"id": batch["id"].dtype, "containment": float, "first_word": int})

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, f"id {kind}, license string, containment double, first_word long").withColumnRenamed("id", id_col)
