"""SentencePiece encoding and decoding of a merge-type (BPE) model with a prefix table.

Every prefix of a text has one BPE encoding, hence one last token. The table stores that token for
each prefix: an automaton lists the pieces that end at a position, and the one that is compatible
with the last token of the prefix before it is the one. The ids are then read off backwards. Two
adjacent tokens are compatible if undoing their merges in reverse order never meets a pair across
their border that would have been merged earlier. What the next row of the table depends on (the
automaton's state, and the last tokens of the prefixes inside it) is itself a state, whose
successors are remembered, so that rows met before cost one look-up for each character.

The vocabulary is read on the driver and broadcast (its size is that of the model file). Texts are
encoded where they lie, in batches of the scan; nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each; other columns are kept as they are, but those named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, filterfalse
from operator import getitem

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.shared import hand_back_memory, remembered

SPACE = "▁"
NO_RANK = float("inf")
#: Encoded chunks and rows of prefix tables that a Python worker remembers (twice as many chunks, of the last two
#: generations), and the length of the longest such chunk.
CACHE_CHUNKS, CACHE_ROWS, CACHE_CHARS = 60_000, 120_000, 60
#: Pairs of tokens whose border a Python worker knows, and as many steps of the automaton, for chunks side by side.
CACHE_PAIRS = 500_000
#: An odd number that spreads keys over a table.
SPREAD = 0x1E3779B97F4A7C15
#: Encoded rows that a Python worker hands on at once, and characters in which no further row is begun.
OUT_ROWS, OUT_CHARS = 250, 1_000_000


def read_vocabulary(model_path: str) -> dict:
    """Pieces with their merge ranks, byte ids and special ids of a model file with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.vocab_size())
    normal = {
        model.id_to_piece(i): i
        for i in ids
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    }
    levels = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in normal.values()}, reverse=True))}
    return {
        "pieces": normal,
        "rank": {p: levels[model.get_score(i)] for p, i in normal.items()},
        "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)},
        "silent": [i for i in ids if model.is_control(i)],
        "unknown": {i: model.decode([i]) for i in ids if model.is_unknown(i)},
    }


def merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short symbol list: best rank first, leftmost among equals; also the last merge."""
    symbols, last = list(symbols), None
    while len(symbols) > 1:
        best, at = NO_RANK, -1
        for i in range(len(symbols) - 1):
            r = rank.get(symbols[i] + symbols[i + 1], NO_RANK)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        last = (symbols[at], symbols[at + 1])
        symbols[at : at + 2] = ["".join(last)]
    return symbols, last


class PrefixCoder:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.pieces: dict[str, int] = vocabulary["pieces"]
        self.rank: dict[str, int] = vocabulary["rank"]
        self.bytes: dict[int, int] = vocabulary["bytes"]
        self.split: dict[str, tuple[str, str]] = {}
        # Pieces of white space alone may share one rank; they are merged after all others.
        self.blank = {p for p in self.pieces if len(p) > 1 and not p.strip(SPACE)}
        rank = {p: r for p, r in self.rank.items() if p not in self.blank}
        for piece in rank:
            whole, last = merged(list(piece), rank)
            if len(whole) == 1:  # any other piece can't come out of merging
                if last:  # a character alone is the last token where no longer piece fits
                    self.split[piece] = last
        self.begins = {p[:k] for p in self.split for k in range(len(p))}
        self.endings: dict[str, tuple[str, list[tuple[int, str]]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.rows: dict[tuple, _Row] = {}
        self.merge_rank = {p: rank[p] for p in self.split}
        self.tokens: dict[str, tuple[str, str, int]] = {}
        self.altered = False  # whether any token met so far decodes to something else than its piece
        self.ids_of, self.word_ids = _Memory(self._learn), _Memory(self._learn_word)
        self.odd: dict[str, str] = {}  # decoded texts of remembered chunks that are not the chunk again
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.chunks = re.compile(self._chunk_pattern())
        self.passing: list[tuple[_Memory, str]] = []  # chunks too long to be worth their memory
        self.side = _SideBySide(self)
        self.from_id = {i: p for p, i in self.pieces.items()}
        self.id_text = {i: p.replace(SPACE, " ") for i, p in self.from_id.items()}
        self.id_name = {i: str(i) for i in (*self.from_id, *self.bytes.values())}
        self.from_byte = {i: b for b, i in self.bytes.items()}
        self.silent, self.unknown = set(vocabulary["silent"]), vocabulary["unknown"]
        self.first = _Row(self, "", ("",))

    def _chunk_pattern(self) -> str:
        """A chunk starts where no piece reaches back over the border.

        That is at white space after anything else, around line ends if no longer piece holds one,
        and between a letter and a mark, where marks are the punctuation that follows no letter in
        any piece.
        """
        letter = r"[^\W\d_]"
        after = {y for p in self.pieces for x, y in zip(p, p[1:], strict=False) if re.match(letter, x)}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        line = "" if any("\n" in p and len(p) > 1 for p in self.pieces) else "\n"
        other = rf"(?:[^\w{SPACE}{line}]|[\d_])"
        tied = rf"(?:(?!{letter})[^{SPACE}{line}{marks}]{other}*)"
        return (rf"{line}|" if line else "") + rf"(?=[\s\S]){SPACE}*{other}*(?:{letter}+{tied}?)*"

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b`` (all other pieces equal)."""
        rank, split = self.merge_rank, self.split
        before_a = before_b = NO_RANK  # ranks at which the symbols beside the border were merged away
        while True:
            across = rank.get(a + b)
            if across is not None and across < before_a and across <= before_b:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal ranks the left one is merged first, so it is undone last
                before_a, a = ra, split[a][1]
            else:
                before_b, b = rb, split[b][0]

    def ending(self, seen: str) -> tuple[str, list[tuple[int, str]]]:
        """The longest end of ``seen`` that a piece may continue; starts and pieces that end there, the longest first."""
        state = seen
        while state not in self.begins:
            state = state[1:]
        return state, [(k, seen[k:]) for k in range(len(seen) - 1) if seen[k:] in self.split]

    def _next_row(self, row: _Row, char: str) -> _Row:
        """The row after ``char``: the longest end of the text that a piece may continue, and the last token."""
        seen = row.state + char
        got = self.endings.get(seen)
        if got is None:
            got = self.endings[seen] = self.ending(seen)
        state, pieces = got
        last = char
        for k, piece in pieces:  # the longest first
            before = row.lasts[k]
            if before:  # none at the start of the text
                fit = self.fits.get((before, piece))
                if fit is None:
                    fit = self.fits[before, piece] = self.compatible(before, piece)
                if not fit:
                    continue
            last = piece
            break
        lasts = (*row.lasts[len(row.lasts) - len(state) :], last)
        found = self.rows.get((state, lasts))
        if found is None:
            found = self.rows[state, lasts] = _Row(self, state, lasts)
        return found

    def token(self, piece: str) -> tuple[str, str, int]:
        """Ids joined by commas, decoded text and length of a piece; what no piece holds is written as bytes."""
        got = self.tokens.get(piece)
        if got is None:
            i = self.pieces.get(piece)
            ids = [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]
            got = self.tokens[piece] = (",".join([self.id_name[i] for i in ids]), self.decoded(ids), len(piece))
            self.altered |= got[1] != piece.replace(SPACE, " ")
        return got

    def coded(self, chunk: str) -> tuple[str, str]:
        """Ids joined by commas and decoded text of a chunk, read backwards off its prefix table."""
        if max(len(self.rows), len(self.endings), len(self.fits) // 4, len(self.tokens)) > CACHE_ROWS:
            for row in (self.first, *self.rows.values()):
                row.clear()
            for memory in (self.rows, self.endings, self.fits, self.tokens):
                memory.clear()
        table = list(accumulate(chunk, getitem, initial=self.first))
        ids, at = [], len(chunk)
        if self.altered:
            texts, end = [], at
            while end:
                _, text, size = table[end].token
                texts.append(text)
                end -= size
            decoded = "".join(texts[::-1])
        else:
            decoded = chunk.replace(SPACE, " ")
        while at:
            row = table[at]
            ids.append(row.name)
            at -= row.size
        if chunk.startswith(SPACE + SPACE):
            single, blanks = self.token(SPACE)[0], 0
            while ids and ids[-1] == single:
                ids.pop()
                blanks += 1
            ids += [self.token(piece)[0] for piece in reversed(self.blanks(blanks))]
        ids.reverse()
        return ",".join(ids), decoded

    def blanks(self, n: int) -> list[str]:
        """Pieces of ``n`` separate white-space symbols: the leftmost merge first, all of one rank or by rank."""
        out: list[str] = []
        if not self.blank:
            return [SPACE] * n
        levels = sorted({self.rank[p] for p in self.blank})
        symbols = [SPACE] * n
        for level in levels:
            allowed = {p for p in self.blank if self.rank[p] <= level}
            out = []
            for symbol in symbols:  # a stack does the leftmost merge first, since a merge frees one to its left
                out.append(symbol)
                while len(out) > 1 and out[-2] + out[-1] in allowed:
                    out[-2:] = [out[-2] + out[-1]]
            symbols = out
        return symbols

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, white space at its start not yet stripped."""
        try:
            return "".join([self.id_text[i] for i in ids])
        except KeyError:
            pass
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.from_byte:
                raw.append(self.from_byte[i])
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if i not in self.silent:
                out.append(self.id_text[i] if i in self.id_text else self.unknown[i])
        if raw:
            out.append(_lenient(bytes(raw)))
        return "".join(out)

    def _coded_once(self, chunk: str) -> str:
        ids, decoded = self.coded(chunk)
        if decoded != chunk.replace(SPACE, " "):
            self.odd[chunk] = decoded
        return ids

    def _learn(self, chunk: str) -> None:
        self.ids_of[chunk] = self._coded_once(chunk)
        if len(chunk) >= CACHE_CHARS:
            self.passing.append((self.ids_of, chunk))

    def _learn_word(self, word: str) -> None:
        """A word is what stands between single spaces; it is encoded with the space before it."""
        self.word_ids[word] = self._coded_once(SPACE + word)
        if len(word) >= CACHE_CHARS:
            self.passing.append((self.word_ids, word))

    def _parts(self, text: str) -> tuple[bool, list[str]]:
        """Whether a text is words between single spaces; and these words, or else its chunks."""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return False, self.chunks.findall(SPACE + text.replace(" ", SPACE))
        return True, text.split(" ")

    def _learn_all(self, memory: _Memory, parts: set[str], before: str) -> None:
        """Remember those parts that can be encoded side by side; the others are learned when they are asked for."""
        if self.altered:  # decoded texts are kept as well, one by one
            return
        new = filterfalse(memory.older.__contains__, filterfalse(memory.__contains__, parts))
        new = [p for p in new if len(p) < CACHE_CHARS and not p.startswith(SPACE + SPACE)]
        ids = self.side.coded([before + p for p in new])
        if not self.altered:
            memory.update(zip(new, ids, strict=True))

    def encode_decode_all(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """What ``encode_decode`` gives for each text."""
        texts = [t.replace(SPACE, " ") if t else "" for t in texts]
        self._forget()
        split = [self._parts(t) if t else (True, []) for t in texts]
        self._learn_all(self.word_ids, set().union(*[parts for words, parts in split if words]), SPACE)
        self._learn_all(self.ids_of, set().union(*[parts for words, parts in split if not words]), "")
        return [self._put_together(t, *s) for t, s in zip(texts, split, strict=True)]

    def encode_decode(self, text: str | None) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text (dummy prefix added and taken away)."""
        if not text:
            return "", 0, ""
        text = text.replace(SPACE, " ")
        self._forget()
        return self._put_together(text, *self._parts(text))

    def _forget(self) -> None:
        if len(self.odd) > CACHE_CHUNKS:  # a remembered chunk that is odd stays known as such
            for memory in (self.word_ids, self.ids_of):
                memory.age()
                memory.older = {}
            self.odd.clear()
        for memory in (self.word_ids, self.ids_of):
            if len(memory) > CACHE_CHUNKS:
                memory.age()

    def _put_together(self, text: str, words: bool, parts: list[str]) -> tuple[str, int, str]:
        if not parts:
            return "", 0, ""
        of_ids = self.word_ids if words else self.ids_of
        ids, decoded = ",".join(map(of_ids.__getitem__, parts)), text
        if self.odd:
            chunks = [SPACE + p for p in parts] if words else parts
            decoded = "".join([self.odd.get(c, c.replace(SPACE, " ")) for c in chunks])[1:]
        for memory, part in self.passing:
            memory.pop(part, None)
        self.passing.clear()
        return ids, ids.count(",") + 1, decoded

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_decode(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of any ids of the vocabulary, without the one white space that encoding adds in front."""
        text = self.decoded(ids)
        return text[1:] if ids and self.from_id.get(ids[0], "").startswith(SPACE) else text


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Numbers:
    """Numbers for whole keys, looked up many at a time in an open table; ``make`` gives the number of a new key."""

    def __init__(self, make: Callable[[int], int]):
        self.make, self.many = make, 0
        self.keys, self.values = np.full(4096, -1), np.zeros(4096, np.int64)

    def _slots(self, wanted: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot at which the search for it ends."""
        mask = len(self.keys) - 1
        slots = wanted * SPREAD >> 32 & mask
        found = self.keys[slots]
        left = np.flatnonzero((found != wanted) & (found >= 0))
        while len(left):
            slots[left] = slots[left] + 1 & mask
            found = self.keys[slots[left]]
            left = left[(found != wanted[left]) & (found >= 0)]
        return slots

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slots = self._slots(wanted)
        lacking = self.keys[slots] != wanted
        if lacking.any():
            self._add(np.unique(wanted[lacking]))
            slots = self._slots(wanted)
        return self.values[slots]

    def _add(self, new: np.ndarray) -> None:
        made = [self.make(k) for k in new.tolist()]
        self.many += len(new)
        if 2 * self.many > len(self.keys):
            held = self.keys >= 0
            old, room = (self.keys[held], self.values[held]), 1 << (4 * self.many).bit_length()
            self.keys, self.values = np.full(room, -1), np.zeros(room, np.int64)
            self._put(*old)
        self._put(new, np.array(made, np.int64))

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):  # of keys that end at one free slot, one gets it
            slots = self._slots(keys)
            self.keys[slots] = keys
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]


class _SideBySide:
    """Prefix tables of many short chunks at once, as an array with a row for each place and a column for each chunk."""

    def __init__(self, coder: PrefixCoder):
        self.coder = coder
        self._clear()

    def _clear(self) -> None:
        self.coder.tokens.clear()
        self.texts, self.names, self.sizes = [""], [""], [0]  # by token; 0 is the start of a chunk
        self.numbers = {"": 0}
        self.states, self.state_numbers = [""], {"": 0}
        self.ends, self.ends_used = np.zeros(4096, np.int64), 0  # pieces that end at each step, the longest first, and their sizes
        self.char = _Numbers(lambda c: self._token(chr(c)))
        self.step = _Numbers(self._make_step)
        self.fit = _Numbers(lambda pair: int(not pair >> 32 or self.coder.compatible(self.texts[pair >> 32], self.texts[pair & 0xFFFFFFFF])))

    def _token(self, piece: str) -> int:
        got = self.numbers.get(piece)
        if got is None:
            got = self.numbers[piece] = len(self.texts)
            name, _, size = self.coder.token(piece)
            self.texts.append(piece)
            self.names.append(name)
            self.sizes.append(size)
        return got

    def _make_step(self, key: int) -> int:
        state, pieces = self.coder.ending(self.states[key >> 21] + chr(key & 0x1FFFFF))
        number = self.state_numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        begin, self.ends_used = self.ends_used, self.ends_used + len(pieces)
        if self.ends_used > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[begin : self.ends_used] = [self._token(piece) << 16 | len(piece) for _, piece in pieces]
        return number << 42 | begin << 10 | len(pieces)

    def coded(self, chunks: list[str]) -> list[str]:
        """Ids joined by commas of each chunk; none starts with two spaces."""
        if not chunks:
            return []
        if max(self.fit.many, self.step.many) > CACHE_PAIRS:
            self._clear()
        sizes = np.array([len(c) for c in chunks])
        order = np.argsort(-sizes, kind="stable")  # chunks that reach a place stand before those that don't
        sizes, width = sizes[order], len(chunks)
        text = np.frombuffer("".join([chunks[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        char = self.char(text)
        table = np.zeros((int(sizes[0]) + 1, width), np.int64)
        state = np.zeros(width, np.int64)
        reach = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for place, n in enumerate(reach.tolist(), 1):
            at = first[:n] + place - 1
            step = self.step(state[:n] << 21 | text[at])
            state[:n] = step >> 42
            last = char[at]
            left = np.flatnonzero(step & 1023)
            begin, many, k = step[left] >> 10 & 0xFFFFFFFF, step[left] & 1023, 0
            while len(left):
                piece = self.ends[begin + k]
                fits = self.fit(table[place - (piece & 0xFFFF), left] << 32 | piece >> 16) > 0
                last[left[fits]] = piece[fits] >> 16
                k += 1
                more = ~fits & (many > k)
                left, begin, many = left[more], begin[more], many[more]
            table[place, :n] = last
        return self._read_off(table, sizes, order)

    def _read_off(self, table: np.ndarray, at: np.ndarray, order: np.ndarray) -> list[str]:
        """Ids joined by commas, read backwards off the columns, which belong to the chunks of ``order``."""
        size, width = np.array(self.sizes), np.array([len(n) + 1 for n in self.names])
        left, found = np.arange(len(order)), []
        while len(left):
            token = table[at[left], left]
            found.append((left, token))
            at[left] -= size[token]
            left = left[at[left] > 0]
        many = np.zeros(len(order), np.int64)
        for left, _ in found:
            many[left] += 1
        ends = np.cumsum(many)
        tokens = np.empty(ends[-1], np.int64)
        for k, (left, token) in enumerate(found, 1):
            tokens[ends[left] - k] = token
        names = ",".join(map(self.names.__getitem__, tokens.tolist()))
        places = np.concatenate([[0], np.cumsum(width[tokens])])
        back = np.argsort(order)
        starts, stops = places[ends - many][back], places[ends][back] - 1
        return [names[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


class _Memory(dict):
    """A dict that asks for what it lacks, and drops what it has not used for a generation."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, key):
        if key in self.older:
            self[key] = self.older.pop(key)
        else:
            self.learn(key)
        return self[key]

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class _Row(dict):
    """A row of the prefix table, by character the rows that can follow it."""

    __slots__ = ("coder", "state", "lasts", "token", "name", "size")

    def __init__(self, coder: PrefixCoder, state: str, lasts: tuple[str, ...]):
        super().__init__()
        self.coder, self.state, self.lasts, self.token = coder, state, lasts, coder.token(lasts[-1])
        self.name, _, self.size = self.token

    def __missing__(self, char: str) -> _Row:
        found = self[char] = self.coder._next_row(self, char)
        return found


def _in_parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in parts of ``OUT_ROWS``, or of fewer once they have ``OUT_CHARS`` characters."""
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text or "")
        if len(part) >= OUT_ROWS or chars >= OUT_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def coded_column(spark: SparkSession, model_path: str, text: Column) -> Column:
    """A struct for each text: ``ids`` (decimal, joined by commas), ``n_tokens``, ``decoded``."""
    vocabulary = read_vocabulary(model_path)
    name = hashlib.sha256(repr(sorted(vocabulary["rank"].items())).encode()).hexdigest()
    held = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("ids string, n_tokens long, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = remembered(name, lambda: PrefixCoder(held.value))
        for texts in batches:
            for part in _in_parts(texts.tolist()):  # ids and text are several times the input: hand them on in parts
                yield pd.DataFrame(coder.encode_decode_all(part), columns=["ids", "n_tokens", "decoded"])
        hand_back_memory(keep=name)

    return code(text)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``."""
    coded = docs.withColumn("__coded", coded_column(docs.sparkSession, model_path, F.col(text_col)))
    for field in ("ids", "n_tokens", "decoded"):
        coded = coded.withColumn(field, F.col(f"__coded.{field}"))
    return coded.drop("__coded")
