"""MD5 of many short texts at once, a text in each lane of arrays; digests are those of ``hashlib``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts that are hashed together: few enough for a core's cache, enough that calls don't count.
LANES = 1 << 13
_ROUNDS = [
    (i // 16, (m * i + a) % 16, int(abs(np.sin(i + 1)) * 2**32), turns[i % 4])
    for (m, a), turns, span in zip(((1, 0), (5, 1), (3, 5), (7, 0)), ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)), range(4), strict=True)
    for i in range(16 * span, 16 * span + 16)
]
# Constants are arrays without dimensions: numpy takes them with half the cost of a call.
_STEPS = [(kind, word, k, np.array(k, np.uint32), np.array(s, np.uint32), np.array(32 - s, np.uint32)) for kind, word, k, s in _ROUNDS]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The state after one more block of sixteen words; a word that all lanes share is added with the constant of its step."""
    shared = (words == words[:, :1]).all(1)
    a, b, c, d = (s.copy() for s in state)
    f, turned = np.empty_like(a), np.empty_like(a)
    for kind, word, k, constant, left, right in _STEPS:
        if kind == 0:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif kind == 1:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif kind == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if shared[word]:
            np.add(f, np.array((k + int(words[word, 0])) % 2**32, np.uint32), f)
        else:
            np.add(f, constant, f)
            np.add(f, words[word], f)
        np.left_shift(f, left, turned)
        np.right_shift(f, right, f)
        np.bitwise_or(f, turned, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return [np.add(x, y, x) for x, y in zip((a, b, c, d), state, strict=True)]


def size(length: int) -> int:
    """Bytes of the blocks that a text takes."""
    return 64 * ((length + 8) // 64 + 1)


def framed(text: bytes) -> bytes:
    """A text filled up to whole blocks, its length at the end."""
    return (text + b"\x80").ljust(size(len(text)) - 8, b"\0") + (8 * len(text)).to_bytes(8, "little")


def md5(frames: np.ndarray) -> np.ndarray:
    """Digests ``(n, 16)`` of ``framed`` texts, bytes ``(n, 64 * blocks)``."""
    out = np.empty((len(frames), 4), dtype="<u4")
    for at in range(0, len(frames), LANES):
        words = np.ascontiguousarray(frames[at : at + LANES].view("<u4").T)
        state = [np.full(words.shape[1], s, dtype=np.uint32) for s in _START]
        for first in range(0, len(words), 16):
            state = _block(state, words[first : first + 16])
        out[at : at + LANES] = np.stack(state, 1)
    return out.view(np.uint8)


def by_digits(low: int, high: int) -> Iterator[tuple[int, int]]:
    """Parts of ``range(low, high)`` whose numbers have equally many digits."""
    while low < high:
        upto = min(high, 10 ** len(str(low)))
        yield low, upto
        low = upto


def decimals(numbers: np.ndarray) -> np.ndarray:
    """The digits ``(n, digits)`` of numbers that have equally many, as ASCII."""
    powers = 10 ** np.arange(len(str(int(numbers[0]))) - 1, -1, -1)
    return (numbers[:, None] // powers % 10 + 48).astype(np.uint8)
