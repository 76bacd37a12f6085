"""Words, word shingles and set signatures for whole batches of texts at once (numpy; no per-word Python).

Words are runs of a-z and 0-9 in lower case; HTML tags read as blanks; character entities are decoded first on request.
A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums over the joined batch, then mixed.
Shingle hashes keep 52 bits, so that one sort of (text number, shingle) words gives every text's distinct set.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np

TAG = re.compile(r"<[^>]*>")
U = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_MULT = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * U(2) + U(1)
_VALUE = np.zeros(256, dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = True
_VALUE[_WORD] = _RNG.integers(1, 2**63, size=36, dtype=np.uint64)
CHUNK = 1_000_000
HASH_BITS = 52
MOST_TEXTS = 1 << (64 - HASH_BITS)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        for name, base in (("p", _BASE), ("q", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def plain(text: str | None, entities: bool = False) -> str:
    t = text or ""
    if entities and "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = TAG.sub(" ", t)
    return t.lower()


def chunks(texts: list[str | None], entities: bool = False) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, prepared texts) of about CHUNK characters and fewer than MOST_TEXTS texts."""
    out: list[str] = []
    first = size = 0
    for k, t in enumerate(texts):
        p = plain(t, entities)
        if out and (size + len(p) > CHUNK or len(out) >= MOST_TEXTS - 1):
            yield first, out
            out, first, size = [], k, 0
        out.append(p)
        size += len(p)
    if out:
        yield first, out


def words(prepared: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and offsets: text k has words [o[k], o[k+1])."""
    raw = [t.encode("ascii", "replace") for t in prepared]
    buf = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
    at = np.cumsum([1, *[len(r) + 1 for r in raw]])
    is_word = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    p, q = _powers(len(buf))
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[buf] * p, out=total[1:])
    return mix((total[end] - total[start]) * q[start]), np.searchsorted(start, at)


def grams(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word sequences inside each text: hash, text number, position in the text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    g = h[:n] * _MULT[0]
    for i in range(1, k):
        g = g + h[i : n + i] * _MULT[i % 64]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    pos = np.arange(n) - offsets[text]
    inside = np.arange(n) + k <= offsets[text + 1]
    return mix(g)[inside], text[inside], pos[inside]


class Sets:
    """Distinct shingles of some texts: text k of `which` (numbers in the batch) has flat[o[k]:o[k+1]], sorted."""

    __slots__ = ("flat", "o", "which")

    def __init__(self, flat: np.ndarray, o: np.ndarray, which: np.ndarray):
        self.flat, self.o, self.which = flat, o, which

    def __len__(self) -> int:
        return len(self.which)

    def sizes(self) -> np.ndarray:
        return np.diff(self.o)

    def fingerprints(self) -> np.ndarray:
        """128 bits of each set, as two columns; equal sets, and for practical purposes only those, agree."""
        if not len(self):
            return np.empty((0, 2), U)
        a, b = mix(self.flat * _MULT[10]), mix(self.flat * _MULT[11] + U(7))
        return np.stack([mix(np.add.reduceat(a, self.o[:-1])), mix(np.add.reduceat(b, self.o[:-1]))], axis=1)

    def parity(self, bits: int = 256) -> np.ndarray:
        """Bitmaps of `bits` bits, packed: bit b of a text is the parity of its shingles that hash to b.
        Two sets differ in at least as many shingles as their bitmaps in bits."""
        n = len(self)
        text = np.repeat(np.arange(n), self.sizes())
        b = (mix(self.flat * _MULT[12]) % U(bits)).astype(np.int64)
        odd = np.bincount(text * bits + b, minlength=n * bits).astype(np.uint8) & 1
        return np.packbits(odd.reshape(n, bits), axis=1)


def _sets(key: np.ndarray, first: int) -> Sets:
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    text = (key >> U(HASH_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    return Sets(key & U(2**HASH_BITS - 1), cuts, text[cuts[:-1]] + first)


def _keys(texts: list[str | None], k: int, least_words: int, entities: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, part in chunks(texts, entities):
        h, o = words(part)
        g, text, _ = grams(h, o, k)
        enough = (np.diff(o) >= max(least_words, k))[text]
        key = ((text.astype(np.uint64) << U(HASH_BITS)) | (g & U(2**HASH_BITS - 1)))[enough]
        if len(key):
            yield first, key, text[enough]


def shingle_sets(texts: list[str | None], k: int, least_words: int, entities: bool = False) -> Iterator[Sets]:
    """Sets of k-word shingles of the texts with at least `least_words` words (and k), chunk by chunk."""
    for first, key, _ in _keys(texts, k, least_words, entities):
        yield _sets(key, first)


def winnowed_sets(texts: list[str | None], k: int, least_words: int, window: int) -> Iterator[tuple[Sets, Sets]]:
    """(shingles, fingerprints) of the same texts. Fingerprints are the least shingle hash of every `window` consecutive
    shingles, so two texts that share a run of window + k - 1 words share one; a text of fewer shingles has its least."""
    for first, key, text in _keys(texts, k, least_words, False):
        n = len(key)
        low = key.copy()
        for i in range(1, window):
            # the last windows of a text are shorter; a text number in the high bits keeps texts apart
            same = text[i:] == text[: n - i]
            low[: n - i] = np.where(same, np.minimum(low[: n - i], key[i:]), low[: n - i])
        rank = np.arange(n) - np.searchsorted(text, text)
        left = np.searchsorted(text, text, side="right") - np.arange(n)
        yield _sets(key, first), _sets(low[(left >= window) | (rank == 0)], first)
