"""Bounded edit distance through a symmetric-delete index, with weighted Damerau-Levenshtein ranking."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

VOWELS = frozenset("aeiouy")
LOOKALIKE = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "8": "b"}


def fold(text: str) -> str:
    """Lower case without accents or compatibility forms."""
    if text.isascii():
        return text.lower()
    out = unicodedata.normalize("NFKD", text)
    return "".join(c for c in out if not unicodedata.combining(c)).lower()


def bound(n: int) -> int:
    """Largest distance at which a key of n letters is still taken for a misspelling."""
    return 0 if n < 4 else 1 if n < 8 else 2


def deletes(key: str, d: int) -> set[str]:
    """key and everything that up to d deletions make of it."""
    layer, out = {key}, {key}
    for _ in range(d):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein (optimal alignment) with weights: a doubled letter, a swap, a vowel for a vowel or a
    lookalike digit cost less than a plain edit, an edit of the first letter more. Above `most`: most + 1."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) > most / 0.6 + 1:
        return most + 1
    before: list[float] = []
    last = [0.0]
    for j in range(1, m + 1):
        last.append(last[-1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, n + 1):
        x = a[i - 1]
        row = [last[0] + (0.6 if i > 1 and x == a[i - 2] else 1.0)]
        low = row[0]
        for j in range(1, m + 1):
            y = b[j - 1]
            if x == y:
                best = last[j - 1]
            else:
                swap = 0.7 if LOOKALIKE.get(x) == y or LOOKALIKE.get(y) == x else 0.9 if x in VOWELS and y in VOWELS else 1.0
                best = last[j - 1] + (swap if i > 1 or j > 1 else 1.3)
                best = min(best, last[j] + (0.6 if i > 1 and x == a[i - 2] else 1.0), row[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1.0))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 0.8)
            row.append(best)
            low = min(low, best)
        if low > most + 1:
            return most + 1
        before, last = last, row
    return last[m]


class Dictionary:
    """Keys with their entries; lookup gives the best entry within the bound of the key's length.

    Its size is that of the reference list times the deletions of a key, so the caller checks the list's size before
    it is broadcast."""

    def __init__(self, rows: Iterable[tuple[str, str, int]]):
        """rows: key, entry, frequency of the entry."""
        self.exact: dict[str, list[tuple[int, str]]] = {}
        self.index: dict[str, set[str]] = {}
        for key, entry, n in rows:
            if not key:
                continue
            have = self.exact.setdefault(key, [])
            if (-n, entry) not in have:
                have.append((-n, entry))
                have.sort()
        self.lengths = {len(k) for k in self.exact}
        for key in self.exact:
            for d in deletes(key, bound(len(key))):
                self.index.setdefault(d, set()).add(key)

    def lookup(self, key: str) -> tuple[float, int, str] | None:
        """(distance, minus frequency, entry): nearest, then most frequent, then first by code point."""
        if key in self.exact:
            n, entry = self.exact[key][0]
            return 0.0, n, entry
        d = bound(len(key))
        if not d or not any(n in self.lengths for n in range(len(key) - d, len(key) + d + 1)):
            return None
        best = None
        tried: set[str] = set()
        for depth in range(1, d + 1):
            found: set[str] = set()
            for x in deletes(key, depth):
                if x in self.index:
                    found |= self.index[x]
            for k in found - tried:
                most = float(min(d, bound(len(k))))
                w = weighted_distance(key, k, most)
                if w <= most:
                    n, entry = self.exact[k][0]
                    if best is None or (w, n, entry) < best:
                        best = (w, n, entry)
            tried |= found
            # two edits cost more than one even where they are cheap
            if best and best[0] <= 1.0:
                break
        return best
