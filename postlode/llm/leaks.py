"""Evaluation texts leaking into training text: which documents hold passages of which held-out items.

Item windows of `window` words, or of the whole item if it is shorter but has `least` words, are embedded by CGK random
walks: step j writes the word under the cursor and moves on by a random bit that depends on j and the word, so texts a
few edits apart stay in step for most of the walk and edit distance turns into Hamming distance. Some positions of the
walk, sampled at random, make a key; independent keys are repeated until a window within the permitted edits is found
with probability `recall`. The chance of one key is measured once for each window size, by walks over random words with
random edits (a fixed number of trials, independent of the data). Document windows with a key of an item window are then
verified: the edit distance in words must be at most `edits` (in proportion for shorter items).

Before the walk, the q-gram lemma (exact) discards document windows: a window within e edits of an item window has at
least window - 2 - 3e of its 3-word sequences in common with it. Equal windows have equal walks, so they are always found.

The items' index is broadcast, about MOST_WINDOWS windows at a time: more items go in several rounds over the documents,
each with its share of the items. Documents are read in place and whole; only the found pairs are shuffled.

Defined cases: NULL and blank texts, texts and items shorter than the window hold nothing; NULL ids are ignored;
repeated rows count once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.blobs import share
from postlode.llm.tokens import chunks, grams, mix, words

U = np.uint64
MOST_WINDOWS = 2_000_000
RECALL = 0.95
TRIALS = 2000
MOST_REPEATS = 64
GRAM_BITS = 24
STRETCH = 3
SAMPLED = 6


class Walk:
    """Random functions of one CGK embedding of windows of w words and the positions sampled from its 3w outputs."""

    def __init__(self, w: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = w
        self.odd = rng.integers(1, 2**63, size=STRETCH * w, dtype=np.uint64) * U(2) + U(1)
        # the later part of a walk has mostly run out of words and tells little
        self.at = np.sort(rng.choice(2 * w, size=min(SAMPLED, 2 * w), replace=False))

    def keys(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Key of the window of w words at each start of the word hashes h."""
        cursor = np.zeros(len(start), dtype=np.int64)
        key = np.full(len(start), U(len(self.at)), dtype=np.uint64)
        sampled = set(self.at.tolist())
        for j in range(int(self.at[-1]) + 1):
            inside = cursor < self.w
            now = h[start + np.minimum(cursor, self.w - 1)]
            if j in sampled:
                key = mix(key * U(0x9E3779B97F4A7C15) + np.where(inside, now, U(0)))
            cursor += ((now * self.odd[j]) >> U(63)).astype(np.int64)
        return key


@lru_cache(maxsize=64)
def repeats_for(window: int, edits: int, recall: float) -> int:
    """Keys that find a window `edits` random edits away with probability `recall`, by trials over random words."""
    if edits == 0:
        return 1
    rng = np.random.default_rng(97 * window + edits)
    a = rng.integers(1, 2**63, size=(TRIALS, window), dtype=np.uint64)
    b = a.copy()
    for row in b:
        left = edits
        while left:
            at, to = rng.integers(window, size=2)
            if left > 1 and rng.random() < 0.5:
                # windows are of one size: a word more here is a word less there
                rest = np.delete(row, at)
                row[:] = np.insert(rest, to, rng.integers(1, 2**63))
                left -= 2
            else:
                row[at] = rng.integers(1, 2**63)
                left -= 1
    flat = np.concatenate([a.ravel(), b.ravel()])
    start = np.arange(2 * TRIALS) * window
    hit = 0.0
    for r in range(8):
        k = Walk(window, 7919 * r + window).keys(flat, start)
        hit += float((k[:TRIALS] == k[TRIALS:]).mean()) / 8
    return int(min(MOST_REPEATS, max(2, np.ceil(np.log(1 - recall) / np.log(1 - min(max(hit, 1e-3), 0.999))))))


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance of word sequences, most + 1 if larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        if min(row) > most:
            return most + 1
        last = row
    return last[-1]


class Index:
    """Item windows by their keys."""

    def __init__(self, ids: list[int], texts: list[str], window: int, edits: int, repeats: int):
        self.window, self.edits = window, edits
        self.walks = [Walk(window, 7919 * r + window) for r in range(repeats)]
        self.grams = np.zeros(1 << (GRAM_BITS - 3), dtype=np.uint8)
        hs, item, start = [], [], []
        base = 0
        for first, part in chunks(texts, entities=True):
            h, o = words(part)
            _, text, pos = grams(h, o, window)
            hs.append(h)
            item.append(text + first)
            start.append(o[text] + pos + base)
            g = grams(h, o, 3)[0] & U((1 << GRAM_BITS) - 1)
            np.bitwise_or.at(self.grams, (g >> U(3)).astype(np.int64), (1 << (g & U(7)).astype(np.uint8)).astype(np.uint8))
            base += len(h)
        self.h = np.concatenate(hs) if hs else np.empty(0, U)
        self.item = np.array(ids, dtype=np.int64)[np.concatenate(item)] if item else np.empty(0, np.int64)
        self.start = np.concatenate(start) if start else np.empty(0, np.int64)
        self.tables = []
        for w in self.walks:
            k = w.keys(self.h, self.start)
            by = np.argsort(k, kind="stable")
            self.tables.append((k[by], by))

    def hits(self, h: np.ndarray, o: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, position, item id, distance) of verified windows of the texts with word hashes h and offsets o."""
        w = self.window
        g, text, pos = grams(h, o, 3)
        if not len(g) or not len(self.start):
            return
        g = g & U((1 << GRAM_BITS) - 1)
        known = np.zeros(len(h) + 1, dtype=np.int32)
        known[(o[text] + pos).astype(np.int64)] = (self.grams[(g >> U(3)).astype(np.int64)] >> (g & U(7)).astype(np.uint8)) & 1
        total = np.concatenate([[0], np.cumsum(known)])
        start = np.arange(max(0, len(h) - w + 1))
        of = np.searchsorted(o, start, side="right") - 1
        inside = start + w <= o[of + 1]
        enough = total[start + w - 2] - total[start] >= w - 2 - 3 * self.edits
        start, of = start[inside & enough], of[inside & enough]
        if not len(start):
            return
        seen: set[tuple[int, int]] = set()
        for walk, (keys, by) in zip(self.walks, self.tables, strict=True):
            k = walk.keys(h, start)
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for at in np.flatnonzero(hi > lo):
                s = int(start[at])
                mine = None
                for x in by[lo[at] : hi[at]]:
                    if (s, int(x)) in seen:
                        continue
                    seen.add((s, int(x)))
                    i = int(self.start[x])
                    if self.edits == 0:
                        if np.array_equal(h[s : s + w], self.h[i : i + w]):
                            yield int(of[at]), s - int(o[of[at]]), int(self.item[x]), 0
                        continue
                    mine = mine if mine is not None else h[s : s + w].tolist()
                    d = edit_distance(mine, self.h[i : i + w].tolist(), self.edits)
                    if d <= self.edits:
                        yield int(of[at]), s - int(o[of[at]]), int(self.item[x]), d


SCHEMA = "doc_id bigint, item_id bigint, windows int, distance int"


def _indexes(ids: list[int], texts: list[str], window: int, edits: int, recall: float, least: int) -> list[Index]:
    """An index of the items of at least `window` words, and one for each shorter length down to `least`."""
    sizes = np.concatenate([np.diff(words(part)[1]) for _, part in chunks(texts, entities=True)]) if texts else np.empty(0, np.int64)
    out = []
    for size in range(least, window + 1):
        mine = np.flatnonzero(sizes >= window if size == window else sizes == size)
        if len(mine):
            e = edits * size // window
            out.append(Index([ids[i] for i in mine], [texts[i] for i in mine], size, e, repeats_for(size, e, recall)))
    return out


def leaks(
    documents: DataFrame, items: DataFrame, window: int = 8, edits: int = 0, recall: float = RECALL, least: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS
) -> DataFrame:
    """(doc_id, item_id, windows, distance): documents and the items they share passages with, the number of document
    windows that match and the least distance. Items under `least` words (the window's size by default) are left out."""
    least = max(3, least or window)
    own = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    # a window needs a letter and a blank at least
    rounds = max(1, -(-int(own.agg(F.sum(F.length("t"))).first()[0] or 0) // (2 * most_windows)))
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text)
    found = None
    for r in range(rounds):
        share_ = own if rounds == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == r)
        part = _leaks_of(docs, share_, window, edits, recall, least)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.min("distance").alias("distance"))


def _leaks_of(docs: DataFrame, items: DataFrame, window: int, edits: int, recall: float, least: int) -> DataFrame:
    """Matches of one round's items."""
    rows = items.collect()
    shared = share(docs.sparkSession, _indexes([r[0] for r in rows], [r[1] for r in rows], window, edits, recall, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found: dict[tuple[int, int], tuple[set[int], int]] = {}
            for first, part in chunks(texts, entities=True):
                h, o = words(part)
                for ix in shared.value:
                    for t, pos, item, d in ix.hits(h, o):
                        have = found.get((first + t, item))
                        if have is None:
                            found[first + t, item] = ({pos}, d)
                        else:
                            have[0].add(pos)
                            found[first + t, item] = (have[0], min(have[1], d))
            out = [(ids[t], i, len(p), d) for (t, i), (p, d) in found.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "windows", "distance"])

    return docs.mapInArrow(run, SCHEMA)


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, documents, nearest): the items that leaked and in how many documents."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("distance").alias("nearest"))
