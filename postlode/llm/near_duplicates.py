"""Near-duplicate records with small edits: an exact set-similarity self-join on word shingles.

Rare-first prefix filtering. Every text is the set of its k-word shingles, ordered rare first by a global order; texts
of similarity t must share a shingle within their prefixes. Postings of the prefixes are joined by shingle under

* the length filter (the smaller set has at least t times the size of the larger),
* the positional filter (a shared shingle at positions i and j must leave room for the overlap still needed),
* the order's own filter: two texts with the same shingle just before the shared one have met there,
* a suffix filter: each posting list is checked at once, as a product of +-1 matrices, against parity bitmaps of the
  whole sets. Two sets differ in at least as many shingles as their bitmaps in bits, so no true pair is lost. A
  bitmap of 512 bits serves sets of up to 234 shingles; larger sets carry one of 512 * 2^level bits besides, which
  folds to the level of a smaller partner, and their pairs are checked a second time on it,

and every surviving pair is verified once on its whole sets. Records with equal sets form one class; joins run between
classes, and members are expanded only at the end, so a text that a third of all rows share costs one posting list
entry per map task.

Scale. The order comes from counts over all texts in a table of 2^order_bits cells, and the filter of texts to fetch for
verification is a Bloom filter of 16 bits a text, at most 2^MOST_FILTER_BITS bits. A cell shared by two shingles only
makes the order a little less sharp, never wrong, since any one order gives the same result; a full filter reads more. Texts are read in place
and never shuffled. Postings travel packed, about five bytes each.

Defined cases: a NULL, blank or short text (under least_words) agrees with none; repeated rows of one id count once;
rows with a NULL id are ignored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.blobs import BLOB, bloom_of, exchange, pack, rows, share, sketch_sum, spread_keys, unpack
from postlode.llm.tokens import Sets, mix, shingle_sets
from postlode.session import cut, shuffle_width

U = np.uint64
BITS = 512
LEVEL_SIZE = 234
TOKEN_BITS = 40
ORDER_BITS = 20
MOST_FILTER_BITS = 30
LABEL_BITS = 14
LEAST_LABELLED = 16
SMALL_LIST = 48
BLOCK = 384


class Threshold:
    """Similarity t = num/den as exact integers: pairs agree when shared/(all) >= num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of sets of sizes a and b: ceil(t/(1+t) (a+b))."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def longest_prefix(self, n: np.ndarray) -> np.ndarray:
        """Prefix of a set against any partner: the smallest partner has t*n shingles, all of them shared."""
        return n - -((-self.num * n) // self.den) + 1


def rarity(df: DataFrame, text: str, k: int, least_words: int, order_bits: int = ORDER_BITS) -> np.ndarray:
    """Place in the order of every cell of shingles: class of frequency (two steps per doubling) over all texts, then a label.

    The label is the least hash of a text that has the cell, so the shingles of a sentence that recurs in many texts mostly
    have one label and follow each other in the order. Cells that no task has LEAST_LABELLED times have label 0. Labels only
    sharpen the filters: any one order gives the same result."""
    size = 1 << order_bits
    half = U(32)
    none = U(2**32 - 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        count = np.zeros(size, dtype=np.int64)
        low = np.full(size, none, dtype=U)
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist(), k, least_words):
                cell = (s.flat & U(size - 1)).astype(np.int64)
                count += np.bincount(cell, minlength=size)
                np.minimum.at(low, cell, np.repeat(mix(np.bitwise_xor.reduceat(s.flat, s.o[:-1])) >> half, s.sizes()))
        return (count.astype(U) << half) | np.where(count >= LEAST_LABELLED, low, none)

    total = sketch_sum(df.select(text), partial, lambda a, b: (((a >> half) + (b >> half)) << half) | np.minimum(a & none, b & none))
    label = np.where(total & none != none, np.maximum(mix(total & none) >> U(64 - LABEL_BITS), U(1)), U(0)).astype(np.uint32)
    return (np.floor(2 * np.log2(np.maximum(total >> half, 1))).astype(np.uint32) << LABEL_BITS) | label


def rare_first(s: Sets, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each set, rare first: shingle, set number, position, size of the set."""
    n = s.sizes()
    text = np.repeat(np.arange(len(s)), n)
    cls = order[(s.flat & U(len(order) - 1)).astype(np.int64)].astype(np.uint64)
    # text number, place (a class, or a class and a label), then the shingle mixed: one sort; the full shingle follows by the same permutation
    bits = U(8 if order.dtype == np.uint8 else 6 + LABEL_BITS)
    key = (text.astype(np.uint64) << U(52)) | (cls << (U(52) - bits)) | (mix(s.flat) >> (U(12) + bits))
    perm = np.argsort(key, kind="stable")
    pos = np.arange(len(perm)) - s.o[:-1][text]
    return s.flat[perm], text, pos, n[text]


def _first_of_each(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct fingerprint, and the class number of every row."""
    by = np.lexsort((fp[:, 1], fp[:, 0]))
    v = fp[by]
    starts = np.concatenate([np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]).any(axis=1)])
    inverse = np.empty(len(by), np.int64)
    inverse[by] = np.cumsum(starts) - 1
    return by[starts], inverse


def levels(n: np.ndarray) -> np.ndarray:
    """Level of the larger bitmap of sets of size n; 0: none."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LEVEL_SIZE))).astype(np.int64)


def _large_bitmaps(s: Sets, chosen: np.ndarray) -> list[bytes]:
    """Bitmaps of the chosen sets (their numbers) at their own levels; empty at level 0."""
    lv = levels(s.sizes())
    out = []
    for i in chosen:
        one = Sets(s.flat[s.o[i] : s.o[i + 1]], np.array([0, s.o[i + 1] - s.o[i]]), np.array([0])) if lv[i] else None
        out.append(one.parity(BITS << int(lv[i])).tobytes() if one else b"")
    return out


def _fold(bits: np.ndarray, times: int) -> np.ndarray:
    """Packed bitmaps at a level lower by `times`: parities of b and b + half add up."""
    for _ in range(times):
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _refine(pairs: np.ndarray, n: np.ndarray, large: dict[int, bytes], t: Threshold) -> np.ndarray:
    """Drop the pairs of two large sets that their larger bitmaps rule out."""
    i, j = (pairs >> 32).astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int64)
    lv = levels(n)
    low = np.minimum(lv[i], lv[j])
    keep = np.ones(len(pairs), dtype=bool)
    for a in np.unique(low[low > 0]):
        at = np.flatnonzero(low == a)
        docs = np.unique(np.concatenate([i[at], j[at]]))
        maps = np.stack([_fold(np.frombuffer(large[d], np.uint8)[None, :], int(lv[d] - a))[0] for d in docs]).view(U)
        x, y = np.searchsorted(docs, i[at]), np.searchsorted(docs, j[at])
        for c in range(0, len(at), 20000):
            c = slice(c, c + 20000)
            apart = np.bitwise_count(maps[x[c]] ^ maps[y[c]]).sum(axis=1, dtype=np.int64)
            p, q = n[i[at[c]]], n[j[at[c]]]
            keep[at[c]] = apart <= p + q - 2 * t.needed(p, q)
    return pairs[keep]


def _bucket_of(tok: np.ndarray, order: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each shingle: that of its label, so that a text's header goes to few buckets; of itself without a label."""
    label = order[(tok & U(len(order) - 1)).astype(np.int64)].astype(U) & U((1 << LABEL_BITS) - 1)
    return (mix(np.where(label > 0, label, tok)) >> U(33)) % U(n_buckets)


def _before(tok: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of each posting the shingle that comes just before in its text's order, if the bucket has it; else a number of its own."""
    by = np.argsort((doc.astype(np.int64) << 32) | pos)
    follows = (doc[by][1:] == doc[by][:-1]) & (pos[by][1:] == pos[by][:-1] + 1)
    out = -1 - np.arange(len(tok), dtype=np.int64)
    out[by[1:][follows]] = tok[by[:-1][follows]].astype(np.int64)
    return out


def postings(df: DataFrame, ids: str, text: str, order: Broadcast, keys: list[int], k: int, least_words: int, t: Threshold) -> DataFrame:
    """Packed rows for exchange(): per map task and bucket the texts' headers and their prefix postings, and in the
    bucket of its fingerprint every row's membership."""
    n_buckets = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, key64, sizes, maps = [], [], [], []
        large: list[bytes] = []
        post: list[tuple[np.ndarray, ...]] = []
        mem_fp, mem_id = [], []
        known: set[bytes] = set()
        base = 0
        table = order.value

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if not base:
                return
            fp, n, key, bm = np.concatenate(fps), np.concatenate(sizes), np.concatenate(key64), np.concatenate(maps)
            tok, doc, pos = (np.concatenate(x) for x in zip(*post, strict=True))
            bucket = _bucket_of(tok, table, n_buckets)
            by = np.argsort((bucket << U(TOKEN_BITS)) | tok)
            tok, doc, pos, bucket = tok[by], doc[by], pos[by], bucket[by]
            ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
            out = []
            for b in range(n_buckets):
                i = slice(ends[b], ends[b + 1])
                used, local = np.unique(doc[i], return_inverse=True)
                step = np.diff(tok[i], prepend=U(0)) if ends[b + 1] > ends[b] else tok[i]
                extra = [large[d] for d in used]
                small = np.uint16 if len(used) < 65536 else np.uint32
                # the upper and lower halves of the steps apart: the upper ones are mostly zero and pack to nothing
                out.append(pack(what=pa.array([0]), fp=_one(fp[used]), n=_one(n[used].astype(np.int32)), key=_one(key[used]), bits=_one(bm[used]), large=pa.array([extra], pa.list_(pa.binary())),
                                hi=_one((step >> U(32)).astype(np.uint32)), lo=_one((step & U(2**32 - 1)).astype(np.uint32)),
                                doc=_one(local.astype(small)), pos=_one(pos[i].astype(np.uint16 if len(n) and n.max() < 65536 else np.uint32))))
            yield rows(["bucket", "blob"], pa.array(keys, pa.int32()), pa.array(out, pa.binary()))
            base = 0
            large.clear()
            for x in (fps, key64, sizes, maps, post):
                x.clear()
            known.clear()

        for b in batches:
            ident, key, texts = b.column(0), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_pylist()
            for s in shingle_sets(texts, k, least_words):
                fp = s.fingerprints()
                mem_fp.append(fp)
                mem_id.append(ident.take(pa.array(s.which)))
                # texts known from this task's earlier chunks, or repeated in this one, add nothing but a member
                first, inverse = _first_of_each(fp)
                low = np.full(len(first), np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(low, inverse, key[s.which])
                fresh = np.array([fp[i].tobytes() not in known for i in first], dtype=bool)
                known.update(fp[i].tobytes() for i in first[fresh])
                place = np.full(len(s), -1)
                place[first[fresh]] = np.arange(fresh.sum()) + base
                tok, doc, pos, n = rare_first(s, table)
                keep = (place[doc] >= 0) & (pos < t.longest_prefix(n))
                tok = tok & U(2**TOKEN_BITS - 1)
                post.append((tok[keep], place[doc[keep]], pos[keep]))
                fps.append(fp[first[fresh]])
                key64.append(low[fresh])
                sizes.append(s.sizes()[first[fresh]])
                maps.append(s.parity(BITS)[first[fresh]])
                large.extend(_large_bitmaps(s, first[fresh]))
                base += int(fresh.sum())
            if base >= 60000:
                yield from flush()
        yield from flush()
        if mem_fp:
            fp = np.concatenate(mem_fp)
            ids_all = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in mem_id])
            to = (fp[:, 0] >> U(17)) % U(n_buckets)
            for b in range(n_buckets):
                m = np.flatnonzero(to == b)
                if len(m):
                    yield rows(["bucket", "blob"], pa.array([keys[b]], pa.int32()), pa.array([pack(what=pa.array([1]), fp=_one(fp[m]), id=_list(ids_all.take(pa.array(m))))], pa.binary()))

    return df.where(F.col(ids).isNotNull()).select(ids, F.xxhash64(ids), text).mapInArrow(run, BLOB)


def _one(v: np.ndarray) -> pa.Array:
    """A whole numpy array as one binary cell, byte planes apart: near-constant high bytes pack to almost nothing."""
    v = np.ascontiguousarray(v)
    planes = v.reshape(len(v), 1).view(np.uint8).T if v.ndim == 1 else v.view(np.uint8)
    return pa.array([np.ascontiguousarray(planes).tobytes()], pa.large_binary())


def _take(batch: pa.RecordBatch, name: str, dtype: type, width: int = 1) -> np.ndarray:
    cell = batch.column(name)[0].as_py()
    raw = np.frombuffer(cell, dtype=np.uint8) if cell else np.empty(0, np.uint8)
    if width > 1:
        return raw.view(dtype).reshape(-1, width)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _list(ids: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), ids)


PAIR = "kind int, fa binary, fb binary, ka bigint, kb bigint, id string"


def candidates(packed: DataFrame, t: Threshold) -> DataFrame:
    """kind 0: candidate pairs of classes (fingerprint and key of a record of each); kind 1: (fa, id) memberships."""
    names = ["kind", "fa", "fb", "ka", "kb", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[tuple[np.ndarray, ...]] = []
        large: dict[int, bytes] = {}
        post: list[tuple[np.ndarray, ...]] = []
        base = 0
        for b in batches:
            for blob in b.column(1).to_pylist():
                x = unpack(blob)
                fp = _take(x, "fp", U, 2)
                if x.column("what")[0].as_py() == 1:
                    ident = x.column("id")[0].values
                    none = pa.nulls(len(ident), pa.binary())
                    zero = pa.nulls(len(ident), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ident), np.int32)), _bin(fp), none, zero, zero, ident.cast(pa.string())], names=names)
                    continue
                n = _take(x, "n", np.int32).astype(np.int64)
                head.append((fp, n, _take(x, "key", U), _take(x, "bits", np.uint8, BITS // 8)))
                for d in np.flatnonzero(levels(n)):
                    large[base + int(d)] = x.column("large")[0].values[int(d)].as_py()
                hi, lo = _take(x, "hi", np.uint32).astype(U), _take(x, "lo", np.uint32).astype(U)
                m = len(hi)
                size = lambda c: np.uint16 if len(x.column(c)[0].as_py()) == 2 * m else np.uint32  # noqa: E731, B023
                post.append((np.cumsum((hi << U(32)) | lo, dtype=U), _take(x, "doc", size("doc")).astype(np.int64) + base, _take(x, "pos", size("pos")).astype(np.int32)))
                base += len(fp)
        if not head:
            return
        fp, n, key, bits = (np.concatenate(z) for z in zip(*head, strict=True))
        tok, doc, pos = (np.concatenate(z) for z in zip(*post, strict=True))
        del head, post
        first, inverse = _first_of_each(fp)
        if len(first) < len(fp):
            low = np.full(len(first), np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(low, inverse, key)
            large = {int(inverse[d]): v for d, v in large.items()}
            fp, n, key, bits, doc = fp[first], n[first], low, bits[first], inverse[doc]
            by = np.lexsort((doc, tok))
            tok, doc, pos = tok[by], doc[by], pos[by]
            once = np.concatenate([[True], (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])])
            tok, doc, pos = tok[once], doc[once], pos[once]
        # sizes of 2^24 and more share a place in the order, which the filters do not need to be exact
        by = np.argsort((tok << U(24)) | np.minimum(n[doc], 2**24 - 1).astype(U))
        tok, doc, pos = tok[by], doc[by], pos[by]
        found = _refine(_pairs(tok, doc.astype(np.int32), pos, n, bits, t, _before(tok, doc, pos)), n, large, t)
        if len(found):
            i, j = (found >> 32).astype(np.int64), (found & 0xFFFFFFFF).astype(np.int64)
            # the smaller fingerprint first, so that every bucket names a pair alike
            swap = (fp[i, 0] > fp[j, 0]) | ((fp[i, 0] == fp[j, 0]) & (fp[i, 1] > fp[j, 1]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for a in range(0, len(i), 200_000):
                s = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(i[s]), np.int32)), _bin(fp[i[s]]), _bin(fp[j[s]]), pa.array(key[i[s]].view(np.int64)), pa.array(key[j[s]].view(np.int64)), pa.nulls(len(i[s]), pa.string())],
                    names=names,
                )

    return packed.mapInArrow(run, PAIR)


def _bin(fp: np.ndarray) -> pa.Array:
    fp = np.ascontiguousarray(fp)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(fp), [None, pa.py_buffer(fp)]).cast(pa.binary())


def _pairs(tok: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, bits: np.ndarray, t: Threshold, before: np.ndarray) -> np.ndarray:
    """Distinct candidate pairs (i << 32 | j, i < j) among the postings, which are sorted by shingle and set size.

    A pair is wanted at the first shingle in the order that both texts have. Two texts with the same shingle just before
    have met there, so they aren't compared again."""
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
    length = np.diff(edge)
    out: list[np.ndarray] = []
    words = bits.view(np.uint64)
    coarse = _fold(bits, 1)
    width = coarse.shape[1] * 8
    # short lists: all of them together, partner by distance within the list
    short = np.repeat(length <= SMALL_LIST, length)
    group = np.repeat(np.arange(len(length)), length)
    at = np.flatnonzero(short)
    for step in range(1, SMALL_LIST):
        at = at[at + step < len(tok)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        i, j = doc[at], doc[at + step]
        need = t.needed(n[i], n[j])
        ok = (pos[at] <= n[i] - need) & (pos[at + step] <= n[j] - need) & (before[at] != before[at + step])
        i, j, need = i[ok], j[ok], need[ok]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        ok = apart <= n[i] + n[j] - 2 * need
        out.append(_code(i[ok], j[ok]))
    # long lists: block by block as matrix products; a block of sizes is compared only with sizes in reach of it
    share = t.num / (t.num + t.den)
    slack = (2 * (1 - 2 * share) * n).astype(np.float32)
    # arrays of this size are mapped and unmapped by every allocation: one of each serves all blocks
    left, right, cells = (np.empty(BLOCK * x, np.float32) for x in (width, width, BLOCK))
    near = np.empty(BLOCK * BLOCK, bool)

    def compare(d: np.ndarray, p: np.ndarray, m: np.ndarray, w: np.ndarray, last: np.ndarray, r: np.ndarray, c: np.ndarray, same: bool) -> None:
        """Places r against places c of one list; each pair once if they are the same."""
        # equal bits minus unequal bits must be at least width - 2 * (sizes - 2 * needed)
        of_r = np.take(SIGNS, coarse[d[r]], axis=0, out=left[: len(r) * width].reshape(len(r), -1, 8), mode="clip").reshape(len(r), width)
        of_c = of_r if same else np.take(SIGNS, coarse[d[c]], axis=0, out=right[: len(c) * width].reshape(len(c), -1, 8), mode="clip").reshape(len(c), width)
        product = np.matmul(of_r, of_c.T, out=cells[: len(r) * len(c)].reshape(len(r), len(c)))
        product += w[r][:, None]
        hit = np.flatnonzero(np.greater_equal(product, width - 0.01 - w[c], out=near[: len(r) * len(c)].reshape(len(r), len(c))).ravel())
        if not len(hit):
            return
        i, j = r[hit // len(c)], c[hit % len(c)]
        ok = (i < j if same else i != j) & (last[i] != last[j])
        i, j = i[ok], j[ok]
        need = t.needed(m[i], m[j])
        ok = (p[i] <= m[i] - need) & (p[j] <= m[j] - need)
        i, j, need = d[i[ok]], d[j[ok]], need[ok]
        if len(i):
            ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * need
            out.append(_code(i[ok], j[ok]))

    for g in np.flatnonzero(length > SMALL_LIST):
        a, b = edge[g], edge[g + 1]
        d, p, last = doc[a:b], pos[a:b], before[a:b]
        m, w = n[d], slack[d]
        values, times = np.unique(last, return_counts=True)
        common = values[np.argmax(times)]
        rest = np.flatnonzero(last != common)
        if 3 * len(rest) < len(d):
            # most have met before: only the others are compared, with all
            for x in range(0, len(rest), BLOCK):
                r = rest[x : x + BLOCK]
                lo, hi = np.searchsorted(m, -(-m[r[0]] * t.num // t.den), "left"), np.searchsorted(m, m[r[-1]] * t.den // t.num, "right")
                for y in range(lo, hi, BLOCK):
                    c = np.arange(y, min(y + BLOCK, hi))
                    c = c[p[c] <= m[c] - t.needed(m[c], np.maximum(m[r[0]], -(-m[c] * t.num // t.den)))]
                    if len(c):
                        compare(d, p, m, w, last, r, c, False)
            continue
        for x in range(0, len(d), BLOCK):
            xe = min(x + BLOCK, len(d))
            for y in range(x, len(d), BLOCK):
                ye = min(y + BLOCK, len(d))
                if m[y] * t.num > m[xe - 1] * t.den:
                    break
                r = x + np.flatnonzero(p[x:xe] <= m[x:xe] - t.needed(m[x:xe], np.maximum(m[y], m[x:xe])))
                c = y + np.flatnonzero(p[y:ye] <= m[y:ye] - t.needed(m[y:ye], m[x]))
                if len(r) and len(c):
                    compare(d, p, m, w, last, r, c, x == y and np.array_equal(r, c))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


# The eight bits of a byte as +1 and -1.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def _code(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lo, hi = np.minimum(i, j).astype(np.int64), np.maximum(i, j).astype(np.int64)
    return (lo << 32) | hi


def filter_bits(count: int) -> int:
    """Size of a Bloom filter of so many keys, as a power of two: 16 bits a key, at most 2^MOST_FILTER_BITS bits."""
    return min(MOST_FILTER_BITS, max(16, (16 * count).bit_length()))


def fetch_sets(df: DataFrame, ids: str, text: str, wanted: DataFrame, k: int, least_words: int) -> DataFrame:
    """(fp, key, shingles) of the records whose key is in `wanted` (one bigint column); a Bloom filter of bounded size
    keeps other texts from being read into sets, and the join that follows drops its few false hits."""
    spark = df.sparkSession
    bloom = share(spark, bloom_of(wanted, filter_bits(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bloom.value
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(f.has(key.view(np.uint64)))
            if not len(hit):
                continue
            texts = b.column(1).take(pa.array(hit)).to_pylist()
            for s in shingle_sets(texts, k, least_words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[hit[s.which]]), _bin(s.fingerprints()), pa.array([s.flat[a:b].tobytes() for a, b in zip(s.o[:-1], s.o[1:], strict=True)], pa.binary())],
                    names=["key", "fp", "shingles"],
                )

    got = df.where(F.col(ids).isNotNull()).select(F.xxhash64(ids), text).mapInArrow(run, "key bigint, fp binary, shingles binary")
    return got


def verify(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(fa, fb, shared, total) of the candidate pairs that reach the threshold on their whole sets."""
    one = sets.dropDuplicates(["fp"])
    with_a = pairs.join(one.select(F.col("fp").alias("fa"), F.col("shingles").alias("sa")), "fa")
    both = with_a.join(one.select(F.col("fp").alias("fb"), F.col("shingles").alias("sb")), "fb").select("fa", "fb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, total = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                z = np.sort(np.concatenate([p, q]))
                s = int((z[1:] == z[:-1]).sum())
                shared.append(s)
                total.append(len(p) + len(q) - s)
            ok = np.array(shared) * t.den >= np.array(total) * t.num
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32()), pa.array(total, pa.int32())], names=["fa", "fb", "shared", "total"]).filter(pa.array(ok))

    return both.mapInArrow(run, "fa binary, fb binary, shared int, total int")


def near_duplicates(df: DataFrame, ids: str, text: str, k: int = 5, num: int = 4, den: int = 5, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (fp, id) has every record with a usable text and its class, the fingerprint of its
    set; links (fa, fb, shared, total) has each pair of different classes that agree, fa < fb."""
    spark = df.sparkSession
    t = Threshold(num, den)
    width = max(2, shuffle_width(spark) // 2)
    order = share(spark, rarity(df, text, k, least_words))
    packed = exchange(postings(df, ids, text, order, spread_keys(spark, width), k, least_words, t), width)
    both = cut(candidates(packed, t))
    members = both.where("kind = 1").select(F.col("fa").alias("fp"), "id").distinct()
    pairs = cut(both.where("kind = 0").groupBy("fa", "fb").agg(F.min("ka").alias("ka"), F.min("kb").alias("kb")))
    wanted = pairs.select("ka").union(pairs.select("kb"))
    sets = cut(fetch_sets(df, ids, text, wanted, k, least_words))
    return members, verify(pairs.select("fa", "fb"), sets, t)


def agreeing_pairs(df: DataFrame, ids: str, text: str, k: int = 5, num: int = 4, den: int = 5, least_words: int = 5) -> DataFrame:
    """(id_a, id_b) of all pairs of different records that agree, id_a < id_b."""
    members, links = near_duplicates(df, ids, text, k, num, den, least_words)
    links = cut(links)
    a = members.select(F.col("fp").alias("fa"), F.col("id").alias("x"))
    b = members.select(F.col("fp").alias("fb"), F.col("id").alias("y"))
    across = links.select("fa", "fb").join(a, "fa").join(b, "fb").select("x", "y")
    within = a.join(b, F.col("fa") == F.col("fb")).where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").union(within).distinct()


