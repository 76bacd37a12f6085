"""Deduplicating new batches against all history with a persistent fingerprint store.

A text's fingerprints are its winnowed word shingles: the least hash of every WINDOW consecutive shingles. Agreement is
defined on all shingles, so WINDOW is 1 and links are exact; larger windows are smaller stores that may miss short texts.
Fingerprints are ordered rare first by an order fixed when the store is made; texts that agree share one of the rarest of
both (prefix filter), and only those are posted.

The store is a folder of written tables: packed postings and memberships of the accepted texts, one part a batch; for
every part and bucket of fingerprints a Bloom filter whose size follows from its number of fingerprints; and the order.
A batch goes through

1. prescreening: its fingerprints meet the filters of their bucket; what the filters lack, and the batch has once, has no
   partner and goes no further;
2. look-up: the store's postings are read in place and only those of a surviving fingerprint are shuffled to its bucket,
   where parity bitmaps of whole sets rule out most pairs (exact bound, as in near_duplicates);
3. verification of the shared coverage of each surviving pair on the whole shingle sets;
4. resolution in order of arrival: a posting is a repeat if its hash or text agrees with an accepted one before it,
   else it is accepted. Whole rounds over classes of equal texts and hashes, until nothing changes;
5. update: accepted postings join the store as a new part (postings, filters) and the table of seen hashes.

A hash class or text class that a third of all rows share is one class: rounds use the least arrival of each class,
never its pairs.

A bucket repeats the headers of the texts it names, so that many buckets copy a header nearly as often as a text has
postings. Steps 1 and 2 therefore go in rounds over parts of the buckets: a round shuffles about MOST_COPIES copies of a
header, and its files are removed before the next. The store has buckets enough that one names about MOST_HEADERS texts.

Scale. What is broadcast is the order, of a fixed size, and Bloom filters of the batch's fingerprints and of the texts to
verify, sized by their count up to 2^MOST_FILTER_BITS bits; a fuller filter lets more through and loses nothing. History's
texts are fingerprinted once, when they enter. A round reads the store's postings without shuffling those that the batch does
not hit, and scans history's texts once, keeping only those a surviving pair names.

Defined cases: a NULL, blank or short text agrees with none and only its hash counts; missing parts of the hash are
empty; ties of similarity go to the posting accepted first; an empty batch or history gives no rows or only new ones;
repeated rows of one id count once; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm.blobs import Bloom, bloom_of, column, exchange, pack, rows, share, sketch_sum, spread_keys, unpack
from postlode.llm.near_duplicates import BITS, ORDER_BITS, PAIR, SIGNS, TOKEN_BITS, Threshold, _bin, _code, _first_of_each, _fold, _large_bitmaps, _list, _one, _refine, _take, fetch_sets, filter_bits, levels, rare_first, verify
from postlode.llm.tokens import mix, winnowed_sets
from postlode.session import cut, ensure_checkpoint_dir, release, shuffle_width

U = np.uint64
WINDOW = 1
SHORT_LIST = 48
BLOCK = 256
FLUSH = 30_000
# Texts that a bucket names, and copies of a text's header that a round shuffles.
MOST_HEADERS = 350_000
MOST_COPIES = 6
AGREE = Threshold(4, 5)
# what: 0 postings, 1 memberships, 2 a Bloom filter of the bucket's fingerprints; bucket -1 where it is not told apart.
ROWS = "bucket int, what int, n bigint, blob binary"
_NAMES = ["bucket", "what", "n", "blob"]
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLANKS = f"^{_BLANK}|{_BLANK}$"


def dedup_hash(title: Column, company: Column, location: Column) -> Column:
    """First 16 hex digits of SHA-256 over title|company|location, each lower-cased and trimmed."""
    part = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BLANKS, "")
    return F.substring(F.sha2(F.concat_ws("|", part(title), part(company), part(location)), 256), 1, 16)


def _order(df: DataFrame, text: str, k: int, least_words: int, window: int) -> np.ndarray:
    """Class of frequency (two steps a doubling) of every cell of fingerprints, counted over all texts."""
    size = 1 << ORDER_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        count = np.zeros(size, dtype=np.int64)
        for b in batches:
            for _, f in winnowed_sets(b.column(0).to_pylist(), k, least_words, window):
                count += np.bincount((f.flat & U(size - 1)).astype(np.int64), minlength=size)
        return count

    total = sketch_sum(df.select(text), partial, lambda a, b: a + b)
    return np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)


def _packed(bucket: int, what: int, n: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([what], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=_NAMES)


def _steps(tok: np.ndarray) -> dict[str, pa.Array]:
    """Ascending fingerprints as steps, the upper and lower halves apart."""
    step = np.diff(tok, prepend=U(0)) if len(tok) else tok
    return {"hi": _one((step >> U(32)).astype(np.uint32)), "lo": _one((step & U(2**32 - 1)).astype(np.uint32))}


def _tokens(x: pa.RecordBatch) -> np.ndarray:
    return np.cumsum((_take(x, "hi", np.uint32).astype(U) << U(32)) | _take(x, "lo", np.uint32).astype(U), dtype=U)


def _pack_postings(side: int, head: tuple[np.ndarray, ...], large: pa.Array, tok: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Postings ascending by fingerprint, with the headers of the texts they name."""
    used, local = np.unique(doc, return_inverse=True)
    fp, n, nf, key, bits = (h[used] for h in head)
    return pack(side=pa.array([side]), fp=_one(fp), n=_one(n.astype(np.int32)), nf=_one(nf.astype(np.int32)), key=_one(key), bits=_one(bits),
                large=pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), large.take(pa.array(used))), **_steps(tok), doc=_one(local.astype(np.uint32)), pos=_one(pos.astype(np.uint32)))


def _unpack_postings(x: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    head = (_take(x, "fp", U, 2), _take(x, "n", np.int32).astype(np.int64), _take(x, "nf", np.int32).astype(np.int64), _take(x, "key", U), _take(x, "bits", np.uint8, BITS // 8))
    return head, x.column("large")[0].values, _tokens(x), _take(x, "doc", np.uint32).astype(np.int64), _take(x, "pos", np.uint32).astype(np.int64)


def _postings(df: DataFrame, ids: str, text: str, order: np.ndarray, side: int, k: int, least_words: int, t: Threshold, window: int) -> DataFrame:
    """Packed rows: postings with their texts' headers, and memberships. Headers are written once; postings are told apart
    by bucket only when they are shuffled."""
    shared = share(df.sparkSession, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        head: list[tuple[np.ndarray, ...]] = []
        large: list[bytes] = []
        post: list[tuple[np.ndarray, ...]] = []
        base = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if not base:
                return
            whole = tuple(np.concatenate(x) for x in zip(*head, strict=True))
            tok, doc, pos = (np.concatenate(x) for x in zip(*post, strict=True))
            by = np.argsort(tok)
            yield _packed(-1, 0, len(tok), _pack_postings(side, whole, pa.array(large, pa.binary()), tok[by], doc[by], pos[by]))
            base = 0
            for x in (head, large, post):
                x.clear()

        for b in batches:
            ident, key = b.column(0), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for s, f in winnowed_sets(b.column(2).to_pylist(), k, least_words, window):
                fp = s.fingerprints()
                yield _packed(-1, 1, len(fp), pack(fp=_one(fp), id=_list(ident.take(pa.array(s.which)).cast(pa.string()))))
                first, inverse = _first_of_each(fp)
                low = np.full(len(first), np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(low, inverse, key[s.which])
                place = np.full(len(s), -1)
                place[first] = np.arange(len(first)) + base
                tok, doc, pos, nf = rare_first(f, table)
                keep = place[doc] >= 0
                if window == 1:
                    keep &= pos < t.longest_prefix(nf)
                post.append((tok[keep] & U(2**TOKEN_BITS - 1), place[doc[keep]], pos[keep]))
                head.append((fp[first], s.sizes()[first], f.sizes()[first], low, s.parity(BITS)[first]))
                large.extend(_large_bitmaps(s, first))
                base += len(first)
            if base >= FLUSH:
                yield from flush()
        yield from flush()

    return df.where(F.col(ids).isNotNull()).select(ids, F.xxhash64(ids), text).mapInArrow(run, ROWS)


@dataclass
class Round:
    """Buckets that are compared at one time, `part` of those of the `stored` keys, and the keys that spread them over
    the round's partitions."""

    stored: list[int]
    part: range
    keys: list[int]

    @property
    def n_buckets(self) -> int:
        return len(self.stored)

    def own(self, filters: DataFrame) -> DataFrame:
        """The filters of the round's buckets, under its keys."""
        if self.keys == self.stored:
            return filters
        names = self.stored[self.part.start : self.part.stop]
        to = F.create_map(*[F.lit(x) for pair in zip(names, self.keys, strict=False) for x in pair])
        return filters.where(F.col("bucket").isin(names)).withColumn("bucket", F.element_at(to, F.col("bucket")))


def _copies(n_buckets: int, each: float) -> float:
    """Expected number of buckets that a text of so many postings goes to, a copy of its header to each."""
    return n_buckets * (1 - (1 - 1 / n_buckets) ** each)


def _n_buckets(least: int, texts: int, posted: int) -> int:
    """Buckets for a store: at least so many, and more until one names about MOST_HEADERS texts."""
    n = least
    while texts * _copies(n, posted / max(1, texts)) / n > MOST_HEADERS:
        n += max(1, n // 4)
    return n


def _rounds(spark: SparkSession, stored: list[int], texts: int, posted: int) -> list[Round]:
    """All buckets of the store, in rounds that copy a text's header about MOST_COPIES times each."""
    n = len(stored)
    times = min(n, max(1, round(_copies(n, posted / max(1, texts)) / MOST_COPIES)))
    if times == 1:
        return [Round(stored, range(n), stored)]
    width = ceil(n / times)
    keys = spread_keys(spark, width)
    return [Round(stored, range(a, min(a + width, n)), keys) for a in range(0, n, width)]


def _counts(rows_: DataFrame) -> tuple[int, int]:
    """(texts, postings) of packed rows."""
    n = {r["what"]: r["n"] for r in rows_.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    return n.get(1, 0), n.get(0, 0)


def _bucket_of(tok: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((mix(tok) >> U(33)) % U(n_buckets)).astype(np.int64)


def _places(tok: np.ndarray, n_buckets: int, part: range) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the part, indices of its tokens in their order) of every bucket of the part that has some."""
    bucket = _bucket_of(tok, n_buckets)
    at = np.flatnonzero((bucket >= part.start) & (bucket < part.stop))
    place = (bucket[at] - part.start).astype(np.uint16 if len(part) < 2**16 else np.int64)
    by = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[by], np.arange(len(part) + 1))
    for i in np.flatnonzero(np.diff(ends)):
        yield int(i), at[by[ends[i] : ends[i + 1]]]


def _split(side: int, which: Round, head: tuple[np.ndarray, ...], large: pa.Array, tok: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row of postings for every bucket of the round that has some."""
    for i, at in _places(tok, which.n_buckets, which.part):
        yield _packed(which.keys[i], 0, len(at), _pack_postings(side, head, large, tok[at], doc[at], pos[at]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(bucket, rows) of a task whose rows are sorted by bucket."""
    held: tuple[int, list] | None = None
    for b in batches:
        for bucket, what, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0] != bucket:
                yield held
                held = None
            held = held or (bucket, [])
            held[1].append((what, n, blob))
    if held:
        yield held


def _filters(written: DataFrame, keys: list[int]) -> DataFrame:
    """One Bloom filter a bucket of the written postings, sized by its fingerprints."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(3).to_pylist():
                tok = np.unique(_tokens(unpack(blob)))
                for i, at in _places(tok, len(keys), range(len(keys))):
                    yield _packed(keys[i], 3, len(at), pack(**_steps(tok[at])))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, found in _by_bucket(batches):
            bloom = Bloom(max(6, ceil(log2(16 * sum(n for _, n, _ in found) + 1))))
            for _, _, blob in found:
                bloom.add(_tokens(unpack(blob)))
            yield _packed(bucket, 2, bloom.log2_bits, pack(v=bloom.bits))

    return exchange(written.where("what = 0").mapInArrow(tokens, ROWS), len(keys)).sortWithinPartitions("bucket").mapInArrow(build, ROWS)


def _screened(batch_rows: DataFrame, filters: DataFrame, keys: list[int], which: Round | None = None) -> DataFrame:
    """The batch's postings, of a round or of all buckets, without fingerprints that the bucket's filters lack and that
    the batch has once. keys: those of the store's buckets."""
    which = which or Round(keys, range(len(keys)), keys)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(3).to_pylist():
                head, large, tok, doc, pos = _unpack_postings(unpack(blob))
                yield from _split(1, which, head, large, tok, doc, pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, found in _by_bucket(batches):
            blooms = [Bloom(n, column(unpack(blob), "v")) for what, n, blob in found if what == 2]
            mine = [_unpack_postings(unpack(blob)) for what, _, blob in found if what == 0]
            if not mine:
                continue
            tok, times = np.unique(np.concatenate([m[2] for m in mine]), return_counts=True)
            known = times > 1
            for f in blooms:
                known |= f.has(tok)
            live = tok[known]
            for head, large, t, doc, pos in mine:
                at = np.flatnonzero(np.isin(t, live))
                if len(at):
                    yield _packed(bucket, 0, len(at), _pack_postings(1, head, large, t[at], doc[at], pos[at]))

    both = batch_rows.where("what = 0").mapInArrow(split, ROWS).unionByName(which.own(filters))
    return exchange(both, len(which.keys)).sortWithinPartitions("bucket", "what").mapInArrow(run, ROWS)


def _hit(written: DataFrame, wanted: DataFrame, which: Round) -> DataFrame:
    """The store's postings of the round's fingerprints that a screened batch has, up to a Bloom filter's false hits."""
    count = wanted.agg(F.sum("n")).first()[0] or 0
    bits = filter_bits(count)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        f = Bloom(bits)
        for b in batches:
            for blob in b.column(3).to_pylist():
                f.add(_tokens(unpack(blob)))
        return f.bits

    shared = share(wanted.sparkSession, Bloom(bits, sketch_sum(wanted, partial, np.bitwise_or)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for b in batches:
            for blob in b.column(3).to_pylist():
                head, large, tok, doc, pos = _unpack_postings(unpack(blob))
                bucket = _bucket_of(tok, which.n_buckets)
                at = np.flatnonzero((bucket >= which.part.start) & (bucket < which.part.stop))
                at = at[bloom.has(tok[at])]
                yield from _split(0, which, head, large, tok[at], doc[at], pos[at])

    return written.where("what = 0").mapInArrow(run, ROWS)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first 64 bits of each class's fingerprint."""
    for b in batches:
        raw = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(raw[::2])], names=["half"])


def _members(found: DataFrame, wanted: Bloom | None = None) -> DataFrame:
    """(fp, id) of the membership rows, those of wanted classes up to false hits."""
    shared = share(found.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for b in batches:
            for blob in b.column(3).to_pylist():
                x = unpack(blob)
                fp, ident = _take(x, "fp", U, 2), x.column("id")[0].values
                at = np.arange(len(fp)) if bloom is None else np.flatnonzero(bloom.has(fp[:, 0]))
                yield pa.RecordBatch.from_arrays([_bin(fp[at]), ident.take(pa.array(at))], names=["fp", "id"])

    return found.where("what = 1").mapInArrow(run, "fp binary, id string")


def _candidates(packed: DataFrame, t: Threshold, window: int) -> DataFrame:
    """Candidate pairs of classes with a batch member in at least one."""
    names = ["kind", "fa", "fb", "ka", "kb", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            yield from meet([unpack(blob) for _, _, blob in found])

    def meet(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[tuple[np.ndarray, ...]] = []
        post: list[tuple[np.ndarray, ...]] = []
        large: dict[int, bytes] = {}
        base = 0
        for x in found:
            (fp, n, nf, key, bits), extra, tok, doc, pos = _unpack_postings(x)
            head.append((fp, n, nf, key, bits, np.full(len(n), x.column("side")[0].as_py() == 1)))
            for d in np.flatnonzero(levels(n)):
                large[base + int(d)] = extra[int(d)].as_py()
            post.append((tok, doc + base, pos))
            base += len(n)
        fp, n, nf, key, bits, new = (np.concatenate(z) for z in zip(*head, strict=True))
        tok, doc, pos = (np.concatenate(z) for z in zip(*post, strict=True))
        first, inverse = _first_of_each(fp)
        if len(first) < len(fp):
            low = np.full(len(first), np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(low, inverse, key)
            fresh = np.zeros(len(first), dtype=bool)
            np.logical_or.at(fresh, inverse, new)
            large = {int(inverse[d]): v for d, v in large.items()}
            fp, n, nf, key, bits, new, doc = fp[first], n[first], nf[first], low, bits[first], fresh, inverse[doc]
            by = np.lexsort((doc, tok))
            tok, doc, pos = tok[by], doc[by], pos[by]
            once = np.concatenate([[True], (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])])
            tok, doc, pos = tok[once], doc[once], pos[once]
        by = np.lexsort((n[doc], tok))
        tok, doc, pos = tok[by], doc[by], pos[by]
        pairs = _refine(_meet(tok, doc, pos, n, bits, new, t, window == 1), n, large, t)
        i, j = (pairs >> 32).astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int64)
        swap = (fp[i, 0] > fp[j, 0]) | ((fp[i, 0] == fp[j, 0]) & (fp[i, 1] > fp[j, 1]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for a in range(0, len(i), 200_000):
            s = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(i[s]), np.int32)), _bin(fp[i[s]]), _bin(fp[j[s]]), pa.array(key[i[s]].view(np.int64)), pa.array(key[j[s]].view(np.int64)), pa.nulls(len(i[s]), pa.string())],
                names=names,
            )

    return packed.sortWithinPartitions("bucket").mapInArrow(run, PAIR)


def _meet(tok: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, bits: np.ndarray, new: np.ndarray, t: Threshold, positional: bool) -> np.ndarray:
    """Distinct pairs of texts, one of them new, that meet in a posting list and that no filter rules out."""
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
    length = np.diff(edge)
    out: list[np.ndarray] = [np.empty(0, np.int64)]
    full = bits.view(np.uint64)

    def keep(i: np.ndarray, j: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """i, j: texts; p, q: positions of the shared fingerprint in their orders."""
        ok = (new[i] | new[j]) & (np.minimum(n[i], n[j]) * t.den >= np.maximum(n[i], n[j]) * t.num)
        if positional:
            need = t.needed(n[i], n[j])
            ok &= (p <= n[i] - need) & (q <= n[j] - need)
        i, j = i[ok], j[ok]
        if len(i):
            apart = np.bitwise_count(full[i] ^ full[j]).sum(axis=1, dtype=np.int64)
            ok = apart <= n[i] + n[j] - 2 * t.needed(n[i], n[j])
            out.append(_code(i[ok], j[ok]))

    group = np.repeat(np.arange(len(length)), length)
    at = np.flatnonzero(np.repeat(length <= SHORT_LIST, length))
    for step in range(1, SHORT_LIST):
        at = at[at + step < len(tok)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        keep(doc[at], doc[at + step], pos[at], pos[at + step])
    coarse = _fold(bits, 1)
    width = coarse.shape[1] * 8
    share_ = t.num / (t.num + t.den)
    for g in np.flatnonzero(length > SHORT_LIST):
        a, b = edge[g], edge[g + 1]
        d, p = doc[a:b], pos[a:b]
        mine = np.flatnonzero(new[d])
        if not len(mine):
            continue
        m = n[d]
        signs = np.take(SIGNS, coarse[d], axis=0).reshape(len(d), width)
        w = (2 * (1 - 2 * share_) * m).astype(np.float32)
        for x in range(0, len(mine), BLOCK):
            rows_ = mine[x : x + BLOCK]
            # only partners of sizes in reach; sizes are ascending
            lo = np.searchsorted(m, -(-m[rows_[0]] * t.num // t.den), "left")
            hi = np.searchsorted(m, m[rows_[-1]] * t.den // t.num, "right")
            for y in range(lo, hi, 4 * BLOCK):
                ye = min(y + 4 * BLOCK, hi)
                r, c = np.arange(len(rows_)), np.arange(y, ye)
                if positional:
                    r = r[p[rows_] <= m[rows_] - t.needed(m[rows_], np.maximum(m[y], -(-m[rows_] * t.num // t.den)))]
                    c = c[p[c] <= m[c] - t.needed(m[c], np.maximum(m[rows_[0]], -(-m[c] * t.num // t.den)))]
                if not len(r) or not len(c):
                    continue
                product = signs[rows_[r]] @ (signs[y:ye] if len(c) == ye - y else signs[c]).T
                product += w[rows_[r]][:, None]
                hit = np.flatnonzero((product >= width - 0.01 - w[c]).ravel())
                if not len(hit):
                    continue
                i, j = rows_[r[hit // len(c)]], c[hit % len(c)]
                ok = (i < j) | ~new[d[j]]
                i, j = i[ok], j[ok]
                keep(d[i], d[j], p[i], p[j])
    found = np.unique(np.concatenate(out))
    return found[(found >> 32) != (found & 0xFFFFFFFF)]


@dataclass
class Store:
    """A fingerprint store in a folder: `rows` (postings and memberships) and `filters`, each with a part for every batch,
    and `meta`; and the table of accepted hashes (id, dedup_hash, first_seen_at, times_seen, last_seen_at)."""

    path: str
    rows: DataFrame
    filters: DataFrame
    order: np.ndarray
    seen: DataFrame
    keys: list[int]
    k: int
    least_words: int
    t: Threshold
    window: int
    parts: int


def _fresh_path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stores/{uuid.uuid4().hex}"


def _add_part(spark: SparkSession, path: str, part: int, postings: DataFrame, keys: list[int] | None) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows, filters, keys) of the store with a part more; a part written again replaces its former self. No keys: a new
    store, whose number of buckets follows from its postings."""
    postings.write.mode("overwrite").parquet(f"{path}/rows/part={part}")
    if keys is None:
        keys = spread_keys(spark, _n_buckets(max(2, shuffle_width(spark) // 2), *_counts(spark.read.schema(ROWS).parquet(f"{path}/rows/part={part}"))))
    _filters(spark.read.schema(ROWS).parquet(f"{path}/rows/part={part}"), keys).write.mode("overwrite").parquet(f"{path}/filters/part={part}")
    return *_tables(spark, path), keys


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: spark.read.schema(f"{ROWS}, part int").parquet(f"{path}/{name}").drop("part")
    return read("rows"), read("filters")


def build(texts: DataFrame, ids: str, text: str, seen: DataFrame, k: int = 5, least_words: int = 5, t: Threshold = AGREE, window: int = WINDOW, path: str | None = None) -> Store:
    """Store of the accepted texts, written to `path` or else to the checkpoint folder. seen: (id, dedup_hash,
    first_seen_at, times_seen, last_seen_at)."""
    spark = texts.sparkSession
    path = path or _fresh_path(spark)
    order = _order(texts, text, k, least_words, window)
    found, filters, keys = _add_part(spark, path, 0, _postings(texts, ids, text, order, 0, k, least_words, t, window), None)
    meta = [(bytearray(pack(v=order)), keys, k, least_words, t.num, t.den, window)]
    spark.createDataFrame(meta, "order_ binary, keys array<int>, k int, least_words int, num int, den int, window int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return Store(path, found, filters, order, seen, keys, k, least_words, t, window, 1)


def save_seen(store: Store) -> None:
    """Write the accepted hashes into the store's folder, as the version of its number of parts."""
    store.seen.write.mode("overwrite").parquet(f"{store.path}/seen/version={store.parts}")


def load(spark: SparkSession, path: str) -> Store:
    """The store that an earlier session wrote, with its last version of the accepted hashes."""
    m = spark.read.parquet(f"{path}/meta").first()
    found, filters = _tables(spark, path)
    versions = spark.read.parquet(f"{path}/seen")
    last = versions.agg(F.max("version")).first()[0]
    last = 1 if last is None else last
    return Store(path, found, filters, column(unpack(bytes(m["order_"])), "v"), versions.where(F.col("version") == last).drop("version"), m["keys"], m["k"], m["least_words"], Threshold(m["num"], m["den"]), m["window"], last)


def _all_candidates(store: Store, mine: DataFrame, t: Threshold) -> DataFrame:
    """Candidate pairs of a batch's packed rows, round by round: what a round shuffles is given back before the next."""
    spark = mine.sparkSession
    found: list[DataFrame] = []
    todo = _rounds(spark, store.keys, *_counts(store.rows.unionByName(mine)))
    for which in todo:
        screened = _screened(mine, store.filters, store.keys, which).persist(StorageLevel.DISK_ONLY)
        found.append(cut(_candidates(exchange(_hit(store.rows, screened, which).unionByName(screened), len(which.keys)), t, store.window)))
        screened.unpersist()
        del screened
        if len(todo) > 1:
            release(spark)
    return reduce(DataFrame.unionByName, found)


def links(store: Store, history: DataFrame, batch: DataFrame, ids: str, text: str, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (kind, fp, id) with kind 1 for history and 2 for the batch, of all classes that the batch
    has or is linked to; links (fa, fb, shared, total) between different classes of which one has a batch member.
    history: the texts behind the store."""
    mine = cut(_postings(batch, ids, text, store.order, 1, store.k, store.least_words, t, store.window))
    both = _all_candidates(store, mine, t)
    pairs = cut(both.groupBy("fa", "fb").agg(F.min("ka").alias("ka"), F.min("kb").alias("kb")))
    wanted = pairs.select("ka").union(pairs.select("kb"))
    texts = history.select(ids, text).unionByName(batch.select(ids, text))
    sets = cut(fetch_sets(texts, ids, text, wanted, store.k, store.least_words))
    found = cut(verify(pairs.select("fa", "fb"), sets, t))
    new = cut(_members(mine))
    classes = new.select("fp").union(found.select("fa")).union(found.select("fb")).distinct()
    classes = cut(classes.mapInArrow(_halves, "half bigint"))
    old = _members(store.rows, bloom_of(classes, filter_bits(classes.count())))
    return old.select(F.lit(1).alias("kind"), "fp", "id").union(new.select(F.lit(2), "fp", "id")).distinct(), found


def resolve(store: Store, batch: DataFrame, members: DataFrame, verified: DataFrame) -> DataFrame:
    """(id, seq, hash, repeats): for each batch posting the dedup_hash it repeats, NULL if it is accepted as new.
    batch: (id, seq, hash)."""
    seen = store.seen.select("id", "dedup_hash", "first_seen_at")
    old = members.where("kind = 1").join(seen, "id").groupBy("fp").agg(F.min(F.struct("first_seen_at", "dedup_hash")).alias("o"))
    one = members.where("kind = 2").groupBy("id").agg(F.min("fp").alias("c"))
    inc = batch.dropDuplicates(["id"]).join(one, "id", "left")
    inc = inc.join(seen.select(F.col("dedup_hash").alias("hash"), F.lit(True).alias("known")).distinct(), "hash", "left")
    classes = one.select("c").distinct()
    both = verified.select(F.col("fa").alias("c"), F.col("fb").alias("d"), "shared", "total").union(verified.select(F.col("fb"), F.col("fa"), "shared", "total"))
    near = both.join(classes, "c", "left_semi").select("c", "d", (F.col("shared") / F.col("total")).alias("sim")).union(classes.select("c", F.col("c").alias("d"), F.lit(1.0).alias("sim")))
    near = cut(near)
    from_old = near.join(old.withColumnRenamed("fp", "d"), "d").groupBy("c").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("o.first_seen_at").alias("f"), F.col("o.dedup_hash").alias("h"))).alias("old"))
    inc = cut(inc.join(from_old, "c", "left").select("id", "seq", "hash", "c", F.coalesce("known", F.lit(False)).alias("known"), "old"))
    undecided = inc.where("not known and old is null").select("id", "seq", "hash", "c")
    # every round derives who is accepted from who was accepted before; after round r all chains of length r are right
    accepted = cut(undecided)
    while True:
        by_hash = accepted.groupBy("hash").agg(F.min("seq").alias("h_seq"))
        by_class = accepted.where("c is not null").groupBy(F.col("c").alias("d")).agg(F.min("seq").alias("s"))
        reach = near.join(by_class, "d").groupBy("c").agg(F.min("s").alias("c_seq"))
        after = undecided.join(by_hash, "hash", "left").join(reach, "c", "left").where("(h_seq is null or h_seq >= seq) and (c_seq is null or c_seq >= seq)").select("id", "seq", "hash", "c")
        after = cut(after)
        changed = after.join(accepted, "id", "left_anti").union(accepted.join(after, "id", "left_anti")).limit(1).count()
        accepted = after
        if not changed:
            break
    by_hash = accepted.groupBy("hash").agg(F.min("seq").alias("h_seq"))
    by_class = accepted.where("c is not null").groupBy(F.col("c").alias("d")).agg(F.min(F.struct("seq", "hash")).alias("a"))
    # accepted posting of each class in reach; a class has at most one
    reach = near.join(by_class, "d").select("c", "sim", F.col("a.seq").alias("a_seq"), F.col("a.hash").alias("a_hash"))
    closest = inc.select("id", "c", "seq").join(reach, "c").where("a_seq < seq").groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "a_seq", "a_hash")).alias("new"))
    out = inc.join(by_hash, "hash", "left").join(closest, "id", "left")
    repeats = (
        F.when(F.col("known") | (F.col("h_seq") < F.col("seq")), F.col("hash"))
        .when(F.col("old").isNotNull() & (F.col("new").isNull() | (F.col("old.s") <= F.col("new.s"))), F.col("old.h"))
        .otherwise(F.col("new.a_hash"))
    )
    return out.select("id", "seq", "hash", repeats.alias("repeats"))


def update(store: Store, batch: DataFrame, ids: str, text: str, resolved: DataFrame, when: DataFrame) -> Store:
    """Store after the batch: accepted texts join postings and filters, and seen gains rows, counts and last dates.
    when: (id, at), the time of each batch posting."""
    new = resolved.where("repeats is null")
    texts = batch.join(new.select(F.col("id").alias(ids)), ids, "left_semi")
    spark = batch.sparkSession
    found, filters, _ = _add_part(spark, store.path, store.parts, _postings(texts, ids, text, store.order, 0, store.k, store.least_words, store.t, store.window), store.keys)
    at = resolved.join(when, "id")
    again = at.where("repeats is not null").groupBy(F.col("repeats").alias("dedup_hash")).agg(F.count(F.lit(1)).alias("more"), F.max("at").alias("last"))
    fresh = at.where("repeats is null").select("id", F.col("hash").alias("dedup_hash"), F.col("at").alias("first_seen_at"), F.lit(1).alias("times_seen"), F.col("at").alias("last_seen_at"))
    whole = store.seen.select(fresh.columns).unionByName(fresh).join(again, "dedup_hash", "left")
    seen = whole.select(
        "id", "dedup_hash", "first_seen_at",
        F.when(F.col("times_seen").isNotNull() | F.col("more").isNotNull(), F.coalesce("times_seen", F.lit(1)) + F.coalesce("more", F.lit(0))).cast("int").alias("times_seen"),
        F.greatest("last_seen_at", "last").alias("last_seen_at"),
    )
    return replace(store, rows=found, filters=filters, seen=seen, parts=store.parts + 1)


def incoming_against_seen(raw: DataFrame, seen: DataFrame, incoming: DataFrame, k: int, t: Threshold, least_words: int) -> tuple[Store, DataFrame, DataFrame]:
    """(store, incoming with its hash, resolution) of all incoming postings against the accepted ones."""
    accepted = seen.where(F.col("dedup_hash").isNotNull()).select(F.col("job_id").alias("id"), "dedup_hash", "first_seen_at", "times_seen", "last_seen_at")
    history = raw.select(F.col("job_id").alias("id"), F.col("description").alias("text"))
    batch = incoming.where("job_id is not null").select(F.col("job_id").alias("id"), F.col("description").alias("text"), "seq", "scraped_at", dedup_hash(F.col("title"), F.col("company"), F.col("location")).alias("hash"))
    store = build(history, "id", "text", accepted, k, least_words, t)
    members, verified = links(store, history, batch, "id", "text", t)
    return store, batch, resolve(store, batch.select("id", "seq", "hash"), members, verified)
