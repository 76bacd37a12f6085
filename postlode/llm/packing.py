"""Filling fixed-capacity containers with items of varying length, dividing only items larger than a container.

Items go by a hash of their id into blocks of about BLOCK_ITEMS, so that a block fits one task whatever the number of
rows, and each block is packed on its own. A block of tens of thousands of items leaves at most a few containers less
than full, so blocks cost next to nothing; their number follows from the number of items.

Within a block, Martello-Toth dominance: for each item, largest first, a set that dominates every other way to fill its
container is fixed for good and the instance shrinks. With a = the largest item that fits beside it:
* nothing fits: the item alone;
* a fills the container exactly, or no two items fit: the item and a;
* no three items fit, and a is at least as long as any two that do: the item and a;
* no three items fit, b is the largest item beside a, and no two items longer than b fit together: the item, a and b.
Every test is made over all items that are still open, so a fixing stays valid whatever was undecided before it; an
undecided item stays open as a partner for the others and is tried again once the instance has shrunk. What no pass
decides goes best-fit in descending order. `fixed` tells the items of containers that dominance fixed.

Items larger than the capacity are cut into full containers and one remainder, which is packed like an item.

A task reads its blocks one after the other in sorted order and holds one block at a time.

Defined cases: NULL texts and items of no tokens take no room and get a NULL container; ties keep the order of ids;
repeated rows are items of their own; an empty table gives no rows; extra columns are ignored. A NULL id is packed too.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 20_000
# Passes of the reduction over what is still open, and tasks that share the blocks.
PASSES = 4
MOST_TASKS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabulary of 50,257 entries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ids: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row; the tokenizer's file is read on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "tokens"])

    return df.select(F.col(ids).cast("bigint"), text).mapInArrow(run, "id bigint, tokens bigint")


class _Pool:
    """Open items by size: the distinct sizes ascending, and the positions of each."""

    def __init__(self, sizes: list[int]):
        self.at: dict[int, list[int]] = {}
        for i, s in reversed(list(enumerate(sizes))):
            self.at.setdefault(s, []).append(i)
        self.sizes = sorted(self.at)

    def take(self, size: int) -> int:
        held = self.at[size]
        i = held.pop()
        if not held:
            self.sizes.pop(bisect_left(self.sizes, size))
        return i

    def put(self, size: int, i: int) -> None:
        if not self.at[size]:
            insort(self.sizes, size)
        self.at[size].append(i)

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """Sizes of the n smallest items longer than `above`."""
        out: list[int] = []
        for s in islice(self.sizes, bisect_right(self.sizes, above), None):
            out += [s] * min(n - len(out), len(self.at[s]))
            if len(out) == n:
                break
        return out

    def best_two(self, room: int) -> int:
        """Largest sum of two items that fits the room."""
        a, b, best = 0, bisect_right(self.sizes, room) - 1, 0
        while a <= b:
            p, q = self.sizes[a], self.sizes[b]
            if p + q > room or (a == b and len(self.at[p]) < 2):
                b -= 1
            else:
                best = max(best, p + q)
                a += 1
        return best


def _dominating(pool: _Pool, room: int) -> tuple[int, ...] | None:
    """Sizes of the partners that dominate every other filling of the room, None if there are none such for certain."""
    at = bisect_right(pool.sizes, room)
    if not at:
        return ()
    a = pool.sizes[at - 1]
    least = pool.smallest(3)
    if a == room or len(least) < 2 or least[0] + least[1] > room:
        return (a,)
    if len(least) == 3 and sum(least) <= room:
        return None
    if a >= pool.best_two(room):
        return (a,)
    # b is not a itself unless there are two of that size
    below = bisect_right(pool.sizes, room - a)
    if below and pool.sizes[below - 1] == a and len(pool.at[a]) < 2:
        below -= 1
    if not below:
        return None
    b = pool.sizes[below - 1]
    held = pool.smallest(3, above=b)
    if b < a:
        held.remove(a) if a in held else None
    return (a, b) if len(held) < 2 or held[0] + held[1] > room else None


def reduce_dominated(sizes: list[int], capacity: int, passes: int = PASSES) -> tuple[list[list[int]], list[int]]:
    """(containers fixed by dominance, what remains), both as positions in `sizes`, which is descending."""
    pool = _Pool(sizes)
    fixed: list[list[int]] = []
    for _ in range(passes):
        before = len(fixed)
        undecided = {s: len(v) for s, v in pool.at.items()}
        for s in sorted(undecided, reverse=True):
            while undecided[s] > 0 and pool.at[s]:
                undecided[s] -= 1
                i = pool.take(s)
                found = _dominating(pool, capacity - s)
                if found is None:
                    # equal items have equal partners: none of them is decided now
                    pool.put(s, i)
                    break
                fixed.append([i, *(pool.take(x) for x in found)])
        if len(fixed) == before:
            break
    return fixed, sorted(i for held in pool.at.values() for i in held)


def best_fit(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Best fit over the positions in `order` (descending sizes)."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in order:
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], b))
    return bins


def pack_block(sizes: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Containers as lists of positions in `sizes`, and how many of the first are fixed by dominance; every size is from
    1 to the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ordered = [sizes[i] for i in order]
    fixed, rest = reduce_dominated(ordered, capacity)
    return [[order[i] for i in b] for b in fixed + best_fit(ordered, rest, capacity)], len(fixed)


SCHEMA = "capacity_id int, container string, doc_id bigint, part int, first_token bigint, tokens bigint, fixed boolean"


def _packed_block(block: int, ids: list[int | None], tokens: list[int], cid: int, cap: int) -> pa.RecordBatch:
    parts: list[tuple[int | None, int, int, int]] = []
    out: list[tuple] = []
    made = 0
    for i, n in zip(ids, tokens, strict=True):
        part = 0
        if n == 0:
            out.append((cid, None, i, 0, 0, 0, False))
            continue
        while n - part * cap > cap:
            out.append((cid, f"{block}-{made}", i, part, part * cap, cap, False))
            made, part = made + 1, part + 1
        parts.append((i, part, part * cap, n - part * cap))
    containers, fixed = pack_block([p[3] for p in parts], cap)
    for k, members in enumerate(containers):
        out.extend((cid, f"{block}-{made}", *parts[i], k < fixed) for i in members)
        made += 1
    cols = list(zip(*out, strict=True))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["capacity_id", "container", "doc_id", "part", "first_token", "tokens", "fixed"])


def pack(items: DataFrame, capacities: list[tuple[int, int]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(capacity_id, container, doc_id, part, first_token, tokens, fixed): items (id, tokens) packed once for each
    capacity."""
    total = items.count()
    blocks = max(1, -(-total // block_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block: one block is held at a time
        held: tuple[int, list, list] | None = None
        for b in batches:
            block, ids, tokens = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_pylist(), b.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0] != block[x]:
                    yield from (_packed_block(*held, cid, cap) for cid, cap in capacities)
                    held = None
                held = held or (int(block[x]), [], [])
                held[1].extend(ids[x:y])
                held[2].extend(tokens[x:y])
        if held:
            yield from (_packed_block(*held, cid, cap) for cid, cap in capacities)

    placed = items.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return placed.repartition(min(blocks, MOST_TASKS), "block").sortWithinPartitions("block", "id", "tokens").mapInArrow(run, SCHEMA)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, tokens, filled, by_dominance): how full the containers are, and how many items are in
    containers that dominance fixed."""
    used = packed.where("container is not null").groupBy("capacity_id", "container").agg(F.sum("tokens").alias("tokens"), F.count_if("fixed").alias("fixed"))
    per = used.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("fixed").alias("by_dominance"))
    filled = (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled")
    return per.join(capacities.select("capacity_id", "capacity_tokens"), "capacity_id").select("capacity_id", "containers", "tokens", filled, "by_dominance")
