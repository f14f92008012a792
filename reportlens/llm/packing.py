"""Packing of tokenized documents into sequences: dominance reduction, then best fit.

Documents of equal length are alike, so the whole instance is a count per length, at most `capacity`
numbers however many documents there are. The plan made from the counts says which lengths share a
sequence and how often; the documents then look up their place by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, numbered, written
from .tokens import encoder

CAPACITY = 4096
ROWS_PER_BUCKET = 50_000


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32): documents as token ids with an end id, cut only beyond the capacity."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batch):
        ids, borders = encoder(tokenizer).encode(batch.column(1))
        n = np.diff(borders) + 1
        out_of, at = np.repeat(np.arange(len(n)), -(-n // capacity)), []
        for k in (-(-n // capacity)).tolist():
            at.append(np.arange(k))
        at = np.concatenate(at)
        start = at * capacity
        length = np.minimum(n[out_of] - start, capacity)
        crc, ids, base, last = [], ids.astype("<u4"), borders[:-1][out_of], borders[1:][out_of]
        tail = np.array([end_id], "<u4").tobytes()
        for b, s, k, e in zip(base.tolist(), start.tolist(), length.tolist(), last.tolist()):
            body = ids[b + s:min(b + s + k, e)].data
            crc.append(zlib.crc32(body) if b + s + k <= e else zlib.crc32(tail, zlib.crc32(body)))
        return {key: batch.column(0).take(_int(out_of)), "piece": at, "start": start, "length": length, "ids_crc32": crc}

    return mapped(docs.select(key, text), cut, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", text)


def _int(values):
    import pyarrow as pa
    return pa.array(values, pa.int64())


class Instance:
    """Counts per length, with the sorted lengths that are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = Counter({k: n for k, n in counts.items() if n > 0})
        self.sizes, self.capacity = sorted(self.left), capacity

    def take(self, lengths: list[int], times: int) -> None:
        for size, n in Counter(lengths).items():
            self.left[size] -= n * times
            if not self.left[size]:
                del self.left[size]
                del self.sizes[bisect_left(self.sizes, size)]

    def times(self, lengths: list[int]) -> int:
        """How often the set can be taken."""
        return min(self.left[size] // n for size, n in Counter(lengths).items())

    def fitting(self, room: int, without: int | None = None) -> int | None:
        """The largest length left that fits, if one more of `without` is spoken for."""
        at = bisect_left(self.sizes, room + 1) - 1
        while at >= 0:
            if self.left[self.sizes[at]] > (self.sizes[at] == without):
                return self.sizes[at]
            at -= 1
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        out = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.left[size] - (size == without))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two lengths that fits, 0 if no two do."""
        free = {s: self.left[s] - (s == without) for s in self.sizes if s <= room}
        sizes, best, hi = [s for s in self.sizes if s <= room and free[s] > 0], 0, 0
        hi = len(sizes) - 1
        for lo, a in enumerate(sizes):
            while hi >= lo and (a + sizes[hi] > room or (hi == lo and free[a] < 2)):
                hi -= 1
            if hi < lo:
                break
            best = max(best, a + sizes[hi])
        return best


def reduce_instance(instance: Instance) -> list[tuple[list[int], int]]:
    """Sequences that some best packing contains: (lengths, times), taken out of the instance.

    For each length, largest first, let k be the largest other that fits beside it. {length} is fixed if
    there is none. {length, k} is fixed if k fills the room exactly, or if no three others fit and no two
    others that fit sum to more than k: whatever else stood beside the length could move to k's place.
    """
    fixed, at = [], instance.capacity
    while True:
        spot = bisect_left(instance.sizes, at + 1) - 1
        if spot < 0:
            return fixed
        at = instance.sizes[spot]
        room = instance.capacity - at
        k = instance.fitting(room, at)
        if k is None:
            chosen, times = [at], (instance.left[at] if 2 * at > instance.capacity else 1)
        elif k == room:
            chosen = [at, k]
            times = instance.times(chosen)
        else:
            low = instance.smallest(3, at)
            if len(low) == 3 and sum(low) <= room:
                at -= 1
                continue
            if len(low) >= 2 and low[0] + low[1] <= room and instance.best_pair(room, at) > k:
                at -= 1
                continue
            chosen = [at, k]
            times = instance.times(chosen)          # what is taken out can only leave fewer other sets
        instance.take(chosen, times)
        fixed.append((chosen, times))


def best_fit(instance: Instance) -> list[tuple[list[int], int]]:
    """Best fit decreasing by counts: each length goes where the least room remains, many at a time."""
    rooms: dict[int, Counter] = {}                 # room left -> contents -> times
    order: list[int] = []

    def put(contents: tuple, times: int) -> None:
        room = instance.capacity - sum(contents)
        if room not in rooms:
            rooms[room] = Counter()
            insort(order, room)
        rooms[room][contents] += times

    for size in sorted(instance.left, reverse=True):
        n = instance.left[size]
        while n:
            spot = bisect_left(order, size)
            if spot == len(order):
                full = instance.capacity // size
                if n >= full:
                    put((size,) * full, n // full)
                    n %= full
                if n:
                    put((size,) * n, 1)
                break
            room = order[spot]
            contents, times = min(rooms[room].items())
            each = min(room // size, n)
            moved = min(times, n // each)
            if moved == times:
                del rooms[room][contents]
                if not rooms[room]:
                    del rooms[room]
                    del order[spot]
            else:
                rooms[room][contents] -= moved
            put(contents + (size,) * each, moved)
            n -= moved * each
    return [(list(c), t) for contents in rooms.values() for c, t in sorted(contents.items())]


@dataclass
class Plan:
    """For each length, runs of places: (first rank, first sequence, places per sequence, offset in it)."""
    runs: dict[int, np.ndarray]
    sequences: int
    fixed: int
    bound: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of the counts; fixed sequences are those of the reduction, bound is the least number there can be."""
    total = sum(k * n for k, n in counts.items())
    instance = Instance(counts, capacity)
    fixed = reduce_instance(instance)
    groups = fixed + best_fit(instance)
    runs, used, sequence = {k: [] for k in counts}, Counter(), 0
    for lengths, times in groups:
        offset = 0
        for size, n in Counter(lengths).items():
            runs[size].append((used[size], sequence, n, offset))
            used[size] += n * times
            offset += size * n
        sequence += times
    assert used == Counter({k: n for k, n in counts.items() if n})
    return Plan({k: np.array(v, np.int64) for k, v in runs.items() if v}, sequence, sum(t for _, t in fixed), -(-total // capacity))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    The driver sees a count per length. Pieces get their rank within the length in two levels and look
    the rank up in the plan, whose size depends on the capacity only. Null and empty texts are one end
    id. Rows that repeat are packed as often as they occur.
    """
    parts = written(pieces(docs, tokenizer, key, text, end_id, capacity))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity).runs)
    columns = parts.columns
    buckets = max(4, -(-max(counts.values(), default=0) // ROWS_PER_BUCKET))
    ranked = numbered(parts, ["length"], [key, "piece", "ids_crc32"], F.xxhash64(key, "piece", "ids_crc32"), buckets, "rank")

    def place(batch):
        length, rank = batch.column(columns.index("length")).to_numpy(), batch.column(len(columns)).to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            size = int(length[own[0]])
            runs = made.value[size]
            run = runs[np.searchsorted(runs[:, 0], rank[own], "right") - 1]
            within = rank[own] - run[:, 0]
            sequence[own] = run[:, 1] + within // run[:, 2]
            offset[own] = run[:, 3] + within % run[:, 2] * size
        return {c: batch.column(i) for i, c in enumerate(columns)} | {"sequence_id": sequence, "offset": offset}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return mapped(ranked.select(*columns, "rank"), place, schema + ", sequence_id bigint, offset bigint")
