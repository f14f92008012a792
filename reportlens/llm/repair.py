"""Token ids in files of Re-Pair compressed shards, in ascending order of keys, with random access.

A shard holds some million ids of whole documents. Its frequent pairs of neighbouring ids are replaced
by new symbols, again and again; the file keeps the two symbols of each rule, how many ids it expands
to, the compressed sequence, and where each document begins in it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .arrays import text_slices
from .common import bound_batches, mapped
from .tokens import encoder

SHARD_IDS = 1 << 20
ROUNDS, RULES, LEAST = 10, 4096, 16        # rounds per shard, new rules per round, least count of a pair
HASH_BITS = 18


def _pairs(seq: np.ndarray, last: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent pairs that do not cross a document's end, as sorted numbers left << 32 | right."""
    left, right, inner = seq[:-1], seq[1:], ~last[:-1]
    slot = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA6B))) >> np.uint32(32 - HASH_BITS)
    slot = slot[inner]
    often = np.bincount(slot, minlength=1 << HASH_BITS) >= least         # a frequent pair has a frequent slot
    at = np.flatnonzero(inner)[often[slot]]
    pairs = np.sort((left[at].astype(np.uint64) << np.uint64(32)) | right[at])
    if not len(pairs):
        return pairs
    begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(begin, len(pairs)))
    names, counts = pairs[begin][counts >= least], counts[counts >= least]
    if len(names) > most:
        names = names[np.argsort(-counts, kind="stable")[:most]]
    return np.sort(names)


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, rules: int = RULES, least: int = LEAST) -> dict[str, np.ndarray]:
    """The grammar of documents that end before ends[i]; ids are unsigned 32-bit numbers."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    base = int(seq.max()) + 1 if len(seq) else 0
    lefts, rights, used = [], [], base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        names = _pairs(seq, last, least, rules)
        if not len(names):
            break
        pair = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        first = np.unique(names >> np.uint64(32))
        maybe = np.zeros(used, bool)
        maybe[first.astype(np.int64)] = True
        at = np.flatnonzero(maybe[seq[:-1]] & ~last[:-1])
        rule = np.minimum(np.searchsorted(names, pair[at]), len(names) - 1)
        ok = names[rule] == pair[at]
        at, rule = at[ok], rule[ok]
        # Overlapping matches stand next to each other: take every second one of such a run.
        new = np.concatenate([[True], np.diff(at) != 1])
        run = np.cumsum(new) - 1
        take = (np.arange(len(at)) - np.flatnonzero(new)[run]) % 2 == 0
        at, rule = at[take], rule[take]
        seq[at] = (used + rule).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        lefts.append((names >> np.uint64(32)).astype(np.uint32))
        rights.append((names & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        used += len(names)
    none = [np.zeros(0, np.uint32)]
    left, right = np.concatenate(lefts or none), np.concatenate(rights or none)
    sizes, at = np.ones(used, np.int64), base
    for a, b in zip(lefts, rights):
        sizes[at:at + len(a)] = sizes[a] + sizes[b]
        at += len(a)
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    full = np.concatenate([[0], np.cumsum(np.diff(ends, prepend=0) > 0)])
    return {"base": base, "left": left, "right": right, "sizes": sizes[base:], "seq": seq, "begin": bounds[full]}


def expand(seq: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that a compressed sequence stands for; every pass opens one level of all symbols."""
    while True:
        rule = seq >= base
        if not rule.any():
            return seq
        at = np.cumsum(rule) - rule + np.arange(len(seq))
        out = np.empty(len(seq) + int(rule.sum()), np.uint32)
        out[at] = seq
        own = seq[rule] - np.uint32(base)
        out[at[rule]], out[at[rule] + 1] = left[own], right[own]
        seq = out


@dataclass
class Shard:
    """One row of the files, decoded as far as needed."""
    base: int
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    seq: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(row) -> Shard:
        get = lambda c, kind: np.frombuffer(row[c], kind)
        low, high = get("seq_low", "<u2"), get("seq_high", "<u2")
        seq = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
        return Shard(row["base"], get("left", "<u4"), get("right", "<u4"), get("sizes", "<u4"), seq, get("begin", "<i8"))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the borders of documents in them."""
        each = self._sizes(self.seq)
        return expand(self.seq, self.base, self.left, self.right), np.concatenate([[0], np.cumsum(each)])[self.begin]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document i; only the symbols that reach into the range are expanded."""
        seq = self.seq[self.begin[i]:self.begin[i + 1]]
        upto = np.concatenate([[0], np.cumsum(self._sizes(seq))])
        stop = int(upto[-1]) if stop is None else min(stop, int(upto[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(upto, start, "right") - 1, np.searchsorted(upto, stop, "left")
        return expand(seq[a:b], self.base, self.left, self.right)[start - upto[a]:stop - upto[a]]

    def _sizes(self, seq: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(self.base, np.int64), self.sizes])[seq] if len(seq) else np.zeros(0, np.int64)


def _schema(key: T.DataType) -> T.StructType:
    fields = [("part", T.IntegerType()), ("shard", T.LongType()), ("n_ids", T.LongType()), ("n_docs", T.LongType()), ("keys", T.ArrayType(key)),
              ("base", T.LongType()), *[(c, T.BinaryType()) for c in ("left", "right", "sizes", "seq_low", "seq_high", "begin")]]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encodes docs, ends each with end_id, and writes shards in ascending order of key to path.

    One shuffle by ranges of the key; each task streams its sorted rows and holds one shard. Null texts
    are empty; null keys come first; rows of equal key are ordered by a hash of their text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = _schema(docs.schema[key].dataType)
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    order = [F.col(key), F.xxhash64(text)]
    rows = docs.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, held, size, shard = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            ids, ends = np.concatenate([h[1] for h in held]), np.cumsum(np.concatenate([h[2] for h in held]))
            g = compress(ids, ends)
            keys = pa.concat_arrays([h[0] for h in held])
            seq, n = g["seq"], len(ends)
            cells = {"part": [part], "shard": [shard], "n_ids": [len(ids)], "n_docs": [n], "base": [g["base"]],
                     "keys": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys),
                     "left": [g["left"].astype("<u4").tobytes()], "right": [g["right"].astype("<u4").tobytes()],
                     "sizes": [g["sizes"].astype("<u4").tobytes()], "seq_low": [(seq & np.uint32(0xFFFF)).astype("<u2").tobytes()],
                     "seq_high": [(seq >> np.uint32(16)).astype("<u2").tobytes()], "begin": [g["begin"].astype("<i8").tobytes()]}
            return pa.RecordBatch.from_arrays([cells[f.name] if isinstance(cells[f.name], pa.Array) else pa.array(cells[f.name], f.type) for f in arrow], schema=arrow)

        for batch in (b.slice(x, y - x) for b in batches for x, y in text_slices(b.column(1))):
            ids, borders = encoder(tokenizer).encode(batch.column(1))
            sizes = np.diff(borders) + 1
            upto = np.cumsum(sizes)
            whole = np.full(int(upto[-1]) if len(upto) else 0, end_id, np.uint32)
            inner = np.ones(len(whole), bool)
            inner[upto - 1] = False
            whole[inner] = ids
            at = 0
            while at < len(sizes):
                before = int(upto[at - 1]) if at else 0
                to = min(len(sizes), int(np.searchsorted(upto, before + shard_ids - size)) + 1)
                held.append((batch.column(0).slice(at, to - at), whole[before:upto[to - 1]], sizes[at:to]))
                size += int(upto[to - 1]) - before
                at = to
                if size >= shard_ids:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    bound_batches(rows)
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """(part, shard, first): ids of all shards before each; only the short columns are read.

    Sums per part come first, so one task sees one number per part, and a part's shards are summed apart.
    """
    rows = files.select("part", "shard", "n_ids")
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", upto.alias("before"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inner", inner).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("first"))


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    kind = files.schema["keys"].dataType.elementType.simpleString()
    names = files.columns

    def decode(batch):
        import pyarrow as pa
        out = {"part": [], "shard": [], "inner": [], "n_tokens": [], "ids_crc32": []}
        keys = []
        for i in range(batch.num_rows):
            row = {c: batch.column(k)[i].as_buffer() if pa.types.is_binary(batch.schema.types[k]) else batch.column(k)[i].as_py()
                   for k, c in enumerate(names) if c != "keys"}
            ids, borders = Shard.of(row).ids()
            ids = ids.astype("<u4")
            n = len(borders) - 1
            out["part"] += [row["part"]] * n
            out["shard"] += [row["shard"]] * n
            out["inner"] += borders[:-1].tolist()
            out["n_tokens"] += np.diff(borders).tolist()
            out["ids_crc32"] += [zlib.crc32(ids[a:b].data) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
            keys.append(batch.column(names.index("keys"))[i].values)
        return out | {key: pa.concat_arrays(keys)}

    docs = mapped(files, decode, f"`{key}` {kind}, part int, shard bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    found = docs.join(shard_starts(files), ["part", "shard"])
    return found.select(key, (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes docs to files (in the shared folder unless a path is given) and describes each document from them."""
    import uuid
    path = path or f"{shared_dir(docs.sparkSession)}/repair-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, key, text, end_id)
    return read_documents(docs.sparkSession.read.schema(_schema(docs.schema[key].dataType)).parquet(path), key)
