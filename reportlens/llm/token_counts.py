"""Token counts of whole texts in one map-side pass, without a shuffle of pre-tokens.

Texts are cut where the tokenizer always splits. The lengths of the most frequent pieces are in a compact
hash table that every task receives; a piece's first 15 bytes and its length are its key, so a hit is
exact. Pieces that are not in the table go to the worker's own memory, and what that does not know is
encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U64, mix, text_buffer
from .common import mapped
from .tokens import _cuts

FREQUENT = 1 << 15              # pieces in the table; it has twice as many slots of 18 bytes
PACKED = 15                     # bytes of the longest piece in it
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 32 << 10     # texts, and bytes of one, whose pieces are counted for the table
HEADS = 4096                    # pieces that one slice of the sample names
REMEMBERED, LONGEST = 200_000, 64               # pieces a worker remembers, and bytes of the longest
LIMIT = 512

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per run of bytes that name it if it has at most PACKED bytes."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    low = words[starts] & _MASKS[np.minimum(sizes, 8)]
    high = words[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 7)]
    return low, high | (np.minimum(sizes, 255).astype(U64) << U64(56))


@dataclass
class Lengths:
    """A hash table with open addressing: key halves and token counts; high = 0 is an empty slot."""
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    probes: int

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Lengths:
        size = 1 << max(4, int(2 * len(low) - 1).bit_length())
        table = Lengths(np.zeros(size, U64), np.zeros(size, U64), np.zeros(size, np.uint16), 1)
        for i, slot in enumerate(table._slot(low, high).tolist()):
            step = 0
            while table.high[(slot + step) % size]:
                step += 1
            at = (slot + step) % size
            table.low[at], table.high[at], table.count[at] = low[i], high[i], count[i]
            table.probes = max(table.probes, step + 1)
        return table

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & U64(len(self.low) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Token counts, -1 for what is not in the table."""
        out, left = np.full(len(low), -1, np.int64), np.arange(len(low))
        slot = self._slot(low, high)
        for step in range(self.probes):
            at = (slot + step) & (len(self.low) - 1)
            hit = (self.high[at] == high) & (self.low[at] == low)
            out[left[hit]] = self.count[at[hit]]
            on = ~hit & (self.high[at] != 0)
            if not on.any():
                break
            left, slot, low, high = left[on], slot[on], low[on], high[on]
        return out


_tokenizers: dict[str, object] = {}
_memory: dict[str, dict[str, int]] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def encoded_lengths(path: str, pieces: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]


def remembered_lengths(path: str, pieces: list[str]) -> np.ndarray:
    """Token counts of distinct pieces by the worker's memory; only new ones are encoded."""
    memory = _memory.setdefault(path, {})
    counts = [memory.get(x, -1) for x in pieces]
    new = [i for i, n in enumerate(counts) if n < 0]
    for i, n in zip(new, encoded_lengths(path, [pieces[i] for i in new])):
        counts[i] = n
        if len(pieces[i]) <= LONGEST:
            memory[pieces[i]] = n
    if len(memory) > REMEMBERED:
        memory.clear()
    return np.array(counts, np.int64)


def _pieces(column):
    """Bytes, borders of texts, and starts and sizes of the pieces of a text column."""
    data, borders = text_buffer(column)
    starts = _cuts(data, borders).astype(np.int64)
    return data, borders, starts, np.diff(np.append(starts, len(data)))


def _strings(data: np.ndarray, starts: np.ndarray):
    import pyarrow as pa
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def counted(column, path: str, table: Lengths) -> np.ndarray:
    """Tokens of each text of a column; null is an empty text."""
    import pyarrow as pa
    data, borders, starts, sizes = _pieces(column)
    if not len(starts):
        return np.zeros(len(borders) - 1, np.int64)
    counts = table.find(*packed(data, starts, sizes))
    missed = np.flatnonzero(counts < 0)
    if len(missed):
        distinct = _strings(data, starts).take(pa.array(missed)).dictionary_encode()
        counts[missed] = remembered_lengths(path, distinct.dictionary.to_pylist())[distinct.indices.to_numpy()]
    upto = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(upto[np.searchsorted(starts, borders)])


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> Lengths:
    """The table of the most frequent pieces of a sample of some sample_rows texts of at most SAMPLE_BYTES.

    The sample only decides which pieces are looked up in the table, never a count. Every slice of it
    names at most HEADS pieces, so the driver sees few.
    """
    import pyarrow as pa
    n = docs.count()
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.sample(min(1.0, sample_rows / max(n, 1)), seed=1)

    def heads(batch):
        data, _, starts, sizes = _pieces(batch.column(0))
        short = np.flatnonzero(sizes <= PACKED)
        seen = _strings(data, starts).take(pa.array(short)).value_counts()
        counts = seen.field("counts").to_numpy()
        top = np.argsort(-counts, kind="stable")[:HEADS]
        return {"piece": seen.field("values").take(pa.array(top)).cast(pa.string()), "n": counts[top]}

    total: dict[str, int] = {}
    for piece, k in mapped(rows, heads, "piece string, n bigint", "text").toLocalIterator():
        total[piece] = total.get(piece, 0) + k
    pieces = sorted(total, key=lambda x: (-total[x], x))[:most]
    raw = [x.encode() for x in pieces]
    sizes = np.array([len(x) for x in raw], np.int64)
    low, high = packed(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return Lengths.of(low, high, np.array(encoded_lengths(tokenizer, pieces), np.uint16))


def _pieced_lengths(column, path: str) -> np.ndarray:
    """Tokens of each text by sentencepiece, which knows no pre-tokens: whole texts."""
    if path not in _tokenizers:
        import sentencepiece
        _tokenizers[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([len(x) for x in _tokenizers[path].encode([x or "" for x in column.to_pylist()], num_threads=1)], np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of docs, as the tokenizer's library counts them.

    tokenizer is the path of a byte-level or lower-casing BPE file of the tokenizers library (.json), or of
    a sentencepiece file (.model), whose texts are encoded whole. Null and empty texts have 0 bytes and
    tokens. Rows are counted one by one, so null and repeated keys stay as they are; an empty table gives
    no rows; other columns are not read. Texts of any length are counted whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    table = None if tokenizer.endswith(".model") else spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text, sample_rows))

    def count(batch):
        column = batch.column(1)
        n = _pieced_lengths(column, tokenizer) if table is None else counted(column, tokenizer, table.value)
        return {key: batch.column(0), "n_bytes": np.diff(text_buffer(column)[1]), "n_tokens": n, "over_limit": n > limit}

    return mapped(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), count, schema, "_text")
