"""Benchmark passages in documents: CGK embedding of word windows, bit-sampling LSH, exact edit distance.

The CGK walk turns a word sequence into a string of three times its length: at step j it writes the
current word and moves on if a random bit of (j, word) says so. Sequences a few edits apart give strings
a small Hamming distance apart, so tables that sample a few places of the string bring them together.
Where a window of an item's length meets an item in some table, the item is compared by edit distance to
every run of words around it, so a passage may be longer or shorter than its item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_ALNUM, U64, Words, chain, inside, mix, text_slices, words_of
from .common import mapped

EDITS = 0.2                 # edits per word of the item
WALKS, TABLES, PLACES = 8, 8, 3
GRAM = 3
MARK_BITS = 20
MAX_ITEMS, MAX_BYTES = 20_000, 32 << 20     # items of one block, and their bytes
MAX_CELLS = 1 << 20                         # words of texts that are compared at once
SEED = 0x51ED270B


def allowed_edits(n_words: int) -> int:
    return int(EDITS * n_words)


def embed(sequences: np.ndarray, walk: int) -> np.ndarray:
    """(rows, 3 L) CGK strings of (rows, L) word hashes; past the end it writes 0."""
    n, size = sequences.shape
    padded = np.concatenate([sequences, np.zeros((n, 1), U64)], axis=1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, 3 * size), U64)
    for j in range(3 * size):
        word = padded[rows, at]
        out[:, j] = word
        at += ((mix(word + U64((SEED + walk * 1_000_003 + j) & (2**64 - 1))) & U64(1)) == 1) & (at < size)
    return out


def table_keys(sequences: np.ndarray) -> np.ndarray:
    """(rows, WALKS * TABLES) keys: hashes of the words at PLACES sampled places of each walk's string."""
    n, size = sequences.shape
    keys = np.empty((n, WALKS * TABLES), U64)
    for walk in range(WALKS):
        string = embed(sequences, walk)
        draws = np.random.default_rng([SEED, walk, size])
        for t in range(TABLES):
            k = walk * TABLES + t
            acc = np.full(n, (size << 16) + k, U64)
            for place in draws.choice(3 * size, min(PLACES, 3 * size), replace=False):
                acc = mix(acc) + string[:, place]
            keys[:, k] = mix(acc)
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of row i of a to row i of b, all rows at once."""
    n, size = a.shape
    before = np.tile(np.arange(b.shape[1] + 1), (n, 1))
    steps = np.arange(b.shape[1] + 1)
    for i in range(size):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        np.minimum(before[:, 1:] + 1, before[:, :-1] + (a[:, i:i + 1] != b), out=now[:, 1:])
        # Insertions run along the row: a running minimum without the slope.
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    return before[:, -1]


def nearest_runs(items: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, first word and words of the run of texts[i, :sizes[i]] nearest to items[i]; the first, then shortest at a tie."""
    unit = 1 << 32                                         # a cell holds edits * unit + first word of the run
    steps = np.arange(texts.shape[1] + 1)
    before = np.tile(steps, (len(items), 1))
    steps = steps * unit
    for i in range(items.shape[1]):
        now = np.empty_like(before)
        now[:, 0] = (i + 1) * unit
        np.minimum(before[:, 1:] + unit, before[:, :-1] + (items[:, i:i + 1] != texts) * unit, out=now[:, 1:])
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    before[np.arange(texts.shape[1] + 1) > sizes[:, None]] = np.iinfo(np.int64).max
    end = before.argmin(axis=1)
    least = before[np.arange(len(items)), end]
    return least // unit, least % unit, end - least % unit


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    out = np.zeros(len(values), bool)
    if len(known):
        marks = np.zeros(1 << MARK_BITS, bool)             # most values end at this small table
        marks[(known >> U64(64 - MARK_BITS)).astype(np.int64)] = True
        at = np.flatnonzero(marks[(values >> U64(64 - MARK_BITS)).astype(np.int64)])
        own = values[at]
        out[at] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    return out


@dataclass
class Index:
    """Items of one block: by length, ids, word hashes, sorted table keys and their items, grams; the grams of all items."""
    groups: dict[int, tuple[np.ndarray, ...]]
    grams: np.ndarray

    @staticmethod
    def of(ids: list[int | None], texts: list[str]) -> Index:
        import pyarrow as pa
        words = words_of(pa.array(texts, pa.string()), NOT_ALNUM, lower=True)
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(words.counts.tolist()):
            if n:
                by_size.setdefault(n, []).append(i)
        groups = {}
        for n, own in sorted(by_size.items()):
            seq = np.stack([words.hashes[words.ptr[i]:words.ptr[i + 1]] for i in own])
            keys = table_keys(seq).reshape(-1)
            item = np.repeat(np.arange(len(own)), WALKS * TABLES)
            order = np.argsort(keys, kind="stable")
            grams = np.unique(np.concatenate([chain(row, GRAM) for row in seq]))
            groups[n] = np.array([ids[i] for i in own], object), seq, keys[order], item[order], grams
        return Index(groups, np.unique(chain(words.hashes, GRAM)[inside(words, GRAM)]))

    def found(self, column) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item, first word, words, edits): the nearest, then first, run of words of each text and item.

        Each edit changes at most GRAM of an item's n - GRAM + 1 grams, and also at most GRAM of the grams of a
        run that is longer. So a window of n words that covers the run, or lies in it, keeps n - GRAM + 1 - GRAM
        edits of them, and so does a whole text of fewer words. Others are left out without loss.
        """
        needs = {n: n - GRAM + 1 - GRAM * allowed_edits(n) for n in self.groups}
        least = max(1, min((x for x in needs.values() if x > 0), default=1))
        likely, texts, best = [], [np.zeros(0, np.int64)], {}
        for at, to in text_slices(column):
            words = words_of(column.slice(at, to - at), NOT_ALNUM, lower=True)
            known = _within(chain(words.hashes, GRAM), self.grams) & inside(words, GRAM)
            upto = np.concatenate([[0], np.cumsum(known), np.full(min(GRAM - 1, len(words.hashes)), known.sum())])
            part, own = words.part(upto[words.ptr[1:]] - upto[words.ptr[:-1]] >= least)
            likely.append(part)
            texts.append(own + at)
            for n in self.groups:
                if needs[n] <= 0:
                    self._search(words, np.arange(at, to), n, 0, best)
        words, texts = Words.joined(likely), np.concatenate(texts)
        for n in self.groups:
            if needs[n] > 0:
                self._search(words, texts, n, needs[n], best)
        return [(text, i, first, size, e) for (text, i), (e, first, size) in sorted(best.items(), key=lambda b: (b[0][0], b[0][1] is not None, b[0][1] or 0))]

    def _search(self, words: Words, texts: np.ndarray, n: int, need: int, best: dict) -> None:
        owner, k = words.owner(), allowed_edits(n)
        ids, seq, keys, item, grams = self.groups[n]
        starts = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
        short = words.ptr[:-1][(words.counts < n) & (words.counts >= max(1, n - k))]      # these texts are one window
        starts = np.sort(np.concatenate([starts, short]))
        if need > 0 and len(starts):
            ends = np.minimum(starts + n, words.ptr[1:][owner[starts]])
            upto = np.concatenate([[0], np.cumsum(_within(chain(words.hashes, GRAM), grams))])
            starts = starts[upto[ends - GRAM + 1] - upto[starts] >= need]
        for block in np.array_split(starts, -(-len(starts) // 4096)) if len(starts) else []:
            ends = words.ptr[1:][owner[block]]
            mine = table_keys(_runs(words.hashes, block, ends, n))
            lo, hi = np.searchsorted(keys, mine, "left").reshape(-1), np.searchsorted(keys, mine, "right").reshape(-1)
            size = hi - lo
            if not size.any():
                continue
            row = np.repeat(np.repeat(np.arange(len(block)), mine.shape[1]), size)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            # Windows whose starts are at most k words apart share one look at the words around them.
            first = words.ptr[:-1][owner[block]]
            cell = first + (block - first) // (k + 1) * (k + 1)
            pairs = np.unique(np.stack([cell[row], item[at]], axis=1), axis=0)
            width = n + 5 * k
            for pair in np.array_split(pairs, -(-len(pairs) * width // MAX_CELLS)):
                text = owner[pair[:, 0]]
                begin = np.maximum(pair[:, 0] - 2 * k, words.ptr[:-1][text])
                stop = np.minimum(pair[:, 0] + n + 3 * k, words.ptr[1:][text])
                edits, run, size = nearest_runs(seq[pair[:, 1]], _runs(words.hashes, begin, stop, width), stop - begin)
                for r in np.flatnonzero(edits <= k).tolist():
                    name = int(texts[text[r]]), ids[pair[r, 1]]
                    new = int(edits[r]), int(begin[r] + run[r] - words.ptr[text[r]]), int(size[r])
                    if name not in best or new < best[name]:
                        best[name] = new


def _runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) hashes from each start; 0 from its end on."""
    at = starts[:, None] + np.arange(n)
    return np.where(at < ends[:, None], hashes[np.minimum(at, len(hashes) - 1)], U64(0))


def blocks(benchmark: DataFrame, item: str, text: str):
    """Indexes over blocks of items, each of bounded size, so a benchmark of any size can be held against."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // MAX_ITEMS), -(-size // MAX_BYTES))
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        got = sorted(own.distinct().collect(), key=lambda r: (r["item"] is not None, r["item"] or 0, r["text"]))
        yield Index.of([r["item"] for r in got], [r["text"] for r in got])


HITS = "array<struct<item:bigint,first:bigint,words:bigint,edits:bigint>>"


def _hits(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """row (all columns) and hits of every row of docs; texts stay where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(index)          # at most MAX_ITEMS items, MAX_BYTES of text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_t", F.col(f"row.`{text}`"))

    def find(batch):
        out = [[] for _ in range(batch.num_rows)]
        for at, item, first, n, edits in sent.value.found(batch.column(1)):
            out[at].append({"item": item, "first": first, "words": n, "edits": edits})
        return {"row": batch.column(0), "hits": out}

    return mapped(rows, find, f"row {rows.schema['row'].dataType.simpleString()}, hits {HITS}")


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Struct row and hits (item, first word, words, edits) for each row of docs.

    Words are runs of letters and digits, A-Z lower-cased. A hit is a run of words, or a whole text, within
    0.2 edits a word of the item: the nearest run, the first and then the shortest one at a tie. Null and empty texts have none. Items with
    equal ids count once, those with a null id as well; repeated rows count each. Documents stream past the items in blocks of bounded size.
    """
    rows = None
    for index in blocks(benchmark, item, item_text):
        if rows is None:
            rows = _hits(docs, index, text)
        else:
            more = _hits(rows, index, f"row`.`{text}").withColumnRenamed("hits", "more")
            rows = more.select(F.col("row.row").alias("row"), F.concat("row.hits", "more").alias("hits"))
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, item_id, first_word, n_words, edits) of every row; the nearest item, then the smallest."""
    rows = with_hits(docs.select(key, text), benchmark, text, item, item_text)
    best = F.array_min(F.transform("hits", lambda h: F.struct(h["edits"].alias("edits"), h["item"].alias("item"), h["first"].alias("first"), h["words"].alias("words"))))
    rows = rows.select(F.col(f"row.`{key}`").alias(key), F.size(F.array_distinct(F.transform("hits", lambda h: h["item"]))).cast("bigint").alias("n_items"), best.alias("best"))
    return rows.select(key, (F.col("n_items") > 0).alias("contaminated"), "n_items", F.col("best.item").alias("item_id"),
                       F.col("best.first").alias("first_word"), F.col("best.words").alias("n_words"), F.col("best.edits").alias("edits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a hit, with their own columns only."""
    return with_hits(docs, benchmark, text, item, item_text).where(F.size("hits") == 0).select("row.*")
