"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has SYMBOLS 16-bit symbols, one per MinHash function; two sets differ in a symbol with
probability 1 - J. Signatures within MAX_DIFFERENT symbols are found without loss: cut into CHUNKS
chunks, two of them have a chunk with at most MAX_DIFFERENT // CHUNKS different symbols, and leaving out
each allowed choice of symbols of a chunk gives the keys they must share. At J = 0.75 a pair differs in
more symbols with probability 2e-4 and less above. Of the pairs found, those go on to the full shingle sets whose second
sketch, the least hash of each of BINS ranges of hashes, does not rule the similarity out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .arrays import U64, mix, shingle_sets, words_of
from .common import mapped, written

SHINGLE = 5
SYMBOLS, MAX_DIFFERENT, CHUNKS = 32, 17, 9
BINS, DEVIATIONS = 512, 3.7     # of the sketch; standard deviations below the similarity that it may fall
PERCENT = 75                    # least similarity
MAX_BROADCAST_IDS = 1_000_000
TILE_ROWS = 2048                # rows of one block of a large bucket
SMALL_BUCKET = 16               # buckets up to this size share tasks
ROWS_PER_BIN = 2_000
PARTNERS = [1, None]            # a node's likest partners in a tile that a round compares; the last round takes all

_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FACTORS = mix(_SEEDS) | U64(1)


def key_choices(symbols: int = SYMBOLS, chunks: int = CHUNKS, different: int = MAX_DIFFERENT) -> list[tuple[int, ...]]:
    """The symbols that make up each key: every chunk without each choice of its allowed errors."""
    allowed = different // chunks
    out = []
    for chunk in np.array_split(np.arange(symbols), chunks):
        if len(chunk) <= allowed:
            raise ValueError("chunks must be longer than the errors they allow")
        out += [tuple(x) for x in combinations(chunk.tolist(), len(chunk) - allowed)]
    return out


def signatures(sets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) 16-bit symbols; texts with an empty set get zeros."""
    out = np.zeros((len(borders) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(borders))
    step = 1 << 17
    at = 0
    while at < len(full):                              # blocks of whole texts that stay in cache
        to = max(at + 1, int(np.searchsorted(borders[full], borders[full[at]] + step)))
        begin, rows = borders[full[at]], full[at:to]
        part, cuts = sets[begin:borders[rows[-1] + 1]], borders[rows] - begin
        for k in range(SYMBOLS):
            lows = np.minimum.reduceat((part ^ _SEEDS[k]) * _FACTORS[k], cuts)
            out[rows, k] = (mix(lows) >> U64(48)).astype(np.uint16)
        at = to
    return out


def sketches(sets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(texts, BINS) bytes: of the hashes in each range the least one's, 0 where there is none."""
    out = np.zeros((len(borders) - 1, BINS), np.uint8)
    owner, bins = np.repeat(np.arange(len(borders) - 1), np.diff(borders)), (sets >> U64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])])) if len(sets) else []
    if len(first):                                     # sets are sorted, so ranges are runs and start with their least
        out[owner[first], bins[first]] = (mix(sets[first]) % U64(255)).astype(np.uint8) + np.uint8(1)
    return out


def _fingerprints(sets: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that together name it."""
    out = []
    for seed in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(sets + U64(seed)))])
        out.append(mix(sums[borders[1:]] - sums[borders[:-1]] + np.diff(borders).astype(U64)).view(np.int64))
    return out[0], out[1]


def _rows(matrix: np.ndarray):
    import pyarrow as pa
    n, width = matrix.shape
    flat = np.ascontiguousarray(matrix).view(np.uint8).reshape(-1)
    width *= matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, f1, f2, sig, sketch) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batch):
        sets, borders = shingle_sets(words_of(batch.column(1), lower=True), SHINGLE)
        f1, f2 = _fingerprints(sets, borders)
        return {"id": batch.column(0), "n_shingles": np.diff(borders), "f1": f1, "f2": f2, "sig": _rows(signatures(sets, borders)),
                "sketch": _rows(sketches(sets, borders))}

    return mapped(docs.select(F.col(key).alias("id"), text), sign, f"id {kind}, n_shingles bigint, f1 bigint, f2 bigint, sig binary, sketch binary", text)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, choice, node): the keys of each class's signature, and which choice of symbols each is made of."""
    choices = key_choices()
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("choice", T.IntegerType()), classes.schema["node"]])

    def keys(batch):
        sig = _matrix(batch.column(1), np.uint16, SYMBOLS).astype(U64)
        out = np.empty((len(sig), len(choices)), np.int64)
        for k, choice in enumerate(choices):
            acc = np.full(len(sig), k + 1, U64)
            for c in choice:
                acc = mix(acc) + sig[:, c]
            out[:, k] = mix(acc).view(np.int64)
        return {"key": out.reshape(-1), "choice": np.tile(np.arange(len(choices)), len(sig)), "node": batch.column(0).take(_indices(np.repeat(np.arange(len(sig)), len(choices))))}

    return mapped(classes.select("node", "sig"), keys, schema)


def _indices(values):
    import pyarrow as pa
    return pa.array(values, pa.int64())


def _near(a, b, na, nb) -> tuple[np.ndarray, np.ndarray]:
    """Whether sketches and sizes allow the similarity, and the share of equal bins.

    The bins in use are a sample of the union without replacement, so a sketch that holds most of the
    union leaves little doubt.
    """
    either = ((a | b) > 0).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    p = PERCENT / 100
    union = np.maximum(either, (na + nb) / (1 + p))
    likely = equal >= p * either - 1 - DEVIATIONS * np.sqrt(p * (1 - p) * either * (1 - either / np.maximum(union, 1)))
    return likely & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)), equal / np.maximum(either, 1)


_MASKS = np.array([sum(1 << c for c in x) for x in key_choices()], U64)


def _met_before(a: np.ndarray, b: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Whether two signatures share the key of an earlier choice, so that their pair belongs to another bucket."""
    masks = _MASKS
    equal = np.ascontiguousarray(np.packbits(a == b, axis=-1, bitorder="little")).view(np.uint32)[:, 0].astype(U64)
    out = np.zeros(len(equal), bool)
    for k in range(int(choice.max(initial=0))):
        out |= (equal & masks[k] == masks[k]) & (k < choice)
    return out


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def test(batch):
        ok, _ = _near(_matrix(batch.column(4), np.uint8, BINS), _matrix(batch.column(5), np.uint8, BINS), batch.column(2).to_numpy(), batch.column(3).to_numpy())
        keep = _indices(np.flatnonzero(ok))
        return {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep)}

    return mapped(rows, test, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the similarity.

    One text per node is read again: its rows are found by id, with a broadcast of the ids if they are
    few, and told apart by the fingerprint of their set.
    """
    kind = docs.schema[key].dataType.simpleString()
    pairs = written(pairs)
    nodes = written(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node")))
    ids = nodes.select(F.col("node.id").alias("_id")).distinct()
    if nodes.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.join(ids, rows["id"].eqNullSafe(ids["_id"]), "left_semi")

    def named(batch):
        f1, _ = _fingerprints(*shingle_sets(words_of(batch.column(1), lower=True), SHINGLE))
        return {"id": batch.column(0), "f1": f1, "text": batch.column(1)}

    texts = mapped(rows, named, f"id {kind}, f1 bigint, text string", "text").select(F.struct("id", "f1").alias("node"), "text")
    texts = written(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def compare(batch):
        a, ab = shingle_sets(words_of(batch.column(2), lower=True), SHINGLE)
        b, bb = shingle_sets(words_of(batch.column(3), lower=True), SHINGLE)
        ok = []
        for i in range(batch.num_rows):
            x, y = a[ab[i]:ab[i + 1]], b[bb[i]:bb[i + 1]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared and 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                ok.append(i)
        keep = _indices(ok)
        return {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep)}

    return mapped(both, compare, T.StructType([pairs.schema["a"], pairs.schema["b"]]), "ta")


def _blocks(n: Column, rows: int) -> Column:
    return F.ceil(n / rows).cast("int")


def mixed_tiles(keys: DataFrame, classes: DataFrame, roots: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows (task, key, choice, i, j, side, node) of the buckets that hold several components.

    Only buckets of three or more nodes are left to look at. Small buckets share tasks, large ones are
    cut into tiles of two blocks of tile_rows: the bucket's largest component against the others, and
    the others among themselves, so no task holds a bucket and no pair of that component is compared.
    """
    comp = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    member = keys.join(comp, "node")
    parts = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    buckets = buckets.where("n >= 3 and comps >= 2").select("key", "n", F.col("top.comp").alias("top"), F.col("top.n").alias("top_n"))
    rows = written(member.join(buckets, "key").withColumn("rest", F.col("comp") != F.col("top")).drop("comp", "top"))
    few = rows.where(F.col("n") <= SMALL_BUCKET)
    bins = max(1, -(-few.count() // ROWS_PER_BIN))
    few = few.select(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("task"), "key", "choice", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "node")
    many = rows.where(F.col("n") > SMALL_BUCKET).withColumns({"nr": _blocks(F.col("n") - F.col("top_n"), tile_rows), "nt": _blocks(F.col("top_n"), tile_rows)})
    spot = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    # Blocks 0 .. nr-1 hold the rest, nr .. nr+nt-1 the largest component; a tile is (i, j), i <= j, i < nr.
    many = many.withColumn("own", F.when(F.col("rest"), spot(F.col("nr"))).otherwise(F.col("nr") + spot(F.col("nt"))))
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("nr") + F.col("nt") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") - 1))
    many = many.withColumn("other", F.explode(others))
    many = many.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "key", "choice",
                       F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    return written(few.union(many))


def tile_pairs(tiles: DataFrame, classes: DataFrame, roots: DataFrame, partners: int | None) -> DataFrame:
    """Pairs (a, b) of a tile in different components whose sketches allow the similarity.

    Only buckets and tiles with several components receive signatures and sketches. A pair is looked at
    in the first of the buckets that it shares only. Of the partners that a node has in a large tile, only
    so many with the likest sketches, or all.
    """
    node = tiles.schema["node"].dataType
    rows = tiles.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("key", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "i", "j")
    rows = rows.join(mixed, ["key", "i", "j"]).join(classes.select("node", "n_shingles", "sig", "sketch"), "node")
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])

    def compare(table):
        import pyarrow as pa
        names: dict = {}
        comp = np.array([names.setdefault((c["id"], c["f1"]), len(names)) for c in table.column("comp").to_pylist()])
        nodes = table.column("node").combine_chunks()
        if len(names) < 2:
            return pa.table({"a": nodes.slice(0, 0), "b": nodes.slice(0, 0)})
        col = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "side", "n_shingles", "choice")}
        order = np.lexsort((col["side"], col["j"], col["i"], col["key"]))
        key, i, j, side, n, choice, comp = (x[order] for x in (*col.values(), comp))
        sig, sketch = _matrix(table.column("sig"), np.uint16, SYMBOLS)[order], _matrix(table.column("sketch"), np.uint8, BINS)[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        own, left, right = np.cumsum(new), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def keep(a, b, most=None):
            new = ~_met_before(sig[a], sig[b], choice[a])
            a, b = a[new], b[new]
            ok, like = _near(sketch[a], sketch[b], n[a], n[b])
            at = np.flatnonzero(ok)
            if most is not None:
                at = at[np.argsort(-like[at], kind="stable")][:most]
            left.append(a[at])
            right.append(b[at])

        small_rows, large = np.flatnonzero(i < 0), np.flatnonzero(i >= 0)
        for k in range(1, min(SMALL_BUCKET, len(small_rows))):
            same = own[small_rows[:-k]] == own[small_rows[k:]]
            a, b = small_rows[:-k][same], small_rows[k:][same]
            apart = comp[a] != comp[b]
            keep(a[apart], b[apart])
        for block in np.split(large, np.flatnonzero(np.diff(own[large])) + 1) if len(large) else []:
            a, b = block[side[block] == 0], block[side[block] == 1]
            if len(np.unique(comp[block])) > 1:
                for at, x in enumerate(a):
                    y = a[at + 1:] if i[x] == j[x] else b
                    y = y[comp[y] != comp[x]]
                    if len(y):
                        keep(np.full(len(y), x), y, partners)
        ends = [nodes.take(_indices(order[np.concatenate(x)])) for x in (left, right)]
        return pa.table({"a": ends[0], "b": ends[1]})

    return rows.groupBy("task").applyInArrow(compare, schema)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _grouped(links: DataFrame) -> DataFrame:
    return written(components(links).select(F.col("id").alias("node"), F.col("root").alias("comp")))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The groups of roots after new links; only the links between groups are contracted."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = _grouped(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = roots.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = top.join(roots.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    return written(old.unionByName(new))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs.

    Equal shingle sets form one class, so copies never meet pair by pair. Each class is compared to the
    middle one of each of its buckets; then buckets that still hold several components are compared
    across components, the likest pairs first, so that groups of near copies have grown together before
    the rest. Each pair under the signature threshold is in one component or has been compared.
    component_id is the smallest key of the component; kept marks its rows. Rows that repeat a key are
    one document. A text without words, null or empty, is linked with nothing. Null keys join a
    component like others, but never name one: a component of null keys has a null id and keeps them.
    """
    rows = written(signed(docs, key, text))
    classes = rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("_id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.struct(F.col("_id").alias("id"), "f1").alias("node"), "f1", "f2", "n_shingles", "sig", "sketch"))
    keys = keyed(classes)
    # What copies have in common sits in large buckets, so the node with the largest ones is the middle of its group.
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(sizes, "key"))
    middle = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = shared.select("key", "node").join(middle, "node").select("key", F.struct("weight", "node").alias("at"))
    heads = ranked.groupBy("key").agg(F.max("at").alias("head"))
    stars = ranked.join(heads, "key").where("at <> head").select(F.col("at.node").alias("a"), F.col("head.node").alias("b"), F.col("head.weight").alias("w"))
    stars = stars.distinct()
    near = close_pairs(stars.select("a", "b"), classes)
    stars = written(stars.join(near, ["a", "b"], "left_semi"))
    first = written(stars.groupBy("a").agg(F.max(F.struct("w", "b")).alias("top")).select("a", "top.b"))
    stars, keys = stars.select("a", "b"), shared.select("key", "choice", "node")
    roots = _grouped(written(confirmed(first, docs, key, text)))
    low = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried, tiles = low(first), None
    for partners in PARTNERS:
        if tiles is None:
            tiles = mixed_tiles(keys, classes, roots, tile_rows)
            more = _apart(stars, roots).union(tile_pairs(tiles, classes, roots, partners))
        else:
            more = tile_pairs(tiles, classes, roots, partners)
        more = written(low(more).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(more)
        found = written(confirmed(more, docs, key, text))
        if not found.isEmpty():
            roots = _joined(roots, found)
    lowest = roots.groupBy("comp").agg(F.min("node.id").alias("low"))
    of = classes.join(roots.join(lowest, "comp").select("node", "low"), "node", "left")
    of = of.select("f1", "f2", "n_shingles", F.coalesce("low", "node.id").alias("component_id"))
    out = rows.select("id", "n_shingles", "f1", "f2").join(of, ["f1", "f2", "n_shingles"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", alone.alias("component_id"), F.col("id").eqNullSafe(alone).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key names their component, with their own columns; one document of each group.

    The keys that go are found first. They are sent to every task if they are few, and else joined.
    """
    gone = written(near_groups(docs, key, text).where("not kept and component_id is not null").select(F.col(key).alias("_gone")).distinct())
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]), "left_anti")
