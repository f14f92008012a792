"""Hard negatives of anchor vectors from exact integer scores.

Vectors become whole numbers. Blocks of anchors meet blocks of candidates in tiles, and the scores of a
tile are an integer matrix product by Strassen's recursion: seven products of half the size in place of
eight, odd sides padded with zeros, all additions exact. Every tile keeps the best few candidates of
each anchor, and these short heaps are merged per anchor. A first pass over rows of like labels finds the
positives; a second pass finds, below each positive's score, the best rows of other labels in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written

LEAF = 32                                   # products with a side this short are not split further
BLOCK_ROWS = 4096                           # rows of one side that a tile receives
TILE_ROWS = 512                             # rows of each side that are multiplied at once
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95                          # the window, in percent of the positive score
MOST = 1 << 52                              # components beyond this size have no exact whole number
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for 64-bit integers. Sums wrap modulo 2^64, so a product that fits is exact whatever came between."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,kj->ij", a, b)
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * h, 2 * j), np.int64)
    c[:h, :j] = p1 + p4 - p5 + p7
    c[:h, j:] = p3 + p5
    c[h:, :j] = p2 + p4
    c[h:, j:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def clean(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id.

    Rows without id, label or vector, or with a component that is null, not finite or beyond MOST, go. Of
    rows that share an id the one with the least label and vector stays.
    """
    x = F.col("vector")
    rows = rows.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST / SCALE))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _blocks(n: Column, rows: int) -> Column:
    return F.greatest(F.ceil(n / rows), F.lit(1)).cast("int")


def tiles(anchors: DataFrame, rows: DataFrame, n_anchor: Column, n_row: Column) -> DataFrame:
    """Both sides dealt to tiles (bucket, i, j): every anchor block i meets every row block j of its bucket.

    n_anchor and n_row are the numbers of blocks of a row's bucket; ids are unique, so a hash of them fills
    the blocks evenly. A row is sent once per block of the other side.
    """
    spot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = anchors.select("bucket", F.lit(1).alias("side"), "id", "label", "vector", "positives", spot(n_anchor).alias("i"), n_row.alias("_n"))
    a = a.select("bucket", "side", "id", "label", "vector", "positives", "i", every(F.col("_n")).alias("j"))
    b = rows.select("bucket", F.lit(0).alias("side"), "id", "label", "vector", F.lit(None).cast(PAIRS).alias("positives"), spot(n_row).alias("j"), n_anchor.alias("_n"))
    b = b.select("bucket", "side", "id", "label", "vector", "positives", every(F.col("_n")).alias("i"), "j")
    return a.unionByName(b)


PAIRS = T.ArrayType(T.StructType([T.StructField("score", T.LongType()), T.StructField("id", T.LongType())]))
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"


def _whole(column, width: int) -> np.ndarray:
    """Vectors as whole numbers, filled up with zeros to one width."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    return out


def _best(scores: np.ndarray, ok: np.ndarray, least: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to most rounds of (row, column) with each row's next best score that is ok and at least `least`.

    Columns are in ascending order of ids, so the first of equal scores has the smallest id.
    """
    left = np.where(ok, scores, NONE)
    rows = np.arange(len(left))
    for _ in range(most):
        at = np.argmax(left, axis=1)
        top = left[rows, at]
        good = (top > NONE) & (top >= least)
        if not good.any():
            return
        yield rows[good], at[good]
        left[rows, at] = NONE


def _tile_heaps(window: bool):
    """The heaps of a tile: the best rows of the anchor's label, or the best of other labels below each positive."""
    def run(table):
        import pyarrow as pa
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 1)), table.filter(pa.array(side == 0)).sort_by("id")
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if a.num_rows and b.num_rows:
            width = max(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max()) for t in (a, b)) or 1
            va, vb = _whole(a.column("vector"), width), np.ascontiguousarray(_whole(b.column("vector"), width)).T
            ids, others, la, lb = (t.column(c).to_numpy() for t, c in ((a, "id"), (b, "id"), (a, "label"), (b, "label")))
            near = a.column("positives").to_pylist() if window else None
            for x in range(0, len(ids), TILE_ROWS):
                p, q = slice(x, x + TILE_ROWS), range(0, len(others), TILE_ROWS)
                for y in q:
                    r = slice(y, y + TILE_ROWS)
                    _heaps(strassen(va[p], vb[:, r]), ids[p], others[r], la[p], lb[r], near[p] if window else None, out)
        cells = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "other_id", "score"), (pa.array(c) for c in cells))))
    return run


def _heaps(scores, ids, others, la, lb, near, out) -> None:
    same = la[:, None] == lb[None, :]
    if near is None:
        for r, c in _best(scores, same & (ids[:, None] != others[None, :]), np.full(len(ids), NONE), POSITIVES):
            for cells, values in zip(out, (ids[r], others[c], scores[r, c], others[c], scores[r, c])):
                cells.append(values)
        return
    for k in range(max(map(len, near), default=0)):
        rows = np.array([i for i, x in enumerate(near) if len(x) > k])
        score, name = (np.array([near[i][k][f] for i in rows], np.int64) for f in ("score", "id"))
        parts = lambda percent: (percent * (score // 100), percent * (score % 100))
        whole, rest = parts(HIGH)
        most = whole + rest // 100
        whole, rest = parts(LOW)
        least = whole - (-rest) // 100
        ok = ~same[rows] & (scores[rows] <= most[:, None])
        for r, c in _best(scores[rows], ok, least, NEGATIVES):
            for cells, values in zip(out, (ids[rows[r]], name[r], score[r], others[c], scores[rows[r], c])):
                cells.append(values)


def merged(found: DataFrame, group: list[str], most: int) -> DataFrame:
    """The best `most` rows of each group by score, then id; heaps are cut before and after the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on `id`. An anchor's positives are the POSITIVES other rows of its label with
    the highest scores, ties by the smaller id. For each, the NEGATIVES best rows of other labels whose
    score is LOW to HIGH percent of the positive score; none below a negative positive score. Rows without
    id, label or vector take no part, and rows that repeat an id are one row (see clean). Shorter vectors
    are filled up with zeros. Empty tables give no rows; other columns of rows are not looked at.
    """
    data = written(clean(rows, key, vector, label).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    n, n_anchors = data.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    # Rows of like labels share a bucket; a bucket with many rows is cut into blocks.
    buckets = max(1, -(-n // block_rows))
    data = data.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    sizes = written(data.groupBy("bucket").agg(_blocks(F.count_if("anchor"), block_rows).alias("na"), _blocks(F.count(F.lit(1)), block_rows).alias("nb"), F.count_if("anchor").alias("_a")))
    dealt = data.join(small(sizes), "bucket").where("_a > 0")
    none = F.lit(None).cast(PAIRS)
    like = tiles(dealt.where("anchor").withColumn("positives", none), dealt, F.col("na"), F.col("nb"))
    heaps = like.groupBy("bucket", "i", "j").applyInArrow(_tile_heaps(False), FOUND)
    best = merged(heaps, ["anchor_id"], POSITIVES).groupBy(F.col("anchor_id").alias("id"))
    best = written(best.agg(F.collect_list(F.struct("score", F.col("other_id").alias("id"))).alias("positives")))
    anchors = data.where("anchor").join(best, "id").withColumn("bucket", F.lit(0))
    na, nb = (F.lit(max(1, -(-x // block_rows))).cast("int") for x in (n_anchors, n))
    unlike = tiles(anchors, data.withColumn("bucket", F.lit(0)), na, nb)
    heaps = unlike.groupBy("bucket", "i", "j").applyInArrow(_tile_heaps(True), FOUND)
    return merged(heaps, ["anchor_id", "positive_id"], NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
