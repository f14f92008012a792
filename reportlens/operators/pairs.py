"""Work on pairs of vectors: near ones through cells, and all pairs in square tiles.

Rows are hashed into blocks of a bounded size, and a tile is a pair of blocks. A tile is one bounded
group whatever the data look like, and it returns per-row or per-group sums, the k nearest, or a
spanning forest, never the list of its pairs. The work is quadratic because the questions are;
rows travel once per block. Blocks are large, so that rows travel seldom; a tile looks at slices of
them, a small matrix at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cells import SLACK, Cells, rows_per_side
from .components import join_in_order
from .ranking import hash_key

TILE_FLOATS = 1 << 22
STRIP_FLOATS = 1 << 17      # distances at once, where only their sums are wanted: these stay in the processor's cache
MERGE_LINKS = 1_000_000     # links of several tiles that one task makes a spanning tree of


def _slices(frame: pd.DataFrame, n: int) -> list[pd.DataFrame]:
    """Parts of some n rows of a frame sorted by id; rows of one id stay together."""
    ids, out, first = frame["id"].to_numpy(), [], 0
    ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)) if len(ids) else np.zeros(0, int)
    while first < len(ids):
        end = int(ends[np.searchsorted(ends, min(first + n, len(ids)))])
        out.append(frame.iloc[first:end].reset_index(drop=True))
        first = end
    return out


def tiles(df: DataFrame, id_col: str, vec: str, carry: Sequence[str], kernel: Callable, schema: str,
          block_rows: int | None = None, combine: Callable | None = None) -> DataFrame:
    """Apply kernel(left, right, same) to every pair of slices of every pair of blocks; frames have id, vec and carry columns.

    combine(found) makes the rows of a whole tile smaller.
    """
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    slice_rows = block_rows or max(64, min(2048, TILE_FLOATS // max(1, shape.d or 1)))
    n_blocks = max(1, -(-shape.n // rows_per_side(shape.n, shape.d, slice_rows)))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), *carry)
    rows = rows.withColumn("block", F.pmod(hash_key(7, "id"), F.lit(n_blocks)).cast("int"))
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    sent = sent.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        b1, b2 = pdf["b1"].iat[0], pdf["b2"].iat[0]
        left = _slices(pdf[pdf["block"] == b1], slice_rows)
        right = left if b1 == b2 else _slices(pdf[pdf["block"] == b2], slice_rows)
        found = [kernel(x, y, x is y) for i, x in enumerate(left) for y in (right[i:] if b1 == b2 else right)]
        if not found:
            return pd.DataFrame()
        table = pd.concat([x for x in found if len(x)] or found[:1], ignore_index=True)
        return combine(table) if combine and len(table) else table

    return sent.drop("other").groupBy("b1", "b2").applyInPandas(run, schema)


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["vec"].tolist(), dtype=np.float64).reshape(len(frame), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean or cosine distances of all rows of a to all rows of b."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return np.clip(1 - unit(a) @ unit(b).T, 0, 2)
    centre = a.mean(axis=0) if len(a) else 0.0
    a, b = a - centre, b - centre
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0))


def tile_distances(left: pd.DataFrame, right: pd.DataFrame, same: bool, metric: str) -> np.ndarray:
    dist = distances(matrix(left), matrix(right), metric)
    if same:
        np.fill_diagonal(dist, 0.0)
    return dist


def _hot(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one column of ones and zeros per label, labels)."""
    codes, names = pd.factorize(labels, sort=True)
    hot = np.zeros((len(labels), len(names)))
    hot[np.arange(len(labels)), codes] = 1
    return hot, names


def _label_sums(ids: np.ndarray, sums: np.ndarray, n: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": np.repeat(ids, len(names)), "label": np.tile(names, len(ids)),
                         "dist": sums.ravel(), "n": n.ravel().astype(np.int64)})


def distance_to_labels(df: DataFrame, id_col: str, vec: str, label: str, metric: str = "euclidean",
                       block_rows: int | None = None) -> DataFrame:
    """(id, label, dist, n): summed distance of each row to the other rows of each label."""
    def kernel(left, right, same):
        a, b, strip = matrix(left), matrix(right), max(1, STRIP_FLOATS // max(1, len(right)))
        (hot_a, names_a), (hot_b, names_b) = _hot(left["label"].to_numpy()), _hot(right["label"].to_numpy())
        there, back = np.zeros((len(a), len(names_b))), np.zeros((len(b), len(names_a)))
        for i in range(0, len(a), strip):
            at = np.arange(i, min(i + strip, len(a)))
            d = distances(a[at], b, metric)
            if same:
                d[at - i, at] = 0.0
            else:
                back += d.T @ hot_a[at]
            there[at] = d @ hot_b
        n = np.tile(hot_b.sum(0), (len(a), 1)) - (hot_a if same else 0)
        one = _label_sums(left["id"].to_numpy(), there, n, names_b)
        if same:
            return one
        two = _label_sums(right["id"].to_numpy(), back, np.tile(hot_a.sum(0), (len(b), 1)), names_a)
        return pd.concat([one, two], ignore_index=True)

    rows = df.select(id_col, vec, F.col(label).cast("int").alias("label"))
    id_type = df.schema[id_col].dataType.simpleString()
    add = lambda t: t.groupby(["id", "label"], as_index=False, dropna=False)[["dist", "n"]].sum()
    part = tiles(rows, id_col, vec, ["label"], kernel, f"id {id_type}, label int, dist double, n bigint", block_rows, add)
    return part.groupBy("id", "label").agg(F.sum("dist").alias("dist"), F.sum("n").alias("n")).where("n > 0")


def label_distances(df: DataFrame, id_col: str, vec: str, label: str, metric: str = "euclidean",
                    block_rows: int | None = None) -> DataFrame:
    """(label_a, label_b, mean_dist) over ordered pairs, own pairs included (zero diagonal)."""
    def kernel(left, right, same):
        d = tile_distances(left, right, same, metric)
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        out = []
        for x in np.unique(la):
            by = pd.Series(d[la == x].sum(0)).groupby(lb).sum()
            out += [(int(x), int(y), float(s), int((la == x).sum() * (lb == y).sum())) for y, s in by.items()]
        if not same:
            out += [(y, x, s, n) for x, y, s, n in out]
        return pd.DataFrame(out, columns=["label_a", "label_b", "dist", "n"])

    rows = df.select(id_col, vec, F.col(label).cast("int").alias("label"))
    add = lambda t: t.groupby(["label_a", "label_b"], as_index=False, dropna=False)[["dist", "n"]].sum()
    part = tiles(rows, id_col, vec, ["label"], kernel, "label_a int, label_b int, dist double, n bigint", block_rows, add)
    return part.groupBy("label_a", "label_b").agg((F.sum("dist") / F.sum("n")).alias("mean_dist"))


def nearest(df: DataFrame, id_col: str, vec: str, k: int, metric: str = "cosine",
            block_rows: int | None = None, among: str | None = None) -> DataFrame:
    """(id, other, dist, rank): the k nearest other rows; ties go to the smaller id.

    With `among`, only rows where that flag holds can be neighbours. A first pass in each row's own cell
    bounds how far its neighbours can be, a second one looks into the cells within that bound.
    """
    def among_these(rows):
        return rows["among"].to_numpy(dtype=bool) if among else np.ones(len(rows), bool)

    def bound(rows):
        d, ids = distances(matrix(rows), matrix(rows), metric), rows["id"].to_numpy()
        d[ids[:, None] == ids[None, :]] = np.inf
        d = d[:, among_these(rows)]
        far = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(rows), np.inf)
        return pd.DataFrame({"id": rows["id"], "reach": np.where(np.isfinite(far), far, np.nan)})

    def first(row, col, dist):
        """The k least of each row; equal distances by column."""
        order = np.lexsort((col, dist, row))
        row = row[order]
        return order[np.arange(len(row)) - np.searchsorted(row, row) < k]

    def top(targets, visitors):
        targets = targets[among_these(targets)]
        others, ids = targets["id"].to_numpy(), visitors["id"].to_numpy()
        if not len(others):
            return pd.DataFrame()
        a, b = matrix(visitors), matrix(targets)
        d = distances(a, b, metric)
        d[ids[:, None] == others[None, :]] = np.inf
        size = 1.0 if metric == "cosine" else 1.0 + np.abs(a).max(initial=0)
        reach = visitors["reach"].astype(float).to_numpy()
        far = np.where(np.isnan(reach), np.finfo(float).max, reach * (1 + SLACK) + SLACK * size)
        row, col = np.nonzero(d <= far[:, None])
        keep = first(row, col, d[row, col])
        row, col = row[keep], col[keep]
        return pd.DataFrame({"id": ids[row], "other": others[col], "dist": d[row, col], "at": visitors["at"].to_numpy()[row]})

    def best(found):
        if not len(found):
            return pd.DataFrame()
        names = np.unique(found["other"].to_numpy(), return_inverse=True)[1]
        keep = first(found["at"].to_numpy(), names, found["dist"].to_numpy())
        return found.iloc[keep].drop(columns="at")

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.withColumn("among", F.col(among)) if among else df
    index = Cells(rows, id_col, vec, metric, ["among"] if among else [], block_rows)
    reach = cut_lineage(index.own(bound, f"id {id_type}, reach double"))
    part = index.within(reach, top, f"id {id_type}, other {id_type}, dist double", best)
    w = Window.partitionBy("id").orderBy("dist", "other")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tile_roots(near: np.ndarray, same: bool) -> np.ndarray:
    """Smallest linked index of each node; left rows come first, right rows after them."""
    n_left, n_right = near.shape
    low = np.arange(n_left if same else n_left + n_right)
    while True:
        before = low
        left, right = (low, low) if same else (low[:n_left], low[n_left:])
        right = np.minimum(right, np.where(near, left[:, None], len(low)).min(0, initial=len(low)))
        left = np.minimum(left, np.where(near, right[None, :], len(low)).min(1, initial=len(low)))
        low = left if same else np.concatenate([left, right])
        low = low[low]
        if np.array_equal(low, before):
            return low


def neighbour_counts(df: DataFrame, id_col: str, vec: str, eps: float, metric: str = "cosine",
                     block_rows: int | None = None) -> DataFrame:
    """(id, n): rows within eps, the row itself included."""
    def count(targets, visitors):
        near = distances(matrix(visitors), matrix(targets), metric) <= eps
        near |= visitors["id"].to_numpy()[:, None] == targets["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": visitors["id"], "n": near.sum(1)})

    id_type = df.schema[id_col].dataType.simpleString()
    index = Cells(df, id_col, vec, metric, block_rows=block_rows)
    add = lambda found: found.groupby("id", as_index=False)["n"].sum()
    part = index.within(index.rows.select("id", F.lit(float(eps)).alias("reach")), count, f"id {id_type}, n bigint", add)
    return part.groupBy("id").agg(F.sum("n").alias("n"))


def near_links(df: DataFrame, id_col: str, vec: str, core: str, eps: float, metric: str = "cosine",
               block_rows: int | None = None) -> DataFrame:
    """(a, b, border): links that join the same groups as all pairs within eps would.

    Per tile a spanning forest of the core rows, and for each border row one link to every
    group of core rows it touches there.
    """
    def kernel(left, right):
        near = distances(matrix(left), matrix(right), metric) <= eps
        near |= left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        both = pd.concat([left, right], ignore_index=True)
        ids, is_core = both["id"].to_numpy(), both["core"].to_numpy(dtype=bool)
        left_core, right_core = left["core"].to_numpy(dtype=bool), right["core"].to_numpy(dtype=bool)
        root = _tile_roots(near & left_core[:, None] & right_core[None, :], False)
        r, c = np.nonzero(near & left_core[:, None] & ~right_core[None, :])
        links = [(ids[i], ids[root[i]], False) for i in np.nonzero(is_core & (root != np.arange(len(both))))[0] if ids[i] != ids[root[i]]]
        edge = np.unique(np.stack([c + len(left), root[r]], 1), axis=0)
        links += [(ids[i], ids[j], True) for i, j in edge]
        return pd.DataFrame(links, columns=["a", "b", "border"])

    def forest(found):
        """The same groups by fewer links."""
        core, border = found[~found["border"].astype(bool)], found[found["border"].astype(bool)]
        ids, roots, _ = join_in_order(core["a"].to_numpy(), core["b"].to_numpy())
        root = dict(zip(ids, roots))
        to = [root.get(x, x) for x in border["b"]]
        inner = pd.DataFrame({"a": ids, "b": roots, "border": False})
        return pd.concat([inner[inner["a"] != inner["b"]], pd.DataFrame({"a": border["a"], "b": to, "border": True}).drop_duplicates()])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, vec, F.col(core).alias("core"))
    index = Cells(rows, id_col, vec, metric, ["core"], block_rows)
    return index.within(index.rows.select("id", F.lit(float(eps)).alias("reach")), kernel, f"a {id_type}, b {id_type}, border boolean", forest).distinct()


def _tile_tree(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, via, w): the links of a minimum spanning tree of a tile, of its left and right rows unless they are the same."""
    n_left, m = len(d), len(d) if same else sum(d.shape)
    rows, back = np.ascontiguousarray(d), np.ascontiguousarray(d.T)
    via, key, limit = np.zeros(m, int), np.full(m, np.inf), np.full(m, np.inf)      # done: key is infinite, limit minus infinite
    ends, w, at = [], [], 0
    for _ in range(m - 1):
        key[at], limit[at] = np.inf, -np.inf
        first = 0 if same or at >= n_left else n_left
        row = rows[at] if at < n_left else back[at - n_left]
        closer = np.flatnonzero(row < limit[first:first + len(row)])
        new, closer = row[closer], closer + first
        key[closer], limit[closer], via[closer] = new, new, at
        at = int(key.argmin())
        if not np.isfinite(key[at]):
            break
        ends.append(at)
        w.append(key[at])
    ends = np.array(ends, int)
    return ends, via[ends], np.array(w, float)


def _tree(found: pd.DataFrame) -> pd.DataFrame:
    """The spanning tree of the links of several trees, equal lengths by their ends."""
    ends = np.sort(found[["a", "b"]].to_numpy(), axis=1)
    found = found.assign(a=ends[:, 0], b=ends[:, 1]).sort_values(["w", "a", "b"], ignore_index=True)
    return found[join_in_order(found["a"].to_numpy(), found["b"].to_numpy())[2]]


def merged_trees(links: DataFrame, merge_links: int = MERGE_LINKS) -> DataFrame:
    """Fewer links (a, b, w) with the same minimum spanning tree: links between two groups of rows shrink to a forest.

    A link that is the longest of a circle, equal lengths by their ends, is in no such tree. A task gets some merge_links links; with
    few enough of them what is left is the tree.
    """
    links = cut_lineage(links.where("a is not null and b is not null"))
    left = links.count()
    while True:
        n = 1
        while left > merge_links * n * (n + 1) // 2:
            n += 1
        dealt = [F.pmod(hash_key(8 + n, c), F.lit(n)).cast("int") for c in ("a", "b")]
        sides = links.withColumns({"b1": F.least(*dealt), "b2": F.greatest(*dealt)})
        fewer = cut_lineage(sides.groupBy("b1", "b2").applyInPandas(lambda pdf: _tree(pdf[["a", "b", "w"]]), links.schema))
        before, links, left = left, fewer, fewer.count()
        if n == 1 or left * 4 > before * 3:
            return links


def reach_links(df: DataFrame, id_col: str, vec: str, core_dist: str, metric: str = "euclidean",
                block_rows: int = 1024, merge_links: int = MERGE_LINKS) -> DataFrame:
    """(a, b, w): minimum spanning trees under mutual reachability, of the trees of tiles and their slices.

    The minimum spanning tree of all rows is among these links, so groups at any level are too.
    """
    def kernel(left, right, same):
        d = tile_distances(left, right, same, metric)
        d = np.maximum(d, np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :]))
        ids = left["id"].to_numpy() if same else np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        ends, via, w = _tile_tree(d, same)
        return pd.DataFrame({"a": ids[ends], "b": ids[via], "w": w}, columns=["a", "b", "w"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, vec, F.col(core_dist).alias("core"))
    found = tiles(rows, id_col, vec, ["core"], kernel, f"a {id_type}, b {id_type}, w double", block_rows, _tree)
    return merged_trees(found, merge_links)
