"""Pairs of vectors within a reach, without looking at cells that are provably too far.

Pivots cut the rows into cells; a cell knows its pivot and its largest distance from it. By the triangle
inequality a row with reach r can only have partners in cells whose pivot is at most r plus that radius
away. Near cells share a bin, and a row travels once to each bin in which it may have partners; there it
meets the rows of the cells within its reach alone, a small matrix at a time. Bins are large, so that rows
travel seldom; those with more rows are cut into parts, and the visitors of a bin into groups, so every
tile is bounded. Cosine distances are looked up among unit vectors, where
d = |u - v|^2 / 2 (zero vectors are only nearer there), so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ranking import hash_key, sample_rows

BLOCK_ROWS = 2048               # rows, and visitors, of one matrix
SIDE_ROWS = 1 << 15             # rows, and visitors, of a tile
SIDE_FLOATS = 1 << 22           # their numbers
SIDES = 12                      # rows are cut into so many sides at least, for the cores' sake, if they fill a matrix each
PIVOT_FLOATS = 1 << 21          # numbers of all pivots together, which every task receives
SLACK = 1e-6                    # relative and absolute, for rounded distances


def rows_per_side(n: int, width: int | None, block: int) -> int:
    """Rows of one side of a tile: as many as memory bears, fewer if there are few."""
    return max(block, min(SIDE_ROWS, SIDE_FLOATS // max(1, width or 1), -(-n // SIDES)))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def plain_reach(reach: np.ndarray | float, metric: str) -> np.ndarray | float:
    """A reach among the vectors that cells are made of."""
    return np.sqrt(2 * np.maximum(reach, 0)) if metric == "cosine" else reach


class Cells:
    """Rows (id, vec, cell, part, carried columns) and what all tasks know of the cells."""

    def __init__(self, df: DataFrame, id_col: str, vec: str, metric: str, carry: Sequence[str] = (), block_rows: int | None = None):
        self.metric, self.carry, self.block = metric, list(carry), block_rows or BLOCK_ROWS
        rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"), *carry)
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        most = max(1, PIVOT_FLOATS // max(1, shape.d or 1))
        found = sample_rows(rows, min(most, max(1, 4 * -(-shape.n // self.block))), ["id"], 11).select("vec").collect()
        pivots = np.array([r.vec for r in found], float).reshape(len(found), shape.d or 0)
        self.pivots = pivots = unit(pivots) if metric == "cosine" else pivots
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])

        def assign(frames):
            for pdf in frames:
                d = gaps(_matrix(pdf, metric), pivots)
                at = d.argmin(axis=1) if len(pdf) else np.zeros(0, int)
                yield pdf.assign(cell=at.astype(np.int32), off=d[np.arange(len(pdf)), at])

        self.rows = cut_lineage(rows.mapInPandas(assign, schema)) if len(found) else rows.withColumns({"cell": F.lit(0), "off": F.lit(0.0)})
        known = {r.cell: (r.n, r.radius) for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()}
        self.count = [known.get(c, (0, 0.0))[0] for c in range(len(found))]
        self.radius = np.array([known.get(c, (0, -np.inf))[1] for c in range(len(found))])
        parts = F.array(*[F.lit(max(1, -(-n // self.block))) for n in self.count] or [F.lit(1)])
        self.side = rows_per_side(shape.n, shape.d, self.block)
        self.bins = self._bins()
        self.rows = self.rows.withColumn("part", F.pmod(hash_key(5, "id"), F.get(parts, F.col("cell"))).cast("int")).drop("off")

    def own(self, kernel: Callable, schema: str) -> DataFrame:
        """kernel(rows) of every part of a cell."""
        return self.rows.groupBy("cell", "part").applyInPandas(lambda pdf: kernel(pdf.sort_values("id", ignore_index=True)), schema)

    def _bins(self) -> np.ndarray:
        """The bin of each cell: cells are halved along their widest axis until a side holds their rows."""
        count, out, n, todo = np.array(self.count, dtype=np.int64), np.zeros(len(self.count), np.int32), 0, [np.arange(len(self.count))]
        while todo:
            at = todo.pop()
            if len(at) < 2 or count[at].sum() <= self.side or not self.pivots.shape[1]:
                out[at], n = n, n + 1
                continue
            order = at[self.pivots[at, self.pivots[at].var(axis=0).argmax()].argsort(kind="stable")]
            half = min(max(1, int(count[order].cumsum().searchsorted(count[at].sum() / 2))), len(at) - 1)
            todo += [order[:half], order[half:]]
        return out

    def _near(self) -> Callable:
        """(pdf, cells) -> which of the cells the reach of each row may touch; reach is null for no bound."""
        pivots, radius, metric = self.pivots, self.radius, self.metric

        def near(pdf: pd.DataFrame, cells=slice(None)) -> np.ndarray:
            far = plain_reach(pdf["reach"].astype(float).fillna(np.inf).to_numpy(), metric)
            found = gaps(_matrix(pdf, metric), pivots[cells]) <= (radius[cells][None, :] + far[:, None]) * (1 + SLACK) + SLACK
            return found & np.isfinite(radius[cells])[None, :]

        return near

    def _touched(self, rows: DataFrame, group: np.ndarray, name: str) -> DataFrame:
        """(id, name) for each group of cells that a row's reach may touch."""
        near, n = self._near(), int(group.max(initial=-1)) + 1
        schema = T.StructType([rows.schema["id"], T.StructField("found", T.ArrayType(T.IntegerType()))])

        def look(frames):
            for pdf in frames:
                row, cell = np.nonzero(near(pdf))
                hit = np.zeros((len(pdf), n), bool)
                hit[row, group[cell]] = True
                yield pd.DataFrame({"id": pdf["id"], "found": [np.flatnonzero(x).astype(np.int32) for x in hit]})

        return rows.select("id", "vec", "reach").mapInPandas(look, schema).select("id", F.explode("found").alias(name))

    def visits(self, rows: DataFrame) -> DataFrame:
        """(id, cell) for each cell that a row's reach may touch; rows have id, vec and reach, null for no bound."""
        return self._touched(rows, np.arange(len(self.count)), "cell")

    def within(self, reaches: DataFrame, kernel: Callable, schema: str, combine: Callable | None = None) -> DataFrame:
        """kernel(targets, visitors) of every cell and the visitors of its tile; reaches (id, reach) bounds how far partners may be.

        Every row meets each row within its reach exactly once as a visitor; it may meet others too. Visitors
        have their reach and at, a number that tells them apart in the tile. combine(found) makes the rows of a
        whole tile smaller.
        """
        bins, block, near = self.bins, self.block, self._near()
        size = np.bincount(bins, weights=self.count).astype(int) if len(bins) else np.zeros(0, int)
        sides = lambda n: [F.lit(max(1, -(-int(x) // self.side))) for x in n] or [F.lit(1)]
        bounded = cut_lineage(self.rows.drop("cell", "part").join(reaches, "id"))
        to = cut_lineage(self._touched(bounded, bins, "bin"))
        asked = {r.bin: r.n for r in to.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts, groups = F.array(*sides(size)), F.array(*sides([asked.get(b, 0) for b in range(len(size))]))
        bin_of = F.get(F.array(*[F.lit(int(b)) for b in bins] or [F.lit(0)]), F.col("cell"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        dealt = lambda seed, n: F.pmod(hash_key(seed, "id"), F.get(n, F.col("bin"))).cast("int")
        visitors = to.join(bounded, "id").select("id", "vec", *self.carry, "bin", F.lit(-1).alias("cell"), F.col("reach").cast("double").alias("reach"),
                                                 dealt(6, groups).alias("group"), every(F.get(parts, F.col("bin"))).alias("part"))
        targets = self.rows.withColumn("bin", bin_of).select("id", "vec", *self.carry, "bin", "cell", F.lit(None).cast("double").alias("reach"),
                                                             every(F.get(groups, F.col("bin"))).alias("group"), dealt(5, parts).alias("part"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)
            targets, visitors = (pdf[side].reset_index(drop=True) for side in (pdf["cell"] >= 0, pdf["cell"] < 0))
            if not len(targets) or not len(visitors):
                return pd.DataFrame()
            visitors["at"] = np.arange(len(visitors))
            found, cells = [], np.unique(targets["cell"])
            for cell, come in zip(cells, near(visitors, cells).T):
                there, come = targets[targets["cell"] == cell], np.flatnonzero(come)
                for i in range(0, len(there), block):
                    for j in range(0, len(come), block):
                        part = kernel(there[i:i + block].reset_index(drop=True), visitors.iloc[come[j:j + block]].reset_index(drop=True))
                        if len(part):
                            found.append(part)
            if not found:
                return pd.DataFrame()
            table = pd.concat(found, ignore_index=True)
            return combine(table) if combine else table

        return targets.unionByName(visitors).groupBy("bin", "part", "group").applyInPandas(run, schema)


def _matrix(pdf: pd.DataFrame, metric: str) -> np.ndarray:
    m = np.array(pdf["vec"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
    return unit(m) if metric == "cosine" else m
