"""Connected groups of a link table by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FINISH_LINKS = 200_000      # links that one task settles without rounds


def join_in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, roots, joins) of bounded links taken in order: roots are the smallest ids, joins the links that join two groups."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, joins = list(range(len(ids))), np.zeros(len(a), bool)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, (x, y) in enumerate(zip(at[:len(a)].tolist(), at[len(a):].tolist())):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)], joins[i] = min(x, y), True
    return ids, ids[[find(x) for x in range(len(ids))]], joins


def _plain(values: pa.Array) -> list[pa.Array]:
    """The columns a value is compared by: the members of a struct in order, or the value itself."""
    return [c for member in values.flatten() for c in _plain(member)] if pa.types.is_struct(values.type) else [values]


def _numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, a place of each number): numbers follow the order of the values, nulls first, as in Spark."""
    columns = _plain(values)
    names = [str(i) for i in range(len(columns))]
    order = pc.sort_indices(pa.table(columns, names), [(c, "ascending") for c in names], null_placement="at_start")
    new = np.arange(len(values)) == 0
    for column in columns:
        held = column.take(order)
        unequal = pc.fill_null(pc.not_equal(held[1:], held[:-1]), False).to_numpy(zero_copy_only=False)
        gone = pc.is_null(held).to_numpy(zero_copy_only=False)
        new[1:] |= unequal | (gone[1:] != gone[:-1])
    order = order.to_numpy()
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _settle(links: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([chunk for c in ("a", "b") for chunk in links.column(c).chunks])
    number, place = _numbered(ends)
    ids, roots, _ = join_in_order(number[:links.num_rows], number[links.num_rows:])
    return pa.table({"id": ends.take(pa.array(place[ids])), "root": ends.take(pa.array(place[roots]))})


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.posexplode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                        .alias("_", "e")).select("e.a", "e.b")


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest member of its neighbourhood; moved marks links that change."""
    both = _both_ways(links)
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link the smaller neighbours, and the row itself, to the smallest of them; moved is kept."""
    low = links.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("any"))
    up = links.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
    return up.unionByName(low.select("a", F.col("m").alias("b"), F.col("any").alias("moved"))).groupBy("a", "b").agg(F.max("moved").alias("moved"))


def components(links: DataFrame, max_rounds: int = 50, finish: int = FINISH_LINKS) -> DataFrame:
    """(id, root) for each row in a link, root the smallest id of its group.

    Few links are settled by one task. For more, hubs are contracted by pre-aggregated minima, and the joins
    on them are split by adaptive execution. Every round is written to the shared folder; the last is the one
    in which no link moves.
    """
    links = cut_lineage(links.where("a <> b").select("a", "b").distinct())
    if links.count() <= finish:
        schema = T.StructType([T.StructField(c, links.schema["a"].dataType) for c in ("id", "root")])
        return cut_lineage(links.groupBy(F.lit("all")).applyInArrow(_settle, schema))
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        if links.where("moved").isEmpty():
            roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
            tops = links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            return roots.unionByName(tops)
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
