"""Row numbers, running totals and draws that no single task has to sort alone.

Each rank is taken in two levels: a row number inside a small bucket plus the count of the buckets
before it. Buckets come from the data values or from a hash, never from physical partitions, so a
lost executor or another partition count gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASH_BITS = 60
BUCKET_BITS = 14
CUTS = 1024


def hash_key(seed: int | Column, *keys: Column | str) -> Column:
    """A 60-bit number from seed and keys: the deterministic stand-in for a random draw."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    seed = F.lit(seed) if isinstance(seed, int) else seed
    joined = F.concat_ws(":", seed.cast("string"), *[c.cast("string") for c in cols])
    return F.conv(F.left(F.md5(joined), F.lit(15)), 16, 10).cast("bigint")


def hash_unit(seed: int | Column, *keys: Column | str) -> Column:
    """The same as a number in [0, 1)."""
    return hash_key(seed, *keys) / float(1 << HASH_BITS)


def _offsets(counts: DataFrame, group: Sequence[str], bucket: str, cols: Sequence[str]) -> DataFrame:
    """Totals of the buckets before each one; the buckets of a group are few, whatever its size."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, bucket, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in cols])


def shuffled_rank(df: DataFrame, keys: Sequence[str], seed: int | Column = 42, group: Sequence[str] = (),
                  out: str = "rank") -> DataFrame:
    """Row number 1..n per group in hashed order; a hot group is spread over many buckets."""
    rows = df.withColumn("_hash", hash_key(seed, *keys))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS))
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = _offsets(counts, group, "_bucket", ["n"])
    w = Window.partitionBy(*group, "_bucket").orderBy("_hash", *keys)
    ranked = rows.withColumn("_in", F.row_number().over(w)).join(before, [*group, "_bucket"])
    return ranked.withColumn(out, F.col("_before_n") + F.col("_in")).drop("_hash", "_bucket", "_in", "_before_n")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement; only n rows per task reach the last step."""
    return df.orderBy(hash_key(seed, *keys), *keys).limit(n)


def subsample(df: DataFrame, frac: float, keys: Sequence[str], seed: int | Column = 42,
              group: Sequence[str] = ()) -> DataFrame:
    """floor(frac * n) rows per group without replacement."""
    ranked = shuffled_rank(df, keys, seed, group, "_rank")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    kept = ranked.join(sizes, list(group)) if group else ranked.withColumn("_n", sizes.scalar())
    return kept.where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(float(frac)))).drop("_rank", "_n")


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: the first floor(test * n) rows of each label in hashed order."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(df, keys, seed, [label], "_rank").join(sizes, label)
    return ranked.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_n") * F.lit(float(test)))).drop("_rank", "_n")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, balanced within each label."""
    ranked = shuffled_rank(df, keys, seed, [label], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def bootstrap(df: DataFrame, n_draws: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n_draws rows with replacement: hashed row numbers joined to the ranked rows."""
    ranked = shuffled_rank(df, keys, seed, (), "_rank")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = df.sparkSession.range(n_draws).select(
        F.col("id").alias("draw"), (F.pmod(hash_key(seed, "id"), total) + 1).alias("_rank"))
    return draws.join(ranked, "_rank").drop("_rank")


def cut_points(df: DataFrame, col: str, n_buckets: int = CUTS) -> list[float]:
    """Values that split distinct values into buckets of like size; at most n_buckets reach the driver."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    return sorted(set(df.withColumn("_v", F.col(col).cast("double")).approxQuantile("_v", probs, 0.5 / n_buckets)))


def running_totals(df: DataFrame, order: str, sums: Sequence[str], group: Sequence[str] = (),
                   cuts: Sequence[float] | None = None) -> DataFrame:
    """Adds before_<c>, the sum of c over smaller `order` values; one row per (group, order) goes in."""
    splits = [float("-inf"), *(cut_points(df, order) if cuts is None else cuts), float("inf")]
    tool = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket")
    rows = tool.transform(df.withColumn("_value", F.col(order).cast("double"))).drop("_value")
    counts = rows.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    before = _offsets(counts, group, "_bucket", sums)
    w = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    out = inner.join(before, [*group, "_bucket"])
    out = out.withColumns({f"before_{c}": F.col(f"_before_{c}") + F.col(f"_in_{c}") for c in sums})
    return out.drop("_bucket", *[f"_before_{c}" for c in sums], *[f"_in_{c}" for c in sums])


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value: (group, value, n, avg_rank)."""
    counts = cut_lineage(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counts, value, ["n"], group)
    return ranked.withColumn("avg_rank", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Row number over a whole table: a distributed sort, then an offset per sorted part.

    The sorted rows are written before they are counted, so both passes see the same parts.
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = _offsets(counts, (), "_part", ["n"])
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_part").withColumn(out, F.col("_before_n") + inside).drop("_at", "_part", "_before_n")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1,
                  out: str = "rank") -> DataFrame:
    """First k rows per group; Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def sum_columns(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])
