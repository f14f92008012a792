"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

HASH_BITS = 52
ROWS_PER_BUCKET = 200_000


def _number(text: Column) -> Column:
    """HASH_BITS bits of the text's MD5 as a number, the same in any SQL engine."""
    return F.conv(F.left(F.md5(text), F.lit(HASH_BITS // 4)), 16, 10).cast("bigint")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a uniform u of key and shard; the smallest cost takes the key."""
    u = (_number(F.concat(_text(key), F.lit(f"/{shard}"))) + 0.5) / float(1 << HASH_BITS)
    return -F.ln(u) / weight


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key: each shard draws an exponential time at the rate of its weight, the first wins.

    Adding a shard, or raising a weight, moves keys only into that shard; removing one moves only its
    keys. A null key counts as one key of its own. Ties go to the smaller shard number.
    """
    chances = [F.struct(_cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in sorted(weights.items()) if w > 0]
    if not chances:
        raise ValueError("no shard has a weight over 0")
    return (F.least(*chances) if len(chances) > 1 else chances[0])["shard"]


def shard_rows(rows: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
               n_rows: int | None = None) -> DataFrame:
    """Adds shard, slot (0, 1, ... in each shard) and, for a changed table of weights, grown_shard.

    rows: short rows; leave texts out, since a slot costs one shuffle. Rows may repeat and keys may be
    null. An empty table stays empty. n_rows, the number of rows, is counted if not given.
    """
    columns = rows.columns
    out = rows.withColumn("shard", rendezvous(F.col(key), weights))
    if grown is not None:
        out = out.withColumn("grown_shard", rendezvous(F.col(key), grown))
    n_rows = rows.count() if n_rows is None else n_rows
    buckets = max(8, -(-n_rows // (ROWS_PER_BUCKET * max(1, len(weights)))))
    return numbered(out, ["shard"], columns, _number(F.concat_ws("/", *[_text(F.col(c)) for c in columns])), buckets, "slot")
