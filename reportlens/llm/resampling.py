"""Importance resampling: documents drawn by how much more likely target text makes them than raw text.

Two bag models over hashed word uni- and bigrams, one of labelled target documents and one of the
whole corpus, give each document a log weight; the k documents with the largest log weight plus a
Gumbel draw are a sample without replacement by weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U64, chain, inside, mix, text_slices, words_of
from .common import bound_batches, mapped, packed, written

BUCKETS = 1 << 16
MAX_LABELLED = 20_000       # labelled documents the target model is fitted on: those with the smallest hashes
PRIOR = 4.0                 # n-grams of raw text added to the target model, per bucket
RADIX = 16


def _buckets(words) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all uni- and bigrams, and the text of each."""
    owner = words.owner()
    pairs = inside(words, 2)
    grams = np.concatenate([words.hashes, chain(words.hashes, 2)[pairs]])
    return (mix(grams) % U64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[:len(pairs)][pairs]])


@dataclass
class Model:
    """log p_target / p_raw per bucket, and the share of documents to keep."""
    log_ratio: np.ndarray
    share: float


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_labelled: int = MAX_LABELLED) -> Model:
    """Counts n-grams of every document, and again of those labelled 1 in the bounded sample.

    Each task sends one short row per bucket it has seen. share is the upper bound (three standard errors) of the share of label 1 in the
    sample. Without target documents every weight is 0 and all are kept.
    """
    known = labels.where(f"`{key}` is not null and `{label}` is not null").groupBy(key).agg(F.max(label).alias("_y"))
    known = written(known.orderBy(F.xxhash64(key), key).limit(max_labelled))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("_y") == 1).cast("bigint")), F.lit(0))).first()
    if not good:
        return Model(np.zeros(BUCKETS), 1.0)
    p = good / n
    share = min(1.0, p + 3 * sqrt(p * (1 - p) / n))
    target = F.broadcast(known.where("_y = 1").select(key, F.lit(True).alias("_target")))      # at most max_labelled rows
    rows = docs.select(key, text).join(target, key, "left").select(F.col(text).alias("text"), F.coalesce("_target", F.lit(False)).alias("target"))

    def count(batches):
        import pyarrow as pa
        raw, near = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at, to in text_slices(batch.column(0)):
                bucket, owner = _buckets(words_of(batch.column(0).slice(at, to - at)))
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False)
                if chosen.any():
                    near += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(near[seen])], names=["bucket", "raw", "target"])

    bound_batches(rows)
    counts = rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, near = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts.collect():                                # at most BUCKETS rows
        raw[b], near[b] = r, t
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    weight = PRIOR * BUCKETS
    return Model(np.log((near + weight * p_raw) / (near.sum() + weight)) - np.log(p_raw), share)


def _sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-1) ^ bits ^ np.int64(-2**63), bits)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """row (all columns of docs), log_weight, and place: the perturbed weight as a sortable whole number.

    The Gumbel draw is a hash of seed, key and words, so a lost executor repeats it.
    """
    log_ratio = docs.sparkSession.sparkContext.broadcast(model.log_ratio)      # BUCKETS numbers
    rows = packed(docs).withColumn("_t", F.col(f"row.{text}")).withColumn("_k", F.xxhash64(F.col(f"row.{key}")))
    schema = T.StructType([rows.schema["row"], T.StructField("log_weight", T.DoubleType()), T.StructField("place", T.LongType())])

    def score(batch):
        words = words_of(batch.column(1))
        bucket, owner = _buckets(words)
        n = batch.num_rows
        weight = np.bincount(owner, log_ratio.value[bucket], minlength=n)
        sums = np.concatenate([[U64(0)], np.cumsum(mix(words.hashes + U64(seed)))])
        own = sums[words.ptr[1:]] - sums[words.ptr[:-1]]
        draw = mix(own ^ mix(batch.column(2).to_numpy().view(U64) + U64(seed)))
        u = ((draw >> U64(11)).astype(float) + 0.5) / 2.0**53
        return {"row": batch.column(0), "log_weight": weight, "place": _sortable(weight - np.log(-np.log(u)))}

    return mapped(rows, score, schema, "_t")


def kth_place(places: DataFrame, k: int) -> int | None:
    """The k-th largest `place`, by four counts of at most 2^16 groups; null if there are fewer rows."""
    prefix, rest = 0, k
    for step in range(4):
        shift = 64 - RADIX * (step + 1)
        # Digits of the number with its sign bit flipped, so they sort as the numbers do.
        flipped = F.col("place").bitwiseXOR(F.lit(-2**63))
        rows = places if step == 0 else places.where(F.shiftrightunsigned(flipped, shift + RADIX) == F.lit(prefix))
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << RADIX) - 1))
        for d, n in sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if n >= rest:
                prefix = (prefix << RADIX) | d
                break
            rest -= n
        else:
            return None
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def threshold(places: DataFrame, share: float) -> int | None:
    """The smallest place that is kept; null keeps all. Rows that tie with it are all kept."""
    n = places.count()
    return None if share >= 1.0 or not n else kth_place(places, ceil(n * share))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             share: float | None = None) -> DataFrame:
    """(key, log_weight, kept) of every row of docs.

    Null and empty texts have weight 0. Rows with equal key and text share their draw and their fate.
    """
    model = fit(docs, labels, key, text, label)
    rows = written(scored(docs.select(key, text), model, key, text).select(F.col(f"row.{key}").alias(key), "log_weight", "place"))
    least = threshold(rows.select("place"), model.share if share is None else share)
    kept = F.lit(True) if least is None else F.col("place") >= F.lit(least)
    return rows.select(key, F.round("log_weight", 6).alias("log_weight"), kept.alias("kept"))


def keep_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                share: float | None = None) -> DataFrame:
    """The drawn rows of docs with their own columns; texts are scored once more instead of being joined."""
    model = fit(docs, labels, key, text, label)
    places = written(scored(docs.select(key, text), model, key, text).select("place"))
    least = threshold(places, model.share if share is None else share)
    return docs if least is None else scored(docs, model, key, text).where(F.col("place") >= F.lit(least)).select("row.*")
