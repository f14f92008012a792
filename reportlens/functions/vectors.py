"""Column functions on array<float|double> vectors; nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, not once per element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def fit_dim(vec: Column, dim: int) -> Column:
    """Pad with zeros or cut to dim; null becomes the zero vector."""
    return let(vec.cast("array<float>"), lambda v: F.when(F.size(v) == dim, v).otherwise(
        F.slice(F.concat(F.coalesce(v, F.array().cast("array<float>")), zeros(dim)), 1, dim)))


def concat_sections(vecs: Sequence[Column], dim: int) -> Column:
    """Section vectors in the given order, each brought to dim."""
    return F.concat(*[fit_dim(v, dim) for v in vecs])


def section_slice(vec: Column, i: int, dim: int) -> Column:
    return F.slice(vec, i * dim + 1, dim)


def without_section(vec: Column, i: int, dim: int, n: int) -> Column:
    return F.concat(F.slice(vec, 1, i * dim), F.slice(vec, (i + 1) * dim + 1, (n - i - 1) * dim)) \
        if n > 1 else F.array().cast("array<float>")


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def nan_to_zero(vec: Column) -> Column:
    return F.transform(as_double(vec), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def total(vec: Column) -> Column:
    return F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm2(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def scale(vec: Column, by: Column) -> Column:
    return F.transform(as_double(vec), lambda x: x * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def unit(vec: Column, eps: float = 1e-12) -> Column:
    """Length one, with eps in the denominator."""
    return let(norm2(vec) + eps, lambda length: F.transform(as_double(vec), lambda x: x / length))


def normalize(vec: Column, norm: str = "l2") -> Column:
    """Row normalisation by l1, l2 or max; NaN counts as 0 and zero rows stay zero."""
    sizes = {
        "l1": lambda v: total(F.transform(v, F.abs)),
        "l2": norm2,
        "max": lambda v: F.array_max(F.transform(v, F.abs)),
    }
    divided = lambda v: let(sizes[norm](v), lambda size: F.when(
        size > 0, F.transform(v, lambda x: x / size)).otherwise(v))
    return let(nan_to_zero(vec), divided)


def token_codes(text: Column, dim: int) -> Column:
    """One signed bucket per word: bucket + 1, negative for the other sign."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def code(word):
        bucket = F.pmod(F.conv(F.left(word, F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)) + 1
        return F.when(F.substr(word, F.lit(9), F.lit(1)) < "8", bucket).otherwise(-bucket)

    return F.transform(F.transform(words, F.md5), code)


def hashing_vector(text: Column, dim: int) -> Column:
    """Deterministic stand-in for a language model: signed word counts in hashed buckets."""
    count = lambda codes, b: F.aggregate(codes, F.lit(0), lambda n, c: F.when(
        c == b, n + 1).when(c == -b, n - 1).otherwise(n))
    return let(token_codes(F.coalesce(text, F.lit("")), dim), lambda codes: F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda b: count(codes, b).cast("float")))
