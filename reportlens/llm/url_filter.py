"""URL verdicts from rules and, where no rule fits, from boosted trees on lexical features.

Only DataFrame functions and Spark's own trees; nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LABELLED = 20_000       # labelled URLs to train on; the ones with the smallest hashes
MAX_SUFFIXES = 10_000       # host suffixes with statistics of their own
ENTROPY_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#=&%:+"
TREES, DEPTH = 20, 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as columns; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule `host/path` that fits the host or a parent domain and begins the path; else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        at_host = (host == F.lit(name)) | host.endswith(F.lit("." + name))
        fits.append(F.when(at_host & path.startswith(F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of url, host and path: length, depth, digit ratio, entropy, parameter counts."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low, n = F.translate(url, UPPER, LOWER), F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    spread = F.lit(0.0)
    for c in ENTROPY_CHARS:
        share = (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / n
        spread = spread - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return urls.select(
        "*", F.length(url).cast("double").alias("f_length"), F.length("host").cast("double").alias("f_host_length"),
        _count(F.col("host"), r"[^.]+").alias("f_labels"), _count(F.col("path"), r"[^/]+").alias("f_depth"),
        (_count(url, r"[^0-9]+") / n).alias("f_digit_ratio"), spread.alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, r"[^&]+") + 1).alias("f_parameters"),
        _count(url, r"[^-_%]+").alias("f_marks"), F.when(F.col("path").rlike(r"\.[A-Za-z0-9]+$"), 1.0).otherwise(0.0).alias("f_file"),
        F.when(url.startswith("https:"), 1.0).otherwise(0.0).alias("f_secure"), _suffix(F.col("host"), 1).alias("suffix1"),
        _suffix(F.col("host"), 2).alias("suffix2"), F.regexp_extract("path", r"^/[^/]*", 0).alias("first"))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


LEXICAL = ["f_length", "f_host_length", "f_labels", "f_depth", "f_digit_ratio", "f_entropy", "f_parameters", "f_marks", "f_file",
           "f_secure"]
SUFFIX = ["suffix1", "suffix2", "first"]


def with_suffix_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """Share of blocked URLs and evidence for each suffix; unseen suffixes get the prior. Tables are bounded."""
    for name, table in rates.items():
        rows = rows.join(F.broadcast(table), rows[name] == table[f"_{name}"], "left").drop(f"_{name}")
        rows = rows.withColumns({f"r_{name}": F.coalesce(f"r_{name}", F.lit(0.5)), f"s_{name}": F.coalesce(f"s_{name}", F.lit(0.0))})
    return rows


def suffix_rates(labelled: DataFrame) -> dict[str, DataFrame]:
    """Smoothed share of blocked rows, and the log of their number, of the most frequent suffixes."""
    out = {}
    for name in SUFFIX:
        counts = labelled.groupBy(F.col(name).alias(f"_{name}")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
        counts = counts.orderBy(F.desc("n"), f"_{name}").limit(MAX_SUFFIXES)
        out[name] = counts.select(f"_{name}", ((F.col("bad") + 1) / (F.col("n") + 2)).alias(f"r_{name}"),
                                  F.log1p("n").alias(f"s_{name}"))
    return out


class UrlFilter:
    """Trees trained on a bounded sample of labelled URLs: rows of url, host, path and label (1: block).

    The sample has the rows with the smallest hashes, so it does not depend on partitions. Without rows,
    or with one class only, the verdict is that class (allow if there is none).
    """

    def __init__(self, labelled: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        sample = labelled.select("url", "host", "path", F.col("label").cast("double").alias("label")).where("label is not null")
        sample = written(lexical(sample.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)))
        seen = {r["label"] for r in sample.select("label").distinct().collect()}
        self.only = None if len(seen) == 2 else (1.0 if seen == {1.0} else 0.0)
        self.rates = suffix_rates(sample)
        names = LEXICAL + [f"{k}_{s}" for s in SUFFIX for k in ("r", "s")]
        self.columns = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")
        if self.only is None:
            trainer = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed,
                                    predictionCol="_prediction")
            self.model = trainer.fit(self.columns.transform(with_suffix_rates(sample, self.rates)).select("_features", "label"))

    def blocked(self, urls: DataFrame) -> DataFrame:
        """Adds blocked (boolean) to rows with url, host and path."""
        if self.only is not None:
            return urls.withColumn("blocked", F.lit(self.only == 1.0))
        rows = self.columns.transform(with_suffix_rates(lexical(urls), self.rates))
        return self.model.transform(rows).select(*urls.columns, (F.col("_prediction") == 1.0).alias("blocked"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of each page.

    rules: (rule, allow or block), a short list that becomes part of the plan. The URLs that a rule
    fits are the labelled ones; trees learned from them judge the rest. Null and malformed URLs have an
    empty host and path and are judged by the trees.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key), F.col("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    said = {r: v for r, v in rules}
    block = F.col("rule").isin([r for r, v in said.items() if v == "block"])
    labelled = rows.where("rule is not null").withColumn("label", F.when(block, 1.0).otherwise(0.0))
    judged = UrlFilter(labelled).blocked(rows)
    bad = F.when(F.col("rule").isNotNull(), block).otherwise(F.col("blocked"))
    return judged.select(key, "host", "path", "rule", F.when(bad, "block").otherwise("allow").alias("verdict"))
