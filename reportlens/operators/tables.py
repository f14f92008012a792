"""Selections, joins and summaries on report, label and run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from ..session import constant, cut_lineage
from .ranking import global_rank, running_totals, sum_columns, top_per_group

# --- choosing rows and columns ----------------------------------------------


def split_usable(df: DataFrame, col: str, min_chars: int = fixed.MIN_REPORT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows)."""
    ok = text.is_usable(F.col(col), min_chars)
    return df.where(ok), df.where(~ok)


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows whose keys have no result yet."""
    return df if overwrite else df.join(done.select(*keys), list(keys), "left_anti")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def split_columns(df: DataFrame, label: str, exclude: Sequence[str] = tuple(fixed.NON_FEATURES)) \
        -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by type, without ids and the label."""
    numeric = numeric_columns(df, [*exclude, label])
    skip = {*exclude, label, *numeric}
    return numeric, [c for c in df.columns if c not in skip]


def vector_from_columns(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = (),
                        out: str = "embedding") -> DataFrame:
    """Pack named columns, or all numeric ones, into one vector; gaps get the column mean."""
    lacking = [c for c in cols or [] if c not in df.columns]
    if lacking:
        raise ValueError(f"no such columns: {lacking}")
    cols = list(cols or numeric_columns(df, exclude))
    rest = [c for c in df.columns if c not in cols]
    double = df.select(*rest, *[F.col(c).cast("double").alias(c) for c in cols])
    full = Imputer(strategy="mean", inputCols=cols, outputCols=cols).fit(double).transform(double)
    return full.select(*rest, F.array(*cols).alias(out))


def vector_to_columns(df: DataFrame, vec: str, dim: int, prefix: str = "emb_") -> DataFrame:
    return df.select("*", *[F.element_at(vec, i + 1).alias(f"{prefix}{i}") for i in range(dim)]).drop(vec)


def fill_vector_gaps(df: DataFrame, vec: str) -> DataFrame:
    """NaN and null entries of an array column get the mean of their position."""
    cell = F.when(~F.isnan("x"), F.col("x"))
    means = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")) \
        .groupBy("i").agg(F.avg(cell).alias("m"))
    packed = constant(means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e.m).alias("m")))
    filled = F.zip_with(F.col(vec).cast("array<double>"), F.col("_m"),
                        lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x))
    return df.withColumn("_m", packed).withColumn(vec, filled).drop("_m")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def without_prefix_flags(df: DataFrame, prefix: str = "malignancy") -> DataFrame:
    """Rows whose columns with the prefix add up to 0; a null among them drops the row."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.where(sum_columns(cols) == 0) if cols else df


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=existing(df, cols))


def first_cases(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def vector_checks(df: DataFrame, vec: str, ids: Sequence[str], dim: int, ranges: int = 5) -> DataFrame:
    """One row: wrong lengths, gaps, zero vectors, repeated ids, ranges of the first dimensions."""
    v = F.col(vec)
    gaps = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x)))
    spans = [c for i in range(ranges) for c in (F.min(F.element_at(v, i + 1)).cast("double").alias(f"min_{i}"),
                                                F.max(F.element_at(v, i + 1)).cast("double").alias(f"max_{i}"))]
    per_id = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).scalar()
    checks = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(v) != dim).alias("n_wrong_dim"),
                    F.coalesce(F.sum(gaps.cast("bigint")), F.lit(0)).alias("n_gaps"),
                    F.count_if(F.forall(v, lambda x: x == 0)).alias("n_zero"), *spans)
    return checks.withColumn("n_repeated", repeated)


def repeated_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def collapse_rare(df: DataFrame, cols: Sequence[str], min_count: int = 5) -> DataFrame:
    """Null becomes missing, values seen fewer than min_count times become one rare level.

    One counting pass serves all columns, and only counts are shuffled.
    """
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING)) for c in cols})
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])
    counts = filled.select(F.explode(pairs).alias("e")).groupBy("e.col", "e.value").agg(F.count(F.lit(1)).alias("n"))
    for c in cols:
        keep = counts.where((F.col("col") == c) & (F.col("n") >= min_count)).select(F.col("value").alias("_keep"))
        filled = filled.join(keep, F.col(c) == F.col("_keep"), "left") \
            .withColumn(c, F.coalesce("_keep", F.lit(fixed.RARE))).drop("_keep")
    return filled


# --- joins ------------------------------------------------------------------

def merge_keys(left: DataFrame, right: DataFrame, priority: Sequence[str] = tuple(fixed.ID_COLUMNS)) -> list[str]:
    keys = [c for c in priority if c in left.columns and c in right.columns]
    if not keys:
        raise ValueError(f"no common id column among {list(priority)}")
    return keys


def with_labels(meta: DataFrame, labels: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Inner join, one row per row_id: the label row that sorts first wins."""
    both = meta.join(labels, list(keys), "inner")
    order = [F.col(c) for c in both.columns if c != row_id]
    return top_per_group(both, [row_id], order).drop("rank")


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full")


def level_grid(df: DataFrame, variable: str, group: str, value: str) -> DataFrame:
    """Every (variable, group level) with the label heights of its variable.

    Both level sets are small; they meet through one packed list of levels.
    """
    levels = constant(df.agg(F.sort_array(F.collect_set(group)).alias("g")))
    spans = df.groupBy(variable).agg((F.max(value) * 0.9).alias("global_max"), F.min(value).alias("global_min"))
    grid = spans.withColumn(group, F.explode(levels))
    heights = {"p_value_y": 0.95, "pairwise_y1": 1.02, "pairwise_y2": 1.07, "pairwise_y3": 1.12}
    return grid.withColumns({k: F.col("global_max") * f for k, f in heights.items()})


def features_with_outcome(features: DataFrame, outcomes: DataFrame, key: str, row: str, outcome: str) -> DataFrame:
    """Distinct feature rows with a known outcome, the smallest row id per key."""
    both = features.select(key, row).distinct().join(outcomes.select(key, outcome), key, "left")
    first = both.where(F.col(outcome).isNotNull()).groupBy(key).agg(F.min(F.struct(row, outcome)).alias("m"))
    return first.select(key, f"m.{row}", f"m.{outcome}")


def map_features(raw: DataFrame, universe: DataFrame, raw_col: str = "raw_feature", key_col: str = "json_key") -> DataFrame:
    """(raw_feature, raw_feature_clean, matched_json_keys, n_matches, status).

    A name matches a key that equals it, equals it after normalisation, or ends with _ and it.
    Every suffix of a key is listed, so the suffix rule is an equality join too.
    """
    names = raw.select(F.col(raw_col).alias("raw_feature")).distinct() \
        .withColumn("raw_feature_clean", text.match_name(F.col("raw_feature")))
    tries = names.select("raw_feature", F.explode(F.array_distinct(F.array(
        "raw_feature", "raw_feature_clean", text.norm_name(F.col("raw_feature_clean"))))).alias("name")).where("name <> ''")
    keys = universe.select(F.col(key_col).alias("k")).distinct()
    parts = F.split("k", "_")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    tails = F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<string>"))
    exact = keys.select("k", F.explode(F.concat(F.array("k"), tails)).alias("name"))
    normed = top_per_group(keys.withColumn("norm", text.norm_name(F.col("k"))), ["norm"], [F.col("k").desc()])
    hits = tries.join(exact, "name").select("raw_feature", "k").unionByName(
        tries.withColumn("norm", text.norm_name(F.col("name"))).join(normed.select("norm", "k"), "norm")
        .select("raw_feature", "k")).distinct()
    found = hits.groupBy("raw_feature").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    n = F.coalesce(F.size("ks"), F.lit(0))
    return names.join(found, "raw_feature", "left").select(
        "raw_feature", "raw_feature_clean", F.coalesce(F.array_join("ks", " | "), F.lit("")).alias("matched_json_keys"),
        F.when(F.col("ks").isNull(), 0).otherwise(n).alias("n_matches"),
        F.when(F.col("ks").isNull(), "unmatched").otherwise("matched").alias("status"))


def or_all(matched: DataFrame, universe: DataFrame) -> DataFrame:
    """The matched keys, or the whole universe if nothing matched."""
    return universe if matched.isEmpty() else matched


# --- summaries --------------------------------------------------------------

def support_summary(df: DataFrame, *group: str, score: str = "support_score") -> DataFrame:
    s = F.col(score)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_support"), F.avg(F.abs(s)).alias("mean_abs_support"),
        F.avg((s < 0).cast("double")).alias("neg_rate"))


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], *group: str) -> DataFrame:
    """(group, <name>...): exact, linearly interpolated quantiles without sorting a group in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")) \
        .agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)        # used four times: one scan of the rows instead
    ranked = running_totals(counts, "v", ["n"], group)
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    rows = ranked.join(totals, list(group)) if group else ranked.withColumn("total", totals.scalar())
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi, w = F.floor(at), F.ceil(at), at - F.floor(at)
        here = lambda i: (F.col("before_n") <= i) & (F.col("before_n") + F.col("n") > i)
        low, high = F.max(F.when(here(lo), F.col("v"))), F.max(F.when(here(hi), F.col("v")))
        picks.append((low + (high - low) * F.max(w)).alias(name))
    return rows.groupBy(*group).agg(*picks)


def long_numbers(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(ids, variable, value) of numeric columns."""
    double = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return double.unpivot(list(ids), list(cols), "variable", "value")


def composition(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """(cluster, variable): mean, spread and count, rounded to 3."""
    return long_numbers(df, [cluster], cols).groupBy(cluster, "variable").agg(
        F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_samp("value"), 3).alias("std"),
        F.count("value").alias("count"))


def composition_of(df: DataFrame, cluster: str, cluster_id: int, cols: Sequence[str]) -> DataFrame:
    """(variable): mean, spread, range and median in one cluster."""
    long = long_numbers(df.where(F.col(cluster) == cluster_id), [], cols)
    stats = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                         F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(quantiles(long, "value", {"median": 0.5}, "variable"), "variable")


def shares(df: DataFrame, count: str, *within: str, out: str = "share") -> DataFrame:
    """Part of each row's count in the total of its group; goes on pre-aggregated counts."""
    return df.withColumn(out, F.col(count) / F.sum(count).over(Window.partitionBy(*within)))


def two_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two labels with row and column percentages."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    return n.withColumns({
        "a_total": F.sum("count").over(Window.partitionBy(a)), "b_total": F.sum("count").over(Window.partitionBy(b)),
    }).withColumns({"a_percent": F.col("count") / F.col("a_total") * 100,
                    "b_percent": F.col("count") / F.col("b_total") * 100})


def score_percent(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Percentage of each score within its group."""
    n = df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*group))
    return n.withColumn("total", total).withColumn("percentage", F.col("count") / F.col("total") * 100)


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)


def value_mix(df: DataFrame, label: str, value: str, top: int = 4) -> DataFrame:
    """Shares of the most common values per label, the others as one."""
    filled = df.withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("NA")))
    counts = filled.groupBy(label, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(value).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), value).limit(top)
    kept = counts.join(best.select(value, F.lit(True).alias("_top")), value, "left")
    named = kept.withColumn("value_grouped", F.when(F.col("_top"), F.col(value)).otherwise("Other"))
    grouped = named.groupBy(label, "value_grouped").agg(F.sum("n").alias("n"))
    return shares(grouped, "n", label, out="prop")


def z_scores(df: DataFrame, cols: Sequence[str], eps: float = 1e-12) -> Column:
    """Sum of z-scores (population spread) over a whole table."""
    stats = df.agg(F.struct(*[s for c in cols for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
                   .alias("s")).scalar()
    parts = [(F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] + eps) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def min_max(df: DataFrame, cols: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Columns on a 0-1 scale over a small table."""
    w = Window.partitionBy()
    return df.withColumns({c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + eps) for c in cols})


def wide_shares(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Pivot with 0 for gaps, columns from the largest total down."""
    order = [r[0] for r in df.groupBy(col).agg(F.sum(value).alias("t")).orderBy(F.desc("t"), col).collect()]
    return df.groupBy(row).pivot(col, order).agg(F.sum(value)).na.fill(0)


def symmetric(pairs: DataFrame, a: str, b: str, value: str, names: Sequence[str]) -> DataFrame:
    """Square matrix of a pair list with a diagonal of 1."""
    cells = F.array(F.struct(F.col(a).alias("row"), F.col(b).alias("col"), F.col(value).alias("v")),
                    F.struct(F.col(b).alias("row"), F.col(a).alias("col"), F.col(value).alias("v")))
    diagonal = pairs.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "row string, col string, v double")
    long = pairs.select(F.explode(cells).alias("e")).select("e.*").unionByName(diagonal)
    return long.groupBy("row").pivot("col", list(names)).agg(F.first("v"))


def concat_last(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two tables by name; a key in both keeps the row of the second."""
    return first.join(second.select(key), key, "left_anti").unionByName(second, allowMissingColumns=True)


# --- runs and leaderboards --------------------------------------------------

def good_runs(runs: DataFrame, min_clusters: int = 2, max_noise: float = 0.5) -> DataFrame:
    return runs.where((F.col("n_clusters") >= min_clusters) & (F.col("noise_ratio") <= max_noise))


def best_runs(runs: DataFrame, k: int, metric: str = "silhouette", min_clusters: int = 2,
              max_noise: float = 0.5) -> DataFrame:
    """Top k runs by a metric; Davies-Bouldin counts upward; ties keep run order."""
    order = F.col(metric).asc_nulls_last() if metric == "davies_bouldin" else F.col(metric).desc_nulls_last()
    return good_runs(runs, min_clusters, max_noise).orderBy(order, "ordinal").limit(k)


def ranked_runs(runs: DataFrame, metric: str = "silhouette") -> DataFrame:
    """The leaderboard with its ranks."""
    return global_rank(runs, [F.desc(metric), "ordinal"])


def top_per_algorithm(runs: DataFrame, k: int = 3) -> DataFrame:
    return top_per_group(runs, ["algorithm"], [F.desc("silhouette"), F.col("ordinal")], k)


def algorithm_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("algorithm").agg(
        F.avg("silhouette").alias("sil_mean"), F.max("silhouette").alias("sil_max"),
        F.stddev_samp("silhouette").alias("sil_std"), F.count("silhouette").alias("n_runs"),
        F.avg("n_clusters").alias("k_mean"), F.stddev_samp("n_clusters").alias("k_std"),
        F.avg("noise_ratio").alias("noise_mean"))


def best_per_algorithm(runs: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("config_key", "silhouette"), F.struct(F.col("silhouette"), -F.col("ordinal"))).alias("b")
    return runs.groupBy("algorithm").agg(best, F.count(F.lit(1)).alias("n_configs")) \
        .select("algorithm", "b.config_key", "b.silhouette", "n_configs")


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("n_configs"), F.countDistinct("algorithm").alias("n_algorithms"),
                    F.max("silhouette").alias("best_silhouette"), F.avg("silhouette").alias("mean_silhouette"))


def trend(df: DataFrame, x: str = "n_clusters", y: str = "silhouette") -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def progression(runs: DataFrame) -> DataFrame:
    """Runs of each algorithm from best to worst with the best one marked."""
    w = Window.partitionBy("algorithm").orderBy(F.desc("silhouette"), "ordinal")
    return runs.withColumn("step", F.row_number().over(w)).withColumn("is_best", F.col("step") == 1)


def components_needed(variances: DataFrame, target: float = 0.95) -> DataFrame:
    """First component count whose cumulative share of variance reaches the target."""
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cum = variances.withColumn("cum", F.sum("share").over(w))
    return cum.agg(F.coalesce(F.min(F.when(F.col("cum") >= target, F.col("i"))), F.max("i")).alias("k"))


def id_columns(df: DataFrame, named: Sequence[str] | None = None) -> list[str]:
    """Named ids, else known id names, else the first two non-numeric columns."""
    known = list(named) if named is not None else existing(df, fixed.COMMON_IDS)
    numeric = set(numeric_columns(df))
    return known or [c for c in df.columns if c not in numeric][:2]


def label_columns(runs: DataFrame, k: int = 5) -> DataFrame:
    """Top runs with the column name of each: algorithm, rank, silhouette and k."""
    top = runs.orderBy(F.desc("silhouette"), "ordinal").limit(k)
    best = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("silhouette"), "ordinal")))
    name = F.format_string("cluster_%s_rank%d_sil%.4f_k%d", "algorithm", "rank", "silhouette", "n_clusters")
    return best.withColumn("column_name", name)


def simplified_labels(ids: DataFrame, assignments: DataFrame, runs: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Ids, the best label, and one column per top run; the run list on the driver has k rows."""
    top = label_columns(runs, k).select("run_id", "rank", "column_name").orderBy("rank").collect()
    names = [r.column_name for r in top]
    pick = assignments.join(
        ids.sparkSession.createDataFrame([(r.run_id, r.column_name) for r in top], "run_id string, column_name string"),
        "run_id")
    wide = pick.groupBy(key).pivot("column_name", names).agg(F.first("label"))
    return ids.join(wide, key).withColumn("best_cluster_label", F.col(f"`{names[0]}`"))
