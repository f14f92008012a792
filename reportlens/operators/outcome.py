"""Baseline tables, rank tests, regressions and survival by group.

Tests run on counts of distinct values, so ties and hot groups shrink before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails, text
from ..session import cut_lineage
from . import tables
from .ranking import cut_points, running_totals, top_per_group

OVERALL = "Overall"


# --- baseline table -----------------------------------------------------------

def _strata(df: DataFrame, stratum: str | None) -> DataFrame:
    """Each row for the whole cohort and, if asked, for its stratum."""
    levels = [F.lit(OVERALL)] + ([F.col(stratum).cast("string")] if stratum else [])
    return df.withColumn("stratum", F.explode(F.array(*levels))).where(F.col("stratum").isNotNull())


def numeric_baseline(df: DataFrame, cols: Sequence[str], stratum: str | None = None) -> DataFrame:
    """(stratum, variable): n, mean, SD, median and quartiles."""
    long = tables.long_numbers(_strata(df, stratum), ["stratum"], cols)
    moments = long.groupBy("stratum", "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    cut = tables.quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "stratum", "variable")
    return moments.join(cut, ["stratum", "variable"], "left")


def categorical_baseline(df: DataFrame, cols: Sequence[str], stratum: str | None = None) -> DataFrame:
    """(stratum, variable, level): n and percent of known values; two-level variables show the second level."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    long = _strata(df, stratum).select("stratum", F.explode(pairs).alias("e")).select("stratum", "e.*").where("level is not null")
    n = long.groupBy("stratum", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    levels = n.groupBy("variable").agg(F.countDistinct("level").alias("n_levels"), F.min("level").alias("first"))
    shown = tables.shares(n, "n", "stratum", "variable", out="part").join(levels, "variable") \
        .where((F.col("n_levels") != 2) | (F.col("level") != F.col("first")))
    return shown.select("stratum", "variable", "level", "n", (F.col("part") * 100).alias("percent"))


def baseline_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], skewed: Sequence[str] = (),
                   stratum: str | None = None) -> DataFrame:
    """(stratum, row_name, label, value): mean (SD), median [IQR] and n (%) as text, one decimal."""
    num = numeric_baseline(df, numeric, stratum)
    is_skewed = F.col("variable").isin(list(skewed)) if skewed else F.lit(False)
    num = num.select(
        "stratum", F.concat("variable", F.when(is_skewed, " (median [IQR])").otherwise(" (mean (SD))")).alias("row_name"),
        F.when(is_skewed, F.format_string("%.1f [%.1f, %.1f]", "median", "q1", "q3"))
        .otherwise(F.format_string("%.1f (%.1f)", "mean", "sd")).alias("value"))
    cat = categorical_baseline(df, categorical, stratum).select(
        "stratum", F.concat("variable", F.lit(" = "), "level", F.lit(" (%)")).alias("row_name"),
        F.format_string("%d (%.1f)", "n", "percent").alias("value"))
    n = _strata(df, stratum).groupBy("stratum").agg(F.count(F.lit(1)).cast("string").alias("value")) \
        .select("stratum", F.lit("n").alias("row_name"), "value")
    out = n.unionByName(num).unionByName(cat)
    return out.select("stratum", "row_name", text.row_label(F.col("row_name")).alias("label"), "value")


def anova(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """(variable, f, df1, df2): one-way analysis of variance."""
    long = tables.long_numbers(df.where(F.col(group).isNotNull()), [group], cols).where("value is not null")
    by = long.groupBy("variable", group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"),
                                             F.var_pop("value").alias("v"))
    t = by.groupBy("variable").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("s") * F.col("s") / F.col("n")
    return t.select("variable", (between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"),
                    (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def chi_square(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """(variable, chi2, df): Pearson test with continuity correction in 2 x 2 tables."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("a")) for c in cols])
    long = df.select(F.col(group).cast("string").alias("b"), F.explode(pairs).alias("e")).select("b", "e.*") \
        .where("a is not null and b is not null")
    cells = long.groupBy("variable", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("variable", "a").agg(F.sum("o").alias("ra"))
    cols_ = cells.groupBy("variable", "b").agg(F.sum("o").alias("rb"))
    size = cells.groupBy("variable").agg(F.sum("o").alias("n"), F.countDistinct("a").alias("ka"),
                                         F.countDistinct("b").alias("kb"))
    grid = rows.join(cols_, "variable").join(size, "variable").join(cells, ["variable", "a", "b"], "left") \
        .withColumn("e", F.col("ra") * F.col("rb") / F.col("n")) \
        .withColumn("gap", F.abs(F.coalesce("o", F.lit(0)) - F.col("e")))
    t = grid.groupBy("variable", "ka", "kb").agg(
        F.min("gap").alias("least"), F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("s2"),
        F.sum(F.col("gap") / F.col("e")).alias("s1"), F.sum(1 / F.col("e")).alias("s0"))
    fix = F.when((F.col("ka") == 2) & (F.col("kb") == 2), F.least(F.lit(0.5), F.col("least"))).otherwise(0.0)
    stat = F.col("s2") - 2 * fix * F.col("s1") + fix * fix * F.col("s0")
    return t.select("variable", stat.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"))


def baseline_tests(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], skewed: Sequence[str],
                   group: str) -> DataFrame:
    """(variable, test, statistic, p) with the default test of each kind of variable."""
    normal = [c for c in numeric if c not in skewed]
    parts = []
    if normal:
        parts.append(anova(df, normal, group).select(
            "variable", F.lit("anova").alias("test"), F.col("f").alias("statistic"),
            tails.f_p(F.col("f"), F.col("df1"), F.col("df2")).alias("p")))
    if skewed:
        long = tables.long_numbers(df, [group], list(skewed))
        parts.append(kruskal(long, "value", group, "variable").select(
            "variable", F.lit("kruskal").alias("test"), F.col("h").alias("statistic"),
            tails.chi2_p(F.col("h"), F.col("df")).alias("p")))
    if categorical:
        parts.append(chi_square(df, categorical, group).select(
            "variable", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"),
            tails.chi2_p(F.col("chi2"), F.col("df")).alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- rank tests ---------------------------------------------------------------

def _rank_sums(df: DataFrame, value: str, cluster: str, strata: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((strata, cluster): n, rank sum) and ((strata): n, k, smallest cluster, tie sum)."""
    known = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull())
    cells = known.groupBy(*strata, cluster, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(cells)          # counts of distinct values, used five times
    values = cells.groupBy(*strata, "v").agg(F.sum("n").alias("t"))
    ranked = running_totals(values, "v", ["t"], strata).withColumn("avg_rank", F.col("before_t") + (F.col("t") + 1) / 2)
    joined = cells.join(ranked.select(*strata, "v", "avg_rank"), [*strata, "v"])
    sums = joined.groupBy(*strata, cluster).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"))
    ties = values.groupBy(*strata).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    sizes = sums.groupBy(*strata).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"))
    return sums, sizes.join(ties, list(strata))


def kruskal(df: DataFrame, value: str, cluster: str, *strata: str, min_rows: int = 0) -> DataFrame:
    """(strata, h, df, n): Kruskal-Wallis with tie correction; only where every cluster has min_rows."""
    if not strata:
        return kruskal(df.withColumn("_all", F.lit(1)), value, cluster, "_all", min_rows=min_rows).drop("_all")
    sums, sizes = _rank_sums(df, value, cluster, strata)
    sizes = sizes.where((F.col("k") > 1) & (F.col("smallest") >= min_rows))
    part = sums.groupBy(*strata).agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"))
    t = sizes.join(part, list(strata))
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return t.select(*strata, h.alias("h"), (F.col("k") - 1).alias("df"), F.col("total").alias("n"))


def dunn(df: DataFrame, value: str, cluster: str, *strata: str) -> DataFrame:
    """(strata, group1, group2, z, p, p_adj) with Bonferroni; the clusters of a stratum are few."""
    if not strata:
        return dunn(df.withColumn("_all", F.lit(1)), value, cluster, "_all").drop("_all")
    sums, sizes = _rank_sums(df, value, cluster, strata)
    means = sums.select(*strata, F.col(cluster).cast("string").alias("c"), "n", (F.col("rank_sum") / F.col("n")).alias("m"))
    packed = means.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("c", "n", "m"))).alias("g"))
    t = packed.join(sizes, list(strata))
    first = t.select(*strata, "total", "ties", "g", F.posexplode("g").alias("i", "x"))
    both = first.select(*strata, "total", "ties", "x", F.size("g").alias("k"),
                        F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    n = F.col("total").cast("double")
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("x.n") + 1 / F.col("y.n"))
    z = both.select(*strata, F.col("x.c").alias("group1"), F.col("y.c").alias("group2"),
                    ((F.col("y.m") - F.col("x.m")) / F.sqrt(var)).alias("z"), (F.col("k") * (F.col("k") - 1) / 2).alias("m"))
    p = z.withColumn("p", tails.normal_p(F.col("z")))
    return p.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.col("m"))).drop("m")


def significant_pairs(pairs: DataFrame, strata: Sequence[str], alpha: float = 0.05, k: int = 3) -> DataFrame:
    """The k clearest pairs of each stratum."""
    return top_per_group(pairs.where(F.col("p_adj") < alpha), list(strata), [F.col("p_adj"), F.col("group1"), F.col("group2")], k)


def annotations(df: DataFrame, value: str, cluster: str, variable: str, risk: str) -> DataFrame:
    """(variable, risk, group1, group2, y, label, type): test labels and the heights to put them at."""
    grid = tables.level_grid(df, variable, risk, value)
    h = kruskal(df, value, cluster, variable, risk, min_rows=3)
    tested = h.withColumn("p", tails.chi2_p(F.col("h"), F.col("df"))).join(grid, [variable, risk])
    shown = F.when(F.col("p") < 0.001, F.concat(F.lit("p "), text.p_text(F.col("p")))) \
        .otherwise(F.concat(F.lit("p = "), text.p_text(F.col("p"))))
    none = F.lit(None).cast("string")
    overall = tested.where(~F.isnan("p")).select(
        variable, risk, none.alias("group1"), none.alias("group2"), F.col("p_value_y").alias("y"),
        shown.alias("label"), F.lit("overall").alias("type"))
    retest = tested.where((F.col("p") < 0.1) & (F.col("df") > 1)).select(variable, risk, "pairwise_y1", "pairwise_y2", "pairwise_y3")
    best = significant_pairs(dunn(df, value, cluster, variable, risk), [variable, risk]).join(retest, [variable, risk])
    pairwise = best.select(
        variable, risk, "group1", "group2",
        F.element_at(F.array("pairwise_y1", "pairwise_y2", "pairwise_y3"), F.col("rank")).alias("y"),
        text.p_stars(F.col("p_adj")).alias("label"), F.lit("pairwise").alias("type"))
    return overall.unionByName(pairwise)


# --- regressions --------------------------------------------------------------

NORMAL_95 = 1.959963984540054       # of a normal distribution, 95 percent lie within


def _design(df: DataFrame, cols: Sequence[str], outcome: str) -> tuple[DataFrame, list[str]]:
    """Complete cases with dummy columns (first level dropped) for the non-numeric columns."""
    cols = tables.existing(df, cols)
    work = tables.complete_cases(df.select(*cols, outcome), [*cols, outcome])
    numeric = set(tables.numeric_columns(work))
    names = []
    for c in cols:
        if c in numeric:
            names.append(c)
            continue
        levels = sorted(r[0] for r in work.select(F.col(c).cast("string")).distinct().collect())
        work = work.withColumns({f"{c}_{v}": (F.col(c).cast("string") == v).cast("double") for v in levels[1:]})
        names += [f"{c}_{v}" for v in levels[1:]]
    kept = work.select(F.col(outcome).cast("double").alias("y"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return kept, names


def _glm(df: DataFrame, cols: Sequence[str], outcome: str, family: str) -> DataFrame:
    work, names = _design(df, cols, outcome)
    safe = [f"_x{i}" for i in range(len(names))]
    ready = VectorAssembler(inputCols=safe, outputCol="features").transform(
        work.select("y", *[F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)]))
    model = GeneralizedLinearRegression(family=family, labelCol="y", maxIter=50, tol=1e-10).fit(ready)
    s = model.summary
    coef = [*model.coefficients, model.intercept]
    rows = [(n, float(c), float(e), float(t), float(p), outcome)
            for n, c, e, t, p in zip([*names, "const"], coef, s.coefficientStandardErrors, s.tValues, s.pValues)]
    out = df.sparkSession.createDataFrame(rows, "variable string, coef double, std_err double, stat double, p double, outcome string")
    half = F.col("std_err") * (tails.t_quantile(s.residualDegreeOfFreedom) if family == "gaussian" else NORMAL_95)
    return out.withColumns({"ci_low": F.col("coef") - half, "ci_high": F.col("coef") + half})


def binary_outcome(df: DataFrame, cols: Sequence[str], outcome: str) -> DataFrame:
    """Unpenalised logit: one row per coefficient."""
    return _glm(df, cols, outcome, "binomial")


def continuous_outcome(df: DataFrame, cols: Sequence[str], outcome: str) -> DataFrame:
    """Least squares: one row per coefficient, intervals by the t distribution."""
    return _glm(df, cols, outcome, "gaussian")


# --- survival -----------------------------------------------------------------

def kaplan_meier(df: DataFrame, time: str, event: str, *group: str) -> DataFrame:
    """(group, time, at_risk, events, survival) at every observed time."""
    by = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(*group, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("bigint")).alias("events"))
    by = cut_lineage(by)
    total = by.groupBy(*group).agg(F.sum("n").alias("total"))
    cuts = cut_points(by, "time")
    ranked = running_totals(by, "time", ["n"], group, cuts)
    ranked = ranked.join(total, list(group)) if group else ranked.withColumn("total", total.scalar())
    risk = ranked.withColumn("at_risk", F.col("total") - F.col("before_n"))
    left = 1 - F.col("events") / F.col("at_risk")
    step = risk.select(*group, "time", "at_risk", "events", F.when(left > 0, F.log(left)).otherwise(0.0).alias("ln"),
                       (left <= 0).cast("int").alias("dead"))
    run = running_totals(step, "time", ["ln", "dead"], group, cuts)
    alive = F.col("before_dead") + F.col("dead") == 0
    return run.select(*group, "time", "at_risk", "events",
                      F.when(alive, F.exp(F.col("before_ln") + F.col("ln"))).otherwise(0.0).alias("survival"))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def _efron(s0: float, d0: float, d: int) -> tuple[float, float, float, float, float, float]:
    """Sums over the d tied steps of ln r, 1/r, c/r, 1/r^2, c/r^2 and c^2/r^2 with r = s0 - c d0, c = l/d."""
    if d <= 2000:
        c = np.arange(d) / d
        r = s0 - c * d0
        return (np.log(r).sum(), (1 / r).sum(), (c / r).sum(), (1 / r**2).sum(), (c / r**2).sum(), (c * c / r**2).sum())
    b = d0 / d
    x = s0 / b
    log_sum = d * math.log(b) + math.lgamma(x + 1) - math.lgamma(x - d + 1)
    one = (_digamma(x + 1) - _digamma(x - d + 1)) / b
    two = (_trigamma(x - d + 1) - _trigamma(x + 1)) / (b * b)
    c_one = (s0 * one - d) / d0
    c_two = (s0 * two - one) / d0
    return log_sum, one, c_one, two, c_two, (s0 * c_two - c_one) / d0


def cox(df: DataFrame, cols: Sequence[str], time: str, event: str, max_iter: int = 25, tol: float = 1e-9) -> DataFrame:
    """Proportional hazards with Efron ties: one row per coefficient, with 95 percent intervals of it and of its ratio.

    A Newton step is one aggregate to distinct times, a two-level running total for the risk sets and one
    sum of gradients; the driver sees the coefficients only.
    """
    base, names = _design(df.withColumn("_time", F.col(time).cast("double")), [*cols, "_time"], event)
    names = [n for n in names if n != "_time"]
    p = len(names)
    spread = base.agg(*[F.avg(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)],
                      *[F.stddev_samp(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)]).first()
    sd = np.array([spread[f"s{i}"] or 1.0 for i in range(p)])
    x = [(F.col(f"`{n}`") - spread[f"m{i}"]) / float(sd[i]) for i, n in enumerate(names)]
    rows = base.select(F.col("_time").alias("t"), F.col("y").alias("e"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).persist()
    cuts = cut_points(rows.select("t").distinct(), "t")
    tri = [(i, j) for i in range(p) for j in range(i, p)]
    sums = ["a0", *[f"a{i}" for i in range(1, p + 1)], *[f"b{i}_{j}" for i, j in tri]]

    def step(beta: np.ndarray):
        eta = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        w = F.exp(eta)
        terms = {"a0": w, **{f"a{i + 1}": w * F.col(f"x{i}") for i in range(p)},
                 **{f"b{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in tri}}
        per = rows.groupBy("t").agg(
            *[F.sum(c).alias(k) for k, c in terms.items()], *[F.sum(c * F.col("e")).alias("d" + k) for k, c in terms.items()],
            F.sum("e").alias("n_events"), F.sum(eta * F.col("e")).alias("eta_e"),
            *[F.sum(F.col(f"x{i}") * F.col("e")).alias(f"ex{i}") for i in range(p)])
        per = cut_lineage(per.withColumn("back", -F.col("t")))
        ran = running_totals(per, "back", sums, (), sorted(-c for c in cuts)).where("n_events > 0")

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ll, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    d = int(r["n_events"])
                    s1 = np.array([r[f"a{i + 1}"] + r[f"before_a{i + 1}"] for i in range(p)])
                    d1 = np.array([r[f"da{i + 1}"] for i in range(p)])
                    s2, d2 = np.zeros((p, p)), np.zeros((p, p))
                    for i, j in tri:
                        s2[i, j] = s2[j, i] = r[f"b{i}_{j}"] + r[f"before_b{i}_{j}"]
                        d2[i, j] = d2[j, i] = r[f"db{i}_{j}"]
                    lg, one, c1, two, c2, cc2 = _efron(r["a0"] + r["before_a0"], r["da0"], d)
                    ll += r["eta_e"] - lg
                    grad += np.array([r[f"ex{i}"] for i in range(p)]) - (s1 * one - d1 * c1)
                    mixed = np.outer(s1, d1) + np.outer(d1, s1)
                    hess -= s2 * one - d2 * c1 - (np.outer(s1, s1) * two - mixed * c2 + np.outer(d1, d1) * cc2)
            yield pd.DataFrame({"ll": [ll], "g": [grad.tolist()], "h": [hess.ravel().tolist()]})

        got = ran.mapInPandas(part, "ll double, g array<double>, h array<double>")
        r = got.agg(F.sum("ll"), *[F.sum(F.element_at("g", i + 1)) for i in range(p)],
                    *[F.sum(F.element_at("h", i + 1)) for i in range(p * p)]).first()
        return r[0], np.array(r[1:p + 1]), np.array(r[p + 1:]).reshape(p, p)

    beta = np.zeros(p)
    ll, grad, hess = step(beta)
    for _ in range(max_iter):
        move = np.linalg.solve(-hess, grad)
        scale = 1.0
        while True:
            new = step(beta + scale * move)
            if new[0] >= ll - 1e-10 or scale < 1e-6:
                break
            scale /= 2
        gain, beta = new[0] - ll, beta + scale * move
        ll, grad, hess = new
        if abs(gain) < tol * (abs(ll) + tol):
            break
    rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(-hess))) / sd
    coef = beta / sd
    out = [(n, float(c), float(s), float(c / s), tails.normal_two_sided(float(c / s)), float(ll), time, event)
           for n, c, s in zip(names, coef, se)]
    table = df.sparkSession.createDataFrame(
        out, "variable string, coef double, se double, z double, p double, log_likelihood double, time_col string, event_col string")
    half = NORMAL_95 * F.col("se")
    table = table.withColumns({"coef_low": F.col("coef") - half, "coef_high": F.col("coef") + half})
    return table.withColumns({"exp_coef": F.exp("coef"), "exp_low": F.exp("coef_low"), "exp_high": F.exp("coef_high"),
                              "bits": F.when(F.col("p") > 0, -F.log2("p"))})


def outcome_tables(df: DataFrame, cols: Sequence[str], binary: Sequence[str] = (), continuous: Sequence[str] = (),
                   survival: Sequence[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """All requested outcome models by name."""
    out = {f"binary_{c}": binary_outcome(df, cols, c) for c in binary}
    out |= {f"continuous_{c}": continuous_outcome(df, cols, c) for c in continuous}
    return out | {f"cox_{e}": cox(df, cols, t, e) for t, e in survival}
