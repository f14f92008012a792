"""Queries on outcomes: baseline tables, tests, regressions, survival; and the stream of new reports."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import cluster, outcome, reduce
from ..session import shared_dir
from ..sources.tables import save_model
from ..streaming import incremental
from . import inputs as I
from .registry import R, query, r6, rounded

SQL_STRATA = f"""{I.SQL_COHORT}, s AS (SELECT *, unnest(['Overall', cluster]) AS stratum FROM cohort),
num AS (SELECT stratum, cluster, unnest(['price', 'balance']) AS variable, unnest([price, balance]) AS value FROM s)"""


@query("E19 DM13", f"""
WITH {SQL_STRATA}
SELECT stratum, variable, count(value) AS n, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'sd')}, {R('quantile_cont(value, 0.25)', 'q1')},
  {R('median(value)', 'median')}, {R('quantile_cont(value, 0.75)', 'q3')} FROM num GROUP BY 1, 2""")
def numeric_baseline(t):
    return rounded(outcome.numeric_baseline(I.cohort(t), ["price", "balance"], "cluster"), "mean", "sd", "q1", "median", "q3")


@query("E19 E20", f"""
WITH {SQL_STRATA}, c AS (SELECT stratum, unnest(['priority', 'risk']) AS variable, unnest([priority, risk]) AS level FROM s),
n AS (SELECT stratum, variable, level, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT stratum, variable, level, n, {R('n / sum(n) OVER (PARTITION BY stratum, variable) * 100', 'percent')} FROM n
QUALIFY variable <> 'risk' OR level = 'low-risk'""")
def categorical_baseline(t):
    return rounded(outcome.categorical_baseline(I.cohort(t), ["priority", "risk"], "cluster"), "percent")


@query("E19 E20 D08 G02 C31")
def baseline_table(t):
    return outcome.baseline_table(I.cohort(t), ["price", "balance"], ["priority", "risk"], ["balance"], "cluster")


@query("E20 O09", f"""
WITH {I.SQL_COHORT}, l AS (SELECT cluster, unnest(['price', 'balance']) AS variable, unnest([price, balance]) AS v FROM cohort),
g AS (SELECT variable, cluster, count(*) AS n, avg(v) AS m, sum((v - a) * (v - a)) AS w FROM (SELECT *, avg(v) OVER (PARTITION BY variable, cluster) AS a FROM l) GROUP BY 1, 2),
o AS (SELECT variable, avg(v) AS mu, count(*) AS n FROM l GROUP BY 1)
SELECT g.variable, {R('(sum(g.n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(w) / (any_value(o.n) - count(*)))', 'f')},
  count(*) - 1 AS df1, any_value(o.n) - count(*) AS df2 FROM g JOIN o USING (variable) GROUP BY g.variable""")
def anova(t):
    return rounded(outcome.anova(I.cohort(t), ["price", "balance"], "cluster"), "f")


@query("E20 O09", f"""
WITH {I.SQL_COHORT}, l AS (SELECT 'priority' AS variable, priority AS a, cluster AS b FROM cohort UNION ALL SELECT 'risk', risk, cluster FROM cohort),
n AS (SELECT variable, a, b, count(*) AS o FROM l GROUP BY 1, 2, 3),
e AS (SELECT *, sum(o) OVER (PARTITION BY variable, a) * sum(o) OVER (PARTITION BY variable, b) / sum(o) OVER (PARTITION BY variable) AS e FROM n)
SELECT variable, {R('sum((o - e) * (o - e) / e)', 'chi2')}, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e GROUP BY variable""")
def chi_square(t):
    return rounded(outcome.chi_square(I.cohort(t), ["priority", "risk"], "cluster"), "chi2")


@query("E20 O09", f"""
WITH {I.SQL_COHORT}, l AS (SELECT risk AS a, CASE WHEN price > 200000 THEN 'x' ELSE 'y' END AS b FROM cohort),
n AS (SELECT a, b, count(*) AS o FROM l GROUP BY 1, 2),
e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM n),
f AS (SELECT *, least(0.5, min(abs(o - e)) OVER ()) AS f FROM e)
SELECT 'risk' AS variable, {R('sum((abs(o - e) - f) * (abs(o - e) - f) / e)', 'chi2')}, CAST(1 AS BIGINT) AS df FROM f""")
def chi_square_corrected(t):
    rows = I.cohort(t).withColumn("dear", F.when(F.col("price") > 200000, "x").otherwise("y"))
    return rounded(outcome.chi_square(rows, ["risk"], "dear"), "chi2")


@query("E20 O11")
def baseline_tests(t):
    return rounded(outcome.baseline_tests(I.cohort(t), ["price", "balance"], ["priority", "risk"], ["balance"], "cluster"), "statistic", "p")


SQL_RANKS = f"""{I.SQL_COHORT}, r AS (SELECT risk, cluster, floor(price / 1000) AS v FROM cohort),
k AS (SELECT *, rank() OVER (PARTITION BY risk ORDER BY v) + (count(*) OVER (PARTITION BY risk, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY risk, v) AS t,
  count(*) OVER (PARTITION BY risk) AS n FROM r),
g AS (SELECT risk, cluster, count(*) AS nc, sum(rk) AS rs, any_value(CAST(n AS DOUBLE)) AS n FROM k GROUP BY 1, 2),
ties AS (SELECT risk, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k GROUP BY risk)"""


@query("O07 F14 Q22", f"""
WITH {SQL_RANKS}
SELECT risk, {R('(12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / nc) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (any_value(n) * any_value(n) * any_value(n) - any_value(n)))', 'h')},
  count(*) - 1 AS df, CAST(any_value(n) AS BIGINT) AS n FROM g JOIN ties USING (risk) GROUP BY risk""")
def kruskal(t):
    rows = I.cohort(t).withColumn("v", F.floor(F.col("price") / 1000))
    return rounded(outcome.kruskal(rows, "v", "cluster", "risk", min_rows=3), "h")


@query("O08", f"""
WITH {SQL_RANKS}
SELECT a.risk, a.cluster AS group1, b.cluster AS group2,
  {R('(b.rs / b.nc - a.rs / a.nc) / sqrt((a.n * (a.n + 1) / 12 - ties / (12 * (a.n - 1))) * (1.0 / a.nc + 1.0 / b.nc))', 'z')}
FROM g a JOIN g b ON a.risk = b.risk AND a.cluster < b.cluster JOIN ties ON ties.risk = a.risk""")
def dunn(t):
    rows = I.cohort(t).withColumn("v", F.floor(F.col("price") / 1000))
    return rounded(outcome.dunn(rows, "v", "cluster", "risk").select("risk", "group1", "group2", "z"), "z")


@query("O10 O08 O11 C30")
def test_annotations(t):
    """Longer delays in one group make the test significant."""
    d = I.durations(t)
    long = d.select((F.col("time") * (1 + F.col("discount"))).alias("value"), F.round("discount", 2).cast("string").alias("cluster"),
                    F.lit("time").alias("variable"), F.col("grp").alias("risk"))
    return outcome.annotations(long, "value", "cluster", "variable", "risk")


@query("O01 O05 O06")
def binary_outcome(t):
    rows = t.labels.join(t.documents, "doc_id").select("quality", (F.col("n_chars") / 1000).alias("kchars"), "lang")
    return rounded(outcome.binary_outcome(rows, ["kchars", "lang"], "quality"), "coef", "std_err", "stat", "p", "ci_low", "ci_high")


# the quantile of t as a series in 1 / n around the normal one
SQL_T = "(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * nu)" \
        " + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * nu * nu))"


@query("O02", f"""
WITH {I.SQL_DURATIONS}, d AS (SELECT CAST(time AS DOUBLE) AS y, CAST(quantity AS DOUBLE) AS x FROM durations WHERE time IS NOT NULL AND quantity IS NOT NULL),
r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS sse,
  avg(x) AS mx, count(*) AS n, count(*) - 2 AS nu FROM d),
c AS (SELECT 'quantity' AS variable, b AS coef, sqrt(sse / nu / sxx) AS se, {SQL_T} AS q FROM r
  UNION ALL SELECT 'const', a, sqrt(sse / nu * (1.0 / n + mx * mx / sxx)), {SQL_T} FROM r)
SELECT variable, {R('coef', 'coef')}, {R('se', 'std_err')}, {R('coef / se', 'stat')}, {R('coef - q * se', 'ci_low')}, {R('coef + q * se', 'ci_high')} FROM c""")
def continuous_outcome(t):
    fit = outcome.continuous_outcome(I.durations(t).withColumn("time", F.col("time").cast("double")), ["quantity"], "time")
    return rounded(fit.select("variable", "coef", "std_err", "stat", "ci_low", "ci_high"), "coef", "std_err", "stat", "ci_low", "ci_high")


@query("O03 F15")
def cox(t):
    fit = outcome.cox(I.durations(t), ["quantity", "discount", "grp"], "time", "event")
    return rounded(fit, "coef", "exp_coef", "se", "z", "p", "log_likelihood", "coef_low", "coef_high", "exp_low", "exp_high", "bits")


@query("O04 F15", f"""
WITH {I.SQL_DURATIONS}, n AS (SELECT grp, time, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM durations GROUP BY 1, 2),
r AS (SELECT grp, time, events, CAST(sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS BIGINT) AS at_risk FROM n)
SELECT grp, time, at_risk, events, {R('CASE WHEN min(1 - events / at_risk) OVER w > 0 THEN exp(sum(ln(CASE WHEN events < at_risk THEN 1 - events / at_risk ELSE 1 END)) OVER w) ELSE 0 END', 'survival')}
FROM r WINDOW w AS (PARTITION BY grp ORDER BY time)""")
def kaplan_meier(t):
    km = outcome.kaplan_meier(I.durations(t), "time", "event", "grp")
    return rounded(km.withColumn("time", F.col("time").cast("bigint")), "survival")


@query("O11")
def tail_probabilities(t):
    """Normal, chi-square, F and t tails of values taken from the events."""
    z = F.col("value") / 20
    return t.events.select("event_id", r6(tails.normal_p(z)).alias("p_normal"), r6(tails.chi2_p(z * z, F.lit(1))).alias("p_chi2"),
                           r6(tails.f_p(z * z, F.lit(1), F.lit(30))).alias("p_f"), r6(tails.t_p(z, F.lit(30))).alias("p_t"))


# --- streams ----------------------------------------------------------------------------

def arrived(t, parts: int = 16) -> str:
    """A folder with the report documents as JSON lines in a few files."""
    path = f"{shared_dir(t.spark)}/reportlens/stream-{uuid.uuid4().hex}"
    docs = I.report_documents(t).select(F.col("doc_id").cast("string").alias("doc_id"), "doc")
    docs.repartition(parts, "doc_id").write.json(f"{path}/in")
    return path


@query("S01 B03 A09", f"""
WITH {I.SQL_DOCS}, s AS (SELECT doc_id, section, string_agg(key || ': ' || value, '; ' ORDER BY ordinal) AS t FROM feat
  WHERE value IS NOT NULL AND value <> '' GROUP BY doc_id, section),
cells AS ({I.sql_cells('s', 'doc_id')})
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(string_agg(t, '|' ORDER BY section)) AS texts, {R('(SELECT sum(x * x) FROM cells c WHERE c.doc_id = s.doc_id)', 'square')} FROM s GROUP BY doc_id""")
def streamed_reports(t):
    """Reports flattened and embedded as they arrive, a few files per batch."""
    path = arrived(t)
    rows = incremental.report_vectors(incremental.read_stream(t.spark, f"{path}/in", 8), I.SECTIONS, I.DIM)
    incremental.append_table(rows, f"{path}/out", f"{path}/state").awaitTermination()
    back = t.spark.read.parquet(f"{path}/out")
    texts = F.concat_ws("|", *[f"text_{s}" for s in sorted(I.SECTIONS)])
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return back.select("doc_id", F.md5(texts).alias("texts"), r6(square).alias("square"))


@query("S02 A15 H09")
def streamed_labels(t):
    """New reports take the cluster of a model fitted on known ones."""
    docs = I.report_documents(t).select(F.col("doc_id").cast("string").alias("doc_id"), "doc")
    known = incremental.report_vectors(docs, I.SECTIONS, I.DIM).select("doc_id", "embedding").persist()
    fit = reduce.pca(known, "embedding", 8)
    model = cluster.kmeans(fit.rows, "doc_id", "reduced", 3, n_init=1).model
    known.unpersist()
    path = arrived(t)
    save_model(fit.model, f"{path}/reduction")
    reduction = PipelineModel.load(f"{path}/reduction")
    rows = incremental.report_vectors(incremental.read_stream(t.spark, f"{path}/in", 8), I.SECTIONS, I.DIM)
    labelled = incremental.assign_clusters(rows.select("doc_id", "embedding"), "embedding", reduction, model)
    incremental.append_table(labelled.select("doc_id", "label"), f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("O11", f"""
WITH z AS (SELECT c_custkey, c_acctbal / 500 AS z, abs(c_acctbal) / 500 AS a FROM customer)
SELECT c_custkey, {R('exp(-a / 2)', 'chi2_2')}, {R('exp(-a / 2) * (1 + a / 2 + a * a / 8)', 'chi2_6')}, {R('pow(1 + 2 * a / 7, -3.5)', 'f_2_7')},
  {R('1 - 2 / pi() * atan(a)', 't_1')}, {R('1 - a / sqrt(2 + z * z)', 't_2')}, {R('1 - a / sqrt(4 + z * z) * (1 + 2 / (4 + z * z))', 't_4')} FROM z""")
def closed_tails(t):
    """Tails with a closed form, of every account balance."""
    z = F.col("c_acctbal").cast("double") / 500
    a, df = F.abs(z), F.lit
    return t.customer.select("c_custkey", *[r6(p).alias(n) for n, p in {
        "chi2_2": tails.chi2_p(a, df(2)), "chi2_6": tails.chi2_p(a, df(6)), "f_2_7": tails.f_p(a, df(2), df(7)),
        "t_1": tails.t_p(z, df(1)), "t_2": tails.t_p(z, df(2)), "t_4": tails.t_p(z, df(4))}.items()])
