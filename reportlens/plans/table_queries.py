"""Queries on report, label, edit and run tables: sources, selections, joins, summaries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import documents, explain, metrics, models, ranking, stability, tables
from ..session import cut_lineage, shared_dir
from ..sources import tables as S
from . import inputs as I
from .registry import R, query, r6, rounded
from .text_queries import SQL_CORE, SQL_MAIN, SQL_NAMES, SQL_SUB, feature_names

HASH = "CAST(('0x' || left(md5({0}), 15)) AS BIGINT)"


def sql_hash(seed, *keys) -> str:
    return HASH.format(" || ':' || ".join([f"CAST({seed} AS VARCHAR)", *[f"CAST({k} AS VARCHAR)" for k in keys]]))


def folder(t, name: str) -> str:
    """A fresh folder for a round trip, in the shared checkpoint folder."""
    return f"{shared_dir(t.spark)}/reportlens/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------

@query("A01", "SELECT CAST(doc_id AS VARCHAR) AS phID, source AS pathology_number, md5(text) AS body FROM documents")
def report_table(t):
    """Reports written as CSV and read back with text ids."""
    path = folder(t, "reports")
    t.documents.select(F.col("doc_id").cast("string").alias("phID"), F.col("source").alias("pathology_number"),
                       F.col("text").alias("gross_description")) \
        .write.option("header", True).option("escape", '"').csv(path)
    back = t.spark.read.schema(S.REPORTS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("phID", "pathology_number", F.md5("gross_description").alias("body"))


@query("A03 A04", "SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(*) AS n FROM orders GROUP BY 1")
def table_scan(t):
    """Parquet with forced text ids; only the id column is read."""
    return S.read_table(t.spark, f"{t.folder}/orders.parquet", text_ids=["o_custkey"]).groupBy("o_custkey") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("A02 A08 C39", """
SELECT 'pathology_features_' || c_custkey || '_' || c_nationkey AS doc_id, '{"a":' || c_nationkey || '}' AS doc FROM customer""")
def document_sink(t):
    """Documents written in hashed buckets of JSON lines and read back."""
    path = folder(t, "documents")
    docs = t.customer.withColumn("doc", F.to_json(F.struct(F.col("c_nationkey").alias("a"))))
    S.write_documents(docs, path, ("c_custkey", "c_nationkey"), "doc", 8)
    return S.read_document_lines(t.spark, path)


@query("A07 B21", "SELECT count(*) AS n_rows, CAST(64 AS INTEGER) AS dim, count(DISTINCT vec_id) AS n_ids FROM embeddings")
def embedding_sink(t):
    back = S.write_embeddings(I.vectors(t), folder(t, "embeddings"), "embedding", 64)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.max("total_embedding_dim").alias("dim"),
                    F.countDistinct("vec_id").alias("n_ids"))


@query("A09", """
WITH w AS (SELECT doc_id, text, (min(doc_id) OVER (PARTITION BY text)) % 3 = 0 AS hit FROM documents)
SELECT hit, count(*) AS n, count(DISTINCT text) AS n_texts FROM w GROUP BY hit""")
def embedding_cache(t):
    """Rows and texts that a half-filled cache serves, and those it lacks."""
    wanted = t.documents.withColumn("key", F.md5("text"))
    known = wanted.groupBy("key").agg(F.min("doc_id").alias("first")).where(F.col("first") % 3 == 0) \
        .select("key", V.zeros(4).alias("embedding"))
    hits, misses = S.cache_split(wanted, known)
    both = hits.select("text", F.lit(True).alias("hit")).unionByName(misses.select("text", F.lit(False).alias("hit")))
    return both.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))


@query("A11 A16 DM8 DM14", f"WITH {I.SQL_RUNS} SELECT 'r1' AS run_id, algorithm, count(*) AS n FROM runs GROUP BY algorithm")
def run_folder(t):
    """Run tables written under a run id and loaded again."""
    path = folder(t, "runs")
    S.save_run(path, "r1", {"runs": I.runs(t).drop("run_id")})
    back = S.load_run(t.spark, path, "r1", ["runs"])["runs"]
    return back.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n")).select(F.lit("r1").alias("run_id"), "algorithm", "n")


@query("A10 A13 A19", f"""
WITH {I.SQL_RUNS} SELECT config_key, {R('silhouette', 'silhouette')}, row_number() OVER (ORDER BY silhouette DESC, ordinal) AS rank, 'r1' AS run_id FROM runs""")
def leaderboard_sink(t):
    board = tables.ranked_runs(I.runs(t)).select("config_key", r6("silhouette").alias("silhouette"), F.col("rank").cast("bigint").alias("rank"))
    return S.write_table(board, folder(t, "board"), "r1", "csv")


@query("A12 F8", f"""
WITH {I.SQL_METHODS}
SELECT vec_id, rule_a AS "cluster_KMeans_rank1_sil0.5000_k10", rule_b AS "cluster_Spectral_rank2_sil0.2500_k3",
  rule_c AS "cluster_DBSCAN_rank3_sil0.1000_k2", rule_a AS best_cluster_label FROM methods""")
def simplified_labels(t):
    wide = I.methods(t)
    long = wide.unpivot(["vec_id"], ["rule_a", "rule_b", "rule_c"], "run_id", "label")
    runs = t.spark.createDataFrame(
        [("rule_c", 3, "DBSCAN", 0.1, 2), ("rule_a", 1, "KMeans", 0.5, 10), ("rule_b", 2, "Spectral", 0.25, 3)],
        "run_id string, ordinal int, algorithm string, silhouette double, n_clusters int")
    return tables.simplified_labels(wide.select("vec_id"), long, runs, "vec_id")


@query("A17 E12 F10 E25", "SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM embeddings) AS share FROM embeddings GROUP BY label")
def cluster_distribution(t):
    n = tables.status_counts(I.vectors(t), "label")
    return tables.shares(n, "n", out="share")


@query("A18 D06 E21 F07 B14", """
WITH f AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders),
j AS (SELECT f.o_custkey, o_orderkey, CASE WHEN c_acctbal >= 0 THEN 'Yes' WHEN c_acctbal > -500 THEN 'No' END AS rapid
      FROM f LEFT JOIN customer ON f.o_custkey = c_custkey)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, any_value(rapid) AS rapid FROM j WHERE rapid IS NOT NULL GROUP BY o_custkey""")
def first_row_outcome(t):
    outcome = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, "Yes").when(
        F.col("c_acctbal") > -500, "No").alias("rapid"))
    return tables.features_with_outcome(t.orders, outcome, "o_custkey", "o_orderkey", "rapid")


# --- selections -------------------------------------------------------------------

@query("B03 D09", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_done(t):
    return tables.not_done(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("B05 B06 C38", f"""
WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('q + 100 * coalesce(d, (SELECT avg(d) FROM n))', 'v')}, count(*) AS n FROM n GROUP BY ALL""")
def column_vectors(t):
    """All numeric columns as one vector, gaps filled with the column mean."""
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
                             "l_quantity", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"))
    vecs = tables.vector_from_columns(rows, None, [], "v")
    v = r6(F.col("v")[0] + 100 * F.col("v")[1])
    return vecs.groupBy(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
                        v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("B07 B08 B20", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(t):
    """A case cap is a parameter of the edit analysis: the first n cases by id."""
    kept = tables.drop_columns(t.orders, ["o_custkey", "o_totalprice"])
    return tables.first_cases(kept.select(*tables.existing(kept, ["o_orderkey", "o_orderstatus", "none"])), 100, "o_orderkey")


@query("B10 B11 F02", f"""
WITH {I.SQL_RUNS}
(SELECT 'silhouette' AS metric, config_key, {R('silhouette', 'score')} FROM runs WHERE n_clusters >= 2 AND noise_ratio <= 0.5
  ORDER BY silhouette DESC, ordinal LIMIT 10) UNION ALL
(SELECT 'davies_bouldin', config_key, {R('davies_bouldin')} FROM runs WHERE n_clusters >= 2 AND noise_ratio <= 0.5
  ORDER BY davies_bouldin, ordinal LIMIT 10)""")
def best_runs(t):
    one = lambda m: tables.best_runs(I.runs(t), 10, m).select(F.lit(m).alias("metric"), "config_key", r6(m).alias("score"))
    return one("silhouette").unionByName(one("davies_bouldin"))


@query("B12 B13", """
SELECT count(*) AS n, min(p_partkey) AS first FROM part WHERE CAST(p_size > 30 AS INTEGER) + CAST(p_type = 'SMALL' AS INTEGER) = 0
  AND p_name <> 'red widget'""")
def cohort_filter(t):
    rows = t.part.select("p_partkey", (F.col("p_size") > 30).cast("int").alias("malignancy_a"),
                         (F.col("p_type") == "SMALL").cast("int").alias("malignancy_b"),
                         F.nullif(F.col("p_name"), F.lit("red widget")).alias("name"))
    kept = tables.complete_cases(tables.without_prefix_flags(rows), ["name", "absent"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("B15", f"SELECT doc_id, lang FROM documents ORDER BY {sql_hash(42, 'doc_id')}, doc_id LIMIT 200")
def fixed_sample(t):
    return ranking.sample_rows(t.documents.select("doc_id", "lang"), 200, ["doc_id"])


@query("B16", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {sql_hash(7, 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE rn <= floor(n * CAST(0.8 AS DOUBLE))""")
def subsample_rows(t):
    return ranking.subsample(t.orders.select("o_orderkey", "o_orderstatus"), 0.8, ["o_orderkey"], 7)


@query("B17", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(42, 'doc_id')}, doc_id) AS rn FROM documents),
d AS (SELECT i AS draw, {sql_hash(42, 'i')} % (SELECT count(*) FROM documents) + 1 AS rn FROM range(500) g(i))
SELECT draw, doc_id FROM d JOIN r USING (rn)""")
def bootstrap_rows(t):
    return ranking.bootstrap(t.documents.select("doc_id"), 500, ["doc_id"]).select("draw", "doc_id")


@query("B18", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, rn <= floor(n * CAST(0.2 AS DOUBLE)) AS is_test FROM r""")
def stratified_split(t):
    return ranking.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("B19", f"""
SELECT o_orderkey, o_orderstatus,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def stratified_folds(t):
    return ranking.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("B21 F13", f"""
SELECT count(*) AS n_rows, count(*) FILTER (len(embedding) <> 64) AS n_wrong_dim,
  CAST(sum(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x)))) AS BIGINT) AS n_gaps,
  count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_zero,
  {', '.join(R(f'{f}(embedding[{i + 1}])', f'{f}_{i}') for i in range(5) for f in ('min', 'max'))},
  (SELECT CAST(count(*) - count(DISTINCT label) AS BIGINT) FROM embeddings) AS n_repeated FROM embeddings""")
def vector_checks(t):
    out = tables.vector_checks(I.vectors(t), "embedding", ["label"], 64)
    return rounded(out, *[f"{f}_{i}" for i in range(5) for f in ("min", "max")])


# --- joins ------------------------------------------------------------------------

@query("D01 D02", """
SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def labelled_documents(t):
    meta = t.documents.select("doc_id", "lang")
    keys = tables.merge_keys(meta, t.labels, ("row_id", "doc_id"))
    doubled = t.labels.unionByName(t.labels.withColumn("quality", F.col("quality") + 1))
    return tables.with_labels(meta, doubled, keys, "doc_id")


@query("D03", f"""
WITH {I.SQL_DOCS} SELECT doc_id, status, late, c_acctbal < 0 AS in_debt FROM docs JOIN customer ON o_custkey = c_custkey""")
def flat_with_labels(t):
    """Flat features joined to a label table by id."""
    flat = documents.wide_table(I.flat_documents(t).withColumn("cust", F.split("source_file", "_")[2].cast("bigint")),
                                ["doc_id", "cust"], ["order_status", "shipping_late"])
    labels = t.customer.select(F.col("c_custkey").alias("cust"), (F.col("c_acctbal") < 0).alias("in_debt"))
    return flat.join(labels, "cust").select("doc_id", F.col("order_status").alias("status"), F.col("shipping_late").alias("late"), "in_debt")


@query("D04", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_labels(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("D05 F08 M13", f"""
WITH {I.SQL_EDITS}, {I.SQL_IMPORTANCES},
i AS (SELECT CASE p_type WHEN 'SMALL' THEN 'click' WHEN 'LARGE' THEN 'view' WHEN 'PROMO' THEN 'error' ELSE p_type END AS feature, sum(p_retailprice) AS imp FROM part GROUP BY 1),
d AS (SELECT feature, avg(abs(support_score)) AS a, avg(CASE WHEN support_score < 0 THEN 1.0 ELSE 0 END) AS r FROM edits WHERE label = 0 GROUP BY 1),
s AS (SELECT feature, avg(abs(support_score)) AS a, avg(CASE WHEN support_score < 0 THEN 1.0 ELSE 0 END) AS r FROM edits WHERE label = 1 GROUP BY 1),
j AS (SELECT i.feature, imp, coalesce(d.a, 0) AS da, coalesce(d.r, 0) AS dr, coalesce(s.a, 0) AS sa, coalesce(s.r, 0) AS sr
  FROM i LEFT JOIN d ON i.feature = d.feature LEFT JOIN s ON i.feature = s.feature)
SELECT feature, {R('imp', 'shap_importance')}, {R('da', 'delete_abs')}, {R('dr', 'delete_neg_rate')}, {R('sa', 'swap_abs')}, {R('sr', 'swap_neg_rate')},
  {R('(imp - avg(imp) OVER ()) / (stddev_pop(imp) OVER () + 1e-12) + (da - avg(da) OVER ()) / (stddev_pop(da) OVER () + 1e-12) + (sa - avg(sa) OVER ()) / (stddev_pop(sa) OVER () + 1e-12)', 'joint_score')}
FROM j""")
def joint_evidence(t):
    kind = F.col("p_type")
    imp = t.part.groupBy(F.when(kind == "SMALL", "click").when(kind == "LARGE", "view").when(kind == "PROMO", "error")
                         .otherwise(kind).alias("raw_feature")).agg(F.sum("p_retailprice").alias("importance"))
    e = I.edits(t)
    out = explain.joint_evidence(imp, e.where("label = 0"), e.where("label = 1"))
    nums = ["shap_importance", "delete_abs", "delete_neg_rate", "swap_abs", "swap_neg_rate", "joint_score"]
    return rounded(out.select("feature", *nums), *nums)


@query("D07 E18", f"""
WITH {I.SQL_COHORT}, s AS (SELECT segment, max(price) * 0.9 AS hi, min(price) AS lo FROM cohort GROUP BY 1),
g AS (SELECT DISTINCT cluster FROM cohort)
SELECT segment, cluster, {R('hi', 'global_max')}, {R('lo', 'global_min')}, {R('hi * 0.95', 'p_value_y')}, {R('hi * 1.12', 'pairwise_y3')} FROM s CROSS JOIN g""")
def level_grid(t):
    out = tables.level_grid(I.cohort(t), "segment", "cluster", "price")
    cols = ["global_max", "global_min", "p_value_y", "pairwise_y3"]
    return rounded(out.select("segment", "cluster", *cols), *cols)


@query("D08", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, n_chars, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def beside(t):
    return tables.side_by_side(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id")


SQL_MAP = f"""
WITH {I.SQL_DOCS}, u AS (SELECT DISTINCT section || '_' || key AS k FROM feat),
raw AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'order_status' WHEN 1 THEN 'home_name__RARE__' WHEN 2 THEN 'label' ELSE p_brand END AS raw_feature FROM part),
c AS (SELECT raw_feature, trim(regexp_replace(regexp_replace(trim(raw_feature), '(?:__RARE__|__RARE_|_RARE__|_RARE_)$', ''), '__+', '_', 'g'), '_') AS clean FROM raw),
tries AS (SELECT raw_feature, raw_feature AS n FROM c UNION SELECT raw_feature, clean FROM c UNION SELECT raw_feature, regexp_replace(clean, '\\s+', '_', 'g') FROM c),
hits AS (SELECT DISTINCT raw_feature, k FROM tries JOIN u ON k = n OR ends_with(k, '_' || n))
SELECT c.raw_feature, c.clean AS raw_feature_clean, coalesce(string_agg(k, ' | ' ORDER BY k), '') AS matched_json_keys,
  CAST(count(k) AS INTEGER) AS n_matches, CASE WHEN count(k) > 0 THEN 'matched' ELSE 'unmatched' END AS status
FROM c LEFT JOIN hits USING (raw_feature) GROUP BY c.raw_feature, c.clean"""


def feature_map(t):
    s = F.col("p_size") % 4
    raw = t.part.select(F.when(s == 0, "order_status").when(s == 1, "home_name__RARE__").when(s == 2, "label")
                        .otherwise(F.col("p_brand")).alias("raw_feature"))
    universe = documents.feature_universe(I.section_documents(t)).select(F.concat_ws("_", "section", "key").alias("json_key"))
    return tables.map_features(raw, universe)


@query("D11 M04 A19", SQL_MAP)
def feature_mapping(t):
    return feature_map(t)


@query("E22", f"WITH m AS ({SQL_MAP}) SELECT status, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 'prop')} FROM m GROUP BY status")
def mapping_shares(t):
    n = tables.status_counts(feature_map(t))
    return rounded(tables.shares(n, "n", out="prop"), "prop")


@query("M05", f"""
WITH {I.SQL_DOCS}, u AS (SELECT DISTINCT section || '_' || key AS json_key FROM feat) SELECT json_key FROM u""")
def mapping_fallback(t):
    """Nothing matched, so every key is kept."""
    universe = cut_lineage(documents.feature_universe(I.section_documents(t)).select(F.concat_ws("_", "section", "key").alias("json_key")))
    return tables.or_all(universe.where(F.col("json_key") == "none"), universe)


# --- summaries --------------------------------------------------------------------

@query("E01 E02", f"""
WITH {I.SQL_EDITS} SELECT feature, count(*) AS n, {R('avg(support_score)', 'mean_support')}, {R('avg(abs(support_score))', 'mean_abs_support')},
  {R('avg(CASE WHEN support_score < 0 THEN 1.0 ELSE 0 END)', 'neg_rate')} FROM edits GROUP BY feature""")
def edit_summary(t):
    return rounded(tables.support_summary(I.edits(t), "feature"), "mean_support", "mean_abs_support", "neg_rate")


@query("E03 M16", f"""
WITH {I.SQL_EDITS} SELECT label AS section, feature AS block, count(*) AS n, {R('avg(support_score)', 'mean_support')},
  {R('avg(abs(support_score))', 'mean_abs_support')}, {R('avg(CASE WHEN support_score < 0 THEN 1.0 ELSE 0 END)', 'neg_rate')},
  label || ' | ' || feature AS section_block FROM edits GROUP BY label, feature""")
def block_summary(t):
    e = I.edits(t).select(F.col("label").alias("section"), F.col("feature").alias("block"), "support_score")
    return rounded(explain.block_summary(e), "mean_support", "mean_abs_support", "neg_rate")


@query("E04", f"WITH {I.SQL_IMPORTANCES} SELECT raw_feature, {R('sum(importance)', 'importance')} FROM imp GROUP BY raw_feature")
def raw_importance(t):
    return rounded(explain.raw_importance(I.importances(t)), "importance")


@query("E05 E06", f"""
WITH {I.SQL_RUNS} SELECT algorithm, {R('avg(silhouette)', 'sil_mean')}, {R('max(silhouette)', 'sil_max')}, {R('stddev_samp(silhouette)', 'sil_std')},
  count(silhouette) AS n_runs, {R('avg(n_clusters)', 'k_mean')}, {R('stddev_samp(n_clusters)', 'k_std')}, {R('avg(noise_ratio)', 'noise_mean')}
FROM runs GROUP BY algorithm""")
def algorithm_summary(t):
    return rounded(tables.algorithm_summary(I.runs(t)), "sil_mean", "sil_max", "sil_std", "k_mean", "k_std", "noise_mean")


@query("E07", f"""
WITH {I.SQL_RUNS} SELECT algorithm, arg_max(config_key, (silhouette, -ordinal)) AS config_key, {R('max(silhouette)', 'silhouette')}, count(*) AS n_configs
FROM runs GROUP BY algorithm""")
def best_per_algorithm(t):
    return rounded(tables.best_per_algorithm(I.runs(t)), "silhouette")


@query("E08 G04", f"""
WITH {I.SQL_COHORT}, l AS (SELECT cluster, unnest(['price', 'balance']) AS variable, unnest([price, balance]) AS value FROM cohort)
SELECT cluster, variable, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, count(value) AS count FROM l GROUP BY cluster, variable""")
def cluster_composition(t):
    return tables.composition(I.cohort(t), "cluster", ["price", "balance"])


@query("E08", f"""
WITH {I.SQL_COHORT}, l AS (SELECT unnest(['price', 'balance']) AS variable, unnest([price, balance]) AS value FROM cohort WHERE cluster = 'F')
SELECT variable, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'std')}, {R('min(value)', 'min')}, {R('max(value)', 'max')},
  {R('quantile_cont(value, 0.5)', 'median')} FROM l GROUP BY variable""")
def one_cluster_composition(t):
    return rounded(tables.composition_of(I.cohort(t), "cluster", "F", ["price", "balance"]), "mean", "std", "min", "max", "median")


@query("E10", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values(t):
    return tables.top_values(t.lineitem, "l_partkey", 20)


@query("E13", f"""
WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, {R('avg(v)', 'mean')} FROM x GROUP BY label, i""")
def class_centroids(t):
    return I.means(t).select("label", F.posexplode("mean").alias("i", "mean")).select("label", "i", r6("mean").alias("mean"))


@query("E14", f"""
WITH x AS (SELECT unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)
SELECT CAST(i AS INTEGER) AS i, {R('stddev_samp(v)', 'std')} FROM x GROUP BY i""")
def feature_spread(t):
    return metrics.feature_std(I.vectors(t), "embedding").select(F.posexplode("std").alias("i", "std")).select("i", r6("std").alias("std"))


@query("E15 Q8", f"""
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT min(n) AS min_size, max(n) AS max_size, {R('avg(n)', 'mean_size')}, {R('stddev_pop(n)', 'std_size')}, {R('median(n)', 'median_size')} FROM s""")
def size_stats(t):
    return rounded(metrics.size_stats(I.vectors(t)), "mean_size", "std_size", "median_size")


@query("E16", f"""
WITH s AS (SELECT feature, avg(abs(support_score)) AS ari, avg(CAST(support_score < 0 AS INTEGER)) AS nmi FROM (SELECT event_type AS feature, value - 50 AS support_score FROM events) GROUP BY 1)
SELECT count(*) AS n_iter, {R('avg(ari)', 'mean_ari')}, {R('stddev_pop(ari)', 'std_ari')}, {R('avg(nmi)', 'mean_nmi')}, {R('stddev_pop(nmi)', 'std_nmi')} FROM s""")
def score_spread(t):
    s = tables.support_summary(I.edits(t), "feature").select(F.col("mean_abs_support").alias("ari"), F.col("neg_rate").alias("nmi"))
    return rounded(stability.agreement_summary(s), "mean_ari", "std_ari", "mean_nmi", "std_nmi")


@query("E17", f"WITH {I.SQL_RUNS} SELECT {R('regr_slope(silhouette, n_clusters)', 'slope')}, {R('regr_intercept(silhouette, n_clusters)', 'intercept')} FROM runs")
def silhouette_trend(t):
    return rounded(tables.trend(I.runs(t)), "slope", "intercept")


@query("E24", f"""
WITH {I.SQL_RUNS} SELECT count(*) AS n_configs, count(DISTINCT algorithm) AS n_algorithms, {R('max(silhouette)', 'best_silhouette')},
  {R('avg(silhouette)', 'mean_silhouette')} FROM runs""")
def run_totals(t):
    return rounded(tables.run_totals(I.runs(t)), "best_silhouette", "mean_silhouette")


# --- ranks, shares, reshape ---------------------------------------------------------

@query("F01 F03 F17", f"""
WITH {I.SQL_RUNS}, r AS (SELECT algorithm, config_key, {R('silhouette', 'silhouette')},
  CAST(row_number() OVER (PARTITION BY algorithm ORDER BY silhouette DESC, ordinal) AS INTEGER) AS step FROM runs)
SELECT *, step = 1 AS is_best FROM r WHERE step <= 3""")
def top_per_algorithm(t):
    top = tables.top_per_algorithm(I.runs(t), 3)
    return rounded(tables.progression(top).select("algorithm", "config_key", "silhouette", "step", "is_best"), "silhouette")


@query("F04 M14", f"""
WITH {I.SQL_EDITS}, top AS (SELECT old_value AS tv FROM edits GROUP BY old_value ORDER BY count(*) DESC, old_value LIMIT 4),
g AS (SELECT label, CASE WHEN tv IS NOT NULL THEN old_value ELSE 'Other' END AS value_grouped, count(*) AS n FROM edits LEFT JOIN top ON old_value = tv GROUP BY 1, 2)
SELECT label, value_grouped, n, {R('n / sum(n) OVER (PARTITION BY label)', 'prop')} FROM g""")
def value_mix(t):
    return rounded(tables.value_mix(I.edits(t), "label", "old_value"), "prop")


@query("F05", f"""
WITH {I.SQL_COHORT}, n AS (SELECT cluster, risk, count(*) AS count FROM cohort GROUP BY 1, 2)
SELECT cluster, risk, count, CAST(sum(count) OVER (PARTITION BY cluster) AS BIGINT) AS a_total, CAST(sum(count) OVER (PARTITION BY risk) AS BIGINT) AS b_total,
  {R('count / sum(count) OVER (PARTITION BY cluster) * 100', 'a_percent')}, {R('count / sum(count) OVER (PARTITION BY risk) * 100', 'b_percent')} FROM n""")
def two_way_percent(t):
    return rounded(tables.two_way(I.cohort(t), "cluster", "risk"), "a_percent", "b_percent")


@query("F06 C29", f"""
WITH {I.SQL_COHORT}, n AS (SELECT cluster, risk, segment, left(priority, 1) AS score, count(*) AS count FROM cohort GROUP BY ALL)
SELECT cluster, risk, segment, score, count, CAST(sum(count) OVER (PARTITION BY cluster, risk, segment) AS BIGINT) AS total,
  {R('count / sum(count) OVER (PARTITION BY cluster, risk, segment) * 100', 'percentage')} FROM n""")
def score_percent(t):
    rows = I.cohort(t).withColumn("score", F.left("priority", F.lit(1)))
    return rounded(tables.score_percent(rows, ["cluster", "risk", "segment"], "score"), "percentage")


@query("F09 F10 M17", f"""
WITH {I.SQL_IMPORTANCES}, s AS (SELECT raw_feature AS feature, sum(importance) AS a, avg(importance) AS b, count(*) AS c FROM imp GROUP BY 1 ORDER BY a DESC, 1 LIMIT 8)
SELECT feature, {', '.join(R(f'({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER () + 1e-12)', n) for x, n in (('a', 'shap_importance'), ('b', 'delete_abs'), ('c', 'swap_abs')))} FROM s""")
def concordance(t):
    s = I.importances(t).groupBy(F.col("raw_feature").alias("feature")).agg(
        F.sum("importance").alias("shap_importance"), F.avg("importance").alias("delete_abs"),
        F.count(F.lit(1)).cast("double").alias("swap_abs")).withColumn("joint_score", F.col("shap_importance"))
    return rounded(explain.concordance(s, 8), "shap_importance", "delete_abs", "swap_abs")


@query("F11 M16 C37", f"""
WITH f AS (SELECT p_partkey, p_retailprice AS importance, raw_feature FROM (WITH {SQL_NAMES} SELECT * FROM names) JOIN part USING (p_partkey)),
s AS (SELECT raw_feature, sum(importance) AS importance FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)
SELECT raw_feature, {SQL_MAIN} AS main_group, {SQL_SUB} AS subgroup, {SQL_CORE} AS core, {R('importance', 'importance')} FROM s""")
def panel_hierarchy(t):
    imp = feature_names(t).join(t.part, "p_partkey").groupBy("raw_feature").agg(F.sum("p_retailprice").alias("importance"))
    return rounded(explain.hierarchy(imp).drop("subgroup_rank"), "importance")


@query("C37", f"""
WITH f AS (SELECT raw_feature, p_retailprice AS importance, {SQL_MAIN} AS m, {SQL_SUB} AS s FROM (WITH {SQL_NAMES} SELECT * FROM names) JOIN part USING (p_partkey))
SELECT (SELECT m FROM f GROUP BY m ORDER BY sum(importance) DESC, m LIMIT 1) AS dominant_main,
  (SELECT s FROM f GROUP BY s ORDER BY sum(importance) DESC, s LIMIT 1) AS dominant_subgroup""")
def dominant_groups(t):
    imp = feature_names(t).join(t.part, "p_partkey").select("raw_feature", F.col("p_retailprice").alias("importance"))
    return explain.dominant_groups(imp)


@query("F12", f"""
WITH {I.SQL_EDITS}, j AS (SELECT p_type AS feature, sum(p_retailprice) AS joint_score FROM part GROUP BY 1
  UNION ALL SELECT event_type, avg(value) FROM events GROUP BY 1)
SELECT feature, {R('joint_score', 'joint_score')} FROM j WHERE feature IN (SELECT feature FROM edits) ORDER BY joint_score DESC, feature LIMIT 3""")
def swapped_top(t):
    joint = t.part.groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("joint_score")).unionByName(
        t.events.groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("joint_score")))
    return rounded(explain.swapped_top(joint, I.edits(t)), "joint_score")


@query("F13", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ids(t):
    return tables.repeated_ids(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("F14", f"""
WITH r AS (SELECT l_linestatus AS grp, l_quantity AS value, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) AS lo,
  count(*) OVER (PARTITION BY l_linestatus, l_quantity) AS n FROM lineitem)
SELECT DISTINCT grp, value, n, {R('lo + (n - 1) / 2', 'avg_rank')} FROM r""")
def average_ranks(t):
    rows = t.lineitem.select(F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("value"))
    return rounded(ranking.value_ranks(rows, "value", ["grp"]), "avg_rank")


@query("F16", f"""
WITH v AS (SELECT p_size AS i, sum(p_retailprice) AS v FROM part GROUP BY 1),
c AS (SELECT i, sum(v) OVER (ORDER BY i) / sum(v) OVER () AS cum FROM v)
SELECT min(i) AS k FROM c WHERE cum >= 0.95""")
def components_needed(t):
    v = t.part.groupBy(F.col("p_size").alias("i")).agg(F.sum("p_retailprice").alias("v"))
    return tables.components_needed(tables.shares(v, "v", out="share"))


@query("G01 G02", """
SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def last_key_wins(t):
    return tables.concat_last(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id")


@query("G03", """
SELECT k, count(*) AS n FROM (SELECT DISTINCT p_type AS k FROM part UNION SELECT DISTINCT event_type FROM events) GROUP BY k""")
def key_union(t):
    keys = t.part.select(F.col("p_type").alias("k")).union(t.events.select("event_type")).distinct()
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("G05", f"""
WITH n AS (SELECT o_orderstatus AS label, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1, 2)
SELECT label, {', '.join(f'''CAST(sum(CASE WHEN v = '{p}' THEN c ELSE 0 END) AS BIGINT) AS "{p}"''' for p in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))}
FROM n GROUP BY label""")
def wide_shares(t):
    n = t.orders.groupBy(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return tables.wide_shares(n, "label", "v", "c")


@query("G06", f"SELECT vec_id, {', '.join(R(f'embedding[{i + 1}]', f'emb_{i}') for i in range(8))} FROM embeddings")
def vector_columns(t):
    wide = tables.vector_to_columns(I.vectors(t), "embedding", 64)
    back = wide.select("vec_id", F.array(*[f"emb_{i}" for i in range(64)]).alias("embedding"))
    return rounded(tables.vector_to_columns(back, "embedding", 8), *[f"emb_{i}" for i in range(8)])


@query("G07", f"""
WITH v AS (SELECT label % 3 AS a, avg(embedding[1]) AS x FROM embeddings GROUP BY 1)
SELECT 'm' || r.a AS row, {', '.join(R(f"max(CASE WHEN c.a = {j} THEN CASE WHEN r.a = c.a THEN 1 ELSE r.x + c.x END END)", f'm{j}') for j in range(3))}
FROM v r CROSS JOIN v c GROUP BY r.a""")
def symmetric_matrix(t):
    x = t.embeddings.groupBy((F.col("label") % 3).alias("a")).agg(F.avg(F.element_at("embedding", 1)).alias("x"))
    three = x.agg(F.array_sort(F.collect_list(F.struct("a", "x"))).alias("g")).select("g", F.posexplode("g").alias("i", "p"))
    p = three.select("p", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("q")).select(
        F.concat(F.lit("m"), "p.a").alias("a"), F.concat(F.lit("m"), "q.a").alias("b"), (F.col("p.x") + F.col("q.x")).alias("v"))
    names = ["m0", "m1", "m2"]
    return rounded(tables.symmetric(p, "a", "b", "v", names), *names)


@query("L11", f"""
SELECT o_orderkey, {R('count(*) OVER () / (3 * count(*) OVER (PARTITION BY o_orderstatus))', 'weight')} FROM orders""")
def class_weights(t):
    return rounded(models.class_weights(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", "weight"), "weight")


@query("L12 O05 L13", """
SELECT p_partkey, CAST(coalesce(nullif(p_size, 7), (SELECT quantile_disc(p_size, 0.5) FROM part WHERE p_size <> 7)) AS DOUBLE) AS size,
  list_position((SELECT list(DISTINCT p_type ORDER BY p_type) FROM part), p_type) - 1 AS hot,
  p_type = 'LARGE' AS dummy_large FROM part""")
def encoded_features(t):
    """Median for gaps, one column per level in sorted order, dummy columns without the first level."""
    rows = t.part.select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("size"), F.col("p_type").alias("kind"))
    numeric, categorical = tables.split_columns(rows, "p_partkey")
    enc = models.encoder(rows, numeric, categorical)
    out = enc.transform(models.prepared(rows, numeric, categorical)).withColumn("x", vector_to_array("features"))
    hot = F.array_position(F.slice("x", 2, F.size("x") - 1), F.lit(1.0)) - 1
    levels = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    dummy = models.dummy_columns(out, "kind", levels)[0].cast("boolean").alias("dummy_large")
    return out.select("p_partkey", F.col("x")[0].alias("size"), hot.alias("hot"), dummy)
