"""Queries that explain classes: axis, prototypes, edits, trajectories, surrogate, models."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import answers, attribution, boosting, explain, external, models, perceptron, tables
from ..operators.ranking import stratified_split
from . import inputs as I
from .registry import R, query, r6, rounded
from .table_queries import folder
from .vector_queries import euclid

SQL_BASE = f"WITH {I.SQL_DOCS}, {I.SQL_TOP}, {I.SQL_AXIS}, base AS (SELECT *, section || '_' || key AS feature FROM feat WHERE label < 2)"
SQL_PROTOS = """counted AS (SELECT label, section, key, value, count(*) AS n, min((doc_id, ordinal)) AS first FROM base
  WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3, 4),
protos AS (SELECT label, section, key, value, n, seen FROM (SELECT *, row_number() OVER (PARTITION BY label, section, key ORDER BY n DESC, first) AS r,
  min(first[1] * 100 + first[2]) OVER (PARTITION BY label, section, key) AS seen FROM counted) WHERE r = 1)"""


def sql_shift(keys: str, cols: str, source: str) -> str:
    """Rows of source(doc_id, label, section, keys, cols, t) with delta_proj and support_score."""
    on = ", ".join(["doc_id", "section", keys])
    return f"""
newcells AS ({I.sql_cells('(SELECT DISTINCT ' + on + ', t FROM ' + source + ')', 'doc_id, ' + keys)}),
newpart AS (SELECT {on}, sum(x * coalesce(a, 0)) AS dot, sum(x * x) AS sq FROM newcells LEFT JOIN axis USING (section, b) GROUP BY ALL),
moved AS (SELECT s.*, (w.dot - coalesce(p.dot, 0) + coalesce(n.dot, 0)) / (sqrt(w.sq - coalesce(p.sq, 0) + coalesce(n.sq, 0)) + 1e-12)
    - w.dot / (sqrt(w.sq) + 1e-12) AS delta
  FROM {source} s JOIN whole w USING (doc_id) LEFT JOIN part p ON p.doc_id = s.doc_id AND p.section = s.section
  LEFT JOIN newpart n ON n.doc_id = s.doc_id AND n.section = s.section AND {' AND '.join(f'n.{k.strip()} = s.{k.strip()}' for k in keys.split(','))})
SELECT doc_id, label, section, {cols}, {R('delta', 'delta_proj')}, {R('CASE WHEN label = 0 THEN -delta ELSE delta END', 'support_score')} FROM moved"""


@query("M06 E13 H05", f"{SQL_BASE} SELECT ({I.SQL_SECTION_INDEX}) * {I.DIM} + b AS i, {R('a', 'a')} FROM axis WHERE abs(a) > 0.0000005")
def class_axis(t):
    _, axis = I.report_cases(t)
    cell = axis.select(F.posexplode("axis").alias("i", "a")).where(F.abs("a") > 0.0000005)
    return cell.select(F.col("i").cast("bigint").alias("i"), r6("a").alias("a"))


@query("E09 M07 DM10", f"{SQL_BASE}, {SQL_PROTOS} SELECT label, section, key, value, n FROM protos")
def class_prototypes(t):
    docs = I.template_documents(t).where(F.col("label") < 2)
    return explain.prototypes(docs, "label", "doc_id").drop("ordinal")


@query("M08 M12 D09 DM11 Q18", f"""{SQL_BASE},
e AS (SELECT doc_id, label, section, key, feature, left(coalesce(value, ''), 100) AS old_value FROM base JOIN top USING (feature)),
edit AS (SELECT e.*, (SELECT 1) AS one, t FROM e LEFT JOIN (
  SELECT e.doc_id, e.feature, string_agg(f.key || ': ' || f.value, '; ' ORDER BY f.ordinal) AS t FROM e JOIN base f ON f.doc_id = e.doc_id AND f.section = e.section
  WHERE f.key <> e.key AND f.value IS NOT NULL AND f.value <> '' GROUP BY 1, 2) x USING (doc_id, feature)),
{sql_shift('feature', 'feature, old_value', 'edit')}""")
def delete_experiment(t):
    cases, axis = I.report_cases(t)
    out = explain.delete_experiment(cases, I.top_features(t), axis, I.embed, I.SECTIONS, I.DIM, "doc_id")
    return rounded(out, "delta_proj", "support_score")


@query("M09 M12 D10", f"""{SQL_BASE}, {SQL_PROTOS},
e AS (SELECT b.doc_id, b.label, b.section, b.key, feature, b.value AS old_value, p.value AS new_value FROM base b JOIN top USING (feature)
  JOIN protos p ON p.label = 1 - b.label AND p.section = b.section AND p.key = b.key WHERE p.value IS DISTINCT FROM b.value),
edit AS (SELECT e.*, t FROM e JOIN (
  SELECT e.doc_id, e.feature, string_agg(f.key || ': ' || CASE WHEN f.key = e.key THEN new_value ELSE f.value END, '; ' ORDER BY f.ordinal)
    FILTER (f.key = e.key OR (f.value IS NOT NULL AND f.value <> '')) AS t
  FROM e JOIN base f ON f.doc_id = e.doc_id AND f.section = e.section GROUP BY 1, 2) x USING (doc_id, feature)),
{sql_shift('feature', 'feature, old_value, new_value', 'edit')}""")
def swap_experiment(t):
    cases, axis = I.report_cases(t)
    protos = explain.prototypes(cases, "label", "doc_id")
    out = explain.swap_experiment(cases, I.top_features(t), protos, axis, I.embed, I.SECTIONS, I.DIM, "doc_id")
    return rounded(out, "delta_proj", "support_score")


@query("M10 M12 C35", f"""{SQL_BASE}, {SQL_PROTOS},
e AS (SELECT b.doc_id, b.label, b.section, b.key, array_to_string(string_split(b.key, '_')[1:2], '_') AS block, p.value AS new_value FROM base b JOIN top USING (feature)
  JOIN protos p ON p.label = 1 - b.label AND p.section = b.section AND p.key = b.key WHERE p.value IS DISTINCT FROM b.value),
g AS (SELECT doc_id, label, section, block, CAST(count(*) AS INTEGER) AS n_changed FROM e GROUP BY ALL),
edit AS (SELECT g.*, t FROM g JOIN (
  SELECT g.doc_id, g.section, g.block, string_agg(f.key || ': ' || coalesce(e.new_value, f.value), '; ' ORDER BY f.ordinal)
    FILTER (coalesce(e.new_value, f.value) IS NOT NULL AND coalesce(e.new_value, f.value) <> '') AS t
  FROM g JOIN base f ON f.doc_id = g.doc_id AND f.section = g.section
  LEFT JOIN e ON e.doc_id = g.doc_id AND e.section = g.section AND e.block = g.block AND e.key = f.key GROUP BY 1, 2, 3) x USING (doc_id, section, block)),
{sql_shift('block', 'block, n_changed', 'edit')}""")
def block_experiment(t):
    cases, axis = I.report_cases(t)
    protos = explain.prototypes(cases, "label", "doc_id")
    out = explain.block_experiment(cases, I.top_features(t), protos, axis, I.embed, I.SECTIONS, I.DIM, "doc_id")
    return rounded(out, "delta_proj", "support_score")


@query("M11 G03", f"""{SQL_BASE}, {SQL_PROTOS},
k AS (SELECT section, key, max(CASE label WHEN 0 THEN value END) AS a, max(CASE label WHEN 1 THEN value END) AS b,
  max(CASE label WHEN 0 THEN seen END) AS sa, max(CASE label WHEN 1 THEN seen END) AS sb FROM protos GROUP BY 1, 2),
s AS (SELECT 0 AS start, section, key, a AS bv, b AS tv, sa AS so FROM k UNION ALL SELECT 1, section, key, b, a, sb FROM k),
s2 AS (SELECT *, array_to_string(string_split(key, '_')[1:2], '_') AS block, {I.SQL_SECTION_INDEX} AS si FROM s),
st AS (SELECT start, si, section, block, row_number() OVER (PARTITION BY start ORDER BY si, min(key)) AS step FROM s2 GROUP BY start, si, section, block),
walk AS (SELECT start, unnest(range(0, max(step) + 1)) AS stp FROM st GROUP BY start),
v AS (SELECT walk.start, walk.stp, s2.section, key, CASE WHEN step <= walk.stp AND tv IS NOT NULL THEN tv ELSE bv END AS value, coalesce(so, 1e18) AS so, step
  FROM s2 JOIN st USING (start, section, block) JOIN walk ON walk.start = s2.start),
tt AS (SELECT start, stp, section, string_agg(key || ': ' || value, '; ' ORDER BY so, step, key) AS t FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3),
vc AS ({I.sql_cells('tt', 'start, stp')}),
pos AS (SELECT start, stp, sum(x * coalesce(a, 0)) / (sqrt(sum(x * x)) + 1e-12) AS position FROM vc LEFT JOIN axis USING (section, b) GROUP BY 1, 2)
SELECT pos.start, pos.stp AS step, coalesce(st.section || ':' || st.block, 'baseline') AS description, {R('position', 'position')}
FROM pos LEFT JOIN st ON st.start = pos.start AND st.step = pos.stp""")
def prototype_trajectory(t):
    cases, axis = I.report_cases(t)
    protos = explain.prototypes(cases, "label", "doc_id")
    out = explain.prototype_trajectory(protos, axis, I.embed, I.SECTIONS, I.DIM)
    return rounded(out.withColumn("step", F.col("step").cast("bigint")), "position")


@query("M01", f"""
WITH c AS (SELECT label % 2 AS y, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
m AS (SELECT i, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS d FROM c GROUP BY i)
SELECT ['s0', 's1', 's2', 's3'][CAST(i // 16 + 1 AS INTEGER)] AS section, {R('sqrt(sum(d * d))', 'centroid_distance')} FROM m GROUP BY 1""")
def section_distance(t):
    rows = I.vectors(t).withColumn("label", F.col("label") % 2)
    return rounded(explain.section_distance(rows, "embedding", "label", ["s0", "s1", "s2", "s3"], 16), "centroid_distance")


@query("M01")
def section_attribution(t):
    rows = I.vectors(t).withColumn("label", F.col("label") % 2)
    return explain.section_attribution(rows, "vec_id", "embedding", "label", ["s0", "s1", "s2", "s3"], 16, folds=3)


def flat_labelled(t):
    flat = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return flat.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
                       F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
                       ((F.col("o_totalprice") > 250000) & (F.col("c_mktsegment") != "BUILDING")).cast("int").alias("y"))


@query("M02 M03 C21 E04")
def surrogate_importance(t):
    """Hold-out AUC, forest importance, exact and sampled Shapley values of a surrogate."""
    s = explain.Surrogate(flat_labelled(t), "o_orderkey", "y", trees=20, depth=6)
    auc = s.auc().select(F.lit("auc").alias("measure"), F.lit("all").alias("raw_feature"), F.col("auc").alias("value"))
    raw = explain.raw_importance(s.encoded_importance()).select(F.lit("forest").alias("measure"), "raw_feature", F.col("importance").alias("value"))
    shap = s.shapley(2).select(F.lit("shapley").alias("measure"), "raw_feature", F.col("importance").alias("value"))
    exact = explain.raw_importance(s.attribution()).select(F.lit("exact").alias("measure"), "raw_feature", F.col("importance").alias("value"))
    return auc.unionByName(raw).unionByName(shap).unionByName(exact)


@query("M03", f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS a, CAST(o_orderstatus = 'F' AS INTEGER) AS b FROM orders),
m AS (SELECT avg(a * b) AS v0, avg(b) FILTER (a = 1) AS va, avg(a) AS pa FROM o)
SELECT o_orderkey, {R('((a * va - v0) + (a * b - b * pa)) / 2', 'urgent')},
  {R('((b * pa - v0) + (a * b - a * va)) / 2', 'finished')} FROM o, m""")
def exact_attribution(t):
    """Exact Shapley values of a tree that learns 'urgent and finished' from two flags of each order."""
    a, b = (F.col("o_orderpriority") == "1-URGENT").cast("double"), (F.col("o_orderstatus") == "F").cast("double")
    rows = t.orders.select("o_orderkey", (a * b).alias("y"), array_to_vector(F.array(a, b)).alias("features")).persist()
    tree = RandomForestClassifier(labelCol="y", numTrees=1, maxDepth=2, bootstrap=False, featureSubsetStrategy="all").fit(rows)
    out = attribution.shapley_values(rows, tree)
    return out.select("o_orderkey", r6(F.element_at("shapley", 1)).alias("urgent"), r6(F.element_at("shapley", 2)).alias("finished"))


@query("M15 C22 F10", f"""
WITH {I.SQL_IMPORTANCES}, p AS (SELECT encoded_feature, raw_feature, sum(importance) AS importance FROM imp GROUP BY 1, 2)
SELECT encoded_feature, substr(encoded_feature, 14) AS level, {R('importance', 'importance')} FROM p WHERE raw_feature = 'Brand#4'
ORDER BY importance DESC, encoded_feature LIMIT 6""")
def encoded_levels(t):
    imp = I.importances(t).groupBy("encoded_feature", "raw_feature").agg(F.sum("importance").alias("importance"))
    return rounded(explain.encoded_levels(imp, "Brand#4").select("encoded_feature", "level", "importance"), "importance")


# --- supervised models ----------------------------------------------------------------

def split_vectors(t):
    rows = I.vectors(t).withColumn("y", F.col("label") % 2)
    split = stratified_split(rows, "y", ["vec_id"])
    return [models.ready(split.where(F.col("is_test") == part), "vec_id", "embedding", "y") for part in (False, True)]


@query("L01 L02 L06 L07 L09 L10 U04 A15")
def model_scores(t):
    train, test = split_vectors(t)
    specs = {"Logistic": models.logistic(), "RandomForest": models.forest(20, 8), "NaiveBayes": models.bernoulli_bayes(),
             "NN": models.perceptron(16, 60)}
    return models.model_table(train, test, specs, folds=2).drop("seconds")


@query("L03 L08")
def vote_scores(t):
    train, test = split_vectors(t)
    return models.model_table(train, test, {"SVM": models.kernel_svm(64, max_iter=30), "Ensemble": models.soft_vote(
        [models.logistic(), models.kernel_svm(64, max_iter=30)])}, folds=0).drop("seconds")


@query("L05 J09")
def boosting_scores(t):
    train, test = split_vectors(t)
    return models.model_table(train, test, {"Boosting": models.boosting(10, 4)}, folds=0).drop("seconds")


@query("L05", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders), n AS (SELECT s, count(*) AS n, sum(count(*)) OVER () AS total FROM o GROUP BY 1),
own AS (SELECT s, 0.3 * (n * 2 / 3.0) / (n * 2 / 9.0 + 1) AS up, -0.3 * ((total - n) / 3.0) / ((total - n) * 2 / 9.0 + 1) AS down,
  -0.3 * (n / 3.0) / (n * 2 / 9.0 + 1) AS alone FROM n),
z AS (SELECT o_orderkey, CASE WHEN o.s = 'F' THEN f.up ELSE f.down END AS zf, CASE WHEN o.s = 'O' THEN p.up ELSE p.down END AS zo,
  CASE WHEN o.s = 'P' THEN me.up ELSE me.alone END AS zp FROM o JOIN own f ON f.s = 'F' JOIN own p ON p.s = 'O' JOIN own me ON me.s = o.s)
SELECT o_orderkey, {R('exp(zf) / (exp(zf) + exp(zo) + exp(zp))', 'p_f')}, {R('exp(zo) / (exp(zf) + exp(zo) + exp(zp))', 'p_o')},
  {R('exp(zp) / (exp(zf) + exp(zo) + exp(zp))', 'p_p')} FROM z""")
def boosted_status(t):
    """One round of three-class boosting on two flags of each order; its second-order leaves have a closed form."""
    flag = lambda s: (F.col("o_orderstatus") == s).cast("double")
    rows = t.orders.select("o_orderkey", F.array(flag("F"), flag("O")).alias("vec"), (flag("O") + 2 * flag("P")).alias("label"))
    out = boosting.fit(rows, 3, rounds=1, depth=2, step=0.3).predict(rows)
    return out.select("o_orderkey", *[r6(F.element_at("probability", i + 1)).alias(f"p_{c}") for i, c in enumerate("fop")])


@query("L06", "SELECT c_custkey, CAST(c_acctbal > 4500 AS DOUBLE) AS prediction FROM customer WHERE abs(c_acctbal - 4500) > 1500")
def stopped_network(t):
    """A network that stops early, on classes with a wide gap between them."""
    x = (F.col("c_acctbal").cast("double") - 4500) / 2000
    rows = t.customer.where("abs(c_acctbal - 4500) > 1500").select(F.col("c_custkey").alias("id"), F.array(x, x * x).alias("vec"), (x > 0).cast("int").alias("label"))
    out = perceptron.fit(rows, 2, hidden=8, patience=3, step=0.05).predict(rows)
    return out.select(F.col("id").alias("c_custkey"), "prediction")


@query("L04", f"""
WITH s AS (SELECT vec_id, embedding, label % 2 AS y, row_number() OVER (PARTITION BY label % 2 ORDER BY
    CAST(('0x' || left(md5('42:' || vec_id), 15)) AS BIGINT), vec_id) <= floor(count(*) OVER (PARTITION BY label % 2) * CAST(0.2 AS DOUBLE)) AS test FROM embeddings),
p AS (SELECT a.vec_id AS id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {euclid('a.embedding', 'b.embedding')}, b.vec_id) AS r
  FROM s a, s b WHERE a.test AND NOT b.test)
SELECT id, {R('avg(y)', 'p1')}, CAST(avg(y) > 0.5 AS DOUBLE) AS prediction FROM p WHERE r <= 5 GROUP BY id""")
def neighbour_vote(t):
    train, test = split_vectors(t)
    out = models.neighbours_vote(5)(train, 2)(test)
    return out.select("id", r6(F.element_at("probability", 2)).alias("p1"), "prediction")


@query("U01 B01 B02 C14 C15 B22", """
SELECT CASE WHEN length(trim(text)) < 10 THEN 'skipped' WHEN regexp_matches(text, 'the') THEN 'ok' ELSE 'invalid' END AS status, count(*) AS n
FROM documents GROUP BY 1""")
def extraction_status(t):
    """The model call with a pattern extractor; texts without the pattern give an incomplete document."""
    def extractor(prompt: str) -> str:
        body = prompt.split("Report:\n", 1)[1].split("\n\nAnswer with JSON", 1)[0]
        return 'Found {"a": {"b": 1}}' if "the" in body else 'Found {"b": {"b": 1}}'

    out = external.extract(t.documents, "doc_id", "text", extractor, "Read.", {"a": ""}, required=["a"], wait=0)
    return tables.status_counts(out)


@query("U01 A09 B03", """
WITH d AS (SELECT trim(text) AS t, text, length(trim(text)) >= 10 AS usable, regexp_matches(text, 'the') AS good, regexp_matches(text, ' of ') AS half FROM documents),
s AS (SELECT *, CASE WHEN NOT usable THEN 'skipped' WHEN good THEN 'ok' WHEN half THEN 'invalid' ELSE 'failed' END AS status FROM d)
SELECT status, count(*) AS n, count(DISTINCT text) FILTER (usable) AS entries, count(DISTINCT text) FILTER (status = 'failed') AS asked_again FROM s GROUP BY status""")
def kept_answers(t):
    """Two runs over one answer log: the second asks only for what failed, and each prompt of the log stands once per call."""
    def extractor(prompt: str) -> str:
        body = prompt.split("Report:\n", 1)[1].split("\n\nAnswer with JSON", 1)[0]
        if "the" not in body and " of " not in body:
            raise ValueError("nothing to read")
        return 'Found {"a": {"b": 1}}' if "the" in body else 'Found {"b": {"b": 1}}'

    log = folder(t, "answers")
    run = lambda: external.extract(t.documents, "doc_id", "text", extractor, "Read.", {"a": ""}, required=["a"], attempts=1,
                                   wait=0, kept=log, model="patterns", slice_rows=20_000)
    run()
    first = answers.known(t.spark, log).groupBy("key").agg(F.count(F.lit(1)).alias("calls"))
    counts = tables.status_counts(run())
    both = answers.known(t.spark, log).groupBy("key").agg(F.count(F.lit(1)).alias("both"), F.any_value("answer").alias("answer"))
    status = F.when(F.col("answer").isNull(), "failed").when(F.col("answer").startswith('Found {"a"'), "ok").otherwise("invalid")
    calls = both.join(first, "key").groupBy(status.alias("status")).agg(
        F.sum("calls").alias("entries"), F.sum(F.col("both") - F.col("calls")).alias("asked_again"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return counts.join(calls, "status", "left").select("status", "n", none("entries"), none("asked_again"))
