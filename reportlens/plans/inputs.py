"""Report documents, vectors and runs derived from the given tables, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import documents, explain, metrics
from ..session import cut_lineage
from .registry import Tables

SECTIONS = ["order", "customer", "lines", "shipping"]
DIM = 16
TOP = ["order_status", "order_priority_label", "order_note", "customer_segment", "lines_flags", "shipping_late",
       "customer_nation_home_name", "customer_nation_home_key"]


def report_documents(t: Tables) -> DataFrame:
    """(doc_id, source_file, label, doc): one nested JSON document per order."""
    o, li = t.orders, t.lineitem
    agg = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"),
        F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.min("l_shipdate").alias("ship"))
    nation = t.nation.select("n_nationkey", "n_name")
    # Both sides are large and meet on the order key, which the aggregate is already partitioned by.
    rows = o.join(agg.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    note = F.when(F.col("o_orderstatus") == "O", "").otherwise(
        F.concat(F.lit("Band "), F.floor(F.col("o_totalprice") / 100000).cast("string")))
    doc = F.struct(
        F.struct(
            F.col("o_orderstatus").alias("Status"),
            F.struct(F.left("o_orderpriority", F.lit(1)).cast("int").alias("Code"),
                     F.substr("o_orderpriority", F.lit(3)).alias("Label")).alias("Priority"),
            note.alias("Note")).alias("Order"),
        F.struct(
            F.col("c_mktsegment").alias("Segment"), (F.col("c_acctbal") < 0).alias("In_Debt"),
            F.struct(F.struct(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("KEY")).alias("Home")).alias("Nation"),
        ).alias("Customer"),
        F.struct(
            F.struct(F.coalesce("n", F.lit(0)).alias("N"), F.coalesce("qty", F.lit(0)).alias("Qty")).alias("Totals"),
            F.coalesce("flags", F.array().cast("array<string>")).alias("Flags")).alias("Lines"),
        F.struct(
            F.coalesce(F.col("ship") < F.col("o_orderdate"), F.lit(False)).alias("Late"),
            F.year("o_orderdate").alias("Year"),
            F.struct(F.lit(None).cast("string").alias("Batch")).alias("Extra")).alias("Shipping"),
        F.struct(F.lit(1).alias("x")).alias("Raw_Only"),
    )
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    name = F.concat(F.lit("pathology_features_"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.lit(".json"))
    return rows.select(F.col("o_orderkey").alias("doc_id"), name.alias("source_file"), label.alias("label"),
                       F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def flat_documents(t: Tables) -> DataFrame:
    return documents.flatten(report_documents(t), "doc")


TEMPLATE = {
    "Order": {"Status": "", "Priority": {"Code": 0, "Label": ""}, "Note": ""},
    "Customer": {"Segment": "", "In_Debt": False, "Nation": {"Home": {"Name": "", "KEY": 0}}},
    "Lines": {"Totals": {"N": 0, "Qty": 0}, "Flags": []},
    "Shipping": {"Late": False, "Year": 0, "Extra": {"Batch": ""}},
}


def template_documents(t: Tables) -> DataFrame:
    """(doc_id, source_file, label, features with section) of documents that follow the template."""
    flat = documents.flatten_template(report_documents(t), "doc", TEMPLATE)
    return flat.select("doc_id", "source_file", "label",
                       documents.with_section(F.col("features"), SECTIONS).alias("features"))


def section_documents(t: Tables) -> DataFrame:
    """The same for raw documents."""
    flat = flat_documents(t)
    return flat.select("doc_id", "source_file", "label",
                       documents.with_section(F.col("features"), SECTIONS).alias("features"))


def embed(text: Column) -> Column:
    return V.hashing_vector(text, DIM)


def report_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(cases of classes 0 and 1 with their position parts, axis); written once, read by every edit."""
    docs = template_documents(t).where(F.col("label") < 2)
    rows = cut_lineage(explain.embed_sections(docs, "features", SECTIONS, embed))
    axis = cut_lineage(explain.class_axis(rows.withColumn("vec", F.flatten("vecs")), "vec", "label"))
    return explain.position_parts(rows, "vecs", axis, SECTIONS, DIM), axis


def top_features(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f,) for f in TOP], "feature string")


def runs(t: Tables) -> DataFrame:
    """One clustering run per part."""
    return t.part.select(
        F.col("p_partkey").cast("string").alias("run_id"), F.col("p_partkey").alias("ordinal"),
        F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("config_key"), F.col("p_type").alias("algorithm"),
        ((F.col("p_retailprice") - 1000) / 1000).alias("silhouette"), (F.col("p_retailprice") * 3).alias("calinski_harabasz"),
        (F.col("p_size") / 20).alias("davies_bouldin"), F.col("p_size").alias("n_clusters"),
        (F.col("p_size") / 50).alias("noise_ratio"))


def edits(t: Tables) -> DataFrame:
    """(feature, support_score, value, label): events read as edit results."""
    return t.events.select(F.col("event_type").alias("feature"), (F.col("value") - 50).alias("support_score"),
                           F.get_json_object("props", "$.k").alias("old_value"),
                           (F.col("value") > 50).cast("int").alias("label"))


def importances(t: Tables) -> DataFrame:
    """(encoded_feature, raw_feature, importance): parts read as encoded features."""
    return t.part.select(F.concat(F.lit("cat__"), "p_brand", F.lit("_"), "p_type").alias("encoded_feature"),
                         F.col("p_brand").alias("raw_feature"), F.col("p_retailprice").alias("importance"))


def vectors(t: Tables) -> DataFrame:
    """(vec_id, embedding, label) with the label as int."""
    return t.embeddings.select("vec_id", "embedding", F.col("label").cast("int").alias("label"))


def methods(t: Tables) -> DataFrame:
    """(vec_id, rule_a, rule_b, rule_c): three labelings by plain rules, the last with noise."""
    v = t.embeddings
    return v.select(
        "vec_id", F.col("label").cast("int").alias("rule_a"), (F.col("label") % 3).cast("int").alias("rule_b"),
        F.when(F.element_at("embedding", 2) < -0.15, -1)
        .when(F.element_at("embedding", 1) > 0, 1).otherwise(0).alias("rule_c"))


def cohort(t: Tables) -> DataFrame:
    """Orders with customer figures: two numbers, two categories, two strata."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("keyID"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("cluster"),
        F.when(F.col("c_acctbal") >= 0, "high-risk").otherwise("low-risk").alias("risk"))


def durations(t: Tables) -> DataFrame:
    """(time, event, grp): days from order to shipping, returned lines as events."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.datediff("l_shipdate", "o_orderdate").alias("time"), (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
    ).where("time > 0")


def means(t: Tables) -> DataFrame:
    return metrics.centroids(vectors(t), "embedding", "label")


# --- the same in SQL ------------------------------------------------------------

SQL_DOCS = """
agg AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty,
               array_to_string(list_sort(list(DISTINCT lower(l_returnflag))), ', ') AS flags, min(l_shipdate) AS ship
        FROM lineitem GROUP BY l_orderkey),
docs AS (SELECT o_orderkey AS doc_id, o_custkey,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
    lower(o_orderstatus) AS status, left(o_orderpriority, 1) AS code, lower(substr(o_orderpriority, 3)) AS plabel,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'band ' || CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END AS note,
    lower(c_mktsegment) AS segment, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS debt,
    lower(n_name) AS nname, CAST(n_nationkey AS VARCHAR) AS nkey,
    CAST(coalesce(n, 0) AS VARCHAR) AS n, CAST(coalesce(qty, 0) AS VARCHAR) AS qty, coalesce(flags, '') AS flags,
    CASE WHEN coalesce(ship < o_orderdate, false) THEN 'True' ELSE 'False' END AS late, CAST(year(o_orderdate) AS VARCHAR) AS yr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN agg ON o_orderkey = l_orderkey),
feat AS (
  SELECT doc_id, label, 'order' AS section, 0 AS ordinal, 'status' AS key, status AS value, 'STRING' AS type FROM docs
  UNION ALL SELECT doc_id, label, 'order', 1, 'priority_code', code, 'BIGINT' FROM docs
  UNION ALL SELECT doc_id, label, 'order', 2, 'priority_label', plabel, 'STRING' FROM docs
  UNION ALL SELECT doc_id, label, 'order', 3, 'note', note, 'STRING' FROM docs
  UNION ALL SELECT doc_id, label, 'customer', 4, 'segment', segment, 'STRING' FROM docs
  UNION ALL SELECT doc_id, label, 'customer', 5, 'in_debt', debt, 'BOOLEAN' FROM docs
  UNION ALL SELECT doc_id, label, 'customer', 6, 'nation_home_name', nname, 'STRING' FROM docs
  UNION ALL SELECT doc_id, label, 'customer', 7, 'nation_home_key', nkey, 'BIGINT' FROM docs
  UNION ALL SELECT doc_id, label, 'lines', 8, 'totals_n', n, 'BIGINT' FROM docs
  UNION ALL SELECT doc_id, label, 'lines', 9, 'totals_qty', qty, 'BIGINT' FROM docs
  UNION ALL SELECT doc_id, label, 'lines', 10, 'flags', flags, 'LIST' FROM docs
  UNION ALL SELECT doc_id, label, 'shipping', 11, 'late', late, 'BOOLEAN' FROM docs
  UNION ALL SELECT doc_id, label, 'shipping', 12, 'year', yr, 'BIGINT' FROM docs
  UNION ALL SELECT doc_id, label, 'shipping', 13, 'extra_batch', NULL, 'VOID' FROM docs)
"""
SQL_TOP = "top AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in TOP) + "]) AS feature)"
SQL_SECTION_INDEX = "CASE section WHEN 'order' THEN 0 WHEN 'customer' THEN 1 WHEN 'lines' THEN 2 ELSE 3 END"


def sql_cells(texts: str, keys: str) -> str:
    """Vector cells (keys, section, b, x) of a table of texts (keys, section, t)."""
    return f"""
SELECT {keys}, section, CAST(('0x' || left(h, 8)) AS BIGINT) % {DIM} AS b,
       CAST(sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x
FROM (SELECT {keys}, section, md5(w) AS h FROM (SELECT {keys}, section, unnest(string_split(lower(t), ' ')) AS w FROM {texts})
      WHERE w <> '') GROUP BY ALL"""


SQL_AXIS = f"""
texts AS (SELECT doc_id, label, section, string_agg(key || ': ' || value, '; ' ORDER BY ordinal) AS t
          FROM feat WHERE value IS NOT NULL AND value <> '' AND label < 2 GROUP BY ALL),
cells AS ({sql_cells('texts', 'doc_id, label')}),
sizes AS (SELECT label, count(*) AS n FROM docs WHERE label < 2 GROUP BY label),
mean AS (SELECT label, section, b, sum(x) / any_value(n) AS m FROM cells JOIN sizes USING (label) GROUP BY label, section, b),
unitmean AS (SELECT label, section, b, m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12) AS u FROM mean),
diff AS (SELECT section, b, sum(CASE WHEN label = 1 THEN u ELSE -u END) AS d FROM unitmean GROUP BY section, b),
axis AS (SELECT section, b, d / (sqrt(sum(d * d) OVER ()) + 1e-12) AS a FROM diff),
part AS (SELECT doc_id, label, section, sum(x * coalesce(a, 0)) AS dot, sum(x * x) AS sq
         FROM cells LEFT JOIN axis USING (section, b) GROUP BY doc_id, label, section),
whole AS (SELECT doc_id, label, sum(dot) AS dot, sum(sq) AS sq FROM part GROUP BY doc_id, label)"""

SQL_RUNS = """runs AS (SELECT CAST(p_partkey AS VARCHAR) AS run_id, p_partkey AS ordinal,
  p_brand || '_' || CAST(p_partkey AS VARCHAR) AS config_key, p_type AS algorithm,
  (p_retailprice - 1000) / 1000 AS silhouette, p_retailprice * 3 AS calinski_harabasz,
  CAST(p_size AS DOUBLE) / 20 AS davies_bouldin, p_size AS n_clusters, CAST(p_size AS DOUBLE) / 50 AS noise_ratio FROM part)"""
SQL_EDITS = """edits AS (SELECT event_type AS feature, value - 50 AS support_score,
  json_extract_string(props, '$.k') AS old_value, CAST(value > 50 AS INTEGER) AS label FROM events)"""
SQL_IMPORTANCES = """imp AS (SELECT 'cat__' || p_brand || '_' || p_type AS encoded_feature, p_brand AS raw_feature,
  p_retailprice AS importance FROM part)"""
SQL_METHODS = """methods AS (SELECT vec_id, label AS rule_a, label % 3 AS rule_b,
  CASE WHEN embedding[2] < CAST(-0.15 AS DOUBLE) THEN -1 WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS rule_c FROM embeddings)"""
SQL_COHORT = """cohort AS (SELECT o_orderkey AS keyID, o_totalprice AS price, c_acctbal AS balance, o_orderpriority AS priority,
  c_mktsegment AS segment, o_orderstatus AS cluster, CASE WHEN c_acctbal >= 0 THEN 'high-risk' ELSE 'low-risk' END AS risk
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_DURATIONS = """durations AS (SELECT datediff('day', o_orderdate, l_shipdate) AS time, CAST(l_returnflag = 'R' AS INTEGER) AS event,
  l_linestatus AS grp, l_quantity AS quantity, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE datediff('day', o_orderdate, l_shipdate) > 0)"""
