"""Queries on texts, ids, names and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import documents, tables
from . import inputs as I
from .registry import R, Tables, query, r6

# Feature names with every known prefix, one per part.
PREFIXES = [*fixed.SUBGROUPS, "tubulointerstitial_lesions_", "glomerular_lesions_", "vascular_lesions_", "free_"]


def feature_names(t: Tables) -> DataFrame:
    known = F.array(*map(F.lit, PREFIXES))
    at = F.pmod(F.col("p_size"), F.lit(len(PREFIXES))) + 1
    tail = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_features_"), F.lower("p_type"))
    return t.part.select("p_partkey", F.concat(F.element_at(known, at.cast("int")), tail).alias("raw_feature"))


SQL_NAMES = ("names AS (SELECT p_partkey, [" + ", ".join(f"'{p}'" for p in PREFIXES) +
             f"][CAST(p_size % {len(PREFIXES)} AS INTEGER) + 1] || replace(lower(p_name), ' ', '_') || '_features_' || lower(p_type)"
             " AS raw_feature FROM part)")


def sql_prefix(rules: dict, default: str, col: str = "raw_feature") -> str:
    return "CASE " + " ".join(f"WHEN starts_with({col}, '{p}') THEN '{v}'" for p, v in
                              sorted(rules.items(), key=lambda kv: -len(kv[0]))) + f" ELSE '{default}' END"


SQL_MAIN = sql_prefix(fixed.MAIN_GROUPS, fixed.OTHER_GROUP)
SQL_SUB = sql_prefix(fixed.SUBGROUPS, fixed.OTHER_GROUP)
_display = "raw_feature"
for _old, _new in fixed.ABBREVIATIONS.items():
    _display = f"replace({_display}, '{_old}', '{_new}')"
SQL_DISPLAY = f"trim(regexp_replace({_display}, '\\s+', ' ', 'g'))"
_stems = "|".join(sorted({*fixed.SUBGROUPS, *fixed.MAIN_GROUPS}, key=lambda p: (-len(p), p)))
SQL_CORE = (f"trim(regexp_replace(replace(replace(regexp_replace(raw_feature, '^(?:{_stems})', ''), '_features_', ' '), '_', ' '),"
            " '\\s+', ' ', 'g'))")
SQL_MATCH = "trim(regexp_replace(regexp_replace(trim({0}), '" + fixed.RARE_SUFFIX + "', ''), '__+', '_', 'g'), '_')"


@query("B01 B22 A01", """
SELECT CASE WHEN length(trim(text)) >= 10 THEN 'ok' ELSE 'skipped' END AS status, count(*) AS n
FROM documents GROUP BY 1""")
def report_guard(t):
    ok, short = tables.split_usable(t.documents, "text")
    marked = ok.select(F.lit("ok").alias("status")).unionByName(short.select(F.lit("skipped").alias("status")))
    return tables.status_counts(marked)


@query("C13", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
def text_preview(t):
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))


RULES = [{"title": "Source", "description": "Use the report only."}, {"title": "Gaps", "description": "Write NA."}]


@query("C14", """
SELECT doc_id, md5('Read the report.' || chr(10) || chr(10) || 'Report:' || chr(10) || text || chr(10) || chr(10) ||
  'Answer with JSON in this form only:' || chr(10) || chr(10) || '{' || chr(10) || '    "a": ""' || chr(10) || '}' || chr(10) || chr(10) ||
  'Rules:' || chr(10) || chr(10) || '    1. Source:' || chr(10) || '       - Use the report only.' || chr(10) ||
  '    2. Gaps:' || chr(10) || '       - Write NA.' || chr(10)) AS prompt_md5 FROM documents""")
def report_prompt(t):
    body = text.prompt(F.col("text"), "Read the report.", {"a": ""}, RULES)
    return t.documents.select("doc_id", F.md5(body).alias("prompt_md5"))


@query("C15", """
SELECT event_id, CASE WHEN event_type = 'click' THEN '{"a":' || props || '}' WHEN event_type = 'view' THEN props ELSE NULL END AS doc FROM events""")
def recovered_json(t):
    """Answers with a nested object inside prose, a bare object, and broken ones."""
    noisy = F.when(F.col("event_type") == "click", F.concat(F.lit('Sure: {"a":'), "props", F.lit("} done. {x}"))) \
        .when(F.col("event_type") == "view", F.col("props")).otherwise(F.concat(F.lit("none "), F.lit("{"), "event_type"))
    return t.events.select("event_id", text.recover_json(noisy).alias("doc"))


@query("B02", """
SELECT doc_id, CASE WHEN label = 2 THEN 'key_terms' ELSE '' END AS missing, label <> 2 AS complete
FROM (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders)""")
def document_validation(t):
    """Required sections; one class of documents lacks one of them."""
    docs = I.report_documents(t).withColumn("doc", F.when(
        F.col("label") < 2, F.concat(F.lit('{"key_terms":[],'), F.substr("doc", F.lit(2)))).otherwise(F.col("doc")))
    lacking = text.missing_keys(F.col("doc"), ["Order", "Customer", "key_terms"])
    return docs.select("doc_id", F.array_join(lacking, ",").alias("missing"), (F.size(lacking) == 0).alias("complete"))


@query("B09 C39", """
SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS ph_id, CAST(o_orderkey AS VARCHAR) AS bio_id,
  'pathology_features_' || o_custkey || '_' || o_orderkey AS doc_name
FROM orders JOIN customer ON o_custkey = c_custkey""")
def file_ids(t):
    docs = I.report_documents(t).withColumn("ids", text.ids_of_file(F.concat(F.lit("/in/raw/"), "source_file")))
    return docs.select("doc_id", "ids.ph_id", "ids.bio_id", text.doc_name(F.col("ids.ph_id"), F.col("ids.bio_id")).alias("doc_name"))


@query("C16 C36", f"""
WITH n AS (SELECT p_partkey, ' ' || p_name || '__' || p_type || CASE WHEN p_size % 2 = 0 THEN '__RARE__' ELSE '_RARE_' END || ' ' AS raw FROM part)
SELECT p_partkey, {SQL_MATCH.format('raw')} AS clean, regexp_replace(trim({SQL_MATCH.format('raw')}), '\\s+', '_', 'g') AS norm FROM n""")
def match_names(t):
    raw = F.concat(F.lit(" "), "p_name", F.lit("__"), "p_type", F.when(F.col("p_size") % 2 == 0, "__RARE__").otherwise("_RARE_"), F.lit(" "))
    return t.part.select("p_partkey", text.match_name(raw).alias("clean"), text.norm_name(raw).alias("norm"))


@query("C17 C18 C19 C20 C35", f"""
WITH {SQL_NAMES}, g AS (SELECT *, {SQL_SUB} AS subgroup, {SQL_MAIN} AS main_group FROM names)
SELECT p_partkey, {SQL_DISPLAY} AS display, {sql_prefix({s + '_': s for s in fixed.FEATURE_SECTIONS}, 'other')} AS section,
  main_group, subgroup, {SQL_CORE} AS core, subgroup || ' | ' || {SQL_CORE} AS panel_label,
  list_position([{', '.join(f"'{v}'" for v in [*fixed.MAIN_GROUPS.values(), fixed.OTHER_GROUP])}], main_group) - 1 AS main_rank,
  list_position([{', '.join(f"'{v}'" for v in [*fixed.SUBGROUPS.values(), fixed.OTHER_GROUP])}], subgroup) - 1 AS subgroup_rank,
  array_to_string(string_split(raw_feature, '_')[1:2], '_') AS block FROM g""")
def feature_labels(t):
    f = F.col("raw_feature")
    return feature_names(t).select(
        "p_partkey", text.display_name(f).alias("display"), text.section_of(f).alias("section"),
        text.main_group(f).alias("main_group"), text.subgroup(f).alias("subgroup"), text.core_name(f).alias("core"),
        text.panel_label(f, " | ").alias("panel_label"), text.main_group_rank(text.main_group(f)).alias("main_rank"),
        text.subgroup_rank(text.subgroup(f)).alias("subgroup_rank"), text.block_of(f).alias("block"))


@query("C21 C22", """
SELECT p_partkey, p_type AS level, p_brand AS raw FROM part""")
def encoded_parts(t):
    encoded = F.concat(F.lit("cat__"), "p_brand", F.lit("_"), "p_type")
    return t.part.select("p_partkey", text.level_of(encoded, F.col("p_brand")).alias("level"),
                         text.raw_of_encoded(encoded).alias("raw"))


@query("C23", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'K-means' WHEN 'LARGE' THEN 'HDBSCAN' ELSE p_type END AS method FROM part""")
def method_names(t):
    raw = F.when(F.col("p_type") == "SMALL", "KMEANS").when(F.col("p_type") == "LARGE", "hdbscan").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", text.method_name(raw).alias("method"))


@query("C24", """
SELECT p_partkey, 'n_clusters=' || p_size || ', method=' || lower(p_type) AS params,
  CASE WHEN p_size % 2 = 0 THEN 'k=' || p_size ELSE lower(p_type) || '_k=' || p_size END AS param_id,
  printf('eps=%.3f', CAST(p_size AS DOUBLE) / 7) AS eps_id FROM part""")
def parameter_texts(t):
    params = F.create_map(F.lit("n_clusters"), F.col("p_size").cast("string"), F.lit("method"), F.lower("p_type"))
    algo = F.when(F.col("p_size") % 2 == 0, "KMeans").otherwise("Hierarchical")
    eps = F.create_map(F.lit("eps"), (F.col("p_size") / 7).cast("string"))
    return t.part.select("p_partkey", text.param_text(params).alias("params"), text.param_id(algo, params).alias("param_id"),
                         text.param_id(F.lit("DBSCAN"), eps).alias("eps_id"))


@query("C25 C27 C29", f"""
SELECT p_partkey, {R('CASE WHEN p_retailprice > 1000 THEN p_retailprice / 1000 ELSE p_retailprice END', 'fixed')},
  CASE WHEN p_size >= 25 THEN 'Yes' ELSE 'No' END AS risk, (p_size % 2 + p_size % 3) > 0 AS any_flag,
  CASE WHEN p_size % 4 >= 1 THEN 1 ELSE 0 END AS binary, CASE WHEN p_size % 4 >= 2 THEN 2 ELSE p_size % 4 END AS capped FROM part""")
def clinical_rules(t):
    s = F.col("p_size")
    return t.part.select(
        "p_partkey", r6(text.fix_unit(F.col("p_retailprice"), 1000, 1000)).alias("fixed"), text.risk(s, 25).alias("risk"),
        text.any_flag(s % 2, s % 3).alias("any_flag"), text.binarise(s % 4).alias("binary"), text.cap(s % 4).alias("capped"))


@query("C26 C28", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'low-activity' WHEN 'O' THEN 'high-activity' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS level, o_orderstatus || ' | ' || o_orderpriority AS grp,
  'Subtype: ' || o_orderstatus AS facet FROM orders""")
def factor_recode(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", text.recode(s, {"F": "low-activity", "O": "high-activity"}).alias("status"),
                           text.level_order(s, ["F", "O"]).alias("level"), text.group_label(s, F.col("o_orderpriority")).alias("grp"),
                           F.concat(F.lit("Subtype: "), s).alias("facet"))


@query("C30 C40", """
WITH p AS (SELECT event_id, value, (value / 100) * (value / 100) * (value / 100) * (value / 100) AS p FROM events)
SELECT event_id, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN p < 0.0001 THEN '< 0.0001' WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', round(p, 3)) END AS p_text,
  CASE WHEN value > 5 THEN printf('%.0f', round(value, 0)) || '%' ELSE printf('%.1f', round(value, 1)) || '%' END AS percent FROM p""")
def p_labels(t):
    v = F.col("value") / 100
    p = v * v * v * v
    rows = t.events.select("event_id", "value", p.alias("p"))
    return rows.select("event_id", text.p_stars(F.col("p")).alias("stars"), text.p_text(F.col("p")).alias("p_text"),
                       text.percent_text(F.col("value")).alias("percent"))


@query("C31", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Age (years)' WHEN 'LARGE' THEN 'MEST-C T score' ELSE p_type END AS label FROM part""")
def row_labels(t):
    raw = F.when(F.col("p_type") == "SMALL", "age (mean (SD))").when(F.col("p_type") == "LARGE", "MEST_C_score_T (%)").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", text.row_label(raw).alias("label"))


@query("C32 C33", f"""
WITH {I.SQL_RUNS}
SELECT run_id, {R('(silhouette + 1) / 2', 'silhouette_01')}, {R('least(calinski_harabasz / 5000, 1)', 'ch_01')},
  {R('1 - least(davies_bouldin / 2, 1)', 'db_01')}, {R('1 - noise_ratio', 'noise_01')},
  {R('least(1, greatest(0, calinski_harabasz / 1000))', 'best_ch_01')}, {R('greatest(0, (2 - davies_bouldin) / 4)', 'best_db_01')},
  CASE WHEN noise_ratio > 0.3 THEN 'high' WHEN noise_ratio > 0.1 THEN 'medium' ELSE 'low' END AS noise_band,
  CASE WHEN silhouette >= 0.7 THEN 'good' WHEN silhouette >= 0.5 THEN 'fair' ELSE 'poor' END AS quality FROM runs""")
def run_scales(t):
    c = [F.col(x) for x in ("silhouette", "calinski_harabasz", "davies_bouldin", "noise_ratio")]
    all_runs, best = text.run_scores(*c), text.best_scores(*c[:3])
    return I.runs(t).select("run_id", *[r6(v).alias(k) for k, v in all_runs.items()], r6(best["ch_01"]).alias("best_ch_01"),
                            r6(best["db_01"]).alias("best_db_01"), text.noise_band(c[3]).alias("noise_band"),
                            text.quality_band(c[0]).alias("quality"))


@query("C38", "SELECT o_orderkey, coalesce(nullif(CAST(o_custkey AS VARCHAR), '0'), '') AS id, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def casts(t):
    return t.orders.select("o_orderkey", text.text_id(F.nullif(F.col("o_custkey"), F.lit(0))).alias("id"),
                           F.col("o_totalprice").cast("string").try_cast("double").alias("price"))


# --- documents ------------------------------------------------------------------

@query("C08 C09 C10 A02 DM4", f"""
WITH {I.SQL_DOCS}
SELECT doc_id, ordinal, section || '_' || key AS key, value, type FROM feat
UNION ALL SELECT doc_id, 14, 'raw_only_x', '1', 'BIGINT' FROM docs""")
def flattened_documents(t):
    return documents.explode_features(I.flat_documents(t), "doc_id")


@query("C08 C09 C10 DM3", f"""
WITH {I.SQL_DOCS}
SELECT doc_id, section, key, value, type FROM feat WHERE value IS NOT NULL""")
def template_features(t):
    """The one-parse form for documents that follow their template."""
    rows = documents.explode_features(I.template_documents(t), "doc_id")
    return rows.select("doc_id", "section", "key", "value", "type")


@query("C12 DM5", f"""
WITH {I.SQL_DOCS}, s AS (SELECT doc_id, section, string_agg(key || ': ' || value, '; ' ORDER BY ordinal) AS t
  FROM feat WHERE value IS NOT NULL AND value <> '' GROUP BY doc_id, section)
SELECT doc_id, max(CASE section WHEN 'order' THEN t END) AS text_order, max(CASE section WHEN 'customer' THEN t END) AS text_customer,
  max(CASE section WHEN 'lines' THEN t END) AS text_lines, max(CASE section WHEN 'shipping' THEN t END) AS text_shipping
FROM s GROUP BY doc_id""")
def section_texts(t):
    return documents.section_texts(I.section_documents(t), "features", I.SECTIONS).select(
        "doc_id", *[f"text_{s}" for s in I.SECTIONS])


@query("A06 DM4", f"""
WITH {I.SQL_DOCS} SELECT doc_id, label, status AS order_status, code AS order_priority_code, segment AS customer_segment,
  debt AS customer_in_debt, flags AS lines_flags, late AS shipping_late FROM docs""")
def flattened_table(t):
    keys = ["order_status", "order_priority_code", "customer_segment", "customer_in_debt", "lines_flags", "shipping_late"]
    return documents.wide_table(I.flat_documents(t), ["doc_id", "label"], keys)


@query("E11", f"WITH {I.SQL_DOCS} SELECT DISTINCT section, key FROM feat")
def feature_universe(t):
    return documents.feature_universe(I.section_documents(t))


@query("C03", f"""
WITH {I.SQL_DOCS} SELECT doc_id, upper(nname) AS nation, qty, status IS NULL AS absent FROM docs""")
def value_by_path(t):
    d = F.col("doc")
    return I.report_documents(t).select(
        "doc_id", documents.value_at(d, "Customer.Nation.Home.Name").alias("nation"), documents.value_at(d, "Lines.Totals.Qty").alias("qty"),
        documents.value_at(d, "Lines.None").isNotNull().alias("absent"))


@query("C01 C04", """
SELECT o_orderkey AS doc_id, '{"a":{"status":"NA","price":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '}}' AS doc FROM orders""")
def struct_edits(t):
    """A struct field is set, another removed."""
    s = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("price"),
                          F.lit("x").alias("extra")).alias("a"))
    edited = documents.drop_field(documents.set_value(s, "a.status", F.lit("NA")), "a.extra")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.to_json(edited).alias("doc"))


TEMPLATE = documents.drop_key({
    "Order": {"Status": "", "Label": "", "Note": "", "Urgent": False},
    "Customer": {"Nation": {"Home": {"Name": ""}}, "Phone": ""},
    "Lines": {"Flags": [], "Count": 0, "total": 0, "Zip": ""},
    "MEST_C_score": {"M": "", "S": "", "T": "", "E": "", "C": ""},
    fixed.REMOVED_KEY: {"present": False},
})


@query("A05 C02 C05 C06 C07 C11", """
WITH agg AS (SELECT l_orderkey, CAST(count(*) AS VARCHAR) AS n, array_to_string(list_transform(list_sort(list(DISTINCT l_returnflag)), lambda x: '"' || x || '"'), ',') AS flags
             FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey AS doc_id, o_orderstatus, left(o_orderpriority, 1) AS code, substr(o_orderpriority, 3) AS plabel, n_name,
        CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'Band ' || CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END AS note,
        coalesce(flags, '') AS flags, coalesce(n, '0') AS n, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS debt
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN agg ON o_orderkey = l_orderkey)
SELECT doc_id, 'Order.Status' AS key, o_orderstatus AS value, 'direct' AS origin FROM d
UNION ALL SELECT doc_id, 'Order.Label', plabel, 'alike' FROM d
UNION ALL SELECT doc_id, 'Order.Note', CASE note WHEN '' THEN 'NA' ELSE note END, 'direct' FROM d
UNION ALL SELECT doc_id, 'Order.Urgent', n, 'alike' FROM d
UNION ALL SELECT doc_id, 'Customer.Nation.Home.Name', n_name, 'direct' FROM d
UNION ALL SELECT doc_id, 'Customer.Phone', n, 'alike' FROM d
UNION ALL SELECT doc_id, 'Lines.Flags', '[' || flags || ']', 'direct' FROM d
UNION ALL SELECT doc_id, 'Lines.Count', n, 'alike' FROM d
UNION ALL SELECT doc_id, 'Lines.total', CASE o_orderstatus WHEN 'F' THEN code ELSE 'Mild' END, 'alike' FROM d
UNION ALL SELECT doc_id, 'Lines.Zip', 'NA', 'default' FROM d
UNION ALL SELECT doc_id, 'MEST_C_score.M', 'M' || code, 'direct' FROM d
UNION ALL SELECT doc_id, 'MEST_C_score.S', 'S' || CASE debt WHEN 'true' THEN '1' ELSE '0' END, 'direct' FROM d
UNION ALL SELECT doc_id, 'MEST_C_score.T', CASE o_orderstatus WHEN 'F' THEN 'T' || code ELSE 'Mild' END, 'direct' FROM d
UNION ALL SELECT doc_id, 'MEST_C_score.E', 'E2', 'direct' FROM d
UNION ALL SELECT doc_id, 'MEST_C_score.C', o_orderstatus || 'x', 'direct' FROM d""")
def template_mapping(t):
    """Raw documents with a score section, mapped to a template."""
    head = F.col("doc")
    code = F.get_json_object(head, "$.Order.Priority.Code")
    status = F.get_json_object(head, "$.Order.Status")
    scores = F.concat(
        F.regexp_replace("doc", r"\}$", ""), F.lit(',"MEST_C_score":{"M":'), code,
        F.lit(',"S":'), F.get_json_object(head, "$.Customer.In_Debt"), F.lit(',"T":'),
        F.when(status == "F", F.concat(F.lit('"'), code, F.lit('"'))).otherwise(F.lit('"Mild"')),
        F.lit(',"E":2.7,"C":"'), status, F.lit('x"}}'))
    docs = I.report_documents(t).withColumn("doc", scores)
    mapped = documents.map_to_template(docs, "doc", TEMPLATE)
    rows = mapped.select("doc_id", F.posexplode_outer("mapped").alias("_", "e")).where("e is not null")
    return rows.select("doc_id", "e.key", "e.value", "e.origin")


@query("C34", """
WITH l AS (SELECT p_partkey, coalesce(nullif(p_name, 'red widget'), 'missing') AS name, coalesce(CAST(p_size AS VARCHAR), 'missing') AS size FROM part)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY name) < 30 THEN '__RARE__' ELSE name END AS name,
  CASE WHEN count(*) OVER (PARTITION BY size) < 30 THEN '__RARE__' ELSE size END AS size FROM l""")
def rare_levels(t):
    rows = t.part.select("p_partkey", F.nullif(F.col("p_name"), F.lit("red widget")).alias("name"), F.col("p_size").alias("size"))
    return tables.collapse_rare(rows, ["name", "size"], 30)
