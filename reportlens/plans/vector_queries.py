"""Queries on vectors: normalisation, reduction, clustering, scores, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import answers, cluster, documents, external, linkage, metrics, pairs, reduce, stability, tables
from ..operators.ranking import stratified_folds, subsample
from ..session import constant, cut_lineage
from . import inputs as I
from .registry import R, query, r6, rounded
from .table_queries import folder, sql_hash

SQL_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def dot(a: str, b: str) -> str:
    return SQL_DOT.format(a=a, b=b)


def euclid(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            "lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))")


def cosine(a: str, b: str) -> str:
    return f"(1 - {dot(a, b)} / sqrt({dot(a, a)}) / sqrt({dot(b, b)}))"


def checksum(vec: Column) -> Column:
    """Position-weighted sum of a vector."""
    return V.total(F.transform(V.as_double(vec), lambda x, i: x * (i + 1)))


SQL_SUMCHECK = "list_sum(list_transform({0}, lambda x, i: CAST(x AS DOUBLE) * i))"


# --- vector columns ---------------------------------------------------------------

@query("H01 H02 H03 DM6", f"""
SELECT vec_id, CAST(4 * 20 AS INTEGER) AS dim,
  {R(SQL_SUMCHECK.format("list_concat(embedding[1:16], [0, 0, 0, 0], embedding[17:36], list_transform(range(20), lambda x: 0), embedding[50:64], [0, 0, 0, 0, 0])"), 'checksum')} FROM embeddings""")
def concatenated(t):
    """A short, a long, a missing and a short section brought to 20 each."""
    e = F.col("embedding")
    none = F.lit(None).cast("array<float>")
    full = V.concat_sections([F.slice(e, 1, 16), F.slice(e, 17, 30), none, F.slice(e, 50, 15)], 20)
    return I.vectors(t).select("vec_id", F.size(full).alias("dim"), r6(checksum(full)).alias("checksum"))


@query("H04", f"""
SELECT vec_id, {R(SQL_SUMCHECK.format("list_transform(embedding, lambda x: x / list_sum(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))))"), 'l1')},
  {R(f"list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) / sqrt({dot('embedding', 'embedding')})", 'l2')},
  {R(f"list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) / list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE))))", 'mx')} FROM embeddings""")
def normalized(t):
    n = {"l1": "l1", "l2": "l2", "mx": "max"}
    return I.vectors(t).select("vec_id", *[r6(checksum(V.normalize(F.col("embedding"), v))).alias(k) for k, v in n.items()])


@query("H05 H06 H15", f"""
WITH u AS (SELECT vec_id, embedding AS e, sqrt({dot('embedding', 'embedding')}) + 1e-12 AS n FROM embeddings)
SELECT vec_id, {R(SQL_SUMCHECK.format('e[17:32]') + ' / n', 'part')}, {R(SQL_SUMCHECK.format('list_concat(e[1:16], e[33:64])') + ' / n', 'rest')},
  {R('(' + dot('e', '(SELECT e FROM u WHERE vec_id = 0)') + ') / n', 'product')} FROM u""")
def unit_parts(t):
    v = I.vectors(t).select("vec_id", "embedding", V.unit(F.col("embedding")).alias("u"))
    v = v.withColumn("axis", v.where("vec_id = 0").select("embedding").scalar())
    return v.select("vec_id", r6(checksum(V.section_slice(F.col("u"), 1, 16))).alias("part"),
                    r6(checksum(V.without_section(F.col("u"), 1, 16, 4))).alias("rest"), r6(V.dot(F.col("u"), F.col("axis"))).alias("product"))


@query("B06", f"""
WITH c AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM c WHERE x > 0 GROUP BY i)
SELECT vec_id, {R('sum((i + 1) * CASE WHEN x > 0 THEN x ELSE m END)', 'checksum')} FROM c JOIN m USING (i) GROUP BY vec_id""")
def filled_vectors(t):
    """Negative entries read as gaps and filled with the mean of their position."""
    holes = I.vectors(t).withColumn("embedding", F.transform(V.as_double(F.col("embedding")), lambda x: F.when(x > 0, x)))
    return tables.fill_vector_gaps(holes, "embedding").select("vec_id", r6(checksum(F.col("embedding"))).alias("checksum"))


@query("U02", f"""
WITH w AS (SELECT doc_id, md5(unnest(string_split_regex(lower(text), '\\s+'))) AS h, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
c AS (SELECT doc_id, CAST(('0x' || left(h, 8)) AS BIGINT) % 16 AS b, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS x FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, {R('sum((b + 1) * x)', 'checksum')}, {R('sum(x * x)', 'square')} FROM c GROUP BY doc_id""")
def embedded_texts(t):
    """Whole report texts through the model call; each distinct text is embedded once."""
    ascii_space = F.regexp_replace("text", r"\s+", " ")
    vecs = external.embed_texts(t.documents.select("doc_id", ascii_space.alias("text")), "text", external.hashing_embedder(16), 16, wait=0)
    return vecs.select("doc_id", r6(checksum(F.col("embedding"))).alias("checksum"), r6(V.dot(F.col("embedding"), F.col("embedding"))).alias("square"))


@query("U02 A09 H03", f"""
WITH w AS (SELECT doc_id, md5(unnest(string_split_regex(lower(text), '\\s+'))) AS h, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
c AS (SELECT doc_id, CAST(('0x' || left(h, 8)) AS BIGINT) % 16 AS b, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS x FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, 'ok' AS status, {R('sum((b + 1) * x)', 'checksum')}, CAST((SELECT count(DISTINCT regexp_replace(text, '\\s+', ' ', 'g')) FROM documents WHERE text <> '') AS BIGINT) AS calls
FROM c GROUP BY doc_id""")
def kept_vectors(t):
    """Vectors of a first run taken out of the answer log by a second one, and how many calls both made."""
    log, texts = folder(t, "vectors"), t.documents.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    for _ in range(2):
        vecs = external.embed_texts(texts, "text", external.hashing_embedder(16), 16, wait=0, kept=log, model="hashing")
    calls = answers.known(t.spark, log, "array<float>").agg(F.count(F.lit(1)).alias("calls"))
    return vecs.where("embedding_status <> 'empty'").select("doc_id", F.col("embedding_status").alias("status"),
        r6(checksum(F.col("embedding"))).alias("checksum"), constant(calls).alias("calls"))


# --- reduction ----------------------------------------------------------------------

def _distances_kept(rows: DataFrame, vec: str) -> DataFrame:
    """Squared length per row: free of signs and of the order of equal components."""
    return rows.select("vec_id", r6(V.dot(F.col(vec), F.col(vec))).alias("square"))


SQL_CENTRED = """
c AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM c GROUP BY i)"""


@query("H07 H13", f"""
WITH {SQL_CENTRED}
SELECT vec_id, {R('sum((x - m) * (x - m))', 'square')} FROM c JOIN m USING (i) GROUP BY vec_id""")
def full_pca(t):
    """All components of a centred PCA keep every row's distance to the mean."""
    fit = reduce.pca(I.vectors(t), "embedding", 64)
    mean = F.transform(F.array(*[F.avg(F.element_at("reduced", i + 1)) for i in range(64)]), lambda x: x)
    centre = fit.rows.agg(mean.alias("m")).scalar()
    rows = fit.rows.withColumn("centre", centre)
    return _distances_kept(rows.withColumn("z", V.subtract(F.col("reduced"), F.col("centre"))), "z")


@query("H08", f"SELECT vec_id, {R(dot('embedding', 'embedding'), 'square')} FROM embeddings")
def full_svd(t):
    """All singular directions without centring keep every row's length."""
    return _distances_kept(reduce.svd(I.vectors(t), "embedding", 64).rows, "reduced")


@query("H12", f"""
WITH {SQL_CENTRED}
SELECT vec_id, {R('sum((x - m) * (x - m))', 'square')} FROM c JOIN m USING (i) GROUP BY vec_id""")
def wide_pca(t):
    rows, _ = reduce.wide_pca(I.vectors(t), "embedding", 64)
    return _distances_kept(rows, "reduced")


@query("H09 H10")
def reduction_shares(t):
    """Variance shares of the two-stage and the high-variance reduction."""
    two = reduce.two_stage_pca(I.vectors(t), "embedding", 32, 8)
    high = reduce.high_variance_pca(I.vectors(t), "embedding", 8)
    rows = [("two_stage", i, float(x)) for i, x in enumerate(two.shares)] + [("high_variance", i, float(x)) for i, x in enumerate(high.shares)]
    return t.spark.createDataFrame(rows, "method string, i int, share double")


@query("H11")
def map_2d(t):
    return rounded(reduce.map_2d(I.vectors(t), "embedding", "vec_id", "label"), "x", "y")


@query("H14", "SELECT vec_id, true AS small FROM embeddings")
def noise_size(t):
    """Noise stays within ten times its scale of the row it is added to."""
    v = I.vectors(t)
    spread = metrics.feature_std(v, "embedding").scalar()
    noisy = reduce.add_noise(v, "embedding", "vec_id", 0.01, 0).withColumn("spread", spread)
    gap = V.norm2(V.subtract(F.col("noisy"), F.col("embedding")))
    return noisy.select("vec_id", gap.between(0.001 * V.norm2(F.col("spread")), 0.1 * V.norm2(F.col("spread"))).alias("small"))


# --- pairs --------------------------------------------------------------------------

@query("D13 D12", f"""
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, {cosine('a.embedding', 'b.embedding')} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM p)
SELECT id, other, CAST(rank AS INTEGER) AS rank, {R('d', 'dist')} FROM r WHERE rank <= 5""")
def nearest_neighbours(t):
    return rounded(pairs.nearest(I.vectors(t), "vec_id", "embedding", 5).select("id", "other", "rank", "dist"), "dist")


@query("E23", f"""
WITH p AS (SELECT a.label AS label_a, b.label AS label_b, {euclid('a.embedding', 'b.embedding')} AS d FROM embeddings a, embeddings b)
SELECT label_a, label_b, {R('avg(d)', 'mean_dist')} FROM p GROUP BY 1, 2""")
def label_distances(t):
    return rounded(pairs.label_distances(I.vectors(t), "vec_id", "embedding", "label"), "mean_dist")


@query("E23", f"""
WITH p AS (SELECT a.label AS la, b.label AS lb, avg({euclid('a.embedding', 'b.embedding')}) AS d FROM embeddings a, embeddings b GROUP BY 1, 2)
SELECT {R('avg(d) FILTER (la = lb)', 'intra_mean')}, {R('stddev_pop(d) FILTER (la = lb)', 'intra_std')}, {R('avg(d) FILTER (la < lb)', 'inter_mean')},
  {R('stddev_pop(d) FILTER (la < lb)', 'inter_std')}, {R('avg(d) FILTER (la < lb) / avg(d) FILTER (la = lb)', 'separation')} FROM p""")
def separation(t):
    d = pairs.label_distances(I.vectors(t), "vec_id", "embedding", "label")
    intra, inter = F.when(F.col("label_a") == F.col("label_b"), F.col("mean_dist")), F.when(F.col("label_a") < F.col("label_b"), F.col("mean_dist"))
    return d.agg(r6(F.avg(intra)).alias("intra_mean"), r6(F.stddev_pop(intra)).alias("intra_std"), r6(F.avg(inter)).alias("inter_mean"),
                 r6(F.stddev_pop(inter)).alias("inter_std"), r6(F.avg(inter) / F.avg(intra)).alias("separation"))


# --- scores -------------------------------------------------------------------------

@query("J01", f"""
WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS label, {cosine('a.embedding', 'b.embedding')} AS d
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
m AS (SELECT id, own, label, avg(d) AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT id, own, max(CASE WHEN label = own THEN d END) AS a, min(CASE WHEN label <> own THEN d END) AS b FROM m GROUP BY 1, 2)
SELECT id, own AS label, {R('CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END', 's')} FROM s""")
def cosine_silhouette(t):
    return rounded(metrics.cosine_silhouette_rows(I.vectors(t), "vec_id", "embedding"), "s")


@query("J01", f"""
WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS label, {cosine('a.embedding', 'b.embedding')} AS d
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
m AS (SELECT id, own, label, avg(d) AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT id, own, max(CASE WHEN label = own THEN d END) AS a, min(CASE WHEN label <> own THEN d END) AS b FROM m GROUP BY 1, 2)
SELECT {R('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM s""")
def cosine_silhouette_mean(t):
    value = metrics.cosine_silhouette(I.vectors(t), "embedding")
    return t.spark.createDataFrame([(value,)], "silhouette double").select(r6("silhouette").alias("silhouette"))


@query("J04", f"""
WITH {I.SQL_METHODS}, v AS (SELECT vec_id, embedding, rule_c AS label FROM methods JOIN embeddings USING (vec_id) WHERE rule_c >= 0),
p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS label, {euclid('a.embedding', 'b.embedding')} AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
m AS (SELECT id, own, label, avg(d) AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT id, own, max(CASE WHEN label = own THEN d END) AS a, min(CASE WHEN label <> own THEN d END) AS b FROM m GROUP BY 1, 2)
SELECT {R('avg((b - a) / greatest(a, b))', 'silhouette')}, count(*) AS n FROM s""")
def euclidean_silhouette(t):
    rows = I.vectors(t).drop("label").join(I.methods(t).select("vec_id", F.col("rule_c").alias("label")), "vec_id")
    return rounded(metrics.euclidean_silhouette(rows, "vec_id", "embedding"), "silhouette")


SQL_CELLS = "c AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)"


@query("J02", f"""
WITH {SQL_CELLS}, g AS (SELECT i, avg(x) AS g FROM c GROUP BY i), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM c GROUP BY 1, 2),
b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (i)), w AS (SELECT sum((x - m) * (x - m)) AS w FROM c JOIN m USING (label, i)),
k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)
SELECT {R('b * (n - k) / (w * (k - 1))', 'calinski_harabasz')} FROM b, w, k""")
def calinski_harabasz(t):
    return rounded(metrics.calinski_harabasz(I.vectors(t), "embedding"), "calinski_harabasz")


@query("J03", f"""
WITH {SQL_CELLS}, m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2),
d AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM c JOIN m USING (label, i) GROUP BY 1, 2),
s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
r AS (SELECT la, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la)
SELECT {R('avg(r)', 'davies_bouldin')} FROM r""")
def davies_bouldin(t):
    return rounded(metrics.davies_bouldin(I.vectors(t), "embedding"), "davies_bouldin")


@query("J05 B10", f"""
WITH {I.SQL_METHODS}
SELECT count(*) AS n_points, count(*) FILTER (rule_c >= 0) AS valid_points, count(*) FILTER (rule_c < 0) AS n_noise,
  {R('count(*) FILTER (rule_c < 0) / count(*)', 'noise_ratio')}, count(DISTINCT CASE WHEN rule_c >= 0 THEN rule_c END) AS n_clusters FROM methods""")
def run_counts(t):
    return rounded(metrics.run_counts(I.methods(t), "rule_c"), "noise_ratio")


def sql_agreement(source: str, group: str = "") -> str:
    """ARI and NMI from a table x(a, b[, group])."""
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"
    cols = ", ".join(f"cell.{c.strip()}" for c in group.split(",")) + ", " if group else ""
    return f"""
x AS ({source}), cells AS (SELECT {g}a, b, count(*) AS n FROM x GROUP BY {g}a, b),
ra AS (SELECT {g}a, sum(n) AS n FROM cells GROUP BY {g}a), rb AS (SELECT {g}b, sum(n) AS n FROM cells GROUP BY {g}b),
cell AS (SELECT {g}CAST(sum(n) AS DOUBLE) AS n, sum(n * (n - 1) / 2.0) AS p, sum(n * ln(n)) AS e FROM cells {by}),
sa AS (SELECT {g}sum(n * (n - 1) / 2.0) AS pa, sum(n * ln(n)) AS ea, count(*) AS ka FROM ra {by}),
sb AS (SELECT {g}sum(n * (n - 1) / 2.0) AS pb, sum(n * ln(n)) AS eb, count(*) AS kb FROM rb {by}),
score AS (SELECT {cols}CAST(cell.n AS BIGINT) AS n, ka, kb, (p - pa * pb / (cell.n * (cell.n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (cell.n * (cell.n - 1) / 2)) AS ari,
  (ln(cell.n) + (e - ea - eb) / cell.n) / ((2 * ln(cell.n) - (ea + eb) / cell.n) / 2) AS nmi FROM cell JOIN sa {on} JOIN sb {on})"""


@query("J06 J07", f"""
WITH {I.SQL_METHODS}, {sql_agreement('SELECT rule_a AS a, rule_b AS b FROM methods')}
SELECT n, ka AS k_a, kb AS k_b, {R('ari', 'ari')}, {R('nmi', 'nmi')} FROM score""")
def label_agreement(t):
    return rounded(metrics.agreement(I.methods(t), "rule_a", "rule_b"), "ari", "nmi")


@query("J08 A14 C23", f"""
WITH {I.SQL_METHODS}, {sql_agreement('''SELECT 'rule_a' AS method_1, 'rule_b' AS method_2, rule_a AS a, rule_b AS b FROM methods
  UNION ALL SELECT 'rule_a', 'rule_c', rule_a, rule_c FROM methods WHERE rule_c >= 0
  UNION ALL SELECT 'rule_b', 'rule_c', rule_b, rule_c FROM methods WHERE rule_c >= 0''', 'method_1, method_2')}
SELECT method_1, method_2, round(ari, 3) AS ari, round(nmi, 3) AS nmi FROM score""")
def method_agreement(t):
    return stability.agreement_table(metrics.method_agreement(I.methods(t), ["rule_a", "rule_b", "rule_c"]))


@query("J09", f"""
WITH x AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, {R('(sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0))', 'auc')} FROM x""")
def roc_auc(t):
    rows = t.documents.join(t.labels, "doc_id")
    return rounded(metrics.roc_auc(rows, "quality", "n_chars"), "auc")


@query("J10", f"""
WITH f AS (SELECT label, embedding[1] > 0 AS p, (row_number() OVER (PARTITION BY label % 2 ORDER BY {sql_hash(42, 'vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings),
a AS (SELECT fold, avg(CASE WHEN label % 2 = CAST(p AS INTEGER) THEN 1.0 ELSE 0 END) AS acc FROM f GROUP BY fold)
SELECT {R('avg(acc)', 'cv_mean')}, {R('stddev_pop(acc)', 'cv_std')} FROM a""")
def fold_accuracy(t):
    rows = I.vectors(t).select("vec_id", (F.col("label") % 2).alias("y"), (F.element_at("embedding", 1) > 0).cast("int").alias("p"))
    return rounded(metrics.fold_scores(stratified_folds(rows, "y", ["vec_id"]), "y", "p"), "cv_mean", "cv_std")


@query("K07 Q12", f"""
WITH {I.SQL_METHODS}, n AS (SELECT rule_c AS pred, rule_b AS ref, count(*) AS n FROM methods GROUP BY 1, 2)
SELECT pred, ref, n FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY n DESC, ref) AS r FROM n) WHERE r = 1""")
def aligned_labels(t):
    return metrics.align_labels(I.methods(t), "rule_b", "rule_c")


# --- clustering ---------------------------------------------------------------------

def small_vectors(t) -> DataFrame:
    """Unit vectors on their first eight components, as the evaluator clusters them."""
    ready = I.vectors(t).withColumn("embedding", V.normalize(F.col("embedding")))
    return cut_lineage(reduce.pca(ready, "embedding", 8).rows.select("vec_id", "label", "reduced"))


def as_table(found: cluster.Found) -> DataFrame:
    return found.labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("I01 DM7")
def kmeans_sizes(t):
    return as_table(cluster.kmeans(small_vectors(t), "vec_id", "reduced", 4, n_init=3))


@query("I02")
def k_by_silhouette(t):
    rows = small_vectors(t)
    table = cluster.inertia_table(rows, "vec_id", "reduced", cluster.k_range(60), 1)
    return cluster.best_k(table)


@query("I03", f"""
WITH v AS (SELECT p_size AS k, sum(p_retailprice) / (p_size * p_size) AS inertia FROM part GROUP BY p_size),
s AS (SELECT k, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS x, (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM v)
SELECT arg_max(k, (1 - y - x, -k)) AS knee FROM s""")
def k_by_knee(t):
    v = t.part.groupBy(F.col("p_size").alias("k")).agg((F.sum("p_retailprice") / F.pow("p_size", F.lit(2))).alias("inertia"))
    return cluster.knee(v)


SQL_COS_PAIRS = f"p AS (SELECT a.vec_id AS id, b.vec_id AS other, {cosine('a.embedding', 'b.embedding')} AS d FROM embeddings a, embeddings b)"


@query("I04", f"""
WITH {SQL_COS_PAIRS}
SELECT id, count(*) FILTER (d <= 0.6 OR id = other) AS n, count(*) FILTER (d <= 0.6 OR id = other) >= 5 AS core FROM p GROUP BY id""")
def dbscan_core_rows(t):
    return cluster.core_rows(I.vectors(t), "vec_id", "embedding", 0.6, 5)


@query("I04", f"""
WITH RECURSIVE {SQL_COS_PAIRS}, near AS (SELECT id, other FROM p WHERE d <= 0.6 OR id = other),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5),
edge AS (SELECT id, other FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT root, edge.other FROM reach JOIN edge ON reach.id = edge.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
member AS (SELECT id, root FROM comp UNION ALL SELECT n.id, min(c.root) FROM near n JOIN comp c ON n.other = c.id WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id),
numbered AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM comp))
SELECT e.vec_id AS id, CAST(coalesce(numbered.label, -1) AS INTEGER) AS label FROM embeddings e LEFT JOIN member m ON e.vec_id = m.id LEFT JOIN numbered USING (root)""")
def dbscan_labels(t):
    return cluster.dbscan(I.vectors(t), "vec_id", "embedding", 0.6, 5).labels


@query("I05", f"""
WITH {SQL_COS_PAIRS}, r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM p WHERE id <> other)
SELECT {R('quantile_cont(d, 0.9)', 'eps')} FROM r WHERE rank = 4""")
def dbscan_eps(t):
    return rounded(cluster.estimate_eps(I.vectors(t), "vec_id", "embedding", 5), "eps")


@query("I06")
def density_sizes(t):
    return as_table(cluster.density_tree(small_vectors(t), "vec_id", "reduced", 5, 5))


def planted_vectors(t) -> DataFrame:
    """Vectors moved far apart by their label, so every clustering has to find the labels."""
    moved = F.transform(V.as_double(F.col("embedding")), lambda x, i: x + F.when(i == F.col("label"), 20.0).otherwise(0.0))
    return I.vectors(t).select("vec_id", "label", moved.alias("embedding"))


SQL_PLANTED = "SELECT CAST(row_number() OVER (ORDER BY min(vec_id)) - 1 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY embeddings.label"


@query("I01 I10", SQL_PLANTED)
def kmeans_planted(t):
    rows = cut_lineage(planted_vectors(t))
    found = cluster.cluster(rows, "vec_id", "embedding", "kmeans", rows.select("label").distinct().count())
    return linkage.numbered(found.labels, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("I06", SQL_PLANTED)
def density_planted(t):
    return as_table(cluster.density_tree(planted_vectors(t), "vec_id", "embedding", 5, 5))


@query("I08", f"SELECT method, label, n FROM ({SQL_PLANTED}), (SELECT unnest(['ward', 'complete', 'average']) AS method)")
def linkage_planted(t):
    rows = cut_lineage(planted_vectors(t))
    k = rows.select("label").distinct().count()
    parts = [as_table(cluster.hierarchical(rows, "vec_id", "embedding", k, m)).withColumn("method", F.lit(m)) for m in ("ward", "complete", "average")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("I07")
def spectral_sizes(t):
    return as_table(cluster.spectral(small_vectors(t), "vec_id", "reduced", 4))


@query("I07", SQL_PLANTED)
def spectral_planted(t):
    rows = cut_lineage(planted_vectors(t))
    return as_table(cluster.spectral(rows, "vec_id", "embedding", rows.select("label").distinct().count()))


@query("I07 D13", f"""
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, {euclid('a.embedding', 'b.embedding')} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM p) WHERE rank <= 10)
SELECT least(id, other) AS src, greatest(id, other) AS dst, count(*) / 2 AS weight FROM r GROUP BY 1, 2""")
def neighbour_affinity(t):
    return cluster.knn_affinity(I.vectors(t), "vec_id", "embedding", 10)


@query("I08")
def hierarchical_sizes(t):
    rows = small_vectors(t)
    parts = [as_table(cluster.hierarchical(rows, "vec_id", "reduced", 4, m)).withColumn("method", F.lit(m))
             for m in ("ward", "complete", "average")]
    parts.append(as_table(cluster.bisecting(rows, "vec_id", "reduced", 4)).withColumn("method", F.lit("bisecting")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("I09")
def mixture_sizes(t):
    return as_table(cluster.gaussian_mixture(small_vectors(t), "vec_id", "reduced", 3))


@query("I10 I11 I12 I13 U03 U05 F01 A11")
def report_leaderboard(t):
    """Reports to ranked clusterings: flatten, embed sections, normalise, reduce, cluster, rank."""
    docs = I.template_documents(t)
    vecs = [I.embed(c) for c in [F.col(f"text_{s}") for s in I.SECTIONS]]
    rows = documents.section_texts(docs, "features", I.SECTIONS).select(
        "doc_id", V.concat_sections(vecs, I.DIM).alias("embedding"))
    configs = [("kmeans", {"k": 2, "n_init": 2}), ("kmeans", {"k": 4, "n_init": 2}), ("hierarchical", {"k": 4}), ("gmm", {"k": 2})]
    board, _, _ = cluster.report_clusters(cut_lineage(rows), "doc_id", "embedding", 8, configs, intermediate=32)
    nums = ["silhouette", "calinski_harabasz", "davies_bouldin", "noise_ratio"]
    return rounded(board.select("rank", "config_key", "algorithm", "n_clusters", *nums), *nums)


@query("I14 A14")
def method_comparison(t):
    return stability.method_table(cluster.compare_methods(small_vectors(t), "vec_id", "reduced", ["kmeans", "gmm", "hierarchical"], 4))


# --- stability ----------------------------------------------------------------------

N_ITER = 6


def drawn_labels(t) -> DataFrame:
    """(iter, id, label): subsamples labelled by a rule that shifts with the iteration."""
    v = I.vectors(t)
    out = None
    for i in range(N_ITER):
        part = subsample(v, 0.8, ["vec_id"], 100 + i).select(
            F.lit(i).alias("iter"), F.col("vec_id").alias("id"),
            (F.element_at("embedding", i + 1) > 0).cast("int").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def reference_labels(t) -> DataFrame:
    return I.vectors(t).select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("label"))


SQL_DRAWN = "drawn AS (" + " UNION ALL ".join(
    f"SELECT {i} AS iter, vec_id AS id, CAST(embedding[{i + 1}] > 0 AS INTEGER) AS label FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash(100 + i, 'vec_id')}, vec_id) AS rn, "
    "count(*) OVER () AS n FROM embeddings) WHERE rn <= floor(n * CAST(0.8 AS DOUBLE))" for i in range(N_ITER)) + \
    "), ref AS (SELECT vec_id AS id, label % 2 AS ref FROM embeddings)"
SQL_CONSENSUS = f"""{SQL_DRAWN}, pair AS (SELECT a.id AS i, b.id AS j, count(*) AS n_both, count(*) FILTER (a.label = b.label) AS n_same
  FROM drawn a JOIN drawn b ON a.iter = b.iter AND a.id < b.id GROUP BY 1, 2),
full_pair AS (SELECT pair.*, x.ref = y.ref AS same_ref FROM pair JOIN ref x ON x.id = i JOIN ref y ON y.id = j)"""


@query("K02 DM9", f"""
WITH {SQL_CONSENSUS}
SELECT same_ref, CAST(n_both AS INTEGER) AS n_both, CAST(n_same AS INTEGER) AS n_same, count(*) AS pairs FROM full_pair GROUP BY 1, 2, 3""")
def consensus_counts(t):
    arrays = stability.label_arrays(drawn_labels(t), reference_labels(t), N_ITER)
    return stability.consensus_counts(arrays)


@query("K03 K04", f"""
WITH {SQL_CONSENSUS}, c AS (SELECT *, n_same / n_both AS c FROM full_pair)
SELECT {R('avg(CASE WHEN c > 0.1 AND c < 0.9 THEN 1.0 ELSE 0 END)', 'pac')}, {R('avg(c) FILTER (same_ref)', 'within')},
  {R('avg(c) FILTER (NOT same_ref)', 'between')}, count(*) AS pairs FROM c""")
def consensus_summary(t):
    arrays = stability.label_arrays(drawn_labels(t), reference_labels(t), N_ITER)
    return rounded(stability.consensus_summary(stability.consensus_counts(arrays)), "pac", "within", "between")


@query("K02 K08", f"""
WITH {SQL_CONSENSUS}, both_ways AS (SELECT i, j, n_same / n_both AS c FROM pair UNION ALL SELECT j, i, n_same / n_both FROM pair)
SELECT i AS id, x.ref AS ref, y.ref AS label, {R('avg(c)', 'consensus')}, count(*) AS n FROM both_ways JOIN ref x ON x.id = i JOIN ref y ON y.id = j GROUP BY 1, 2, 3""")
def consensus_to_labels(t):
    arrays = stability.label_arrays(drawn_labels(t), reference_labels(t), N_ITER)
    return rounded(stability.consensus_to_labels(arrays), "consensus")


@query("K08", f"""
SELECT vec_id AS id, label, row_number() OVER (ORDER BY label, {sql_hash(42, 'vec_id')}, vec_id) AS position FROM embeddings""")
def matrix_order(t):
    rows = I.vectors(t).select(F.col("vec_id").alias("id"), "label")
    return stability.matrix_order(rows)[0]


@query("K01 J06 J07", f"""
WITH {SQL_DRAWN}, {sql_agreement('SELECT iter, ref AS a, label AS b FROM drawn JOIN ref USING (id)', 'iter')}
SELECT iter, {R('ari', 'ari')}, {R('nmi', 'nmi')} FROM score""")
def iteration_agreement(t):
    ref = reference_labels(t)
    return rounded(stability.iteration_agreement(drawn_labels(t), ref), "ari", "nmi")


SUBSAMPLES, NOISE_ROUNDS = 200, 100


@query("K01 K05 A14 F16")
def stability_table(t):
    """Consensus and noise stability of a k-means clustering."""
    v = I.vectors(t)
    ref = cut_lineage(cluster.kmeans(v, "vec_id", "embedding", 3).labels)
    sub = cut_lineage(stability.subsample_labels(v, "vec_id", "embedding", "kmeans", 3, SUBSAMPLES, 0.8, 32, 8))
    noisy = cut_lineage(stability.noise_labels(v, "vec_id", "embedding", "kmeans", 3, NOISE_ROUNDS, 0.01, 32, 8))
    counts = stability.consensus_counts(stability.label_arrays(sub, ref, SUBSAMPLES))
    return stability.robustness_table(stability.iteration_agreement(sub, ref), stability.consensus_summary(counts),
                                      stability.iteration_agreement(noisy, ref), 0.8, 0.01)


@query("K06")
def bootstrap_mixture(t):
    ref, boots = stability.bootstrap_labels(I.vectors(t), "vec_id", "embedding", 2, 3, 0.8, 8)
    return rounded(stability.iteration_agreement(boots, ref), "ari", "nmi")
