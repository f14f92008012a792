"""Why a report is in its class: axis, prototypes, edits, trajectories, attribution."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import vectors as V
from ..session import constant, cut_lineage
from . import attribution, metrics, models, tables
from .documents import explode_features, features_text, section_text
from .ranking import hash_key, shuffled_rank, stratified_folds, stratified_split

Embed = Callable[[Column], Column]      # text column -> array<float> column


# --- cases, axis, prototypes ----------------------------------------------------

def embed_sections(df: DataFrame, features: str, sections: Sequence[str], embed: Embed, out: str = "vecs") -> DataFrame:
    """Array of section vectors in section order."""
    return df.withColumn(out, F.array(*[embed(section_text(F.col(features), s)) for s in sections]))


def class_axis(df: DataFrame, vec: str, label: str, class_a: int = 0, class_b: int = 1) -> DataFrame:
    """One row: unit difference of the unit class means, from class a to class b."""
    mean = metrics.centroids(df.where(F.col(label).isin(class_a, class_b)), vec, label)
    pick = lambda c: F.first(F.when(F.col(label) == c, F.col("mean")), ignorenulls=True)
    two = mean.agg(pick(class_a).alias("a"), pick(class_b).alias("b"))
    return two.select(V.unit(V.subtract(V.unit(F.col("b")), V.unit(F.col("a")))).alias("axis"))


def prototypes(df: DataFrame, label: str, order: str, features: str = "features") -> DataFrame:
    """(label, section, key, value, n, ordinal): the most common value, the first seen among equals.

    ordinal is the place where the key first turns up in its class.
    """
    long = explode_features(df, label, order, features=features).where("value is not null and value <> ''")
    counts = long.groupBy(label, "section", "key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(order).alias("doc"), "ordinal")).alias("first"))
    best = counts.groupBy(label, "section", "key").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("value"))).alias("m"), F.min("first").alias("seen"))
    w = Window.partitionBy(label).orderBy("seen")
    return best.select(label, "section", "key", F.col("m.value").alias("value"), (-F.col("m.n")).alias("n"), "seen") \
        .withColumn("ordinal", F.row_number().over(w)).drop("seen")


def position_parts(df: DataFrame, vecs: str, axis: DataFrame, sections: Sequence[str], dim: int) -> DataFrame:
    """Adds the axis product and squared length of every section vector."""
    rows = df.withColumn("_axis", constant(axis))
    return rows.withColumns({
        "dots": F.array(*[V.dot(F.col(vecs)[i], V.section_slice(F.col("_axis"), i, dim)) for i in range(len(sections))]),
        "squares": F.array(*[V.dot(F.col(vecs)[i], F.col(vecs)[i]) for i in range(len(sections))]),
    }).drop("_axis")


def _position(dots: Column, squares: Column, eps: float = 1e-12) -> Column:
    return dots / (F.sqrt(squares) + eps)


def _shift(edits: DataFrame, embed: Embed, axis: DataFrame, sections: Sequence[str], dim: int) -> DataFrame:
    """delta_proj of an edit: one section vector is replaced, the others stay."""
    rows = edits.withColumn("_axis", constant(axis)).withColumn("_new", embed(F.col("new_text"))) \
        .withColumn("_i", F.array_position(F.array(*map(F.lit, sections)), F.col("section")).cast("int"))
    part = F.slice("_axis", (F.col("_i") - 1) * dim + 1, dim)
    dot, sq = V.total(F.col("dots")), V.total(F.col("squares"))
    new_dot = dot - F.element_at("dots", F.col("_i")) + V.dot(F.col("_new"), part)
    new_sq = sq - F.element_at("squares", F.col("_i")) + V.dot(F.col("_new"), F.col("_new"))
    delta = _position(new_dot, new_sq) - _position(dot, sq)
    return rows.withColumn("delta_proj", delta).drop("_axis", "_new", "_i", "dots", "squares", "new_text")


def support(label: Column, delta: Column, class_a: int = 0) -> Column:
    return F.when(label == class_a, -delta).otherwise(delta)


def full_key(e: Column) -> Column:
    return F.concat(e.section, F.lit("_"), e.key)


def _top_list(top: DataFrame, col: str = "feature") -> Column:
    """The top features as one array; their number is a parameter of the analysis."""
    return constant(top.agg(F.collect_set(col)))


def _opposite(protos: DataFrame, top: DataFrame, label: str, class_a: int, class_b: int) -> Column:
    """Map 'label:section_key' -> value of the other class, for the top features alone."""
    kept = protos.withColumn("feature", F.concat("section", F.lit("_"), "key")).join(top.select("feature"), "feature", "left_semi")
    other = F.when(F.col(label) == class_a, class_b).when(F.col(label) == class_b, class_a)
    entry = F.struct(F.concat(other.cast("string"), F.lit(":"), "feature"), F.col("value"))
    return constant(kept.where(other.isNotNull()).agg(F.map_from_entries(F.collect_list(entry)).alias("m")))


def delete_experiment(cases: DataFrame, top: DataFrame, axis: DataFrame, embed: Embed, sections: Sequence[str], dim: int,
                      doc: str = "source_file", label: str = "label", class_a: int = 0) -> DataFrame:
    """Drop one top feature of a case and see how far the case moves along the axis.

    cases has features and the position parts; each edit stays in the task of its case.
    """
    rows = cases.withColumn("_top", _top_list(top)).select(
        doc, label, "features", "dots", "squares", "_top", F.posexplode_outer("features").alias("_at", "e"))
    rows = rows.where(F.col("e").isNotNull() & F.array_contains("_top", full_key(F.col("e"))))
    left = F.filter("features", lambda e, i: (e.section == F.col("e.section")) & (i != F.col("_at")))
    edits = rows.select(doc, label, F.col("e.section").alias("section"), full_key(F.col("e")).alias("feature"),
                        F.left(F.coalesce("e.value", F.lit("")), F.lit(100)).alias("old_value"),
                        features_text(left).alias("new_text"), "dots", "squares")
    out = _shift(edits, embed, axis, sections, dim)
    return out.withColumn("support_score", support(F.col(label), F.col("delta_proj"), class_a))


def swap_experiment(cases: DataFrame, top: DataFrame, protos: DataFrame, axis: DataFrame, embed: Embed,
                    sections: Sequence[str], dim: int, doc: str = "source_file", label: str = "label",
                    class_a: int = 0, class_b: int = 1) -> DataFrame:
    """Set one top feature to the most common value of the other class."""
    rows = cases.where(F.col(label).isin(class_a, class_b)) \
        .withColumn("_protos", _opposite(protos, top, label, class_a, class_b)) \
        .select(doc, label, "features", "dots", "squares", "_protos", F.posexplode_outer("features").alias("_at", "e")) \
        .where("e is not null")
    new = F.try_element_at("_protos", F.concat(F.col(label).cast("string"), F.lit(":"), full_key(F.col("e"))))
    rows = rows.withColumn("_value", new).where("_value is not null and not (_value <=> e.value)")
    inside = F.filter("features", lambda e: e.section == F.col("e.section"))
    changed = F.transform(inside, lambda e: F.struct(e.key.alias("key"), F.when(
        e.key == F.col("e.key"), F.col("_value")).otherwise(e.value).alias("value")))
    edits = rows.select(doc, label, F.col("e.section").alias("section"), full_key(F.col("e")).alias("feature"),
                        F.col("e.value").alias("old_value"), F.col("_value").alias("new_value"),
                        features_text(changed).alias("new_text"), "dots", "squares")
    out = _shift(edits, embed, axis, sections, dim)
    return out.withColumn("support_score", support(F.col(label), F.col("delta_proj"), class_a))


def block_experiment(cases: DataFrame, top: DataFrame, protos: DataFrame, axis: DataFrame, embed: Embed,
                     sections: Sequence[str], dim: int, doc: str = "source_file", label: str = "label",
                     tokens: int = 2, class_a: int = 0, class_b: int = 1) -> DataFrame:
    """Set all top features of a block (keys with the same first tokens) to the other class at once."""
    value_of = lambda e: F.try_element_at("_protos", F.concat(
        F.col(label).cast("string"), F.lit(":"), full_key(e)))
    marked = cases.where(F.col(label).isin(class_a, class_b)) \
        .withColumn("_protos", _opposite(protos, top, label, class_a, class_b))
    marked = marked.withColumn("_f", F.transform("features", lambda e: F.struct(
        e.section.alias("section"), e.key.alias("key"), e.value.alias("value"),
        text.block_of(e.key, tokens).alias("block"), value_of(e).alias("new")))).drop("features", "_protos")
    differs = lambda e: e.new.isNotNull() & ~e.new.eqNullSafe(e.value)
    blocks = F.array_distinct(F.transform(F.filter("_f", differs), lambda e: F.struct(
        e.section.alias("section"), e.block.alias("block"))))
    rows = marked.withColumn("b", F.explode_outer(blocks)).where("b is not null")
    in_block = lambda e: (e.block == F.col("b.block")) & differs(e)
    inside = F.filter("_f", lambda e: e.section == F.col("b.section"))
    changed = F.transform(inside, lambda e: F.struct(e.key.alias("key"),
                                                     F.when(in_block(e), e.new).otherwise(e.value).alias("value")))
    edits = rows.select(doc, label, "b.section", "b.block", F.size(F.filter(inside, in_block)).alias("n_changed"),
                        features_text(changed).alias("new_text"), "dots", "squares")
    out = _shift(edits, embed, axis, sections, dim)
    return out.withColumn("support_score", support(F.col(label), F.col("delta_proj"), class_a))


def prototype_trajectory(protos: DataFrame, axis: DataFrame, embed: Embed, sections: Sequence[str], dim: int,
                         label: str = "label", tokens: int = 2, class_a: int = 0, class_b: int = 1) -> DataFrame:
    """(start, step, description, position): blocks of one prototype turn into the other's, section by section.

    The tables here are as wide as the template: one row per key and step, whatever the number of reports.
    """
    two = protos.where(F.col(label).isin(class_a, class_b) & F.col("section").isin(list(sections)))
    side = lambda c, tag: F.max(F.when(F.col(label) == c, F.struct("value", "ordinal"))).alias(tag)
    keys = two.groupBy("section", "key").agg(side(class_a, "a"), side(class_b, "b"))
    both = keys.select("section", "key", F.explode(F.array(
        F.struct(F.lit(class_a).alias("start"), F.col("a").alias("base"), F.col("b").alias("target")),
        F.struct(F.lit(class_b).alias("start"), F.col("b").alias("base"), F.col("a").alias("target")))).alias("s"),
    ).select("section", "key", "s.*")
    order = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    both = both.withColumns({"block": text.block_of(F.col("key"), tokens), "_s": order})
    first = both.groupBy("start", "_s", "section", "block").agg(F.min("key").alias("_first"))
    steps = first.withColumn("step", F.row_number().over(Window.partitionBy("start").orderBy("_s", "_first")))
    both = both.join(steps.select("start", "section", "block", "step"), ["start", "section", "block"])
    last = steps.groupBy("start").agg(F.max("step").alias("n"))
    at = both.join(last, "start").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n"))))
    turned = (F.col("step") <= F.col("at")) & F.col("target").isNotNull()
    value = F.when(turned, F.col("target.value")).otherwise(F.col("base.value"))
    place = F.struct(F.col("base").isNull().alias("late"), F.coalesce("base.ordinal", F.lit(0)).alias("o"),
                     F.when(F.col("base").isNull(), F.col("step")).otherwise(0).alias("st"), F.col("key").alias("k"))
    entries = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("key"), F.col("_v").alias("value"))))
    sec = at.withColumn("_v", value).where("_v is not null").groupBy("start", "at", "section").agg(entries.alias("e"))
    texts = sec.select("start", "at", "section", features_text(F.col("e")).alias("t"))
    wide = texts.groupBy("start", "at").agg(*[
        F.max(F.when(F.col("section") == s, F.col("t"))).alias(f"t{i}") for i, s in enumerate(sections)])
    vec = V.concat_sections([embed(F.coalesce(f"t{i}", F.lit(""))) for i in range(len(sections))], dim)
    wide = wide.withColumn("_vec", vec).withColumn("_axis", constant(axis))
    named = steps.select("start", F.col("step").alias("at"), F.concat("section", F.lit(":"), "block").alias("d"))
    return wide.withColumn("position", V.dot(V.unit(F.col("_vec")), F.col("_axis"))).join(named, ["start", "at"], "left").select(
        "start", F.col("at").alias("step"), F.coalesce("d", F.lit("baseline")).alias("description"), "position")


# --- attribution of sections and features -----------------------------------------

def _fold_scores(ready: DataFrame, fold: int, n: int) -> DataFrame:
    """(fold, label, s): held-out scores of a balanced logistic regression on all but one of the folds' n rows."""
    train = ready.where(F.col("fold") != fold)
    model = models.sendable(LogisticRegression(maxIter=100, regParam=1 / n, standardization=False, weightCol="weight").fit(train))
    held = model.transform(ready.where(F.col("fold") == fold))
    return held.select("fold", "label", F.element_at(vector_to_array("probability"), 2).alias("s"))


def section_attribution(df: DataFrame, id_col: str, vec: str, label: str, sections: Sequence[str], dim: int,
                        folds: int = 5, seed: int = 42, class_a: int = 0, class_b: int = 1) -> DataFrame:
    """Per section: AUC alone, AUC without it, the drop, and the distance of the class means."""
    two = df.where(F.col(label).isin(class_a, class_b)).select(
        F.col(id_col).alias("id"), F.col(vec).alias("vec"), (F.col(label) == class_b).cast("int").alias("label"))
    marked = cut_lineage(models.class_weights(stratified_folds(two, "label", ["id"], folds, seed), "label"))
    n, v = len(sections), F.col("vec")
    parts = {"full": v}
    for i, s in enumerate(sections):
        parts[f"only {s}"] = V.section_slice(v, i, dim)
        parts[f"without {s}"] = V.without_section(v, i, dim, n)
    sizes = {r["fold"]: r["n"] for r in marked.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, auc = sum(sizes.values()), {}
    for name, c in parts.items():            # one part after the other: its folds' scores are written before the next
        ready = marked.select("label", "fold", "weight", array_to_vector(V.as_double(c)).alias("features")).persist()
        scored = cut_lineage(fold(DataFrame.unionByName, [_fold_scores(ready, f, total - sizes[f]) for f in sorted(sizes)]))
        ready.unpersist()
        auc[name] = metrics.roc_auc(scored, "label", "s", "fold").agg(F.avg("auc")).first()[0]
    table = df.sparkSession.createDataFrame(
        [(s, auc[f"only {s}"], auc[f"without {s}"], auc["full"] - auc[f"without {s}"]) for s in sections],
        "section string, auc_section_only double, auc_leave_out double, auc_drop double")
    return table.join(section_distance(two, "vec", "label", sections, dim), "section").orderBy(F.desc("auc_drop"))


def section_distance(df: DataFrame, vec: str, label: str, sections: Sequence[str], dim: int,
                     class_a: int = 0, class_b: int = 1) -> DataFrame:
    """(section, centroid_distance) between the two class means."""
    mean = metrics.centroids(df.where(F.col(label).isin(class_a, class_b)), vec, label)
    pick = lambda c: F.first(F.when(F.col(label) == c, F.col("mean")), ignorenulls=True)
    diff = mean.agg(V.subtract(pick(class_b), pick(class_a)).alias("d"))
    per = F.array(*[F.struct(F.lit(s).alias("section"), V.norm2(V.section_slice(F.col("d"), i, dim)).alias("centroid_distance"))
                    for i, s in enumerate(sections)])
    return diff.select(F.explode(per).alias("e")).select("e.*")


class Surrogate:
    """A forest that learns the labels from flat features, and what it relies on."""

    def __init__(self, df: DataFrame, id_col: str, label: str, trees: int = 500, depth: int = 20, min_count: int = 5,
                 seed: int = 42, exclude: Sequence[str] = tuple(fixed.NON_FEATURES)):
        self.id_col, self.label, self.seed = id_col, label, seed
        self.numeric, self.categorical = tables.split_columns(df, label, [*exclude, id_col])
        self.features = [*self.numeric, *self.categorical]
        rows = tables.collapse_rare(df.where(F.col(label).isNotNull()), self.categorical, min_count)
        rows = models.prepared(rows, self.numeric, self.categorical).withColumn(label, F.col(label).cast("double"))
        split = stratified_split(rows, label, [id_col], 0.2, seed).persist()
        self.train, self.test = split.where(~F.col("is_test")), split.where("is_test")
        self.encoder = models.encoder(self.train, self.numeric, self.categorical)
        weighted = models.class_weights(self.encoder.transform(self.train), label)
        self.model = models.sendable(RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
                                                            weightCol="weight", seed=seed).fit(weighted))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds p, the probability of class 1."""
        out = self.model.transform(self.encoder.transform(rows))
        return out.withColumn("p", F.element_at(vector_to_array("probability"), 2))

    def auc(self) -> DataFrame:
        return metrics.roc_auc(self.predict(self.test), self.label, "p")

    def encoded_importance(self) -> DataFrame:
        """(encoded_feature, raw_feature, importance) from the forest itself."""
        values = self.model.featureImportances.toArray()
        rows = [(e, r, float(values[i])) for i, e, r in models.encoded_names(self.encoder, self.numeric, self.categorical)]
        return self.train.sparkSession.createDataFrame(rows, "encoded_feature string, raw_feature string, importance double")

    def attribution(self) -> DataFrame:
        """(encoded_feature, raw_feature, importance): mean absolute exact Shapley value over the held-out rows."""
        found = attribution.mean_absolute(self.encoder.transform(self.test), self.model)
        names = models.encoded_names(self.encoder, self.numeric, self.categorical)
        named = self.train.sparkSession.createDataFrame(names, "feature int, encoded_feature string, raw_feature string")
        return named.join(found, "feature").select("encoded_feature", "raw_feature", "importance")

    def shapley(self, draws: int = 8) -> DataFrame:
        """(raw_feature, importance): mean absolute sampled Shapley value (Strumbelj and Kononenko 2014).

        Each test row walks from another row to itself, one feature at a time in a hashed order.
        """
        test = self.test.select(F.col(self.id_col).cast("string").alias("id"), *self.features)
        ranked = shuffled_rank(test, ["id"], self.seed, (), "r")
        total = constant(test.agg(F.count(F.lit(1)).alias("n")))
        walks = ranked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        walks = walks.withColumn("partner", F.pmod(hash_key(self.seed, "draw", "id"), total) + 1)
        other = ranked.select(F.col("r").alias("partner"), F.struct(*self.features).alias("z"))
        keyed = F.array(*[F.struct(hash_key(self.seed + 1, "draw", "id", F.lit(f)).alias("h"), F.lit(f).alias("f"))
                          for f in self.features])
        walks = walks.join(other, "partner").withColumn("order", F.transform(F.array_sort(keyed), lambda e: e.f))
        steps = walks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(self.features)))))
        turned = F.try_element_at(F.concat(F.array(F.lit(None).cast("string")), "order"), F.col("at") + 1)
        mixed = steps.select("id", "draw", "at", turned.alias("raw_feature"),
                             *[F.when(F.array_position("order", f) <= F.col("at"), F.col(f)).otherwise(F.col(f"z.{f}")).alias(f)
                               for f in self.features])
        scored = self.predict(mixed).select("id", "draw", "at", "raw_feature", "p")
        w = Window.partitionBy("id", "draw").orderBy("at")
        gain = scored.withColumn("gain", F.col("p") - F.lag("p").over(w)).where("at > 0")
        phi = gain.groupBy("id", "raw_feature").agg(F.avg("gain").alias("phi"))
        return phi.groupBy("raw_feature").agg(F.avg(F.abs("phi")).alias("importance"))


def raw_importance(encoded: DataFrame) -> DataFrame:
    return encoded.groupBy(text.match_name(F.col("raw_feature")).alias("raw_feature")).agg(F.sum("importance").alias("importance"))


# --- joint evidence ---------------------------------------------------------------

def joint_evidence(importance: DataFrame, deleted: DataFrame, swapped: DataFrame) -> DataFrame:
    """Importance with delete and swap support, and the sum of their z-scores."""
    def part(df, tag):
        return tables.support_summary(df, "feature").select(
            "feature", F.col("mean_abs_support").alias(f"{tag}_abs"), F.col("neg_rate").alias(f"{tag}_neg_rate"))

    base = importance.select(F.col("raw_feature").alias("feature"), F.col("importance").alias("shap_importance"),
                             text.section_of(F.col("raw_feature")).alias("section"),
                             text.subgroup(F.col("raw_feature")).alias("subgroup"))
    both = base.join(part(deleted, "delete"), "feature", "left").join(part(swapped, "swap"), "feature", "left")
    both = both.na.fill(0.0, ["delete_abs", "delete_neg_rate", "swap_abs", "swap_neg_rate"])
    return both.withColumn("joint_score", tables.z_scores(both, ["shap_importance", "delete_abs", "swap_abs"])) \
        .withColumn("clean", text.display_name(F.col("feature")))


def top_joint(joint: DataFrame, k: int = 8) -> DataFrame:
    return joint.orderBy(F.desc("joint_score"), "feature").limit(k)


def concordance(joint: DataFrame, k: int = 8) -> DataFrame:
    """The three measures of the top features, each on a 0-1 scale."""
    return tables.min_max(top_joint(joint, k), ["shap_importance", "delete_abs", "swap_abs"]).select(
        "feature", "shap_importance", "delete_abs", "swap_abs")


def swapped_top(joint: DataFrame, swapped: DataFrame, k: int = 3) -> DataFrame:
    """First k features by joint score that were ever swapped; the swaps shrink to their features before the join."""
    return joint.join(swapped.select("feature").distinct(), "feature", "left_semi").orderBy(F.desc("joint_score"), "feature").limit(k)


def block_summary(blocks: DataFrame) -> DataFrame:
    out = tables.support_summary(blocks, "section", "block")
    return out.withColumn("section_block", F.concat_ws(" | ", "section", "block")).orderBy(F.desc("mean_abs_support"))


def hierarchy(importance: DataFrame, k: int = 12) -> DataFrame:
    """Top features with their groups and ranks for a grouped display."""
    top = importance.orderBy(F.desc("importance"), "raw_feature").limit(k)
    f = F.col("raw_feature")
    return top.select("raw_feature", text.main_group(f).alias("main_group"), text.subgroup(f).alias("subgroup"),
                      text.core_name(f).alias("core"), "importance") \
        .withColumn("subgroup_rank", text.subgroup_rank(F.col("subgroup"))).orderBy("subgroup_rank", "importance")


def dominant_groups(importance: DataFrame) -> DataFrame:
    """One row: the main group and the subgroup with the largest summed importance."""
    f = F.col("raw_feature")
    def top(col, name):
        s = importance.groupBy(col.alias("g")).agg(F.sum("importance").alias("s"))
        return s.agg(F.min_by("g", F.struct(-F.col("s"), F.col("g"))).alias(name)).scalar()

    return importance.sparkSession.range(1).select(top(text.main_group(f), "m").alias("dominant_main"),
                                                   top(text.subgroup(f), "s").alias("dominant_subgroup"))


def encoded_levels(encoded: DataFrame, raw_feature: str, k: int = 6) -> DataFrame:
    """Most important levels of one raw feature."""
    rows = encoded.where(F.col("raw_feature") == raw_feature)
    return rows.withColumn("level", text.level_of(F.col("encoded_feature"), F.col("raw_feature"))) \
        .orderBy(F.desc("importance"), "encoded_feature").limit(k)
