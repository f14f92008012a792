"""Column functions on report texts, ids, feature names and labels.

All of them are plain Column expressions, so they stay inside one projection.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


# --- report texts -----------------------------------------------------------

def is_usable(text: Column, min_chars: int = fixed.MIN_REPORT_CHARS) -> Column:
    """Non-blank and long enough after trimming; null counts as blank."""
    return F.coalesce(F.length(F.trim(text)) >= min_chars, F.lit(False))


def preview(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def prompt(text: Column, role: str, output_format: Mapping, rules: Sequence[Mapping],
           heads: Sequence[str] = ("Report:", "Answer with JSON in this form only:", "Rules:")) -> Column:
    """Role, report text, wanted JSON form and the numbered rules."""
    numbered = "".join(f"    {i}. {r['title']}:\n       - {r['description']}\n" for i, r in enumerate(rules, 1))
    form = json.dumps(output_format, indent=4)
    return F.concat(
        F.lit(f"{role}\n\n{heads[0]}\n"), text,
        F.lit(f"\n\n{heads[1]}\n\n{form}\n\n{heads[2]}\n\n{numbered}"),
    )


def recover_json(text: Column) -> Column:
    """The text itself if it is JSON, else the longest nested object in it, else the widest braces."""
    nested = F.regexp_extract_all(text, F.lit(f"({fixed.NESTED_JSON})"), F.lit(1))
    longest = F.reduce(nested, F.lit(""), lambda best, m: F.when(F.length(m) > F.length(best), m).otherwise(best))
    widest = F.regexp_extract(text, fixed.ANY_JSON, 0)
    found = F.when(F.size(nested) > 0, longest).otherwise(widest)
    return F.coalesce(_if_object(text), _if_object(found))


def _if_object(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), text)


def missing_keys(doc: Column, required: Sequence[str] = tuple(fixed.REQUIRED_SECTIONS)) -> Column:
    """Required keys an extracted document lacks."""
    have = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, required)), have)


# --- ids --------------------------------------------------------------------

def file_base(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def ids_of_file(name: Column, prefix: str = fixed.FILE_PREFIX) -> Column:
    """struct(ph_id, bio_id) from a file name; missing parts are empty."""
    parts = F.split(F.replace(file_base(name), F.lit(prefix), F.lit("")), "_")
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("ph_id"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("bio_id"),
    )


def doc_name(ph_id: Column, bio_id: Column, prefix: str = fixed.FILE_PREFIX) -> Column:
    return F.format_string(f"{prefix}%s_%s", text_id(ph_id), text_id(bio_id))


def text_id(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


# --- cleaning ---------------------------------------------------------------

def na_if_blank(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), "NA").otherwise(value)


NUMBER_TYPES = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]


def grade_score(key: Column, value: Column, kind: Column) -> Column:
    """Numbers and booleans become key+integer; integer-like text too; other text stays."""
    number = F.when(kind == "BOOLEAN", F.when(F.lower(value) == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint")) \
        .when(kind.isin(NUMBER_TYPES), value.try_cast("double").cast("bigint"))
    as_int = F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("bigint"))
    begins = value.rlike(f"^[{''.join(fixed.SCORE_KEYS)}]")
    return (
        F.when(number.isNotNull(), F.concat(key, number.cast("string")))
        .when((kind == "STRING") & ~value.isin("", "NA") & ~begins & as_int.isNotNull(),
              F.concat(key, as_int.cast("string")))
        .otherwise(value)
    )


def is_grade(key: Column, value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Z][0-9]+$") & value.startswith(key), F.lit(False))


# --- feature names ----------------------------------------------------------

def match_name(name: Column) -> Column:
    """Strip a rare-category suffix, collapse runs of _, trim _."""
    out = F.regexp_replace(F.trim(name), fixed.RARE_SUFFIX, "")
    return F.btrim(F.regexp_replace(out, "__+", "_"), F.lit("_"))


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(match_name(name)), r"\s+", "_")


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def display_name(name: Column) -> Column:
    out = name
    for old, new in fixed.ABBREVIATIONS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return _squeeze(out)


def _by_prefix(name: Column, rules: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for prefix in sorted(rules, key=len):      # the longest prefix is tested first
        out = F.when(name.startswith(prefix), rules[prefix]).otherwise(out)
    return out


def section_of(name: Column) -> Column:
    return _by_prefix(name, {s + "_": s for s in fixed.FEATURE_SECTIONS}, "other")


def main_group(name: Column) -> Column:
    return _by_prefix(name, fixed.MAIN_GROUPS, fixed.OTHER_GROUP)


def subgroup(name: Column) -> Column:
    return _by_prefix(name, fixed.SUBGROUPS, fixed.OTHER_GROUP)


def _rank_in(value: Column, order: Sequence[str]) -> Column:
    out = F.lit(fixed.RANK_MISSING)
    for i, item in enumerate(order):
        out = F.when(value == item, i).otherwise(out)
    return out


def main_group_rank(group: Column) -> Column:
    return _rank_in(group, [*fixed.MAIN_GROUPS.values(), fixed.OTHER_GROUP])


def subgroup_rank(group: Column) -> Column:
    return _rank_in(group, [*fixed.SUBGROUPS.values(), fixed.OTHER_GROUP])


def core_name(name: Column) -> Column:
    """The descriptor that is left once the hierarchy prefix is gone."""
    prefixes = sorted({*fixed.SUBGROUPS, *fixed.MAIN_GROUPS}, key=lambda p: (-len(p), p))
    out = F.regexp_replace(name, f"^(?:{'|'.join(prefixes)})", "")
    return _squeeze(F.replace(F.replace(out, F.lit("_features_"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def panel_label(name: Column, sep: str = "\n") -> Column:
    return F.concat_ws(sep, subgroup(name), core_name(name))


def level_of(encoded: Column, raw: Column) -> Column:
    """Category level inside an encoded column name."""
    at = F.instr(encoded, "cat__")
    tail = F.when(at > 0, F.substr(encoded, at + 5)).otherwise(encoded)
    head = F.concat(raw, F.lit("_"))
    return F.when(F.startswith(tail, head), F.substr(tail, F.length(head) + 1)).otherwise(tail)


def raw_of_encoded(encoded: Column) -> Column:
    """Raw feature behind an encoded name when no encoder metadata is at hand."""
    tail = match_name(F.substr(encoded, F.lit(6)))
    parts = F.split(tail, "_")
    stem = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_")).otherwise(tail)
    return (
        F.when(encoded.startswith("num__"), F.substr(encoded, F.lit(6)))
        .when(encoded.startswith("cat__"), stem)
        .otherwise(match_name(encoded))
    )


def block_of(key: Column, tokens: int = 2) -> Column:
    return F.array_join(F.slice(F.split(key, "_"), 1, tokens), "_")


# --- labels and small numeric rules ------------------------------------------

def lookup(value: Column, names: Mapping[str, str]) -> Column:
    """Pretty name from a fixed dictionary, the value itself if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)


def method_name(method: Column) -> Column:
    return F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in fixed.METHOD_NAMES.items() for x in kv]), F.lower(method)), method)


def row_label(name: Column) -> Column:
    return lookup(name, fixed.ROW_LABELS)


def param_text(params: Column) -> Column:
    """k=v pairs of a map in their stored order."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")


def param_id(algorithm: Column, params: Column, eps_digits: int = 3) -> Column:
    get = lambda k, d="0": F.coalesce(F.try_element_at(params, F.lit(k)), F.lit(d))
    eps = F.format_string(f"eps=%.{eps_digits}f", get("eps").cast("double"))
    return (
        F.when(algorithm == "DBSCAN", eps)
        .when(algorithm == "HDBSCAN", F.concat(F.lit("min_cluster_size="), get("min_cluster_size")))
        .when(algorithm.isin("KMeans", "Spectral"), F.concat(F.lit("k="), get("n_clusters")))
        .when(algorithm == "Hierarchical", F.concat(get("method", ""), F.lit("_k="), get("n_clusters")))
        .otherwise("")
    )


def fix_unit(value: Column, limit: float = 100, factor: float = 1000) -> Column:
    return F.when(value > limit, value / factor).otherwise(value)


def risk(value: Column, cut: float = 0.5) -> Column:
    return F.when(value >= cut, "Yes").when(value < cut, "No")


def recode(value: Column, levels: Mapping[str, str]) -> Column:
    """Level to label; unknown levels become null."""
    pairs = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.try_element_at(pairs, value.cast("string"))


def level_order(value: Column, levels: Sequence[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, item in enumerate(levels):
        out = F.when(value == item, i).otherwise(out)
    return out


def any_flag(*flags: Column) -> Column:
    """Sum of the flags above zero; null if any flag is null."""
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total > 0


def group_label(*parts: Column, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *parts)


def binarise(score: Column) -> Column:
    return F.when(score >= 1, 1).when(score.isNotNull(), 0)


def cap(score: Column, top: int = 2) -> Column:
    return F.when(score >= top, top).otherwise(score)


def p_stars(p: Column) -> Column:
    return (
        F.when(p.isNull() | F.isnan(p), "").when(p < 0.0001, "****").when(p < 0.001, "***")
        .when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def p_text(p: Column) -> Column:
    return (
        F.when(p.isNull() | F.isnan(p), "NA").when(p < 0.0001, "< 0.0001").when(p < 0.001, "< 0.001")
        .otherwise(F.format_string("%.3f", p))
    )


def percent_text(pct: Column) -> Column:
    return F.when(pct > 5, F.format_string("%.0f%%", pct)).otherwise(F.format_string("%.1f%%", pct))


def quality_band(silhouette: Column) -> Column:
    return F.when(silhouette >= 0.7, "good").when(silhouette >= 0.5, "fair").otherwise("poor")


def noise_band(ratio: Column) -> Column:
    return F.when(ratio > 0.3, "high").when(ratio > 0.1, "medium").otherwise("low")


def run_scores(silhouette: Column, ch: Column, db: Column, noise: Column) -> dict[str, Column]:
    """Metrics on a 0-1 scale where higher is better, for comparing runs."""
    return {
        "silhouette_01": (silhouette + 1) / 2,
        "ch_01": F.least(ch / 5000, F.lit(1.0)),
        "db_01": 1 - F.least(db / 2, F.lit(1.0)),
        "noise_01": 1 - noise,
    }


def best_scores(silhouette: Column, ch: Column, db: Column) -> dict[str, Column]:
    """The same for the best run alone, with its own scales and clipping."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return {
        "silhouette_01": clip((silhouette + 1) / 2),
        "ch_01": clip(F.when(ch > 0, F.least(ch / 1000, F.lit(1.0))).otherwise(0.0)),
        "db_01": clip(F.when(-db > -2, (2 - db) / 4).otherwise(0.0)),
    }
