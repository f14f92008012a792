"""Nested JSON documents: flatten, map to a template, clean, build section texts.

A flattened document is one array column of struct(key, value, type) in document order, so
cleaning, texts and edits of a document never need a shuffle. Explode it for the long form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce as fold
from operator import and_, or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text

ENTRY = "array<struct<key:string,value:string,type:string>>"
BASE_LEVELS = 6             # levels of nested objects that the plan opens; rows nested deeper are walked on
PLAIN_CHARS = 1 << 14       # longer documents stay in the plan, so a batch sent to Python is bounded


def _kind(variant: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def children(doc: Column, parent: Column | None = None, sep: str = "_", lower: bool = True) -> Column:
    """Direct members of a JSON object as struct(key, value, type), in document order.

    Text and order come from a string map; a variant map is read for the types alone, since
    a variant sorts its keys.
    """
    texts = F.map_entries(F.from_json(doc, "map<string,string>"))
    kinds = F.map_entries(F.from_json(doc, "map<string,variant>"))

    def entry(e, v):
        key = F.lower(e.key) if lower else e.key
        name = key if parent is None else F.concat(parent, F.lit(sep), key)
        return F.struct(name.alias("key"), e.value.alias("value"), _kind(v.value).alias("type"))

    return F.coalesce(F.zip_with(texts, kinds, entry), F.array().cast(ENTRY))


def _first_is_object(value: Column) -> Column:
    return F.coalesce(_kind(F.try_element_at(F.from_json(value, "array<variant>"), F.lit(1))) == "OBJECT", F.lit(False))


def _list_members(e: Column, sep: str) -> Column:
    """Object members of a list, keyed by position; other members are dropped."""
    both = F.zip_with(F.from_json(e.value, "array<string>"), F.from_json(e.value, "array<variant>"),
                      lambda v, k: F.struct(v.alias("v"), _kind(k).alias("k")))
    numbered = F.transform(both, lambda m, i: F.struct(
        F.concat(e.key, F.lit(sep), i.cast("string")).alias("key"), m.v.alias("value"), m.k.alias("type")))
    return F.filter(numbered, lambda m: m.type == "OBJECT")


def _open(entries: Column, sep: str, lower: bool) -> Column:
    """Replace every object, and every list that starts with one, by its members; close plain lists.

    The array is named once only: each further mention would double the expression per level.
    """
    def opened(e):
        plain = F.struct(e.key.alias("key"), e.value.alias("value"), F.lit("LIST").alias("type"))
        return (F.when(e.type == "OBJECT", children(e.value, e.key, sep, lower))
                .when((e.type == "ARRAY") & _first_is_object(e.value), _list_members(e, sep))
                .when(e.type == "ARRAY", F.array(plain)).otherwise(F.array(e)))

    return F.flatten(F.transform(entries, opened))


def _open_nodes(entries: Column) -> Column:
    """Put the members of every object after it and mark it as opened; lists stay closed."""
    def opened(e):
        head = F.struct(e.key.alias("key"), e.value.alias("value"), F.lit("OPENED").alias("type"))
        return F.when(e.type == "OBJECT", F.concat(F.array(head), children(e.value, e.key, ".", False))) \
            .otherwise(F.array(e))

    return F.flatten(F.transform(entries, opened))


def _list_text(value: Column) -> Column:
    """Members of a plain list in lower case, joined by comma and blank."""
    def member(v):
        kind = _kind(v)
        as_text = F.try_variant_get(v, "$", "string")
        return (F.when(kind == "STRING", F.lower(as_text)).when(kind == "BOOLEAN", F.initcap(as_text))
                .when(kind == "VOID", "None").otherwise(as_text))

    return F.coalesce(F.array_join(F.transform(F.from_json(value, "array<variant>"), member), ", "), F.lit(""))


def _printed(e: Column) -> Column:
    value = (F.when(e.type == "STRING", F.lower(e.value)).when(e.type == "BOOLEAN", F.initcap(e.value))
             .when(e.type.isin("ARRAY", "LIST"), _list_text(e.value)).otherwise(e.value))
    return F.struct(e.key.alias("key"), value.alias("value"), e.type.alias("type"))


def _last_wins(entries: Column) -> Column:
    """Repeated keys keep their first place and their last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e.key))
    merged = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e.key == k), -1))
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(merged)


def _still_closed(entries: Column, flat: bool) -> Column:
    """Whether an object with members, or in flat form a list of objects, is still closed."""
    open_list = (lambda e: (e.type == "ARRAY") & _first_is_object(e.value)) if flat else (lambda e: F.lit(False))
    return F.exists(entries, lambda e: ((e.type == "OBJECT") & (e.value != "{}")) | open_list(e))


def _number(x: float) -> str:
    """A number as Spark prints it."""
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    digits, _, power = f"{x:.16e}".partition("e")
    digits, _, power = next((t for t in (f"{x:.{n}e}" for n in range(1, 18)) if float(t) == x), f"{digits}e{power}").partition("e")
    return f"{digits.rstrip('0') if not digits.rstrip('0').endswith('.') else digits.rstrip('0') + '0'}E{int(power)}"


def _member(key: str, value: object) -> tuple[str, str | None, str]:
    """(key, text, type) of a parsed value; objects and lists keep their JSON text."""
    if value is None:
        return key, None, "VOID"
    if isinstance(value, (dict, list)):
        return key, json.dumps(value, ensure_ascii=False, separators=(",", ":")), "OBJECT" if isinstance(value, dict) else "ARRAY"
    if isinstance(value, bool):
        return key, "true" if value else "false", "BOOLEAN"
    if isinstance(value, str):
        return key, value, "STRING"
    return (key, str(value), "BIGINT") if isinstance(value, int) else (key, _number(value), "DOUBLE")


def walk(entries: list[tuple[str, str | None, str]], flat: bool) -> list[tuple[str, str | None, str]]:
    """Opens all that is still closed in a row, however deep, by the rules of _open or _open_nodes."""
    out, todo = [], [(k, json.loads(v) if t in ("OBJECT", "ARRAY") else None, (k, v, t)) for k, v, t in reversed(entries)]
    while todo:
        key, value, entry = todo.pop()
        if isinstance(value, dict) and (value or not flat):
            if not flat:
                out.append((entry[0], entry[1], "OPENED"))
            inner = [(f"{key}_{k.lower()}" if flat else f"{key}.{k}", v) for k, v in value.items()]
        elif flat and isinstance(value, list) and value and isinstance(value[0], dict):
            inner = [(f"{key}_{i}", v) for i, v in enumerate(value) if isinstance(v, dict)]
        else:
            out.append((entry[0], entry[1], "LIST") if flat and isinstance(value, list) else entry)
            continue
        todo += [(k, v, _member(k, v)) for k, v in reversed(inner)]
    return out


def _opened(df: DataFrame, out: str, levels: int | None, flat: bool) -> DataFrame:
    """Opens the entries of out: some levels in the plan, which does not grow with the data, deeper rows by walk().

    With given levels, deeper documents end the query.
    """
    for _ in range((levels or BASE_LEVELS) - 1):
        df = df.withColumn(out, _open(F.col(out), "_", True) if flat else _open_nodes(F.col(out)))
    if levels:
        closed = F.exists(F.col(out), lambda e: (e.type == "OBJECT") & (F.size(children(e.value)) > 0))
        error = F.raise_error(F.lit(f"a document is nested deeper than {levels} levels")).cast(ENTRY)
        return df.withColumn(out, F.when(closed, error).otherwise(F.col(out)))

    def deep(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [dict(zip(("key", "value", "type"), e)) for e in walk([(e["key"], e["value"], e["type"]) for e in r], flat)])

    tool = F.pandas_udf(deep, ENTRY)
    df = df.withColumn("_deep", tool(F.when(_still_closed(F.col(out), flat), F.col(out))))
    return df.withColumn(out, F.coalesce("_deep", out)).drop("_deep")


class _NotPlain(ValueError):
    """A document that the plan has to read."""


def _pairs_once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise _NotPlain
    return found


def _short_int(digits: str) -> int:
    if len(digits) > 18 or digits == "-0":
        raise _NotPlain
    return int(digits)


def _plain_number(digits: str) -> float:
    """A fraction that every reader prints as it stands."""
    x = float(digits)
    if len(digits) > 14 or repr(x) != digits or not 1e-3 <= abs(x) < 1e7 or digits.endswith(".0"):
        raise _NotPlain
    return x


def _refused(_: str) -> None:
    raise _NotPlain


_READER = json.JSONDecoder(object_pairs_hook=_pairs_once, parse_int=_short_int, parse_float=_plain_number, parse_constant=_refused)
_TYPES = {str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID"}


def _plain_object(doc: str | None) -> dict | None:
    """The members of a document that has one reading only, else None.

    Its text is ASCII without \\u escapes, its names differ, its numbers have one spelling.
    """
    if doc is None or not doc.isascii() or "\\u" in doc:
        return None
    try:
        found = _READER.decode(doc)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _plain_list(members: list) -> str:
    """As _list_text, of a list that holds neither lists nor objects."""
    out = []
    for m in members:
        if type(m) not in (str, bool, int):
            raise _NotPlain
        out.append(m.lower() if isinstance(m, str) else str(m))
    return ", ".join(out)


def _plain_entries(members: dict, prefix: str, left: int, keys: list, values: list, types: list) -> None:
    """Appends the flat entries of an object, in document order; left is the number of levels that the plan opens."""
    for name, value in members.items():
        key, kind = prefix + name.lower(), type(value)
        if kind is dict:
            if value and not left:
                raise _NotPlain
            _plain_entries(value, key + "_", left - 1, keys, values, types)
            continue
        keys.append(key)
        if kind is list:
            values.append(_plain_list(value))
            types.append("LIST")
        else:
            values.append(value.lower() if kind is str else None if value is None else str(value))
            types.append(_TYPES[kind])


def _plain_nodes(members: dict, prefix: str, left: int, keys: list, values: list, types: list) -> None:
    """Appends all members by dotted path, objects before their members."""
    for name, value in members.items():
        key, kind = prefix + name, type(value)
        if kind is dict and not left:
            raise _NotPlain
        keys.append(key)
        if kind is dict or kind is list:
            values.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
            types.append("OPENED" if kind is dict else "ARRAY")
        if kind is dict:
            _plain_nodes(value, key + ".", left - 1, keys, values, types)
        elif kind is not list:
            values.append(value if kind is str else ("false", "true")[value] if kind is bool else None if value is None else str(value))
            types.append(_TYPES[kind])


def _read_plainly(doc: Column, flat: bool, order: Sequence[str] | None = None) -> Column:
    """The entries of plain documents in one reading, null for all others.

    With an order of keys, entries without a value are left out, and a document with its keys in another order is null.
    """
    place = None if order is None else {key: at for at, key in enumerate(order)}
    enter = _plain_entries if flat else _plain_nodes

    def read(docs: pa.Array) -> pa.Array:
        keys, values, types, ends, found = [], [], [], [0], []
        for doc in docs.to_pylist():
            members = _plain_object(doc)
            start = len(keys)
            try:
                if members is not None:
                    enter(members, "", BASE_LEVELS - 1, keys, values, types)
                    if flat and len(set(keys[start:])) < len(keys) - start:
                        raise _NotPlain
                    if place is not None:
                        held = [i for i in range(start, len(keys)) if values[i] is not None]
                        at = [place.get(keys[i], len(place)) for i in held]
                        if at != sorted(at):
                            raise _NotPlain
                        for column in (keys, values, types):
                            column[start:] = [column[i] for i in held]
            except _NotPlain:
                del keys[start:], values[start:], types[start:]
                members = None
            ends.append(len(keys))
            found.append(members is None)
        entries = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (keys, values, types)], ["key", "value", "type"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=pa.array(found, pa.bool_()))

    read.__annotations__ = {"docs": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, ENTRY)(F.when(F.length(doc) <= PLAIN_CHARS, doc))


def nodes(df: DataFrame, doc: str, out: str, levels: int | None = None) -> DataFrame:
    """All members by dotted path, depth first, objects (type OPENED) before their members.

    Plain documents are read once in a task, all others opened level by level in the plan, with the same entries.
    """
    if levels:
        return _opened(df.withColumn(out, children(F.col(doc), None, ".", False)), out, levels, False)
    df = df.withColumn("_plain", _read_plainly(F.col(doc), False))
    rest = F.when(F.col("_plain").isNull(), F.col(doc))
    df = _opened(df.withColumn(out, children(rest, None, ".", False)), out, levels, False)
    return df.withColumn(out, F.coalesce("_plain", out)).drop("_plain")


def _finished(df: DataFrame, out: str, levels: int | None) -> DataFrame:
    """The entries of out opened, without empty objects, and printed."""
    df = _opened(df, out, levels, True)
    df = df.withColumn(out, F.filter(F.col(out), lambda e: e.type != "OBJECT"))
    return df.withColumn(out, _last_wins(F.transform(F.col(out), _printed)))


def flatten(df: DataFrame, doc: str, out: str = "features", levels: int | None = None) -> DataFrame:
    """One array column of (key, value, type): keys joined by _ and values in lower case.

    Empty objects vanish, lists become comma-joined text, a later duplicate key wins. Documents may be
    nested as deep as they like, in tables and in streams; beyond given levels they end the query. Plain
    documents are read once in a task, all others opened level by level in the plan, with the same entries.
    """
    if levels:
        return _finished(df.withColumn(out, children(F.col(doc))), out, levels)
    df = df.withColumn("_plain", _read_plainly(F.col(doc), True))
    df = _finished(df.withColumn(out, children(F.when(F.col("_plain").isNull(), F.col(doc)))), out, levels)
    return df.withColumn(out, F.coalesce("_plain", out)).drop("_plain")


def explode_features(df: DataFrame, *ids: str, features: str = "features") -> DataFrame:
    """Long form (ids, ordinal, key, value, type).

    The outer form keeps Spark from inferring a size filter, which would flatten each document twice.
    """
    rows = df.select(*ids, F.posexplode_outer(features).alias("ordinal", "e"))
    return rows.where(F.col("e").isNotNull()).select(*ids, "ordinal", "e.*")


def _of_section(features: Column, section: str) -> Column:
    prefix = F.lit(section.lower() + "_")
    start = F.lit(len(section) + 2)
    inside = F.filter(features, lambda e: F.startswith(e.key, prefix))
    return F.transform(inside, lambda e: F.struct(
        F.lit(section).alias("section"), F.substr(e.key, start).alias("key"),
        e.value.alias("value"), e.type.alias("type")))


def with_section(features: Column, sections: Sequence[str]) -> Column:
    """Keep features of the named sections as struct(section, key, value, type)."""
    return F.concat(*[_of_section(features, s) for s in sections])


def features_text(entries: Column) -> Column:
    """'key: value; key: value' without null and empty values."""
    kept = F.filter(entries, lambda e: e.value.isNotNull() & (e.value != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(e.key, F.lit(": "), e.value)), "; ")


def section_text(features: Column, section: str) -> Column:
    """Text of one section from the with_section array."""
    return features_text(F.filter(features, lambda e: e.section == section))


def section_texts(df: DataFrame, features: str, sections: Sequence[str]) -> DataFrame:
    return df.withColumns({f"text_{s}": section_text(F.col(features), s) for s in sections})


def feature_universe(df: DataFrame, features: str = "features") -> DataFrame:
    """Distinct (section, key) pairs; the map side shrinks them before the shuffle."""
    return explode_features(df, features=features).select("section", "key").distinct()


# --- templates --------------------------------------------------------------

def template_paths(template: Mapping, prefix: str = "") -> list[tuple[str, object]]:
    """(path, default) of every leaf, in template order."""
    out = []
    for key, value in template.items():
        path = f"{prefix}.{key}" if prefix else key
        out += template_paths(value, path) if isinstance(value, Mapping) else [(path, value)]
    return out


def drop_key(template: Mapping, key: str = fixed.REMOVED_KEY) -> dict:
    return {k: drop_key(v, key) if isinstance(v, Mapping) else v for k, v in template.items() if k != key}


def template_schema(template: Mapping) -> T.StructType:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), list: T.ArrayType(T.StringType())}
    return T.StructType([
        T.StructField(k, template_schema(v) if isinstance(v, Mapping) else kinds.get(type(v), T.StringType()))
        for k, v in template.items()
    ])


def _fits(kind: Column, value: object) -> Column:
    """Whether a variant's schema is that of a template value, with any field null or absent."""
    def form(v):
        if isinstance(v, Mapping):
            fields = "|".join(f"{re.escape(k)}: {form(x)}" for k, x in v.items())
            return f"(?:OBJECT<(?:(?:{fields})(?:, (?!>)|(?=>)))*>|VOID)"
        name = {"ARRAY": "ARRAY<(?:STRING|VOID)>"}.get(_default(v)[1], _default(v)[1])
        return f"(?:{name}|VOID)"

    return F.coalesce(kind.rlike(f"^{form(value)}$"), F.lit(True))


def flatten_template(df: DataFrame, doc: str, template: Mapping, out: str = "features", levels: int | None = None) -> DataFrame:
    """flatten() for documents that mostly follow a template: typed fields in template order, then unknown members.

    Only unknown members of the document itself are walked. A document is flattened as a whole, in its own
    order, if a value has another type than the template's, if an object of the template has an unknown
    member, or if an unknown name begins like one of the template. Absent and null fields give no entry.
    A plain document whose keys stand in template order has the same entries either way, and is read once in a task.
    """
    keys = [p.lower().replace(".", "_") for p, _ in template_paths(template)]
    whole = levels is None and len(set(keys)) == len(keys)
    df = df.withColumn("_plain", _read_plainly(F.col(doc), True, keys) if whole else F.lit(None).cast(ENTRY))
    df = df.withColumn("_rest", F.when(F.col("_plain").isNull(), F.col(doc)))
    names = F.array(*[F.lit(k) for k in template])
    df = df.withColumns({"_doc": F.from_json("_rest", template_schema(template)), "_kinds": F.from_json("_rest", "map<string,variant>")})
    new = F.filter(F.map_keys("_kinds"), lambda k: ~F.array_contains(names, k))
    df = df.withColumn("_new", new)
    like = F.exists("_new", lambda k: fold(or_, [F.lower(k).startswith(t.lower()) for t in template]))
    fits = fold(and_, [_fits(F.schema_of_variant(F.col("_kinds")[k]), v) for k, v in template.items()])
    df = df.withColumn("_odd", ~F.coalesce(fits & ~like & F.col("_doc").isNotNull(), F.lit(False)))
    unknown = F.filter(children(F.col("_rest"), lower=False), lambda e: F.array_contains("_new", e.key))
    unknown = F.transform(unknown, lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"), e.type.alias("type")))
    df = df.withColumn("_entries", F.when(F.col("_odd"), children(F.col("_rest"))).when(F.size("_new") > 0, unknown).otherwise(F.array().cast(ENTRY)))

    def entry(path, default):
        col = F.col("_doc." + ".".join(f"`{p}`" for p in path.split(".")))
        kind = _default(default)[1]
        value = {"STRING": F.lower(col), "BOOLEAN": F.initcap(col.cast("string")),
                 "ARRAY": F.array_join(F.transform(col, lambda x: F.coalesce(F.lower(x), F.lit("None"))), ", ") if kind == "ARRAY" else None}.get(kind, col.cast("string"))
        return F.struct(F.lit(path.lower().replace(".", "_")).alias("key"), value.alias("value"),
                        F.lit("LIST" if kind == "ARRAY" else kind).alias("type"))

    entries = F.array(*[entry(p, d) for p, d in template_paths(template)])
    rows = _finished(df, "_entries", levels)
    entries = F.when(F.col("_odd"), F.col("_entries")).otherwise(F.concat(entries, F.col("_entries")))
    entries = F.filter(entries, lambda e: e.value.isNotNull() & (e.type != "VOID"))
    return rows.withColumn(out, F.coalesce("_plain", entries)).drop("_doc", "_kinds", "_new", "_odd", "_entries", "_plain", "_rest")


def load_template(path: str, key: str = fixed.REMOVED_KEY) -> tuple[dict, T.StructType]:
    """Template of a prompt file and its schema, without the removed key."""
    with open(path, encoding="utf-8") as f:
        template = drop_key(json.load(f).get("output_format", {}), key)
    return template, template_schema(template)


def value_at(doc: Column, path: str) -> Column:
    """Text of the value at a dotted path, null if absent."""
    return F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in path.split(".")))


def set_value(doc: Column, path: str, value: Column) -> Column:
    """Set a field of a struct column by dotted path."""
    return doc.withField(path, value)


def drop_field(doc: Column, path: str) -> Column:
    return doc.dropFields(path)


def _default(value: object) -> tuple[str, str]:
    kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", list: "ARRAY"}.get(type(value), "STRING")
    return (value if isinstance(value, str) else json.dumps(value)), kind


def map_to_template(df: DataFrame, doc: str, template: Mapping, out: str = "mapped",
                    fuzzy: bool = True, subtrees: bool = False, score_section: str = fixed.SCORE_SECTION, levels: int | None = None) -> DataFrame:
    """One entry per template leaf: its own path, else the first member with a like name, else the default.

    Members are leaves, or whole objects too with `subtrees`. Names are alike if the last part of either lower-cased path holds the other. Blank text becomes
    NA and grade scores get their letter. Entries are struct(key = path, value, type, origin).
    """
    raw = "_leaves"
    df = nodes(df, doc, raw, levels)
    paths = template_paths(template)
    wanted = F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(p.split(".")[-1].lower()).alias("last"),
                 F.lit(_default(v)[0]).alias("value"), F.lit(_default(v)[1]).alias("type"))
        for p, v in paths
    ])
    known = F.filter(F.col(raw), lambda e: e.type != "VOID")
    named = F.transform(known, lambda e: F.struct(e.key.alias("key"), e.value.alias("value"), e.type.alias("type"),
                                                  F.lower(F.substring_index(e.key, ".", -1)).alias("last")))
    df = df.withColumn("_named", named)

    def pick(w):
        direct = F.filter(F.col("_named"), lambda e: e.key == w.path)
        alike = F.filter(F.col("_named"), lambda e: F.lit(fuzzy) & (F.lit(subtrees) | ~e.type.isin("OPENED", "OBJECT"))
                         & (F.contains(e.last, w.last) | F.contains(w.last, e.last)))
        entry = lambda e, how: F.struct(w.path.alias("key"), e.value.alias("value"), e.type.alias("type"),
                                        F.lit(how).alias("origin"))
        return (F.when(F.size(direct) > 0, entry(direct[0], "direct"))
                .when(F.size(alike) > 0, entry(alike[0], "alike"))
                .otherwise(entry(w, "default")))

    def clean(e):
        value = F.when(e.type == "STRING", text.na_if_blank(e.value)).otherwise(e.value)
        grade = text.grade_score(F.substring_index(e.key, ".", -1), value, e.type)
        is_score = F.startswith(e.key, F.lit(score_section + "."))
        return F.struct(e.key.alias("key"), F.when(is_score, grade).otherwise(value).alias("value"),
                        F.when(is_score & (grade != value), "STRING").otherwise(e.type).alias("type"),
                        e.origin.alias("origin"))

    return df.withColumn(out, F.transform(F.transform(wanted, pick), clean)).drop(raw, "_named")


def entries_to_json(entries: Column, template: Mapping, prefix: str = "") -> Column:
    """Nested JSON text of mapped entries, in template order."""
    by_key = F.map_from_entries(F.transform(entries, lambda e: F.struct(e.key, F.struct(e.value, e.type))))

    def leaf(path):
        e = by_key[path]
        quoted = F.regexp_replace(F.to_json(F.array(e.value)), r"^\[|\]$", "")
        return F.when(e.type == "STRING", quoted).otherwise(e.value)

    def node(t, prefix):
        parts = []
        for k, v in t.items():
            path = f"{prefix}.{k}" if prefix else k
            body = node(v, path) if isinstance(v, Mapping) else leaf(path)
            parts.append(F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), body))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    return node(template, prefix)


def wide_table(df: DataFrame, ids: Sequence[str], keys: Sequence[str], features: str = "features") -> DataFrame:
    """One column per known key; no shuffle, since a document's features are in its row."""
    pairs = F.map_from_entries(F.transform(F.col(features), lambda e: F.struct(e.key, e.value)))
    return df.withColumn("_map", pairs).select(*ids, *[F.col("_map")[k].alias(k) for k in keys])
