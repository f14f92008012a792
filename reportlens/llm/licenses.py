"""Licence notices, headers and whole licences: text compared to templates by the Dice coefficient of word bigrams.

DataFrame functions only. Lines are compared to the notices; size bounds leave most lines out before any
bigram is compared. Windows of a template's size, over line feeds and inside lines, are compared to the
notices, headers and licences; the rare bigrams of the templates leave most texts out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import BODIES, HEADERS

# Short notices by which texts name their licence.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = Fraction(3, 4)


def normalised(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams; a single word stands for itself."""
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def _line_bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, pairs).otherwise(words)


def _pair_hashes(words: Column) -> Column:
    """Hashes of the word bigrams, in order."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(
        F.array().cast("array<bigint>"))


def _literals(spark: SparkSession, templates: Sequence[tuple[str, str]], t: float) -> tuple[Column, Column]:
    """The templates as an array of structs (license, size in words, distinct bigrams), and their rare bigrams.

    A window or short text that reaches t shares t / (2 - t) of a template's bigrams at least. So one
    bigram more than the other share is enough of each template: texts without any of these reach none.
    The longest bigrams are taken, since long words are rare.
    """
    split = [normalised(body) for _, body in templates]
    coded = spark.range(1).select(*[_pair_hashes(F.split(F.lit(" ".join(w)), " ")).alias(f"t{i}") for i, w in enumerate(split)]).first()
    # One text that is folded to a constant; thousands of literals would make a large plan.
    longs = lambda values: F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")
    structs, rare = [], set()
    for (name, _), words, own in zip(templates, split, coded):
        length = {h: len(a) + len(b) for h, a, b in zip(own, words, words[1:])}
        structs.append(F.struct(F.lit(name).alias("license"), F.lit(len(words)).alias("size"), longs(length).alias("grams")))
        rare |= set(sorted(length, key=lambda h: (-length[h], h))[:int(len(length) * (2 - 2 * t) / (2 - t)) + 1])
    return F.array(*structs), longs(rare)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, also where a lambda inside uses it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _best_window(g: Column, template: Column) -> Column:
    """(shared, at): most distinct bigrams of the template in a window of its size, and the first of them there.

    A bigram at place i counts for the window starts from behind its last place before, or the window's
    reach, up to i: one step up and one down. The running sum over the sorted steps is the number shared.
    """
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("at"))

    def step(s: Column, e: Column) -> Column:
        now = s["now"] + e["d"]
        return F.struct(now.alias("now"), F.greatest(now, s["most"]).alias("most"), F.when(now > s["most"], e["at"]).otherwise(s["at"]).alias("at"))

    def best(hits: Column) -> Column:
        past = F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice(hits, F.lit(1), F.size(hits) - 1))
        steps = F.zip_with(hits, past, lambda h, p: F.array(
            F.struct(F.greatest(h["i"] - template["size"] + 2, F.lit(0), F.when(h["x"] == p["x"], p["i"] + 1)).alias("at"), F.lit(1).alias("d")),
            F.struct((h["i"] + 1).alias("at"), F.lit(-1).alias("d"))))
        return F.aggregate(F.sort_array(F.flatten(steps)), zero, step, lambda s: F.struct(
            s["most"].alias("shared"), F.array_min(F.filter(F.transform(hits, lambda h: h["i"]), lambda i: i >= s["at"])).alias("at")))

    every = F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return _let(F.array_intersect(g, template["grams"]), lambda both: _let(F.sort_array(F.filter(every, lambda h: F.array_contains(both, h["x"]))), best))


def _passages(rows: DataFrame, templates: Sequence[tuple[str, str]], t: float) -> DataFrame:
    """Adds passages (low, line, license): the best window of each template that reaches t; rows have words by line."""
    templates = [x for x in templates if len(normalised(x[1])) >= 2]
    if not templates:
        return rows.withColumn("passages", F.array().cast("array<struct<low:double,line:int,license:string>>"))
    known, rare = _literals(rows.sparkSession, templates, t)
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("g", _pair_hashes(F.flatten("words")))
    rows = rows.withColumn("g", F.when(F.arrays_overlap("g", rare), F.col("g")).otherwise(none))

    def passage(x: Column) -> Column:
        # The window has as many bigrams as the template, a shorter text its own number.
        n, own = F.size(x["grams"]), F.least(F.size("g"), F.size(x["grams"]))
        need = t * (n + own) / 2
        found = F.when(F.size(F.array_intersect(F.col("g"), x["grams"])) >= need, _best_window(F.col("g"), x))
        return _let(found, lambda f: F.struct(x["license"].alias("license"), (2.0 * f["shared"] / (n + own)).alias("dice"), f["at"].alias("at")))

    empty = F.array().cast("array<struct<license:string,dice:double,at:int>>")
    found = F.when(F.size("g") > 0, F.transform(known, passage)).otherwise(empty)
    rows = rows.withColumn("found", F.filter(found, lambda s: s["dice"] >= t))

    def line_of(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("line"))
        return F.aggregate("words", start, lambda s, w: F.struct(
            (s["words"] + F.size(w)).alias("words"), (s["line"] + F.when(s["words"] + F.size(w) <= at, 1).otherwise(0)).alias("line")), lambda s: s["line"])

    return rows.withColumn("passages", F.transform("found", lambda s: F.struct(
        (-s["dice"]).alias("low"), line_of(s["at"]).alias("line"), s["license"].alias("license")))).drop("g", "found")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: Mapping[str, str] = NOTICES,
         threshold: Fraction = THRESHOLD, texts: Sequence[tuple[str, str]] = (*HEADERS, *BODIES)) -> DataFrame:
    """(key, n_lines, n_notices, license, dice, line) of each row of docs.

    Every line, without case and punctuation, is compared to the templates whose number of bigrams
    lets 2 |A and B| / (|A| + |B|) reach the threshold: |A| from t / (2 - t) to (2 - t) / t of |B|. |A|
    counts the bigrams of the line with repeats, |B| the distinct ones of the template. A notice is a line that reaches it.
    The whole text's words, across line feeds and inside lines, are compared as well, to the notices and to texts (headers and
    whole licences): every window of as many words as a template, by the distinct bigrams that both have. |A| is |B| there,
    or the number of bigrams of a text that has fewer. A passage is the best window of a template, if it reaches the threshold.
    license, dice and line (from 0; where a passage begins) are those of the best notice or passage, the first at a tie, and null
    if there is none; n_notices counts lines only. Null and empty texts have no lines. Rows stay in
    their order of partitions; nothing is shuffled. At most a few hundred templates.
    """
    t = float(threshold)
    shapes = [(name, bigrams(normalised(body))) for name, body in sorted(notices.items())]
    shapes = [(name, grams) for name, grams in shapes if grams]
    least = min((len(g) * t / (2 - t) for _, g in shapes), default=0)
    most = max((len(g) * (2 - t) / t for _, g in shapes), default=0)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n")).alias("lines"))

    # Each filter is a column of its own, so the next one sees few lines.
    rows = rows.withColumn("words", F.transform("lines", _words))
    kept = F.filter(F.transform("words", lambda x, i: F.struct(i.alias("line"), x.alias("words"))),
                    lambda s: (F.greatest(F.size(s["words"]) - 1, F.least(F.size(s["words"]), F.lit(1))) >= least) & (F.size(s["words"]) <= most + 1))
    rows = rows.withColumn("found", kept).withColumn("found", F.transform("found", lambda s: F.struct(
        s["line"].alias("line"), F.greatest(F.size(s["words"]) - 1, F.lit(1)).alias("n"), _line_bigrams(s["words"]).alias("g"))))

    def best(s: Column) -> Column:
        n, scores = s["n"], []
        for name, grams in shapes:
            fits = (n >= len(grams) * t / (2 - t)) & (n <= len(grams) * (2 - t) / t)
            shared = F.size(F.array_intersect(s["g"], F.array(*map(F.lit, grams))))
            dice = F.when(fits, 2.0 * shared / (n + len(grams))).otherwise(0.0)
            scores.append(F.struct((-dice).alias("low"), s["line"].alias("line"), F.lit(name).alias("license")))
        return F.least(*scores) if len(scores) > 1 else scores[0]

    if shapes:
        notes = F.filter(F.transform("found", best), lambda s: s["low"] <= -t)
    else:
        notes = F.array().cast("array<struct<low:double,line:int,license:string>>")
    rows = _passages(rows.withColumn("notes", notes), [*sorted(notices.items()), *texts], t)
    rows = rows.withColumn("first", F.array_min(F.concat("notes", "passages")))
    return rows.select(key, F.size("lines").cast("bigint").alias("n_lines"), F.size("notes").cast("bigint").alias("n_notices"),
                       F.col("first.license").alias("license"), F.round(-F.col("first.low"), 6).alias("dice"),
                       F.col("first.line").cast("bigint").alias("line"))
