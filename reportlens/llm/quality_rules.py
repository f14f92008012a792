"""Quality rules with thresholds from mergeable quantile sketches per language and source.

DataFrame functions only. A sketch is a histogram over buckets that keep the seven leading bits of a
whole number: exact below 128, within 1/64 above. Sketches merge by adding counts, so they do not
depend on partitions, and sketches of small groups merge into those of the language and the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, small, written

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
INDEX_BITS = 24
MIN_WORDS, MAX_REPEAT = 50, 50          # base rule: words, and per cent of words in repeated windows
MIN_DOCS = 100                          # a group of fewer documents takes the thresholds of its language
REACH = 3                               # fences lie so many spreads beyond the quartiles
LEAST_MARGIN = 100                      # per thousand; an upper fence lies this, or a quarter, above the group's 0.99 quantile

# Measured per document as whole numbers: (least spread, lower fence as well). A rule without a lower fence has the
# lower of two upper ones: of the tail, and of the quartiles, which a group with much junk cannot shift.
RULES = {
    "symbols": (150, False),            # symbols per thousand words
    "dup_lines": (150, False),          # repeated lines per thousand lines with a word
    "repeats": (150, False),            # words in repeated windows per thousand words
    "word_length": (30, True),          # characters per hundred words
}


def _repeated_windows(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that the text has twice or more.

    Windows are hashed; most texts have no hash twice and are done. Else hash and position are packed
    into one number and sorted, neighbours with equal hashes are kept, and only these few windows are
    compared as strings.
    """
    n = F.size("_w")
    at_all = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(
        F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)))
    rows = rows.withColumn("_h", F.when(n >= 3, at_all).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    index = (1 << INDEX_BITS) - 1
    pack = F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~index)).bitwiseOR(i.cast("bigint")))
    none = F.array().cast("array<bigint>")
    short = F.size("_h") <= index
    rows = rows.withColumn("_again", again)
    rows = rows.withColumn("_s", F.when(F.col("_again") & short, F.sort_array(pack)).otherwise(none))
    near = F.zip_with(F.col("_s"), F.slice(F.col("_s"), F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: F.when(
        F.shiftright(a, INDEX_BITS) == F.shiftright(b, INDEX_BITS), F.array(a, b)))
    near = F.flatten(F.filter(near, lambda p: p.isNotNull()))
    near = F.transform(near, lambda x: x.bitwiseAND(F.lit(index)))
    every = F.transform("_h", lambda h, i: i.cast("bigint"))
    rows = rows.withColumn("_c", F.when(~F.col("_again"), none).when(short, F.array_distinct(near)).otherwise(every))
    keyed = F.transform("_c", lambda i: F.struct(F.concat_ws(" ", F.slice(F.col("_w"), (i + 1).cast("int"), F.lit(3))).alias("k"), i.alias("i")))
    rows = rows.withColumn("_k", F.sort_array(keyed))
    same = F.zip_with(F.col("_k"), F.slice(F.col("_k"), F.lit(2), F.greatest(F.size("_k") - 1, F.lit(0))),
                      lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))))
    steps = F.zip_with(F.col("_p"), F.slice(F.col("_p"), F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))),
                       lambda a, b: F.when(b.isNull(), F.lit(3)).otherwise(F.least(b - a, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", total).drop("_h", "_again", "_s", "_c", "_k", "_p")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The whole table as struct `row`, and the counts of the rules over the whole text (null: no words).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed.
    """
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = packed(docs).withColumn("_t", whole)
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACES), ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    symbols = F.length(F.regexp_replace("_t", "[^" + SYMBOLS + "]+", ""))
    rows = rows.select("row", "_w", F.size("_w").cast("bigint").alias("n_words"),
                       F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
                       F.size("_l").cast("bigint").alias("n_lines"),
                       (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"))
    rows = _repeated_windows(rows).drop("_w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _per(count: str, size: str, unit: int) -> Column:
    return F.when(F.col(size) > 0, F.floor(unit * F.col(count) / F.col(size))).otherwise(0).cast("bigint")


def rates(rows: DataFrame) -> DataFrame:
    """Adds m_<rule>, the whole number that each rule looks at."""
    return rows.withColumns({"m_symbols": _per("n_symbols", "n_words", 1000), "m_dup_lines": _per("n_dup_lines", "n_lines", 1000),
                             "m_repeats": _per("n_repeat_words", "n_words", 1000), "m_word_length": _per("word_chars", "n_words", 100)})


def bucket(value: Column) -> Column:
    """The value without the bits below its seven leading ones."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, value, n): one mergeable histogram per group and rule, of texts that pass the base rule."""
    long = rows.where("not base_failed").select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(f"m_{r}")).alias("value")) for r in RULES])).alias("e"))
    return long.groupBy("lang", "source", F.col("e.rule").alias("rule"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, docs, lo_<rule>, hi_<rule>) from the quartiles and upper tails of the merged sketches."""
    merged = sketch.groupBy(*group, "rule", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "rule")
    upto = merged.withColumns({"upto": F.sum("n").over(w.orderBy("value")), "docs": F.sum("n").over(w)})
    q = {p: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * p, F.col("value"))) for p in (25, 75, 99)}
    ends = upto.groupBy(*group, "rule").agg(F.max("docs").alias("docs"), q[25].alias("q1"), q[75].alias("q3"), q[99].alias("q99"))
    cols = [F.max("docs").alias("docs")]
    for r, (least, both) in RULES.items():
        spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        high = F.col("q3") + spread
        if not both:
            high = F.least(high, F.col("q99") + F.greatest(F.lit(LEAST_MARGIN), F.floor(F.col("q99") / 4)))
        cols.append(F.max(F.when(F.col("rule") == r, high)).alias(f"hi_{r}"))
        if both:
            cols.append(F.max(F.when(F.col("rule") == r, F.col("q1") - spread)).alias(f"lo_{r}"))
    return ends.groupBy(*group).agg(*cols)


def thresholds(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, lo_*, hi_*) of every group with texts that pass the base rule.

    A group below min_docs texts takes the fences of its language, a language below it those of all.
    """
    sketch = written(sketches(rows))
    own, tongue, whole = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch.withColumn("_all", F.lit(1)), ["_all"])
    ends = [c for c in own.columns if c[:3] in ("lo_", "hi_")]
    names = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    t, a = names(tongue, "t_"), names(whole, "a_")
    both = own.join(t, F.col("lang").eqNullSafe(F.col("t_lang")), "left").withColumn("_all", F.lit(1)).join(a, F.col("_all") == F.col("a__all"), "left")
    pick = lambda c: F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("t_docs") >= min_docs, F.col(f"t_{c}")).otherwise(F.col(f"a_{c}"))
    return written(both.select("lang", "source", *[pick(c).alias(c) for c in ends]))


def kept(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds kept to measured rows: not base_failed and every rate within the fences of language and source."""
    fences = fences.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    ok = ~F.col("base_failed")
    for r, (_, both) in RULES.items():
        ok = ok & F.coalesce(F.col(f"m_{r}") <= F.col(f"hi_{r}"), F.lit(True))
        if both:
            ok = ok & F.coalesce(F.col(f"m_{r}") >= F.col(f"lo_{r}"), F.lit(True))
    return rows.join(small(fences), same, "left").withColumn("kept", ok).drop(*fences.columns)


def grouped(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds lang and source beside `row`; a null language or source is a group like any other."""
    return rates(rows).withColumns({"lang": F.col(f"row.{lang}"), "source": F.col(f"row.{source}")})


def judge(docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, counts, base_failed, kept) of every row; the texts are read once and never shuffled."""
    rows = grouped(measures(docs)).withColumn(key, F.col(f"row.{key}")).drop("row")
    rows = written(rows)
    out = kept(rows, thresholds(rows, min_docs))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs that are kept, with their own columns only.

    Measured rows are written with their texts, since joining verdicts to texts would shuffle them.
    """
    rows = written(grouped(measures(docs)))
    return kept(rows, thresholds(rows.drop("row"), min_docs)).where("kept").select("row.*")
