"""The training-data operators against brute force, round trips and odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from reportlens.llm import decontaminate, html_text, licenses, neardup, packing, quality_rules, repair, resampling, sharding, tokens, url_filter
from reportlens.llm.arrays import NOT_ALNUM, words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "a", "two words", " \t\n ", "x" * 300_000, "The same text, twice.\nThe same text, twice.", "é   b\n\n c\x1cd <|endoftext|> don't",
       "a  b　\n\nZz.. ,x", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, and columns that clash with those of the operators."""
    rows = [(i, t, "en", "s", 1, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 1, "k"), (None, "no key here at all", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, row string")


def empty(df):
    return df.where(F.lit(False))


def test_shards(spark, odd):
    weights = {i: 1.0 + i % 2 for i in range(10)}
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("size"))
    got = sharding.shard_rows(rows, "doc_id", weights, weights | {10: 1.0}).toPandas()
    assert sorted(got.doc_id) == list(range(3000))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert set(got[got.shard != got.grown_shard].grown_shard) == {10}
    share = got.groupby(got.shard % 2).size()
    assert 1.7 < share[1] / share[0] < 2.3                       # by weight
    few = sharding.shard_rows(odd.select("doc_id", "kept"), "doc_id", {0: 1.0}).toPandas()
    assert sorted(few.slot) == list(range(len(few)))
    assert sharding.shard_rows(empty(odd.select("doc_id")), "doc_id", weights).count() == 0


def test_urls(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    urls = ["http://A.Example.ORG/es/1?x", "https://b.org", "https://b.org/", "http://x.com/fr/9#a", "http://x.com/de/9", "nothing", None, "", "://", "http://notcom/fr/"]
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls * 5)], "page_id long, url string, rule string")
    got = url_filter.judge(pages, rules).toPandas().sort_values("page_id").head(len(urls))
    assert got.host.tolist() == ["a.example.org", "b.org", "b.org", "x.com", "x.com", "", "", "", "", "notcom"]
    assert got.path.tolist() == ["/es/1", "", "/", "/fr/9", "/de/9", "", "", "", "", "/fr/"]
    assert [r if isinstance(r, str) else None for r in got.rule] == ["example.org/es/", None, "org/", "com/fr/", "com/de/", None, None, None, None, None]
    assert got.verdict.tolist()[0] == "block" and set(got.verdict) <= {"allow", "block"}
    assert url_filter.judge(empty(pages), rules).count() == 0


def test_url_accuracy(spark):
    host, path = url_filter.host_and_path(F.col("url"))
    rows = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id") % 40, F.when(F.col("id") % 3 == 0, ".bad.example/").otherwise(".good.example/"), F.col("id")).alias("url"),
                                    F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"), "id")
    rows = rows.select("url", "label", "id", host.alias("host"), path.alias("path"))
    model = url_filter.UrlFilter(rows.where("id % 5 <> 0"))
    held = model.blocked(rows.where("id % 5 = 0")).agg(F.avg((F.col("blocked") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert held > 0.95


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name, spark):
    from tokenizers import Tokenizer
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice(list("aZé ß.,'\n\t<|>  ́Σİ9中")) for _ in range(60)) for _ in range(300)]
    whole = Tokenizer.from_file(tokens.tokenizer_path(name))
    ids, borders = tokens.Encoder(tokens.tokenizer_path(name)).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert whole.encode(t or "", add_special_tokens=False).ids == ids[borders[i]:borders[i + 1]].tolist(), t


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 4000, 1, 0, 2500, 9])
    ids = rng.integers(0, 6, sizes.sum()).astype(np.uint32)
    g = repair.compress(ids, np.cumsum(sizes), least=4)
    assert len(g["seq"]) < len(ids) and len(g["left"]) > 0
    shard = repair.Shard(**g)
    out, borders = shard.ids()
    assert (out == ids).all() and (np.diff(borders) == sizes).all()
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        assert (shard.document(i) == ids[a:b]).all()
        assert (shard.document(i, 3, 700) == ids[a:b][3:700]).all()


def test_repair_files(spark, odd, tmp_path):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    got = repair.encoded(odd, path, path=str(tmp_path / "files")).toPandas().sort_values("start")
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and len(got) == odd.count()
    keys = got.doc_id.dropna().tolist()
    assert keys == sorted(keys)
    one = got[got.doc_id == 3].iloc[0]
    ids = tokens.Encoder(path).encode(pa.array([ODD[3]]))[0].tolist() + [0]
    assert one.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert repair.encoded(empty(odd), path, path=str(tmp_path / "none")).count() == 0


def _fewest(sizes, capacity):
    """Bins of an optimal packing, by trying all."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i]:
                place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(150):
        sizes = sorted((rng.randint(2, 20) for _ in range(8)), reverse=True)
        counts = collections.Counter(sizes)
        instance = packing.Instance(counts, 20)
        fixed = packing.reduce_instance(instance)
        assert all(sum(lengths) <= 20 for lengths, _ in fixed)
        rest = sorted(instance.left.elements(), reverse=True)
        assert sum(t for _, t in fixed) + _fewest(rest, 20) == _fewest(sizes, 20)
        assert packing.plan(counts, 20).sequences <= _fewest(sizes, 20) + 1


def test_pack(spark, odd):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    got = packing.pack(odd, path, capacity=64).toPandas()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    ids = tokens.Encoder(path).encode(pa.array([ODD[9]]))[0].tolist() + [1]
    own = got[got.doc_id == 9].sort_values("piece")
    assert own.length.sum() == len(ids) and (own.start == own.piece * 64).all()
    assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes()) for s in own.start]
    assert packing.pack(empty(odd), path).count() == 0


def _groups(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in sets}


def test_near_duplicates(spark, odd):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    texts = {}
    for i in range(160):                                        # copies of one text with one to nine changed words, and copies of copies
        words = list(base if i < 120 else texts[i - 100].split(" "))
        for _ in range(rng.randint(1, 9) if i < 120 else 4):
            words[rng.randrange(150)] = f"n{i}x{rng.randint(0, 99)}"
        texts[i] = " ".join(words)
    texts |= {200 + i: t for i, t in enumerate(ODD)} | {300: ODD[3], 301: texts[5], 302: texts[5].upper()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, roots = _groups(texts)
    for tile in (8, 512):
        got = neardup.near_groups(docs, tile_rows=tile).toPandas().set_index("doc_id")
        assert {i: got.n_shingles[i] for i in texts} == sizes
        wrong = [i for i in texts if got.component_id[i] != roots[i]]
        assert not wrong
        assert all(got.kept[i] == (roots[i] == i) for i in texts)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert neardup.near_groups(empty(odd)).count() == 0


def test_leaks(spark, odd):
    rng = random.Random(2)
    items = [" ".join(f"v{rng.randint(0, 900)}" for _ in range(n)) for n in (1, 2, 6, 15, 30, 40, 55)] + ["", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, planted = [], {}
    for k in range(120):
        item = rng.randrange(3, 7)
        words, n = items[item].split(), len(items[item].split())
        for _ in range(rng.randint(0, int(0.1 * n))):
            words[rng.randrange(n)] = f"changed{k}"
        docs.append((k, " ".join([f"p{rng.randint(0, 900)}" for _ in range(50)] + [w.upper() + "," for w in words] + [f"q{k}"] * 20), "x"))
        planted[k] = item
    docs += [(1000 + k, " ".join(f"z{rng.randint(0, 900)}" for _ in range(100)), "x") for k in range(50)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, hits string"), bench).toPandas().set_index("doc_id")
    found = [k for k, item in planted.items() if got.item_id[k] == item]
    assert len(found) >= 0.98 * len(planted) and not got.contaminated[got.index >= 1000].any()
    assert decontaminate.leaks(odd, bench).where("contaminated").count() == 0
    assert decontaminate.keep_clean(odd, empty(bench)).count() == odd.count()
    assert decontaminate.leaks(empty(odd), bench).count() == 0


def test_leaks_of_items_without_id(spark):
    items = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    bench = spark.createDataFrame(list(zip([None, 7, None], items)), "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0]), (2, items[1]), (3, "nothing of the kind"), (4, "x " + items[0] + " y " + items[2] + " " + items[1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, bench).collect()}
    assert [(got[i]["contaminated"], got[i]["n_items"], got[i]["item_id"], got[i]["edits"]) for i in range(1, 5)] == [
        (True, 1, None, 0), (True, 1, 7, 0), (False, 0, None, None), (True, 2, None, 0)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [3]


@pytest.mark.parametrize("kind", ["drop", "add", "change", "whole"])
def test_leaks_of_other_lengths(kind):
    """Up to the whole 0.2 edits a word: words dropped, added or changed inside a text, or dropped from a text that is the item."""
    rng = random.Random(4)
    for n in (5, 10, 20, 40, 55):
        items = [[f"v{rng.randint(0, 3000)}" for _ in range(n)] for _ in range(40)]
        texts = []
        for item in items:
            words, at = list(item), sorted(rng.sample(range(1, n - 1), decontaminate.allowed_edits(n)), reverse=True)
            for i in at:
                words[i:i + (kind != "add")] = [] if kind in ("drop", "whole") else [f"new{i}"]
            around = [] if kind == "whole" else [f"p{rng.randint(0, 900)}" for _ in range(40)]
            texts.append(" ".join(around + words + around))
        found = decontaminate.Index.of(list(range(40)), [" ".join(i) for i in items]).found(pa.array(texts))
        hits = {(text, item): (edits, first, size) for text, item, first, size, edits in found}
        size = n + {"drop": -1, "whole": -1, "add": 1, "change": 0}[kind] * decontaminate.allowed_edits(n)
        assert sum((i, i) in hits for i in range(40)) >= 39
        assert all(h == (decontaminate.allowed_edits(n), len(around), size) for (text, item), h in hits.items() if text == item)


def test_nearest_runs():
    rng = np.random.default_rng(3)
    a, b, sizes = rng.integers(0, 4, (60, 5)), rng.integers(0, 4, (60, 9)), rng.integers(4, 10, 60)
    for x, y, n, *got in zip(a, b, sizes, *decontaminate.nearest_runs(a, b, sizes)):
        y = y[:n]
        runs = [(int(decontaminate.edit_distances(x[None], y[None, i:j])[0]), i, j) for i in range(n + 1) for j in range(i, n + 1)]
        edits, first, _ = min(runs)
        assert got[0] == edits and (edits, got[1], got[1] + got[2]) in runs


def test_edit_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (40, 9)), rng.integers(0, 3, (40, 9))

    def slow(x, y):
        d = np.add.outer(np.arange(len(x) + 1), np.arange(len(y) + 1))
        for i, j in itertools.product(range(len(x)), range(len(y))):
            d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (x[i] != y[j]))
        return d[-1, -1]

    assert decontaminate.edit_distances(a, b).tolist() == [slow(x, y) for x, y in zip(a, b)]


def _counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").union(
        odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, "text", "lang", "source"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality_rules.judge(docs).toPandas().set_index("doc_id")
    got = got[~got.index.duplicated()]
    for i, t in texts.items():
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(t), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and not got.base_failed[i]]
    assert np.mean([got.kept[i] for i in good]) > 0.99
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert quality_rules.judge(empty(odd)).count() == 0


def test_quality_fences_follow_tails(spark):
    """Documents of 20 lines: none, or 5 of them, are repeats of another; one in 200 has 7 such lines."""
    def text(k, repeated):
        lines = [" ".join(f"w{k:04d}x{i:02d}x{j}" for j in range(8)) for i in range(20 - (repeated + 1 if repeated else 0))]
        for i in range(repeated + 1 if repeated else 0):
            lines.insert(2 * i, "once-again near-again")                       # between other lines, so no window of words repeats
        return "\n".join(lines)

    rows = [(1000 * g + k, text(1000 * g + k, 7 if k == 0 else 5 if g and k % 20 == 1 else 0), "en", f"s{g}") for g in (0, 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rows = quality_rules.grouped(quality_rules.measures(docs)).cache()
    table = quality_rules.thresholds(rows)
    fences = {r["source"]: r for r in table.collect()}
    assert fences["s0"]["hi_dup_lines"] < 250 < fences["s1"]["hi_dup_lines"]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.kept(rows, table).select("row.doc_id", "kept").collect()}
    assert not got[0] and all(kept for i, kept in got.items() if i)


def test_resampling(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = resampling.resample(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.8
    half = resampling.resample(docs, labels, share=0.5).toPandas()
    assert half.kept.sum() == 500
    assert resampling.keep_sample(odd, labels, share=0.5).columns == odd.columns
    assert resampling.resample(odd, empty(labels)).where("kept").count() == odd.count()
    assert resampling.resample(empty(odd), labels).count() == 0


def test_licenses(spark, odd):
    texts = ["prose here\nReleased under the MIT license\nmore", "Licensed under CC BY-NC 4.0.", "MIT", "licensed", None, "", "Nothing of the kind is said here."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert [x if isinstance(x, str) else None for x in got.license] == ["MIT", "CC-BY-NC-4.0", None, None, None, None, None]
    assert got.line[0] == 1 and got.dice[0] == 1.0

    def brute(t):
        best = []
        for k, line in enumerate(t.split("\n") if t else []):
            w = licenses.normalised(line)
            grams = [" ".join(p) for p in zip(w, w[1:])] or w
            for name, body in licenses.NOTICES.items():
                b = set(licenses.bigrams(licenses.normalised(body)))
                if grams and 4 * 2 * len(set(grams) & b) >= 3 * (len(grams) + len(b)):
                    best.append((-2 * len(set(grams) & b) / (len(grams) + len(b)), k, name))
        return min(best)[2] if best else None

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert r["license"] == brute(texts[r["doc_id"]])
    assert licenses.scan(odd).count() == odd.count()


def test_licenses_in_whole_texts(spark):
    from reportlens.llm.license_texts import BODIES, HEADERS
    rng = random.Random(6)
    prose = lambda n: " ".join(f"p{rng.randint(0, 900)}" for _ in range(n))
    texts = [(name, prose(30) + "\n" + body + "\n" + prose(30)) for name, body in (*HEADERS, *BODIES)]
    texts += [(name, body.replace("\n", " ")) for name, body in BODIES[:5]]                       # one long line
    texts += [(name, re.sub(r"(\S+\s+){4}", r"\g<0>\n# ", prose(40) + " " + body)) for name, body in HEADERS]     # wrapped, commented
    texts += [("MIT", prose(40) + ". Released under the MIT License. " + prose(40)), ("MIT", prose(9) + " released under\nthe MIT\nLicense " + prose(9)),
              (None, prose(200)), (None, prose(40) + " the license under the software is provided " + prose(40))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == [name for name, _ in texts]
    assert all(got[i]["line"] <= 2 and got[i]["dice"] == 1.0 for i in range(len(HEADERS) + len(BODIES)))

    # The best window of short templates, one by one.
    templates = [("a", "x y z x y w"), ("b", "y z y z y"), ("c", "w x")]
    texts = [" ".join(rng.choice("xyzwv") for _ in range(rng.randint(0, 20))) for _ in range(150)]

    def brute(text):
        words, best = text.split(), []
        for name, body in templates:
            b, size = set(licenses.bigrams(body.split())), len(body.split())
            grams = list(zip(words, words[1:]))
            own = min(len(b), len(grams))
            for at in range(max(1, len(grams) - size + 2)):
                share = 2 * len({" ".join(p) for p in grams[at:at + size - 1]} & b) / (len(b) + own)
                if share >= 0.75:
                    best.append((-share, name))
        return round(-min(best)[0], 6) if best else None

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs, notices={}, texts=templates).collect():
        assert r["dice"] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_pages(spark):
    page = ("<html><head><title>T</title></head><body><header>Site</header><nav><a href=/x>x</a></nav><div class='cookie-notice'>We use cookies on this site.</div>"
            "<article><h1>Head</h1><p>Is &amp; was&nbsp;so\n long <b>bold<br><p>Of.</p><div class=ad>Buy this thing</div></article><section id=comments><p>Nice text, thank you all!</p></section>"
            "<form><label>Name</label></form><script>var t='</p>';</script><footer>&copy; all</footer>")
    plain = "<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></body>"
    rows = [(1, "u", page), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "<p>un<closed &am")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head\nIs & was so long bold\nOf." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"].startswith("word word") and "Home" not in got[2]["text"] and "more" in got[2]["text"]
    assert got[3]["text"] == "" and got[4]["n_chars"] == 0


def test_words():
    words = words_of(pa.array(ODD, pa.string()))
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in ODD]
    low = words_of(pa.array(["A-b  Cé"]), NOT_ALNUM, lower=True).hashes
    assert (low == words_of(pa.array(["a b cé"])).hashes).all()


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF)
        if name != "best_fit_packing":
            assert rows.columns == docs.columns and rows.exceptAll(before).isEmpty()
    one = {tuple(r)[:5] for r in rows.collect()}
    assert one == {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()}
