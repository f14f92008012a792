import json

import pytest
from pyspark.sql import functions as F

from reportlens.functions import fixed, text
from reportlens.functions import vectors as V
from reportlens.operators import documents as D


def flat(spark, doc):
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    return {r.key: r.value for r in D.explode_features(D.flatten(df, "doc")).orderBy("ordinal").collect()}


def test_flatten_rules(spark):
    got = flat(spark, {"B": {"z": "X", "a": True, "n": None, "num": 1.5, "arr": ["A", 2, True, None],
                             "dl": [{"K": "V"}, 3, {"K": "W"}], "e": {}, "E2": [], "Z": "Last"}})
    assert got == {"b_z": "last", "b_a": "True", "b_n": None, "b_num": "1.5", "b_arr": "a, 2, True, None",
                   "b_dl_0_k": "v", "b_dl_2_k": "w", "b_e2": ""}
    assert list(got)[0] == "b_z"


def test_flatten_keeps_document_order_and_depth(spark):
    got = flat(spark, {"z": 1, "a": {"y": {"x": {"w": {"v": "Deep"}}}}, "m": "é"})
    assert list(got.items()) == [("z", "1"), ("a_y_x_w_v", "deep"), ("m", "é")]


def test_section_text_drops_empty_values_only(spark):
    doc = {"s": {"a": "NA", "b": "", "c": None, "d": False, "e": 0}, "t": {"a": "x"}}
    df = D.flatten(spark.createDataFrame([(json.dumps(doc),)], "doc string"), "doc")
    row = df.select(D.section_text(D.with_section(F.col("features"), ["s", "t"]), "s").alias("t")).first()
    assert row.t == "a: na; d: False; e: 0"


def mapped(spark, doc, template, **kw):
    df = D.map_to_template(spark.createDataFrame([(json.dumps(doc),)], "doc string"), "doc", template, **kw)
    rows = df.select(F.explode_outer("mapped").alias("e")).select("e.*").collect()
    return {r.key: (r.value, r.origin) for r in rows}


def test_template_mapping(spark):
    template = {"q": {"n": 0, "flag": False, "note": "", "list": []}, "other": ""}
    got = mapped(spark, {"q": {"n": None, "note": ""}, "z": {"List_of": ["a"], "my_other": "found"}}, template)
    assert got["q.n"] == ("NA", "alike")      # "n" lies in "note", the first leaf like it
    assert got["q.note"] == ("NA", "direct")
    assert got["q.flag"] == ("false", "default")
    assert got["q.list"] == ('["a"]', "alike")
    assert got["other"] == ("found", "alike")
    strict = mapped(spark, {"z": {"my_other": "found"}}, template, fuzzy=False)
    assert strict["other"] == ("NA", "default") and strict["q.n"] == ("0", "default")


def test_fuzzy_match_can_take_subtrees(spark):
    template = {"total": ""}
    doc = {"x": {"totals": {"n": 3}}, "y": {"subtotal": "7"}}
    assert mapped(spark, doc, template)["total"] == ("7", "alike")
    assert mapped(spark, doc, template, subtrees=True)["total"] == ('{"n":3}', "alike")


def test_grade_scores(spark):
    values = {"M": "Mild", "E": "2", "S": 2, "T": True, "C": 2.9}
    got = mapped(spark, {"MEST_C_score": values}, {"MEST_C_score": dict.fromkeys(fixed.SCORE_KEYS, "")})
    assert {k[-1]: v for k, (v, _) in got.items()} == {"M": "Mild", "E": "E2", "S": "S2", "T": "T1", "C": "C2"}
    got = mapped(spark, {"MEST_C_score": {"M": "2.5", "E": " 3 ", "S": "high", "T": "", "C": "C1"}},
                 {"MEST_C_score": dict.fromkeys(fixed.SCORE_KEYS, "")}, fuzzy=False)
    assert {k[-1]: v for k, (v, _) in got.items()} == {"M": "2.5", "E": "E3", "S": "high", "T": "NA", "C": "C1"}


def test_template_round_trip(spark, tmp_path):
    path = tmp_path / "prompt.json"
    path.write_text(json.dumps({"output_format": {"a": {"b": "", fixed.REMOVED_KEY: {"x": 1}}, "n": 0, "l": []}}))
    template, schema = D.load_template(str(path))
    assert template == {"a": {"b": ""}, "n": 0, "l": []}
    assert schema.simpleString() == "struct<a:struct<b:string>,n:bigint,l:array<string>>"
    assert len(D.template_paths(fixed.TEMPLATE)) == 71
    df = spark.createDataFrame([('{"a":{"b":"q\\"uote"},"n":4,"l":["x"]}',)], "doc string")
    out = D.map_to_template(df, "doc", template).select(D.entries_to_json(F.col("mapped"), template).alias("j")).first().j
    assert json.loads(out) == {"a": {"b": 'q"uote'}, "n": 4, "l": ["x"]}


def test_both_flatteners_agree(spark):
    template = {"A": {"S": "", "Yes": False, "N": 0}, "L": []}
    docs = [{"A": {"S": "Text", "Yes": True, "N": 3}, "L": ["X", "y"]}, {"A": {"S": "", "Yes": False, "N": 0}, "L": []}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    kv = lambda d: sorted(map(str, D.explode_features(d).select("ordinal", "key", "value").collect()))
    assert kv(D.flatten(df, "doc")) == kv(D.flatten_template(df, "doc", template))


def test_nothing_is_lost_below_six_levels(spark):
    doc = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": "deep"}}, "t": "a } \" { b"}}, "x": "kept"}}}}}
    df = spark.createDataFrame([(json.dumps(doc),), ('{"k": 1}',), (None,)], "doc string")
    got = {r.key: r.value for r in D.explode_features(D.flatten(df, "doc")).collect()}
    assert got == {"a_b_c_d_e_f_g_h_i": "deep", "a_b_c_d_e_f_t": 'a } " { b', "a_b_c_d_x": "kept", "k": "1"}
    mapped = D.map_to_template(df.limit(1), "doc", {"z": {"i": "none"}}).first().mapped
    assert [(m.value, m.origin) for m in mapped] == [("deep", "alike")]
    with pytest.raises(Exception, match="nested deeper than 3 levels"):
        D.flatten(df, "doc", levels=3).collect()


def test_deep_documents_in_a_plan_that_does_not_grow(spark):
    doc = {"end": 1, "n": [1.5, -2e-7, 12345678.25, 1e30], "s": "Ü}\"", "b": False, "o": {}, "z": None, "l": ["A", None], "d": [{"K": "V"}, 3, {"k": {"w": 2.5}}]}
    for i in range(200):
        doc = {"Level": doc, "x": i} if i % 2 else {"x": i, "Level": doc}
    df = spark.createDataFrame([(json.dumps(doc),), ('{"k": {"l": 1}}',)], "doc string")
    rows = D.flatten(df, "doc")
    got = {r.key: r.value for r in D.explode_features(rows).collect()}
    deep = "level_" * 200
    assert got[deep + "end"] == "1" and got[deep + "s"] == "ü}\"" and got[deep + "b"] == "False" and got[deep + "z"] is None
    assert got[deep + "l"] == "a, None" and got[deep + "d_0_k"] == "v" and got[deep + "d_2_k_w"] == "2.5" and deep + "o" not in got
    assert got["k_l"] == "1" and len([k for k in got if k.endswith("_x") or k == "x"]) == 200
    found = D.map_to_template(df.limit(1), "doc", {"q": {"end": 0}}).first().mapped
    assert [(m.value, m.origin) for m in found] == [("1", "alike")]


def test_walk_follows_the_rules_of_the_plan(spark):
    doc = {"A": {"b": [{"C": {"D": [1, "x"]}}, 7, {"E": []}], "f": {"G": {"h": {"I": True}}}, "j": [[{"k": 1}]], "n": 1.50, "big": 123456789012, "e": {}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    plain = lambda rows: [(r.key, r.value, r.type) for r in rows]
    top = plain(df.select(D.children(F.col("doc")).alias("e")).first().e)
    walked = [e for e in D.walk(top, True) if e[2] != "OBJECT"]
    in_plan = [e for e in plain(D._opened(df.withColumn("e", D.children(F.col("doc"))), "e", 9, True).first().e) if e[2] != "OBJECT"]
    number = lambda es: [(k, v, "NUMBER" if t in ("DOUBLE", "DECIMAL", "BIGINT") else t) for k, v, t in es]
    assert number(walked) == number(in_plan)
    top = plain(df.select(D.children(F.col("doc"), None, ".", False).alias("e")).first().e)
    assert number(D.walk(top, False)) == number(plain(D.nodes(df, "doc", "e", 9).first().e))


def test_template_path_keeps_unknown_members(spark):
    template = {"S": {"Code": 1, "Name": "n", "In": {"Deep": ""}}, "L": []}
    docs = [{"S": {"Code": 1, "Name": None, "In": {"Deep": None}}, "L": ["A", None], "Extra": {"x": {"Y": "Z"}}, "More": 2.5}, {"Other": [{"a": 1}]}, {"S": None, "L": []},
            {"S": {"In": {"Deep": "D", "New": 1}}, "l": 3}, {"S": {"Code": 1.5}}, {"L": [1, "x"]}, {"S": "text"}, {}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(98, "[1]"), (99, None)], "i int, doc string")
    kv = lambda rows: sorted((r.i, r.key, r.value) for r in D.explode_features(rows, "i").collect() if r.value is not None)
    assert kv(D.flatten_template(df, "doc", template)) == kv(D.flatten(df, "doc"))
    odd = D.flatten_template(df, "doc", template).count()
    assert odd == len(docs) + 2


def test_documents_off_the_template_lose_nothing(spark):
    template = {"S": {"Code": 1, "Name": "n", "Tags": ["t"]}}
    docs = [{"S": {"Code": "two", "Name": "A"}}, {"S": {"Code": 2, "Name": "A", "More": {"New": "B"}}}, {"S": {"Code": 3, "Name": None}}, {"S": {"Name": ["x", "Y"]}}]
    for doc in docs:
        df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
        full = {k: v for k, v in flat(spark, doc).items() if v is not None}
        assert {r.key: r.value for r in D.explode_features(D.flatten_template(df, "doc", template)).collect()} == full


def test_ids_of_file_names(spark):
    names = ["/a/b/pathology_features_ph1_RB2.json", "pathology_features_x.json", "a_b_c.tar.json", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(text.ids_of_file(F.col("n")).alias("i")).select("i.*")
    assert [tuple(r) for r in df.collect()] == [("ph1", "RB2"), ("x", ""), ("a", "b"), ("", "")]


def test_json_recovery(spark):
    cases = ['{"a":1}', 'Text {"a":{"b":1}} and {"c":{"d":12345}} end', 'pre {"x":1} post', "no json", '{"broken": {']
    df = spark.createDataFrame([(c,) for c in cases], "c string").select(text.recover_json(F.col("c")).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":1}', '{"c":{"d":12345}}', '{"x":1}', None, None]


def test_hashing_vector_equals_plain_function(spark):
    from reportlens.operators.external import hashing_embedder
    texts = ["a: b; c: d", "", "Word word WORD other", "é ü"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(V.hashing_vector(F.col("t"), 8).alias("v"))
    assert [r.v for r in df.collect()] == [list(map(float, v)) for v in hashing_embedder(8)(texts)]


def test_zero_and_odd_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 2.0],)], "v array<double>")
    for norm, want in {"l1": [[3 / 7, 4 / 7], [0, 0], [0, 1]], "l2": [[0.6, 0.8], [0, 0], [0, 1]], "max": [[0.75, 1], [0, 0], [0, 1]]}.items():
        assert [r.v for r in df.select(V.normalize(F.col("v"), norm).alias("v")).collect()] == want
    cut = df.select(V.fit_dim(F.col("v"), 1).alias("a"), V.fit_dim(F.col("v"), 3).alias("b")).first()
    assert (cut.a, cut.b) == ([3.0], [3.0, 4.0, 0.0])


def test_plain_documents_in_one_reading(spark, monkeypatch):
    """Plain documents are read once; the entries are those of the plan, which reads all others."""
    plain = ['{"Order":{"Status":"F","Code":3,"Note":"","Empty":{}},"Lines":{"Flags":["A",true,7],"None":[]},"x":null,"y":2.7}', "{}"]
    other = ['{"a":1,"a":2}', '{"a":{"b":1},"a_b":2}', '{"a":-0}', '{"a":1} x', '{"a":NaN}', '{"a":1e2}', '{"a":"\u00c9"}', '{"a":[{"b":1},2]}', "[1]", "", None,
             '{"a":' * 7 + "1" + "}" * 7, '{"a":"' + "long " * 4000 + '"}']
    df = spark.createDataFrame(list(enumerate(plain + other)), "id int, doc string")
    read = {r.id for r in df.where(D._read_plainly(F.col("doc"), True).isNotNull()).select("id").collect()}
    assert read == {0, 1}
    def both():
        flat = {r.id: r.o for r in D.flatten(df, "doc", "o").collect()}
        return {r.id: (flat[r.id], r.o) for r in D.nodes(df, "doc", "o").collect()}

    got = both()
    monkeypatch.setattr(D, "_read_plainly", lambda doc, flat: F.lit(None).cast(D.ENTRY))
    assert got == both()
    assert [(e.key, e.value, e.type) for e in got[0][0]][:2] == [("order_status", "f", "STRING"), ("order_code", "3", "BIGINT")]


def test_plain_template_documents_in_one_reading(spark, monkeypatch):
    """Plain documents in template order are read once, with the entries that the typed parse gives."""
    template = {"Order": {"Status": "", "Code": 0, "Ok": False}, "Lines": {"Flags": [], "N": 0}}
    plain = ['{"Order":{"Status":"F","Code":3,"Ok":true},"Lines":{"Flags":["A","b"],"N":null},"More":{"x":1}}', '{"Order":null,"Lines":{"Flags":[],"N":4}}',
             '{"Order":{"Status":7,"Extra":"x"}}', '{"order":{"Status":"F"},"Order_2":1}', "{}"]
    other = ['{"Lines":{"N":4},"Order":{"Status":"F"}}', '{"More":1,"Order":{"Code":3}}', '{"Order":{"Code":3,"Status":"F"}}', '{"Lines":{"Flags":[null]}}', "[]", "", None]
    df = spark.createDataFrame(list(enumerate(plain + other)), "id int, doc string")
    keys = ["order_status", "order_code", "order_ok", "lines_flags", "lines_n"]
    read = df.where(D._read_plainly(F.col("doc"), True, keys).isNotNull()).select("id").collect()
    assert {r.id for r in read} == set(range(len(plain)))
    every = lambda: {r.id: r.features for r in D.flatten_template(df, "doc", template).collect()}
    got = every()
    assert D.flatten_template(df, "doc", template).columns == ["id", "doc", "features"]
    monkeypatch.setattr(D, "_read_plainly", lambda doc, flat, order=None: F.lit(None).cast(D.ENTRY))
    assert got == every()
