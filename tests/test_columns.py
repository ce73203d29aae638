"""Column functions on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.operators import discovery
from rowscribe.functions import jsonx, progress, prompts, text, vectors


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_clean_cell_markers_and_space(spark):
    values = [None, "", "   ", "NaN", "None", "null", "N/A", "na", "-", "0", " text\t", " нет　", "n/a yes", "--"]
    got = column(spark, values, text.clean_cell)
    assert got == [None] * 9 + ["0", "text", "нет", "n/a yes", "--"]


def test_strip_matches_python(spark):
    values = [f"{ch}a{ch} b{ch}" for ch in K.WHITESPACE]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_squash_matches_python(spark):
    values = [f"{ch} a{ch}{ch}b \n c{ch}" for ch in K.WHITESPACE] + ["", "  ", "plain"]
    assert column(spark, values, text.squash) == [" ".join(v.split()) for v in values]


def test_file_stem(spark):
    values = ["a.xlsx", "a.b.xlsx", ".hidden", "name", "/x/y.csv", "name.", " ", None, "d/e/"]
    assert column(spark, values, text.file_stem) == ["a", "a.b", ".hidden", "name", "y", "name.", None, None, "e"]


def test_safe_file_name(spark):
    values = ["a/b:c.txt", "..", None, "x" * 150 + ".csv", "report", " .a. "]
    got = column(spark, values, lambda c: text.safe_file_name(c, "fallback", "xlsx"))
    assert got == ["a_b_c.xlsx", "fallback.xlsx", "fallback.xlsx", "x" * 100 + ".xlsx", "report.xlsx", "a.xlsx"]


def test_mask_secrets(spark):
    values = [
        "Authorization: Bearer abc.def, next",
        "api_key='k1' API-KEY: \"k2\"",
        "{\"password\": \"p\", \"token\":\"t\"}",
        "nothing here",
    ]
    got = column(spark, values, text.mask_secrets)
    assert got == [
        "Authorization: Bearer ***, next",
        "api_key='***' API-KEY: \"***\"",
        "{\"password\": \"***\", \"token\":\"***\"}",
        "nothing here",
    ]


def test_truthy(spark):
    values = ["1", " TRUE ", "off", "0", "maybe", None]
    assert column(spark, values, lambda c: text.truthy(c, True)) == [True, True, False, False, True, True]


def test_visible_step(spark):
    values = ["Обработка 1/2", "На паузе 3/4 ", "Готово", " Готовим файл ", "", None, "Обработка"]
    assert column(spark, values, text.visible_step) == [None, None, None, "Готовим файл", None, None, "Обработка"]


def test_percent_ties_to_even(spark):
    df = spark.createDataFrame([(1, 800), (3, 800), (1, 0), (5, 5)], "p bigint, t bigint")
    got = [r[0] for r in df.select(progress.percent(F.col("p"), F.col("t"))).collect()]
    assert got == [0.12, 0.38, 0.0, 100.0]


def test_clamped_percent(spark):
    df = spark.createDataFrame([(-1, 10), (20, 10), (1, 4), (1, -1)], "p bigint, t bigint")
    assert [r[0] for r in df.select(progress.clamped_percent(F.col("p"), F.col("t"))).collect()] == [0.0, 100.0, 25.0, 0.0]


def test_eta_text(spark):
    values = [None, -1.0, 0.0, 30.4, 59.6, 3599.0, 3600.0, 5400.0, float("inf"), float("nan")]
    got = column(spark, values, progress.eta_text, "double")
    assert got == [
        None,
        None,
        None,
        "Осталось ~30 сек",
        "Осталось ~1 мин",
        "Осталось ~60 мин",
        "Осталось ~1 ч",
        "Осталось ~1 ч 30 мин",
        None,
        None,
    ]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0, 5.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.5**0.5, 0.0])


def test_object_or_empty(spark):
    values = ['{"a":1}', "[1]", "3", "", None, "broken", " {} "]
    assert column(spark, values, jsonx.object_or_empty) == ['{"a":1}', "{}", "{}", "{}", "{}", "{}", " {} "]


def plain_cells(found):
    return {key: None if value is None else value.toPython() for key, value in found.items()}


def test_flatten_any_depth(spark):
    deep = {"z": 1, "a": {"c": {"b": {"d": {"e": {"f": 1}}}, "a": 0.5}}, "l": ["x", None, 2], "n": None, "t": True, "o": {}, "a.c.a": "later"}
    df = spark.createDataFrame([(json.dumps(deep),), ("[]",), (None,), ('{"s":"1","b":12345678901234567890}',)], "t string")
    assert discovery.depth_of(df, F.col("t")) == 5 and discovery.depth_of(df.filter("t LIKE '{\"s%'"), F.col("t")) == 0
    flat = jsonx.flatten_object(F.col("t"), 5)
    got = [plain_cells(r[0]) for r in df.select(flat).collect()]
    # Source order, types kept; of a key met twice the place of the first and the value of the last.
    assert df.select(F.map_keys(flat)).first()[0] == ["z", "a.c.b.d.e.f", "a.c.a", "l", "n", "t"]
    assert got[0] == {"z": 1, "a.c.b.d.e.f": 1, "a.c.a": "later", "l": ["x", None, 2], "n": None, "t": True}
    assert got[1:3] == [{}, {}] and got[3]["s"] == "1" and int(got[3]["b"]) == 12345678901234567890


def test_cells_keep_their_type(spark):
    text_in = '{"i":9,"f":4.75,"w":1.0,"t":true,"s":"9","l":["a",null,true,1.5,{"k":1}],"e":[],"n":null}'
    flat = jsonx.flatten_object(F.col("t"), 0)
    kinds = {"i": "bigint", "f": "double", "w": "double", "t": "boolean", "s": "string", "l": "string", "e": "string", "n": "string"}
    row = spark.createDataFrame([(text_in,)], "t string").select(*[jsonx.cell(flat[k], kind).alias(k) for k, kind in kinds.items()]).first()
    assert tuple(row) == (9, 4.75, 1.0, True, "9", 'a, True, 1.5, {"k":1}', "", None)
    assert discovery.column_type(["BIGINT", "VOID"]) == "bigint" and discovery.column_type(["BIGINT", "DECIMAL"]) == "double"
    assert discovery.column_type(["BIGINT", "STRING"]) == "variant" and discovery.column_type(["VOID"]) == "string"


def test_text_list(spark):
    values = ['["a","",null,"b"]', "raw note", "", None, '{"a":1}', "[]", '["0",0]']
    got = column(spark, values, jsonx.text_list)
    assert got == [["a", "b"], ["raw note"], [], [], ['{"a":1}'], [], ["0"]]


def test_pick_keys_keeps_values_and_order(spark):
    text_in = '{"x":1.0,"b":{"z":1,"a":2.50},"skip":1,"q":"say \\"hi\\"","n":null}'
    got = column(spark, [text_in], lambda c: jsonx.pick_keys(c, ["n", "q", "b", "x"]))
    assert got == ['{"x":1.0,"b":{"z":1,"a":2.5},"q":"say \\"hi\\"","n":null}']


def test_preview_merge(spark):
    df = spark.createDataFrame(
        [('{"a":"1","b":"2"}', '{"b":"3","c":"4"}', '{"c":{"d":5},"a":"6"}', "g1")], "i string, p string, c string, g string"
    )
    plain, grouped, fallback = df.select(
        jsonx.row_preview(F.col("i"), F.col("p"), F.col("c"), depth=1),
        jsonx.row_preview(F.col("i"), F.col("p"), F.col("c"), "b", F.col("g"), depth=1),
        jsonx.row_preview(F.col("i"), F.col("p"), F.col("c"), "zone", F.col("g"), depth=1),
    ).first()
    assert plain_cells(plain) == {"a": "6", "b": "3", "c": "4", "c.d": 5}
    assert plain_cells(grouped) == {"b": "3", "c.d": 5, "a": "6"}
    assert plain_cells(fallback) == {"zone": "g1", "c.d": 5, "a": "6"}


KEY = dict(provider="p", model="m", mode="custom", prompt_template="t")


def keys_of(spark, value="text", **changes):
    args = {**KEY, "template": None, "schema": None, **changes}
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c.alias(n) for n, c in prompts.cache_keys(F.col("v"), **args).items()]).first().asDict()


def test_cache_key_properties(spark):
    base = keys_of(spark)
    assert keys_of(spark) == base
    assert all(len(v) == 64 for v in base.values())
    assert keys_of(spark, template={}, schema={}) == base
    one, two = {"a": 1, "b": 2}, {"b": 2, "a": 1}
    assert keys_of(spark, template=one) == keys_of(spark, template=two)
    for change in (dict(provider="q"), dict(model="n"), dict(mode="x"), dict(prompt_template="u"), dict(template=one), dict(schema=one)):
        assert keys_of(spark, **change)["cache_key"] != base["cache_key"]
    other = keys_of(spark, value="other")
    assert other["review_hash"] != base["review_hash"] and other["prompt_hash"] == base["prompt_hash"]


def test_prompt_rendering(spark):
    one = lambda wording, **kw: column(spark, ['{"a":1}'], lambda c: prompts.render_prompt(wording, c, **kw))[0]
    assert one("x {row_json} y {row_json}") == 'x {"a":1} y {"a":1}'
    assert one("ask  ") == f'ask\n\n{K.DATA_HEADING}\n{{"a":1}}'
    full = one("ask {row_json} ", template={"f": {"type": "string"}})
    assert full.startswith('ask {"a":1}\n\n') and full.endswith('"type": "string"\n  }\n}\n')
    assert column(spark, [None], lambda c: prompts.render_prompt("q {row_json}", c)) == ["q {}"]


def test_feedback_is_cut(spark):
    long = "y" * 600
    got = column(spark, [long, "", None], lambda c: prompts.with_feedback(F.lit("ask \n"), F.lit("bad"), c))
    assert "y" * 500 + "…\n" in got[0] and "y" * 501 not in got[0]
    assert got[1] == got[2] == f"ask\n\n{K.FEEDBACK_INTRO}\n{K.FEEDBACK_REASON}bad\n{K.FEEDBACK_OUTRO}\n"
