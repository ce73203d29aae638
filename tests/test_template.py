"""Template compiler and answer checks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowscribe.functions.template import TemplateError, compile_template, spark_type
from rowscribe.functions.validation import accepted_answer, answer_error, extra_keys_warning


def test_compiles_every_kind():
    schema = compile_template(
        {
            "e": {"type": " ENUM ", "values": [" a ", 1]},
            "s": {"type": "string", "min_length": 0, "max_length": 3},
            "n": {"type": "number", "min": 0, "max": 1.5},
            "i": {"type": "integer", "min": 1},
            "b": {"type": "boolean"},
            "d": {"type": "date"},
            "t": {"type": "datetime"},
            "a": {"type": "array", "items": {"type": "number"}, "min_items": 1, "max_items": 2},
            "o": {"type": "object", "properties": {"x": {"type": "string"}}},
            "f": {"type": "object"},
        }
    )
    assert schema["required"] == list("esnibdtaof")
    props = schema["properties"]
    assert props["e"] == {"type": "string", "enum": ["a", "1"]}
    assert props["s"] == {"type": "string", "min_length": 0, "max_length": 3}
    assert props["n"] == {"type": "number", "minimum": 0, "maximum": 1.5}
    assert props["d"] == {"type": "string", "format": "date"}
    assert props["t"] == {"type": "string", "format": "date-time"}
    assert props["a"] == {"type": "array", "items": {"type": "number"}, "min_items": 1, "max_items": 2}
    assert props["o"] == {"type": "object", "properties": {"x": {"type": "string"}}, "required": ["x"]}
    assert props["f"] == {"type": "object"}
    assert spark_type(schema).simpleString() == (
        "struct<e:string,s:string,n:double,i:bigint,b:boolean,d:string,t:string,a:array<double>,"
        "o:struct<x:string>,f:variant>"
    )


@pytest.mark.parametrize(
    "template",
    [
        {},
        {" ": {"type": "string"}},
        {"a": "string"},
        {"a": {}},
        {"a": {"type": "money"}},
        {"a": {"type": "enum", "values": []}},
        {"a": {"type": "enum", "values": ["x", " "]}},
        {"a": {"type": "string", "min_length": -1}},
        {"a": {"type": "string", "max_length": 0}},
        {"a": {"type": "string", "min_length": 5, "max_length": 4}},
        {"a": {"type": "number", "min": "0"}},
        {"a": {"type": "integer", "min": 2, "max": 1}},
        {"a": {"type": "array"}},
        {"a": {"type": "array", "items": {"type": "string"}, "min_items": 3, "max_items": 2}},
        {"a": {"type": "object", "properties": {}}},
        {"a": {"type": "object", "properties": {"x": {"type": "string"}}, "required": ["y"]}},
        {"a": {"type": "object", "properties": {"x": {"type": "string"}}, "required": "x"}},
    ],
)
def test_rejects(template):
    with pytest.raises(TemplateError):
        compile_template(template)


def errors(spark, template, answers, schema=None):
    schema = compile_template(template) if schema is None else schema
    texts = [(i, a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)) for i, a in enumerate(answers)]
    df = spark.createDataFrame(texts, "i int, a string").orderBy("i")
    return [r[0] for r in df.select(answer_error(F.col("a"), schema, template)).collect()]


def check(spark, spec, values):
    """Which values of one field pass?"""
    found = errors(spark, {"f": spec}, [{"f": v} for v in values])
    return [e is None for e in found]


def test_not_an_object(spark):
    template = {"f": {"type": "string"}}
    found = errors(spark, template, ["[]", '"x"', "42", "null", "oops"])
    assert set(found) == {"Ожидался JSON-объект в ответе модели"}


def test_echo_required_and_extra(spark):
    template = {"a": {"type": "string"}, "b": {"type": "string"}}
    found = errors(spark, template, [{"x": 1}, {"a": "1"}, {"a": "1", "b": None}, {"b": "2", "a": "1", "x": 1}])
    assert found == [
        "Модель вернула входные данные вместо результата по Ожидаемому JSON",
        "В ответе отсутствует обязательное поле: b",
        "В ответе отсутствует обязательное поле: b",
        None,
    ]
    df = spark.createDataFrame([('{"x1":1,"b":"2","x2":1,"x3":1,"x4":1,"x5":1,"x6":1,"a":"1"}',), ('{"a": "1"}',)], "a string")
    rows = df.select(extra_keys_warning(F.col("a"), template), accepted_answer(F.col("a"), template)).collect()
    assert rows[0][0] == "dropped_extra_keys:x1,x2,x3,x4,x5"
    assert rows[0][1] == '{"b":"2","a":"1"}'
    assert tuple(rows[1]) == (None, '{"a": "1"}')


def test_optional_field(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "n": {"type": "integer"}}}
    found = errors(spark, None, [{"a": "x"}, {"a": "x", "n": None}, {"a": "x", "n": 1}], schema)
    assert found == [None, "Поле 'n' должно быть целым числом", None]


def test_strings(spark):
    assert check(spark, {"type": "string", "min_length": 2, "max_length": 3}, ["a", "ab", "абв", "abcd", 5]) == [False, True, True, False, False]
    assert check(spark, {"type": "enum", "values": ["x", "y"]}, ["x", "X", 1]) == [True, False, False]


def test_numbers(spark):
    assert check(spark, {"type": "number", "min": 0, "max": 1}, [0, 1.0, 1.01, -0.1, True, "1"]) == [True, True, False, False, True, False]
    assert check(spark, {"type": "integer"}, [3, 1.0, 1.5, True, "1", 123456789012345678901234]) == [True, False, False, True, False, True]
    assert check(spark, {"type": "boolean"}, [True, 1, "true"]) == [True, False, False]


def test_dates(spark):
    days = ["2024-02-29", "2023-02-29", "2024-2-3", "20240203", "2024-13-01", ""]
    assert check(spark, {"type": "date"}, days) == [True, False, False, False, False, False]
    stamps = ["2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02", "2024-01-02T25:00:00", "yesterday", "2024-01-02T03:04:05.123+03:00", "2024-01-02T03:60"]
    assert check(spark, {"type": "datetime"}, stamps) == [True, True, True, False, False, True, False]


def test_arrays_and_objects(spark):
    spec = {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer", "max": 5}}}, "min_items": 1, "max_items": 2}
    found = errors(spark, {"f": spec}, [{"f": v} for v in ([], [{"n": 1}], [{"n": 1}, {"n": 9}], [{"n": 1}, {}], [1], {}, [{"n": 1}] * 3)])
    assert found == [
        "Поле 'f' должно содержать не менее 1 элементов",
        None,
        "Поле 'f[1].n' должно быть <= 5",
        "Поле 'f[1]' должно содержать обязательные ключи: n",
        "Поле 'f[0]' должно быть объектом",
        "Поле 'f' должно быть массивом",
        "Поле 'f' должно содержать не более 2 элементов",
    ]


def test_cyrillic_and_dotted_keys(spark):
    template = {"число нарушений": {"type": "integer"}, "a.b": {"type": "string"}, "it's": {"type": "boolean"}}
    found = errors(spark, template, [{"число нарушений": 1, "a.b": "x", "it's": True}, {"число нарушений": "1", "a.b": "x", "it's": True}])
    assert found == [None, "Поле 'число нарушений' должно быть целым числом"]
