"""Answer templates: what a user writes, compiled to a schema of constraints.

A template maps each answer field to a description such as
``{"type": "number", "min": 0, "max": 1}``. The compiled schema is plain data;
:mod:`rowscribe.functions.validation` turns it into column expressions and
:func:`spark_type` into the type of the parsed answer.
"""

from __future__ import annotations

from pyspark.sql import types as T


class TemplateError(ValueError):
    """The template itself is wrong."""


def _whole(value: object) -> bool:
    return isinstance(value, int)


def _numeric(value: object) -> bool:
    return isinstance(value, (int, float))


def _bounds(name: str, spec: dict, low: str, high: str, check, floors=(None, None)) -> dict:
    """The two limits of a field, each checked alone and then against each other."""
    found = {}
    for key, floor in zip((low, high), floors):
        value = spec.get(key)
        if value is None:
            continue
        if not check(value) or (floor is not None and value < floor):
            raise TemplateError(f"field '{name}': bad {key}: {value!r}")
        found[key] = value
    if len(found) == 2 and float(found[low]) > float(found[high]):
        raise TemplateError(f"field '{name}': {low} is above {high}")
    return found


def _enum(name: str, spec: dict) -> dict:
    values = spec.get("values")
    if not isinstance(values, list) or not values:
        raise TemplateError(f"field '{name}': enum needs a list of values")
    words = [str(v).strip() for v in values]
    if not all(words):
        raise TemplateError(f"field '{name}': enum has blank values")
    return {"type": "string", "enum": words}


def _text(name: str, spec: dict) -> dict:
    return {"type": "string", **_bounds(name, spec, "min_length", "max_length", _whole, (0, 1))}


def _number(name: str, spec: dict) -> dict:
    limits = _bounds(name, spec, "min", "max", _numeric)
    renamed = {"min": "minimum", "max": "maximum"}
    return {"type": _kind(spec), **{renamed[k]: v for k, v in limits.items()}}


def _array(name: str, spec: dict) -> dict:
    if not isinstance(spec.get("items"), dict):
        raise TemplateError(f"field '{name}': array needs an items description")
    return {
        "type": "array",
        "items": _field(f"{name}[]", spec["items"]),
        **_bounds(name, spec, "min_items", "max_items", _whole, (0, 0)),
    }


def _object(name: str, spec: dict) -> dict:
    children = spec.get("properties")
    if children is None:
        return {"type": "object"}
    if not isinstance(children, dict) or not children:
        raise TemplateError(f"field '{name}': properties must be a filled object")
    properties = {str(c): _field(f"{name}.{c}", s) for c, s in children.items()}
    required = spec.get("required")
    if required is None:
        required = list(properties)
    elif not isinstance(required, list):
        raise TemplateError(f"field '{name}': required must be a list")
    required = [str(r) for r in required]
    unknown = [r for r in required if r not in properties]
    if unknown:
        raise TemplateError(f"field '{name}': required names unknown fields {unknown}")
    return {"type": "object", "properties": properties, "required": required}


_KINDS = {
    "enum": _enum,
    "string": _text,
    "date": lambda name, spec: {"type": "string", "format": "date"},
    "datetime": lambda name, spec: {"type": "string", "format": "date-time"},
    "number": _number,
    "integer": _number,
    "boolean": lambda name, spec: {"type": "boolean"},
    "array": _array,
    "object": _object,
}


def _kind(spec: dict) -> str:
    return str(spec.get("type") or "").strip().lower()


def _field(name: str, spec: object) -> dict:
    if not isinstance(spec, dict):
        raise TemplateError(f"field '{name}': description must be an object")
    if not _kind(spec):
        raise TemplateError(f"field '{name}': type is missing")
    if _kind(spec) not in _KINDS:
        raise TemplateError(f"field '{name}': unknown type {_kind(spec)!r}")
    return _KINDS[_kind(spec)](name, spec)


def compile_template(template: dict) -> dict:
    """The schema of a whole answer; every top-level field is required."""
    if not template:
        raise TemplateError("the template is empty")
    for key in template:
        if not isinstance(key, str) or not key.strip():
            raise TemplateError("the template has a blank key")
    return {
        "type": "object",
        "properties": {key: _field(key, spec) for key, spec in template.items()},
        "required": list(template),
    }


def spark_type(schema: dict) -> T.DataType:
    """The Spark type of a checked answer; free objects stay as VARIANT."""
    kind = schema.get("type")
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "object":
        if not schema.get("properties"):
            return T.VariantType()
        return T.StructType(
            [T.StructField(name, spark_type(child)) for name, child in schema["properties"].items()]
        )
    simple = {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
    return simple.get(kind, T.StringType())
