"""Answer checks as column expressions over VARIANT.

The compiled schema is unrolled once on the driver into one expression that
gives the first error of an answer, so the check runs inside the scan stage
and never leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.binding import let
from rowscribe.functions.jsonx import pick_keys

# Whole numbers beyond 64 bits are typed DECIMAL(19+,0) by the JSON parser.
_BIG_WHOLE = r"^DECIMAL\((19|[23]\d),0\)$"
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|BOOLEAN|DECIMAL.*)$"
_WHOLE = r"^(TINYINT|SMALLINT|INT|BIGINT|BOOLEAN)$"
# Hours, minutes and seconds may be left out from the end; so may the offset.
_CLOCK = r"(?:[01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d+)?)?)?"
_OFFSET = r"[+-](?:[01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d)?)?"
_DATETIME = rf"^\d{{4}}-\d{{2}}-\d{{2}}(.{_CLOCK}({_OFFSET})?)?$"


def _child(node: Column, name: str) -> Column:
    quote = "'" if '"' in name else '"'
    return F.try_variant_get(node, f"$[{quote}{name}{quote}]", "variant")


def _absent(node: Column) -> Column:
    return node.isNull() | F.is_variant_null(node)


def _message(path: Column, template: str, value: object = None) -> Column:
    return F.concat(F.lit(K.MSG_FIELD), path, F.lit(template.replace("{}", str(value))))


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def _as_double(node: Column, kind: Column) -> Column:
    flag = F.try_variant_get(node, "$", "boolean").cast("double")
    return F.when(kind == "BOOLEAN", flag).otherwise(F.try_variant_get(node, "$", "double"))


def _is_date(text: Column) -> Column:
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return shaped & F.try_to_date(text, "yyyy-MM-dd").isNotNull() & ~text.startswith("0000")


def _is_datetime(text: Column) -> Column:
    stamp = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return stamp.rlike(_DATETIME) & _is_date(F.substring(stamp, 1, 10))


def _in_list(node: Column, kind: Column, values: list) -> Column:
    text = F.try_variant_get(node, "$", "string")
    words = [v for v in values if isinstance(v, str)]
    numbers = [float(v) for v in values if isinstance(v, (int, float))]
    tests = []
    if words:
        tests.append((kind == "STRING") & text.isin(words))
    if numbers:
        tests.append(kind.rlike(_NUMERIC) & _as_double(node, kind).isin(numbers))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _text_rules(node: Column, path: Column, schema: dict):
    text = F.try_variant_get(node, "$", "string")
    yield _kind(node) != "STRING", _message(path, K.MSG_STRING)
    if isinstance(schema.get("min_length"), int):
        yield F.length(text) < schema["min_length"], _message(path, K.MSG_MIN_LENGTH, schema["min_length"])
    if isinstance(schema.get("max_length"), int):
        yield F.length(text) > schema["max_length"], _message(path, K.MSG_MAX_LENGTH, schema["max_length"])
    if schema.get("format") == "date":
        yield ~_is_date(text), _message(path, K.MSG_DATE)
    if schema.get("format") == "date-time":
        yield ~_is_datetime(text), _message(path, K.MSG_DATETIME)


def _enum_rules(node: Column, path: Column, schema: dict):
    values = schema.get("enum")
    if isinstance(values, list) and values:
        allowed = "|".join(str(v) for v in values)
        yield ~_in_list(node, _kind(node), values), _message(path, K.MSG_ENUM, allowed)


def _number_rules(node: Column, path: Column, schema: dict):
    kind = _kind(node)
    if schema["type"] == "number":
        yield ~kind.rlike(_NUMERIC), _message(path, K.MSG_NUMBER)
    else:
        yield ~(kind.rlike(_WHOLE) | kind.rlike(_BIG_WHOLE)), _message(path, K.MSG_INTEGER)
    value = _as_double(node, kind)
    if isinstance(schema.get("minimum"), (int, float)):
        yield value < float(schema["minimum"]), _message(path, K.MSG_MINIMUM, schema["minimum"])
    if isinstance(schema.get("maximum"), (int, float)):
        yield value > float(schema["maximum"]), _message(path, K.MSG_MAXIMUM, schema["maximum"])


def _array_rules(node: Column, path: Column, schema: dict):
    items = F.try_variant_get(node, "$", "array<variant>")
    yield ~_kind(node).startswith("ARRAY"), _message(path, K.MSG_ARRAY)
    if isinstance(schema.get("min_items"), int):
        yield F.size(items) < schema["min_items"], _message(path, K.MSG_MIN_ITEMS, schema["min_items"])
    if isinstance(schema.get("max_items"), int):
        yield F.size(items) > schema["max_items"], _message(path, K.MSG_MAX_ITEMS, schema["max_items"])
    if isinstance(schema.get("items"), dict) and schema["items"].get("type"):

        def item_error(item: Column, index: Column) -> Column:
            place = F.concat(path, F.lit("["), index.cast("string"), F.lit("]"))
            return field_error(item, place, schema["items"])

        errors = F.filter(F.transform(items, item_error), lambda e: e.isNotNull())
        first = F.get(errors, F.lit(0))
        yield first.isNotNull(), first


def _object_rules(node: Column, path: Column, schema: dict):
    yield ~_kind(node).startswith("OBJECT"), _message(path, K.MSG_OBJECT)
    required = schema.get("required")
    if isinstance(required, list) and required:
        gaps = F.array_compact(
            F.array(*[F.when(_absent(_child(node, name)), F.lit(name)) for name in required])
        )
        text = F.concat(
            F.lit(K.MSG_FIELD), path, F.lit(K.MSG_OBJECT_KEYS), F.array_join(gaps, ", ")
        )
        yield F.size(gaps) > 0, text
    for name, child in (schema.get("properties") or {}).items():
        error = _present_error(node, F.concat(path, F.lit(f".{name}")), name, child)
        yield error.isNotNull(), error


_RULES = {
    "string": [_text_rules, _enum_rules],
    "number": [_enum_rules, _number_rules],
    "integer": [_enum_rules, _number_rules],
    "boolean": [
        _enum_rules,
        lambda node, path, schema: [(_kind(node) != "BOOLEAN", _message(path, K.MSG_BOOLEAN))],
    ],
    "array": [_array_rules],
    "object": [_object_rules],
}


def _present_error(node: Column, path: Column, name: str, schema: dict) -> Column:
    return let(
        _child(node, name),
        lambda value: F.when(value.isNotNull(), field_error(value, path, schema)),
    )


def field_error(node: Column, path: Column, schema: dict) -> Column:
    """First broken rule of one value, or null."""
    rules = [pair for rule in _RULES.get(schema.get("type"), []) for pair in rule(node, path, schema)]
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(broken, message) for broken, message in rules])


def answer_error(text: Column, schema: dict | None, template: dict | None = None) -> Column:
    """First error of an answer text, or null when it passes.

    With a template at least one of its keys must be there; required fields
    come next in their order, then the fields in schema order.
    """
    if schema and schema.get("type") not in (None, "", "object"):
        raise ValueError("the schema of an answer must describe an object")

    def first_error(node: Column) -> Column:
        steps = [F.when(node.isNull() | ~_kind(node).startswith("OBJECT"), F.lit(K.MSG_NOT_OBJECT))]
        if template:
            known = F.array(*[F.lit(key) for key in template])
            matched = F.arrays_overlap(F.json_object_keys(text), known)
            steps.append(F.when(~F.coalesce(matched, F.lit(False)), F.lit(K.MSG_ECHO)))
        if schema:
            for name in schema.get("required") or []:
                steps.append(F.when(_absent(_child(node, name)), F.lit(K.MSG_MISSING + name)))
            for name, child in (schema.get("properties") or {}).items():
                steps.append(_present_error(node, F.lit(name), name, child))
        return F.coalesce(*steps)

    return let(F.try_parse_json(text), first_error)


def extra_keys_warning(text: Column, template: dict) -> Column:
    """Names of up to five keys that the template does not know, or null."""
    known = F.array(*[F.lit(key) for key in template])
    extra = F.array_except(F.json_object_keys(text), known)
    listed = F.array_join(F.slice(extra, 1, 5), ",")
    return F.when(F.size(extra) > 0, F.concat(F.lit("dropped_extra_keys:"), listed))


def accepted_answer(text: Column, template: dict | None) -> Column:
    """The answer without unknown keys (unchanged when it has none)."""
    if not template:
        return text
    extra = F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in template])))
    return F.when(extra > 0, pick_keys(text, list(template))).otherwise(text)
