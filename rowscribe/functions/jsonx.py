"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe.functions.text import strip


def is_object(text: Column) -> Column:
    """True for text that parses to a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def object_or_empty(text: Column) -> Column:
    """The text if it is a JSON object, else ``{}`` (blank, broken, other types)."""
    return F.when(is_object(text), text).otherwise(F.lit("{}"))


def object_or_null(text: Column) -> Column:
    return F.when(is_object(text), text)


def as_map(text: Column) -> Column:
    """A flat object as an ordered string map; empty for anything else."""
    parsed = F.from_json(object_or_empty(text), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def text_list(text: Column) -> Column:
    """Stored warnings: a JSON list, or one raw string; blanks are dropped.

    List items that JSON counts as false (null, "", 0, false) are dropped too.
    """
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    words = F.transform(parsed, lambda v: F.try_variant_get(v, "$", "string"))
    kinds = F.transform(parsed, F.schema_of_variant)
    pairs = F.arrays_zip(words.alias("word"), kinds.alias("kind"))
    kept = F.filter(
        pairs,
        lambda p: p["word"].isNotNull()
        & (p["word"] != "")
        & ~((p["kind"] != "STRING") & p["word"].isin("0", "false")),
    )
    listed = F.transform(kept, lambda p: p["word"])
    empty = F.array().cast("array<string>")
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", empty).otherwise(
        F.coalesce(listed, F.array(text))
    )


def setting_list(text: Column) -> Column:
    """A stored list of column names: blank items dropped, empty when unreadable."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    words = F.transform(parsed, lambda v: F.try_variant_get(v, "$", "string"))
    kept = F.filter(words, lambda w: strip(w) != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def usage(raw: Column, field: str) -> Column:
    """``raw.usage.<field>`` as an integer, 0 when missing."""
    value = F.try_variant_get(F.try_parse_json(raw), f"$.usage.{field}", "int")
    return F.coalesce(value, F.lit(0))


def has_usage(raw: Column) -> Column:
    node = F.try_variant_get(F.try_parse_json(raw), "$.usage", "variant")
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def fallback_prompt_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one, when usage is missing."""
    quarter = F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)
    return F.greatest(F.lit(1), quarter).cast("int")


def quoted(value: Column) -> Column:
    """A string column as a JSON string literal."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def pick_keys(text: Column, keys: list[str]) -> Column:
    """The object reduced to ``keys``, in its own key order, values unchanged."""
    words = F.from_json(text, "map<string,string>")
    kinds = F.from_json(text, "map<string,variant>")
    kept = F.array_intersect(F.json_object_keys(text), F.array(*[F.lit(k) for k in keys]))

    def entry(key: Column) -> Column:
        word = F.element_at(words, key)
        is_text = F.schema_of_variant(F.element_at(kinds, key)) == "STRING"
        value = F.when(is_text, quoted(word)).otherwise(F.coalesce(word, F.lit("null")))
        return F.concat(quoted(key), F.lit(":"), value)

    return F.concat(F.lit("{"), F.array_join(F.transform(kept, entry), ","), F.lit("}"))


VARIANTS = "map<string,variant>"


def as_variants(text: Column) -> Column:
    """An object's values with their types, in source order; empty for anything else."""
    parsed = F.from_json(object_or_empty(text), VARIANTS)
    return F.coalesce(parsed, F.create_map().cast(VARIANTS))


def kind_of(value: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID, ARRAY or OBJECT; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _fields(text: Column) -> Column:
    """(key, value, inner) of an object in source order; ``inner`` is the text of a value that is an object itself.

    VARIANT sorts the keys of an object, so nested objects are kept as text until
    their own fields are taken.
    """
    words = F.from_json(text, "map<string,string>")
    zipped = F.arrays_zip(
        F.map_keys(words).alias("key"), F.map_values(F.from_json(text, VARIANTS)).alias("value"), F.map_values(words).alias("word")
    )
    inner = lambda f: F.when(kind_of(f["value"]) == "OBJECT", f["word"])
    found = F.transform(zipped, lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value"), inner(f).alias("inner")))
    return F.coalesce(found, F.array().cast("array<struct<key:string,value:variant,inner:string>>"))


def inner_objects(text: Column) -> Column:
    """Texts of the values that are objects."""
    return F.filter(F.transform(_fields(text), lambda f: f["inner"]), lambda t: t.isNotNull())


def flatten_object(text: Column, depth: int) -> Column:
    """An object's values under dotted keys, objects opened ``depth`` levels deep.

    Keys keep their source order and values their types. Of one key met twice the
    later value wins. Text that is no object gives an empty map.
    """
    fields = _fields(object_or_empty(text))
    for _ in range(depth):
        opened = lambda f: F.transform(
            _fields(f["inner"]),
            lambda g: F.struct(F.concat(f["key"], F.lit("."), g["key"]).alias("key"), g["value"].alias("value"), g["inner"].alias("inner")),
        )
        fields = F.flatten(F.transform(fields, lambda f: F.when(f["inner"].isNull(), F.array(f)).otherwise(opened(f))))
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["key"], f["value"])))


def list_text(value: Column) -> Column:
    """A list as one cell: its items that are not null, joined by a comma; null for other values."""
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: kind_of(v) != "VOID")
    word = lambda v: F.try_variant_get(v, "$", "string")
    return F.array_join(F.transform(items, lambda v: F.when(kind_of(v) == "BOOLEAN", F.initcap(word(v))).otherwise(word(v))), ", ")


def cell(value: Column, kind: str = "variant") -> Column:
    """A value as a cell of a type; lists are text. A value of another type is null in it."""
    joined = kind_of(value) == "ARRAY"
    if kind == "variant":
        return F.when(joined, list_text(value).cast("variant")).otherwise(F.when(kind_of(value) != "VOID", value))
    if kind == "string":
        return F.when(joined, list_text(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return F.try_variant_get(value, "$", kind)


def analysis_text(custom: Column, legacy: Column | None = None) -> Column:
    """The answer if it is a non-empty object, else the older answer column."""
    filled = F.size(F.json_object_keys(custom)) > 0
    other = F.lit("{}") if legacy is None else object_or_empty(legacy)
    return F.when(is_object(custom) & filled, custom).otherwise(other)


def row_preview(
    input_json: Column,
    passthrough_json: Column,
    custom_json: Column,
    group_by: str | None = None,
    group_key: Column | None = None,
    depth: int = 0,
) -> Column:
    """Input, passed-through and answer columns merged, with their types; the later source wins.

    A grouped report keeps only its group column of the source columns, because
    the answer describes the group and not the row that stands for it. Objects in
    the answer are opened ``depth`` levels deep.
    """
    answer = flatten_object(custom_json, depth)
    if group_by is None:
        return F.map_concat(as_variants(input_json), as_variants(passthrough_json), answer)
    name = F.lit(group_by)
    known = lambda text: F.filter(F.array(F.element_at(as_variants(text), name)), lambda v: kind_of(v) != "VOID")
    value = F.coalesce(F.get(known(passthrough_json), F.lit(0)), F.get(known(input_json), F.lit(0)), group_key.cast("variant"))
    head = F.when(value.isNotNull(), F.create_map(name, value)).otherwise(F.create_map().cast(VARIANTS))
    return F.map_concat(head, answer)


def empty_input(input_json: Column) -> Column:
    """No input value at all: every one is null or an empty string."""
    values = F.map_values(as_map(input_json))
    return F.forall(values, lambda v: v.isNull() | (v == ""))
