"""Which result columns a report has: order of appearance, depth and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx

PASSTHROUGH, ANSWER = "passthrough", "answer"
#: Columns a sheet can have.
MOST_COLUMNS = 16_384
_NUMBERS = {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}


def answer_text(rows: DataFrame) -> Column:
    """The answer of each row, older or newer."""
    return jsonx.analysis_text(F.col("custom_json"), F.col("analysis_json") if "analysis_json" in rows.columns else None)


def depth_of(rows: DataFrame, text: Column) -> int:
    """How many levels of objects lie inside the objects of ``text``, over all rows.

    One scan for each level; all but the last stop at the first row that goes on.
    """
    inner, depth = rows.select(jsonx.inner_objects(jsonx.object_or_empty(text)).alias("inner")), 0
    while not inner.filter(F.size("inner") > 0).isEmpty():
        inner, depth = inner.select(F.flatten(F.transform("inner", jsonx.inner_objects)).alias("inner")), depth + 1
    return depth


def cell_table(rows: DataFrame, ids: list[str], text: Column, depth: int | None = None) -> DataFrame:
    """ids, position, key and value (VARIANT) of every cell of an answer, one row per cell; ``depth`` if it is known."""
    flat = jsonx.flatten_object(text, depth_of(rows, text) if depth is None else depth)
    return rows.select(*ids, F.posexplode(flat).alias("position", "key", "value"))


def first_seen_keys(rows: DataFrame, keys: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct keys with the (row, position) of their first appearance.

    ``keys`` is an array of names, or of structs whose fields tell keys apart.
    ``rows`` must have ``row_number``. The minimum is taken inside each task, so
    only distinct keys are shuffled.
    """
    seen = rows.select(*(by or []), "row_number", F.posexplode(keys).alias("position", "key"))
    first = F.min(F.struct("row_number", "position")).alias("_first")
    return seen.groupBy(*(by or []), "key").agg(first).select(
        *(by or []),
        "key",
        F.col("_first.row_number").alias("first_row"),
        F.col("_first.position").alias("first_position"),
    )


def result_keys(rows: DataFrame, group_by: str | None = None) -> DataFrame:
    """Carried keys and flattened answer keys of finished rows: kind, key, first_row, first_position, types.

    ``types`` are the kinds of values met (a few at most). Reserved names are no
    carried keys; a grouped report carries only its group column.
    """
    answer = answer_text(rows)
    sources = {PASSTHROUGH: jsonx.as_variants(F.col("passthrough_json")), ANSWER: jsonx.flatten_object(answer, depth_of(rows, answer))}

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(F.map_entries(found), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), jsonx.kind_of(e["value"]).alias("type")))

    seen = rows.select("row_number", F.posexplode(F.concat(*[tagged(kind, found) for kind, found in sources.items()])).alias("position", "cell"))
    keys = seen.groupBy("cell.kind", "cell.key").agg(
        F.min(F.struct("row_number", "position")).alias("first"), F.array_sort(F.collect_set("cell.type")).alias("types")
    )
    usable = ~F.col("key").isin(K.RESERVED_KEYS)
    if group_by:
        usable = usable & (F.col("key") == group_by)
    found = keys.filter((F.col("kind") == ANSWER) | usable)
    return found.select("kind", "key", F.col("first.row_number").alias("first_row"), F.col("first.position").alias("first_position"), "types")


def column_type(types: list[str]) -> str:
    """The column type that keeps all values of these kinds; VARIANT if no plain type does."""
    met = set(types) - {"VOID"}
    if met == {"BOOLEAN"}:
        return "boolean"
    if met == {"BIGINT"}:
        return "bigint"
    if met and met <= _NUMBERS:
        return "double"
    return "string" if met <= {"STRING", "ARRAY"} else "variant"


def named_columns(keys: DataFrame, most: int = MOST_COLUMNS) -> dict[str, dict[str, str]]:
    """Names and types per kind, in order of appearance: they become columns.

    More than ``most`` are no columns any more and raise; ``cell_table`` has no limit.
    """
    listed = keys.orderBy("first_row", "first_position", "key").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} result columns: name the columns, or export cells")
    found: dict[str, dict[str, str]] = {PASSTHROUGH: {}, ANSWER: {}}
    for row in listed:
        found[row["kind"]][row["key"]] = column_type(row["types"])
    return found
