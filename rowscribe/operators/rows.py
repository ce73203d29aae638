"""From a sheet to report rows: cleaning, packing, group keys, row tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx
from rowscribe.functions.text import clean_cell, is_blank, strip


def review_text(cells: dict[str, Column]) -> Column:
    """Filled cells as ``name: value`` lines; null when there is none."""
    lines = [F.when(cell.isNotNull(), F.concat(F.lit(f"{name}: "), cell)) for name, cell in cells.items()]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def packed(cells: dict[str, Column]) -> Column:
    """Cells as a JSON object in column order, nulls kept."""
    if not cells:
        return F.lit("{}")
    fields = [cell.alias(name) for name, cell in cells.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def row_warnings(cells: dict[str, Column]) -> Column:
    """Warnings of all cleaned analysis cells, each once."""
    found = F.array(*[F.when(cell.isNull(), F.lit("empty_cell")) for cell in cells.values()])
    return F.array_distinct(F.array_compact(found))


def resolve_columns(
    available: list[str], analysis: list[str], passthrough: list[str] | None = None, group_by: str | None = None
) -> tuple[list[str], list[str], str | None]:
    """Check the column choice of a job before a plan is built.

    A grouped job needs its group column among the analysis columns and carries
    only that one through.
    """
    analysis = [c for c in analysis if c]
    carried = [c for c in passthrough or [] if c]
    if not analysis:
        raise ValueError("choose at least one analysis column")
    missing = [c for c in [*analysis, *carried] if c not in available]
    if missing:
        raise ValueError(f"unknown column: {missing[0]}")
    group_by = (group_by or "").strip() or None
    if group_by and group_by not in analysis:
        raise ValueError("the group column must be one of the analysis columns")
    return analysis, [group_by] if group_by else carried, group_by


def with_group_key(rows: DataFrame, group_by: str) -> DataFrame:
    """Group key from the cleaned input; a blank one becomes a key of its own."""
    raw = F.element_at(jsonx.as_map(F.col("input_json")), F.lit(group_by))
    blank = is_blank(raw)
    own = F.concat(F.lit("__missing__:"), F.col("row_number").cast("string"))
    noted = F.array_distinct(F.array_append("warnings", F.lit("group_key_missing")))
    return rows.withColumn("group_key", F.when(blank, own).otherwise(strip(raw))).withColumn(
        "warnings", F.when(blank, noted).otherwise(F.col("warnings"))
    )


def build_rows(
    sheet: DataFrame, analysis: list[str], passthrough: list[str] | None = None, group_by: str | None = None
) -> DataFrame:
    """Report rows of a sheet that has a ``row_number`` column; no shuffle."""
    columns = [c for c in sheet.columns if c != "row_number"]
    analysis, carried, group_by = resolve_columns(columns, analysis, passthrough, group_by)
    # Cells are cleaned in a step of their own, once for all uses.
    tidy = sheet.select(
        "row_number",
        *[clean_cell(F.col(f"`{c}`")).alias(f"_a{i}") for i, c in enumerate(analysis)],
        *[strip(F.col(f"`{c}`").cast("string")).alias(f"_p{i}") for i, c in enumerate(carried)],
    )
    cells = {c: F.col(f"_a{i}") for i, c in enumerate(analysis)}
    rows = tidy.select(
        "row_number",
        review_text(cells).alias("review_text"),
        packed(cells).alias("input_json"),
        packed({c: F.col(f"_p{i}") for i, c in enumerate(carried)}).alias("passthrough_json"),
        row_warnings(cells).alias("warnings"),
    )
    if group_by:
        return with_group_key(rows, group_by)
    return rows.withColumn("group_key", F.lit(None).cast("string"))


def first_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` data rows, by row number (no sort)."""
    return rows.filter(F.col("row_number") < K.FIRST_DATA_ROW + max_rows)


def skips_model(review: Column, input_json: Column) -> Column:
    """Rows without text and without any input value never reach the model."""
    no_text = F.coalesce(review, F.lit("")) == ""
    no_input = F.coalesce(input_json, F.lit("")) == ""
    nothing_in_it = jsonx.is_object(input_json) & jsonx.empty_input(input_json)
    return no_text & (no_input | nothing_in_it)


def is_materialized(status: Column, custom: Column, legacy: Column, error: Column) -> Column:
    """Does a row have an outcome? A known status decides, else the data."""
    by_data = custom.isNotNull() | legacy.isNotNull() | (F.coalesce(error, F.lit("")) != "")
    return (
        F.when(status.isin(K.FINISHED_ROW_STATUSES), F.lit(True))
        .when(status.isin(K.UNFINISHED_ROW_STATUSES), F.lit(False))
        .otherwise(by_data)
    )


def is_previewable(status: Column, custom: Column, legacy: Column, error: Column) -> Column:
    """The looser test of previews: finished, or any result, or any error."""
    finished = F.coalesce(status.isin(K.FINISHED_ROW_STATUSES), F.lit(False))
    return finished | custom.isNotNull() | legacy.isNotNull() | (F.coalesce(error, F.lit("")) != "")
