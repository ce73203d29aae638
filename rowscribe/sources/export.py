"""Report exports as tables: wide results, summary, prompt example, raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.functions import jsonx
from rowscribe.operators.discovery import ANSWER, PASSTHROUGH, answer_text, cell_table, depth_of, named_columns, result_keys
from rowscribe.operators.groups import first_row_per_group, number_groups
from rowscribe.operators.reports import report_summary
from rowscribe.operators.rows import is_materialized


def _column(rows: DataFrame, *names: str, kind: str = "string") -> Column:
    found = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def finished_rows(rows: DataFrame) -> DataFrame:
    """Rows that have an outcome; waiting rows never reach the wide export."""
    done = is_materialized(
        _column(rows, "status"),
        _column(rows, "custom_json"),
        _column(rows, "analysis_json"),
        _column(rows, "error_text", "error"),
    )
    return rows.filter(done)


def _typed(names: list[str] | dict[str, str]) -> dict[str, str]:
    return names if isinstance(names, dict) else dict.fromkeys(names, "variant")


def wide_results(
    rows: DataFrame,
    group_by: str | None = None,
    carried: list[str] | dict[str, str] | None = None,
    answered: list[str] | dict[str, str] | None = None,
) -> DataFrame:
    """One wide row per row or group: number, carried keys, answer keys, notes.

    ``carried`` and ``answered`` name keys, with a type each or as VARIANT; keys that
    are not given are found by one aggregation, with the type that keeps all their
    values. Numbers and flags stay what they are, lists are joined to one text. An
    answer key that repeats an earlier column name is written as ``answer.<key>``.
    """
    done = finished_rows(rows)
    if carried is None or answered is None:
        found = named_columns(result_keys(done, group_by))
        carried = found[PASSTHROUGH] if carried is None else carried
        answered = found[ANSWER] if answered is None else answered
    carried, answered = _typed(carried), _typed(answered)
    chosen = first_row_per_group(done, ["group_key"]) if "group_key" in rows.columns else done
    number = "row_number"
    if group_by:
        chosen, number = number_groups(chosen), "group_number"
    # A key opens as many objects as it has dots at most.
    depth = max((key.count(".") for key in answered), default=0)
    flat = chosen.withColumn("_in", jsonx.as_variants(F.col("passthrough_json"))).withColumn("_out", jsonx.flatten_object(answer_text(rows), depth))
    taken = {number, "warnings", "error", *carried}
    notes = (
        F.col("warnings") if "warnings" in rows.columns else jsonx.text_list(_column(rows, "warnings_json"))
    )
    return flat.select(
        F.col(number),
        *[jsonx.cell(F.element_at("_in", F.lit(k)), kind).alias(k) for k, kind in carried.items()],
        *[jsonx.cell(F.element_at("_out", F.lit(k)), kind).alias(k if k not in taken else f"answer.{k}") for k, kind in answered.items()],
        F.array_join(F.coalesce(notes, F.array().cast("array<string>")), ", ").alias("warnings"),
        _column(rows, "error", "error_text").alias("error"),
    )


def long_results(rows: DataFrame, group_by: str | None = None) -> DataFrame:
    """row_number, position, key and value (VARIANT) of every answer cell of the wide results, with no list of columns."""
    done = finished_rows(rows)
    chosen = first_row_per_group(done, ["group_key"]) if "group_key" in rows.columns else done
    number = "row_number"
    if group_by:
        chosen, number = number_groups(chosen), "group_number"
    # The depth is looked for in the rows as they are read, not behind the choice of first rows.
    return cell_table(chosen, [number], answer_text(rows), depth_of(done, answer_text(rows)))


def export_summary(rows: DataFrame, partial: bool = False) -> DataFrame:
    """The summary of an export; a running report says so and has no row total done."""
    total = report_summary(rows)
    if partial:
        return total.withColumn("partial", F.lit(True))
    return total.select("total_rows", F.col("total_rows").alias("processed_rows"), "success_rows", "failed_rows")


def summary_table(summary: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value) lines; nested values as JSON."""
    nested = ("array", "map", "struct")

    def text(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return F.to_json(column) if kind.startswith(nested) else column.cast("string")

    pairs = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"), text(n, k).alias("value"))
        for i, (n, k) in enumerate(summary.dtypes)
    ]
    return summary.select(F.explode(F.array(*pairs)).alias("line")).select("line.*")


def raw_rows(rows: DataFrame) -> DataFrame:
    """All rows, waiting ones too, without the packed input."""
    return rows.drop("input_json")


def raw_metadata(spark: SparkSession, provider: str, model: str, prompt: str, version: str) -> DataFrame:
    one = spark.range(1)
    return one.select(
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp_utc"),
        F.lit(prompt).alias("prompt_template"),
        F.lit(version).alias("app_version"),
    )


def write_export(
    rows: DataFrame,
    folder: str,
    *,
    group_by: str | None = None,
    prompt_example: str | None = None,
    partial: bool = False,
    file_format: str = "parquet",
) -> None:
    """Write ``results``, ``summary`` and, if given, ``prompt_example``."""
    spark = rows.sparkSession
    write = lambda df, name: df.write.mode("overwrite").format(file_format).option("header", "true").save(
        f"{folder}/{name}"
    )
    write(wide_results(rows, group_by), "results")
    write(summary_table(export_summary(rows, partial)), "summary")
    if prompt_example:
        line = spark.range(1).select(F.lit("prompt").alias("name"), F.lit(prompt_example).alias("value"))
        write(line, "prompt_example")


def write_raw(rows: DataFrame, folder: str, provider: str, model: str, prompt: str, version: str) -> None:
    """Write the raw rows as JSON lines next to a one-line metadata table."""
    raw_rows(rows).write.mode("overwrite").json(f"{folder}/rows")
    raw_metadata(rows.sparkSession, provider, model, prompt, version).write.mode("overwrite").json(
        f"{folder}/metadata"
    )
