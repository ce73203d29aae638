"""Changes to stored tables, each giving the next snapshot of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.operators.cache import delete_keys, upsert
from rowscribe.operators.reports import unreferenced_uploads

TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def insert_missing(existing: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet; repeats of a key come once."""
    others = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*keys, "_row.*")
    if existing is not None:
        once = once.join(existing.select(*keys), keys, "left_anti")
    return once.select(*new.columns)


def needs_retry() -> Column:
    skipped = F.exists("warnings", lambda w: w.contains("skipped_large_group"))
    return (F.col("status") == "error") | (
        (F.col("status") == "done") & F.coalesce(skipped, F.lit(False))
    )


def reset_failed_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Failed rows and rows of skipped groups become pending again.

    Answer, error, tokens and warnings are cleared; a caller may ``keep`` some
    warnings. ``was_reset`` marks the changed rows.
    """
    reset = needs_retry()
    kept = F.filter("warnings", lambda w: w.isin(keep)) if keep else F.lit(None)
    cleared = {
        "status": F.lit("pending"),
        "custom_json": F.lit(None).cast("string"),
        "raw_response_json": F.lit(None).cast("string"),
        "error_text": F.lit(None).cast("string"),
        "warnings": kept,
        **{name: F.lit(0) for name in TOKENS},
    }
    marked = rows.withColumn("was_reset", reset)
    changed = {
        name: F.when(F.col("was_reset"), value.cast(rows.schema[name].dataType)).otherwise(F.col(name))
        for name, value in cleared.items()
        if name in rows.columns
    }
    return marked.withColumns(changed)


def reset_terminal_state(reports: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Clear end time and error of the reports that start again."""
    chosen = ids.select("id", F.lit(True).alias("_again")).distinct()
    found = reports.join(chosen, "id", "left")
    again = F.col("_again").isNotNull()
    return (
        found.withColumn("finished_at", F.when(~again, F.col("finished_at")))
        .withColumn("error_text", F.when(~again, F.col("error_text")))
        .withColumn("updated_at", F.when(again, now).otherwise(F.col("updated_at")))
        .drop("_again")
        .select(*reports.columns)
    )


def apply_patch(table: DataFrame, patch: DataFrame, keys: list[str], replaced: list[str] | None = None) -> DataFrame:
    """Columns of ``patch`` over the table; a null keeps the old value.

    ``replaced`` columns are taken even when null. A terminal status without a
    step text gets the default text of that status.
    """
    values = [c for c in patch.columns if c not in keys]
    renamed = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in values], F.lit(True).alias("_hit"))
    found = table.join(renamed, keys, "left")

    def value(name: str) -> Column:
        if name not in values:
            return F.col(name)
        new, old = F.col(f"_p_{name}"), F.col(name)
        if name in (replaced or []):
            return F.when(F.col("_hit"), new).otherwise(old).alias(name)
        if name == "current_step" and "status" in values:
            defaults = F.create_map(*[F.lit(x) for pair in K.TERMINAL_STEPS.items() for x in pair])
            new = F.coalesce(new, F.try_element_at(defaults, F.col("_p_status")))
        return F.coalesce(new, old).alias(name)

    return found.select(*[value(c) for c in table.columns])


def latest_progress(reports: DataFrame, updates: DataFrame) -> DataFrame:
    """Progress columns of the latest update per report over the stored ones.

    Updates replace every progress column, also with null (an unknown ETA).
    """
    columns = [c for c in updates.columns if c not in ("id", "seq")]
    last = updates.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("_last"))
    return apply_patch(reports, last.select("id", "_last.*"), ["id"], replaced=columns)


def with_row_tokens(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Token totals of reports, summed from their rows."""
    sums = rows.groupBy(F.col("report_id").alias("id")).agg(*[F.sum(t).alias(t) for t in TOKENS])
    return reports.drop(*TOKENS).join(sums, "id", "left").fillna(0, TOKENS)


def upsert_presets(presets: DataFrame, fresh: DataFrame) -> DataFrame:
    """Presets by (user, trimmed name); id and creation time of an old one stay."""
    from rowscribe.functions.text import strip

    named = fresh.withColumn("name", strip(F.col("name")))
    return upsert(
        presets,
        named,
        ["user_id", "name"],
        keep={"id": F.col("_new.new_id"), "created_at": F.col("_new.updated_at")},
        order=["updated_at"],
    )


def delete_reports(reports: DataFrame, rows: DataFrame, uploads: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, rows and uploads after a delete.

    Only owners of a deleted report lose their unreferenced uploads.
    """
    left = delete_keys(reports, gone, ["id"])
    # One report may hold most rows; the adaptive join splits it.
    rows_left = delete_keys(rows, gone.select(F.col("id").alias("report_id")), ["report_id"])
    owners = reports.join(gone.select("id").distinct(), "id", "left_semi").select("user_id").distinct()
    orphaned = unreferenced_uploads(uploads, left).join(owners, "user_id", "left_semi")
    return left, rows_left, delete_keys(uploads, orphaned, ["user_id", "id"])
