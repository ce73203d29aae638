"""Progress numbers and texts of a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe import constants as K


def percent(processed: Column, total: Column) -> Column:
    """Share done in percent, two decimals (ties to even); 0 for an empty job."""
    share = processed.cast("double") / F.nullif(total, F.lit(0)) * 100
    return F.when(total != 0, F.bround(share, 2)).otherwise(F.lit(0.0))


def clamped_percent(processed: Column, total: Column) -> Column:
    """The heartbeat's copy: negative inputs count as 0, result within 0..100."""
    done = F.greatest(processed, F.lit(0)).cast("double")
    whole = F.greatest(total, F.lit(0))
    share = done * 100 / F.nullif(whole, F.lit(0))
    return F.when(whole > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), share))).otherwise(0.0)


def eta_seconds(elapsed: Column, processed: Column, total: Column, already: Column) -> Column:
    """Mean seconds per row of this run times the rows left, one decimal."""
    left = F.greatest(F.lit(0), total - processed)
    mean = elapsed / F.greatest(F.lit(1), processed - already)
    return F.when(left > 0, F.bround(mean * left, 1)).otherwise(F.lit(0.0))


def eta_text(seconds: Column) -> Column:
    """``~n`` seconds, minutes, or hours and minutes; null when nothing is left."""
    total = F.floor(seconds + 0.5)
    minutes = F.floor(total / 60 + 0.5)
    hours = F.floor(total / 3600)
    rest = F.floor((total - hours * 3600) / 60 + 0.5)
    text = lambda n: n.cast("bigint").cast("string")
    whole_hours = F.concat(F.lit(K.ETA_PREFIX), text(hours), F.lit(K.ETA_HOURS))
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(
        usable,
        F.when(total < 60, F.concat(F.lit(K.ETA_PREFIX), text(total), F.lit(K.ETA_SECONDS)))
        .when(total < 3600, F.concat(F.lit(K.ETA_PREFIX), text(minutes), F.lit(K.ETA_MINUTES)))
        .when(rest > 0, F.concat(whole_hours, F.lit(" "), text(rest), F.lit(K.ETA_MINUTES)))
        .otherwise(whole_hours),
    )


def is_grouped(group_by: Column, group_total: Column) -> Column:
    return (F.coalesce(group_by, F.lit("")) != "") & (F.coalesce(group_total, F.lit(0)) > 0)


def effective_progress(
    group_by: Column, group_done: Column, group_total: Column, rows_done: Column, rows_total: Column
) -> dict[str, Column]:
    """Count groups for a grouped report that has groups, rows otherwise."""
    grouped = is_grouped(group_by, group_total)
    zero = F.lit(0)
    done = F.when(grouped, F.coalesce(group_done, zero)).otherwise(F.coalesce(rows_done, zero))
    total = F.when(grouped, F.coalesce(group_total, zero)).otherwise(F.coalesce(rows_total, zero))
    share = F.when(total > 0, done.cast("double") / F.nullif(total, zero) * 100).otherwise(0.0)
    return {"is_grouped": grouped, "processed": done, "total": total, "percent": share}
