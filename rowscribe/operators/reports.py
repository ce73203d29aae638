"""Queries over reports, users, uploads, sessions and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe import constants as K


def is_active(status: Column) -> Column:
    return status.isin(K.ACTIVE_STATUSES)


def group_progress(rows: DataFrame) -> DataFrame:
    """Distinct groups and finished groups per report.

    A group is finished as soon as one of its rows is; one pass over (report,
    group) pairs answers both counts.
    """
    finished = F.coalesce(F.col("status").isin(K.FINISHED_ROW_STATUSES), F.lit(False))
    pairs = (
        rows.filter("group_key IS NOT NULL")
        .groupBy("report_id", "group_key")
        .agg(F.bool_or(finished).alias("finished"))
    )
    return pairs.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("group_total"), F.count_if("finished").alias("group_processed")
    )


def row_progress(rows: DataFrame) -> DataFrame:
    """Rows and finished rows per report."""
    return rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status").isin(K.FINISHED_ROW_STATUSES)).alias("processed_rows"),
    )


def with_source_name(reports: DataFrame, uploads: DataFrame) -> DataFrame:
    names = uploads.select(
        F.col("id").alias("uploaded_file_id"), F.col("original_name").alias("source_original_name")
    )
    # Many reports may share an upload or have none; the adaptive join splits such keys.
    return reports.join(names, "uploaded_file_id", "left")


def report_list(
    reports: DataFrame, uploads: DataFrame, rows: DataFrame, user_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """Reports with their source name and group progress (0 without groups).

    With ``user_id`` only that user's, with ``limit`` only the newest; both are
    chosen before anything is joined or counted.
    """
    reports = owned(reports, user_id)
    if limit is not None:
        reports = newest(reports, limit)
        rows = rows.join(reports.select(F.col("id").alias("report_id")), "report_id", "left_semi")
    progress = group_progress(rows).withColumnRenamed("report_id", "id")
    return (
        with_source_name(reports, uploads)
        .join(progress, "id", "left")
        .fillna(0, ["group_total", "group_processed"])
    )


def newest(df: DataFrame, limit: int, by: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``limit`` records (top-k per task, then once)."""
    return df.orderBy(F.desc(by), F.desc(tie)).limit(limit)


def active_reports(reports: DataFrame) -> DataFrame:
    return reports.filter(is_active(F.col("status")))


def inflight(reports: DataFrame) -> DataFrame:
    """Active reports, oldest first."""
    return active_reports(reports).orderBy("created_at", "id")


def owned(df: DataFrame, user_id: int | None = None, **keys: object) -> DataFrame:
    """Records of an owner, optionally with a given id or job id."""
    found = df if user_id is None else df.filter(F.col("user_id") == user_id)
    for name, value in keys.items():
        found = found.filter(F.col(name) == value)
    return found


def recent_failures(reports: DataFrame, users: DataFrame, limit: int = 30) -> DataFrame:
    """Newest failed reports that say why, with the user's name."""
    failed = reports.filter((F.col("status") == "failed") & (F.coalesce("error_text", F.lit("")) != ""))
    found = failed.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    return newest(
        found.select(
            F.col("id").alias("report_id"), "user_id", "username", "updated_at", "error_text"
        ),
        limit,
        by="updated_at",
        tie="report_id",
    )


def users_overview(
    users: DataFrame, reports: DataFrame, sessions: DataFrame, limit: int | None = None
) -> DataFrame:
    """Reports and last login per user; both sides are aggregated before the join.

    With ``limit`` the newest users are taken first and only their reports and
    sessions are counted.
    """
    if limit is not None:
        users = newest(users, limit)
        chosen = users.select(F.col("id").alias("user_id"))
        reports, sessions = (x.join(chosen, "user_id", "left_semi") for x in (reports, sessions))
    counts = reports.groupBy("user_id").agg(F.count_distinct("id").alias("reports_count"))
    logins = sessions.groupBy("user_id").agg(F.max("created_at").alias("last_login_at"))
    return (
        users.withColumnRenamed("id", "user_id")
        .join(counts, "user_id", "left")
        .join(logins, "user_id", "left")
        .fillna(0, ["reports_count"])
        .withColumnRenamed("user_id", "id")
    )


def status_histogram(reports: DataFrame) -> DataFrame:
    """Queued, running, paused and failed reports in one row, from one scan."""
    named = ["queued", "running", "paused", "failed"]
    return reports.agg(*[F.count_if(F.col("status") == s).alias(s) for s in named])


def token_usage(reports: DataFrame) -> DataFrame:
    """Token sums per user."""
    sums = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return reports.groupBy("user_id").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums])


def report_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, succeeded and failed rows; rows without answer and error are neither."""
    failed = F.coalesce("error_text", F.lit("")) != ""
    answered = ~failed & F.col("custom_json").isNotNull()
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(answered).alias("success_rows"),
        F.count_if(failed).alias("failed_rows"),
    )


def outcome_breakdown(summary: DataFrame) -> DataFrame:
    """Two lines per summary: outcome, rows, whole-percent share (half up)."""
    others = [c for c in summary.columns if c not in ("total_rows", "success_rows", "failed_rows")]
    long = summary.unpivot(
        [*others, "total_rows"], ["success_rows", "failed_rows"], "outcome", "rows"
    )
    share = F.floor(F.col("rows") * 100 / F.nullif("total_rows", F.lit(0)) + 0.5)
    return long.select(
        *others, "outcome", F.greatest("rows", F.lit(0)).alias("rows"), share.cast("bigint").alias("share_percent")
    )


def stored_or_computed(stored: Column, computed: Column) -> Column:
    """A stored summary wins if it is a JSON object."""
    from rowscribe.functions.jsonx import object_or_null

    return F.coalesce(object_or_null(stored), computed)


def activity_flags(reports: DataFrame) -> DataFrame:
    """Has a user any active, any running report?"""
    return reports.groupBy("user_id").agg(
        F.bool_or(is_active(F.col("status"))).alias("has_active"),
        F.bool_or(F.col("status") == "running").alias("has_running"),
    )


def merge_snapshot(listed: DataFrame, active: DataFrame, kept: list[str]) -> DataFrame:
    """Fresh active records over listed ones, by id; unknown ones come first.

    ``kept`` columns of a listed record stay, because the fresh one does not
    carry them.
    """
    fresh = F.struct(*[c for c in active.columns if c != "id"])
    both = listed.withColumn("_listed", F.lit(True)).join(
        active.select("id", fresh.alias("_fresh")), "id", "full_outer"
    )

    def value(name: str) -> Column:
        if name in kept or name not in active.columns:
            fallback = F.col(f"_fresh.{name}") if name in active.columns else F.lit(None)
            return F.when(F.col("_listed"), F.col(name)).otherwise(fallback).alias(name)
        return F.when(F.col("_fresh").isNotNull(), F.col(f"_fresh.{name}")).otherwise(F.col(name)).alias(name)

    return both.select(
        *[c if c == "id" else value(c) for c in listed.columns],
        F.col("_listed").isNull().alias("is_new"),
    )


def stale_jobs(
    reports: DataFrame, leases: DataFrame, markers: DataFrame, now: Column, queue_empty: bool, after_seconds: int = K.STALE_SECONDS
) -> DataFrame:
    """Running jobs without lease that fell silent, queued jobs nobody will pick up."""
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    old = F.col("updated_at").isNull() | (age >= after_seconds)
    free = reports.filter(F.col("status").isin("running", "queued")).join(
        leases.select("job_id").distinct(), "job_id", "left_anti"
    )
    running = free.filter((F.col("status") == "running") & old)
    queued = free.filter(F.col("status") == "queued").join(
        markers.select("job_id").distinct(), "job_id", "left_anti"
    )
    return running.unionByName(queued if queue_empty else queued.filter(old))


def recover_jobs(
    reports: DataFrame,
    leases: DataFrame,
    markers: DataFrame,
    now: Column,
    queue_empty: bool,
    needs_key: tuple[str, ...] = (),
    after_seconds: int = K.STALE_SECONDS,
) -> DataFrame:
    """What becomes of every stale job: the columns of ``reports`` and new_status, new_error, new_finished_at.

    A job whose start cannot be repeated (no provider, model, prompt, file, id,
    job or user, or a provider in ``needs_key`` without a stored key) has failed.
    Any other is queued, but a job_id only once: if it waits already, or several
    reports share it, all but the oldest report (ties: least id) stay as they are
    (new_status null), and so do later ones that were queued, whatever they lack.
    """
    said = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    told = [said(c) for c in ("provider", "model", "prompt_template", "uploaded_file_id", "id", "job_id")]
    lost = ~F.expr("coalesce(user_id, 0) != 0")
    for each in told:
        lost = lost | ~each
    keyless = F.trim("provider").isin(list(needs_key)) & ~said("api_key_encrypted") if needs_key else F.lit(False)
    error = F.when(lost, K.MSG_NO_CONTEXT).when(keyless, K.MSG_NO_KEY)
    found = stale_jobs(reports, leases, markers, now, queue_empty, after_seconds).withColumn("new_error", error)
    marked = markers.select(F.col("job_id").alias("_marked")).distinct()
    free = found.filter("new_error IS NULL").join(marked, F.col("job_id") == F.col("_marked"), "left_anti")
    # One row per job after map-side combine; a job_id that many reports share meets in no task.
    taken = free.groupBy(F.col("job_id").alias("_job")).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    rows = found.join(taken, F.col("job_id") == F.col("_job"), "left")
    own = F.struct("created_at", "id")
    skipped = (F.col("status") == "queued") & (own > F.col("_first"))
    failed = F.col("new_error").isNotNull() & ~F.coalesce(skipped, F.lit(False))
    status = F.when(failed, "failed").when(F.col("new_error").isNull() & (own == F.col("_first")), "queued")
    return rows.select(
        *reports.columns,
        status.alias("new_status"),
        F.when(failed, F.col("new_error")).alias("new_error"),
        F.when(failed, now).alias("new_finished_at"),
    )


def recovery_counts(recovered: DataFrame) -> DataFrame:
    """How many jobs were queued again and how many have failed: one row."""
    return recovered.agg(
        F.count_if(F.col("new_status") == "queued").alias("requeued"),
        F.count_if(F.col("new_status") == "failed").alias("failed"),
    )


def upload_references(reports: DataFrame) -> DataFrame:
    return reports.groupBy("user_id", "uploaded_file_id").agg(F.count(F.lit(1)).alias("reference_count"))


def unreferenced_uploads(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """Uploads that no report of their owner uses."""
    used = reports.select("user_id", F.col("uploaded_file_id").alias("id")).distinct()
    return uploads.join(used, ["user_id", "id"], "left_anti")


def expired_uploads(
    uploads: DataFrame, reports: DataFrame, now: Column, ttl_hours: int = K.ORPHAN_TTL_HOURS
) -> DataFrame:
    """Unreferenced uploads older than the limit that are not being read."""
    cutoff = now - F.make_interval(hours=F.lit(max(1, ttl_hours)))
    status = F.coalesce("inspect_status", F.lit("ready"))
    idle = uploads.filter((F.col("created_at") < cutoff) & ~status.isin(K.BUSY_UPLOAD_STATUSES))
    return unreferenced_uploads(idle, reports)


def retention(reports: DataFrame, keep_last: int = K.KEEP_LAST_REPORTS) -> DataFrame:
    """Reports beyond the newest ``keep_last`` of their user, marked deletable or active.

    The kept reports are a rank filter that is applied inside each task before
    the shuffle; the rest is an anti join on the unique id.
    """
    newest_first = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    known = reports.filter(F.col("user_id") > 0)
    kept = (
        known.select("id", "user_id", "created_at")
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= max(1, keep_last))
        .select("id")
    )
    stale = known.join(kept, "id", "left_anti")
    return stale.withColumn(
        "decision", F.when(is_active(F.col("status")), F.lit("skip_active")).otherwise(F.lit("delete"))
    )


def retention_counts(stale: DataFrame) -> DataFrame:
    return stale.agg(
        F.count_if(F.col("decision") == "delete").alias("deleted_reports"),
        F.count_if(F.col("decision") == "skip_active").alias("skipped_active"),
    )


def preview(
    rows: DataFrame, group_by: str | None = None, limit: int = K.PREVIEW_ROWS
) -> DataFrame:
    """First ready rows (or groups, numbered 1..N) with their merged columns."""
    from rowscribe.functions.jsonx import row_preview
    from rowscribe.operators.discovery import depth_of
    from rowscribe.operators.groups import first_row_per_group
    from rowscribe.operators.rows import is_previewable

    legacy = F.col("analysis_json") if "analysis_json" in rows.columns else F.lit(None).cast("string")
    ready = rows.filter(is_previewable(F.col("status"), F.col("custom_json"), legacy, F.col("error_text")))
    if group_by:
        ready = first_row_per_group(ready, ["group_key"], blank_is_group=True)
    top = ready.orderBy("row_number").limit(limit)
    number = F.col("row_number")
    if group_by:
        # At most ``limit`` rows are left here, so one window may see them all.
        number = F.row_number().over(W.orderBy("row_number")).cast("bigint")
    return top.select(
        number.alias("row_number"),
        row_preview(
            F.col("input_json"), F.col("passthrough_json"), F.col("custom_json"), group_by, F.col("group_key"), depth_of(top, F.col("custom_json"))
        ).alias("columns"),
        F.col("warnings"),
        F.nullif("error_text", F.lit("")).alias("error"),
    )


def pending_page(rows: DataFrame, after: int, limit: int, ties: list[str] | None = None) -> DataFrame:
    """The next pending rows after a row number; ``ties`` order rows of one number."""
    later = (F.col("status") == "pending") & (F.col("row_number") > max(0, after))
    return rows.filter(later).orderBy("row_number", *(ties or [])).limit(max(1, limit))


def first_row(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each report, taken as a minimum."""
    others = [c for c in rows.columns if c not in by]
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*others), "row_number").alias("_first"))
    return first.select(*by, "_first.*").select(*rows.columns)
