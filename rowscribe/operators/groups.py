"""Grouped reports: assembly, size limit, first rows, answers for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx
from rowscribe.operators.ordering import sequential_number


def pending_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row and size of every group that still has pending rows."""
    return (
        rows.filter(F.col("status") == "pending")
        .groupBy(*keys)
        .agg(F.min("row_number").alias("first_row_number"), F.count(F.lit(1)).alias("group_rows"))
    )


def group_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size and first row of every group; one small row per group."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("key_rows"), F.min("row_number").alias("first_row_number")
    )


def mark_oversize(
    rows: DataFrame, keys: list[str], max_rows: int = K.GROUP_MAX_ROWS, stats: DataFrame | None = None
) -> DataFrame:
    """Rows of a group above the limit become errors; the others stay as they are."""
    stats = group_stats(rows, keys) if stats is None else stats
    big = stats.filter(F.col("key_rows") > max_rows).select(*keys, F.col("key_rows").alias("group_size"))
    found = rows.join(big, keys, "left")
    too_big = F.col("group_size").isNotNull()
    size = F.col("group_size").cast("string")
    head, middle, tail = K.MSG_LARGE_GROUP
    note = F.concat(F.lit("skipped_large_group:"), size, F.lit(f">{max_rows}"))
    text = F.concat(F.lit(head), size, F.lit(f"{middle}{max_rows}{tail}"))
    return (
        found.withColumn("status", F.when(too_big, F.lit("error")).otherwise(F.col("status")))
        .withColumn("error_text", F.when(too_big, text).otherwise(F.col("error_text")))
        .withColumn(
            "warnings", F.when(too_big, F.array_append("warnings", note)).otherwise(F.col("warnings"))
        )
        .select(*rows.columns)
    )


def assemble(
    rows: DataFrame,
    keys: list[str],
    group_by: str,
    max_rows: int | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """One input row per group: texts joined in row order and the packed payload.

    A group is one prompt and therefore one value. A caller who limits groups to
    ``max_rows`` gets the larger ones from :func:`mark_oversize` as error rows;
    they are taken out here before anything is collected. Without a limit every
    group is assembled.
    """
    small = rows
    if max_rows is not None:
        stats = group_stats(rows, keys) if stats is None else stats
        small = rows.join(stats.filter(F.col("key_rows") > max_rows), keys, "left_anti")
    text = F.coalesce("review_text", F.lit(""))
    item = F.struct("row_number", text.alias("review_text"), "input_json")
    packed = small.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("group_size")
    )
    line = lambda i: F.concat(F.lit("[row "), i["row_number"].cast("string"), F.lit("] "), i["review_text"])
    entry = lambda i: F.concat(
        F.lit('{"row_number":'),
        i["row_number"].cast("string"),
        F.lit(',"review_text":'),
        jsonx.quoted(i["review_text"]),
        F.lit(',"row_json":'),
        jsonx.object_or_empty(i["input_json"]),
        F.lit("}"),
    )
    size = F.col("group_size").cast("string")
    payload = F.concat(
        F.lit('{"group_key":'),
        jsonx.quoted(F.col("group_key")),
        F.lit(',"group_size":'),
        size,
        F.lit(',"rows":['),
        F.array_join(F.transform("items", entry), ","),
        F.lit("]}"),
    )
    return packed.select(
        *keys,
        F.col("items")[0]["row_number"].alias("row_number"),
        F.array_join(F.transform("items", line), "\n").alias("review_text"),
        payload.alias("input_json"),
        F.array(F.lit(f"grouped_by:{group_by}"), F.concat(F.lit("group_size:"), size)).alias("warnings"),
        "group_size",
    )


def first_row_per_group(rows: DataFrame, keys: list[str], blank_is_group: bool = False) -> DataFrame:
    """The first row of each group by row number.

    Rows without a group key stand for themselves, unless ``blank_is_group``
    (previews) treats all of them as one group. The first row is a minimum that
    is taken inside each task first; no task sees a whole group.
    """
    key = keys[-1]
    columns = rows.columns
    if blank_is_group:
        rows = rows.withColumn(key, F.coalesce(key, F.lit("")))
    grouped = rows if blank_is_group else rows.filter(F.coalesce(key, F.lit("")) != "")
    others = [c for c in columns if c not in keys]
    first = grouped.groupBy(*keys).agg(F.min_by(F.struct(*others), "row_number").alias("_first"))
    out = first.select(*keys, "_first.*").select(*columns)
    if blank_is_group:
        return out
    return out.unionByName(rows.filter(F.coalesce(key, F.lit("")) == ""))


def number_groups(firsts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Number the groups 1..N by their first row."""
    return sequential_number(firsts, "row_number", "group_number", within)


def spread_answers(
    rows: DataFrame, answers: DataFrame, keys: list[str], stats: DataFrame | None = None
) -> DataFrame:
    """Give every row of a group the answer of its group; tokens only on its first row.

    The number of the first row travels with the answer, one per group.
    """
    stats = group_stats(rows, keys) if stats is None else stats
    per_group = stats.drop("key_rows").join(answers, keys, "left")
    found = rows.join(per_group, keys, "left")
    for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
        if name in answers.columns:
            first = (F.col("row_number") == F.col("first_row_number")) & F.col(name).isNotNull()
            found = found.withColumn(name, F.when(first, F.col(name)).otherwise(F.lit(0)))
    return found.drop("first_row_number")


def risk_rollup(labelled: DataFrame, key: str, violation: str, scheme: str) -> DataFrame:
    """Violations, share, distinct schemes and risk level per group.

    ``scheme`` is read only for violating rows. Schemes are made distinct per
    group before they are listed.
    """
    hit = F.col(violation) == 1
    pairs = labelled.groupBy(key, F.when(hit, F.col(scheme)).alias("_scheme")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(hit).alias("_hits")
    )
    totals = pairs.groupBy(key).agg(
        F.sum("_rows").alias("group_rows"),
        F.sum("_hits").alias("violations"),
        F.array_sort(F.collect_set("_scheme")).alias("schemes"),
    )
    share = F.bround(F.col("violations") * 100 / F.col("group_rows"), 1)
    exact = F.col("violations") * 100 / F.col("group_rows")
    extortion = F.array_contains("schemes", K.RISK_OVERRIDING_SCHEME)
    low = (F.col("violations") <= 1) | (exact < 10)
    medium = (F.col("violations") <= 4) & (exact <= 20)
    level = (
        F.when(extortion, F.lit(K.RISK_HIGH))
        .when(low, F.lit(K.RISK_LOW))
        .when(medium, F.lit(K.RISK_MEDIUM))
        .otherwise(F.lit(K.RISK_HIGH))
    )
    return totals.withColumn("share_percent", share).withColumn("risk_level", level)
