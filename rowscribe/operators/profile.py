"""Column profile of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.text import strip

#: Logarithm of a sketch's registers: it errs by less than one hundredth as a rule.
SKETCH = 14
#: A sketch this far above the cap leaves no doubt; nearer ones are counted exactly.
MARGIN = 1.25


def _value(name: str) -> Column:
    """A cell as it is compared: trimmed, null if blank, a long one as its digest."""
    text = F.nullif(strip(F.col(f"`{name}`").cast("string")), F.lit(""))
    # The digest is longer than any text kept as it is.
    return F.when(F.length(text) > 64, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def distinct_values(sheet: DataFrame, columns: list[str], named: dict[str, int]) -> DataFrame:
    """position and value of the distinct filled cells; ``named`` gives each column's position."""
    cells = [F.struct(F.lit(named[c]).alias("position"), _value(c).alias("value")) for c in columns]
    pairs = sheet.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return pairs.filter("value IS NOT NULL").distinct()


def summaries(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """position, column_name, total_rows and sketch (of the distinct values) of every column, from one pass without a shuffle of values.

    Summaries of parts of a sheet add up: rows are summed, sketches united.
    """
    sketches = [F.hll_sketch_agg(_value(c), F.lit(SKETCH)).alias(f"s{i}") for i, c in enumerate(columns)]
    one = sheet.agg(F.count(F.lit(1)).alias("total_rows"), *sketches)
    lines = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), "total_rows", F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*lines)))


def beyond(sketch: Column, cap: int | None) -> Column:
    """Whether a sketch shows more values than ``cap`` beyond doubt."""
    return F.lit(False) if cap is None else F.hll_sketch_estimate(sketch) > cap * MARGIN


def column_profile(sheet: DataFrame, columns: list[str], cap: int | None = None) -> DataFrame:
    """Row count and exact distinct count per column; blanks are no value.

    A count above ``cap`` (none by default) is null. Columns whose sketch is far
    above the cap take no part in the exact count. Cells are reduced to distinct
    (column, value) pairs inside each task before they are shuffled, and the count
    itself runs over those pairs, so a value that fills a third of a column costs one
    pair per task.
    """
    named = {c: i for i, c in enumerate(columns)}
    # A row per column: what is left to count exactly is known before it is planned.
    found = summaries(sheet, columns).withColumn("beyond", beyond(F.col("sketch"), cap)).drop("sketch").collect()
    near = [r.column_name for r in found if not r.beyond]
    listed = sheet.sparkSession.createDataFrame(found, "position int, column_name string, total_rows bigint, beyond boolean")
    if not near:
        return listed.select("position", "column_name", "total_rows", F.lit(None).cast("bigint").alias("distinct_values"))
    counted = distinct_values(sheet, near, named).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    return _counted(listed, counted, cap)


def _counted(listed: DataFrame, counted: DataFrame, cap: int | None) -> DataFrame:
    count = F.coalesce("n", F.lit(0))
    shown = F.when(~F.col("beyond") & (F.lit(True) if cap is None else count <= cap), count)
    return listed.join(counted, "position", "left").select("position", "column_name", "total_rows", shown.alias("distinct_values"))


def merged_profile(parts: DataFrame, values: DataFrame, cap: int | None = None) -> DataFrame:
    """The profile of a sheet that came in parts, from the summaries and the distinct values of each part."""
    listed = parts.groupBy("position", "column_name").agg(F.sum("total_rows").alias("total_rows"), F.hll_union_agg("sketch").alias("sketch"))
    listed = listed.withColumn("beyond", beyond(F.col("sketch"), cap)).drop("sketch")
    near = values.join(listed.filter("NOT beyond").select("position"), "position", "left_semi")
    return _counted(listed, near.select("position", "value").distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n")), cap)
