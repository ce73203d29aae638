"""Log records: parsing, filters, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.text import is_blank, strip

FIELDS = ["ts", "level", "service", "logger", "request_id", "user_id", "username"]


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fields of JSON lines; any other line is kept whole as its message."""
    # Exploding a single value keeps it from being computed again for every field
    # and for every filter that is pushed down to the lines.
    node = F.explode(F.array(F.try_parse_json(F.col(line))))
    parsed = lines.filter(~is_blank(F.col(line))).select("*", node.alias("_node"))
    node = F.col("_node")
    is_record = F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))
    field = lambda name: F.when(is_record, F.try_variant_get(node, f"$.{name}", "string"))
    message = F.coalesce(field("message"), F.col(line))
    return parsed.select(
        *lines.columns, *[field(name).alias(name) for name in FIELDS], message.alias("message")
    )


def concat_logs(sources: list[DataFrame]) -> DataFrame:
    """The lines of several log sources one after another; a column that one of them lacks is null there."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out


def filter_records(records: DataFrame, level: str | None = None, query: str | None = None, line: str = "line") -> DataFrame:
    """Level (only for records that have one) and text, both ignoring case."""
    found = records
    if level and level.strip():
        wanted = level.strip().upper()
        has_none = F.coalesce("level", F.lit("")) == ""
        found = found.filter(has_none | (F.upper("level") == wanted))
    if query and query.strip():
        text = query.strip().lower()
        found = found.filter(F.lower("message").contains(text) | F.lower(line).contains(text))
    return found


def is_worth_logging(path: Column, status: Column, millis: Column, slow: int = K.SLOW_ACCESS_MS) -> Column:
    """Polling paths are only kept when they failed or were slow."""
    noisy = F.lit(False)
    for prefix in K.NOISY_PATH_PREFIXES:
        noisy = noisy | path.startswith(prefix)
    return ~noisy | (status >= 400) | (millis >= slow)


def tail(lines: DataFrame, limit: int, file: str, order: list[str], file_rank: str | None = None) -> DataFrame:
    """Last ``limit`` lines of each file, then the last ``limit`` of all files.

    The rank filter is applied inside each task before the shuffle, and the
    second step is a bounded top-k.
    """
    backwards = [F.desc(c) for c in order]
    per_file = (
        lines.withColumn("_rank", F.row_number().over(W.partitionBy(file).orderBy(*backwards)))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )
    return per_file.orderBy(F.desc(file_rank or file), *backwards).limit(limit)


def newest_first(records: DataFrame, index: str) -> DataFrame:
    """Newest time first, unreadable times last, later lines first among those."""
    time = F.try_to_timestamp(strip(F.col("ts")))
    tie = F.when(time.isNull(), -F.col(index)).otherwise(F.col(index))
    return records.orderBy(time.desc_nulls_last(), tie)


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Cut texts at ``## `` headings into version, title and body.

    The work is per text: lines before the first heading and divider lines are
    dropped, sections keep their order.
    """
    # Every line break becomes a plain one; \\R takes a pair of them as one.
    plain = F.regexp_replace(F.col(text), r"\R|[\x1c-\x1e]", "\n")
    cut = texts.select(key, F.split(F.concat(F.lit("\n"), plain), r"\n## ", -1).alias("_pieces"))
    rest = F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0)))
    bodies = cut.select(key, F.posexplode(rest).alias("section", "piece"))
    parts = F.split("piece", "\n", 2)
    title = strip(parts[0])
    body = F.filter(F.split(strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "\n"), lambda l: strip(l) != "---")
    head = strip(F.split(title, "—")[0])
    version = F.when(head != "", F.split(head, r"\s+")[0]).otherwise(title)
    return bodies.select(
        key,
        (F.col("section") + 1).alias("section"),
        version.alias("version"),
        title.alias("title"),
        strip(F.array_join(body, "\n")).alias("body"),
    )
