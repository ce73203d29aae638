"""Sheets: from any DataFrame, or from folders of workbooks.

A workbook is one zip file of limited size, so one task decodes one workbook;
a folder of many is decoded by many tasks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.text import strip
from rowscribe.operators.ordering import sequential_number

CELLS = "path string, sheet string, sheet_index int, row_number int, cells array<struct<kind:string,text:string>>"


def header_names(cells: list[str | None]) -> list[str]:
    """Trimmed names; a blank one is named after its place."""
    names = [str(c).strip() if c is not None else "" for c in cells]
    return [name or f"Column {i}" for i, name in enumerate(names, start=1)]


def sheet_from(df: DataFrame, order: str | None = None, max_rows: int | None = None) -> DataFrame:
    """A DataFrame as a sheet: clean header, ``row_number`` counting from 2.

    ``order`` is a unique whole-number column that says which row comes first
    (a column named ``row_number`` is taken as it is). Of several columns with
    one name the first is used.
    """
    if order is None and "row_number" not in df.columns:
        raise ValueError("say which column gives the order of the rows")
    names = header_names(df.columns)
    firsts = [i for i, name in enumerate(names) if names.index(name) == i]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    if "row_number" in names:
        numbered = plain.withColumnRenamed(f"c{names.index('row_number')}", "row_number")
    else:
        numbered = sequential_number(
            plain, f"c{names.index(order.strip())}", "row_number", start=K.FIRST_DATA_ROW
        )
    out = numbered.select(
        F.col("row_number"),
        *[F.col(f"c{i}").alias(names[i]) for i in firsts if names[i] != "row_number"],
    )
    return out if max_rows is None else out.filter(F.col("row_number") < K.FIRST_DATA_ROW + max_rows)


WORKBOOK_GLOB = "*.[xX][lL][sS][xX]"


def admitted_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """Workbooks of a folder, by default of any size; a size test needs no read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", WORKBOOK_GLOB).load(folder)
    return files if max_bytes is None else files.filter(F.col("length") <= max_bytes)


def rejected_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """path, length and reason of the files that :func:`admitted_files` leaves out."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    reason = F.when(~F.lower("path").endswith(".xlsx"), "not a workbook")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "too large")
    return files.withColumn("reason", reason).filter("reason IS NOT NULL")


def is_admissible(name, length, max_bytes: int = K.MAX_UPLOAD_BYTES):
    """The same test for a listing of names and sizes."""
    return F.lower(name).endswith(".xlsx") & (length <= max_bytes)


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(parts) -> str:
    return "".join(node.text or "" for node in parts if _plain(node.tag) == "t")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in iterparse(stream):
            if _plain(node.tag) == "si":
                found.append(_texts(node.iter()))
                node.clear()
    return found


def _sheet_files(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    with book.open("xl/_rels/workbook.xml.rels") as stream:
        targets = {n.get("Id"): n.get("Target") for _, n in iterparse(stream) if n.get("Id")}
    sheets = []
    with book.open("xl/workbook.xml") as stream:
        for _, node in iterparse(stream):
            if _plain(node.tag) == "sheet":
                link = next(v for k, v in node.attrib.items() if _plain(k) == "id")
                target = targets[link].lstrip("/")
                where = target if target.startswith("xl/") else posixpath.join("xl", target)
                sheets.append((node.get("name"), where))
    return sheets


def _column(reference: str) -> int:
    place = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        place = place * 26 + ord(letter) - 64
    return place - 1


def _cell(node, shared: list[str]) -> tuple[str | None, str | None]:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return "text", _texts(node.iter())
    value = next((c.text for c in node if _plain(c.tag) == "v"), None)
    if value is None:
        return None, None
    if kind == "s":
        return "text", shared[int(value)]
    if kind == "b":
        return "flag", "True" if value == "1" else "False"
    if kind in ("str", "e"):
        return "text", value
    number = float(value)
    return "number", str(int(number)) if number.is_integer() else repr(number)


def _sheet_rows(book: zipfile.ZipFile, where: str, shared: list[str]):
    expected = 1
    with book.open(where) as stream:
        for _, node in iterparse(stream):
            if _plain(node.tag) != "row":
                continue
            number = int(node.get("r", expected))
            for gap in range(expected, number):
                yield gap, []
            cells: list = []
            for cell in node:
                place = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([(None, None)] * (place - len(cells)))
                cells.append(_cell(cell, shared))
            yield number, cells
            expected = number + 1
            node.clear()


def decode_workbooks(files: DataFrame, batch: int = 2000) -> DataFrame:
    """All rows of all sheets, the header as row 1; cells keep their kind."""

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = _shared_strings(book)
                    for index, (sheet, where) in enumerate(_sheet_files(book)):
                        held = []
                        for number, cells in _sheet_rows(book, where, shared):
                            row = [{"kind": k, "text": t} for k, t in cells]
                            held.append((path, sheet, index, number, row))
                            if len(held) == batch:
                                yield pd.DataFrame(held, columns=_COLUMNS)
                                held = []
                        if held:
                            yield pd.DataFrame(held, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(decode, CELLS)


_COLUMNS = ["path", "sheet", "sheet_index", "row_number", "cells"]


def workbook_sheet(cells: DataFrame, path: str, sheet: str, max_rows: int | None = None) -> DataFrame:
    """One sheet of one workbook as a sheet DataFrame (short rows end in nulls)."""
    chosen = cells.filter((F.col("path") == path) & (F.col("sheet") == sheet))
    header = chosen.filter(F.col("row_number") == 1).select("cells").first()
    if header is None:
        raise ValueError(f"no such sheet: {sheet}")
    names = header_names([c["text"] for c in header["cells"]])
    firsts = [i for i, name in enumerate(names) if names.index(name) == i]
    rows = chosen.filter(F.col("row_number") >= K.FIRST_DATA_ROW)
    if max_rows is not None:
        rows = rows.filter(F.col("row_number") < K.FIRST_DATA_ROW + max_rows)
    return rows.select(
        "row_number", *[F.get("cells", F.lit(i))["text"].alias(names[i]) for i in firsts]
    )


def profile_workbooks(cells: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows and distinct values per column of every sheet.

    Cells are distinct by kind and text, so the text ``1`` and the number 1 are
    two values; text is compared without the white space around it.
    """
    sheet = ["path", "sheet", "sheet_index"]
    flat = cells.select(*sheet, "row_number", F.posexplode_outer("cells").alias("position", "cell"))
    names = flat.filter((F.col("row_number") == 1) & F.col("position").isNotNull()).select(
        *sheet,
        "position",
        F.coalesce(
            F.nullif(strip(F.col("cell.text")), F.lit("")),
            F.concat(F.lit("Column "), (F.col("position") + 1).cast("string")),
        ).alias("column_name"),
    )
    totals = cells.groupBy(*sheet).agg(F.count_if(F.col("row_number") > 1).alias("total_rows"))
    value = F.when(F.col("cell.kind") == "text", strip(F.col("cell.text"))).otherwise(F.col("cell.text"))
    distinct = (
        flat.filter(F.col("row_number") > 1)
        .select(*sheet, "position", F.col("cell.kind").alias("kind"), value.alias("value"))
        .filter(F.coalesce("value", F.lit("")) != "")
        .distinct()
        .groupBy(*sheet, "position")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    count = F.coalesce("n", F.lit(0))
    if cap is not None:
        count = F.when(count <= cap, count)
    return (
        names.join(totals, sheet)
        .join(distinct, [*sheet, "position"], "left")
        .select(*sheet, "position", "column_name", "total_rows", count.alias("distinct_values"))
    )
