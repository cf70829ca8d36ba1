"""Tabs of raw values (text or number) as cells, read up to a fixed window, with header-driven kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.operators.sheets import sheet_kind, sheet_value

WINDOW_ROWS, WINDOW_COLUMNS = 5000, 32
SCHEMA = "title string, tab string, row_no int, values array<struct<text:string,number:double>>"


def tab_cells(raw: DataFrame) -> DataFrame:
    """(file, sheet, row_no, cells): the first row of a tab decides which columns are days and which are times."""
    inside = raw.where(F.col("row_no") <= WINDOW_ROWS).withColumn("values", F.slice("values", 1, WINDOW_COLUMNS))
    head = inside.where("row_no = 1").select("title", "tab", F.transform("values", lambda v: sheet_kind(F.coalesce(v["text"], F.lit("")))).alias("_kinds"))
    joined = inside.join(head, ["title", "tab"])
    cell = F.transform("values", lambda v, i: sheet_value(v["text"], v["number"], F.coalesce(F.get("_kinds", i), F.lit("text"))))
    text = F.transform("values", lambda v: F.coalesce(v["text"], F.lit("")))
    out = joined.withColumn("cells", F.when(F.col("row_no") == 1, text).otherwise(cell))
    return out.where((F.col("row_no") == 1) | F.exists("cells", lambda c: c != "")).select(F.col("title").alias("file"), F.col("tab").alias("sheet"), "row_no", "cells")


def two_sources(current: DataFrame, archive: DataFrame) -> DataFrame:
    """Both readings with the source each row came from."""
    return current.withColumn("source", F.lit("current")).unionByName(archive.withColumn("source", F.lit("archive")), allowMissingColumns=True)
