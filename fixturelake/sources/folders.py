"""Folder trees of spreadsheets, seasons of folders, and keys of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON = r"(\d{4})-(\d{4})"


def is_spreadsheet(path: Column, mime: Column | None = None) -> Column:
    """By suffix, or by a type that names a spreadsheet."""
    by_name = F.lower(path).rlike(r"\.xlsx?$")
    return by_name if mime is None else by_name | F.coalesce(F.lower(mime).rlike("spreadsheet|excel"), F.lit(False))


def scan(spark: SparkSession, root: str, depth: int = -1, content: bool = False) -> DataFrame:
    """(path, name, folder, modified, length, md5[, content]) of spreadsheets below a root.

    depth 0 is the root itself, 1 its folders and so on, -1 everything. Links that lead back are not followed by
    the file system's listing, so no guard is needed. Bytes are read only for the checksum, column-pruned otherwise.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xls*").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rest = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^\w+:/*", ""), rf"^\Q{base}\E/?", "")
    parts = F.split(rest, "/")
    out = files.withColumns({"name": F.element_at(parts, -1), "folder": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), "_depth": F.size(parts) - 1})
    out = out.where(is_spreadsheet(F.col("path")))
    if depth >= 0:
        out = out.where(F.col("_depth") <= depth)
    cols = ["path", "name", "folder", F.col("modificationTime").alias("modified"), "length", F.md5("content").alias("md5")]
    return out.select(*cols, *(["content"] if content else []))


def seasons(folders: DataFrame, column: str = "folder") -> DataFrame:
    """(folder, start, end) of folders whose name holds a season anywhere."""
    year = lambda k: F.nullif(F.regexp_extract(column, SEASON, k), F.lit("")).cast("int")
    return folders.select(column).distinct().withColumns({"start": year(1), "end": year(2)}).where("start IS NOT NULL")


def latest_season(folders: DataFrame, column: str = "folder") -> DataFrame:
    """The folder of the greatest start year; of equals the first by name."""
    return seasons(folders, column).orderBy(F.desc("start"), column).limit(1)


def is_archive_of(name: Column, folder_season: Column, active: str) -> Column:
    """An archive copy of the running season, which repeats what its folder holds."""
    return name.rlike(r"AR[ŞSşs][İIıi]?[Vv]|ar[ŞSşs][İIıi]?[Vv]") & F.coalesce(folder_season == active, F.lit(False))


def folder_keys(setting: str, expected: str, known: list[str]) -> list[str]:
    """Folder keys a setting names: a comma list, or 'latest-season' for the expected season, else the greatest known."""
    out = []
    for part in (p.strip() for p in setting.split(",")):
        if part == "latest-season":
            if not known:
                raise ValueError("no season folder is known")
            out.append(expected if expected in known else max(known))
        elif part:
            if known and part not in known:
                raise ValueError(f"unknown folder key {part!r}")
            out.append(part)
    return out
