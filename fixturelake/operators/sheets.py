"""Irregular sheets as fixtures: header search, column classes, carry-forward, gathering of crews.

Input is one row per physical sheet row: cells(file, sheet, row_no, cells array<string>). Everything runs as
array expressions inside a row and as windows inside a sheet; a sheet is read from one file and bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions.days import day_fraction, serial_day
from fixturelake.functions.keys import is_nameless
from fixturelake.functions.text import SPACE, collapse, key_part, lower_tr, normalize_tr, trim
from fixturelake.session import broadcast_checked

#: Non-empty rows of a sheet among which its header is sought.
HEADER_DEPTH = 20
FIELDS = ["date", "time", "venue", "organisation", "category", "group", "team", "stat", "medic", "observer", "commissioner", "table", "referee"]
CREW_FIELDS = {"referees": "referee", "table_officials": "table", "medics": "medic", "statisticians": "stat", "observers": "observer", "commissioners": "commissioner"}

# What a header cell must hold for each field, in the order in which the rules apply.
_ROLE_LIKE = r"hakem|masa|yazıcı|skor|24 sn|24sn|yardımcı|sağlık|gözlemci|istatistik|stat|^h[123]$"
_CONTEXT_LIKE = r"tarih|^gün$|saat|salon|spor|takım|maç|karşılaşma|ev sahibi"
_RULES = [
    ("date", r"tarih|^gün$", None), ("time", r"saat", r"srm|sorumlu|görevli|hakem"), ("venue", r"salon|spor", None),
    ("organisation", r"organizasyon|^org$", None), ("category", r"kategori", None), ("group", r"grup", None),
    ("team", r"maç|karşılaşma|müsabaka|takım|ev sahibi", None), ("stat", r"stat", None), ("medic", r"sağlık|sağlik|doktor", None),
    ("observer", r"gözlemci|gozlemci", None), ("commissioner", r"komiser|saha.*kom|kom.*saha", None),
    ("table", r"masa|yazıcı|skor|24|srm|sorumlu|opr|operatör|şut|sut|süre|sure|kronometre|sayı|saat görevlisi|saat gorevlisi", None),
    ("table", r"yardımcı", r"hakem"), ("referee", r"hakem|^h[123]$", None),
]
_CREW_CLASSES = {"stat", "medic", "observer", "commissioner", "table", "referee"}
# League types by what a file name holds, in order; and sheet names that say nothing.
_LEAGUES = [
    (r"OKUL|İL VE İLÇE|IL VE ILCE", "OKUL İL VE İLÇE"), (r"ÖZEL LİG|ÜNİVERSİTE|OZEL LIG|UNIVERSITE", "ÖZEL LİG VE ÜNİVERSİTE"),
    (r"BÖLGE|BOLGE", "BÖLGE LİGİ"), (r"TBF|MİLLİ|FIBA|AVRUPA", "TBF / MİLLİ"), (r"HÜKMEN", "HÜKMEN"), (r"CEZA", "CEZA KARARLARI"),
]
_GENERIC = r"(?i)^(sheet\s*\d*|sayfa\s*\d*|worksheet\s*\d*|[çÇ]al[ıI]şma\s*sayfas[ıI]\s*\d*|data\s*\d*)$"
_DATE_PREFIX = rf"^{SPACE}*(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}{SPACE}*(?:-{SPACE}*)?|-{SPACE}*)"
_ANY_DATE = r"\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4}"


def column_class(header: Column) -> Column:
    """Field of a normalised header cell by the first rule that fits; null for none."""
    out = F.lit(None).cast("string")
    for field, has, but in reversed(_RULES):
        hit = header.rlike(has) if but is None else header.rlike(has) & ~header.rlike(but)
        if field == "time":
            hit = hit | (header == "saat")
        out = F.when(hit, field).otherwise(out)
    return out


def clean_date_prefix(c: Column) -> Column:
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), _DATE_PREFIX, ""))


def clean_time(c: Column) -> Column:
    """H:MM stays; remains of an empty time cell (years 1899 and 1900) vanish; other texts stay as they are."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(r"^\d{1,2}:\d{2}$"), c).when(c.rlike("1899|1900"), "").otherwise(c)


def file_week(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)(\d+)\.?\s*hafta", 1), F.lit("")).cast("int")


def file_league(name: Column) -> Column:
    out = F.lit("Yerel Lig")
    for pattern, league in reversed(_LEAGUES):
        out = F.when(F.upper(name).rlike(pattern), league).otherwise(out)
    return out


def is_generic_sheet(name: Column) -> Column:
    return trim(name).rlike(_GENERIC)


def file_category(name: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.(xlsx|xls|csv)$", ""), rf"(?i)ARŞ[İI]V{SPACE}*", ""))


def sheet_kind(header: Column) -> Column:
    """Kind of a column of a values sheet by its exact header."""
    low = lower_tr(trim(header))
    return F.when(low == "tarih", "date").when(low == "saat", "time").otherwise("text")


def sheet_value(text: Column, number: Column, kind: Column) -> Column:
    """A raw value as text: numbers as day serials or day fractions where the column says so."""
    plain = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    as_number = F.when(kind == "date", serial_day(number)).when(kind == "time", day_fraction(number)).otherwise(plain)
    return F.coalesce(F.when(number.isNotNull(), as_number), trim(text), F.lit(""))


def header_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row, fields map<string, array<int>>): the first fitting row among the first non-empty ones.

    A header has three cells or more, one like a role and one like a context. A blank header cell right of a
    crew column belongs to it (merged headers); right of any other column it belongs to nothing.
    """
    order = W.partitionBy("file", "sheet").orderBy("row_no")
    first = cells.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= HEADER_DEPTH)
    low = first.withColumn("_low", F.transform("cells", normalize_tr)).where("size(cells) >= 3")
    fit = low.where(F.exists("_low", lambda c: c.rlike(_ROLE_LIKE)) & F.exists("_low", lambda c: c.rlike(_CONTEXT_LIKE)))
    head = fit.groupBy("file", "sheet").agg(F.min_by(F.struct("row_no", "_low"), "row_no").alias("h"))
    columns = head.select("file", "sheet", F.col("h.row_no").alias("header_row"), F.posexplode("h._low").alias("pos", "text"))
    # a blank cell looks left for the last cell that isn't blank; only a crew column passes its class on
    left = W.partitionBy("file", "sheet").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(F.col("text") != "", F.coalesce(column_class(F.col("text")), F.lit("-")))
    carried = F.last(own, ignorenulls=True).over(left)
    field = F.when(F.col("text") != "", own).when(carried.isin(*_CREW_CLASSES), carried)
    classed = columns.withColumn("field", field).where("field IS NOT NULL AND field <> '-'")
    per_field = classed.groupBy("file", "sheet", "header_row", "field").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    return per_field.groupBy("file", "sheet", "header_row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "ps")))).alias("fields"))


def _columns(field: str) -> Column:
    return F.coalesce(F.col("fields")[field], F.array().cast("array<int>"))


def _cell(pos: Column) -> Column:
    return F.coalesce(F.get("cells", pos), F.lit(""))


def _first(field: str) -> Column:
    return F.when(F.size(_columns(field)) > 0, _cell(F.get(_columns(field), F.lit(0)))).otherwise(F.lit(""))


def _gather(field: str, longer_than: int) -> Column:
    return F.filter(F.transform(_columns(field), _cell), lambda v: F.length(v) > longer_than)


def parse_cells(cells: DataFrame) -> DataFrame:
    """Fixtures of all sheets, one row each, in the columns of the fixture table (src_row = physical row).

    Date and venue are carried down a sheet with a window; rows without a readable match name update what is
    carried and are left out; rows without any crew are kept. Sheets of fewer than two rows or without a header
    give nothing. Null cells count as empty; extra columns of ``cells`` are ignored.
    """
    rows = cells.select("file", "sheet", "row_no", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: c != ""))
    enough = rows.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    rows = rows.join(enough, ["file", "sheet"], "left_semi")
    body = rows.join(broadcast_checked(header_rows(rows)), ["file", "sheet"]).where("row_no > header_row AND size(cells) >= 3")
    body = body.where(F.exists("cells", lambda c: trim(c) != ""))

    row_date, row_venue = _first("date"), clean_date_prefix(_first("venue"))
    found = F.get(F.filter("cells", lambda c: c.rlike(_ANY_DATE)), F.lit(0))
    body = body.withColumns({"_date": row_date, "_venue": F.when(F.size(_columns("venue")) > 0, row_venue).otherwise(F.lit(""))})
    body = body.withColumns({
        "_carry_date": F.when(F.col("_date").rlike(r"\d"), F.col("_date")).when(F.col("_date") == "", trim(found)),
        "_carry_venue": F.when(F.length("_venue") > 2, F.col("_venue")),
    })
    down = W.partitionBy("file", "sheet").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    body = body.withColumns({f"_last{c}": F.coalesce(F.last(f"_carry{c}", ignorenulls=True).over(down), F.lit("")) for c in ("_date", "_venue")})

    used = F.flatten(F.map_values("fields"))
    teams = F.array_join(_gather("team", 1), " - ")
    spare = F.slice(F.filter(F.zip_with("cells", F.sequence(F.lit(0), F.size("cells") - 1), lambda v, i: F.when(~F.array_contains(used, i) & (F.length(v) > 2), v)), lambda v: v.isNotNull()), 1, 3)
    name = F.coalesce(F.nullif(teams, F.lit("")), F.nullif(F.array_join(spare, " - "), F.lit("")))
    org, kind = trim(_first("organisation")), trim(_first("category"))
    has_org = F.size(_columns("organisation")) > 0
    tab = F.when((trim(F.col("sheet")) != "") & ~is_generic_sheet(F.col("sheet")), trim(F.col("sheet"))).otherwise(file_category(F.col("file")))
    category = F.when(has_org, F.when(F.length(org) > 1, org).otherwise(tab)).when(F.length(kind) > 1, kind).otherwise(tab)
    return body.withColumn("_name", name).where("_name IS NOT NULL").select(
        clean_date_prefix(F.col("_name")).alias("match_name"),
        F.when(F.col("_date") != "", F.col("_date")).otherwise(F.col("_last_date")).alias("date_text"),
        clean_time(_first("time")).alias("time_text"),
        F.when(F.col("_venue") != "", F.col("_venue")).otherwise(F.col("_last_venue")).alias("venue"),
        category.alias("category"),
        F.when(has_org, F.nullif(kind, F.lit(""))).alias("sub_category"),
        F.nullif(trim(_first("group")), F.lit("")).alias("group_name"),
        file_week(F.col("file")).alias("week"),
        file_league(F.col("file")).alias("league_type"),
        *(_gather(f, 2).alias(c) for c, f in CREW_FIELDS.items()),
        F.concat_ws(" → ", "file", "sheet").alias("src_file"), F.col("sheet").alias("src_sheet"), F.col("row_no").alias("src_row"),
    )


def group_ordinal(rows: DataFrame, order: list[str], out: str = "src_row") -> DataFrame:
    """For nameless fixtures, ``out`` becomes the place within (file, sheet, date, time, venue) from 0; others keep it.

    Rows outside the group never shift it, unlike physical row numbers.
    """
    part = W.partitionBy("src_file", key_part(F.col("date_text")), key_part(F.col("time_text")), key_part(F.col("venue")), is_nameless())
    at = F.row_number().over(part.orderBy(*order)) - 1
    return rows.withColumn(out, F.when(is_nameless(), at).otherwise(F.col(out)).cast("int"))


def category_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, categories map<string, bigint>): how many fixtures of each category."""
    counts = rows.groupBy(*by, F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"))


__all__ = ["clean_date_prefix", "clean_time", "collapse", "column_class", "file_league", "file_week", "group_ordinal", "header_rows", "parse_cells"]
