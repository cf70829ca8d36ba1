"""Days, clock times and season rules as Column expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixturelake.functions.text import lower_tr, trim

# Month names, weekdays from Sunday on, and the years a fixture may have.
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
WEEKDAYS = ["Pazar", "Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi"]
SPELLED = {"subat": 2, "mayis": 5, "agustos": 8, "eylul": 9, "kasim": 11, "aralik": 12}
FIRST_YEAR, LAST_YEAR = 2015, 2100
NUMERIC_DAY = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)"
WORDED_DAY = r"(\d{1,2})\s+([A-Za-zÇĞÖŞÜçğıöşü]+)\s+(\d{4})(?!\d)"
CLOCK = r"(\d{1,2})[:.](\d{2})"
#: Hours the home clock is ahead of UTC, all year round.
AHEAD = 3


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it: keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int")


def month_number(name: Column) -> Column:
    pairs = {m.replace("I", "ı").lower(): i for i, m in enumerate(MONTHS, 1)} | SPELLED
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[lower_tr(name)]


def build_day(y: Column, m: Column, d: Column) -> Column:
    """A day within the years a fixture may have; days past the month's end roll over, others are null."""

    def build(p: Column) -> Column:
        ok = p["y"].between(FIRST_YEAR, LAST_YEAR) & p["m"].between(1, 12) & p["d"].between(1, 31)
        return F.when(ok, F.date_add(F.make_date(F.when(ok, p["y"]), F.when(ok, p["m"]), F.lit(1)), F.when(ok, p["d"]) - 1))

    return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), build)


def parse_day(c: Column) -> Column:
    """The first day written in a text: numbers with points, slashes or dashes, else with a month name."""
    numeric = F.regexp_extract_all(c, F.lit(NUMERIC_DAY), F.lit(0))
    worded = F.regexp_extract_all(c, F.lit(WORDED_DAY), F.lit(0))

    def read(p: Column) -> Column:
        by_number = F.split(p["n"], r"[./-]")
        by_word = F.split(p["w"], r"\s+")
        parts = F.when(p["n"].isNotNull(), F.struct(F.get(by_number, F.lit(2)).cast("int").alias("y"), F.get(by_number, F.lit(1)).cast("int").alias("m"), F.get(by_number, F.lit(0)).cast("int").alias("d")))
        other = F.struct(F.get(by_word, F.lit(2)).cast("int").alias("y"), month_number(F.get(by_word, F.lit(1))).alias("m"), F.get(by_word, F.lit(0)).cast("int").alias("d"))
        return let(F.coalesce(parts, other), lambda q: build_day(q["y"], q["m"], q["d"]))

    return let(F.struct(F.get(numeric, F.lit(0)).alias("n"), F.get(worded, F.lit(0)).alias("w")), read)


def clock_minutes(c: Column) -> Column:
    """Minutes of the first clock time; none readable counts as the last minute of the day."""
    first = F.get(F.regexp_extract_all(c, F.lit(CLOCK), F.lit(0)), F.lit(0))
    h = lambda p: F.get(p, F.lit(0)).cast("int")
    m = lambda p: F.get(p, F.lit(1)).cast("int")
    return let(F.split(first, "[:.]"), lambda p: F.coalesce(F.when((h(p) < 24) & (m(p) < 60), h(p) * 60 + m(p)), F.lit(23 * 60 + 59)))


def start_utc(day_text: Column, time_text: Column) -> Column:
    """When a fixture starts, in UTC without zone; null when its day is unreadable."""
    day = parse_day(day_text).cast("timestamp_ntz")
    return day + F.make_dt_interval(mins=clock_minutes(F.coalesce(time_text, F.lit(""))) - AHEAD * 60)


def started(day_text: Column, time_text: Column, now: datetime) -> Column:
    """Whether a fixture has begun; one without a readable day hasn't."""
    return F.coalesce(start_utc(day_text, time_text) <= F.lit(now).cast("timestamp_ntz"), F.lit(False))


def format_time(c: Column) -> Column:
    """H:MM or H.MM as HH:MM, other texts trimmed, null as empty."""
    hit = F.coalesce(c.rlike(CLOCK), F.lit(False))
    text = F.concat(F.lpad(F.regexp_extract(c, CLOCK, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, CLOCK, 2))
    return F.when(hit, text).otherwise(trim(F.coalesce(c, F.lit(""))))


def format_day(c: Column) -> Column:
    """'1 Kasım Pazar' for a numeric day, other texts trimmed; the day of a rolled-over date keeps its number."""
    d, m, y = (_part(c, NUMERIC_DAY, k) for k in (1, 2, 3))
    ok = F.coalesce(c.rlike(NUMERIC_DAY) & m.between(1, 12) & d.between(1, 31) & (y > 0), F.lit(False))
    day = F.date_add(F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1)), F.when(ok, d) - 1)
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i)
    text = F.concat_ws(" ", d.cast("string"), name(MONTHS, F.when(ok, m).otherwise(1)), name(WEEKDAYS, F.coalesce(F.dayofweek(day), F.lit(1))))
    return F.when(ok, text).otherwise(trim(F.coalesce(c, F.lit(""))))


def serial_day(c: Column) -> Column:
    """Spreadsheet day serial as dd.MM.yyyy, halves rounded up."""
    return F.date_format(F.date_add(F.lit(date(1899, 12, 30)), F.floor(c + 0.5).cast("int")), "dd.MM.yyyy")


def day_fraction(c: Column) -> Column:
    """Fraction of a day as HH:MM, rounded down."""
    m = F.floor(c * 24 * 60).cast("int")
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", (m / 60).cast("int"), m % 60))


def season_key(day: Column) -> Column:
    """'2025-2026': seasons turn over in August."""
    y = F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))


def season_override(start: int | None, end: int | None) -> str | None:
    """A season set by hand; a start alone lasts one year."""
    return None if start is None else f"{start}-{end if end is not None else start + 1}"


def season_cutoff(day: date, setting: date | None = None) -> date:
    """First day that counts: the setting, or the first of August of the running season."""
    return setting or date(day.year if day.month >= 8 else day.year - 1, 8, 1)


def in_season(day: Column, cutoff: date) -> Column:
    """Rows from the cutoff on; rows without a readable day are kept."""
    return day.isNull() | (day >= F.lit(cutoff))
