"""Identities of fixtures, crews and sheet tabs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixturelake.functions.text import key_part, trim

#: Crew columns in the fixed order in which a person's role is looked up.
CREWS = ["referees", "table_officials", "medics", "statisticians", "observers", "commissioners"]
ROLES = ["HAKEM", "MASA", "SAGLIK", "ISTATISTIK", "GOZLEMCI", "KOMISER"]
NAMELESS = "3x3 - 3x3"
FINGERPRINT_VERSION = "v1"


def empty() -> Column:
    return F.array().cast("array<string>")


def crew(c: str) -> Column:
    return F.coalesce(F.col(c), empty())


def everyone(columns: list[str] = CREWS) -> Column:
    """All crew entries in role order."""
    return F.flatten(F.array(*(crew(c) for c in columns)))


def crew_size(columns: list[str] = CREWS) -> Column:
    return sum((F.size(crew(c)) for c in columns), F.lit(0))


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def match_key() -> Column:
    """Crew-sensitive key: four text parts trimmed and lower-cased, sorted referees and table crew as written."""
    part = lambda c: F.lower(trim(F.coalesce(F.col(c), F.lit(""))))
    crews = [F.array_join(F.array_sort(crew(c)), "|") for c in ("referees", "table_officials")]
    return digest(F.concat_ws("|", *(part(c) for c in ("match_name", "date_text", "time_text", "venue")), *crews))


def is_nameless() -> Column:
    """Fixtures that share one name: only their place in the group tells them apart."""
    return F.coalesce(F.lower(trim(F.col("match_name"))) == NAMELESS, F.lit(False))


def content_key_raw() -> Column:
    """Crew-insensitive identity; the place in the group is added for nameless fixtures that have one."""
    base = F.concat_ws("|", key_part(F.col("match_name")), key_part(F.col("date_text")), key_part(F.col("time_text")))
    return F.when(is_nameless() & F.col("src_row").isNotNull(), F.concat(base, F.lit("|#"), F.col("src_row").cast("string"))).otherwise(base)


def content_key() -> Column:
    return digest(content_key_raw())


def tab_fingerprint(season: str, cutoff: str, title: Column, tab: Column, rows: Column, version: str = FINGERPRINT_VERSION) -> Column:
    """Whether a tab changed between runs: its rows with all that decides what becomes of them."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), F.lit(season).alias("s"), F.lit(cutoff).alias("c"), title.alias("t"), tab.alias("n"), rows.alias("r"))), 256)


def may_skip(before: Column, after: Column, force: bool = False) -> Column:
    """A tab may be skipped only when both fingerprints are there, equal, and nothing is forced."""
    return F.lit(not force) & F.coalesce((before == after) & (before != ""), F.lit(False))


def role_of(name: Column) -> Column:
    """Role of a person: the first crew in fixed order that lists the name."""
    return F.coalesce(*(F.when(F.array_contains(crew(c), name), F.lit(r)) for c, r in zip(CREWS, ROLES)))
