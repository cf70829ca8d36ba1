from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixturelake.functions import days, keys, text
from fixturelake.functions.namerule import match_cell, one_edit
from fixturelake.session import small_enough


def run(spark, build, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_normalise_fold_squash(spark):
    assert run(spark, text.normalize_tr, "  İSA  IŞIK x ", None, "ÇĞÖŞÜ") == ["isa ışık x", "", "çğöşü"]
    assert run(spark, text.fold_tr, "Şükrü İ. Çağ-lı 3", None) == ["sukru i cagli", ""]
    assert run(spark, text.squash, "GENÇ OSMAN  K.") == ["gencosmank"]
    assert run(spark, text.trim, "﻿  a b \t") == ["a b"]
    assert run(spark, text.words, "CAN SINAMA- ECE DENEME", "￼ ALİ (x)", "  ", None) == [["can", "sınama", "ece", "deneme"], ["ali", "x"], [], []]


def test_similarity(spark):
    got = spark.sql("SELECT * FROM VALUES ('', ''), ('a', ''), ('abcd', 'abce') t(a, b)").select(text.similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.75]


@pytest.mark.parametrize("raw,day", [
    ("01.02.2026", date(2026, 2, 1)), ("1/2/2026 Pazar", date(2026, 2, 1)), ("31.02.2026", date(2026, 3, 3)), ("05.12.22025", None), ("01.13.2026", None), ("32.01.2026", None), ("01.01.2014", None),
    ("20 Aralık 2025 Cumartesi", date(2025, 12, 20)), ("4 EKİM 2025", None), ("3 subat 2025", date(2025, 2, 3)), ("3 xyz 2025", None), ("", None), (None, None), ("x", None),
])
def test_parse_day(spark, raw, day):
    assert run(spark, days.parse_day, raw) == [day]


def test_started(spark):
    rows = [("01.11.2025", "12:00"), ("01.11.2025", "15.00"), ("01.11.2025", "15:01"), ("01.11.2025", None), ("31.10.2025", "x"), ("?", "10:00"), (None, None)]
    df = spark.createDataFrame(rows, "d string, t string")
    assert [r[0] for r in df.select(days.started(F.col("d"), F.col("t"), datetime(2025, 11, 1, 12))).collect()] == [True, True, False, False, True, False, False]


def test_formats_and_serials(spark):
    assert run(spark, days.format_day, "01.11.2026", " soon ", None, "40.01.2026") == ["1 Kasım Pazar", "soon", "", "40.01.2026"]
    assert run(spark, days.format_time, "9.05", "12:30:00", " - ", None) == ["09:05", "12:30", "-", ""]
    df = spark.createDataFrame([(45292.0, 0.5), (45292.5, 0.999999), (None, None)], "a double, b double")
    assert [tuple(r) for r in df.select(days.serial_day(F.col("a")), days.day_fraction(F.col("b"))).collect()] == [("01.01.2024", "12:00"), ("02.01.2024", "23:59"), (None, None)]
    minutes = spark.range(1440).select(days.day_fraction(F.col("id") / 1440).alias("t"), "id").collect()
    assert [r.t for r in minutes] == [f"{int(r.id / 1440 * 24 * 60) // 60:02d}:{int(r.id / 1440 * 24 * 60) % 60:02d}" for r in minutes]


def test_seasons(spark):
    df = spark.createDataFrame([(date(2025, 7, 31),), (date(2025, 8, 1),)], "d date")
    assert [r[0] for r in df.select(days.season_key(F.col("d"))).collect()] == ["2024-2025", "2025-2026"]
    assert days.season_cutoff(date(2026, 3, 1)) == date(2025, 8, 1) and days.season_cutoff(date(2026, 3, 1), date(2026, 1, 1)) == date(2026, 1, 1)
    assert days.season_override(2024, None) == "2024-2025" and days.season_override(None, 2025) is None


ROW = {"match_name": " A  - B ", "date_text": "01.01.2025", "time_text": None, "venue": "V", "referees": ["b", "a"], "table_officials": None, "src_row": 4}


def keyed(spark, *changes):
    schema = "match_name string, date_text string, time_text string, venue string, referees array<string>, table_officials array<string>, src_row int"
    df = spark.createDataFrame([tuple({**ROW, **c}.values()) for c in changes], schema)
    return df.select(keys.match_key(), keys.content_key(), keys.content_key_raw()).collect()


def test_keys(spark):
    base, crew, perm, ws, venue, name = keyed(spark, {}, {"referees": ["c"]}, {"referees": ["a", "b"]}, {"match_name": "a - b"}, {"venue": "W"}, {"match_name": "A - C"})
    assert base[0] == perm[0] != crew[0] and base[1] == crew[1] == ws[1] == venue[1] != name[1] and base[0] != venue[0]
    assert base[2] == "a - b|01.01.2025|" and len(base[0]) == len(base[1]) == 32
    a, b, c = keyed(spark, {"match_name": "3X3 - 3x3"}, {"match_name": "3x3 - 3x3", "src_row": 5}, {"match_name": "3x3 - 3x3", "src_row": None})
    assert a[2].endswith("|#4") and b[2].endswith("|#5") and not c[2].endswith("#")


def test_skip_and_links(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), ("", "")], "x string, y string")
    assert [r[0] for r in df.select(keys.may_skip(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(keys.may_skip(F.col("x"), F.col("y"), True)).collect()] == [False] * 4
    assert run(spark, text.drive_id, "https://x/d/AB-c_1/edit", "https://x/drive/folders/F1?resourcekey=k", "https://x/open?id=Q9", " raw1 ") == ["AB-c_1", "F1", "Q9", "raw1"]


@pytest.mark.parametrize("cell,first,last,kind,typo", [
    ("Deniz Örnek", "Deniz", "Örnek", "exact", False), ("ÖRNEK DENİZ", "Deniz", "Örnek", "exact", False), ("DENİZ ÖRNEC", "Deniz", "Örnek", "exact", True), ("ATA DENİZ ÖRNEK", "Deniz", "Örnek", None, None),
    ("CAN SINAMA- ECE DENEME", "Can", "Sınama", "partial", False), ("CAN SINAMO- ECE DENEME", "Can", "Sınama", None, None), ("LALE KAYNAK", "Lale", "Kaynak Testi", "short", False), ("DENİZ ÖRNEK", "Ata Deniz", "Örnek", "short", False),
    ("LALE KAYNAC", "Lale", "Kaynak Testi", None, None), ("ÖRNEK", "Ata", "Örnek", None, None), ("￼ CAN SINAMA", "Can", "Sınama", "exact", False), ("AB", "A", "B", None, None), ("", "A", "B", None, None), (None, None, None, None, None),
])
def test_name_rule(cell, first, last, kind, typo):
    got = match_cell(cell, first, last)
    assert (got and got[0], got and got[2]) == (kind, typo)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    assert one_edit(a, b) == (d[-1] <= 1)


def test_small_enough(spark):
    assert small_enough(spark.range(5), 5) and not small_enough(spark.range(6), 5)


@pytest.mark.parametrize("time,utc", [("18:30 America/New_York", "2025-07-05T22:30"), ("18:30 Asia/Tokyo", "2025-07-05T09:30"), ("18:30 Australia/Sydney", "2025-07-05T08:30"), ("18:30 Mars/Base", None), ("18:30 America/Argentina/Buenos_Aires", "2025-07-05T21:30")])
def test_regions_all_over_the_world(time, utc):
    from datetime import datetime, timezone

    from fixturelake.functions.instants import ZoneTables, to_instants

    m = to_instants(["05.07.2025"], [time], ZoneTables.build())[0]
    assert (None if m != m else datetime.fromtimestamp(m * 60, timezone.utc).strftime("%Y-%m-%dT%H:%M")) == utc
