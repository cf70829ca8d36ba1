import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fixturelake.functions.instants import ZoneTables, parser_for, shape, to_instants
from fixturelake.operators import merge, resolve, sheets
from fixturelake.operators.instants import unusual, with_instant
from fixturelake.operators.skew import attach, dense_rank_in
from fixturelake.operators.snapshots import snapshot_changes

ZONES = ZoneTables.build(("Europe/Istanbul", "Europe/Berlin", "Europe/Madrid"))
NOW = datetime(2025, 11, 1, 12)


@pytest.mark.parametrize("d,t,utc", [
    ("05.01.2025", "19.00", "2025-01-05 16:00"), ("05.07.2015", "saat 9.30", "2015-07-05 06:30"), ("05.01.2016", "19:00", "2016-01-05 17:00"), ("5/1/25", "7:00 PM", "2025-01-05 16:00"), ("20250105", "1900", "2025-01-05 16:00"),
    ("Pazar, 5 Ocak 2025", "ÖS 7:00", "2025-01-05 16:00"), ("Jan 5, 2025", "0.791667", "2025-01-05 16:00"), ("2025-01-05T16:00:00Z", None, "2025-01-05 16:00"), ("2025-01-05T19:00:00.000000+0300", "", "2025-01-05 16:00"),
    ("45662", "19:00", "2025-01-05 16:00"), ("45662.791666667", None, "2025-01-05 16:00"), ("1736092800", None, "2025-01-05 16:00"), ("1736092800000", None, "2025-01-05 16:00"), ("05.01.2025", "17:00 CET", "2025-01-05 16:00"),
    ("05.07.2025", "18:00 CEST", "2025-07-05 16:00"), ("05.07.2025", "18:00 (Europe/Berlin)", "2025-07-05 16:00"), ("05.01.2025", "19:00 TSİ", "2025-01-05 16:00"), ("05.01.2025", "18.00 UTC+02", "2025-01-05 16:00"), ("05.01.2025", "16:00 (UTC)", "2025-01-05 16:00"),
    ("10 Ocak 2026 saat 20.00", None, "2026-01-10 17:00"), ("05.01.2025", "12:30 AM", "2025-01-04 21:30"), ("05.01.2025", "12:00 PM", "2025-01-05 09:00"), ("5 subat 2025", " 09 : 00 ", "2025-02-05 06:00"), ("05.01.2025", "12:59:40", "2025-01-05 10:00"),
    ("30.03.2025", "02:30 Europe/Berlin", None), ("26.10.2025", "02:30 Europe/Berlin", None), ("25.10.2015", "03:30", "2015-10-25 00:30"), ("08.11.2015", "03:30", None), ("27.03.2016", "03:30", None), ("31.02.2025", "10:00", None), ("05.01.20255", "10:00", None),
    ("5 Ocak", "10:00", None), ("05.01.2025", None, None), ("05.01.2025", "25:00", None), ("05.01.2025", "sabah", None), (None, "10:00", None), ("TBD", "10:00", None), ("?", "?", None), ("05.01.2025", "13:00 PM", None), ("05.01.2025", "1" * 5000, None),
    ("2025-01-05 19:00:00", "20:00", None), ("05.01.2025", "10:00 Mars/Base", None),
])
def test_instants(d, t, utc):
    m = to_instants([d], [t], ZONES)[0]
    assert (None if m != m else datetime.fromtimestamp(m * 60, timezone.utc).strftime("%Y-%m-%d %H:%M")) == utc


def test_zone_tables_agree_with_the_zone_data():
    rng = random.Random(7)
    for zone in ("Europe/Istanbul", "Europe/Berlin"):
        z = ZoneInfo(zone)
        for _ in range(1500):
            wall = datetime(rng.randint(1985, 2036), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.choice([0, 30]))
            hits = {(wall - o).replace(tzinfo=timezone.utc) for o in {wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1)}}
            true = [h for h in hits if h.astimezone(z).replace(tzinfo=None) == wall]
            utc, once = ZONES.to_utc(zone.lower(), __import__("numpy").array([int((wall - datetime(1970, 1, 1)).total_seconds())]))
            assert bool(once[0]) == (len(true) == 1) and (len(true) != 1 or utc[0] == true[0].timestamp())


def test_shapes_are_parsed_once():
    assert shape("05.01.2025")[0] == "99.99.9999" and shape("Pazar, 5 Ocak 2025")[0] == "W, 9 M 9999" and shape("18:00 (Europe/Berlin)")[0] == "99:99 (R)"
    before = parser_for.cache_info().currsize
    to_instants(["01.01.2025", "02.01.2025"], ["10:00", "11:00"], ZONES)
    assert parser_for.cache_info().currsize <= before + 2


def test_instants_in_a_table(spark):
    df = spark.createDataFrame([(1, "05.01.2025", "19:00", "x"), (2, "05.01.2025", "19.00", "y"), (3, None, None, None)], "id long, date string, time string, start_utc string")
    out = with_instant(df, "date", "time")
    assert {r.id: (r.start_utc, r.u) for r in out.withColumn("u", unusual("date", "time")).collect()} == {1: ("2025-01-05T16:00:00Z", False), 2: ("2025-01-05T16:00:00Z", True), 3: (None, True)}
    assert with_instant(df.limit(0), "date", "time").count() == 0 and out.columns.count("start_utc") == 1


def brute_changes(rows):
    snaps = sorted({r[0] for r in rows if r[0] is not None})
    of = {s: {} for s in snaps}
    for s, k, *rest in rows:
        if k is not None and s is not None:
            of[s].setdefault(k, set()).add(repr(rest[:3]))
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        for k in of[a].keys() | of[b].keys():
            kind = "added" if k not in of[a] else "removed" if k not in of[b] else "changed" if of[a][k] != of[b][k] else None
            if kind:
                out.add((b, k, kind))
    return out


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in (3, 4, 9):
        for _ in range(120):
            rows.append((s, rng.choice([None, *"abcdefghijklmnopqrst"]), rng.choice([None, "", "x"]), rng.choice([None, [], ["p"], ["p", None], ["q", "p"]]), rng.choice([None, 1]), rng.randint(1, 99)))
    rows += [(3, "hot", "v", [], None, i) for i in range(400)] + [(4, "hot", "v", [], None, i) for i in range(3)] + [(9, "hot", "w", [], None, 1)] + [(None, "z", "v", [], 1, 1)]
    df = spark.createDataFrame(rows, "snap_no int, content_key string, change_kind string, crew array<string>, n int, pos int")
    got = snapshot_changes(df, "snap_no", "content_key", ("pos",)).collect()
    assert len(got) == len({(r[0], r[1]) for r in got}) and {(r[0], r[1], r[2]) for r in got} == brute_changes(rows)
    assert snapshot_changes(df.limit(0), "snap_no", "content_key").count() == 0
    assert snapshot_changes(df.where("snap_no = 3"), "snap_no", "content_key").count() == 0


def test_skewed_attach_and_rank(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 700).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert attach(rows, groups, ["k"], "n").count() == 3000
    assert {(r.id, r.first) for r in attach(rows, groups, ["k"], "n").collect()} == {(r.id, r.first) for r in rows.join(groups, "k").collect()}
    ranks = {}
    for r in dense_rank_in(rows, ["k"], F.col("id"), "id", "at", salts=7).collect():
        ranks.setdefault(r.k, []).append(r["at"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "id int, k string, v string")
    s = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "3", 1), (None, "4", 1)], "k string, v string, o int")
    got = {tuple(r) for r in merge.upsert(t, s, ["k"], ["v"], ["o"]).collect()}
    assert got == {(1, "a", "2"), (2, "b", "old"), (3, None, "old"), (None, "c", "3"), (None, None, "4")}
    once = merge.upsert(t.where("k IS NOT NULL"), s.where("k IS NOT NULL"), ["k"], ["v"], ["o"])
    twice = merge.upsert(once, s.where("k IS NOT NULL"), ["k"], ["v"], ["o"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_detect_changes(spark):
    at = [datetime(2025, 1, d) for d in (1, 2, 3)]
    sheet = merge.NATIVE_SHEET
    files = [("new", "x", None, None), ("s+", sheet, None, at[2]), ("s=", sheet, None, at[1]), ("s?", sheet, None, None), ("m+", "x", "2", at[0]), ("m=", "x", "1", at[2]), ("m?", "x", None, at[2])]
    known = [(f[0], "1", at[1]) for f in files[1:]]
    f = spark.createDataFrame(files, "file_id string, mime string, md5 string, modified timestamp_ntz")
    k = spark.createDataFrame(known, "file_id string, last_md5 string, known_modified timestamp_ntz")
    assert {r.file_id: r.process for r in merge.detect_changes(f, k).collect()} == {"new": True, "s+": True, "s=": False, "s?": True, "m+": True, "m=": False, "m?": False}
    assert all(r.process for r in merge.detect_changes(f, k, force=True).collect())


def test_ids_are_dense_and_stable(spark):
    old = spark.createDataFrame([(41,)], "id long")
    new = spark.range(100).select(F.col("id").cast("string").alias("k"))
    a = {r.k: r.id for r in merge.with_ids(new, old, "id", ["k"], 8).collect()}
    assert sorted(a.values()) == list(range(42, 142)) and a == {r.k: r.id for r in merge.with_ids(new.repartition(7), old, "id", ["k"], 8).collect()}


def test_lock_and_pace():
    free, state = merge.acquire_lock({}, NOW)
    assert free and not merge.acquire_lock(state, NOW)[0] and merge.acquire_lock(state, datetime(2025, 11, 1, 12, 16))[0]
    failed = merge.release_lock(merge.release_lock(state, False, NOW), False, NOW)
    assert failed["errors"] == 2 and merge.release_lock(failed, True, NOW)["errors"] == 0
    done = merge.release_lock(state, True, NOW)
    assert not merge.may_run(done, NOW) and merge.may_run(done, NOW, force=True) and merge.may_run({}, NOW)


def cells(spark, *rows):
    return spark.createDataFrame([(f, s, n, c, "x") for f, s, n, c in rows], "file string, sheet string, row_no int, cells array<string>, fields string")


def test_parse_cells(spark):
    head = ["TARİH", "SAAT", "SALON", "A TAKIMI", "B TAKIMI", "KATEGORİ", "HAKEM", "", "SAYI GÖREVLİSİ", "GÖZLEMCİ"]
    df = cells(
        spark,
        ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 1, ["title", "", ""]), ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 3, head),
        ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 4, ["01.02.2026", "10:00", "01.02.2026 - Hall", "X", "YY SK", "U12", "Ali Kaya", "Can Su", "Ece Ay", "-"]),
        ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 5, ["02.02.2026", "", "", "", "", "", "", "", "", ""]),
        ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 6, ["", "1899-12-30", "", "QQ", "ZZ", "", "", "Ad Soy", "", "", "extra one"]),
        ("3. HAFTA ÖZEL LİG.xlsx", "Sheet1", 7, ["soon", "9.30", "ab", "KK", "LL"]),
        ("a.xlsx", "one row", 1, head), ("b.xlsx", "no header", 1, ["a", "b", "c"]), ("b.xlsx", "no header", 2, ["1", "2", "3"]),
    )
    got = {r.src_row: r for r in sheets.parse_cells(df).collect()}
    assert sorted(got) == [4, 6, 7]
    a, b, c = (got[k] for k in (4, 6, 7))
    assert (a.match_name, a.date_text, a.time_text, a.venue, a.category, a.week, a.league_type) == ("YY SK", "01.02.2026", "10:00", "Hall", "U12", 3, "ÖZEL LİG VE ÜNİVERSİTE")
    assert a.referees == ["Ali Kaya", "Can Su"] and a.table_officials == ["Ece Ay"] and a.observers == []
    assert (b.match_name, b.date_text, b.time_text, b.venue, b.category, b.referees) == ("QQ - ZZ", "02.02.2026", "", "Hall", "3. HAFTA ÖZEL LİG", ["Ad Soy"])
    assert (c.date_text, c.time_text, c.venue) == ("soon", "9.30", "ab")
    assert sheets.parse_cells(df.limit(0)).count() == 0


def test_classes(spark):
    names = ["tarih", "gün", "saat", "saat görevlisi", "salon", "organizasyon", "kategori", "grup", "ev sahibi", "istatistik", "sağlıkçı", "gözlemci", "saha komiseri", "masa", "şut saati", "yardımcı hakem", "h1", "notlar"]
    want = ["date", "date", "time", "table", "venue", "organisation", "category", "group", "team", "stat", "medic", "observer", "commissioner", "table", "time", "referee", "referee", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(sheets.column_class(F.col("n"))).collect()] == want


def test_resolution(spark):
    people = [(1, "Deniz", "Örnek"), (2, "Ata Deniz", "Örnek"), (3, "Can", "Sınama"), (4, "Ece", "Deneme"), (5, "Ali", "Tarzan"), (6, "Ali", "Tarhan"), (7, "Işıl", "Kontrol"), (8, "Işıl", "Kontrol"), (9, "Lale", "Kaynak Testi"), (9, "Lale", "Kaynak"), (10, "Gül Nur", "Örnekoğlu"), (11, None, "Boş")]
    names = ["DENİZ ÖRNEK", "ATA DENİZ ÖRNEK", "CAN SINAMA- ECE DENEME", "ALİ TARZAN", "ALİ TARYAN", "IŞIL KONTROL", "LALE KAYNAK", "GÜLNUR ÖRNEKOĞLU", "???", None]
    profiles = spark.createDataFrame([(*p, "x") for p in people], "user_id long, first_name string, last_name string, cell string")
    c = spark.createDataFrame([(n,) for n in names], "cell string")
    got = {}
    for r in resolve.resolve_cells(c, profiles).where("NOT ambiguous").collect():
        got.setdefault(r.cell, set()).add(r.user_id)
    assert got == {"DENİZ ÖRNEK": {1}, "ATA DENİZ ÖRNEK": {2}, "CAN SINAMA- ECE DENEME": {3, 4}, "ALİ TARZAN": {5}, "IŞIL KONTROL": {7, 8}, "LALE KAYNAK": {9}}
    assert {r.cell: r.user_id for r in resolve.resolve_similar(c, profiles).collect()}["GÜLNUR ÖRNEKOĞLU"] == 10
    assert resolve.resolve_cells(c.limit(0), profiles).count() == 0 and resolve.resolve_similar(c, profiles.limit(0)).count() == 0


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 30))) for _ in range(60)]

    def noisy(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["z"], [s[k], "y"]])
        return "".join(s) or "a"

    cell = [noisy(b) for b in base for _ in range(3)]

    def dist(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    profiles = spark.createDataFrame([(i, b[:2], b[2:]) for i, b in enumerate(base)], "user_id long, first_name string, last_name string")
    got = {(r.cell, r.user_id) for r in resolve.similar_pairs(spark.createDataFrame([(c,) for c in cell], "cell string"), profiles).collect()}
    assert got == {(c, i) for c in cell for i, b in enumerate(base) if 1 - dist(c, b) / max(len(c), len(b)) >= 0.9}
