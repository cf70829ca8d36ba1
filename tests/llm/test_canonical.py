import pytest

from fixturelake.llm.canonical import Automaton, CategoryMapper, VenueMapper, map_values

VENUES = [(1, "Mavitepe Spor Kompleksi A Salonu - Çamlı", "Çamlı"), (2, "Mavitepe Spor Kompleksi B Salonu - Çamlı", "Çamlı"), (3, "Uzundere Kapalı Spor Salonu - Derebaşı", "Derebaşı"), (4, "Kışlaönü Gençlik Merkezi - Çamlı", "Çamlı"), (5, "Harmanyeri Lisesi Salonu - Ova", "Ova")]
KINDS = [(1, "U10 Kız", None), (2, "U10 Erkek", None), (3, "Büyük Kadınlar", None), (4, "Veteran 35+", None), (5, "3x3 Açık Kadın", None), (6, "Kurumlar Ligi", None), (7, "Üniversite Kadın", None), (8, "Hazırlık Maçı", None)]


@pytest.mark.parametrize("value,ref", [
    ("MAVİTEPE SPOR KOMPLEKSİ A SALONU", 1), ("Spor Kompleksi (B) Mavitepe", 2), ("mavitepe komp-b", 2), ("Mavitepe Spor Kompleksi", 0), ("MVİTEPE KOMPLEKSI A", 1),
    ("uzundere kss", 3), ("Derebaşı / Uzundere Kapalı", 3), ("Uzunedre Kap. Spor Sal.", 3), ("Uzundere Parkı", 0), ("Uzundere Halı Saha", 0), ("UZUNDERE", 3), ("Kislaonu GM", 4), ("Kışlaönü Lisesi", 0),
    ("Harmanyeri L. Salonu - 2. kat", 5), ("Belli değil", 0), ("?", 0), ("", 0), ("Salon netleşmedi", 0),
])
def test_venues(value, ref):
    assert VenueMapper(VENUES)(value) == ref


@pytest.mark.parametrize("value,ref", [
    ("u10k", 1), ("10 yaş altı erkek", 2), ("Kızlar U-10 Ligi", 1), ("U.10 Erkekler", 2), ("Kız-10", 1), ("10YA KIZ", 1), ("BK", 3), ("Bayanlar Büyük", 3), ("VETERAN +35", 4), ("3 x 3 Açık K", 5),
    ("KURUM LİGİ", 6), ("Üni K", 7), ("Ünivesite Kadın", 7), ("HAZ. MAÇI", 8), ("U10", 0), ("Kız", 0), ("Veteran", 0), ("U17 Karma", 0), ("Gösteri maçı", 0), ("", 0),
])
def test_categories(value, ref):
    assert CategoryMapper(KINDS)(value) == ref


def test_longest_mention_wins():
    a = Automaton({"a b": "long", "a": "short", "b c": "late"})
    assert a.mentions("x a b c a".split()) == (["long", "short"], ["x", "c"])
    assert Automaton({}).mentions(["x"]) == ([], ["x"])


def test_in_a_table(rows, spark):
    df = rows("rec_id long, venue string, ref_id string", *({"rec_id": i, "venue": "uzundere kss"} for i in range(200)), {"rec_id": 500}, {"rec_id": 501, "venue": VENUES[0][1]}, {"rec_id": 502, "venue": "x" * 20_000})
    entries = spark.createDataFrame(VENUES, "id int, name string, hint string")
    got = {r.rec_id: (r.ref_id, r.exact) for r in map_values(df, "venue", "rec_id", "venue", entries, VenueMapper).collect()}
    assert got == {i: (3, False) for i in range(200)} | {501: (1, True), 502: (0, False)}
    assert {r.ref_id for r in map_values(df, "venue", "rec_id", "v", entries.limit(0), VenueMapper).collect()} == {0}
    assert map_values(df.limit(0), "venue", "rec_id", "v", entries, VenueMapper).count() == 0


HALLS = [(1, "Kadıköy Caferağa Spor Salonu", None), (2, "Kadıköy Moda Spor Salonu", None), (3, "Beşiktaş Akatlar Spor Salonu", None), (4, "Yeni Mahalle Gençlik Merkezi", None), (5, "Üsküdar Burhan Felek Voleybol Salonu", None), (6, "Oak Street Gym", None)]
AGES = [(1, "Yıldız Erkek", None), (2, "Yıldız Kız", None), (3, "Minik Kız", None), (4, "Minik Erkek", None), (5, "Masters 40+", None), (6, "Lise Genç Kız", None), (7, "Lise Genç Erkek", None)]


@pytest.mark.parametrize("value,ref", [
    ("Kadıköy Caferaga Spor Salonu", 1), ("CAFERAĞA SPOR SALONU", 1), ("Caferağa SS", 1), ("Kadıköy Cafrağa Sp. Sal.", 1), ("kadikoy moda s.s.", 2), ("Kadıköy Spor Salonu", 0), ("Yeni Mahalle GM", 4), ("Yeni Mahale Gençlik Merkezi", 4),
    ("Burhan Felek", 5), ("oak street gym", 6), ("Oak Stret Gym", 6), ("Maltepe Spor Salonu", 0), ("Kadıköy Caferağa Parkı", 0),
])
def test_a_list_of_halls_never_seen(value, ref):
    assert VenueMapper(HALLS)(value) == ref


@pytest.mark.parametrize("value,ref", [
    ("YILDIZ ERKEKLER", 1), ("Yıldız Erkek", 1), ("yıldız kızlar", 2), ("Minik Kız", 3), ("minik kizlar", 3), ("MİNİK ERK.", 4), ("Masters +40", 5), ("masters 40", 5), ("Masters 50", 0), ("Minik", 0), ("Lise Genç Koz", 6), ("LİSE GENÇ KZI", 6), ("Lise Genç", 0), ("Genç", 0),
])
def test_a_list_of_ages_never_seen(value, ref):
    assert CategoryMapper(AGES)(value) == ref


def test_a_long_list_in_blocks(rows, spark):
    df = rows("rec_id long, venue string", *({"rec_id": i, "venue": v} for i, v in enumerate(["CAFERAĞA SPOR SALONU", "Yeni Mahalle GM", "oak street gym", "Maltepe", "Kadıköy Moda Spor Salonu", ""])))
    entries = spark.createDataFrame(HALLS, "id int, name string, hint string")
    for most in (100, 2):
        got = {r.rec_id: (r.ref_id, r.exact) for r in map_values(df, "venue", "rec_id", "venue", entries, VenueMapper, most).collect()}
        assert got == {0: (1, False), 1: (4, False), 2: (6, False), 3: (0, False), 4: (2, True), 5: (0, False)}
