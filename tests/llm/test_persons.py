import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixturelake.llm.nearwords import NearWords, distance
from fixturelake.llm.persons import anchor_keys, anchors, edits_allowed, joined_names, resolve_cells, same_accounts
from fixturelake.session import shared_dir

PEOPLE = [
    (1, "Deniz", "Örnekkaya"), (2, "Ata Deniz", "Örnekkaya"), (3, "Mehmet", "Sınamacı Denemeer"), (4, "Yağız Efe", "Kontrolbey"), (5, "Lale", "Tarzanoğlu"),
    (6, "Jale", "Uzunharman"), (7, "Mustafa", "Uzunharman"), (9, "Lale", "TARZNOĞLU"), (10, "Rüya", "Kısabacak"), (11, "Rüya", "Kısa Bacak"), (12, "Oğuz", None), (13, None, None),
]
NAMED = [p for p in PEOPLE if p[1] and p[2]]


def meant(spark, people, cells):
    """{cell: sorted accounts}"""
    shared_dir(spark)
    accounts = spark.createDataFrame(people, "user_id long, first_name string, last_name string")
    df = spark.createDataFrame([("f", i, 0, c) for i, c in enumerate(cells)], "field string, row_id long, pos int, cell string")
    out = {c: [] for c in cells}
    for r in resolve_cells(df, accounts).collect():
        out[cells[r.row_id]] = sorted([*out[cells[r.row_id]], r.user_id])
    return out


WHO = [
    ("MEHMET SINAMACI DENEMEER", []), ("mehmet  sınamacı denemeer", []), ("SINAMACI DENEMEER MEHMET", [3]), ("M. SINAMACI", [3]), ("Memo Sınamacı Denemeer", [3]),
    ("MHMT. SINAMACI DENEMEER", [3]), ("Mehmet Sinamaci Denemeer", []), ("Yagiz Efe Kontrolbey", [4]), ("mehmetsınamacı", [3]), ("HK. YAĞIZ EFE KONTROLBEY (ADAY)", [4]), ("Yağız Kontrolbey", [4]),
    ("EFE KONTROLBEY", [4]), ("YAĞIZ EFE KONTROLBYE *", [4]), ("Yağız Kontrol Bey", [4]), ("KONTROLBEY, YAĞIZ EFE", [4]), ("TARZNOĞLU LALE", [5]), ("Lale TARZNOĞLU", [5]),
    ("UZUNHARMAN", []), ("LALE UZUNHARMAN", []), ("J. Uzunharman", [6]), ("JALE UZUNHARMAN / LALE TARZANOĞLU", [5, 6]), ("JALE UZUNHARMAN-MUSTAFA UZUNHARMAN", [6, 7]),
    ("???", []), ("-", []), ("", []), ("A. Yabancıoğlu", []), ("D. ÖRNEKKAYA", [1]),
    ("Jale Uzunharman ve Lale Tarzanoglu ve Mehmet Sinamacı", [3, 5, 6]), ("JALE UZUNHARMAN / ??? / SINAMACI MEHMET, YAGIZ KONTROLBEY", [3, 4, 6]),
]


def test_who(spark):
    assert meant(spark, PEOPLE, [c for c, _ in WHO]) == dict(WHO)


SHORT = [(1, "Ahmet", "Koç"), (2, "Zeynep", "Demirtaş"), (3, "Hasan", "Kocak"), (4, "Ela", "Öz"), (5, "Can", "Er"), (6, "Suna", "Ak")]
SHORT_WHO = [
    ("A. Koç", [1]), ("KOÇ A.", [1]), ("Ahm. Koç", [1]), ("Ahmet Koc", [1]), ("Ahmet Koc ve Zeynep Demirtas ve Hasan Koçak", [1, 2, 3]), ("ÖZ ELA", [4]), ("Oz Ela", [4]), ("C. Er", [5]), ("Suna AK *", [6]), ("Er, Can / Ak Suna", [5, 6]), ("Ak", []), ("A K", []),
]


def test_short_surnames_and_several_people(spark):
    assert meant(spark, SHORT, [c for c, _ in SHORT_WHO]) == dict(SHORT_WHO)


def test_recall_on_planted_variants(spark):
    """Recall over planted spellings of 100 invented people: 0.99 or more, and no cell means another person."""
    rnd = random.Random(11)
    heads, tails = ["Kızıl", "Boz", "Alaca", "Demir", "Sarp", "Kuzgun", "Turnaz", "Meşebar", "Zeybel", "Ilgıt"], ["kaymaz", "tepeli", "bükülmez", "sancaktan", "oğlu", "pınarbey", "durmazlar", "erenbey", "çalan", "zorbilek"]
    given = ["Ahmet", "Zeynep", "Mustafa", "Gülşah", "Ömer Faruk", "Elif Naz", "Hüseyin", "Nurettin", "Beyza", "Çağla"]
    people = [(i, rnd.choice(given), h + t) for i, (h, t) in enumerate((h, t) for h in heads for t in tails)]

    def typo(w):
        k = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :]])

    ways = [lambda f, x: f"{x} {f}", lambda f, x: f"{f[0]}. {x}", lambda f, x: f"{f} {typo(x)}".upper(), lambda f, x: f"{typo(f.split()[0])} {x}", lambda f, x: f"{f}{x}".replace(" ", "").lower(), lambda f, x: f"HK. {x}, {f}",
            lambda f, x: f"{f} {x[:5]} {x[5:]}", lambda f, x: f"{f} {typo(typo(x))}"]
    planted = {way(f, x): i for i, f, x in people for way in ways}
    got = meant(spark, people, list(planted))
    found = sum(got[c] == [i] for c, i in planted.items())
    assert found >= 0.99 * len(planted)
    assert sum(bool(got[c]) and got[c] != [i] for c, i in planted.items()) <= 0.002 * len(planted)


@pytest.mark.parametrize("parts", [1, 7])
def test_any_spread_gives_the_same(spark, parts):
    shared_dir(spark)
    accounts = spark.createDataFrame(NAMED, "user_id long, first_name string, last_name string").repartition(parts)
    cells = spark.createDataFrame([("f", i, 0, c) for i, (c, _) in enumerate(WHO)], "field string, row_id long, pos int, cell string").repartition(parts)
    got = {(r.row_id, r.user_id) for r in resolve_cells(cells, accounts).collect()}
    assert got == {(i, u) for i, (_, us) in enumerate(WHO) for u in us}


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=300, deadline=None)
def test_distance_is_alignment_distance(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert distance(a, b, 9) == d[-1][-1]
    assert distance(a, b, 1) == min(d[-1][-1], 2)


@given(st.sets(st.text("abc", min_size=7, max_size=9), max_size=12), st.text("abc", min_size=7, max_size=9))
@settings(max_examples=150, deadline=None)
def test_index_misses_no_near_word(words, w):
    assert {x for _, x in NearWords(words, 2).near(w, 2)} == {x for x in words if distance(w, x, 2) <= 2}


LONG = [(1, "Necmettin", "Zeybelzorbilek"), (2, "Vildan", "Nergüzpınarsoy"), (3, "Rüya", "Kısabacak"), (4, "Ömer", "Taşan"), (5, "Ali Can", "Uzun Çamlıdere")]
LONG_WHO = [("Necmettin Zeylbzorbilek", [1]), ("VİLDAN NERGÜZPINAORY", [2]), ("rüyakısbaçk", [3]), ("canuzn", [])]


def test_candidates_as_far_as_the_scorer(spark):
    assert meant(spark, LONG, [c for c, _ in LONG_WHO]) == dict(LONG_WHO)


def share_a_key(a, b, joined):
    keys = [{k for at in anchors(w, joined) for k in anchor_keys(at)} for w in (a, b)]
    return bool(keys[0] & keys[1])


EDITS = st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["del", "ins", "sub", "swap"]), st.sampled_from("abx")), max_size=3)


@given(st.text("abc", min_size=2, max_size=22), EDITS)
@settings(max_examples=2000, deadline=None)
def test_near_words_share_a_key(word, edits):
    other = word
    for at, how, c in edits:
        k = at % max(1, len(other))
        other = {"del": other[:k] + other[k + 1 :], "ins": other[:k] + c + other[k:], "sub": other[:k] + c + other[k + 1 :], "swap": other[:k] + other[k + 1 : k + 2] + other[k : k + 1] + other[k + 2 :]}[how]
    if len(other) >= 2:
        most = edits_allowed(min(len(word), len(other)))
        assert distance(word, other, most) > most or share_a_key(word, other, False)
        if len(word) >= 9:
            assert distance(word, other, 2) > 2 or share_a_key(word, other, True)


def test_joined_names():
    assert joined_names(["ali", "can"], ["uzun", "dere"]) >= {"aliuzun", "alicanuzundere", "canuzun", "uzunali", "uzundereali"}


def test_same_accounts(spark):
    shared_dir(spark)
    df = spark.createDataFrame([(*p, "x") for p in PEOPLE], "user_id long, first_name string, last_name string, key string")
    assert {(r.user_id, r.owner) for r in same_accounts(df).collect() if r.user_id != r.owner} == {(9, 5), (11, 10)}
    assert same_accounts(df.limit(0)).count() == 0


def test_cells_in_a_table(spark):
    accounts = spark.createDataFrame(PEOPLE, "user_id long, first_name string, last_name string")
    many = [("f", i, 0, "J. UZUNHARMAN") for i in range(300)]
    cells = spark.createDataFrame([*many, ("f", 1000, 1, None), ("f", 1001, 0, " "), ("g", 1, 2, "LALE TARZANOĞLU + Mustafa Uzunharman")], "field string, row_id long, pos int, cell string")
    want = {("f", i, 0, 6) for i in range(300)} | {("g", 1, 2, 5), ("g", 1, 2, 7)}
    assert {tuple(r) for r in resolve_cells(cells, accounts).collect()} == want
    assert resolve_cells(cells.limit(0), accounts).count() == 0
    assert resolve_cells(cells, accounts.limit(0)).count() == 0
