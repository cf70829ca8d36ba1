from datetime import datetime

from fixturelake.llm.survivor import judged_values, stands_in, survivors

SCHEMA = (
    "id long, content_key string, match_name string, date_text string, time_text string, venue string, category string, created_at timestamp_ntz, src_file string, cancelled_at timestamp_ntz, "
    "referees array<string>, table_officials array<string>, medics array<string>, statisticians array<string>, observers array<string>, commissioners array<string>, g string"
)
T = [datetime(2025, 1, d) for d in range(1, 9)]
SLOT = {"date_text": "01.01.2025", "time_text": "10:00", "venue": "V"}


def test_groups_and_survivors(rows):
    df = rows(
        SCHEMA,
        {"id": 5, "content_key": "a", "match_name": "X - Y", "created_at": T[0], "referees": ["Ali Kaya", "Can Su"], "src_file": "f"},
        {"id": 2, "content_key": "a", "match_name": "X - Y", "created_at": T[1], "referees": ["Ali Kaya", "-", "???"], "venue": "Hall"},
        {"id": 9, "content_key": "a", "match_name": "X - Y", "created_at": T[2], "referees": ["Ali Kaya"], "medics": ["Can Su"], "src_file": "g"},
        {"id": 1, "content_key": "a", "created_at": T[7], "cancelled_at": T[7], "referees": ["A", "B", "C"]},
        {"id": 20, "content_key": "b", "created_at": T[0]},
        {"id": 30, "match_name": "TBD - TBD", **SLOT, "created_at": T[0], "referees": ["P Q", "R S"], "observers": ["T U", "*"]},
        {"id": 31, "content_key": "c", "match_name": "X - Z", **SLOT, "created_at": T[0], "referees": ["R S", "P Q"], "observers": ["T U"], "medics": ["V W"]},
        {"id": 32, "content_key": "d", "match_name": "M - N", **SLOT, "created_at": T[0], "referees": ["P Q"]},
        {"id": 40, "match_name": "? - ?", "created_at": T[0], "referees": ["K L", "M N"]},
        {"id": 41, "content_key": "e", "match_name": "X - Q", "created_at": T[0], "referees": ["K L", "M N"]},
        {"id": 50, "match_name": "3x3 - 3x3", "created_at": T[0], "referees": ["K L", "M N", "O P"]},
        {"id": 51, "match_name": "A1 - B2", "created_at": T[0], "referees": ["K L", "M N", "O P"]},
        {"id": 60, "content_key": "t", "created_at": T[3], "referees": ["K L"]},
        {"id": 61, "content_key": "t", "created_at": T[3], "referees": ["K L"]},
    )
    got = {r.group_id: r for r in survivors(df).collect()}
    assert {g: r.survivor_id for g, r in got.items()} == {2: 9, 30: 31, 50: 50, 60: 60}
    assert got[2].venue == "Hall" and got[2].n_rows == 3 and "Ali Kaya" in got[2].referees and "-" not in got[2].referees
    assert got[60].referees == ["K L"] and got[60].medics == []
    assert survivors(df.limit(0)).count() == 0


def test_standins(spark):
    yes = ["? - ?", "TBD - TBD", "GALİP 1 - GALİP 2", "A1 - B2", "Kura sonrası", "Yarı final 1. maç", "GRUP BİRİNCİSİ - GRUP İKİNCİSİ", "Eşleşme bekleniyor", "Takımlar belli olunca yazılacak"]
    no = ["3x3 - 3x3", "X SK - Y SK", "ДРУЖБИН ЩИТ - BK", "A1 - Kartal SK", None]
    df = spark.createDataFrame([(n,) for n in yes + no], "n string")
    assert [r[0] for r in df.select(stands_in(df.n)).collect()] == [True] * len(yes) + [False] * len(no)


def test_a_source_that_invents_values_is_believed_less(spark):
    members, claims = [], []
    for k in range(40):
        for i, s in enumerate(("good", "fair", "liar")):
            members.append((f"g{k}", 3 * k + i, s))
            claims.append((f"g{k}", 3 * k + i, s, "f", f"lie{k}" if s == "liar" else f"true{k}"))
    got = judged_values(spark.createDataFrame(members, "g string, id long, source string"), spark.createDataFrame(claims, "g string, id long, source string, field string, value string"))
    p = {r.value: r.p for r in got.collect()}
    assert all(p[f"true{k}"] > 0.9 > 0.2 > p[f"lie{k}"] for k in range(40))


def test_an_unreliable_source_is_outvoted(rows):
    """Two rows a game: source g lists what the third source confirms, source h invents names and halls; g's values survive, though h's rows are later."""
    made = []
    for k in range(40):
        base = {"content_key": f"k{k}", "match_name": "X - Y", "date_text": "d", "time_text": "t", "category": "c"}
        good, bad = {"venue": f"Hall {k}", "referees": [f"Good {k}", "Ali Kaya"]}, {"venue": f"Barn {k}", "referees": [f"Bad {k}", "Can Su"]}
        made += [{"id": 10 * k, **base, **good, "src_file": "g", "created_at": T[0]}, {"id": 10 * k + 1, **base, **bad, "src_file": "h", "created_at": T[2]}]
        if k < 30:
            made.append({"id": 10 * k + 2, **base, **good, "src_file": "f", "created_at": T[1]})
    df = rows(SCHEMA, *made)
    got = {r.group_id: r for r in survivors(df).collect()}
    assert len(got) == 40
    for k in range(40):
        r = got[10 * k]
        assert r.venue == f"Hall {k}" and f"Good {k}" in r.referees and f"Bad {k}" not in r.referees
    # without the model's rounds all sources count alike, and the later row wins where two disagree
    plain = {r.group_id: r for r in survivors(df, 0).collect()}
    assert plain[390].venue == "Barn 39"
