import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fixturelake.llm.folded_copies import group_copies, rolling_hashes, same_two_pointers, same_words

TEXT = st.text(st.sampled_from("aAbıIiİ .-'3ş\t​"), max_size=8)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.booleans())
@settings(max_examples=200, deadline=None)
def test_hashes_agree_exactly_where_the_texts_do(texts, apart):
    s, w, c = rolling_hashes(pa.array(texts, pa.string()), apart)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (s[i] == s[j]) == same_two_pointers(a, b)
            assert (w[i] == w[j]) == same_words(a, b, apart)
            assert c[i] == c[j] or not (same_two_pointers(a, b) or same_words(a, b, apart))


SCHEMA = "rec_id long, name string, venue string, clock string, crew array<string>, other string, seen string, _keep string"


def groups(df):
    return {r.rec_id: (r.keep_id, r.n_copies) for r in group_copies(df, "rec_id", ["name", "venue", "clock"], ("seen",), ("clock",)).collect()}


def test_copies(rows):
    base = {"name": "X SK - Y BK", "venue": "Hall A - Town", "clock": "16:30", "crew": ["a", "b"]}
    df = rows(
        SCHEMA,
        {"rec_id": 3, **base, "seen": "1"}, {"rec_id": 1, **base, "name": "(y bk — x sk)", "venue": "TOWN / HALL A", "clock": "1630"}, {"rec_id": 7, **base, "clock": "16 : 30."},
        {"rec_id": 4, **base, "clock": "13:60"}, {"rec_id": 5, **base, "name": "X SK - Y BK B"}, {"rec_id": 6, **base, "crew": ["a"]}, {"rec_id": 8, **base, "crew": ["b", "a"]},
        {"rec_id": 9, **base, "other": "o"}, {"rec_id": 10, **base, "venue": None}, {"rec_id": 11, **base, "venue": ""}, {"rec_id": 12, **base, "venue": None}, {"rec_id": 13}, {"rec_id": 14},
        {"rec_id": 20, **base, "name": "XSK - YBK"}, {"rec_id": 21, "name": "z" * 90_000}, {"rec_id": 22, "name": "Z" * 90_000},
    )
    got = groups(df)
    assert got == {3: (1, 4), 1: (1, 4), 7: (1, 4), 20: (1, 4), 4: (4, 1), 5: (5, 1), 6: (6, 1), 8: (8, 1), 9: (9, 1), 10: (10, 2), 12: (10, 2), 11: (11, 1), 13: (13, 2), 14: (13, 2), 21: (21, 2), 22: (21, 2)}
    assert groups(df.limit(0)) == {}


def test_collisions_are_found_out(rows):
    df = rows(SCHEMA, {"rec_id": 1, "name": "abc"}, {"rec_id": 2, "name": "xyz q"}, {"rec_id": 3, "name": "Q-XYZ"}, {"rec_id": 4, "name": "ABC"}, {"rec_id": 5, "name": "d"})
    for bits in (64, 1):
        got = group_copies(df, "rec_id", ["name", "venue", "clock"], ("seen",), ("clock",), bits=bits).collect()
        assert {r.rec_id: (r.keep_id, r.n_copies) for r in got} == {1: (1, 2), 4: (1, 2), 2: (2, 2), 3: (2, 2), 5: (5, 1)}


def linked(a, b, k):
    return same_two_pointers(a, b) or same_words(a, b, k == 2)


def brute_force(rows):
    """{id: (least id, number)} of everything linked: rows are (id, name, venue, clock)."""
    least = {r[0]: r[0] for r in rows}
    moved = True
    while moved:
        moved = False
        for x in rows:
            for y in rows:
                if least[y[0]] < least[x[0]] and all(linked(x[k + 1], y[k + 1], k) for k in range(3)):
                    least[x[0]] = least[y[0]]
                    moved = True
    return {i: (k, list(least.values()).count(k)) for i, k in least.items()}


def test_chains_join_in_any_order_of_rows(rows):
    chain = ["ab c", "a bc", "bc a", "b ca", "ca b", "c ab"]
    for ids in ([1, 2, 3, 4, 5, 6], [6, 2, 5, 1, 4, 3]):
        for n in (5, 6):
            df = rows(SCHEMA, *({"rec_id": i, "name": x} for i, x in list(zip(ids, chain))[:n]))
            least = min(ids[:n])
            assert groups(df) == dict.fromkeys(ids[:n], (least, n))


def test_equal_to_brute_force_on_random_texts(rows):
    rnd = random.Random(5)
    one = lambda: rnd.choice([None, "".join(rnd.choice("ab -'I") for _ in range(rnd.randrange(6)))])
    texts = [(i, one(), rnd.choice(["x y", "y x", "yx"]), rnd.choice(["1a2", "12 a", None])) for i in range(120)]
    df = rows(SCHEMA, *({"rec_id": i, "name": a, "venue": b, "clock": c} for i, a, b, c in texts))
    for bits in (64, 3):
        got = group_copies(df, "rec_id", ["name", "venue", "clock"], ("seen",), ("clock",), bits=bits).collect()
        assert {r.rec_id: (r.keep_id, r.n_copies) for r in got} == brute_force(texts)
