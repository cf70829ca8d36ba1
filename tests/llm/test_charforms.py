import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixturelake.llm.charforms import hidden_forms, unify_strings, unify_text

CASES = [
    ("ＳＫ － ＢＫ", "SK - BK"), ("ВАSКEТ", "BASKET"), ("ВК", "BK"), ("S.Κ.", "S.K."), ("K", "K"), ("ﬁ", "fi"),
    ("KÖ​PR­Ü﻿", "KÖPRÜ"), ("A B C　D", "A B C D"), ("gül ç", "gül ç"), ("İ", "İ"), ("i̇", "i"),
    ("DÜZLÜǦÜ ș", "DÜZLÜĞÜ ş"), ("a ‑ b", "a - b"), ("ӧΪ", "öÏ"), ("Ѕ̧", "Ş"), ("ᵃ½", "ᵃ½"), ("Ꭺhmet ɑli", "Ahmet ali"), ("LİG Ⅳ", "LİG IV"), ("ⅻ. hafta", "xii. hafta"), ("ՍMUT", "UMUT"), ("ĳ", "ij"),
]
KEPT = ["ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "Երևան", "ДРУЖБИН ЩИТ - BK", "Φωλιά Ψαράδων", "Бджілія Жовтня", "a – b — c", "“x” ‘y’", "tab\tand\nline  ends", "IıİiŞş", "", "3x3 - 3x3", "😀 é"]


@pytest.mark.parametrize("raw,one", CASES)
def test_one_form(raw, one):
    assert unify_strings([raw]) == [one]


@pytest.mark.parametrize("text", KEPT)
def test_left_alone(text):
    assert unify_strings([text]) == [text]


def test_all_alike_word_beside_a_real_one_of_its_alphabet_stays():
    assert unify_strings(["ЩИТ ВК - ВК"]) == ["ЩИТ ВК - BK"]


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_applying_twice_changes_nothing_more(texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    once = unify_strings(texts)
    assert unify_strings(once) == once


def test_edges(rows):
    df = rows("id long, s string, out string, x array<int>", {"id": 1, "s": None}, {"id": 2, "s": ""}, {"id": 3, "s": "Ｋ" * 50_000, "x": [1]}, {"id": 3, "s": "Ｋ"})
    got = {(r.id, len(r.out or "")): r.out for r in unify_text(df, "s", "out").collect()}
    assert got == {(1, 0): None, (2, 0): "", (3, 50_000): "K" * 50_000, (3, 1): "K"}
    assert unify_text(df, "s", "out").columns == ["id", "s", "x", "out"]
    assert {(r.field, r.row_id) for r in hidden_forms(df, "s", "id", "f").collect()} == {("f", 3)}
    assert hidden_forms(df.limit(0), "s", "id", "f").count() == 0
