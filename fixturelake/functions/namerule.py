"""Whether a cell names a profile: words spent greedily, surnames before given names, exact before misspelt."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MATCH = T.StructType([T.StructField("kind", T.StringType()), T.StructField("covered", T.ArrayType(T.IntegerType())), T.StructField("typo", T.BooleanType())])
_BREAKS = re.compile(r"[\s,.;\-/()﻿]+")


def normal(s: str | None) -> str:
    s = (s or "").replace("İ", "i").replace("I", "ı").lower().replace("i̇", "i")
    return re.sub(r"[\s﻿]+", " ", s).strip()


def cell_words(s: str | None) -> list[str]:
    return [w for w in _BREAKS.split(normal(s)) if any(c.isalpha() for c in w)]


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def match_cell(cell: str | None, first: str | None, last: str | None) -> tuple[str, list[int], bool] | None:
    """(exact | partial | short, indexes of the words covered, whether a misspelling was forgiven), or None.

    exact: every word of the cell belongs to the profile. partial: the whole profile is there word for word and
    at least two words are left, so a second person is named. short: the profile has one word more, its last
    surname or its first given name, and all others agree word for word.
    """
    if not cell or len(cell) < 3 or not first or not last:
        return None
    words, surnames, given = cell_words(cell), normal(last).split(" "), normal(first).split(" ")
    free, typo = dict(enumerate(words)), False
    for parts, least in ((surnames, 5), (given, 3)):
        for p in filter(None, parts):
            at = next((i for i, w in free.items() if w == p), None)
            if at is None:
                at = next((i for i, w in free.items() if min(len(w), len(p)) >= least and one_edit(w, p)), None)
                typo |= at is not None
            if at is None:
                return _short(words, [g for g in given if g], [s for s in surnames if s])
            del free[at]
    covered = [i for i in range(len(words)) if i not in free]
    if not free:
        return "exact", covered, typo
    return None if typo or len(free) < 2 else ("partial", covered, False)


def _short(words: list[str], given: list[str], surnames: list[str]) -> tuple[str, list[int], bool] | None:
    if len(words) < 2:
        return None
    dropped = ([given + surnames[:-1]] if len(surnames) > 1 else []) + ([given[1:] + surnames] if len(given) > 1 else [])
    return ("short", list(range(len(words))), False) if any(sorted(d) == sorted(words) for d in dropped) else None


@F.pandas_udf(_MATCH)
def cell_match(cell: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """match_cell over Arrow batches; a null struct field kind means no match."""
    none = lambda x: x if isinstance(x, str) else None
    got = [match_cell(none(c), none(f), none(s)) or (None, None, None) for c, f, s in zip(cell, first, last)]
    return pd.DataFrame(got, columns=["kind", "covered", "typo"])
