"""Symmetric-delete neighbourhood index of words, and the folding all name matching shares."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import combinations

_PLAIN = str.maketrans({"ı": "i", "ß": "ss", "æ": "ae", "ø": "o", "đ": "d", "ł": "l"})


def bare(text: str) -> str:
    """Lower case with dotted and dotless i alike, marks removed: ş becomes s."""
    s = text.replace("İ", "i").replace("I", "i").lower().translate(_PLAIN)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Runs of letters and runs of digits of the folded text."""
    return re.findall(r"[^\W\d_]+|\d+", bare(text))


def deletes(word: str, most: int) -> set[str]:
    """The word with up to ``most`` characters left out."""
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for at in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in at))
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits with neighbouring letters swapped as one (optimal string alignment); most + 1 when beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            row.append(c)
        if min(row) > most and (i < 2 or min(last) > most):
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


class NearWords:
    """Words within a small edit distance: two words that near share a form with few characters left out."""

    def __init__(self, words: set[str], most: int = 2, reach: Callable[[int], int] | None = None):
        """reach: letters left out of a word by its length, on both sides; with it, near finds all words within the reach of both."""
        self.reach = reach
        self.most, self.words, self.longest = most, frozenset(words), max(map(len, words), default=0)
        self.index: dict[str, list[str]] = {}
        for w in sorted(words):
            for d in deletes(w, self._reach(w)):
                self.index.setdefault(d, []).append(w)
        self._seen: dict[tuple[str, int], list[tuple[int, str]]] = {}

    def _reach(self, word: str) -> int:
        return min(self.most, self.reach(len(word)) if self.reach else max(0, (len(word) - 1) // 3))

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        """(distance, word) of all words within ``most`` edits, nearest first."""
        if len(word) > self.longest + most:
            return []
        most = min(most, self.most, self._reach(word) + (self.reach is None))
        key = (word, most)
        if (hit := self._seen.get(key)) is not None:
            return hit
        found = {w for d in deletes(word, most) for w in self.index.get(d, ())}
        out = sorted((d, w) for w in found if (d := distance(word, w, most)) <= most)
        if len(self._seen) > 500_000:
            self._seen.clear()
        self._seen[key] = out
        return out
