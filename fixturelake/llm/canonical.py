"""Free-entered values mapped to a canonical list: an automaton over names and aliases, then token similarity."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import product
from math import log

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.llm.nearwords import NearWords, tokens
from fixturelake.operators.skew import attach
from fixturelake.session import durable, spread

#: Entries of a list held in memory at a time; a longer list is mapped block by block and the fits of all blocks compared.
LIST_ROWS = 200_000
#: Weighted share of words a value and an entry must have in common, and its lead over the next entry.
SIMILAR, LEAD = 0.75, 0.1
#: Share of entries from which a word tells nothing about which of them is meant.
GENERIC = 0.4

# Fixed values, used beside what the list itself gives: how words are written short, by the plain word; they count only where the list has the word.
VENUE_WORDS = {
    "spor": ["spor", "sp"], "salonu": ["salonu", "salon", "sal", "s"], "kompleksi": ["kompleksi", "kompleks", "komp", "kmp"],
    "kapali": ["kapali", "kap"], "genclik": ["genclik", "genc"], "merkezi": ["merkezi", "merkez", "mrk", "mer"],
    "lisesi": ["lisesi", "lise", "lis", "l"], "olimpik": ["olimpik", "olimp", "ol"], "koleji": ["koleji", "kolej", "kol"],
}
VENUE_SHORT = {"ss": "spor salonu", "kss": "kapali spor salonu", "gm": "genclik merkezi", "sk": "spor kompleksi", "os": "olimpik salonu", "ls": "lisesi salonu"}
#: Words that name another kind of place than any in the list.
VENUE_OTHER = [
    "hali saha", "saha", "sahasi", "park", "parki", "ortaokul", "ortaokulu", "ilkokulu", "okulu", "bahce", "bahcesi", "meydan",
    "meydani", "stadi", "stadyumu", "havuzu", "tesisi", "tesisleri", "kortu", "universitesi", "pisti",
]
CATEGORY_WORDS = {
    "kiz": ["kiz", "kizlar", "kizlari", "kz", "k"], "erkek": ["erkek", "erkekler", "erkk", "erk", "e"], "kadin": ["kadin", "kadinlar", "kad", "bayan", "bayanlar", "k"],
    "buyuk": ["buyuk", "buyukler", "a takim", "b"], "universite": ["universite", "universiteler", "uni", "unv", "univ"],
    "lise": ["lise", "liseler", "liseli"], "genc": ["genc", "gencler"], "ortaokul": ["ortaokul", "ortaokullar", "oo", "orta okul"],
    "kucuk": ["kucuk", "kucukler", "kuc"], "veteran": ["veteran", "veteranlar", "vet"], "kurumlar": ["kurumlar", "kurum", "kurumlararasi"],
    "tekerlekli": ["tekerlekli", "tek", "t"], "sandalye": ["sandalye", "sand"], "hazirlik": ["hazirlik", "haz"],
    "maci": ["maci", "mac", "maclari", "karsilasmasi", "musabakasi"], "acik": ["acik"], "3x3": ["3 x 3", "3 e 3", "3 ve 3"], "u": ["u", "ya", "yas alti", "yas"],
}
CATEGORY_SHORT = {"be": "buyuk erkek", "bk": "buyuk kadin", "ue": "universite erkek", "uk": "universite kadin"}
CATEGORY_NOISE = {"ligi", "lig", "kategori", "kategorisi", "grubu", "maclari"}
#: Words of the list that a value may leave out.
CATEGORY_LOOSE = {"ligi", "maci", "u"}


class Automaton:
    """Longest non-overlapping mentions of word sequences in a text of words."""

    def __init__(self, patterns: dict[str, str]):
        self.machine = ahocorasick.Automaton()
        for words, meaning in patterns.items():
            self.machine.add_word(f" {words} ", (len(words), words, meaning))
        if patterns:
            self.machine.make_automaton()
        self.empty = not patterns

    def mentions(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(meanings in order, words under no mention)."""
        text = f" {' '.join(words)} "
        if self.empty:
            return [], words
        hits = [(end - n, n, meaning) for end, (n, _, meaning) in self.machine.iter(text)]
        taken, spans = [], []
        for start, n, meaning in sorted(hits, key=lambda h: (-h[1], h[0])):
            if all(start + n <= a or start >= a + b for a, b in spans):
                spans.append((start, n))
                taken.append((start, meaning))
        rest, at = [], 1
        for w in words:
            if not any(a <= at < a + b for a, b in spans):
                rest.append(w)
            at += len(w) + 1
        return [m for _, m in sorted(taken)], rest


PLURAL = re.compile(r"(?<=\w{3})l[ae]r[i]?$")


def singular(word: str) -> str:
    return PLURAL.sub("", word)


def edits_of(n: int) -> int:
    """Edits by which a word of n letters may be misspelled."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


class TokenSets:
    """Weighted similarity of a value's words to an entry's: rare words weigh more, misspelled ones less; numbers and letters must agree."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.sets = [(ref, frozenset(map(singular, tokens(name)))) for ref, name, _ in rows]
        self.holders: dict[str, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.sets):
            for w in words:
                self.holders[w].append(k)
        self.weight = {w: log(1 + len(self.sets) / len(ks)) for w, ks in self.holders.items()}
        self.unknown = log(1 + len(self.sets))
        self.near = NearWords({w for w in self.holders if len(w) >= 3 and not w.isdigit()}, 3, edits_of)

    def __call__(self, words: list[str], whole: Callable[[str], bool] = lambda w: False) -> tuple[float, int]:
        """(similarity, id) of the entry meant, (0, 0) when none leads. ``whole``: words that are no misspelling of another."""
        alike: dict[str, dict[str, float]] = {}
        for w in set(map(singular, words)):
            if w in self.holders or len(w) < 3 or w.isdigit() or whole(w):
                alike[w] = {w: 1.0} if w in self.holders else {}
                if not alike[w] and (w.isdigit() or len(w) == 1):
                    return 0.0, 0
            else:
                alike[w] = {x: 1 - d / max(len(w), len(x)) for d, x in self.near.near(w, edits_of(len(w))) if d <= edits_of(min(len(w), len(x)))}
        rare = sorted({x for near in alike.values() for x in near}, key=lambda x: -self.weight[x])
        scored: dict[int, float] = {}
        for k in {k for x in rare for k in self.holders[x]}:
            ref, entry = self.sets[k]
            held, lost = 0.0, 0.0
            best: dict[str, float] = {}
            for w, near in alike.items():
                x = max((x for x in near if x in entry), key=near.get, default=None)
                if x is None:
                    lost += self.weight.get(w, self.unknown)
                else:
                    best[x] = max(best.get(x, 0.0), near[x])
            held = sum(self.weight[x] * c for x, c in best.items())
            if all(x.isalpha() and len(x) > 1 or x in entry for x in alike):
                scored[ref] = max(scored.get(ref, 0.0), held / (sum(self.weight[x] for x in entry) + lost))
        top = sorted(((c, -ref) for ref, c in scored.items()), reverse=True)[:2]
        if top and top[0][0] >= SIMILAR and (len(top) < 2 or top[0][0] - top[1][0] >= LEAD):
            return top[0][0], -top[0][1]
        return 0.0, 0


def prefixes(words: set[str]) -> dict[str, str]:
    """Beginnings of three letters and more that only one of the words has, by what they stand for."""
    found: dict[str, set[str]] = defaultdict(set)
    for w in words:
        for k in range(3, len(w)):
            found[w[:k]].add(w)
    return {p: ws.pop() for p, ws in found.items() if len(ws) == 1 and p not in words}


class VenueMapper:
    """Place, kind of hall, hall letter and district of a free-entered venue, against the list.

    Kinds are the words that never begin an entry's name and that several names share (or known ones); what else a name begins
    with is its place, of any number of words.
    """

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        heads = [(ref, tokens(name.rsplit(" - ", 1)[0]), " ".join(tokens(district or ""))) for ref, name, district in rows]
        heads = [h for h in heads if h[1]]
        count = Counter(w for _, ws, _ in heads for w in set(ws))
        first, end = {ws[0] for _, ws, _ in heads}, Counter(ws[-1] for _, ws, _ in heads)
        kinds = {w for w, n in count.items() if len(w) > 1 and (w in VENUE_WORDS or w not in first and (n >= 3 or end[w] >= 2))}
        self.same = {w: w + c for w in kinds for c in "iu" if w + c in kinds} | ({"salon": "salonu"} if "salon" in kinds else {})
        self.generic = {"spor", "salonu"} | {w for w in kinds if count[w] >= GENERIC * len(heads) and len(heads) > 2}
        self.entries: dict[str, list[tuple[int, frozenset[str], str, str]]] = defaultdict(list)
        patterns: dict[str, str] = {}
        owners: dict[str, set[str]] = defaultdict(set)
        for ref, ws, district in heads:
            place = " ".join(w for w in ws if w not in kinds and len(w) > 1) or ws[0]
            letter = next((w for w in ws[1:] if len(w) == 1), "")
            kind = [self.same.get(w, w) for w in ws if w in kinds and w not in place.split()]
            self.entries[place].append((ref, frozenset(kind), letter, district))
            for w in place.split():
                owners[w].add(place)
            for k in range(len(kind)):
                for j in range(k + 2, len(kind) + 1):
                    short = "".join(w[0] for w in kind[k:j])
                    for w in (short, " ".join(short)):
                        patterns[w] = "kind:" + " ".join(kind[k:j])
            if district:
                patterns.setdefault(district, "district:" + district)
        listed = {self.same.get(w, w) for w in kinds}
        for w in kinds:
            patterns[w] = "kind:" + self.same.get(w, w)
        shorts = prefixes(listed)
        for short, w in shorts.items():
            patterns.setdefault(short, "kind:" + w)
        for plain, written in VENUE_WORDS.items():
            for w in written if plain in listed else ():
                patterns[w] = f"kind:{plain}"
        for short, full in VENUE_SHORT.items():
            for w in (short, " ".join(short)) if set(full.split()) <= listed else ():
                patterns[w] = "kind:" + full
        for w in VENUE_OTHER:
            if not set(w.split()) & listed:
                patterns[w] = f"other:{w}"
        for w, of in owners.items():
            if len(of) == 1:
                patterns[w] = "place:" + next(iter(of))
        for place in self.entries:
            patterns[place] = f"place:{place}"
        self.automaton = Automaton(patterns)
        self.exact = {w for p in patterns for w in p.split()} | set(owners)
        # beginnings of words are too short to be told from other words when misspelled
        self.vocabulary = NearWords({w for w in self.exact if len(w) >= 4 and w not in shorts}, 2)
        self.words = set(owners)
        self.places = NearWords(self.words, 3)
        # word parts at which several places branch: a word made of two of them is a place of its own
        after, before = defaultdict(set), defaultdict(set)
        for p in self.words:
            for k in range(4, len(p) - 3):
                after[p[:k]].add(p[k])
                before[p[k:]].add(p[k - 1])
        self.heads, self.tails = ({w for w, cs in c.items() if len(cs) >= 3} for c in (after, before))
        self.sets = TokenSets(rows)

    def _own(self, w: str) -> bool:
        return any(w[:k] in self.heads and w[k:] in self.tails for k in range(4, len(w) - 3))

    def _nearest(self, w: str) -> str | None:
        if self._own(w):
            return None
        for index, most in ((self.vocabulary, 1 if len(w) < 6 else 2), (self.places, 3 if len(w) >= 11 else 2)):
            near = index.near(w, most)
            if near and (len(near) == 1 or near[1][0] > near[0][0]):
                return near[0][1]
        return None

    def repair(self, words: list[str]) -> tuple[list[str], int]:
        """Words outside the vocabulary become the one word that is nearest; neighbours may make one word. With the number of words so changed."""
        out, i, changed = [], 0, 0
        while i < len(words):
            w, nxt = words[i], words[i + 1] if i + 1 < len(words) else ""
            if w in self.exact:
                out.append(w)
            elif nxt and nxt not in self.exact and (w + nxt in self.words or len(w + nxt) > 9 and self.places.near(w + nxt, 1)):
                out.append(self._nearest(w + nxt) or w + nxt)
                changed += 1
                i += 1
            else:
                to = (self._nearest(w) if len(w) >= 4 else None) or w
                out.append(to)
                changed += to != w
            i += 1
        return out, changed

    def fits(self, value: str) -> tuple[float, list[int]]:
        """(how far the value is from what is meant, the entries it fits)."""
        note = re.sub(r"\([^)]{4,}\)", lambda m: m[0] if any(w in self.exact for w in tokens(m[0])) else " ", value)
        words = tokens(note)
        fixed, changed = self.repair(words)
        meanings, rest = self.automaton.mentions(fixed)
        by = defaultdict(list)
        for m in meanings:
            k, _, v = m.partition(":")
            by[k].append(v)
        places = set(by["place"])
        if by["other"] or len(places) > 1:
            return 0.0, []
        if not places:
            c, ref = self.sets(words, self._own)
            return 2.0 - c, [ref] if ref else []
        kind = {w for k in by["kind"] for w in k.split()}
        place = places.pop()
        found = self.entries[place]
        letters = {w for w in rest if len(w) == 1 and w.isalpha()} & ({e[2] for e in found} | set("abcd"))
        if not set(place.split()) & set(words) and by["district"] and not any(e[3] in by["district"] for e in found):
            return 0.0, []
        telling = kind - self.generic
        fit = [e for e in found if telling <= e[1] and (not kind or telling or kind <= e[1])]
        if letters:
            fit = [e for e in fit if e[2] in letters] if any(e[2] for e in fit) else fit
        return changed / (len(words) + 1), [e[0] for e in fit]

    def __call__(self, value: str) -> int:
        return only([self.fits(value)])


class CategoryMapper:
    """The words and the age of a free-entered category, against the list."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        listed = {singular(w) for _, name, _ in rows for w in tokens(name) if not w.isdigit()}
        self.plain = {singular(plain): plain for plain in CATEGORY_WORDS}
        patterns: dict[str, str] = {}

        def add(written: str, meaning: str) -> None:
            now = patterns.get(written, "").split("|") if patterns.get(written) else []
            if meaning not in now:
                patterns[written] = "|".join([*now, meaning])

        for w in sorted(listed):
            if len(w) > 1 or w == "u":
                add(w, w)
                for end in ("ler", "lar", "leri", "lari"):
                    add(w + end, w)
        for plain, written in CATEGORY_WORDS.items():
            for w in written if singular(plain) in listed or plain in ("3x3", "u") else ():
                add(w, singular(plain))
        shorts = {x: w for x, w in prefixes({w for w in listed if len(w) > 3}).items() if x not in patterns}
        for short, w in shorts.items():
            add(short, w)
        for short, full in CATEGORY_SHORT.items():
            if set(full.split()) <= listed:
                patterns[short] = full
        for w in CATEGORY_NOISE:
            patterns.setdefault(w, "")
        self.patterns = patterns
        self.automaton = Automaton(patterns)
        self.exact = {w for p in patterns for w in p.split()}
        self.vocabulary = NearWords({w for w in self.exact if len(w) >= 3 and w not in shorts}, 2)
        self.entries: dict[frozenset[str], set[int]] = defaultdict(set)
        self.sets = TokenSets(rows)
        for ref, name, _ in rows:
            for sense in self._senses(name)[1]:
                self.entries[sense].add(ref)

    def _senses(self, value: str) -> tuple[int, list[frozenset[str]]]:
        words, changed = [], 0
        for w in tokens(value):
            near = [] if w in self.exact or w.isdigit() or len(w) < 3 else self.vocabulary.near(w, 1 if len(w) < 7 else 2)
            if near and len({self.patterns.get(x, x) for d, x in near if d == near[0][0]}) == 1:
                w = near[0][1]
                changed += 1
            words.append(w)
        meanings, rest = self.automaton.mentions(words)
        if not all(w.isdigit() for w in rest):
            return changed, []
        options = [m.split("|") for m in meanings if m]
        return changed, [frozenset(w for o in pick for w in o.split() if w not in CATEGORY_LOOSE) | frozenset(rest) for pick in product(*options)]

    def fits(self, value: str) -> tuple[float, list[int]]:
        """(how far the value is from what is meant, the entries it fits)."""
        changed, senses = self._senses(value)
        found = set().union(*(self.entries.get(s, set()) for s in senses))
        if not found:
            c, ref = self.sets(tokens(value))
            return 2.0 - c, [ref] if ref else []
        return changed / (len(value) + 1), sorted(found)

    def __call__(self, value: str) -> int:
        return only([self.fits(value)])


def only(fits: list[tuple[float, list[int]]]) -> int:
    """The one entry that fits nearest over all blocks of a list; 0 for none or several."""
    near = min((c for c, refs in fits if refs), default=None)
    found = {r for c, refs in fits if refs and c == near for r in refs}
    return found.pop() if len(found) == 1 else 0


def map_values(df: DataFrame, column: str, row: str, field: str, entries: DataFrame, mapper: Callable, most: int = LIST_ROWS) -> DataFrame:
    """(field, row, value, ref_id): every non-null value with its entry of the list, 0 when it has none.

    ``entries`` is (ref_id, name, hint); up to ``most`` of them are shipped to the workers, where an automaton over
    their words and aliases derived from them marks the longest non-overlapping mentions of a value; a value without
    a full mention goes to the token-set similarity with all entries (SIMILAR, LEAD). A longer list is taken block by
    block; the fits of all blocks are compared, the nearest decides. Values shrink to distinct ones first, so a value
    that fills a third of the table is mapped once. A value letter for letter in the list keeps its entry (the
    smallest id of equal names). Empty values and an empty list give 0.
    """
    kept = entries.toDF("ref_id", "name", "hint").where("ref_id IS NOT NULL AND name IS NOT NULL")
    blocks = max(1, -(-kept.count() // most))
    values = df.where(F.col(column).isNotNull()).select(F.col(row).alias("rec_id"), F.col(column).alias("value"))
    distinct = spread(values.groupBy("value").agg(F.count(F.lit(1)).alias("_n")))
    parts = None
    for k in range(blocks):
        rows = sorted(((r[0], r[1], r[2]) for r in kept.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == k).collect()), key=lambda r: (r[0], r[1], r[2] or ""))

        def run(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            made, names = mapper(rows), {}
            for ref, name, _ in rows:
                names.setdefault(name, ref)
            for pdf in batches:
                got = [(-1.0, [names[v]]) if v in names else made.fits(v) for v in pdf["value"]]
                yield pdf.assign(cost=[c for c, _ in got], refs=[r for _, r in got])

        part = distinct.mapInPandas(run, "value string, _n long, cost double, refs array<int>")
        parts = part if parts is None else parts.unionByName(part)
    if blocks > 1:
        nearest = parts.where("size(refs) > 0").groupBy("value").agg(F.min(F.struct("cost")).alias("b")).select("value", F.col("b.cost").alias("cost"))
        best = parts.join(nearest, ["value", "cost"]).groupBy("value").agg(F.flatten(F.collect_list("refs")).alias("refs"), F.min("cost").alias("cost"))
        parts = distinct.join(best, "value", "left")
    refs = F.array_distinct("refs")
    ref = F.when(F.col("cost") < 0, F.array_min("refs")).when(F.size(refs) == 1, refs[0]).otherwise(0)
    mapped = durable(parts.select("value", "_n", F.coalesce(ref, F.lit(0)).cast("int").alias("ref_id"), F.coalesce(F.col("cost") < 0, F.lit(False)).alias("exact")))
    return attach(values, mapped, ["value"], "_n").select(F.lit(field).alias("field"), "rec_id", "value", "ref_id", "exact")
