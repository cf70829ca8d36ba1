"""Variant spellings of people's names: a symmetric-delete index of tokens and an optimal token assignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.llm.charforms import unify_strings
from fixturelake.llm.links import components
from fixturelake.llm.nearwords import bare, deletes, distance
from fixturelake.operators.skew import attach
from fixturelake.session import broadcast_checked, durable

# Words beside a name that are no part of it.
TITLES = {"hk", "hakem", "ulusal", "bolge", "il", "sn", "sayin", "aday", "yedek", "uluslararasi", "fiba", "klasman", "hanim", "yrd"}
#: Short names that share too few letters with the name they stand for.
NICKNAMES = {"apo": "abdullah", "memo": "mehmet", "memis": "mehmet", "mamo": "muhammet", "sulo": "suleyman", "fato": "fatma", "hatce": "hatice"}
VOWELS = set("aeiou")
NICK_ENDS = ("os", "us", "is", "as", "ti", "to", "o", "s", "i", "u", "cik", "can", "csi", "ko", "ta", "it")

#: Costs: an initial, an abbreviation, a nickname, one edit; a given name or surname part left out; a part joined or cut apart.
INITIAL, SHORT, NICK, EDIT, LEFT_GIVEN, LEFT_LAST, JOIN = 0.30, 0.30, 0.45, 0.50, 0.20, 0.20, 0.10
#: Edits within which a word is a given name and surname written as one.
JOINED_EDITS, JOINED_LETTERS = 2, 9
#: Beyond this total a cell means nobody; the next person must cost so much more, or the cell is left open.
MOST, GAP, GAP_SHORT = 2.3, 0.12, 0.25
#: What a stretch of a cell costs that means nobody, when a cell is cut into people.
NOBODY = 9.0


def edits_allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 12 else 3


@lru_cache(maxsize=1_000_000)
def token_cost(cell: str, name: str, dotted: bool) -> float:
    """Cost of a cell token standing for a name token; infinite when it can't."""
    if cell == name:
        return 0.0
    if len(cell) == 1:
        return INITIAL if name[0] == cell else float("inf")
    best = float("inf")
    d = distance(cell, name, edits_allowed(min(len(cell), len(name))))
    if d <= edits_allowed(min(len(cell), len(name))):
        best = EDIT * d
    if cell[0] == name[0] and len(cell) < len(name):
        if (dotted and len(cell) <= 4 or len(cell) == 3) and name.startswith(cell):
            best = min(best, SHORT if dotted else SHORT + 0.1)
        consonants = [c for c in name[1:] if c not in VOWELS]
        it = iter(name)
        if all(c in it for c in cell) and [c for c in cell[1:] if c not in VOWELS] == consonants and (dotted or len(cell) <= len(name) - 2):
            best = min(best, SHORT)
        elif dotted and len(cell) <= 4 and _subsequence(cell, name):
            best = min(best, SHORT + 0.1)
    if NICKNAMES.get(cell) == name:
        best = min(best, NICK)
    for end in NICK_ENDS:
        stem = cell.removesuffix(end)
        if stem != cell and 2 <= len(stem) <= 4 and len(name) > len(stem) and name.startswith(stem):
            best = min(best, NICK)
    return best


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def spelling(text: str) -> str:
    """What decides whether a cell is the account's own spelling: case, i's and repeated blanks aside."""
    return re.sub(r"\s+", " ", text.replace("İ", "i").replace("I", "i").lower().replace("ı", "i")).strip()


def words_of(text: str) -> list[tuple[str, bool]]:
    """Letter runs of the folded text, and whether a point follows."""
    return [(m[1], m[2] == ".") for m in re.finditer(r"([^\W\d_]+)(\.?)", bare(text))]


def token(w: str, n: str, dot: bool, known: frozenset[str]) -> float:
    """token_cost, but a token that is someone's name as it stands is no misspelling of another name."""
    c = token_cost(w, n, dot)
    return c if c == 0 or len(w) < 3 or dot or w not in known else float("inf")


def align(words: tuple[tuple[str, bool], ...], given: tuple[str, ...], last: tuple[str, ...], known: frozenset[str]) -> float:
    """Least cost of assigning every cell token to a name token of its own; parts of a name may stay out."""
    names = given + last
    if len(words) > len(names):
        return float("inf")
    best: dict[int, float] = {0: 0.0}
    for w, dot in words:
        nxt: dict[int, float] = {}
        for k, n in enumerate(names):
            x = token(w, n, dot, known)
            if x < float("inf"):
                for mask, c in best.items():
                    if not mask >> k & 1 and c + x < nxt.get(mask | 1 << k, float("inf")):
                        nxt[mask | 1 << k] = c + x
        best = nxt
    g = len(given)
    total = float("inf")
    for mask, c in best.items():
        ins_given = sum(mask >> k & 1 for k in range(g))
        ins_last = sum(mask >> k & 1 for k in range(g, len(names)))
        if ins_given and ins_last and not (len(words) and all(len(w) == 1 for w, _ in words)):
            left_first = 0.15 if not mask & 1 else 0.0
            c += LEFT_GIVEN * (g - ins_given) + LEFT_LAST * (len(last) - ins_last) + left_first
            total = min(total, c)
    return total


def cost(words: list[tuple[str, bool]], given: tuple[str, ...], last: tuple[str, ...], known: frozenset[str]) -> float:
    """Cost of the words meaning the person: as they stand, with words joined, with names joined, with a word that is given name and surname in one."""
    ways = [(tuple(words), 0.0)]
    for k in range(len(words) - 1):
        if len(words) > 2 or len(words[k][0]) > 1 and len(words[k + 1][0]) > 1:
            ways.append(((*words[:k], (words[k][0] + words[k + 1][0], words[k + 1][1]), *words[k + 2 :]), JOIN))
    if len(words) >= 4:
        ways.append((tuple((words[k][0] + words[k + 1][0], False) for k in range(0, len(words) - 1, 2)), 2 * JOIN))
    forms = {(given, last), (given, ("".join(last),))} if len(last) > 1 else {(given, last)}
    if len(given) > 1:
        forms |= {(("".join(given),), x) for _, x in list(forms)}
    best = min(align(w, g, x, known) + c + JOIN * ((g, x) != (given, last)) for w, c in ways for g, x in forms)
    for k, (w, _) in enumerate(words):
        if len(w) >= JOINED_LETTERS:
            rest = words[:k] + words[k + 1 :]
            for g in range(len(given)):
                for joined in {"".join(given[: g + 1]) + last[0], given[g] + last[0], "".join(given[: g + 1]) + "".join(last), last[0] + given[g]}:
                    d = distance(w, joined, JOINED_EDITS)
                    if d <= JOINED_EDITS:
                        others = [n for n in given if n not in joined] + [n for n in last if n not in joined]
                        if not rest:
                            best = min(best, JOIN + EDIT * d + LEFT_GIVEN * len(others))
                        elif len(rest) <= len(others):
                            c = sum(min(token(r, n, dot, known) for n in others) for r, dot in rest)
                            best = min(best, JOIN + EDIT * d + c + LEFT_GIVEN * (len(others) - len(rest)))
    return best


def joined_names(given: list[str], last: list[str]) -> set[str]:
    """Given name and surname written as one word, in the ways cost knows."""
    firsts = {"".join(given[: k + 1]) for k in range(len(given))} | set(given)
    return {y for g in firsts for x in ("".join(last), last[0]) for y in (g + x, x + g)}


def runs_of(cell: str, longest: int) -> list[tuple[int, int, list[tuple[str, bool]]]]:
    """(from, to, words): the whole cell as (0, 0), then each run of its pieces that a person of at most ``longest`` words can fill."""
    text = re.sub(r"\([^)]*\)|\*", " ", cell)
    clean = lambda t: [w for w in words_of(t) if w[0] not in TITLES]
    out = [(0, 0, clean(text))]
    pieces = [clean(p) for p in re.split(r"\s*[/,+&;|–—-]\s*|\s+(?:ve|and)\s+", text, flags=re.I) if p.strip()]
    if len(pieces) > 1:
        for i in range(len(pieces)):
            words: list[tuple[str, bool]] = []
            for j in range(i, len(pieces)):
                words = words + pieces[j]
                if len(words) > 2 * longest:
                    break
                if j - i < len(pieces) - 1:
                    out.append((i, j + 1, words))
    return [(i, j, w) for i, j, w in out if w]


def settle(runs: dict[tuple[int, int], list[tuple[float, int, bool]]], pieces: int) -> list[int]:
    """Owners a cell names: (from, to) -> its two nearest people (cost, owner, short); one person for the whole, or one for each run of the best cut."""
    best: dict[tuple[int, int], tuple[int | None, float]] = {}
    for at, near in runs.items():
        c, owner, short = near[0]
        lead = near[1][0] - c if len(near) > 1 else float("inf")
        best[at] = (owner if lead >= (GAP_SHORT if short else GAP) else None, c)
    whole = best.get((0, 0))
    if whole and whole[1] <= 3 * EDIT:
        return [whole[0]] if whole[0] is not None else []
    # the best way to cut the first j pieces into runs: most people, then least cost; a run that means nobody costs NOBODY
    ways: list[tuple[int, float, list[int]]] = [(0, 0.0, [])]
    ends: dict[int, list[int]] = defaultdict(list)
    for i, j in best:
        if j:
            ends[j].append(i)
    for j in range(1, pieces + 1):
        n, c, who = ways[j - 1]
        options = [(n, c - NOBODY, who)]
        for i in sorted(ends[j]):
            owner, cost_ = best[i, j]
            n, c, who = ways[i]
            options.append((n + (owner is not None), c - cost_, who + ([owner] if owner is not None else [])))
        # pieces side by side that mean nobody count as one
        for i in range(j - 1):
            n, c, who = ways[i]
            if n == ways[j - 1][0] and who == ways[j - 1][2]:
                options.append((n, c - NOBODY, who))
                break
        ways.append(max(options, key=lambda o: o[:2]))
    n, _, who = ways[pieces]
    if n >= 2 or n and not (whole and whole[0] is not None):
        return sorted(set(who))
    return [whole[0]] if whole and whole[0] is not None else []


def same_accounts(accounts: DataFrame) -> DataFrame:
    """(user_id, owner): the smallest account of each person among accounts (user_id, first_name, last_name).

    Two accounts are one person when their given names agree and their last names are written differently:
    few edits apart, cut apart or joined, or one with a second last name added. Pairs are found by equal
    left-out forms of the joined last name and by equal first parts, so accounts are never compared all
    with all; labels then spread to the least account until nothing changes.
    """

    @F.pandas_udf("struct<given:string,joined:string,parts:array<string>,keys:array<string>>")
    def shape(first: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = []
        f1, l1 = unify_strings([x or "" for x in first]), unify_strings([x or "" for x in last])
        for f, x in zip(f1, l1):
            parts = [w for w, _ in words_of(x)]
            joined = "".join(parts)
            heads = {"".join(parts[:k]) for k in range(1, len(parts) + 1)}
            keys = {d for h in heads if len(h) >= 4 for d in deletes(h, 1 if len(h) < 8 else 2)}
            rows.append((" ".join(w for w, _ in words_of(f)), joined, parts, sorted(keys)))
        return pd.DataFrame(rows, columns=["given", "joined", "parts", "keys"])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = list(x), list(y)
            p, q = "".join(x), "".join(y)
            most = 1 if min(len(p), len(q)) < 8 else 2
            heads = lambda z: {"".join(z[:k]) for k in range(1, len(z) + 1)}
            return distance(p, q, most) <= most or any(distance(h, q, 1) <= 1 for h in heads(x)) or any(distance(p, h, 1) <= 1 for h in heads(y))

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    named = accounts.where("first_name IS NOT NULL AND last_name IS NOT NULL").select("user_id", "first_name", "last_name").distinct()
    shaped = named.select("user_id", shape("first_name", "last_name").alias("s")).where("s.given <> '' AND s.joined <> ''")
    keyed = shaped.select("user_id", "s.given", "s.parts", F.explode("s.keys").alias("key"))
    other = keyed.select(F.col("user_id").alias("b"), "given", F.col("parts").alias("parts_b"), "key")
    pairs = keyed.withColumnRenamed("user_id", "a").join(other, ["given", "key"]).where("a < b").dropDuplicates(["a", "b"])
    links = durable(pairs.where(alike("parts", "parts_b")).select("a", "b"))
    return components(links, "a", "b").select(F.col("node").alias("user_id"), F.col("least").alias("owner"))


def anchors(word: str, joined: bool = False) -> list[str]:
    """Places of a word in the delete index: its head, or its head and tail, marked with the letters that may be left out.

    Words that are near share an anchor's key: where the shorter has fewer than 12 letters both stand under their heads
    of 8 letters, else under head and tail of 4 letters each (edits that touch the head and those that touch the tail
    are different ones then). Given name and surname in one word allow two edits at any length.
    """
    n = len(word)
    if joined:
        return ([f"j2 {word[:8]} "] if n <= 12 else []) + ([f"k2 {word[:4]} {word[-4:]}"] if n >= 10 else [])
    return ([f"s{min(2, edits_allowed(n))} {word[:8]} "] if n <= 13 else []) + ([f"l3 {word[:4]} {word[-4:]}"] if n >= 12 else [])


def anchor_keys(anchor: str) -> set[int]:
    """64-bit names of an anchor's forms with letters left out, so many in head and tail together."""
    kind, head, tail = anchor.split(" ")
    most = int(kind[1])
    out = set()
    for k in range(most + 1):
        tails = {tail} if not tail else deletes(tail, most - k)
        heads = {h for h in deletes(head, k) if len(h) == max(1, len(head) - k)} if k else {head}
        out |= {xxhash.xxh64_intdigest(f"{kind[0]}{h} {t}") - (1 << 63) for h in heads for t in tails}
    return out


def near_pairs(looks: DataFrame, names: DataFrame, joined: bool) -> DataFrame:
    """(look, name): all words look and name within the edits allowed, met on forms with letters left out.

    Words shrink to distinct anchors before letters are left out, so a key is met once for all words of one head and tail.
    """

    @F.pandas_udf("array<string>")
    def anchored(w: pd.Series) -> pd.Series:
        return w.map(lambda x: anchors(x, joined))

    @F.pandas_udf("array<long>")
    def keyed(c: pd.Series) -> pd.Series:
        return c.map(lambda x: sorted(anchor_keys(x)))

    @F.pandas_udf("boolean")
    def near(c: pd.Series, d: pd.Series) -> pd.Series:
        most = (lambda x, y: JOINED_EDITS) if joined else (lambda x, y: edits_allowed(min(len(x), len(y))))
        return pd.Series([distance(x, y, m) <= m for x, y in zip(c, d) for m in (most(x, y),)], dtype=bool)

    a, b = (df.select(F.col(c).alias(c), F.explode(anchored(F.col(c))).alias(f"{c}_at")) for df, c in ((looks, "look"), (names, "name")))
    a, b = durable(a), durable(b)
    keys = [df.select(f"{c}_at").distinct().select(f"{c}_at", F.explode(keyed(F.col(f"{c}_at"))).alias("key")) for df, c in ((a, "look"), (b, "name"))]
    met = keys[0].join(keys[1], "key").select("look_at", "name_at").distinct()
    pairs = a.join(met, "look_at").join(b, "name_at").select("look", "name").distinct()
    return pairs.where(near("look", "name"))


def name_forms(accounts: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(given, last, owner, other): each written form of a name with its least and greatest owner; (spelled): own spellings."""
    listed = accounts.where("first_name IS NOT NULL AND last_name IS NOT NULL").select("user_id", "first_name", "last_name").distinct()
    listed = listed.join(owners, "user_id", "left").withColumn("owner", F.coalesce("owner", "user_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = unify_strings([f"{f} {x}" for f, x in zip(pdf["first_name"], pdf["last_name"])])
            parts = [[" ".join(w for w, _ in words_of(x)) for x in pdf[c]] for c in ("first_name", "last_name")]
            yield pd.DataFrame({"owner": pdf["owner"], "spelled": [spelling(t) if u == o else None for t, u, o in zip(both, pdf["user_id"], pdf["owner"])], "given": parts[0], "last": parts[1]})

    parsed = durable(listed.mapInPandas(run, "owner long, spelled string, given string, last string"))
    forms = parsed.where("given <> '' AND last <> ''").groupBy("given", "last").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return durable(forms), parsed.where("spelled IS NOT NULL").select("spelled").distinct()


def resolve_cells(cells: DataFrame, accounts: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(field, row_id, pos, user_id): whom each cell (field, row_id, pos, cell) means, where its spelling varies.

    Cells shrink to distinct texts, their words to distinct words, accounts to distinct forms of names, before anything is
    matched. Words meet surnames (and given names that begin with another letter, and names written as one word) in a
    symmetric-delete index that is joined, not held in memory; a cell meets the forms of a surname only where one of
    its words can be a given name by its first letter. The pairs are scored by optimal assignment as they stream
    past, keeping two people a run of words. Null and blank cells, cells that mean nobody, and cells
    that fit several people give no row; a cell naming several people gives one row each; accounts without a name
    take no part. Who a word is known as depends on all accounts, never on how they are spread.
    """
    owners = same_accounts(accounts) if owners is None else owners
    forms, own = name_forms(accounts, owners)
    longest = forms.agg(F.max(F.size(F.split(F.concat_ws(" ", "given", "last"), " ")))).first()[0] or 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, (cell, text) in enumerate(zip(pdf["cell"], unify_strings(pdf["cell"].tolist()))):
                runs = runs_of(text, longest)
                rows.append((cell, pdf["_n"].iat[n], spelling(text), max((j for _, j, _ in runs), default=0), [{"i": i, "j": j, "words": " ".join(w + "." * d for w, d in ws)} for i, j, ws in runs]))
            yield pd.DataFrame(rows, columns=["cell", "_n", "spelled", "pieces", "runs"])

    distinct = cells.where("cell IS NOT NULL AND trim(cell) <> ''").groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    schema = "cell string, _n long, spelled string, pieces int, runs array<struct<i:int,j:int,words:string>>"
    parsed = distinct.mapInPandas(parse, schema).join(own, "spelled", "left_anti").withColumn("cid", F.monotonically_increasing_id())
    parsed = durable(parsed.drop("spelled"))
    runs = parsed.select("cid", "pieces", F.explode("runs").alias("r")).select("cid", "pieces", "r.*")
    # what is looked up of a run: each word, and each two neighbours as one
    bare_words = F.transform(F.split("words", " "), lambda w: F.rtrim(w, F.lit(".")))
    pairs = F.expr("transform(sequence(1, greatest(size(_w) - 1, 1)), k -> concat(_w[k - 1], coalesce(get(_w, k), '')))")
    looked = runs.withColumn("_w", bare_words).select("cid", "i", "j", F.explode(F.array_union(
        F.transform("_w", lambda w: F.struct(w.alias("look"), F.lit(True).alias("plain"))), F.transform(pairs, lambda w: F.struct(w.alias("look"), F.lit(False).alias("plain"))),
    )).alias("l")).select("cid", "i", "j", "l.look", "l.plain").where("length(look) >= 2").distinct()
    looked = durable(looked)
    dotted = runs.select(F.explode(F.split("words", " ")).alias("w")).where("endswith(w, '.')").select(F.rtrim("w", F.lit(".")).alias("look"), F.lit(True).alias("dotted")).distinct()
    looks = looked.groupBy("look").agg(F.count(F.lit(1)).alias("_m"), F.max("plain").alias("plain"))

    split = lambda c: F.split(c, " ")
    lasts = forms.select(F.explode(F.array_union(split("last"), F.array(F.replace("last", F.lit(" "), F.lit(""))))).alias("name")).distinct()
    givens = forms.select(F.explode(split("given")).alias("name")).distinct()
    named = lasts.withColumn("last", F.lit(True)).join(givens.withColumn("given", F.lit(True)), "name", "full")
    named = durable(named.select("name", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("given", F.lit(False)).alias("given")))
    known = named.where("given OR last AND length(name) >= 5").select(F.col("name").alias("look"), F.lit(True).alias("known"))
    looks = durable(looks.join(known, "look", "left").join(dotted, "look", "left").select("look", "_m", "plain", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("dotted", F.lit(False)).alias("dotted")))

    same = looks.join(named, F.col("look") == F.col("name"))
    near = near_pairs(looks.where("length(look) >= 3 AND (NOT known OR dotted)").select("look"), named.select("name"), False).join(named, "name")
    both = same.select("look", "name", "last", "given").unionByName(near.select("look", "name", "last", "given")).distinct()

    @F.pandas_udf("array<string>")
    def one_word(given: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([sorted(joined_names(g.split(), x.split())) for g, x in zip(given, last)])

    whole = durable(forms.select("*", F.explode(one_word("given", "last")).alias("name")))
    in_one = near_pairs(looks.where(f"plain AND length(look) >= {JOINED_LETTERS}").select("look"), whole.select("name").distinct(), True)
    # what each look may stand for, one row a look: surnames, other first letters of given names, names in one word
    told = both.select("look", F.when(F.col("last"), F.col("name")).alias("last"), F.when(F.col("given") & (F.substring("name", 1, 1) != F.substring("look", 1, 1)), F.substring("name", 1, 1)).alias("letter"), F.lit(None).cast("string").alias("one"))
    told = told.unionByName(in_one.select("look", F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("letter"), F.col("name").alias("one")))
    told = told.groupBy("look").agg(F.collect_set("last").alias("lasts"), F.collect_set("letter").alias("letters"), F.collect_set("one").alias("ones"))
    told = durable(looks.select("look", "_m", "known").join(told, "look"))
    of_run = attach(looked, told, ["look"], "_m").groupBy("cid", "i", "j").agg(
        F.array_distinct(F.flatten(F.collect_list("lasts"))).alias("lasts"), F.array_distinct(F.flatten(F.collect_list("letters"))).alias("letters"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("plain"), F.col("ones"))))).alias("ones"), F.concat_ws(" ", F.collect_set(F.when(F.col("known"), F.col("look")))).alias("known"),
    )
    asked = durable(runs.join(of_run, ["cid", "i", "j"]))
    letter = F.array_distinct(F.concat(F.transform(F.split("words", " "), lambda w: F.substring(w, 1, 1)), F.col("letters")))
    keep = ["cid", "pieces", "i", "j", "words", "known"]
    by_last = forms.select("*", F.explode(F.array_union(split("last"), F.array(F.replace("last", F.lit(" "), F.lit(""))))).alias("_last"))
    by_last = by_last.select("*", F.explode(F.array_distinct(F.transform(split("given"), lambda g: F.substring(g, 1, 1)))).alias("_letter"))
    found = asked.select(*keep, letter.alias("_ls"), F.explode("lasts").alias("_last")).select(*keep, "_last", F.explode("_ls").alias("_letter")).join(broadcast_checked(by_last), ["_last", "_letter"]).select(*keep, "given", "last", "owner", "other")
    in_word = asked.select(*keep, F.explode("ones").alias("name")).join(broadcast_checked(whole), "name").select(*keep, "given", "last", "owner", "other")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells_: dict[int, tuple[int, dict]] = {}
        for pdf in batches:
            for cid, pieces, i, j, words, known_, given, last, owner, other in zip(*(pdf[c].tolist() for c in (*keep, "given", "last", "owner", "other"))):
                ws = [(w.rstrip("."), w.endswith(".")) for w in words.split(" ")]
                c = cost(ws, tuple(given.split(" ")), tuple(last.split(" ")), frozenset(known_.split(" ")))
                if c <= MOST:
                    near_ = cells_.setdefault(cid, (pieces, {}))[1].setdefault((i, j), [])
                    short = any(len(w) <= 2 for w, _ in ws)
                    for o in {owner, other}:
                        same_ = [x for x in near_ if x[1] == o]
                        if not same_ or c < same_[0][0]:
                            near_[:] = sorted([x for x in near_ if x[1] != o] + [(c, o, short)])[:2]
        out = [(cid, users) for cid, (pieces, near_) in cells_.items() if (users := settle(near_, pieces))]
        yield pd.DataFrame({"cid": [c for c, _ in out], "users": [u for _, u in out]})

    scored = found.unionByName(in_word).repartition("cid").dropDuplicates(["cid", "i", "j", "given", "last"]).mapInPandas(score, "cid long, users array<long>")
    meant = durable(parsed.select("cid", "cell", "_n").join(scored, "cid").drop("cid"))
    back = attach(cells.where("cell IS NOT NULL"), meant, ["cell"], "_n")
    return back.select("field", "row_id", "pos", F.explode("users").alias("user_id"))
