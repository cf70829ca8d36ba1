"""Copies hidden by formatting: rolling hashes over skipped and folded characters, verified by two pointers."""

from __future__ import annotations

import unicodedata
from functools import cmp_to_key, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixturelake.llm.links import components
from fixturelake.operators.skew import attach
from fixturelake.session import durable

SKIP, BREAK = 0, 1
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Marks inside a word ("S.K.", "D'or") join it; any other mark or blank ends a word.
JOINING = ".'’`´"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point; SKIP for what is dropped inside a word, BREAK for what ends one."""
    t = np.arange(0x110000, dtype=np.uint32)
    for o in range(0x20000):
        c = chr(o)
        cat = unicodedata.category(c)
        if cat in ("Cf", "Mn") or c in JOINING:
            t[o] = SKIP
        elif cat[0] in "ZPSC" and cat not in ("Co", "Cn", "Cs"):
            t[o] = BREAK
        else:
            low = c.lower()
            t[o] = ord("i") if c in "İıIi" else ord(low[0])
    return t


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def rolling_hashes(column: pa.Array, letters_apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text: its folded characters in order, its folded words in any order, its characters in any order.

    Texts that agree in the first or the second agree in the third, which serves as their block. 0 for null.

    The characters of the whole batch stream through the fold table; positions and per-word sums come from
    running counts, so no folded string is ever built. ``letters_apart``: the digits of a text count as one
    word, as a clock time is written with and without marks between them.
    """
    n = len(column)
    texts = column.fill_null("")
    lengths = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(n), lengths)
    f = fold_table()[codes]
    real = f > BREAK
    seq, words, chars = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if real.any():
        # a word starts where a real character follows a break, the start of a row, or a change of kind
        r, c = row[real], f[real]
        breaks = np.cumsum(f == BREAK)[real]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (breaks[1:] != breaks[:-1])
        if letters_apart:
            digit = (c >= 48) & (c <= 57)
            order = np.lexsort((np.arange(len(r)), ~digit, r))  # the digits of a row first, each kind in order
            wr, wc, wd = r[order], c[order], digit[order]
            wb = np.cumsum(first | np.r_[True, digit[1:] != digit[:-1]])[order]  # letters on two sides of digits are two words
            wfirst = np.ones(len(r), bool)
            wfirst[1:] = (wr[1:] != wr[:-1]) | (wd[1:] != wd[:-1]) | (~wd[1:] & (wb[1:] != wb[:-1]))
        else:
            wr, wc, wfirst = r, c, first
        with np.errstate(over="ignore"):
            rstart = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            pos = np.arange(len(r)) - np.repeat(rstart, np.diff(np.r_[rstart, len(r)]))
            seq[r[rstart]] = mix(np.add.reduceat(mix(c) * _powers(int(pos.max()) + 1)[pos], rstart))
            chars[r[rstart]] = mix(np.add.reduceat(mix(c), rstart))
            wstart = np.flatnonzero(wfirst)
            wpos = np.arange(len(wr)) - np.repeat(wstart, np.diff(np.r_[wstart, len(wr)]))
            each = mix(np.add.reduceat(mix(wc) * _powers(int(wpos.max()) + 1)[wpos], wstart))
            rows = wr[wstart]
            at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            words[rows[at]] = mix(np.add.reduceat(each, at) + np.uint64(1))
    null = column.is_null().to_numpy(zero_copy_only=False)
    seq[null] = words[null] = chars[null] = 0
    chars[~null & (chars == 0)] = 1
    seq[~null & (seq == 0)] = words[~null & (words == 0)] = 1
    return seq.view(np.int64), words.view(np.int64), chars.view(np.int64)


def same_two_pointers(a: str | None, b: str | None) -> bool:
    """Whether two texts agree but for what the fold table skips: one pointer each, skipping as it goes."""
    if a is None or b is None:
        return a is b
    t, i, j = fold_table(), 0, 0
    while True:
        while i < len(a) and t[ord(a[i])] <= BREAK:
            i += 1
        while j < len(b) and t[ord(b[j])] <= BREAK:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if t[ord(a[i])] != t[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def word_places(s: str, letters_apart: bool = False) -> list[list[int]]:
    """The places of each word's characters in the text; no folded text is built."""
    t, words, digits, now = fold_table(), [], [], None
    for i, c in enumerate(s):
        f = t[ord(c)]
        if f == SKIP:
            continue
        if f == BREAK:
            now = None
        elif letters_apart and 48 <= f <= 57:
            digits.append(i)
            now = None
        else:
            if now is None:
                now = []
                words.append(now)
            now.append(i)
    return [*words, digits] if digits else words


def same_words(a: str | None, b: str | None, letters_apart: bool = False) -> bool:
    """Whether two texts hold the same words in any order: words are put in order, then compared, by a pointer into each text."""
    if a is None or b is None:
        return a is b
    t = fold_table()

    def compare(x: tuple[str, list[int]], y: tuple[str, list[int]]) -> int:
        for i, j in zip(x[1], y[1]):
            if (p := int(t[ord(x[0][i])])) != (q := int(t[ord(y[0][j])])):
                return p - q
        return len(x[1]) - len(y[1])

    one, two = (sorted(((s, w) for w in word_places(s, letters_apart)), key=cmp_to_key(compare)) for s in (a, b))
    return len(one) == len(two) and not any(compare(x, y) for x, y in zip(one, two))


def flags(df: DataFrame, columns: list[str]) -> list[Column]:
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
        if isinstance(df.schema[c].dataType, T.ArrayType):
            parts += [F.size(c), F.transform(c, lambda x: x.isNull())]
    return parts


def agree(texts: list[str], times: tuple[str, ...]):
    """A vectorised test of texts against a leader's: per text, its words in any order (1), its characters in order (0), or both (2)."""

    def same(way: int, a: str | None, b: str | None, apart: bool) -> bool:
        return a == b or (way == 1 or same_two_pointers(a, b)) and (way == 0 or same_words(a, b, apart))

    @F.pandas_udf("boolean")
    def check(ways: pd.Series, *c: pd.Series) -> pd.Series:
        half = len(c) // 2
        columns = [s.where(s.notna(), None).tolist() for s in c]
        apart = [t in times for t in texts]
        return pd.Series([all(same(int(w[k]), r[k], r[half + k], apart[k]) for k in range(half)) for w, r in zip(ways, zip(*columns))], dtype=bool)

    return check


def group_copies(df: DataFrame, row: str, texts: list[str], ignore: tuple[str, ...] = (), times: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """(row, keep_id, n_copies): each row with the smallest ``row`` of its record and the record's number of rows.

    Two rows are linked when all columns but ``row`` and ``ignore`` are equal (null equal to null) and each of
    ``texts`` holds the same characters in order, or the same words in any order, blanks, letter case and
    punctuation aside; a record is everything linked, over any number of steps. Rows are hashed once and shrink
    to shapes (equal in all hashes) in one pre-aggregated shuffle. Rows of a shape written in several ways are
    verified against its first row by two pointers; those that only share its hashes are named apart and judged
    again. Shapes of equal characters meet under each choice of hashes, are verified likewise, and links spread
    until nothing changes, so no order or chain of rows matters. Shapes, not rows, are paired, each with the first of its
    class, so a record holding a third of all rows is no burden. Empty tables give none; empty and null texts differ.
    ``bits`` of each hash are kept (tests force collisions with few).
    """
    n = len(texts)
    others = [c for c in df.columns if c not in {row, *texts, *ignore}]
    base = df.select(
        F.col(row).alias("_row"),
        F.xxhash64(F.lit(1), *flags(df, others)).alias("_o1"),
        F.xxhash64(F.lit(7), *flags(df, others)).alias("_o2"),
        F.xxhash64(F.lit(3), *flags(df, texts)).alias("_x"),
        *(F.col(c).alias(f"_t{i}") for i, c in enumerate(texts)),
    )
    hashes = [f"_{k}{i}" for i in range(n) for k in "swc"]
    schema = T.StructType([*base.schema.fields, *(T.StructField(h, T.LongType(), False) for h in hashes)])

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            for i, c in enumerate(texts):
                made = rolling_hashes(b.column(4 + i).cast(pa.string()), c in times)
                cols += [pa.array(h >> (64 - bits) if bits < 64 else h) for h in made]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    order = [f"_{k}{i}" for i in range(n) for k in "sw"]
    shape, own, led = ["_a", "_b"], [f"_t{i}" for i in range(n)], [f"_l.t{i}" for i in range(n)]
    name = lambda *c: [F.xxhash64(F.lit(k), "_o1", "_o2", *c) for k in (11, 12)]
    a, b = name(*order)
    block = F.xxhash64("_o1", "_o2", *(f"_c{i}" for i in range(n)))
    rows = durable(base.mapInArrow(run, schema).select("_row", a.alias("_a"), b.alias("_b"), "_x", block.alias("_block"), "_o1", "_o2", *order, *own))
    texts_of = F.struct(*(F.col(f"_t{i}").alias(f"t{i}") for i in range(n)))
    check = agree(texts, times)
    both = F.array(*[F.lit(2)] * n)

    again = 0
    while True:
        numbers = ("_block", "_o1", "_o2", *order)
        shapes = durable(rows.groupBy(*shape).agg(
            F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
            *(F.first(c).alias(c) for c in numbers), F.min_by(texts_of, "_row").alias("_l"),
        ))
        written = shapes.where("_lo <> _hi").select(*shape, "_n", "_l")
        wrong = durable(attach(rows.select("_row", *shape, *own), written, shape, "_n").where(~check(both, *own, *led)).select("_row"))
        if not wrong.limit(1).count():
            break
        again += 1
        renamed = rows.join(wrong.withColumn("_wrong", F.lit(True)), "_row", "left")
        rows = durable(renamed.withColumn("_a", F.when(F.col("_wrong"), F.xxhash64("_a", F.lit(again))).otherwise(F.col("_a"))).drop("_wrong"))

    # shapes of one block meet under every choice of one hash for each text
    blocks = shapes.groupBy("_block").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_block")
    several = shapes.join(blocks, "_block", "left_semi")
    choices = []
    for choice in range(2**n):
        k1, k2 = name(*(F.col(f"_{'sw'[choice >> i & 1]}{i}") for i in range(n)))
        choices.append(F.struct(F.array(*(F.lit(choice >> i & 1) for i in range(n))).alias("ways"), F.xxhash64(F.lit(choice), k1).alias("k1"), k2.alias("k2")))
    keyed = durable(several.select("_least", "_l", F.explode(F.array(*choices)).alias("_k")).select("_least", "_l", "_k.ways", "_k.k1", "_k.k2"))
    edges = None
    while True:
        first = keyed.groupBy("k1", "k2").agg(F.min("_least").alias("_first"), F.count(F.lit(1)).alias("_m"), F.min_by("_l", "_least").alias("_f")).where("_m > 1")
        met = attach(keyed, first, ["k1", "k2"], "_m").where("_least <> _first")
        judged = durable(met.select("_least", "_first", "k1", "k2", check("ways", *led, *(f"_f.t{i}" for i in range(n))).alias("_true")))
        found = judged.where("_true").select("_least", "_first")
        edges = found if edges is None else edges.unionByName(found)
        apart = judged.where("NOT _true").select("_least", "k1", "k2")
        if not apart.limit(1).count():
            break
        keyed = durable(keyed.join(apart, ["_least", "k1", "k2"], "left_semi"))

    least = components(edges, "_least", "_first").withColumnRenamed("node", "_least")
    linked = least.join(shapes.select("_least", "_n"), "_least")
    total = linked.groupBy("least").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_m"))
    kept = attach(linked.select("_least", "least"), total, ["least"], "_m")
    named = shapes.select(*shape, "_n", "_least").join(kept, "_least", "left")
    owned = named.select(*shape, "_n", F.coalesce("least", "_least").alias("keep_id"), F.coalesce("_all", "_n").alias("n_copies"))
    return attach(rows.select("_row", *shape), owned, shape, "_n").select(F.col("_row").alias(row), "keep_id", "n_copies")
