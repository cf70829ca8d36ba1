"""One form for text that looks the same: embedded SQL over Arrow partitions.

Every batch is registered with an in-process DuckDB; its SQL resolves compatibility forms, drops invisible
characters, composes accents (nfc_normalize) and maps look-alike letters, word by word, so that words truly
written in another alphabet stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that show a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "ı", "ϳ": "j", "α": "a", "ρ": "p", "υ": "u", "κ": "k",
    "χ": "x", "Ϲ": "C", "ϲ": "c", "Ϳ": "J",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "Տ": "S",
}
#: Latin letters of other uses that show a common one.
LATIN_ALIKE = {"ɑ": "a", "ɡ": "g", "ɩ": "ı"}
#: Letters with the wrong mark for the mark this alphabet uses, and dashes that are hyphens.
WRONG_MARKS = {"Ǧ": "Ğ", "ǧ": "ğ", "Ș": "Ş", "ș": "ş", "Ț": "Ţ", "ț": "ţ", "Ĭ": "İ", "ŭ": "ü", "‐": "-", "‑": "-", "−": "-", "﹣": "-", "⁃": "-"}
MARKS = "̧̨̦̀́̂̃̄̆̇̈̊̋̌"
INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2065}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
#: Characters that show what they are, so that a value of these alone needs no work.
PLAIN = r"^[\x{0009}\x{000A}\x{000D}\x{0020}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{00FF}\x{011E}\x{011F}\x{0130}\x{0131}\x{015E}\x{015F}\x{2013}\x{2014}\x{2018}-\x{201F}\x{2026}]*$"


@lru_cache(maxsize=1)
def tables() -> tuple[tuple[str, str], tuple[str, str]]:
    """(compatibility forms, plain forms) and (look-alikes, Latin letters), by rule from the character database."""
    compat: dict[str, str] = {}
    for c in map(chr, range(0xA0, 0x1FFFF)):
        cat, how = unicodedata.category(c), unicodedata.decomposition(c)
        if cat == "Zs":
            compat[c] = " "
        elif how.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")) and (cat[0] in "LNP" or how[1:5] in ("wide", "narr")):
            if len(to := unicodedata.normalize("NFKC", c)) == 1:
                compat[c] = to
    compat |= WRONG_MARKS | LATIN_ALIKE
    alike = dict(LOOKALIKES)
    for c, latin in LOOKALIKES.items():
        for m in MARKS:
            one, to = unicodedata.normalize("NFC", c + m), unicodedata.normalize("NFC", latin + m)
            if len(one) == 1:
                alike[one] = to if len(to) == 1 else latin
    quoted = lambda d: ("".join(d).replace("'", "''"), "".join(d.values()).replace("'", "''"))
    return quoted(compat), quoted(alike)


@lru_cache(maxsize=1)
def written_as_one() -> list[tuple[str, str]]:
    """Characters that show several plain letters side by side (ligatures, Roman numerals), by rule from the character database."""
    both = ((c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0xA0, 0x10000)) if unicodedata.decomposition(c).startswith("<compat>"))
    return [(c, to) for c, to in both if 2 <= len(to) <= 4 and to.isascii() and to.isalpha()]


@lru_cache(maxsize=8)
def unify_sql(table: str = "batch", text: str = "s", order: str = "i") -> str:
    """SQL giving each row's text in one form, in the order of ``order``."""
    (cf, ct), (af, at) = tables()
    ligatures = text
    for one, many in written_as_one():
        ligatures = f"replace({ligatures}, '{one}', '{many}')"
    other = "\\p{Greek}\\p{Cyrillic}\\p{Cherokee}\\p{Armenian}"
    wrong = "".join(k for k in WRONG_MARKS if k.isalpha()), "".join(v for k, v in WRONG_MARKS.items() if k.isalpha())
    return f"""
WITH visible AS (
    SELECT {order} AS i, {text} AS raw,
        nfc_normalize(translate(regexp_replace({ligatures}, '{INVISIBLE}', '', 'g'), '{cf}', '{ct}')) AS t
    FROM {table} WHERE {text} IS NOT NULL AND NOT regexp_matches({text}, '{PLAIN}')
), parts AS (
    SELECT i, raw, t, regexp_extract_all(t, '[^\\-–—:/_|]+|[\\-–—:/_|]+') AS segments FROM visible
), worded AS (
    SELECT i, raw, t, list_transform(segments, lambda seg: struct_pack(
        words := regexp_extract_all(seg, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
        own := list_filter(regexp_extract_all(seg, '[\\p{{L}}\\p{{M}}]+'), lambda w:
            NOT regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(translate(w, '{af}', '{at}'), '[{other}]'))
    )) AS segs FROM parts
), mapped AS (
    SELECT i, raw, array_to_string(flatten(list_transform(segs, lambda g: list_transform(g.words, lambda w:
        CASE WHEN NOT regexp_matches(w, '[{other}]') THEN w
             WHEN list_contains(g.own, w) THEN w
             WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, '{af}', '{at}')
             WHEN regexp_matches(w, '\\p{{Cyrillic}}') AND len(list_filter(g.own, lambda o: regexp_matches(o, '\\p{{Cyrillic}}'))) > 0 THEN w
             WHEN regexp_matches(w, '\\p{{Greek}}') AND len(list_filter(g.own, lambda o: regexp_matches(o, '\\p{{Greek}}'))) > 0 THEN w
             WHEN regexp_matches(w, '\\p{{Cherokee}}') AND len(list_filter(g.own, lambda o: regexp_matches(o, '\\p{{Cherokee}}'))) > 0 THEN w
             WHEN regexp_matches(w, '\\p{{Armenian}}') AND len(list_filter(g.own, lambda o: regexp_matches(o, '\\p{{Armenian}}'))) > 0 THEN w
             ELSE translate(w, '{af}', '{at}') END))), '') AS t
    FROM worded
)
SELECT b.{order}, CASE WHEN m.i IS NULL THEN b.{text}
    ELSE translate(nfc_normalize(regexp_replace(m.t, '[iı]\\x{{0307}}', 'i', 'g')), '{wrong[0]}', '{wrong[1]}') END AS u
FROM {table} b LEFT JOIN mapped m ON b.{order} = m.i ORDER BY b.{order}
"""


_CON = None


def unify_arrow(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column in one form; null stays null. Runs inside one DuckDB connection a worker, on one thread."""
    global _CON
    import duckdb

    if _CON is None:
        _CON = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    if len(column) == 0:
        return pa.array([], pa.string())
    text = column.cast(pa.large_string())
    batch = pa.table({"i": pa.array(range(len(text)), pa.int64()), "s": text})
    _CON.register("batch", batch)
    got = _CON.sql(unify_sql()).to_arrow_table()["u"]
    _CON.unregister("batch")
    got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    return got.cast(pa.string())


def unify_strings(values: list[str | None]) -> list[str | None]:
    return unify_arrow(pa.array(values, pa.string())).to_pylist()


def unify_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the text of ``column`` in one form.

    Full-width and other compatibility letters become plain ones, blanks of every width one ASCII blank each,
    invisible characters vanish, accents are composed, and look-alike letters become Latin where the word or
    its neighbours show that Latin is meant. Letter case, tabs, line ends, repeated blanks, dashes and quotes
    stay. Null stays null, empty stays empty; texts of any length are processed whole; a column named ``out``
    is replaced.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType(), True)])

    def run(batches):
        for b in batches:
            u = unify_arrow(b.column(b.schema.get_field_index(column)))
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, u], names=[*kept, out])

    return df.mapInArrow(run, schema)


def hidden_forms(df: DataFrame, column: str, row: str, field: str) -> DataFrame:
    """(field, row_id, text): rows whose text holds a character that is not what it shows, with the one form."""
    done = unify_text(df.select(F.col(row).alias("row_id"), F.col(column).alias("raw")), "raw", "text")
    return done.where(F.col("raw") != F.col("text")).select(F.lit(field).alias("field"), "row_id", "text")
