"""Text rules as Column expressions: trimming, Turkish case, folding, tokens, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that count as white space besides the ASCII ones, as a regular-expression class.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# What separates the words of a name cell.
WORD_BREAKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF},.;\-/()]+"
#: Least similarity of two names, the one for names under SHORT_NAME letters, and the least lead over the next best.
SIMILAR, SIMILAR_SHORT, SHORT_NAME, LEAD = 0.90, 0.95, 8, 0.05


def trim(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def key_part(c: Column) -> Column:
    """A part of a content key: collapsed, plain lower case, null as empty."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def lower_tr(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def upper_tr(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def normalize_tr(c: Column) -> Column:
    """Turkish lower case, combining dots dropped, blanks collapsed; null as empty."""
    return collapse(F.regexp_replace(lower_tr(F.coalesce(c, F.lit(""))), "i̇", "i"))


def fold_tr(c: Column) -> Column:
    """ASCII letters and single blanks only: ş as s, ı as i; everything else dropped."""
    plain = F.translate(F.coalesce(c, F.lit("")), "İIıĞğÜüŞşÖöÇçÂâ", "iiigguussooccaa")
    return collapse(F.regexp_replace(F.lower(F.regexp_replace(plain, "i̇", "i")), rf"[^a-z \t\n\r\x{{00A0}}]", ""))


def squash(c: Column) -> Column:
    """The fold without blanks: words joined, cut apart or spaced differently agree."""
    return F.regexp_replace(fold_tr(c), r"\s+", "")


def words(c: Column) -> Column:
    """Words of a name cell: pieces between blanks and separators that hold a letter."""
    return F.filter(F.split(normalize_tr(c), WORD_BREAKS), lambda w: w.rlike(r"\p{L}"))


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two squashed names; both empty 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similar_enough(squashed: Column, sim: Column) -> Column:
    """The threshold that rises for short names."""
    return sim >= F.when(F.length(squashed) < SHORT_NAME, SIMILAR_SHORT).otherwise(SIMILAR)


def is_typo(a: Column, b: Column, least: int) -> Column:
    """One edit apart, both at least so long: surnames five letters, given names three."""
    long_enough = (F.length(a) >= least) & (F.length(b) >= least)
    return long_enough & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= 1)


def is_placeholder(name: Column) -> Column:
    """A match name whose teams are to be determined or come out of a preliminary round."""
    low = F.lower(F.translate(F.coalesce(name, F.lit("")), "İ", "i"))
    return low.contains("belirlen") | low.contains("elemelerden gelecek") | low.rlike(r"^\W*tbd\W") | ~has_letter(F.coalesce(name, F.lit("")))


def multiset_minus(a: Column, b: Column) -> Column:
    """Entries of a that b lacks, repeats kept (array_except would drop them)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def drive_id(c: Column) -> Column:
    """The id in a link or the text itself: /folders/ID, /d/ID or ?id=ID."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"/folders/([\w-]+)", r"/d/([\w-]+)", r"[?&]id=([\w-]+)")))
    return F.coalesce(found, trim(F.regexp_replace(c, r"[?#].*$", "")))


def resource_key(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)[?&]resourcekey=([\w-]+)", 1), F.lit(""))
