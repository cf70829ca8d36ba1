"""Shapes of written dates and times, their parsers, and zone transition tables."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo, available_timezones

import numpy as np

# The words a written date or time may hold.
MONTHS = {
    "ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6,
    "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "oca": 1, "şub": 2, "nis": 4, "haz": 6, "tem": 7, "ağu": 8, "eyl": 9, "eki": 10, "kas": 11, "ara": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
}
WEEKDAYS = {
    "pazartesi", "salı", "çarşamba", "perşembe", "cuma", "cumartesi", "pazar",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "wed", "thu", "fri", "sat", "sun", "pzt", "sal", "çar", "per", "cum", "cmt", "paz",
}
#: Minutes east of UTC of abbreviations; None is the civil time of the home zone.
ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "trt": None, "tsi": None,
}
HALVES = {"am": 0, "öö": 0, "pm": 12, "ös": 12}
HOME = "Europe/Istanbul"
FIRST, LAST = 1970, 2100


def fold(s: str) -> str:
    """Lower case, dotted and dotless i alike, compatibility forms resolved, blanks collapsed."""
    s = unicodedata.normalize("NFKC", s).replace("İ", "i").replace("I", "i").lower().replace("ı", "i").replace("i̇", "i")
    return re.sub(r"\s+", " ", s).strip()


def _bare(s: str) -> str:
    """Letters without their marks, so that words typed in ASCII are found too."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


_WORDS: dict[str, str] = {}
for _table, _kind in ((ZONES, "Z"), (HALVES, "P"), ({w: 0 for w in WEEKDAYS}, "W"), (MONTHS, "M")):
    for _w in _table:
        _WORDS.setdefault(fold(_w), _kind)
        _WORDS.setdefault(_bare(fold(_w)), _kind)
_WORDS |= {"saat": "S", "saati": "S", "t": "T", "um": "S", "uhr": "U", "at": "S"}
_MONTH = {k: v for w, v in MONTHS.items() for k in (fold(w), _bare(fold(w)))}
_ZONE = {fold(w): v for w, v in ZONES.items()}
_HALF = {k: v for w, v in HALVES.items() for k in (fold(w), _bare(fold(w)))}
_TOKEN = re.compile(r"[a-z]+/[a-z_]+(?:/[a-z_]+)?|\d+|[^\W\d_]+| |.", re.S)


def shape(text: str) -> tuple[str, list[str]]:
    """Mask of character classes, and the tokens behind its letters: 9s for digits, a class letter for a word."""
    tokens = _TOKEN.findall(fold(text))
    mask, kept = [], []
    for i, t in enumerate(tokens):
        if t.isascii() and t.isdigit():
            mask.append("9" * len(t))
            kept.append(t)
        elif "/" in t and len(t) > 1:
            mask.append("R")
            kept.append(t)
        elif t[0].isalpha():
            mask.append(_WORDS.get(t, "x"))
            kept.append(t)
        else:
            mask.append(t)
    return "".join(mask), kept


_CLOCK = r"(?P<{0}h>9{{1,2}}) ?[:.;\-] ?(?P<{0}mi>99)(?:[:.](?P<{0}s>99)(?:[.,](?P<{0}f>9+))?)?"
_TIME = (
    r"(?:S )?(?:(?P<p>P)\.? )?" + _CLOCK.format("") + r"(?: ?(?P<q>P)\.?)?(?: U)?"
    r"(?: ?\(?(?:(?P<z>Z) ?(?:(?P<sg>[+\-])(?P<oh>9{1,2})(?::(?P<om>99))?)?|(?P<r>R)|(?P<sh>[+\-])(?:(?P<pq>9999)|(?P<ph>99)(?::(?P<pm>99))?))\)?)?\.?"
)
_DATES = [
    r"(?P<d>9{1,2})(?P<sep>[./\-])(?P<m>9{1,2})(?P=sep)(?P<y>9999|99)(?P<end>)",
    r"(?P<y>9999)(?P<sep>[./\-])(?P<m>9{1,2})(?P=sep)(?P<d>9{1,2})",
    r"(?:W,? )?(?P<d>9{1,2})\.? (?P<mon>M)\.?,? (?P<y>9999)(?:,? W)?",
    r"(?:W,? )?(?P<mon>M)\.? (?P<d>9{1,2}),? (?P<y>9999)(?:,? W)?",
]
_DATE_TIMES = [re.compile(rf"{d}(?:(?: ?T|,? ){_TIME.replace('?P<d>', '?P<dd>')})?") for d in _DATES]
_TIME_ONLY = re.compile(_TIME)
_NUMBER = re.compile(r"(?P<n>9+)(?:[.,](?P<fr>9+))?")


class Parser:
    """How the tokens of one mask make up a day, minutes of the day and a zone; kind says what they are."""

    def __init__(self, kind: str, slots: dict[str, int] | None = None, signs: dict[str, int] | None = None):
        self.kind, self.slots, self.signs = kind, slots or {}, signs or {}


@lru_cache(maxsize=4096)
def parser_for(mask: str, role: str) -> Parser | None:
    """The parser of a mask, found once: role is 'date' or 'time'. Masks outside the grammar have none."""
    tried = [*_DATE_TIMES] if role == "date" else [_TIME_ONLY]
    for rx in tried:
        if m := rx.fullmatch(mask):
            starts = [x.start() for x in re.finditer(r"9+|[A-Za-z]", mask)]
            slots, signs = {}, {}
            for name, v in m.groupdict().items():
                if v is None:
                    continue
                if name in ("sg", "sh"):
                    signs[name] = 1 if v == "+" else -1
                elif name not in ("sep", "end"):
                    slots[name] = starts.index(m.start(name))
            return Parser("clock" if role == "time" else "day", slots, signs)
    if m := _NUMBER.fullmatch(mask):
        n, fr = len(m["n"]), m["fr"]
        if role == "time":
            if fr and n == 1:
                return Parser("fraction")
            if not fr and n in (3, 4, 6):
                return Parser("hhmm")
        elif not fr and n == 8:
            return Parser("yyyymmdd")
        elif n == 5:
            return Parser("serial")
        elif not fr and n in (10, 13, 16):
            return Parser("epoch")
    return None


def _clock(p: Parser, t: list[str]) -> tuple[float, object] | None:
    """Seconds of the day and the zone: minutes east, a region's name, or None for none given."""
    g = lambda k: t[p.slots[k]] if k in p.slots else None
    if g("h") is None:
        return None
    h, mi, s = int(g("h")), int(g("mi")), float(f"{g('s') or 0}.{g('f') or 0}")
    half = g("p") or g("q")
    if half is not None:
        if g("p") and g("q") or not 1 <= h <= 12:
            return None
        h = h % 12 + _HALF[half]
    if h > 23 or mi > 59 or s >= 60:
        return None
    zone: object = None
    if g("r"):
        zone = g("r")
    elif g("z") is not None:
        east = _ZONE[g("z")]
        zone = HOME.lower() if east is None else east
        if g("oh"):
            if east != 0:
                return None
            zone = p.signs["sg"] * (int(g("oh")) * 60 + int(g("om") or 0))
    elif g("ph") or g("pq"):
        h4 = g("pq") or g("ph") + (g("pm") or "00")
        zone = p.signs["sh"] * (int(h4[:2]) * 60 + int(h4[2:]))
    if isinstance(zone, int) and abs(zone) > 14 * 60:
        return None
    return h * 3600 + mi * 60 + s, zone


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return (datetime(y, m, d) - datetime(1970, 1, 1)).days
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def read_date(text: str) -> tuple | None:
    """(day since 1970, seconds or None, zone or None, exact epoch seconds or None)."""
    mask, t = shape(text)
    if (p := parser_for(mask, "date")) is None:
        return None
    if p.kind == "yyyymmdd":
        d = _day(int(t[0][:4]), int(t[0][4:6]), int(t[0][6:]))
        return None if d is None or not FIRST <= int(t[0][:4]) < LAST else (d, None, None, None)
    if p.kind == "serial":
        day = int(t[0]) - 25569
        seconds = None if len(t) == 1 else round(float(f"0.{t[1]}") * 1440) * 60.0
        if seconds == 86400:
            day, seconds = day + 1, 0.0
        return (day, seconds, None, None) if 0 <= day < 47482 else None
    if p.kind == "epoch":
        return (None, None, None, int(t[0]) / 10 ** (len(t[0]) - 10))
    y = t[p.slots["y"]]
    year = int(y) + 2000 if len(y) == 2 else int(y)
    month = _MONTH[t[p.slots["mon"]]] if "mon" in p.slots else int(t[p.slots["m"]])
    day = _day(year, month, int(t[p.slots["d"]])) if FIRST <= year < LAST else None
    if day is None:
        return None
    if "h" not in p.slots:
        return (day, None, None, None)
    return None if (c := _clock(p, t)) is None else (day, *c, None)


@lru_cache(maxsize=200_000)
def read_time(text: str) -> tuple | None:
    """(seconds of the day, zone or None)."""
    mask, t = shape(text)
    if (p := parser_for(mask, "time")) is None and mask[:1] == "9":
        mask, t = shape(text.strip().rstrip("."))
        p = parser_for(mask, "time")
    # one digit, a point and two digits are a clock time, but for a fraction of the day below one
    if p is not None and p.kind == "clock" and re.fullmatch(r"9\.99", mask) and t[0] == "0":
        p = Parser("fraction")
    if p is None:
        return None
    if p.kind == "fraction":
        return None if t[0] != "0" else (round(float(f"0.{t[1]}") * 1440) * 60.0, None)
    if p.kind == "hhmm":
        n = t[0].zfill(4) if len(t[0]) < 6 else t[0]
        h, m, s = int(n[:2]), int(n[2:4]), int(n[4:] or 0)
        return None if h > 23 or m > 59 or s > 59 else (h * 3600.0 + m * 60 + s, None)
    return _clock(p, t)


@lru_cache(maxsize=1)
def _regions() -> dict[str, str]:
    return {n.lower(): n for n in available_timezones()}


class ZoneTables:
    """Transitions of zones over FIRST to LAST, taken once from one version of the zone data and shipped as arrays."""

    def __init__(self, names: tuple[str, ...], version: str, tables: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names, self.version, self.tables = names, version, tables

    @classmethod
    def build(cls, prefixes: tuple[str, ...] = ("Europe/", "Asia/Istanbul", "Asia/Tbilisi", "Asia/Baku")) -> ZoneTables:
        names = tuple(sorted(n for n in available_timezones() if n.startswith(prefixes)))
        tables = {n.lower(): cls._of(ZoneInfo(n)) for n in names}
        return cls(names, cls._version(), tables)

    def table(self, zone: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The transitions of any region by its lower-case name; one that wasn't shipped is taken from the same version of the zone data once a cell names it."""
        if zone not in self.tables:
            name = _regions().get(zone)
            if name and self._version() != self.version:
                raise ValueError(f"zone data {self._version()} here, {self.version} where the tables were made")
            self.tables[zone] = self._of(ZoneInfo(name)) if name else None
        return self.tables[zone]

    @staticmethod
    def _version() -> str:
        for p in ("/usr/share/zoneinfo/tzdata.zi", "/usr/share/zoneinfo/+VERSION"):
            if Path(p).exists():
                with open(p) as f:
                    return f.readline().strip().removeprefix("# version ")
        try:
            import tzdata

            return tzdata.IANA_VERSION
        except ImportError:
            return "unknown"

    @staticmethod
    def _of(zone: ZoneInfo) -> tuple[np.ndarray, np.ndarray]:
        off = lambda s: int(datetime.fromtimestamp(s, timezone.utc).astimezone(zone).utcoffset() / timedelta(seconds=1))
        at, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FIRST, LAST))
        starts, offsets, step = [-(2**60)], [off(at)], 14 * 86400
        while at < end:
            nxt = at + step
            if off(nxt) != offsets[-1]:
                lo, hi = at, nxt
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if off(mid) == offsets[-1] else (lo, mid)
                starts.append(hi)
                offsets.append(off(hi))
            at = nxt
        return np.array(starts, dtype="int64"), np.array(offsets, dtype="int64")

    def to_utc(self, zone: str, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall seconds, and whether each wall time occurs exactly once."""
        starts, offsets = self.table(zone)
        k = np.searchsorted(starts, wall - offsets.max(), "right") - 1
        found, utc = np.zeros(len(wall), dtype="int64"), np.zeros(len(wall), dtype="int64")
        for j in (0, 1, 2):
            i = np.minimum(k + j, len(starts) - 1)
            after = np.where(i + 1 < len(starts), starts[np.minimum(i + 1, len(starts) - 1)], 2**60)
            u = wall - offsets[i]
            hit = (u >= starts[i]) & (u < after) & (k + j < len(starts))
            utc = np.where(hit, u, utc)
            found += hit
        return utc, found == 1


def to_instants(dates: list[str | None], times: list[str | None], zones: ZoneTables, home: str = HOME) -> np.ndarray:
    """UTC minutes since 1970 as float, NaN where the two cells fix no instant."""
    n = len(dates)
    out = np.full(n, np.nan)
    walls: dict[str, tuple[list[int], list[float]]] = {}
    for i, (d, t) in enumerate(zip(dates, times)):
        a = read_date(d) if d is not None else None
        if a is None:
            continue
        day, seconds, zone, epoch = a
        blank = t is None or not t.strip()
        b = None if blank else read_time(t)
        if not blank and b is None:
            continue
        if epoch is not None:
            out[i] = epoch
            if b is not None:
                out[i] = np.nan
            continue
        if seconds is None:
            if b is None:
                continue
            seconds, zone = b
        elif b is not None and (b[0] != seconds or b[1] is not None and b[1] != zone):
            continue
        wall = day * 86400 + seconds
        if isinstance(zone, int):
            out[i] = wall - zone * 60
        else:
            at, values = walls.setdefault(zone or home.lower(), ([], []))
            at.append(i)
            values.append(wall)
    for zone, (at, values) in walls.items():
        if zones.table(zone) is not None:
            wall = np.array(values)
            utc, once = zones.to_utc(zone, np.floor(wall).astype("int64"))
            out[at] = np.where(once, utc + (wall - np.floor(wall)), np.nan)
    return np.floor(out / 60 + 0.5)
