"""Template residue: slots induced by aligning records of one template, and repeated error pages."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from operator import eq

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.operators.skew import attach
from fixturelake.session import broadcast_checked, durable, small_enough, spread

#: Identical masked pages from this many records on are one template: where wording speaks for it, and where only its words do.
PAGE_COUNT, SILENT_COUNT = 2, 3
#: Different real values that make a place of a template a slot; fixed words its skeleton has at least, and where a slot is blank.
SLOT_VALUES, FIXED_WORDS, FIXED_WORDS_BLANK = 2, 2, 3
#: Share of a template's records that hold a word in the same place, from which it is fixed.
FIXED_SHARE = 0.8

#: Skeletons, or sentences of pages, and their characters, up to which all workers know them; beyond that they are joined.
KNOWN_ROWS, KNOWN_CHARS = 200_000, 32_000_000
#: Different tokens a worker remembers.
REMEMBERED = 200_000

#: Share of lines from which a text is a trace or an empty form.
SHARE = 0.8

_NAME = r"[A-Za-z_ÇĞİÖŞÜçğıöşü][\w.]{0,40}"
# Delimiters of template languages that ordinary text doesn't use ...
STRONG = [
    r"\{\{\{?-?\s*(N)\s*-?\}?\}\}", r"\$\{\s*(N)\s*\}", r"#\{\s*(N)\s*\}", r"<%[=-]?\s*(N)\s*-?%>", r"\{%\s*(N)\s*%\}",
    r"@@(N)@@", r"\[\[\s*(N)\s*\]\]", r"\[(N) BURAYA\]",
]
#: ... and such that it does, which count only around the name of a template variable.
WEAK = [r"\{\s*(N)\s*\}", r"<(N)>", r"«(N)»", r"%(N)%", r"\$(N)\$", r"(?<!\w)__(N?)__(?!\w)", r"\[(N)\]"]
STRONG = [re.compile(p.replace("N", _NAME)) for p in STRONG]
WEAK = [re.compile(p.replace("(N?)", r"([A-Za-z][\w.]*?)").replace("N", _NAME)) for p in WEAK]
#: How often which mark stands at least where each of them matches.
WEAK_MARKS = [("{", 1), ("<", 1), ("«", 1), ("%", 2), ("$", 2), ("__", 2), ("[", 1)]
#: What an unset variable leaves in its slot.
DEFAULTS = [
    "undefined", "null", "(null)", "none", "nan", "nil", "[object object]", "#ref!", "#n/a", "#value!", "#name?", "#div/0!", "#null!", "#num!",
    "#yok", "#başv!", "#değer!", "#ad?", "#sayı/0!", "#sayi!", "%s", "%d", "n/a", "<na>", "nat",
]
_DEFAULT = re.compile("|".join(re.escape(d) for d in DEFAULTS), re.I)
#: One of these words, or of these marks, stands wherever a default does that isn't part of a word.
DEFAULT_WORDS = {"undefined", "null", "none", "nan", "nil", "nat"}
DEFAULT_MARKS = ("#", "%s", "%d", "n/a", "[object", "<na>")
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse "
    "cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vitae ante quam nunc porta tellus mauris massa vestibulum morbi leo risus at eros cras justo odio dapibus ac facilisis donec ullamcorper "
    "metus auctor fringilla maecenas faucibus interdum aenean lacinia bibendum nullam integer posuere erat a pellentesque".split()
)
#: Wording of pages shown in place of content.
PAGES = [
    r"\b[45]\d\d\b[\s:|—–-]{0,4}(?:not found|sayfa|içerik|page|forbidden|bad|internal|service|gateway|erişim|unavailable|unauthorized)", r"(?:kaldırılmış|silinmiş|taşınmış) (?:ya da|veya|olabilir)", r"\bhttp[ /]?\d?[ .]?\d? ?[45]\d\d\b", r"\bhata \d{3}\b", r"\berror \d{3}\b",
    r"sayfa bulunamadı", r"page (?:[\w']+ ){0,4}?not (?:be )?found", r"seite (?:wurde )?nicht gefunden", r"aradığınız (?:içerik|sayfa)", r"ana ?sayfaya dönün", r"back to (?:the )?home ?page",
    r"(?:internal )?server error", r"could not complete your request", r"isteği(?:niz)? işle(?:ye|n)me", r"bad gateway", r"upstream timed out", r"gateway time-?out",
    r"(?:temporarily )?unavailable", r"retry in \d", r"tekrar deneyin", r"yeniden deneyin", r"try again (?:later|in)", r"too many requests", r"çok fazla istek", r"kota aşıldı", r"quota exceeded", r"rate limit",
    r"zaman aşımına uğradı", r"(?:connection|request|session|oturum)\w* (?:has )?(?:timed out|expired)", r"oturum\w* süresi doldu", r"session (?:has )?expired", r"sitzung.{0,20}abgelaufen",
    r"(?:yeniden |tekrar |lütfen )giriş yap", r"please (?:log|sign) in", r"bitte (?:melden|loggen)",
    r"erişim\w* (?:engellendi|reddedildi|yok)", r"access (?:was |is )?denied", r"permission denied", r"zugriff (?:wurde )?verweigert", r"izin isteyin", r"request (?:access|permission)", r"yetkiniz yok", r"forbidden",
    r"(?:enable|activate|turn on) (?:javascript|scripts?|cookies?)", r"javascript'?[iı]? (?:etkinleştirin|açın)", r"javascript (?:is|must be|and cookies)", r"betik\w* (?:desteklem|çalıştır|etkin)", r"aktivieren sie (?:javascript|skripte|cookies)", r"noscript", r"çerez\w* (?:izin verin|kabul edin|etkinleştirin)", r"cookies? (?:to continue|einverstanden)",
    r"robot olmadığınız", r"not a robot", r"captcha", r"verify (?:that )?you are human", r"kein roboter", r"içerik yüklenemedi", r"content could not be loaded", r"yüklenirken (?:bir )?hata",
    r"bakım (?:çalışması|nedeniyle|modunda)", r"(?:down for|under) maintenance", r"şu anda (?:okunamıyor|kullanılamıyor|hizmet vere)", r"beklenmeyen (?:bir )?hata", r"bir (?:şeyler ters gitti|hata oluştu)", r"something went wrong",
]
PAGE = re.compile("|".join(f"(?:{p})" for p in PAGES), re.I)
#: What at least one of stands in each wording above, dotted and dotless i alike; a sentence without any is none of them.
STEMS = (
    "found gefunden bulunamad sayfa içerik page forbidden bad internal service gateway erişim unavailable unauthorized kaldirilmiş silinmiş taşinmiş http hata error home server "
    "complete isteği upstream retry tekrar yeniden again many fazla kota quota limit aşimina timed expired süresi sitzung giriş please bitte access permission zugriff izin request yetki "
    "enable activate turn javascript betik aktivieren noscript çerez cookie robot captcha verify content yüklenirken bakim maintenance anda beklenmeyen şeyler something"
).split()


def folded(text: str) -> str:
    """Lower case, dotted and dotless i alike."""
    return text.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()


#: What pages of this sort are about, in languages whose wording isn't listed: a page is one only if it also repeats and never stands in content.
ABOUT = (
    r"\b(?:page|pagina|página|seite|sayfa|site|serv[eiu]\w*|request\w*|requête|solicitud|richiesta|anfrage|istek|err(?:eur|or|ore|o)s?|fehler|hata|session|sesión|sessione|sitzung|oturum|"
    r"acc(?:ess|ès|eso|esso)|zugriff|erişim|navigat\w*|navegador|browser|tarayici\w*|java ?script|scripts?|cookies?|login|connexion|conexión|connection|verbindung|bağlanti|http|url|lien|link)\b"
)

_ABOUT = re.compile(ABOUT)
#: Lines that accompany such a page, or stand in an empty form.
SIDE = re.compile(
    r"^(?:(?:request|trace|error|ray|incident)[ -]?(?:id|no|code)\b.*|referans\w*:? ?\w*\d\w*|ref\.? ?\w*\d\w*|\(?(?:kod|code|no)\.? ?:?\d+\)?|[«‹<←]\s*+\w[ \w]*+|geri dön|go back|\(?sayfa \d+/\d+\)?|page \d+ ?(?:/|of) ?\d+|\W*+(?:\d++\W*+)?|[0-9a-f-]{16,}|"
    r"(?:internal )?server error|not found|hata|error|fehler|uyarı|warning|[45]\d\d\b.{0,30})$",
    re.I,
)
TRACE = re.compile(r"^(?:traceback \(most recent call last\)|(?:[\w.]+\.)?\w*(?:error|exception)\b: .+|caused by: .+|\s+at [\w.$<>]+ ?\(.*:\d+.*\)|\s*file \"[^\"]+\", line \d+.*|exception in thread .+|panic: .+)", re.I)
#: Invitations to write something, in place of what should be written.
INVITE = re.compile(
    r"(?:metni|metin|yazı\w*|içer\w*|başlı\w*|özet\w*|açıklama\w*) (?:\w+ )?(?:giriniz|girin|yazınız|yazın|ekleyin|eklemek için tıklayın|gelecek|eklenecek)|buraya (?:metin|yazı|içerik)|"
    r"(?:your|some|body|placeholder) (?:text|title|content|name) (?:goes )?here|(?:title|text|content|subtitle|heading) goes here|add (?:your|a) (?:content|text|title|subtitle)\b|click to (?:add|edit)|"
    r"(?:hier|ihr) (?:ihren )?text|insert (?:text|title|content)|^(?:sub)?title$|^alt başlık$",
    re.I,
)
#: What some folded token holds where an invitation stands; in an empty form, else; and in a trace but for frames.
INVITES = re.compile(r"girin|yazin|ekley|ekleme|eklenecek|gelecek|buraya|^here|add$|click$|^text|insert|title|alt$")
FORMS = re.compile(r"\.{3}|_{3}|…|-{3}|[\[<#]|todo|tbd|fixme|xxx")
TRACES = re.compile(r"error:|exception|traceback|caused$|file$|panic:|\.{3}|[~^]")
TODO = re.compile(r"^\W*(?:todo|tbd|fixme|xxx)\b\W*+(?:\w++\W*+)?$", re.I)
BLANK = re.compile(r"^[^:\n.…_]{0,40}:?\s*(?:(?:\.{3,}+|_{3,}+|…++|-{3,}+|\[\s*\])[\s/·,:-]*+)++$")
FILLED = re.compile(r"[^:\n]{1,40}:\s*\w")
FIELD = re.compile(r"^[<\[][^<>\[\]\n]{2,40}[>\]](?:\s*[-/·,]\s*[<\[][^<>\[\]\n]{2,40}[>\]])*$")
REPEAT = re.compile(r"(?<!\w)((?:[^\W\d_]+ ){0,3}[^\W\d_]+)[.,;:!]*\s+(?:\1[.,;:!]*\s+){2,}\1(?!\w)", re.I)
QUOTED = {"'": "'", '"': '"', "‘": "’", "“": "”", "`": "`"}
MARKUP = re.compile(r"<(?:!doctype|/?(?:html|head|title|body|h\d|hr|p|br|div|span|meta|center|noscript|script)\b)[^<>]*>", re.I)


_UNSEEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")


def plain(text: str) -> str:
    """Compatibility forms and blanks of all kinds as plain ones; line ends as one sort."""
    s = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    s = s if unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)
    if s.replace("\n", "").isprintable():  # neither unseen marks nor other blanks
        return s
    return re.sub(r"[^\S\n ]", " ", _UNSEEN.sub("", s))


def names_in(text: str, patterns: list[re.Pattern]) -> set[str]:
    """Folded names inside delimiters, but not those quoted as the name of a delimiter's own field."""
    out = set()
    for p in patterns:
        for m in p.finditer(text):
            a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not (a and QUOTED.get(a) == b):
                out.add(m[1].replace("İ", "i").replace("I", "ı").lower().replace("ı", "i"))
    return out


def page_mask(text: str) -> str:
    """The page with numbers and ids masked, as the key of its template."""
    s = re.sub(r"\b(?=[0-9a-f-]*\d)[0-9a-f-]{8,}\b|\d+", "0", plain(text).strip().lower())
    return re.sub(r"'[\w.]+'", "'x'", s)


def default_slots(line: str) -> bool:
    """Whether one default fills two slots of a line with little fixed text between them."""
    low = line.lower().replace("i̇", "i")
    for d in DEFAULTS:
        if low.count(d) < 2:
            continue
        at = [m.start() for m in re.finditer(rf"(?<!\w){re.escape(d)}(?!\w)", low)]
        for a, b in zip(at, at[1:]):
            between = low[a + len(d) : b]
            if "." not in between.strip(" .")[1:-1] and len(re.findall(r"\w+", between)) <= 3:
                return True
    return False


_WORD = re.compile(r"\w+")


def filler(text: str) -> bool:
    """Whether the text holds filler: a run of filler Latin, or one short phrase said over and over."""
    low = folded(text)
    words = _WORD.findall(low)
    if not LOREM.isdisjoint(words):
        run = 0
        for w in words:
            run = run + 1 if w in LOREM else 0
            if run >= 8:
                return True
    # where a phrase of k words is said four times, 3 k words in a row are said again k places on
    if any(b"\1" * (3 * k) in bytes(map(eq, words, islice(words, k, None))) for k in range(1, 5)):
        return any(any(c.isalpha() for c in m[1]) for m in REPEAT.finditer(low + " "))
    return False


def untraced(lines: list[str]) -> list[str]:
    """Lines that don't belong to a trace: neither its own, nor the source line under a frame's place, nor lines of left-out frames."""
    out, place = [], False
    for ln in lines:
        own = TRACE.match(ln) is not None
        if not (own or place and ln[:1].isspace() or re.match(r"\s*(?:\.\.\. \d+ (?:more|common)|[~^]+$)", ln)):
            out.append(ln)
        place = own and re.match(r"\s*file ", ln, re.I) is not None
    return out


def whole_page(text: str, signs: int | None = None) -> str | None:
    """What kind of page the whole text is, when it is one instead of content: trace, form or notice. signs: those of the text, where known."""
    body = html.unescape(MARKUP.sub("\n", text)) if "<" in text or "&" in text else text
    marked = body != text
    signs = signs_of(body.split()) if marked or signs is None else signs
    lines = [x for x in (ln.rstrip() for ln in body.split("\n")) if x.strip()]
    if not lines:
        return "page" if marked else None
    if marked or count(signs, TRACE_SIGN) or count(signs, FRAME_SIGN) and any(ln[0].isspace() for ln in lines):
        strange = untraced(lines)
        hits = len(lines) - len(strange)
        if (hits >= SHARE * len(lines) or hits >= max(1, len(lines) - 1) and len(strange[0]) <= 400) and any(re.match(r"\s*(?:at |file )", ln, re.I) or len(lines) <= 2 for ln in lines):
            return "trace"
    lines = [ln.strip() for ln in lines]
    if all(SIDE.match(ln) for ln in lines):
        return "page" if marked or any(re.search(r"\b[45]\d\d\b|error|hata", ln, re.I) for ln in lines) else None
    if marked or count(signs, FORM_SIGN) or count(signs, INVITE_SIGN):
        left = [ln for ln in lines if not SIDE.match(ln)]
        invites = marked or count(signs, INVITE_SIGN) > 0
        other = [ln for ln in left if not (BLANK.match(ln) or FIELD.match(ln) or TODO.match(ln) or invites and len(ln) <= 60 and INVITE.search(ln))]
        # headings and instructions may stand among the fields, filled fields may not
        if len(left) - len(other) >= SHARE * len(left) and not any(FILLED.match(ln) for ln in other):
            if any(any(c.isalnum() for c in ln) for ln in left) and (len(left) >= 2 or not BLANK.match(left[0])):
                return "form"
        if all(re.fullmatch(r"\W*(?:#\w+[!?/]?\w*[!?]?)\W*(?:[-/·,]\W*#\w+[!?/]?\w*[!?]?\W*)*", ln) for ln in left):
            return "form"
    return "page" if worded(lines, count(signs, STEM_SIGN)) else None


@lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in STEMS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def about(low: str, hits: int) -> bool:
    """Whether half the sentences of a folded text or more are about what error pages are about. hits: tokens of the text that may be."""
    said = []
    for x in pieces(_SAID, low) if hits else ():
        if re.search(r"[^\W\d_]", x):
            said.append(x)
            if len(said) > 2 * hits:
                return False
    return 0 < len(said) <= 2 * sum(_ABOUT.search(x) is not None for x in said)


_SAID, _SAID_IN = re.compile(r"(?<=[.!?])\s+|\n"), re.compile(r"(?<=[.!?])\s+(?=\w)")


def pieces(ends: re.Pattern, text: str) -> Iterator[str]:
    """As split gives them, one by one."""
    at = 0
    for m in ends.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class _Remembered(dict):
    """What a function says of a token, kept for some REMEMBERED tokens."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, token: str):
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[token] = self.f(token)
        return out


#: What is counted over a text's tokens in one sum: bits of each count, and where it begins.
_COUNT = 32
STEM_SIGN, ABOUT_SIGN, DEFAULT_SIGN, LOREM_SIGN, INVITE_SIGN, FORM_SIGN, TRACE_SIGN, FRAME_SIGN, LEFT_SIGN = (_COUNT * i for i in range(9))


def count(signs: int, of: int) -> int:
    return signs >> of & (1 << _COUNT) - 1


def _signs(token: str) -> int:
    low = folded(token)
    words = _WORD.findall(low)
    found = {
        STEM_SIGN: sum(1 for _ in _stems().iter(low)), ABOUT_SIGN: _ABOUT.search(low) is not None, DEFAULT_SIGN: not DEFAULT_WORDS.isdisjoint(words) or any(d in low for d in DEFAULT_MARKS),
        LOREM_SIGN: sum(w in LOREM for w in words), INVITE_SIGN: INVITES.search(low) is not None, FORM_SIGN: FORMS.search(low) is not None, TRACE_SIGN: TRACES.search(low) is not None, FRAME_SIGN: low == "at",
        LEFT_SIGN: may_be_left(token),
    }
    return sum(n << at for at, n in found.items())


_signs_known = _Remembered(_signs)


def signs_of(tokens: list[str]) -> int:
    """How many signs of each kind the tokens hold: none of what is looked for in a text goes without, but for blanks (gaps). ABOUT's "java script" shows by its second word."""
    return sum(map(_signs_known.__getitem__, tokens))


#: A number for each token without the marks behind it; few differ that have the same.
_number = _Remembered(lambda t: zlib.crc32(folded(t).strip(".,;:!").encode("utf-8", "surrogatepass")) | 1)


def said_over(tokens: list[str]) -> bool:
    """Whether a phrase may be said four times: of its k words, 3 k are said again k places on, the first and the last perhaps with marks before or behind."""
    packed = array("I", map(_number.__getitem__, tokens)).tobytes()
    n = int.from_bytes(packed, "little")
    return any(b"\0" * (4 * (3 * k - 2)) in (n ^ n >> 32 * k).to_bytes(len(packed), "little") for k in range(1, 5))


def stemmed(text: str) -> bool:
    return next(_stems().iter(folded(text)), None) is not None


def worded(lines: list[str], stems: int) -> bool:
    """Whether notices fill the lines, but for those that accompany them, whatever their length: at most a third and never most sentences say something else. stems: how many stand there."""
    said, silent, n_silent, total = [], 0, 0, 0
    for ln in lines if stems else ():
        if SIDE.match(ln):
            continue
        for x in pieces(_SAID_IN, ln):
            if re.search(r"\w", x):
                total += len(x)
                if stemmed(x):
                    said.append(x)
                elif not SIDE.match(x.strip(". ")):
                    silent, n_silent = silent + len(x), n_silent + 1
                    if n_silent > stems:  # more than sentences that can hold one
                        return False
    if not said or silent > 0.34 * total or n_silent > len(said):
        return False
    other = [x for x in said if not PAGE.search(x)]
    hits = len(said) - len(other)
    other = [x for x in other if not SIDE.match(x.strip(". "))]
    return hits > 0 and silent + sum(map(len, other)) <= 0.34 * total and n_silent + len(other) <= hits


# Parts of a text that values fill: names and numbers, variables, defaults, blanks to fill in, and the gap (¶) a missing value leaves.
_GAP = "¶"
_LEFT = (
    r"[A-Za-z][A-Za-z0-9]*+_\w+(?:\.\w+)*+|[a-z]++\.[a-z]++_\w+|[\{<\[«%$_@#]{1,3}[A-Za-zÇĞİÖŞÜçğıöşü][\w.]*[\}>\]»%$_@]{1,3}|"
    r"(?i:undefined|null|none|nan|nil|nat|n/a|\[object object\]|\(null\))|#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!|NULL!|NUM!|YOK|BAŞV!|DEĞER!|AD\?|SAYI/0!)|%[sd]|\.{3,}|_{2,}|…+|-{3,}"
)
_VALUE = rf"(?:{_LEFT}|{_GAP}|\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}’'/-]*+(?:\.(?=\p{{Lu}}))?|\p{{L}}*+\p{{N}}[\p{{L}}\p{{N}}]*+(?:[.:/-]\p{{N}}++)*+)"
#: Begins and ends of a value: neither inside a word.
_REGION = rf"(?<![\p{{L}}\p{{N}}_]){_VALUE}(?:\s+{_VALUE})*(?![\p{{L}}\p{{N}}_])"
_SENTENCE = r"[.!?](?<=[\p{L}\p{N}\p{M})\]}»>\"'!?].)\s+|\n"


_D = "\ue000"  # around each value while a sentence is put together
_BETWEEN = f"{_D} {_D}"


def _either(words: str) -> str:
    """Of A to Z either case, as (?i:) has it in the patterns' first language."""
    return re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


def _ascii(pattern: str) -> str:
    """The pattern with words, blanks and either case of ASCII only."""
    out = re.sub(r"\(\?i:((?:\\.|[^()])*)\)", lambda m: f"(?:{_either(m[1])})", pattern)
    return out.replace(r"[\w.]", "[A-Za-z0-9_.]").replace(r"\w", "[A-Za-z0-9_]").replace(r"\s", r"[ \t\n\x0b\f\r]")


_REGIONS = regex.compile(_ascii(_REGION))
_IN_TOKEN = regex.compile(_ascii(rf"(?<![\p{{L}}\p{{N}}_]){_VALUE}(?![\p{{L}}\p{{N}}_])"))
_SHOWN = regex.compile(_ascii(rf"{_GAP}|(?<![\p{{L}}\p{{N}}_])(?:{_LEFT})(?![\p{{L}}\p{{N}}_])"))
_ENDS = regex.compile(_ascii(_SENTENCE))
_BLANKS = [*((c, " ") for c in "\u00a0\u202f\u2009\t"), ("\r", "\n"), *((c, "") for c in "\u200b\u200c\u200d\u200e\u200f\u00ad\ufeff")]
_GAP_MARKS = re.compile(" [ ,.;:!?)]")
_GAPS = regex.compile(_ascii(r"(?<=\S)  +(?=\S)| (?=[,.;:!?)](?:\s|[\x85\u2028\u2029]?\Z))").replace(r"\S", r"[^ \t\n\x0b\f\r]"))

#: A token by itself with its values marked, None if the next token may decide about it. No value but "[object object]" holds a blank.
_marked = _Remembered(lambda t: None if _D in t or "\x0b" in t or "\f" in t or t[-7:].lower() == "[object" else _IN_TOKEN.sub(rf"{_D}\g<0>{_D}", t))


def spaced(text: str) -> str:
    """Blanks and line ends of one kind, and a mark where a value is missing after a line's last colon."""
    t = text
    for c, by in _BLANKS:
        if c in t:
            t = t.replace(c, by)
    return re.sub(": *\n", f": {_GAP}\n", t) if ":\n" in t or ": \n" in t else t


def may_be_left(token: str) -> bool:
    return token[-7:].lower() == "[object" or _SHOWN.search(token) is not None


def segments(t: str, parts: list[str]) -> Iterator[str]:
    """Sentences and lines (parts) of a spaced text, and a mark where a value is missing: between a blank and a mark, or between two blanks."""
    gaps = _GAP_MARKS.search(t)
    for x in parts:
        if x:
            y = x.strip(" ")
            if gaps and _GAP_MARKS.search(x):
                y = re.sub(" +", " ", _GAPS.sub(f" {_GAP} ", y))
                y = re.sub(rf"(?<={_GAP}) (?=[,.;:!?)])", "", y).strip(" ")
            yield y


def aligning(seg: str) -> tuple[str, list[str]]:
    """A sentence's skeleton before it is lowered, its fixed words with ¤ for each value, and the values. Values with only a blank between are one."""
    try:
        parts = " ".join(map(_marked.__getitem__, seg.split(" "))).replace(_BETWEEN, " ").split(_D)
        return "¤".join(parts[::2]), parts[1::2]
    except TypeError:
        return _REGIONS.sub("¤", seg), _REGIONS.findall(seg)


def small_known(df: DataFrame, text: str) -> bool:
    """Whether all workers may know df."""
    n, chars = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    return n <= KNOWN_ROWS and (chars or 0) <= KNOWN_CHARS


def placed(df: DataFrame, key: str, text: str, asked: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_id, _sk, _at, _v): values and their places in sentences with one of the asked skeletons; and (_id, _p): texts where a sentence of a page stands, or begins a sentence. One reading of the texts.

    asked: (_text, _sk), pages: (_p, page). Where there are few of them, all workers know them, else they are joined.
    """
    sc = df.sparkSession.sparkContext
    known = {r[0]: r[1] for r in asked.select("_text", "_sk").toLocalIterator()} if small_known(asked, "_text") else None
    heads: dict[str, list[tuple[str, int]]] | None = {} if small_known(pages, "page") else None
    if heads is not None:
        for p, page in pages.select("_p", "page").toLocalIterator():
            for y in {masked(y) for y in _ENDS.split(page)}:
                if " " in y:
                    heads.setdefault(head(y), []).append((y, p))
    shared = sc.broadcast((known, heads))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = shared.value
        key_of = _Remembered(lambda sk: known.get(sk.lower())) if known is not None else None
        begins = _Remembered(lambda x: heads.get(masked(x)))
        for b in batches:
            ids, keys, texts, values, ends, inside = [], [], [], [], [0], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                s = spaced(t)
                parts = _ENDS.split(s)
                for seg in segments(s, parts):
                    sk, found = aligning(seg)
                    if not found:
                        continue
                    if key_of is None:
                        keys.append(None), texts.append(sk.lower())
                    elif (k := key_of[sk]) is not None:
                        keys.append(k), texts.append(None)
                    else:
                        continue
                    ids.append(i), values.extend(found), ends.append(len(values))
                if heads:
                    theirs = set()
                    for x in parts if s == t else _ENDS.split(t):
                        x = x.lstrip(" ")
                        if like := begins[head(x)]:
                            low = masked(x)
                            theirs.update(p for y, p in like if low.startswith(y))
                    inside += [(i, p) for p in theirs]
            n = len(inside)
            lists = pa.ListArray.from_arrays(pa.array([*ends, *[len(values)] * n], pa.int32()), pa.array(values, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, *(i for i, _ in inside)], b.schema.field(0).type), pa.array([*keys, *(p for _, p in inside)], pa.int64()), lists, pa.array([*texts, *[None] * n], pa.string())], names=["_id", "_sk", "_vs", "_text"]
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text).mapInArrow(place, f"_id {kind}, _sk long, _vs array<string>, _text string")
    if known is None:
        met = rows.join(asked.select("_text", F.col("_sk").alias("_asked")), "_text", "left")
        rows = met.withColumn("_sk", F.coalesce("_asked", "_sk")).where("_sk IS NOT NULL")
    rows = durable(rows.select("_id", "_sk", "_vs"))
    inside = rows.where("size(_vs) = 0").select("_id", F.col("_sk").alias("_p")) if heads is not None else said_inside(df, key, text, pages)
    return rows.select("_id", "_sk", F.posexplode("_vs").alias("_at", "_v")), inside


def leftovers(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(_id): records with a slot that kept its variable's name, a default or a blank where other records of their template hold values.

    Sentences are records of one template when they agree in their fixed words: what stays when values (capitalised
    words, numbers, variables, defaults, blanks) are cut out. Within a template every place of a value is aligned over
    all its records; words most of them share there are fixed too. A place is a slot when at least SLOT_VALUES different real values fill it
    and fill it no less often than leftovers do, so words that only look like leftovers ("null skorlu maç") and
    blanks left by every record stay. asked: (_sk, _w), templates of sentences that show a leftover, and their words; only
    their records are aligned, by counts, so a template may hold any share of the corpus. values: as placed gives them.
    """
    each = values.groupBy("_sk", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    told = durable(each.withColumn("_t", F.split("_v", " ")))
    size = told.groupBy("_sk", "_at").agg(F.sum("_n").alias("_all"))
    held = told.select("_sk", "_at", "_n", F.explode(F.array_distinct("_t")).alias("_x")).groupBy("_sk", "_at", "_x").agg(F.sum("_n").alias("_c"))
    # so many records hold a fixed word that a place has few of them
    fixed = held.join(size, ["_sk", "_at"]).where((F.col("_c") >= FIXED_SHARE * F.col("_all")) & ~F.col("_x").rlike(f"^(?:{_LEFT}|{_GAP})$"))
    fixed = fixed.groupBy("_sk", "_at").agg(F.collect_set("_x").alias("_fixed"))
    bare = told.join(fixed, ["_sk", "_at"], "left").withColumn("_t", F.filter(F.array_except("_t", F.coalesce("_fixed", F.array().cast("array<string>"))), lambda x: x != _GAP))
    left = lambda x: x.rlike(rf"^(?:{_LEFT})$")
    dots = lambda x: x.rlike(r"^(?:\.{3,}|_{2,}|…+|-{3,})$")
    kind = (
        F.when(F.size("_t") == 0, "blank").when(F.forall("_t", dots), "blank").when(F.forall("_t", left), "name").when(F.exists("_t", left), "mixed").otherwise("real")
    )
    judged = durable(bare.select("_sk", "_at", "_v", "_n", kind.alias("_kind"), F.concat_ws(" ", "_t").alias("_real")))
    real, lost = F.col("_kind") == "real", F.col("_kind").isin("name", "blank")
    slots = judged.groupBy("_sk", "_at").agg(
        F.sum(F.when(real, F.col("_n"))).alias("_reals"), F.sum(F.when(lost, F.col("_n"))).alias("_losts"), F.approx_count_distinct(F.when(real, F.col("_real"))).alias("_kinds"),
    ).where((F.col("_kinds") >= SLOT_VALUES) & (F.col("_reals") >= F.col("_losts")))
    enough = (F.col("_kind") == "name") | (F.col("_w") >= FIXED_WORDS_BLANK)
    kept = judged.where(lost).join(asked.select("_sk", "_w"), "_sk").where(enough).join(slots.select("_sk", "_at"), ["_sk", "_at"], "left_semi").select("_sk", "_at", "_v", "_n")
    if small_enough(kept := durable(kept)):
        return values.join(F.broadcast(kept), ["_sk", "_at", "_v"], "left_semi").select("_id").distinct()
    return attach(values, kept, ["_sk", "_at", "_v"], "_n").select("_id").distinct()


def head(c: str) -> str:
    return " ".join(c.split(" ", 2)[:2])


def masked(c: str) -> str:
    """page_mask on one sentence without its end."""
    low = folded(c.replace("\r", " ").replace("\u00a0", " ").replace("\t", " "))
    return re.sub(r" +|[.!?]+\Z", " ", re.sub(r"\b(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}\b|[0-9]+", "0", low)).strip(" ")


def said_inside(df: DataFrame, key: str, text: str, pages: DataFrame) -> DataFrame:
    """(_id, _p): as placed gives them, joined, where the pages are too many for the workers to know them all."""
    first, whole = F.udf(lambda x: masked(head(x)), "string"), F.udf(masked, "string")
    asked = pages.select("_p", F.explode(F.split("page", _SENTENCE)).alias("_y")).select("_p", whole("_y").alias("_y")).where("instr(_y, ' ') > 0").withColumn("_head", F.substring_index("_y", " ", 2))
    said = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.explode(F.split(F.col(text), _SENTENCE)).alias("_x")).select("_id", F.ltrim("_x").alias("_x"))
    met = said.withColumn("_head", first("_x")).join(asked, "_head").select("_id", "_p", "_y", whole("_x").alias("_x"))
    return met.where("startswith(_x, _y)").select("_id", "_p")


def repeated_pages(theirs: DataFrame, often: DataFrame, inside: DataFrame) -> DataFrame:
    """(_id): whole pages of error templates known by repetition alone, whatever their wording, language and length.

    theirs: (_id, _p), texts half of whose sentences or more are about what such pages are about, and which SILENT_COUNT records or more are, the same but for numbers
    and ids. often: (_p, _n). Such a page is a template when none of its sentences stands, or begins a sentence, in any text that is no such page (inside): content
    that is copied or cut short shares its sentences with other content, templates of errors don't.
    """
    others = inside.join(broadcast_checked(theirs.select("_id")), "_id", "left_anti").select("_p").distinct()
    return attach(theirs, often.join(others, "_p", "left_anti").select("_p", "_n"), ["_p"], "_n").select("_id")


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason): texts that are residue of a template, filler, an error or script notice, an empty form or a trace.

    Three ways, each over whole texts of any length: sentences of one template are aligned and slots that kept a name,
    a default or a blank are found (leftovers); pages repeated as a whole that never stand in content (repeated_pages);
    and one pass that judges each text by itself. Texts are read twice: for that pass, which finds the templates and pages asked about too, and to look for these (placed). In the first a text is flagged when a slot in strong delimiters still holds
    a name (unless it is quoted as a name), when one in weak delimiters holds a name the corpus has in strong ones,
    when one default fills two slots side by side, when filler runs through it, when all of it is a trace or an empty form, or when
    the wording of an error, access, session or script notice fills it, so that content speaking of such
    things stays; a page repeated word for word but for its numbers needs only some of that wording. Null, empty and blank texts are
    never flagged.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, reasons, names, masks = [], [], [], []
            strong: set[str] = set()

            def add(i, reason, name=None, mask=None):
                ids.append(i), reasons.append(reason), names.append(name), masks.append(mask)

            shown: set[str] = set()
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or not t.strip():
                    continue
                s, x = plain(t), spaced(t)
                tokens = s.split()
                signs = signs_of(tokens)
                if _GAP_MARKS.search(x) or count(signs if s == x else signs_of(x.split()), LEFT_SIGN):
                    shown.update(aligning(seg)[0].lower() for seg in segments(x, _ENDS.split(x)) if _SHOWN.search(seg))
                marked = names_in(s, STRONG) if any(c in s for c in "{@<[$#") else ()
                strong.update(marked)
                if count(signs, DEFAULT_SIGN) and _DEFAULT.search(s) and any(default_slots(ln) for ln in s.split("\n")):
                    add(i, "default")
                elif (count(signs, LOREM_SIGN) >= 8 or said_over(tokens)) and filler(s):
                    add(i, "filler")
                elif kind := whole_page(s, signs):
                    add(i, kind)
                elif marked:
                    add(i, "slot")
                else:
                    for n in names_in(s, [p for p, (c, least) in zip(WEAK, WEAK_MARKS) if c in s and s.count(c) >= least]):
                        add(i, "slot", n)
                    if (n := count(signs, STEM_SIGN)) and 200 * n >= len(s):
                        m = page_mask(s)
                        if sum(len(x[0]) for x in PAGE.finditer(m)) >= 0.3 * len(m):
                            add(i, "page", None, m)
                    if count(signs, ABOUT_SIGN) and about(low := folded(s), count(signs, ABOUT_SIGN)):
                        add(i, "repeated", None, page_mask(low))
            for sk in shown:
                add(None, "shown", None, sk)
            for n in strong:
                add(None, "strong", n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), *(pa.array(c, pa.string()) for c in (reasons, names, masks))], names=["_id", "reason", "name", "page"]
            )

    kind = df.schema[key].dataType.simpleString()
    df = spread(df.select(key, text))
    judged = durable(df.mapInArrow(judge, f"_id {kind}, reason string, name string, page string"))
    sure = judged.where("name IS NULL AND page IS NULL").select("_id", "reason")
    known = judged.where("reason = 'strong'").select("name").distinct()
    weak = judged.where("name IS NOT NULL AND reason = 'slot'").join(broadcast_checked(known), "name", "left_semi").select("_id", "reason")
    paged = judged.where("reason = 'page' AND page IS NOT NULL").withColumn("page", F.xxhash64("page"))
    often = paged.groupBy("page").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= PAGE_COUNT)
    repeated = attach(paged.select("_id", "page"), often, ["page"], "_n").select("_id", F.lit("page").alias("reason"))
    # templates of sentences that show a leftover
    words = F.size(F.expr("regexp_extract_all(_text, '(?<![¤\\\\p{L}])\\\\p{Ll}[\\\\p{L}\\\\p{M}]+', 0)"))
    asked = durable(judged.where("reason = 'shown'").select(F.col("page").alias("_text")).distinct().select("_text", F.xxhash64("_text").alias("_sk"), words.alias("_w")).where(F.col("_w") >= FIXED_WORDS))
    named = judged.where("reason = 'repeated'").select("_id", F.xxhash64("page").alias("_p"), "page")
    same = durable(named.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.first("page").alias("page")).where(F.col("_n") >= SILENT_COUNT))
    theirs = durable(attach(named.select("_id", "_p"), same.select("_p", "_n"), ["_p"], "_n"))
    values, inside = placed(df, key, text, asked, same)
    slots = leftovers(values, asked).select("_id", F.lit("slot").alias("reason"))
    pages = repeated_pages(theirs, same.select("_p", "_n"), inside).select("_id", F.lit("page").alias("reason"))
    found = sure.unionByName(weak).unionByName(repeated).unionByName(slots).unionByName(pages)
    return found.groupBy(F.col("_id").alias(key)).agg(F.min("reason").alias("reason"))
