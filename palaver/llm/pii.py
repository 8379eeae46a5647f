"""Personal data in texts, plain or disguised, with spans in the original text.

Plain identifiers are found in the text as it stands. Disguised ones are found in a normalised text: transducers
rewrite look-alike letters and digits, drop invisible characters, turn spelled digits into digits and at/dot words
into signs, and character references into what they name. Each keeps, for every character it writes, the span of the source it was read from, so what is detected
in the normalised text maps back to source characters. Plain spans always stay. A disguised span that goes beyond a plain
one it meets comes besides, as a whole: of an address with look-alikes in front the plain one is only the tail.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same spans as the pattern of `ip`, from the first digit of a run only, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A document must show one of these for its kind to be looked for at all.
_HINTS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]+\.[0-9]"), "card": re.compile(r"[0-9]([\x20-]?[0-9]){11}"), "phone": re.compile(r"\+[0-9]")}
#: Look-alikes of ASCII letters and signs. What stands for one by its decimal value or compatibility form follows by rule.
LOOKALIKES = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s", "\u0501": "d", "\u04bb": "h", "\u043a": "k", "\u043c": "m", "\u0442": "t", "\u04cf": "l", "\u051b": "q", "\u051d": "w",
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H", "\u041e": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0425": "X", "\u0406": "I", "\u0405": "S", "\u0408": "J", "\u04c0": "I",
    "\u03bf": "o", "\u03b1": "a", "\u03bd": "v", "\u03c1": "p", "\u03b9": "i", "\u03c5": "u", "\u03ba": "k", "\u03c4": "t", "\u03c7": "x", "\u03b3": "y", "\u03b7": "n",
    "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039a": "K", "\u039c": "M", "\u039d": "N", "\u039f": "O", "\u03a1": "P", "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X",
    "\u1d00": "a", "\u0299": "b", "\u1d04": "c", "\u1d05": "d", "\u1d07": "e", "\ua730": "f", "\u0262": "g", "\u029c": "h", "\u026a": "i", "\u1d0a": "j", "\u1d0b": "k", "\u029f": "l", "\u1d0d": "m", "\u0274": "n", "\u1d0f": "o", "\u1d18": "p", "\u0280": "r", "\ua731": "s", "\u1d1b": "t", "\u1d1c": "u", "\u1d20": "v", "\u1d21": "w", "\u028f": "y", "\u1d22": "z",
    "\u0130": "I", "\u0131": "i", "\u0251": "a", "\u0261": "g", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits, signs and the plus by name in the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "f\u00fcnf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "z\u00e9ro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "\u00e4t", "arobase", "arroba"), ("dot", "punkt", "point", "punto"), ("plus", "m\u00e1s")
#: The words for an @ that each word for a dot goes with: `at this point in time` is prose, `arobase exemple point fr` is not.
AT_WITH = {"dot": ("at",), "punkt": ("at", "\u00e4t"), "point": ("arobase",), "punto": ("arroba",)}
#: Words that stand for an @ and are no words of prose.
SURE_AT = frozenset(("\u00e4t", "arobase", "arroba"))
#: Endings of hosts that count after a word for a dot or for an @. The second row are words of the four languages as well,
#: and count where no word follows, or where the word for the @ is sure.
ENDINGS = frozenset(
    "com net org edu gov mil int info biz name pro app dev io ai xyz online shop site tech cloud web blog news email eu uk fr ch nl pl pt ru ua cz sk hu ro bg gr tr dk fi ie ca au nz jp cn kr tw hk sg br mx ar cl za il ae ke ng example invalid test local".split()
)
WORD_ENDINGS = frozenset("at be co de es in is it me my no se so to tv us am as do la li lu si".split())
#: What stands before `at` in prose, and after it: neither begins an address spelled with a bare word.
NO_LOCAL = frozenset(
    "a about again all am an and are arrive arrived arrives at available away back be been begin begins both but by call come comes down each end ends find for found from gather go good had has have he held her here him his hosted i if in is it its join just later laughing live lives look looked looking looks me meet meeting meets more now of off on once one online only open or our out page pages paused point pointed published read rest says see she shop shout shows sit site so speak stand start started starts stay stop stopped stops store take talk than that the them there these they this those to try up us visit was we website welcome went were while with work worked working works you your".split()
)
NO_HOST = frozenset(
    "a all an another any both certain each either every final first first-class half her his ich its last least le la les le el los las un una une ein eine der die das diese dieser dem den den dieser my next no one only our same second some that the their these third this those three two what whatever which your".split()
)
#: A word near an address that says that one follows; with it, or with a sign or digit inside the name, a dot may be plain.
_CUE = re.compile(r"(?:\b(?:e-?mails?|mail(?:to|en)?|contact|reach|write|kontakt|schreib\w*|adresse|address|courriel|\u00e9cri\w*|contacter?|correo|escrib\w*|contacto)\b[^\n]{0,24})\Z", re.I)


def _tree(words) -> str:
    """A pattern of any of the words, the longest first, that reads what they begin with once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    end = "" in by
    inner = "|".join(c + _tree(rest) for c, rest in by.items() if c)
    return "" if not inner else f"(?:{inner})" + ("?" if end else "")


_DIGIT_WORD, _AT_WORD, _DOT_WORD, _PLUS_WORD = map(_tree, (SPELLED, AT_WORDS, DOT_WORDS, PLUS_WORDS))
_LETTER = r"[^\W\d_]"
#: Digits and digit words in a row. Runs of digits are taken whole: taken apart, their ways grow as powers of two.
_GAP = r"(?:[.-]\x20?|\x20{1,2})?"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_DIGIT_WORD}|[0-9]++)(?:{_GAP}(?:{_DIGIT_WORD}|[0-9]++|{_DOT_WORD}|{_PLUS_WORD})(?!{_LETTER}))+(?![^\W_])", re.I)
#: A row has at least LEAST_SPELLED of these, LEAST_WORDS of them words; fewer are ordinary prose.
_ELEMENT = re.compile(rf"{_DIGIT_WORD}|[0-9]|{_DOT_WORD}|{_PLUS_WORD}", re.I)
LEAST_SPELLED, LEAST_WORDS = 3, 2
_WORD = re.compile(rf"{_DIGIT_WORD}(?!{_LETTER})", re.I)
_SPELLED_DOT = re.compile(rf"\x20{_DOT_WORD}\x20", re.I)
_BRACKETED = re.compile(rf"\x20?[\[({{<]\x20?({_AT_WORD}|{_DOT_WORD}|@|\.)\x20?[\])}}>]\x20?", re.I)
#: A spelled plus before a digit, spelled or not.
_PLUS = re.compile(rf"(?<![^\W_]){_PLUS_WORD}\x20{{0,2}}(?={_DIGIT_WORD}(?!{_LETTER})|[0-9])", re.I)
_DOT = rf"(?:\x20{_DOT_WORD}\x20|\.|\x20\.\x20)"
_LABEL = r"[A-Za-z0-9-]+"
#: A name, a bare word or a blank-padded sign for the @, a host whose dots may be words. What it says is checked by `_address`.
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]++)(?:\x20(?P<at>{_AT_WORD}|@)\x20|(?P<sign>@))(?P<host>{_LABEL}(?:{_DOT}{_LABEL})+)(?![A-Za-z0-9-])", re.I)
#: The same with words between underscores or hyphens.
_GLUED = re.compile(rf"(?<![A-Za-z0-9])(?P<local>[A-Za-z0-9.%+]++)(?P<by>[_-])(?:{_AT_WORD})(?P=by)(?P<host>[A-Za-z0-9.]+(?:(?P=by)(?:{_DOT_WORD})(?P=by)[A-Za-z0-9.]+)+)(?![A-Za-z0-9])", re.I)
_GLUED_SIGN = re.compile(rf"[_-]({_AT_WORD}|{_DOT_WORD})[_-]", re.I)
#: Character references of ASCII letters, digits and signs.
_REFERENCE = re.compile(r"&(?:#0*(?P<ten>[0-9]{2,3})|#[xX]0*(?P<hex>[0-9A-Fa-f]{2})|(?P<name>commat|period|plus|lowbar|hyphen));")
_GOES_ON_IN_WORDS = re.compile(r"\x20?[^\W_]")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-"}
_BARE_SIGN = re.compile(rf"\x20({_AT_WORD}|{_DOT_WORD}|@|\.)\x20", re.I)
# What the rewritings of spelled text need, looked for in lower case: a row of words for digits begins with one and goes on,
# or has one behind a digit.
_BEGUN = re.compile(rf"(?<![^\W_]){_tree([*SPELLED, *PLUS_WORDS])}{_GAP}(?:{_DIGIT_WORD}|[0-9]|{_DOT_WORD}|{_PLUS_WORD})")
_GOES_ON = re.compile(rf"[0-9]{_GAP}{_tree([*SPELLED, *DOT_WORDS, *PLUS_WORDS])}")
_ENCLOSED = re.compile(rf"[\[({{<]\x20?(?:{_AT_WORD}|{_DOT_WORD}|@|\.)\x20?[\])}}>]")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    """Whether a match of a kind's pattern is one."""
    if kind == "ip":
        return all(len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in found.split(".")))
    if kind == "email":
        return True
    digits = "".join(c for c in found if c.isdigit())
    return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the pattern of `email`, each found from its @, so that long words are read once."""
    at = 0
    for sign in re.finditer("@", text):
        j = i = sign.start()
        while i > at and text[i - 1] in _LOCAL:
            i -= 1
        if i < j and (domain := _DOMAIN.match(text, j)):
            at = domain.end()
            yield i, at


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a kind's pattern that don't overlap."""
    if kind == "email":
        return _emails(text)
    return (m.span() for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text))


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain identifiers, in code points, leftmost and not overlapping within a kind."""
    out = []
    for kind in KINDS:
        if _HINTS[kind].search(text):
            out += [(a, b, kind) for a, b in _matches(kind, text) if holds(kind, text[a:b])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Tape:
    """A text being rewritten. What each rewriting put where is kept, so that a span can be traced back to the source."""

    def __init__(self, text: str):
        self.text, self.edits = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put new text for (start, end); each new character comes from the whole of the old ones."""
        if not edits:
            return
        text, places, at, grown = [], ([], [], [], []), 0, 0
        for i, j, new in edits:
            text += [self.text[at:i], new]
            for column, value in zip(places, (i + grown, i + grown + len(new), i, j), strict=True):
                column.append(value)
            at, grown = j, grown + len(new) - (j - i)
        self.text = "".join([*text, self.text[at:]])
        self.edits.append(places)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of characters start to end of the text as it is now; they are one at least."""
        for new_start, new_end, old_start, old_end in reversed(self.edits):
            k, m = bisect_right(new_start, start) - 1, bisect_right(new_start, end - 1) - 1
            if k >= 0:
                start = old_start[k] if start < new_end[k] else start - new_end[k] + old_end[k]
            if m >= 0:
                end = old_end[m] if end <= new_end[m] else end - new_end[m] + old_end[m]
        return start, end


@lru_cache(1 << 16)
def plain_form(c: str) -> str | None:
    """The ASCII character that another one stands for, nothing for an invisible one, None if it stands for itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else LOOKALIKES.get(same)


def _to_ascii(t: Tape) -> None:
    odd = {c: p for c in set(_NOT_ASCII.findall(t.text)) if (p := plain_form(c)) is not None}
    if odd:
        t.rewrite([(m.start(), m.end(), odd[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, sorted(odd))) + "]", t.text)])


def _to_characters(t: Tape) -> None:
    if "&" not in t.text:
        return
    found = [(m, chr(int(m["ten"])) if m["ten"] else chr(int(m["hex"], 16)) if m["hex"] else _NAMED[m["name"]]) for m in _REFERENCE.finditer(t.text)]
    t.rewrite([(m.start(), m.end(), c) for m, c in found if "\x20" < c < "\x7f"])


def may_hold_signs(low: str) -> bool:
    """Whether a text in lower case has a sign in brackets, a spaced @ or dot beside an @, or a word for an @ with dots."""
    dot = any(f" {w} " in low for w in DOT_WORDS)
    bare = ("@" in low and (dot or " @ " in low or " . " in low)) or any(f" {w} " in low for w in AT_WORDS)
    return bare or any(f"{by}{w}{by}" in low for by in "_-" for w in AT_WORDS) or bool(_ENCLOSED.search(low))


def _ends_well(text: str, end: int, last: str, sure: bool = False) -> bool:
    """Whether a last label is an ending of hosts here; one that is a word as well only if sure, or if no word follows."""
    return last in ENDINGS or last.startswith("xn--") or (last in WORD_ENDINGS and (sure or not _GOES_ON_IN_WORDS.match(text, end)))


def _address(text: str, m: re.Match) -> bool:
    """Whether a match of _BARE is an address and not prose. A plain @ and plain dots are left as they are."""
    host = m["host"].lower()
    dots = {w for w in DOT_WORDS if f" {w} " in host}
    if m["sign"] and not dots and " . " not in host:
        return False
    labels = re.split(rf"\x20?\.\x20?|\x20{_DOT_WORD}\x20", host)
    if m["sign"]:
        return _ends_well(text, m.end(), labels[-1])
    at, local = m["at"].lower(), m["local"].lower()
    sure = at in SURE_AT
    if labels[0] in NO_HOST or local.rstrip(".") != local or not _ends_well(text, m.end(), labels[-1], sure):
        return False
    if sure:
        return not any(at not in AT_WITH[w] for w in dots)
    if local in NO_LOCAL:
        return False
    if at == "@":
        return True
    if dots:
        return all(at in AT_WITH[w] for w in dots)
    return " . " not in host and (bool(re.search(r"[._%+0-9-]", local)) or bool(_CUE.search(text, max(0, m.start() - 40), m.start())))


def may_hold_digits(low: str) -> bool:
    return bool(_GOES_ON.search(low) or _BEGUN.search(low))


def _to_signs(t: Tape) -> None:
    if not may_hold_signs(t.text.lower()):
        return
    sign = lambda w: "@" if w == "@" or w.lower() in AT_WORDS else "."
    t.rewrite([(m.start(), m.end(), sign(m[1])) for m in _BRACKETED.finditer(t.text)])
    edits, at = [], 0
    while whole := _BARE.search(t.text, at):
        if _address(t.text, whole):
            edits += [(m.start(), m.end(), sign(m[1])) for m in _BARE_SIGN.finditer(t.text, whole.start(), whole.end())]
            at = whole.end()
        else:
            at = whole.end("local")  # the next name may begin inside of what this one took for its host
    t.rewrite(edits)
    edits = []
    for whole in _GLUED.finditer(t.text):
        if _ends_well(t.text, whole.end(), re.split("[_.-]", whole["host"].lower())[-1]) and not whole["local"].endswith("."):
            edits += [(m.start(), m.end(), sign(m[1])) for m in _GLUED_SIGN.finditer(t.text, whole.end("local"), whole.end())]
    t.rewrite(edits)


def _to_digits(t: Tape) -> None:
    if not may_hold_digits(t.text.lower()):
        return
    t.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(t.text)])
    edits = []
    for run in _SPELLED.finditer(t.text):
        found = _ELEMENT.findall(run[0])
        if len(found) < LEAST_SPELLED or sum(not x.isdigit() for x in found) < LEAST_WORDS:
            continue
        words = list(_WORD.finditer(t.text, run.start(), run.end()))
        for k, m in enumerate(words):
            start = m.start()
            if k and t.text[words[k - 1].end() : start].strip(" ") == "":
                start = words[k - 1].end()  # blanks between spelled digits go
            edits.append((start, m.end(), SPELLED[m[0].lower()]))
        edits += [(m.start(), m.end(), ".") for m in _SPELLED_DOT.finditer(t.text, run.start(), run.end())]
    edits.sort()
    clean: list[tuple[int, int, str]] = []
    for e in edits:
        if clean and e[0] < clean[-1][1]:
            e = (clean[-1][1], e[1], e[2])
        if e[0] < e[1]:
            clean.append(e)
    t.rewrite(clean)


def disguised_spans(text: str, plain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that show only after normalising. What lies within a plain one is known; what reaches beyond plain ones is
    added whole, from the first character to the last of them all."""
    tape = Tape(text)
    if not text.isascii():
        _to_ascii(tape)
    _to_characters(tape)
    _to_digits(tape)
    _to_signs(tape)
    if not tape.edits:
        return []
    out = []
    known = sorted((a, b) for a, b, _ in plain)
    furthest = list(accumulate((b for _, b in known), max))
    for a, b, kind in plain_spans(tape.text):
        i, j = tape.span(a, b)
        at, upto = bisect_right(furthest, i), bisect_left(known, (j,))
        near = [s for s in known[at:upto] if i < s[1]]
        if any(x <= i and j <= y for x, y in near):
            continue
        out.append((min([i, *(x for x, _ in near)]), max([j, *(y for _, y in near)]), kind))
    return sorted(set(out) - set(plain))


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(plain spans, all spans) of a text, each sorted by start and kind."""
    if not text:
        return [], []
    plain = plain_spans(text)
    more = disguised_spans(text, plain)
    return plain, sorted(plain + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else plain


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None) -> str | None:
    """The text with `<kind>` for each span; spans that overlap become one, named after the first."""
    spans = find(text)[1]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in _FOUND]
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            plain, every = find(text)
            base = joined(plain)
            kinds = [s[2] for s in plain]
            for column, value in zip(rows, (key, *map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), base if every is plain else joined(every), len(every) - len(plain)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _FOUND, strict=True)], schema=_FOUND)


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, counts of plain identifiers by kind, digest of their spans, all spans, and how many
    of these the disguises added. Null and empty texts have none; repeated rows repeat; other columns are ignored."""
    small_batches(docs.sparkSession)
    out = docs.select(key, text).mapInArrow(_detect, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("doc_id", key)


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with `<kind>` in place of personal data, plain or disguised; all other columns, null texts and row order stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redacted(x) for x in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return detect(table(spark, sf_dir, "documents"))
