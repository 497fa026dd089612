"""Personal data, also behind homoglyphs, spelled digits and written-out at and dot signs.

Texts are searched as they stand (base spans).  Then a chain of transducers rewrites disguises, each
step leaving a record of what it replaced; the same detectors read the rewritten text, and what they
find is mapped back to code points of the source.  A mapped span is added where a rewrite took part in
it and no base span of its kind holds it whole, so texts without disguises get nothing.

Defined cases: null and empty texts have no spans; one that is all digits or all signs is read in
linear time, and very long texts are searched whole; repeated rows are searched each; ids may be null; an
empty table gives no rows; further columns of the table are left out, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit not after two digits, itself included, is the first of its run: matches start there, and long runs are read once
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")

# Letters of other scripts that look like a Latin letter, each above the letter it is taken for.
_LOOKALIKES = (
    "аеорсухіјѕһԁɡԛԝАВЕКМНОРСТХІЈЅοανικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−。",
    "aeopcyxijshdgqwABEKMHOPCTXIJSoavikptuABEZHIKMNOPTYX------.",
)
# The digits 0 to 9 in four languages.
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _one_to_one() -> dict[int, str]:
    """Code points whose compatibility form is one ASCII character, other scripts' digits, and the lookalikes."""
    found = dict(zip(map(ord, _LOOKALIKES[0]), _LOOKALIKES[1], strict=True))
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and plain.isascii():
            found[code] = plain
        elif (digit := unicodedata.decimal(char, None)) is not None:
            found[code] = str(digit)
    return found


_TABLE = _one_to_one()
_ODD = frozenset(map(chr, _TABLE))
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
_DIGIT = {word: str(i) for words in _DIGIT_WORDS.values() for i, word in enumerate(words.split())} | {"oh": "0"}
_WORD = "|".join(sorted(_DIGIT, key=len, reverse=True))
_GAP = r"[\s.,()-]{1,3}"
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?:plus|\+){_GAP})?(?:(?:{_WORD}|[0-9]+){_GAP}(?:(?:dot|point|punkt|punto|double){_GAP})?){{4,}}(?:{_WORD}|[0-9]+)(?![^\W_])",
    re.IGNORECASE,
)
_DOTTED = re.compile(r"(?<![^\W_])[0-9]+(?:\s+(?:dot|point|punkt|punto)\s+[0-9]+){3,}(?![^\W_])", re.IGNORECASE)
# no space stands before the spaces, so a long run of them is read once
_SPOKEN_DOT = re.compile(r"(?<!\s)\s++(?:dot|point|punkt|punto)\s+", re.IGNORECASE)
_SPOKEN = ("dot", "point", "punkt", "punto")
_DOT_NUMBER = re.compile(r"(?:dot|point|punkt|punto)\s+[0-9]", re.IGNORECASE)
_WORDS_AND_NUMBERS = re.compile(r"[^\W\d_]+|[0-9]+")
# what may stand in a run of spelled digits: 1 a number in figures, 2 a digit's word, 3 a word between them
_ROLE = dict.fromkeys(_DIGIT, 2) | dict.fromkeys(("dot", "point", "punkt", "punto", "double", "plus"), 3)
_RUN = re.compile(rb"[\1-\3]{5,}")
_THREE = re.compile(rb"[\1-\3]{3}")
_PART = re.compile(rf"({_WORD})|(dot|point|punkt|punto)|(plus)|(double)|([0-9]+)|([\s.,()-]+)|(.)", re.IGNORECASE | re.DOTALL)
_BRACKETED = re.compile(r"[\[({<]\s*(?:(at|@|arroba)|dot|\.|punkt|point|punto)\s*[\])}>]\s*", re.IGNORECASE)
_AT_SIGN = re.compile(r"(?<!\s)\s++at\s+|@", re.IGNORECASE)
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*\s+dot\s+[A-Za-z]{2,}(?![A-Za-z0-9])", re.IGNORECASE)
_WRITTEN_DOT = re.compile(r"(?<!\s)\s++dot\s+", re.IGNORECASE)
_AT_DOMAIN = re.compile(r" at (?=(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b)", re.IGNORECASE)
# English words after which a site, not the host of an address, is told.
_NO_NAMES = frozenset(
    """a about active am an and are article as available be been being bought but buy called came chat check click com come contact details directly document documents
    documentation download email everything example file files find first for form found free from go guide have he help her here hers him his hosted i if in info
    information is it item its job just link list listed live located login look looked looking looks mail me mine more news not now of office on online only or order our
    ours out page pages posted price project published read register report seen section see shop shown sign site source start stay store story text that the them then
    there these they this those today tools up us version view viewed visit was we website were work worked working works write you your yours""".split()
)

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """(start, rank of the kind, end), leftmost non-overlapping per kind; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            # the longest run of name characters up to the sign, no further back than the last address
            at = m.start()
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewrites:
    """One step: the text with parts replaced, and the way back to positions before the step."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, self.at, self.kept, before, length = [], [0], [(0, 0, 0)], 0, 0
        for start, end, new in edits:
            out += [text[before:start], new]
            length += start - before
            if new:
                self.at.append(length)
                self.kept.append((start, end, len(new)))
                length += len(new)
            self.at.append(length)
            self.kept.append((end, 0, 0))
            before = end
        self.text = "".join([*out, text[before:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._find(start)[0], self._find(end - 1)[1]

    def _find(self, position: int) -> tuple[int, int]:
        i = bisect_right(self.at, position) - 1
        start, end, replaced = self.kept[i]
        if replaced:
            return start, end
        at = start + position - self.at[i]
        return at, at + 1


def _digits_of(run: str) -> str:
    """A run of spelled digits in figures; with dots in it, as in an address, without the gaps."""
    parts = [(m.lastindex, m[0]) for m in _PART.finditer(run)]
    dotted = any(kind == 2 for kind, _ in parts)
    out, twice = "", False
    for kind, part in parts:
        if kind in (1, 5):
            new = _DIGIT[part.lower()] if kind == 1 else part
            out, twice = out + new * (1 + twice), False
        elif kind == 2:
            out = out.rstrip() + "."
        elif kind == 3 or part == "+":
            out += "+"
        elif kind == 4:
            twice = True
        elif not dotted and out[-1:] not in ("", " ", "+", "-"):
            out += "-" if part == "-" else " "
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of five numbers or more, two of them in words."""
    # such runs are rare in prose: other signs may touch the first and the last number of one, but three stand free inside it
    bare = text.lower()
    for sign in ".,()-":
        bare = bare.replace(sign, " ")
    if not _THREE.search(bytes([_ROLE.get(w, 0) or w.isdigit() for w in bare.split()])):
        return []
    roles = bytes([1 if w[0] in "0123456789" else _ROLE.get(w, 0) for w in _WORDS_AND_NUMBERS.findall(text.lower())])
    if not any(m[0].count(2) > 1 for m in _RUN.finditer(roles)):
        return []
    return [(m.start(), m.end(), _digits_of(m[0])) for m in _SPELLED.finditer(text) if sum(p.lastindex == 1 for p in _PART.finditer(m[0])) > 1]


def _dotted(text: str) -> list[tuple[int, int, str]]:
    """number dot number dot number dot number"""
    low = text.lower()
    if not any(word in low for word in _SPOKEN) or not _DOT_NUMBER.search(text):
        return []
    return [(m.start(), m.end(), _SPOKEN_DOT.sub(".", m[0])) for m in _DOTTED.finditer(text)]


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    edits, before = [], 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > before and text[start - 1].isspace():
            start -= 1
        edits.append((start, m.end(), "@" if m[1] else "."))
        before = m.end()
    return edits


def _name_before(text: str, end: int, low: int, spoken: bool) -> int | None:
    """Where the name that ends at `end` begins, not before `low`; with `spoken`, parts may be joined by the word dot."""
    start = end
    while True:
        at = start
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            return None if at == end else at
        if not spoken:
            break
        gap = start
        while gap > low and text[gap - 1].isspace():
            gap -= 1
        word = gap - 3
        if gap == start or word <= low or text[word:gap].lower() != "dot" or not text[word - 1].isspace():
            break
        while word > low and text[word - 1].isspace():
            word -= 1
        if word == low or text[word - 1] not in _LOCAL:
            break
        start = word
    while start < end and text[start] == ".":
        start += 1
    return None if start == end or start > 0 and text[start - 1] == "@" else start


def _written(text: str) -> list[tuple[int, int, str]]:
    """name at host dot tld; and name at host.tld in any case, where the name is no word such as look or us.

    Both begin at the sign and go each way from there, so names and hosts may have any length.
    """
    edits, last = [], 0
    if "dot" in text.lower() and _WRITTEN_DOT.search(text):
        for m in _AT_SIGN.finditer(text):
            domain = _SPOKEN_DOMAIN.match(text, m.end()) if m.start() >= last else None
            start = _name_before(text, m.start(), last, True) if domain else None
            if start is not None:
                whole = [_WRITTEN_DOT.sub(".", text[start : m.start()]), "@", _WRITTEN_DOT.sub(".", domain[0])]
                edits.append((start, domain.end(), "".join(whole)))
                last = domain.end()
    taken, k = list(edits), 0
    for m in _AT_DOMAIN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] <= m.start():
            continue
        start = _name_before(text, m.start(), taken[k - 1][1] if k else 0, False)
        if start is not None:
            name = text[start : m.start()]
            if name[0].isalnum() and name[-1].isalnum() and name.lower() not in _NO_NAMES:
                edits.append((m.start(), m.end(), "@"))
    return sorted(edits)


def deobfuscated(text: str) -> tuple[str, list[Rewrites], bool]:
    """The normalised text, the steps that lead back, and whether letters were swapped in place."""
    plain, swapped = text, False
    if not text.isascii():
        if not _ODD.isdisjoint(text):
            plain, swapped = text.translate(_TABLE), True
    steps = []
    for edit in (lambda t: [(m.start(), m.end(), "") for m in _HIDDEN.finditer(t)] if not t.isascii() else [], _bracketed, _written, _dotted, _spelled):
        if edits := edit(plain):
            steps.append(Rewrites(plain, edits))
            plain = steps[-1].text
    return plain, steps, swapped


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the transducers add."""
    base = detect(text)
    plain, steps, swapped = deobfuscated(text)
    added: list[Span] = []
    if steps or swapped:
        for start, kind, end in detect(plain):
            s, e = start, end
            for step in reversed(steps):
                s, e = step.source(s, e)
            if text[s:e] != plain[start:end] and not any(k == kind and bs <= s and e <= be for bs, k, be in base):
                added.append((s, kind, e))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base spans, base, spans, n_added) a row; base and spans as kind:start:end, joined by commas.

    One pass over the rows and no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base_spans, spans, n_added = [], [], []
            for text in batch.column("_text"):
                base, added = find(text.as_py() or "")
                for k in range(len(KINDS)):
                    counts[k].append(sum(b[1] == k for b in base))
                base_spans.append(joined(base))
                spans.append(joined(base + added))
                n_added.append(len(added))
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts)]
            columns += [pa.array(base_spans, pa.string()), pa.array(spans, pa.string()), pa.array(n_added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, n_added bigint")


