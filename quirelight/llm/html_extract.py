"""Main text of web pages, with templates deduced from equivalence classes of tokens.

A token is an element at its path, or a text at its path.  Tokens of one host that occur the same
number of times on the same distinct pages form an equivalence class: what a page template wrote.
Equal occurrence vectors are recognised by an exclusive-or of hashes of (page, count), which adds up
across tasks, so no vector is ever gathered in one place.  Classes of at least two tokens, an element
among them, are valid on `least` distinct pages, however small a part of the host these are; a single
token is, where it stands inside a valid class that is no rarer and, being a text, fills a fair share
of the places of its own element.  The classes nest by their paths into the host's template.  What the
template does not hold are slots.

Which slot holds the article, the template tells too: from the outermost element of a layout, the way goes
to the element inside it, once on each of its pages, that holds over half of what the slots there hold
outside links on average over the host's pages, as long as there is one.  Menus, adverts, footers and headers are the
slots beside that way.  An explicit article element that the way runs through is taken whole, so
that its title stays.  Inside the slot, texts of the template go; so do elements that HTML or their class
says are no text of the article (forms, asides, adverts, reader comments), as these vary from page to page
like the article and no count tells them apart.

Pages that have no such slot (hosts of fewer than `least` distinct pages, or layouts that no element
dominates) are read by the names of their elements and classes alone: the article, else the main element, else
the page without what is named as something else.

Defined cases: null and empty pages have an empty text; pages without a host share the host "";
unclosed elements end where HTML ends them; a page cut inside a tag or a script loses only that; pages are
read whole, however long; repeated pages are extracted each and count once for their host; ids may be
null; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import cut_lineage

#: Bytes of templates up to which they are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_DROPPED = frozenset("head nav footer aside form script style noscript template svg math iframe object button select textarea dialog menu canvas audio video title fieldset".split())
_DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal
    overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer comment comments reply replies respond disqus share sharing social newsletter
    subscribe subscription login signup related recommended recommendations widget toolbar pagination pager skip topbar masthead complementary contentinfo search""".split()
)
_HEADER_NAMES = frozenset("header banner masthead topbar".split())
_MAIN_NAMES = frozenset("main".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}

#: What a token is: an element, a text outside articles (or one that goes by name), or a text of an article.
ELEMENT, TEXT, ARTICLE_TEXT = 0, 1, 2
#: Where a block stands: in an article, in a main element, elsewhere in the page, or in what goes.
ARTICLE, MAIN, ELSEWHERE, DROPPED = 2, 1, 0, -1
#: Traits of elements: the whole page, in an article or main element, holding a title of the first rank.
FRAME, NAMED, TITLED = 1, 2, 4


def _names(attributes: str) -> tuple[str, frozenset[str]]:
    """The class and id as written, and the words in class, id and role."""
    written, found = [], set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        found |= {x.lower() for x in _NAME.findall(value)} | {x.lower() for x in value.split()}
        written.append(f"{m[1].lower()}={value}")
    return " ".join(written), frozenset(found)


class Page:
    """One pass over a page: its template tokens and its blocks of text."""

    def __init__(self, html: str):
        from xxhash import xxh64_intdigest

        #: (token, token of the element around it, what it is) -> occurrences
        self.tokens: Counter = Counter()
        #: (where, token, text, number of the element around it)
        self.blocks: list[tuple[int, int, str, int]] = []
        #: of every element that text can be in, by number, parents first (0: the page): token, number of the parent, and whether it is named as something else than an article
        self.elements: list[tuple[int, int, bool]] = [(0, -1, False)]
        #: characters outside links of each text and in each element (0: the page), but for what is named as something else
        self.chars: Counter = Counter()
        #: what an element is good for on the way to the article
        self.traits: dict[int, int] = {}
        self._hash = lambda s: xxh64_intdigest(s.encode()) - (1 << 63)
        self._pieces: list[str] = []
        self._muted: list[str] = []  # open inline elements whose text is dropped, from the first such on
        self._linked = 0  # open links
        self._plain = 0  # characters of the block outside links
        self._own: Counter = Counter()  # such characters of the blocks right in an element, by number
        self._titled: set[int] = set()  # elements right around a title of the first rank
        # open elements: (name, number, where, dropped, in or of an element named as something else)
        self._open: list[tuple[str, int, int, bool, bool]] = [("", 0, ELSEWHERE, False, False)]
        self._names: Counter = Counter()  # of the open elements
        self._read(html)
        self._flush()
        self._sum_up()

    def _sum_up(self) -> None:
        """What is in an element is in those around it, too: children come after their parents."""
        for k in range(len(self.elements) - 1, -1, -1):
            token, parent, _ = self.elements[k]
            if own := self._own[k]:
                self.chars[token] += own
            if k in self._titled:
                if k:
                    self.traits[token] = self.traits.get(token, 0) | TITLED
                self._titled.add(parent)
            if parent >= 0 and own:
                self._own[parent] += own

    def _flush(self) -> None:
        if not self._pieces:
            return
        text = " ".join("".join(self._pieces).split())
        plain, self._pieces, self._plain = self._plain, [], 0
        _, number, where, dropped, out = self._open[-1]
        if not text:
            return
        around = self.elements[number][0]
        token = self._hash(f"{around}\t{text}")
        self.tokens[token, around, TEXT if where == ELSEWHERE or dropped else ARTICLE_TEXT] += 1
        if not out:
            self.chars[token] += plain
            self._own[number] += plain
        self.blocks.append((DROPPED if dropped else where, token, text, number))

    def _text(self, text: str) -> None:
        if text and not self._muted:
            text = unescape(text) if "&" in text else text
            self._pieces.append(text)
            if not self._linked:
                self._plain += len(text)

    def _close(self, name: str) -> None:
        """Ends the innermost open element of this name and all inside it."""
        if not self._names[name]:
            return
        self._flush()
        self._muted.clear()
        self._linked = 0
        while True:
            last = self._open.pop()[0]
            self._names[last] -= 1
            if last == name:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in _CLOSES_P and any(o[0] == "p" for o in self._open[-3:]):
            self._close("p")
        elif name == "li" and self._open[-1][0] in ("li", "p"):
            self._close("li")
        elif name in ("td", "th", "tr", "dd", "dt", "option") and self._open[-1][0] == name:
            self._close(name)
        self._flush()
        written, names = _names(attributes) if "=" in attributes else ("", frozenset())
        _, number, where, dropped, out = self._open[-1]
        around = self.elements[number][0]
        token = self._hash(f"{around}\t<{name} {written}")
        self.tokens[token, around, ELEMENT] += 1
        if name in _VOID:
            return
        named = name in _DROPPED or bool(names & _DROPPED_NAMES) and name not in ("body", "html")
        out = out or named
        if not dropped:
            dropped = out
            if not dropped and where != ARTICLE:
                dropped = name == "header" or bool(names & _HEADER_NAMES) and name not in ("body", "html", "article", "main")
        if name == "article":
            where = ARTICLE
        elif name == "main" or names & _MAIN_NAMES and name not in ("body", "html"):
            where = max(where, MAIN)
        if name in ("html", "body"):
            self.traits[token] = FRAME
        elif where != ELSEWHERE:
            self.traits[token] = NAMED
        if name == "h1" and not out:
            self._titled.add(number)
        self._open.append((name, len(self.elements), where, dropped, out))
        self._names[name] += 1
        self.elements.append((token, number, named))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                return
            self._text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name not in _INLINE:
                    if name == "p" and not self._names["p"]:
                        self._flush()
                    self._close(name)
                elif name == "br":
                    self._pieces.append(" ")
                elif self._muted and self._muted[-1] == name:
                    self._muted.pop()
                if name == "a":
                    self._linked = 0
                continue
            if not m[4]:
                return  # cut inside a tag
            if name in _RAW:
                self._start(name, m[3])
                close = _RAW_END[name].search(html, at)
                at = close.start() if close else end
                continue
            if name in _INLINE:
                if name == "a":
                    self._linked = 1
                if name == "br" or name == "img":
                    self._pieces.append(" ")
                elif name not in _VOID and (name in self._muted[:1] or not self._muted and "=" in m[3] and _names(m[3])[1] & _DROPPED_NAMES):
                    self._muted.append(name)
                continue
            self._start(name, m[3])

    def main_text(self, template: frozenset[int] | set[int], slots: frozenset[int] | set[int] = frozenset()) -> str:
        """Texts of the article, joined by line feeds in the order of the page."""
        held = []
        if slots:
            # of each element: whether it is in a slot, and whether one inside the slot around it is named as something else
            inside, out = [], []
            for token, parent, named in self.elements:
                in_slot = parent >= 0 and inside[parent]
                inside.append(in_slot or token in slots)
                out.append(in_slot and (out[parent] or named))
            held = [(token, text, out[number]) for _, token, text, number in self.blocks if inside[number]]
        if held:
            own = [(token, text) for token, text, named in held if not named]
        else:
            best = max((b[0] for b in self.blocks), default=DROPPED)
            own = [(b[1], b[2]) for b in self.blocks if b[0] == best != DROPPED]
            if best == ELSEWHERE:
                return "\n".join(text for token, text in own if token not in template)
        # an article of template texts only stays whole
        return "\n".join([text for token, text in own if token not in template] or [text for _, text in own])


def nested(tokens: list[dict]) -> list[int]:
    """The tokens of valid classes and of what nests in them, from (token, around, vector, support, kind) of one host."""
    by_class: dict[tuple, list[dict]] = {}
    for t in tokens:
        by_class.setdefault((t["vector"], t["support"]), []).append(t)
    valid = [c for c in by_class.values() if len(c) > 1 and any(t.get("kind", ELEMENT) == ELEMENT for t in c)]
    kept = {t["token"]: t["support"] for c in valid for t in c}
    inside: dict[int, list[dict]] = {}
    for t in tokens:
        if t["token"] not in kept and t.get("kind", ELEMENT) != ARTICLE_TEXT:
            inside.setdefault(t["around"], []).append(t)
    ways = list(kept)
    while ways:
        around = ways.pop()
        for t in inside.get(around, ()):
            if t["token"] not in kept and kept[around] >= t["support"]:
                kept[t["token"]] = t["support"]
                ways.append(t["token"])
    return sorted(kept)


def _inner_first(elements: dict[int, dict]) -> list[int]:
    """The elements, those inside another before it."""
    inside: dict[int, list[int]] = {}
    for token, t in elements.items():
        inside.setdefault(t["around"], []).append(token)
    order = [token for token, t in elements.items() if t["around"] not in elements]
    for token in order:  # grows as it goes
        order += inside.get(token, ())
    return order[::-1]


def article_slots(tokens: list[dict], kept: set[int]) -> list[int]:
    """The elements that the ways to the articles of one host's layouts end in, of the template's tokens."""
    inside: dict[int, list[dict]] = {}
    elements = {t["token"]: t for t in tokens if t["kind"] == ELEMENT}
    fixed: Counter = Counter()  # characters of the template's own texts in each element, on all pages
    for t in tokens:
        if t["kind"] == ELEMENT:
            if t["most"] == 1 and t["token"] in kept:
                inside.setdefault(t["around"], []).append(t)
        elif t["token"] in kept:
            fixed[t["around"]] += t["chars"]
    for token in _inner_first(elements):
        if (around := elements[token]["around"]) in elements:
            fixed[around] += fixed[token]

    def leads(t: dict) -> bool:
        """Whether over half of what the element around it varies in is in it, on average over its pages."""
        around = elements.get(t["around"])
        beside = fixed[t["around"]] * t["support"] / around["support"] if around else 0
        return 2 * (t["chars"] - fixed[t["token"]]) > t["around_chars"] - beside

    found, ways = [], [(0, 0, 0)]
    while ways:
        at, traits, named = ways.pop()
        # of a title that the way has, none is left behind
        on = [t for t in inside.get(at, ()) if t["traits"] & TITLED >= traits & TITLED and leads(t)]
        ways += [(t["token"], t["traits"], named or (t["traits"] & NAMED and t["token"])) for t in on]
        if not on and at and not traits & FRAME:
            found.append(named or at)
    return sorted(set(found))


def templates(pages: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """(host, template, slots) from (page, host, html), a page each: texts of the template, and the elements that hold articles.

    Classes are on at least `least` pages; a text that makes no class with an element is on that share of
    the pages of the element around it, too.
    """

    measured = ("token", "around", "kind", "n", "chars", "around_chars", "traits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, found = [], [], []
            for page, host, html in zip(batch.column("page").to_pylist(), batch.column("host").to_pylist(), batch.column("html"), strict=True):
                read = Page(html.as_py() or "")
                rows += [page] * len(read.tokens)
                hosts += [host] * len(read.tokens)
                found += [(*token, n, read.chars[token[0]], read.chars[token[1]], read.traits.get(token[0], 0)) for token, n in read.tokens.items()]
            numbers = zip(*found, strict=True) if found else [()] * 7
            columns = [pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "host", *measured])

    each = pages.select("page", "host", "html").mapInArrow(run, "page bigint, host string, " + ", ".join(f"{c} bigint" for c in measured))
    sums = [F.sum("chars").alias("chars"), F.sum("around_chars").alias("around_chars"), F.max("n").alias("most"), F.bit_or("traits").alias("traits")]
    vectors = each.groupBy("host", "token", "around", "kind").agg(F.count("*").alias("support"), F.expr("bit_xor(xxhash64(page, n))").alias("vector"), *sums)
    common = cut_lineage(vectors.filter(F.col("support") >= least))
    classes = common.groupBy("host", "vector", "support").agg(((F.count("*") > 1) & (F.count_if(F.col("kind") == ELEMENT) > 0)).alias("valid"))
    outer = common.filter(F.col("kind") == ELEMENT).select("host", F.col("token").alias("around"), F.col("support").alias("places"))
    judged = common.join(classes, ["host", "vector", "support"]).join(outer, ["host", "around"], "left")
    fills = (F.col("kind") == TEXT) & (F.col("support") >= share * F.col("places"))
    judged = judged.filter(F.col("valid") | (F.col("kind") == ELEMENT) | fills)
    # of a host: the elements on `least` pages, and the texts that may be of its template
    lists = judged.groupBy("host").agg(F.collect_list(F.struct("token", "around", "vector", "support", "kind", "chars", "around_chars", "most", "traits")).alias("tokens"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, slots = [], []
            for tokens in batch.column("tokens").to_pylist():
                texts, kept = {t["token"] for t in tokens if t["kind"] != ELEMENT}, nested(tokens)
                made.append([t for t in kept if t in texts])
                slots.append(article_slots(tokens, set(kept)))
            columns = [batch.column("host"), *(pa.array(x, pa.list_(pa.int64())) for x in (made, slots))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "template", "slots"])

    return lists.mapInArrow(nest, "host string, template array<bigint>, slots array<bigint>")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.3, least: int = 3) -> DataFrame:
    """(id, url, text) for every page."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    named = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    # copies of a page say nothing about its template, and a null page has no tokens
    distinct = named.select("host", F.xxhash64("html").alias("page"), "html").dropDuplicates(["host", "page"])
    found = cut_lineage(templates(distinct, share, least))
    size = found.agg(F.sum(F.octet_length("host") + 8 * (F.size("template") + F.size("slots")) + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column("html"), batch.column("template"), batch.column("slots"), strict=True)
            texts = [Page(h.as_py() or "").main_text(set(t.as_py() or ()), set(s.as_py() or ())) for h, t, s in parts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return named.join(found, "host", "left").select("id", "url", "html", "template", "slots").mapInArrow(run, f"id {kind}, url string, text string")
