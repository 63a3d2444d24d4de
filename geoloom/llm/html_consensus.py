"""Main text of web pages, by the container paths that a host's pages agree on.

Each page's containers are scored by the share of the page's good text that
they hold: text outside of menus, headers, footers, side bars, notices,
adverts, forms and comments, and outside of links. A container's path is the
chain of its tags and classes, with digits generalised, and is known by its
hash. Spark adds up the scores by host and path; the best path of a host is the
one its pages' text is taken from. A page that has no such container, or less
than half of its good text in it, uses its own best one.

Class words are a prior only: an element that they mark is kept after all if it
wraps the page's article or nearly all of its text, and inline elements are
left out only where they are hidden. A name of which one word is such a word and
others aren't (``related-story``) decides nothing by itself: the element is left
out if half of its text is links, or half of the host's pages have the same text
in such an element.

Defined results for odd input: null and empty html give an empty text; markup
that is not well formed is read leniently, in time and memory in proportion to
the page (unclosed elements end with their parent, a tag without an end is
text, a quote without its pair is a letter); character references are decoded
text node by text node; a url without a host belongs to the host ''. Of equal
scores the deeper path wins, then the greater hash. Repeated rows are kept and
vote again, columns other than page_id, url and html are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, temporary

ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav header footer aside script style noscript iframe svg button select textarea template object canvas audio video menu dialog fieldset title head math".split())
#: Words of a class, id or role that mark what isn't main text.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead footer foot sidebar side aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search form "
    "share sharing social related recommended recommendations tags pagination pager toolbar skip complementary contentinfo hidden".split()
)
#: Words that mark reader comments.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that say nothing about what a marked element holds.
PLAIN = frozenset(
    "site page main global top bottom left right upper lower inner outer wrap wrapper container box bar block area section panel list item items link links icon icons button buttons btn "
    "text content body posts articles stories news primary secondary mobile desktop sticky fixed floating mini small large user users thread".split()
)
WORDS = re.compile(r"[\s_-]+")
#: Names that tell what an element has beside it, or lacks.
LACKED = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|not)[-_]\S+", re.I)
#: How an element is marked: not at all, by one word of a longer name, by a name or as a form, as reader comments, for good.
FREE, MAYBE, MARKED, REMARKS, OUT = range(5)
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that an element ends if they are open within the nearest of the others.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Elements that are too small to be voted on.
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li ul ol td tr".split())
DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
#: Containers that hold this share of a page's good text are voted on.
LEAST_SHARE = 0.5
#: A marked element with this share of all text is the page's own frame.
FRAME_SHARE = 0.9


#: Depths that stand for other votes: digests of texts, and pages.
TEXTS, PAGES = -1, -2


class Element:
    """A container: its tag and path, how it is marked, and where its text pieces begin and end."""

    __slots__ = ("tag", "path", "depth", "mark", "begin", "end", "parent", "dropped")

    def __init__(self, tag: str, path: str, depth: int, mark: int, begin: int, parent: Element | None):
        self.tag, self.path, self.depth, self.mark, self.begin, self.parent = tag, path, depth, mark, begin, parent
        self.end, self.dropped = begin, False


def tokens(html: str):
    """``(text, tag, is an end, attributes)`` of each run of text and the tag after it, in one pass."""
    at, text, n = 0, 0, len(html)
    last, unpaired = html.rfind(">"), set()
    while (i := html.find("<", at)) >= 0:
        after = html[i + 1 : i + 2]
        if i > last:  # no tag can end any more
            break
        if after in ("!", "?"):
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                end = n if end < 0 else end + 3
            else:
                end = html.find(">", i) + 1
            yield html[text:i], "", False, ""
            at = text = end
            continue
        close = after == "/"
        m = NAME.match(html, i + 1 + close)
        if not m:
            at = i + 1
            continue
        name, end = m[0].lower(), m.end()
        if close:
            stop = html.find(">", end)
        else:
            stop = _tag_end(html, end, last, unpaired)
        raw = name in RAW
        yield html[text:i], "" if raw else name, close, html[end:stop]
        at = text = stop + 1
        if raw and not close:  # what it holds and its end tag are left out
            m = re.compile(f"</{name}\\s*>", re.I).search(html, at)
            at = text = m.end() if m else n
    yield html[text:], "", False, ""


def _tag_end(html: str, at: int, last: int, unpaired: set[str]) -> int:
    """Where a tag ends: at the first ``>`` outside of quotes, or the first at all if there is no other."""
    begin = at
    while at <= last:
        m = STOP.search(html, at)
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] not in unpaired:
            pair = html.find(m[0], at)
            if pair < 0:
                unpaired.add(m[0])
            else:
                at = pair + 1
    return html.find(">", begin)


def _described(tag: str, attributes: str) -> tuple[str, int]:
    """Generalised classes of an element, and how it is marked."""
    classes, mark = "", OUT if tag in DROPPED else MARKED if tag == "form" else FREE
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "class":
            classes = "".join(f".{c}" for c in sorted(set(DIGITS.sub("#", value.lower()).split())))
        if name in ("class", "id", "role"):
            mark = max(mark, _named(LACKED.sub(" ", value.lower())))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            mark = OUT
    return classes, mark


@lru_cache(maxsize=1 << 14)
def _named(value: str) -> int:
    """How the names of a class, id or role mark an element.

    A name counts if all of its words are chrome or plain; one chrome word beside
    others, as in ``social-history``, leaves it to the element's text.
    """
    mark = FREE
    for name in value.split():
        words = [DIGITS.sub("", w) for w in WORDS.split(name)]
        words = {w for w in words if w}
        told = words & CHROME, words & COMMENTS
        if any(told):
            whole = words <= CHROME | COMMENTS | PLAIN
            mark = max(mark, MAYBE if not whole else REMARKS if told[1] else MARKED)
    return mark


class Page:
    """Text pieces of a page in order, with the element and links they stand in, and its elements, parents first.

    A piece that is a single blank separates blocks. ``repeated`` are digests of
    texts that most of the host's pages have in an element that may be marked.
    """

    def __init__(self, html: str | None, repeated=()):
        self.repeated = frozenset(repeated)
        self.texts: list[str] = []
        self.owners: list[Element] = []
        self.linked: list[bool] = []
        self.root = Element("", "", 0, FREE, 0, None)
        self.elements = [self.root]
        self._open = [self.root]
        self._blocks = [0]  # places of open elements that aren't inline
        self._places: dict[str, list[int]] = {}
        for text, tag, end, attributes in tokens(html or ""):
            if text:
                self._put(entities.unescape(text))
            if not tag:
                continue
            if end:
                self._end(tag)
            elif tag in VOID:
                if tag not in INLINE:
                    self._put(" ")
            else:
                self._begin(tag, attributes)
        self._close(0)
        self._settle()

    def _put(self, text: str) -> None:
        self.texts.append(text)
        self.owners.append(self._open[-1])
        self.linked.append(bool(self._places.get("a")))

    def _close(self, down_to: int) -> None:
        while len(self._open) > down_to:
            e = self._open.pop()
            e.end = len(self.texts)
            if not self._open:
                break
            self._places[e.tag].pop()
            if e.tag not in INLINE:
                self._blocks.pop()
                self._put(" ")

    def _nearest(self, tags) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _end(self, tag: str) -> None:
        at = self._nearest((tag,))
        if at and (tag not in INLINE or self._blocks[-1] < at):
            self._close(at)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            if self._open[self._blocks[-1]].tag == "p":
                self._close(self._blocks[-1])
        elif tag in SIBLINGS:
            ended, until = SIBLINGS[tag]
            while (at := self._nearest(ended)) > self._nearest(until):
                self._close(at)
        parent = self._open[-1]
        inline = tag in INLINE
        classes, mark = _described(tag, attributes) if attributes else ("", OUT if tag in DROPPED else MARKED if tag == "form" else FREE)
        if inline:
            e = Element(tag, parent.path, parent.depth, OUT if mark == OUT else FREE, len(self.texts), parent)
        else:
            self._put(" ")
            # a page's own frame is never outside the main text as a whole
            mark = FREE if tag in ("html", "body", "article", "main") and mark != OUT else mark
            e = Element(tag, xxhash.xxh64_hexdigest(f"{parent.path}>{tag}{classes}"), parent.depth + 1, mark, len(self.texts), parent)
            self._blocks.append(len(self._open))
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(e)
        self.elements.append(e)
        if attributes.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            self._close(len(self._open) - 1)

    def _settle(self) -> None:
        """Decide which elements are dropped, and count the good characters up to each piece."""
        out = self._within(lambda e: e.mark == OUT)
        remarks = self._within(lambda e: e.mark == REMARKS)
        size, own = [0], [0]  # characters before each piece: all, and those outside of comments
        for text, owner in zip(self.texts, self.owners):
            n = 0 if out[owner] else len(text) - text.count(" ")
            size.append(size[-1] + n)
            own.append(own[-1] + (0 if remarks[owner] else n))
        begins = sorted(e.begin for e in self.elements if e.tag in ("article", "main", "h1") and not out[e])
        for e in self.elements:
            if e.mark in (MARKED, REMARKS):
                count = own if e.mark == MARKED else size
                share = (count[e.end] - count[e.begin]) / max(1, count[-1])
                holds = _between(begins, e.begin, e.end)
                # comments may be longer than the article, so they need more
                if share >= FRAME_SHARE and (holds or e.mark == MARKED) or share >= LEAST_SHARE and holds and e.mark == MARKED:
                    e.mark = FREE
        self.maybe = {e: self._digest(e) for e in self.elements if e.mark == MAYBE and not out[e]}
        linked = [0]
        for text, owner, link in zip(self.texts, self.owners, self.linked):
            linked.append(linked[-1] + (len(text) - text.count(" ") if link and not out[owner] else 0))
        for e, digest in self.maybe.items():
            links = linked[e.end] - linked[e.begin]
            if links < LEAST_SHARE * (size[e.end] - size[e.begin]) and digest not in self.repeated:
                e.mark = FREE
        dropped = self._within(lambda e: e.mark != FREE)
        if own[-1] and all(dropped[o] or not t.strip() for t, o in zip(self.texts, self.owners)):
            # nothing is left: class words count for nothing on this page
            dropped = self._within(lambda e: e.mark in (REMARKS, OUT))
        for e in self.elements:
            e.dropped = dropped[e]
        self.good = [0]
        for text, owner, link in zip(self.texts, self.owners, self.linked):
            self.good.append(self.good[-1] + (0 if owner.dropped or link or text == " " else len(text) - text.count(" ")))

    def _digest(self, e: Element) -> str:
        return xxhash.xxh64_hexdigest(" ".join("".join(self.texts[e.begin : e.end]).split()))

    def _within(self, test) -> dict[Element, bool]:
        """Whether each element, or one around it, passes the test."""
        found: dict[Element, bool] = {}
        for e in self.elements:
            found[e] = test(e) or e.parent is not None and found[e.parent]
        return found

    def votes(self) -> list[tuple[str, int, float]]:
        """Paths of the page's containers, their depths and scores."""
        if not self.good[-1]:
            return []
        shares: dict[tuple[str, int], float] = {}
        for e in self.elements:
            if not e.dropped and e.tag not in INLINE and e.tag not in SMALL:
                share = (self.good[e.end] - self.good[e.begin]) / self.good[-1]
                if share > 0:
                    shares[e.path, e.depth] = shares.get((e.path, e.depth), 0) + share
        # containers of one path count together
        return [(path, depth, min(s, 1.0)) for (path, depth), s in shares.items() if s >= LEAST_SHARE]

    def spans(self, path: str | None) -> list[tuple[int, int]]:
        """Where the outermost containers with the path lie."""
        out: list[tuple[int, int]] = []
        for a, b in sorted((e.begin, e.end) for e in self.elements if e.path == path and not e.dropped and e.tag not in INLINE):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def text(self, spans: list[tuple[int, int]]) -> str:
        parts = []
        for a, b in spans:
            parts.append(" ")
            parts += [t for t, owner in zip(self.texts[a:b], self.owners[a:b]) if not owner.dropped]
        return " ".join("".join(parts).split())


def _between(sorted_: list[int], low: int, high: int) -> bool:
    at = bisect_left(sorted_, low)
    return at < len(sorted_) and sorted_[at] <= high


def extract(html: str | None, path: str | None, repeated=()) -> str:
    """Text of the containers with the path, or of the page's own best container."""
    page = Page(html, repeated)
    spans = page.spans(path) if path is not None else []
    # the host's path may be another template's
    little = sum(page.good[b] - page.good[a] for a, b in spans) < LEAST_SHARE * page.good[-1]
    if little or not (text := page.text(spans)):
        own = max(page.votes(), key=lambda v: (v[2], v[1], v[0]), default=None)
        text = page.text([(0, len(page.texts))] if own is None else page.spans(own[0]))
    return text


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host``, its winning ``path`` and the digests ``repeated``: texts of half of its pages, three at least, in elements that may be marked.

    A host has no more of those than twice such elements a page.
    """

    def run(batches):
        for batch in batches:
            rows: dict[tuple[str, str, int], float] = {}
            for h, html in zip(batch["host"], batch["html"]):
                page = Page(html)
                votes = page.votes() + [(digest, TEXTS, 1.0) for digest in set(page.maybe.values())] + [("", PAGES, 1.0)]
                for path, depth, score in votes:
                    rows[h, path, depth] = rows.get((h, path, depth), 0.0) + score
            yield pd.DataFrame([(*k, s) for k, s in rows.items()], columns=["host", "path", "depth", "score"])

    scored = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInPandas(run, "host string, path string, depth int, score double")
    # sums of floats depend on their order: whole millionths don't
    sums = scored.withColumn("score", F.round(F.col("score") * 1e6).cast("bigint")).groupBy("host", "path", "depth").agg(F.sum("score").alias("score"))
    sums = staged(sums, "host-votes")
    least = F.greatest(F.col("score") * LEAST_SHARE, F.lit(3_000_000)).alias("least")
    often = sums.where(F.col("depth") == TEXTS).join(sums.where(F.col("depth") == PAGES).select("host", least), "host").where("score >= least")
    best = sums.where("depth >= 0").groupBy("host").agg(F.max(F.struct("score", "depth", "path")).alias("best")).select("host", "best.path")
    often = often.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("repeated"))
    return best.join(often, "host", "full_outer")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    keyed = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    @F.pandas_udf("string")
    def text(html: pd.Series, path: pd.Series, repeated: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p, () if r is None else r) for h, p, r in zip(html, path, repeated)])

    # as a table its size is known: while it is small the pages aren't shuffled
    with temporary():
        paths = staged(host_paths(pages), "host-paths", kept=True)
    return keyed.join(paths, "host", "left").select("page_id", "url", text("html", "path", "repeated").alias("text"))


def op4_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op4_html_consensus": op4_html_consensus}
