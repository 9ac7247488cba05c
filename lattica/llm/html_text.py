"""Main text of web pages by consensus of host paths.

Each page's containers are scored by the running text they hold. Pages vote, with their scores, for
generalised tag-class paths (digits dropped); votes are added up by host in Spark. Each page is then
extracted again from the containers on its host's winning path, or from its own best container where
it has none on that path.

Pages are read by a scanner that looks at every character a bounded number of times, whatever the
page holds; elements nest at most ``DEPTH`` deep, as in browsers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import extended, fresh, lean, materialise, table

#: Winning paths of this many hosts (some 50 bytes each) are broadcast; more are joined by a shuffle of urls' hosts, without the pages.
BROADCAST_HOSTS = 1_000_000
#: Elements that would be nested deeper become siblings of the deepest.
DEPTH = 512

# Fixed values of the HTML standard and names in common use.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object".split())
_CONTAINERS = frozenset("article body center div form main section td".split())
_DROPPED = frozenset("nav header footer aside dialog menu head noscript template svg math button select textarea option optgroup datalist label legend audio video canvas map frameset".split())
#: Their content is no markup. An end tag that is missing ends a script or style with the page; the others are then empty.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Controls that end where a block begins, if nobody has ended them.
_CONTROLS = frozenset("button select option optgroup label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Pieces of class and id names. Elements with one of these go.
_DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner comment comments consent cookie cookies copyright disqus footer gdpr masthead modal nav navbar navigation newsletter notice "
    "popup promo replies respond sidebar sponsor sponsored subscribe widget".split()
)
#: Elements with one of these go unless most of their text is running text, as that of a section on related work is.
_UNLESS_PROSE = frozenset("breadcrumb breadcrumbs header login menu pager pagination related search share sharing social toolbar".split())
#: Blocks of so many characters and without links are running text.
PROSE = 80
_CLOSES = {
    "p": frozenset(("p",)),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
_SCOPE = {"p": frozenset("article section div form main body td th li table blockquote object".split()), "li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset()}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_WHOLE = frozenset(("body", "html", "article", "main", *_HEADINGS))

_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
#: The usual form of attributes; what it tries ends at the next < or >, so that no page makes it slow.
_USUAL = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z-]+="[^"<>]*")+)>')
_USUAL_ATTRIBUTE = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_PIECE = re.compile(r"[a-z]+")
_WANTED = frozenset("class id role style hidden aria-hidden itemprop".split())

_KEEP, _DROP, _MAYBE, _FORM = range(4)


class Scanner:
    """Pieces of a page in order: (text, "", None, False), or ("", tag, attributes, whether it ends) with attributes None for none."""

    def __init__(self, source: str):
        self.source, self.absent = source, set()

    def _find(self, what: str, at: int) -> int:
        """Like str.find; what once was not found to the end of the page isn't sought again."""
        if what in self.absent:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _end_tag(self, tag: str, at: int) -> int:
        if f"</{tag}" in self.absent:
            return -1
        m = _RAW_END[tag].search(self.source, at)
        if m is None:
            self.absent.add(f"</{tag}")
        return m.start() if m else -1

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Those that matter, the place behind the tag (-1: the page ends in it) and whether a slash ends it."""
        source, size, found = self.source, len(self.source), []
        while True:
            gap = _GAP.match(source, at)
            at = gap.end()
            if at >= size:
                return found, -1, False
            if source[at] == ">":
                return found, at + 1, gap.end() > gap.start() and source[at - 1] == "/"
            m = _ATTRIBUTE.match(source, at)
            name, value, at = m[0].lower(), "", m.end()
            eq = _EQUALS.match(source, at)
            if eq:
                at = eq.end()
                if at < size and source[at] in "\"'":
                    close = self._find(source[at], at + 1)
                    if close < 0:  # a quote that nobody closes is a letter
                        m = _BARE.match(source, at)
                        value, at = m[0], m.end()
                    else:
                        value, at = source[at + 1 : close], close + 1
                else:
                    m = _BARE.match(source, at)
                    value, at = m[0], m.end()
            if name in _WANTED:
                found.append((name, value))

    def __iter__(self) -> Iterator[tuple[str, str, list[tuple[str, str]] | None, bool]]:
        source, size, at, said = self.source, len(self.source), 0, 0
        while True:
            at = source.find("<", at)
            if at < 0:
                break
            plain = _PLAIN.match(source, at)
            if plain:
                if at > said:
                    yield source[said:at], "", None, False
                tag, at = plain[2].lower(), plain.end()
                yield "", tag, None, bool(plain[1])
                if tag in _RAW and not plain[1]:
                    at = yield from self._raw(tag, at)
                said = at
                continue
            usual = _USUAL.match(source, at)
            if usual:
                if at > said:
                    yield source[said:at], "", None, False
                tag, at = usual[1].lower(), usual.end()
                yield "", tag, [x for x in _USUAL_ATTRIBUTE.findall(usual[2].lower()) if x[0] in _WANTED], False
                if tag in _RAW:
                    at = yield from self._raw(tag, at)
                said = at
                continue
            c = source[at + 1 : at + 2]
            if c in ("!", "?") and c:
                if at > said:
                    yield source[said:at], "", None, False
                if source.startswith("<!--", at):
                    end = at + 5 if source.startswith("<!-->", at) else self._find("-->", at + 4) + 3
                    end = size if end == 2 else end
                elif source.startswith("<![CDATA[", at):
                    end = self._find("]]>", at)
                    yield source[at + 9 : end if end >= 0 else size], "", None, False
                    end = size if end < 0 else end + 3
                else:
                    end = self._find(">", at) + 1 or size
                at = said = end
                continue
            closing = c == "/"
            first = source[at + 1 + closing : at + 2 + closing]
            if not (first.isascii() and first.isalpha()):
                if closing and first:  # browsers take </ and anything else for a comment
                    if at > said:
                        yield source[said:at], "", None, False
                    at = said = self._find(">", at) + 1 or size
                else:
                    at += 1  # a sign, no tag
                continue
            if at > said:
                yield source[said:at], "", None, False
            m = _NAME.match(source, at + 1 + closing)
            tag = m[0].lower()
            attributes, end, slash = self._attributes(m.end())
            if end < 0:
                return  # the page ends within a tag
            at = said = end
            yield "", tag, attributes, closing
            if slash and tag not in _CONTAINERS and not closing:
                yield "", tag, None, True
            elif tag in _RAW and not closing:
                at = said = yield from self._raw(tag, at)
        if said < size:
            yield source[said:], "", None, False

    def _raw(self, tag: str, at: int) -> Generator[tuple[str, str, None, bool], None, int]:
        """The place of the end tag; an element without one ends at once, or with the page."""
        end = self._end_tag(tag, at)
        if end < 0 and tag not in ("script", "style"):
            yield "", tag, None, True
            return at
        return len(self.source) if end < 0 else end


class Page:
    """The elements of a page and its blocks of text outside dropped elements."""

    def __init__(self, source: str):
        self.tags, self.parents, self.paths, self.good = ["#"], [-1], [0], [0]
        self.state, self.dropped, self.in_link, self.block = [_KEEP], [False], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters in links
        self._read(source)
        self._decide()

    def _read(self, source: str) -> None:
        stack, open_ = [0], Counter()
        parts: list[str] = []
        owner, links = 0, 0
        tags, dropped = self.tags, self.dropped

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((owner, text, links))
                parts.clear()
            links = 0

        def pop() -> str:
            tag = tags[stack.pop()]
            open_[tag] -= 1
            return tag

        for piece, tag, attributes, ends in Scanner(source):
            if not tag:
                if not dropped[stack[-1]]:
                    text = html.unescape(piece) if "&" in piece else piece
                    if not parts:
                        owner = self.block[stack[-1]]
                    parts.append(text)
                    if self.in_link[stack[-1]]:
                        links += len(text)
                continue
            if tag == "br":
                if parts:
                    parts.append(" ")
                continue
            if tag not in _INLINE:
                flush()
            if tag in _VOID or (tag == "form" and open_[tag] and not ends):  # a form holds no other
                continue
            if ends:
                if open_[tag]:
                    while pop() != tag:
                        pass
                continue
            if tag not in _INLINE and tag not in _CONTROLS and tag not in _VOID:
                while tags[stack[-1]] in _CONTROLS:
                    pop()
            self._close(stack, open_, tag, pop)
            if len(stack) >= DEPTH:
                pop()
            self._open(stack, tag, attributes)
            open_[tag] += 1
        flush()

    def _close(self, stack: list[int], open_: Counter, tag: str, pop) -> None:
        """End what a new element ends by itself, up to the element that bounds it."""
        ends = _CLOSES.get(tag) or (_CLOSES["p"] if tag not in _INLINE else None)
        if not ends or not any(open_[x] for x in ends):
            return
        scope, tags = _SCOPE.get(tag, _SCOPE["p"]), self.tags
        k = len(stack) - 1
        while k > 0:
            name = tags[stack[k]]
            if name in ends:
                while len(stack) > k:
                    pop()
                if tag not in _CLOSES or tag == "p":
                    return
            elif name in scope:
                return
            k -= 1

    def _open(self, stack: list[int], tag: str, attributes: list[tuple[str, str]] | None) -> None:
        up = stack[-1]
        names: list[str] = []
        state, good = _DROP if tag in _DROPPED or tag in _RAW else _FORM if tag == "form" else _KEEP, tag == "article" or tag == "main"
        for name, value in attributes or ():
            value = value.lower()
            if name in ("class", "id"):
                pieces = _PIECE.findall(value)
                if name == "class":
                    names = pieces
                if tag not in _WHOLE and state != _DROP:
                    if any(p in _DROPPED_NAMES for p in pieces):
                        state = _DROP
                    elif any(p in _UNLESS_PROSE for p in pieces):
                        state = _MAYBE
                good = good or any(p in ("content", "post", "entry", "story") for p in pieces)
            elif name == "role":
                state = _DROP if value in _ROLES and tag not in _WHOLE else state
                good = good or value in ("main", "article")
            elif name == "style":
                state = _DROP if "display:none" in value.replace(" ", "") else state
            elif name == "aria-hidden":
                state = _DROP if value == "true" else state
            elif name == "hidden":
                state = _DROP
            else:
                good = good or value == "articlebody"
        nr = len(self.tags)
        self.tags.append(tag)
        self.parents.append(up)
        step = ".".join((tag, *sorted(set(names))))
        #: A path is the hash of the steps from the root.
        self.paths.append(xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), self.paths[up]) if tag not in _INLINE else self.paths[up])
        self.good.append(2 if tag == "article" else int(good))
        self.state.append(state)
        self.dropped.append(self.dropped[up] or state == _DROP)
        self.in_link.append(self.in_link[up] or tag == "a")
        self.block.append(self.block[up] if tag in _INLINE else nr)
        stack.append(nr)

    def _decide(self) -> None:
        """Settle the elements that go unless they hold running text: named ones by their own text, forms by the page's."""
        asked = {n for n, s in enumerate(self.state) if s in (_MAYBE, _FORM)}
        if not asked:
            return
        total, prose = [0] * len(self.tags), [0] * len(self.tags)
        for owner, text, links in self.blocks:
            total[owner] += len(text)
            prose[owner] += len(text) if len(text) >= PROSE and not links else 0
        for n in range(len(self.tags) - 1, 0, -1):  # parents come first
            total[self.parents[n]] += total[n]
            prose[self.parents[n]] += prose[n]
        # a form with most of the page's running text is no form but the page
        gone = {n for n in asked if 2 * prose[n] < (total[n] if self.state[n] == _MAYBE else max(1, prose[0]))}
        for n in range(1, len(self.tags)):
            self.dropped[n] = self.dropped[n] or self.dropped[self.parents[n]] or n in gone
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def scores(self) -> dict[int, float]:
        """Characters of running text of each container: of its own blocks in full, of those further in by half a level."""
        found: dict[int, float] = {}
        for owner, text, links in self.blocks:
            weight = max(0, len(text) - 2 * links)
            n = owner
            if self.tags[n] not in _CONTAINERS:
                n = self.parents[n]
            while n > 0 and weight >= 1:
                if self.tags[n] in _CONTAINERS:
                    found[n] = found.get(n, 0.0) + weight
                    weight /= 2
                n = self.parents[n]
        return {n: s * (1 + self.good[n]) for n, s in found.items()}

    def best(self) -> int | None:
        found = self.scores()
        return max(found, key=lambda n: (found[n], -n), default=None)

    def on_path(self, path: int) -> list[int]:
        return [n for n, p in enumerate(self.paths) if p == path and self.tags[n] in _CONTAINERS and not self.dropped[n]]

    def text(self, roots: list[int]) -> str:
        """The blocks within these elements, in page order, by one newline."""
        inside = [False] * len(self.tags)
        chosen = set(roots)
        inside[0] = 0 in chosen
        for n in range(1, len(self.tags)):
            inside[n] = n in chosen or inside[self.parents[n]]
        return "\n".join(text for owner, text, _ in self.blocks if inside[owner])


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)://([^/?#]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: dict[tuple[str, int], int] = {}
        for host, source in zip(pdf["__host"], pdf["html"]):
            if source:
                page = Page(source)
                found = page.scores()
                top = max(found.values(), default=0)
                for path, s in {page.paths[n]: s for n, s in sorted(found.items(), key=lambda x: x[1])}.items():
                    if 2 * s >= top > 0:
                        rows[host, _signed(path)] = rows.get((host, _signed(path)), 0) + int(1000 * s / top)
        if rows:
            yield pd.DataFrame([(h, p, v) for (h, p), v in rows.items()], columns=["__host", "path", "votes"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """__host and __path, one row for each host. Votes are added up before the shuffle, so a hot host costs nothing; equal votes: the larger path."""
    votes = pages.select("__host", "html").mapInPandas(lean(_votes), "__host string, path bigint, votes bigint")
    added = votes.groupBy("__host", "path").agg(F.sum("votes").alias("votes"))
    return added.groupBy("__host").agg(F.max_by("path", F.struct("votes", "path")).alias("__path"))


def main_text(source: str | None, path: int | None) -> str:
    """The text within the containers on the path, else within the page's own best container, else all of it."""
    if not source:
        return ""
    page = Page(source)
    text = page.text(page.on_path(path % (1 << 64))) if path is not None else ""
    if not text and (best := page.best()) is not None:
        text = page.text([best])
    return text or page.text([0])


def extract(pages: DataFrame) -> DataFrame:
    """The input's columns but html, with text and n_chars.

    A null or empty html, and a page without text outside what is dropped, has the empty text. Null
    urls and urls without ``://`` share the empty host. Equal rows are extracted each by itself; paths
    of equal votes are settled by their hash. A long or hostile page costs time in proportion to its
    length. Input columns named text or n_chars are replaced. An empty table gives an empty result.
    """
    pages = fresh(pages, "text", "n_chars").withColumn("__host", host_of("url"))
    paths = materialise(winning_paths(pages), "paths")
    joined = pages.join(F.broadcast(paths), "__host", "left") if paths.count() <= BROADCAST_HOSTS else _by_url(pages, paths)

    def start():
        def work(sources: list[str | None], found: list[int | None]) -> dict[str, list]:
            texts = [main_text(*x) for x in zip(sources, found)]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return extended(joined, ["html", "__path"], start, "text string, n_chars bigint", drop=["html", "__host", "__path"])


def _by_url(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """More hosts than can be broadcast. A host's pages are dealt to 64 places, each with a copy of the host's row, so that a hot host is not one task's."""
    salt = F.pmod(F.xxhash64("url", F.length("html")), F.lit(64))
    copies = paths.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))))
    return pages.withColumn("__salt", salt).join(copies, ["__host", "__salt"], "left").drop("__salt")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
