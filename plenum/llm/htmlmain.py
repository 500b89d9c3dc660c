"""Main text of web pages by consensus paths of each host.

1. Every page is cut into tags and text.  Menus, headers, footers, sidebars, notices, adverts, forms
   and reader comments are marked, by tag, role, or a class or id that is called so, ends so or is a known compound, and
   so are lists of links outside of articles.  A container's text is what it holds without the marked
   parts inside it; a mark around a container takes nothing from it.
2. A container's path is its chain of tags and classes from the body down, numbers generalised.
   Pages vote for paths: each container with a good share of its page's text scores by that share,
   with a premium for depth and for tags and classes that name an article, and with little weight
   inside a marked part.  Spark sums the votes by host and path and takes the path with most votes.
3. Every page is cut again and yields the text of its containers with the host's path.  A page that
   has none of them, or whose host is unknown, yields that of its own best container; so does one
   whose best container holds these containers and twice their text, for they are only parts of it.

Scripts, styles and markup are no text.  Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by a space in page order; nothing else is dropped or
capped.

Defined results: null and empty pages have an empty text; pages without ``://`` in the url form no
host; a tag that is never closed ends with what holds it; of paths with equal votes the longest
counts, then the last by name; repeated pages vote and are extracted once each; empty tables give
empty results; further columns are passed on, less any named text or n_chars; pages may be of any
length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plenum.llm.common import ascii_lower, fresh, materialize

#: A page's vote for a path is its score by the best one's to this power: what holds every page's text, the body, gets no full vote from any.
VOTE_POWER = 16
#: Hosts and bytes of winning paths up to which the join may broadcast them.
BROADCAST_BYTES = 32 << 20

# HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div figure main section table tbody td tr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog dir fieldset footer form head header iframe input label menu nav object select video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disclaimer disqus feedback footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Of these the names that also begin what they mean, if only the words below follow: comment-list is for comments, but
#: social-issues is a subject and sidebar-right may be a layout.
DROPPED_STARTS = frozenset(
    "ad ads adv advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus menu nav navbar newsletter pagination popup promo promoted related replies reply respond share sharing social sponsor sponsored subscribe widget".split()
)
PART_WORDS = frozenset(
    "area articles bar block bottom box button buttons column container content count desktop feed form group holder icon icons inner item items label left link links list mobile module outer panel post posts right row section slot space stories thread top unit wrap wrapper zone".split()
)
ARTICLE_WORDS = frozenset("article articlebody body content entry main page post story text".split())
#: An open element that a start tag of the key ends, if nothing of the second set is in between.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")


def _names_a_drop(name: str, own_header: bool) -> bool:
    """Whether a class or id names what isn't main text; an article's own header is part of it."""
    parts = _WORD.findall(name)
    if not parts or own_header and parts[-1] == "header":
        return False
    return parts[-1] in DROPPED_WORDS or parts[0] in DROPPED_STARTS and all(p in PART_WORDS or p in DROPPED_WORDS for p in parts[1:])


class Page:
    """A page's containers, marked parts and pieces of text, in page order.

    containers: (path, depth, first piece, piece after the last, premium, whether inside a marked part); marks: (first piece, piece
    after the last); pieces: decoded text, with a space at each block boundary.
    """

    def __init__(self, html: str):
        self.pieces: list[str] = []
        self.containers: list[tuple[str, int, int, int, float, bool]] = []
        self.marks: list[tuple[int, int]] = []
        #: open elements: tag, path of the container it is or is in, container's depth, first piece, whether it is marked, premium or None
        self._open: list[tuple] = [("", "", 0, 0, False, None)]
        self._inside = [0, 0]  # open marked elements, open elements that name an article
        self._lists: list[list[int]] = []  # open lists: first piece, characters in links, links
        self._in_link = 0
        self._read(html)
        while len(self._open) > 1:
            self._pop()
        self.containers.append(("", 0, 0, len(self.pieces), 0.0, False))
        self.marks.sort(key=lambda m: (m[0], -m[1]))
        covered, self._upto, self._open_upto = [0] * (len(self.pieces) + 1), [0], [0]
        for first, end in self.marks:
            covered[first] += 1
            covered[end] -= 1
        depth = 0
        for x, step in zip(self.pieces, covered):
            depth += step
            size = len(x.strip())
            self._upto.append(self._upto[-1] + size)
            self._open_upto.append(self._open_upto[-1] + (0 if depth else size))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else n
            else:
                self._start(tag, m[3])

    def _text(self, raw: str) -> None:
        self.pieces.append(text := unescape(raw))
        if self._in_link and self._lists:
            self._lists[-1][1] += len(text.strip())

    def _start(self, tag: str, attributes: str) -> None:
        if ends := CLOSES.get(tag):
            scope = SCOPE.get(tag, CONTAINER)
            for i in range(len(self._open) - 1, 0, -1):
                if self._open[i][0] in ends:
                    while len(self._open) > i:
                        self._pop()
                    break
                if self._open[i][0] in scope:
                    break
        if tag == "br" or tag in BLOCK:
            self.pieces.append(" ")
        if tag in VOID:
            return
        _, path, depth, _, _, _ = self._open[-1]
        said: dict[str, str] = {}
        if attributes:
            for a in _ATTR.finditer(attributes):
                said.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        names = [c.lower() for c in said.get("class", "").split()]
        named, role = [*names, said.get("id", "").lower()], said.get("role", "").lower()
        in_article = self._inside[1] > 0
        marked = False
        if tag not in ("html", "body", "main"):
            own_header = in_article and tag not in ("nav", "aside", "form")
            marked = any(_names_a_drop(x, own_header) for x in named)
            if tag != "article":
                marked = marked or tag in DROPPED and not (tag == "header" and in_article) or role in DROPPED_ROLES
        premium = None
        if tag in CONTAINER:
            path = f"{path}>{tag}" + "".join(f".{_NUMBER.sub('#', c)}" for c in sorted(set(names)))
            depth += 1
            of_article = tag in ("article", "main") or role == "main" or tag != "body" and any(set(_WORD.findall(x)) & ARTICLE_WORDS for x in named)
            premium = 0.25 if of_article and not marked else 0.0
        self._inside[0] += marked
        self._inside[1] += bool(premium)
        self._open.append((tag, path, depth, len(self.pieces), marked, premium))
        if tag == "a":
            self._in_link += 1
            if self._lists:
                self._lists[-1][2] += 1
        elif tag in ("ul", "ol"):
            self._lists.append([len(self.pieces), 0, 0])

    def _end(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if tag not in BLOCK and self._open[i][0] in CONTAINER:
                return

    def _pop(self) -> None:
        tag, path, depth, first, marked, premium = self._open.pop()
        if tag == "a":
            self._in_link -= 1
        elif tag in ("ul", "ol") and self._lists:
            start, linked, links = self._lists.pop()
            if links > 2 and not self._inside[1] and linked >= 0.8 * sum(len(x.strip()) for x in self.pieces[start:]):
                self.marks.append((start, len(self.pieces)))  # a menu
        if marked:
            self.marks.append((first, len(self.pieces)))
        self._inside[0] -= marked
        self._inside[1] -= bool(premium)
        if tag in BLOCK:
            self.pieces.append(" ")
        if premium is not None:
            self.containers.append((path, depth, first, len(self.pieces), premium, self._inside[0] + marked > 0))

    def _kept(self, first: int, end: int) -> list[tuple[int, int]]:
        """The runs of pieces from ``first`` to ``end`` outside of the marks inside them."""
        runs, at = [], first
        for i in range(bisect_left(self.marks, (first, -len(self.pieces)), key=lambda m: (m[0], -m[1])), len(self.marks)):
            a, b = self.marks[i]
            if a >= end:
                break
            if a == first and b >= end - 1:  # the container's own
                continue
            if a > at:
                runs.append((at, a))
            at = max(at, b)
        return [*runs, (at, end)] if at < end else runs

    def _held(self, first: int, end: int, inside: bool) -> int:
        """Characters of a container outside of marked parts; all of them if it is inside one itself."""
        upto = self._upto if inside else self._open_upto
        return upto[end] - upto[first]

    def scores(self) -> dict[str, float]:
        """Path -> score of the page's containers that hold a third as much text as the best, or more; none for a page without text."""
        held: dict[str, list[float]] = {}
        for path, depth, first, end, premium, inside in self.containers:
            x = held.setdefault(path, [0.0, depth, premium])
            x[0] += self._held(first, end, inside) * (0.1 if inside else 1.0)
            x[2] = max(x[2], premium)
        most = max((h for h, _, _ in held.values()), default=0.0)
        return {p: (h / most) * (1 + 0.05 * d + m) for p, (h, d, m) in held.items() if most and h >= most / 3}

    def _spans(self, path: str) -> list[tuple[int, int, bool]]:
        """Where the containers with this path are, those inside others apart, and whether they are in a marked part."""
        spans: list[tuple[int, int, bool]] = []
        for first, end, inside in sorted((c[2], -c[3], c[5]) for c in self.containers if c[0] == path):
            if not spans or -end > spans[-1][1]:
                spans.append((first, -end, inside))
        return spans

    def text(self, path: str) -> str | None:
        """The text of the containers with this path; None without any."""
        spans = self._spans(path)
        if not spans:
            return None
        return " ".join(" ".join("".join(self.pieces[a:b]) for first, end, _ in spans for a, b in self._kept(first, end)).split())

    def is_part(self, path: str, best: str) -> bool:
        """Whether the containers with this path are inside those of the best one, which hold twice their text."""
        parts, wholes = self._spans(path), self._spans(best)
        inside, i = True, 0
        for first, end, _ in parts:  # both are in page order
            while i < len(wholes) and wholes[i][1] < end:
                i += 1
            inside = inside and i < len(wholes) and wholes[i][0] <= first
        return inside and 2 * sum(self._held(*s) for s in parts) < sum(self._held(*s) for s in wholes)


def best_path(scores: dict[str, float]) -> str:
    """The path with the highest score; of equals the longest, then the first by name."""
    return min(scores, key=lambda p: (-scores[p], -len(p), p), default="")


def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, html) -> (host, path, votes), summed over each batch."""
    for frame in frames:
        said: dict[tuple[str, str], float] = {}
        for host, html in zip(frame["host"], frame["html"]):
            scores = Page(html or "").scores()
            most = max(scores.values(), default=1.0)
            for path, score in scores.items():
                said[host, path] = said.get((host, path), 0.0) + (score / most) ** VOTE_POWER
        yield pd.DataFrame([(h, p, v) for (h, p), v in said.items()], columns=["host", "path", "votes"])


def page_text(html: str | None, path: str | None) -> str:
    """The text at the host's path, or else at the page's own best."""
    page = Page(html or "")
    best = best_path(page.scores())
    if path is None or not page._spans(path) or page.is_part(path, best):
        path = best
    return page.text(path) or ""


@F.pandas_udf(StringType())
def main_text(htmls: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([page_text(h, p) for h, p in zip(htmls, paths)], dtype="object")


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host."""
    host = ascii_lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)://([^/?#]+)", 1))
    named = pages.select(host.alias("host"), F.col(html).alias("html")).where("host <> ''")
    counted = named.mapInPandas(votes, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    best = F.max(F.struct("votes", F.length("path").alias("n"), "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", F.col("best.path").alias("path"))


def extract_main(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""
    paths = materialize(host_paths(pages, url, html), "host-paths")
    host, path = fresh(pages, "host_of"), fresh(pages, "path_of")
    paths = paths.select(F.col("host").alias(host), F.col("path").alias(path))
    size = paths.agg(F.sum(F.length(host) + F.length(path) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        paths = F.broadcast(paths)
    plain = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c not in (url, html)])
    asked = plain.withColumn(host, ascii_lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)://([^/?#]+)", 1)))
    found = asked.join(paths, host, "left").withColumn("text", main_text(F.col(html), F.col(path)))
    return found.select(*plain.columns, "text", F.length("text").cast("long").alias("n_chars"))
