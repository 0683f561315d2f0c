"""Operator 12 — main text of HTML pages by consensus host paths.

*Score.*  A page is read into blocks of text and the containers around them.  Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
go by their elements, roles and class words.  A container's score is the text
below it that is not mostly links; the page's candidate is reached from the
outside in, as long as one container inside holds ``SHARE`` of the score.
*Vote.*  Each page votes for the path of its candidate: tags with their class words
(or id), numbers and generated parts generalised.  Spark adds the votes up per host
and path and keeps the paths with a tenth of their host's votes, so ten a host at most.
*Extract.*  Every page is read again by its host's paths, the strongest first, so a page whose own
scores mislead (a short article, a long advert) follows its host.  A page that holds none of them,
or whose url names no host, falls back to its own candidate.

Pages meet the paths of their host by (host, salt); a host with a third of all
pages is thus dealt over ``SALTS`` keys, and votes are combined before their shuffle.

Defined results: a null html is empty and gives an empty text; unclosed tags, comments and
scripts end with the page; unclosed paragraphs, list items and cells end where the next begins;
repeated rows are pages of their own; ``n_chars`` counts code points; other columns are
ignored; an empty table gives no rows.  Headings and lists of an article belong to it;
a block that lists nothing but links (three or more in one element) is a menu.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.session import ship_package

#: share of a container's score that leads on to a container inside it
SHARE = 0.8
#: least share of a host's votes
SUPPORT = 0.1
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("div section article main table tbody thead tfoot tr td center form fieldset details".split())
#: elements that never hold an article's text
APART = frozenset("head nav header footer aside menu script style template noscript svg math iframe object applet "
                  "canvas audio video button select textarea datalist dialog title noframes noembed".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar".split())
#: words in a class or id that set an element apart
APART_WORDS = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored "
    "sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification "
    "notifications alert popup popover modal overlay lightbox newsletter subscribe subscription signup signin login "
    "register nav navbar navigation navigator menu menus submenu breadcrumb breadcrumbs crumbs pagination pager header "
    "masthead topbar toolbar footer colophon copyright sidebar sidebars aside rail widget widgets share sharing social "
    "related recommended recommendations similar comment comments commentlist disqus reply replies respond discussion "
    "form search skip tags tagcloud paywall outbrain taboola".split())
#: of these, words that wrappers of whole pages also carry: such an element stays if it holds main or article
WRAPPER_WORDS = frozenset("header nav navbar menu banner notice alert modal overlay login register form search promo "
                          "footer topbar toolbar widget skip paywall subscription".split())
#: with these a class tells of a page's layout, not of the element
LAYOUT_WORDS = frozenset("has no with without enabled disabled open closed".split())
#: a start tag that ends an open element of these, up to the given borders
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr"), "tfoot": ("tbody", "thead", "tr")}
BORDERS = frozenset("ul ol dl table select body".split())
CELLS = frozenset("table td th caption".split())
TABLE_TAGS = frozenset("table tbody thead tfoot tr td th".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)
        (?P<attrs>(?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+)*+)(?P<close>>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""", re.S | re.I | re.X)
ATTR = re.compile(r"""(?P<name>class|id|role|hidden|aria-hidden|style)(?![^\s/>=])
    (?:\s*+=\s*+(?:"(?P<a>[^"]*+)"|'(?P<b>[^']*+)'|(?P<c>[^\s>]*+)))?+|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+""",
                  re.S | re.I | re.X)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)"


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source and not source.isspace():
        for m in ATTR.finditer(source):
            if m["name"]:
                out.setdefault(m["name"].lower(), unescape(m["a"] or m["b"] or m["c"] or ""))
    return out


def set_apart(tag: str, attrs: dict[str, str]) -> int:
    """0: may hold the article, 1: unless it holds main or article, 2: never does."""
    if tag in APART:
        return 2
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return 2
    if tag in ("html", "body", "main", "article") and not any(
            w in ("comment", "comments", "reply", "ad", "sponsored") for w in WORDS.findall(attrs.get("class", "").lower())):
        return 0
    if tag in ("html", "body", "main"):
        return 0
    if attrs.get("role", "").lower() in ROLES:
        return 1 if attrs["role"].lower() in ("form", "search") else 2
    names = [*attrs.get("class", "").split(), attrs.get("id", "")]
    kind = 1 if tag == "form" else 0
    for name in names:
        words = {w.lower() for w in WORDS.findall(name)}
        hit = words & APART_WORDS
        if hit and not words & LAYOUT_WORDS:
            kind = max(kind, 1 if hit <= WRAPPER_WORDS else 2)
    return kind


def step(tag: str, attrs: dict[str, str]) -> str:
    """A path's step: the tag and its class words (else its id), generalised."""
    names = attrs.get("class", "").split() or [attrs["id"]] if attrs.get("class", "").strip() or attrs.get("id") else []
    general = set()
    for n in names:
        n = re.sub(r"\d+", "#", n.lower())
        general.add("*" if n.count("#") > 1 else n)
    return ".".join([tag, *sorted(general)]).replace(">", "").replace("\n", "")


class Page:
    """Blocks and containers of one page."""

    def __init__(self, html: str):
        #: per element (0: the page): parent, step, whether it is a container, kind of set_apart
        self.parent, self.steps, self.tags, self.apart = [-1], [""], [""], [0]
        self.semantic = [False]                        # holds main or article
        self.blocks: list[tuple[str, int, int]] = []   # text, characters in links, element
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = [("", 0, 0)]     # tag, block element, never-depth
        is_open: dict[str, int] = {}
        text: list[str] = []
        links = linked = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if text:
                body = " ".join("".join(text).split())
                if body:
                    self.blocks.append((body, min(linked, len(body)), stack[-1][1]))
                text.clear()
            linked = 0

        def say(piece: str) -> None:
            nonlocal linked
            if stack[-1][2] == 0 and piece:
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if links:
                    linked += len("".join(piece.split()))

        def push(entry: tuple[str, int, int]) -> None:
            stack.append(entry)
            is_open[entry[0]] = is_open.get(entry[0], 0) + 1

        def pop(n: int) -> None:
            nonlocal links
            for e in stack[n:]:
                is_open[e[0]] -= 1
                links -= e[0] == "a"
            del stack[n:]

        def find(tags: tuple[str, ...], borders: frozenset) -> int:
            if not any(is_open.get(t) for t in tags):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in borders:
                    return 0
            return 0

        for m in TOKEN.finditer(html):
            if m.start() > at:
                say(html[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None or not m["close"]:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if m["end"]:
                if inline and not is_open.get(tag):
                    pass
                elif inline:
                    k = len(stack) - 1
                    while k and stack[k][0] != tag and stack[k][0] in INLINE:
                        k -= 1
                    if k and stack[k][0] == tag:
                        pop(k)
                elif tag not in VOID and (k := find((tag,), frozenset() if tag in TABLE_TAGS else CELLS - {tag})):
                    flush()
                    pop(k)
                elif tag == "br":
                    say(" ")
                continue
            if tag == "br":
                say(" ")
                continue
            if not inline:
                flush()
                if (k := find(("p",), CELLS)):
                    pop(k)
                if tag in ENDS and (k := find(ENDS[tag][:1], BORDERS) or find(ENDS[tag], BORDERS)):
                    pop(k)
            if tag in VOID:
                continue
            attrs = attributes(m["attrs"])
            kind = set_apart(tag, attrs)
            _, element, never = stack[-1]
            if inline and not kind:
                if tag == "a":
                    links += 1
                push((tag, element, never))
                continue
            if inline:                                   # an advert's span and the like
                push((tag, element, never + 1))
                links += tag == "a"
                continue
            if tag in ("main", "article"):
                e = element
                while e >= 0 and not self.semantic[e]:
                    self.semantic[e] = True
                    e = self.parent[e]
            self.parent.append(element)
            self.steps.append(step(tag, attrs) if tag in CONTAINERS else tag)
            self.tags.append(tag)
            self.apart.append(kind)
            self.semantic.append(False)
            push((tag, len(self.parent) - 1, never + (kind == 2)))
        if at < len(html):
            say(html[at:])
        flush()

    def _judge(self) -> None:
        """Drop what is set apart; score the containers; path numbers of the elements."""
        n = len(self.parent)
        gone, path, self.numbers = [False] * n, [0] * n, {}
        for e in range(1, n):
            p = self.parent[e]
            gone[e] = gone[p] or self.apart[e] == 1 and not self.semantic[e]
            if self.tags[e] in ("html", "body"):
                path[e] = path[p]
            else:
                path[e] = self.numbers.setdefault((path[p], self.steps[e]), len(self.numbers) + 1)
        self.path = path
        # menus: three or more blocks of one element, all of them links
        around: dict[int, list[int]] = {}
        for k, (body, linked, e) in enumerate(self.blocks):
            holder = self.parent[e] if self.tags[e] in ("li", "td", "dd", "dt") else e
            if self.tags[e] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
                around.setdefault(holder, []).append(k)
        menus = {k for ks in around.values() if len(ks) > 2 and all(
            self.blocks[k][1] >= 0.8 * len("".join(self.blocks[k][0].split())) for k in ks) for k in ks}
        self.kept = [not gone[e] and k not in menus for k, (_, _, e) in enumerate(self.blocks)]
        self.score = [0] * n
        for (body, linked, e), keep in zip(self.blocks, self.kept):
            if keep and 2 * linked <= len(body):
                self.score[e] += len(body)
        for e in range(n - 1, 0, -1):
            self.score[self.parent[e]] += self.score[e]

    def candidate(self) -> int:
        """The container reached from the outside in."""
        inside: dict[int, int] = {}                    # best child of every element
        for e in range(1, len(self.parent)):
            p = self.parent[e]
            if self.tags[e] in CONTAINERS or self.tags[e] in ("html", "body"):
                if p not in inside or self.score[e] > self.score[inside[p]]:
                    inside[p] = e
        e = 0
        while self.tags[e] != "article" and e in inside and self.score[inside[e]] > 0 \
                and self.score[inside[e]] >= SHARE * self.score[e]:
            e = inside[e]
        return e

    def path_of(self, e: int) -> str:
        out = []
        while e:
            if self.tags[e] not in ("html", "body"):
                out.append(self.steps[e])
            e = self.parent[e]
        return ">".join(reversed(out))

    def at(self, path: str) -> list[int]:
        """Elements with a path; of bare elements the one with the highest score."""
        number = 0
        for s in path.split(">") if path else ():
            number = self.numbers.get((number, s), -1)
            if number < 0:
                return []
        if not path:
            return [0]
        found = [e for e, p in enumerate(self.path) if p == number and self.tags[e] not in ("html", "body")]
        last = path.rsplit(">", 1)[-1]
        return found if "." in last or last in ("article", "main") else [max(found, key=lambda e: (self.score[e], -e))]

    def text(self, elements: list[int]) -> str:
        inside = [False] * len(self.parent)
        for e in elements:
            inside[e] = True
        for e in range(1, len(self.parent)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return "\n\n".join(b[0] for b, keep in zip(self.blocks, self.kept) if keep and inside[b[2]])


def main_text(html: str | None, paths: list[str] | None = None) -> str:
    """The page's text by the first path it holds, else by its own candidate."""
    page = Page(html or "")
    for p in paths or ():
        if found := page.at(p):
            return page.text(found)
    return page.text([page.candidate()])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, weights = [], [], []
        for host, html in zip(b.column("host").to_pylist(), b.column("html")):
            page = Page(html.as_py() or "")
            best = page.candidate()
            if page.score[best]:
                hosts.append(host)
                paths.append(page.path_of(best))
                weights.append(log2(1 + page.score[best]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                          pa.array(weights, pa.float64())], ["host", "path", "weight"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(b.column("html"), b.column("paths"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url):
    """The url's host in lower case, null where it names none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths (strongest first) of every host's winning paths."""
    ship_package(pages.sparkSession)
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").where("host IS NOT NULL") \
        .mapInArrow(_vote, "host string, path string, weight double")
    # whole numbers add up alike in any order
    units = F.sum(F.round(F.col("weight") * 1000).cast("long"))
    votes = stored(votes.groupBy("host", "path").agg(units.alias("votes")), "path-votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    strong = votes.join(totals, "host").where(F.col("votes") >= F.col("total") * SUPPORT)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))    # ten at most
    return stored(strong.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths")), "host-paths")


def extract(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html) by its host's paths."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    paths = host_paths(pages) if paths is None else paths
    ship_package(pages.sparkSession)
    dealt = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("salt", salt)
    rows = rows.withColumn("host", F.coalesce("host", F.concat(F.lit("/"), F.col("salt"))))       # never a host
    return rows.join(dealt, ["host", "salt"], "left").select("page_id", "url", "html", "paths") \
        .mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
