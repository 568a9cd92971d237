"""Main text of web pages by deducing the template of each host.

An element (a pair of tags with its class and id) and a block of text are tokens,
told apart by the elements around them.  Tokens of a host whose occurrence
vectors agree (how often each page holds them) are one equivalence class; the
vector is carried as a sum of hashes over the pages, so that no task ever sees
a whole host.  A class is valid when its tokens occur at most once a page, on
enough pages, and an element is among them.  Valid classes nest, by the elements around their tokens, into
the template, ordered by where its tokens stand on average.  Each page is
aligned to it: template tokens that stand in order cut the page into slots, and what is
left in the slots of the article is the text.

The article is the page's article or main element; where several compete the
template says which one is the page's own.  Without one it is the innermost
container of the template that holds most of the text of all the host's pages.
Text that belongs to the template goes, wherever it stands.  Names of classes
only break ties outside of articles, and there never against the template.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy

#: Templates of up to this many tokens in all are broadcast; beyond, pages and templates are joined with a salt.
BROADCAST_TOKENS = 100_000
#: Groups of equal pages, or hosts, of up to this many are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 32
#: A class needs so many different pages, and one in so many of its host's; text goes only with a class that one in ``TEXT_IN`` of them hold.
LEAST_PAGES, ONE_IN, TEXT_IN = 3, 10, 2
#: Share of a host's text that its content container holds at least.
CONTAINS = 0.8

_RAW = re.compile(r"(script|style|noscript|template|iframe|svg|textarea|select)\b", re.I)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template iframe svg textarea select".split()}
#: A tag as most are: without ``<`` or single quotes inside, so that a try ends where the next markup begins.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:\"[^<\"]*\"[^<>\"']*)*)>")
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_ENDS_BLOCK = _BLOCK | {"hr"}
_AWAY = frozenset("head title nav menu aside footer form dialog fieldset".split())
_CONTAINERS = frozenset("article aside body div main section table td".split())
_LISTS = frozenset("article div ins li ol section table ul".split())
#: What an element ends, up to one that holds it.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
_HOLDS = frozenset("ul ol menu dl table tbody thead tfoot html".split())
_BODY = frozenset(("article", "main"))
_P, _ENDS_P = frozenset("p"), _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Names of containers of reader comments and adverts, whole class names or ids.
_COMMENTS = frozenset("comment comments comment-list commentlist comments-area comments-section comment-section comment-respond respond reader-comments user-comments disqus_thread".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-unit sponsored".split())
#: Names that tell menus, notices and the like where nothing else does.
_TIES = frozenset("banner breadcrumb breadcrumbs consent cookie cookies cookie-banner cookie-consent cookie-notice footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related related-posts share share-buttons sharing sidebar social social-links subscribe toolbar topbar widget".split())


def _key(up: int, what: str) -> int:
    return int.from_bytes(blake2b(what.encode("utf-8", "surrogatepass"), digest_size=8, key=up.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of all markup in order; without a name for comments, declarations and elements whose content is no text.

    One pass: what is known to have no end after a place is not sought again.  A tag ends at the first ``>`` outside of quotes; where a quote is
    never closed, or none is left outside, at the first ``>`` at all.  Without any it is text, and a comment or an element like a script without an end goes on to the end of the page.
    """
    last, at = page.rfind(">"), page.find("<")
    ends = {x: True for x in _RAW_END}
    lost = {'"': len(page), "'": len(page)}  # from where on there is no such quote
    failed = set()  # quotes from which on no tag ends
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif at > last:
            # Nothing but a comment is markup from here on.
            end = page.find("<!--", at + 1)
            at = end
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2) + 1
            yield at, end, False, "", ""
        elif raw := _RAW.match(page, at + 1):
            name, begin = raw[1].lower(), page.find(">", raw.end()) + 1
            if begin == 0:
                at = page.find("<", at + 1)
                continue
            found = _RAW_END[name].search(page, begin) if ends[name] else None
            ends[name] = found is not None
            end = found.end() if found else len(page)
            yield at, end, False, "", ""
        elif tag := _TAG.match(page, at):
            end = tag.end()
            yield at, end, tag[1] == "/", tag[2], tag[3]
        elif named := _NAME.match(page, at + 1):
            pos, opened, end = named.end(), [], 0
            while stop := _STOP.search(page, pos):
                if stop[0] == ">":
                    end = stop.end()
                    break
                if stop.start() in failed or stop.start() >= lost[stop[0]]:
                    break
                opened.append(stop.start())
                pos = page.find(stop[0], stop.end()) + 1
                if pos == 0:
                    lost[stop[0]] = stop.start()
                    break
            if not end:
                failed.update(opened)
                end = page.find(">", named.end()) + 1
            if not end:
                at = page.find("<", at + 1)
                continue
            yield at, end, named[0][0] == "/", named[0].lstrip("/"), page[named.end():end - 1]
        else:
            end = at + 1
        at = page.find("<", end)


class Page:
    """The elements and text blocks of a page.

    elements: (key, parent, name, class names and ids, order); blocks: (element,
    text, characters of links, order).  The first element is the page itself.
    Ends that HTML leaves out are put in; inline markup is no element.
    """

    def __init__(self, page: str):
        self.elements: list[tuple[int, int, str, frozenset, int]] = [(0, -1, "", frozenset(), 0)]
        self.blocks: list[tuple[int, str, int, int]] = []
        open_, still, piece, links = [0], defaultdict(int), [], 0
        last = in_link = in_button = order = 0

        def end():
            nonlocal links, order
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                order += 1
                self.blocks.append((open_[-1], text, min(links, len(text)), order))
            piece.clear()
            links = 0

        def close(names, holds=frozenset()):
            if not any(still[x] for x in names):
                return
            for i in range(len(open_) - 1, 0, -1):
                name = self.elements[open_[i]][2]
                if name in names:
                    for k in open_[i:]:
                        still[self.elements[k][2]] -= 1
                    del open_[i:]
                    return
                if name in holds:
                    return

        for start, stop, ends, name, attributes in _tags(page):
            if start > last and not in_button:
                piece.append(page[last:start])
                links += (start - last) * (in_link > 0)
            last, name = stop, name.lower()
            if not name:
                continue
            if name == "br":
                piece.append(" ")
            elif name == "a":
                in_link = int(not ends)
            elif name == "button":
                in_button = int(not ends)
            if name not in _ENDS_BLOCK:
                continue
            end()
            in_button = 0
            if ends:
                close({name})
                continue
            if name == "hr":
                continue
            close(_P, _ENDS_P)
            if name in _IMPLIED:
                close(_IMPLIED[name], _HOLDS)
            named = " ".join(sorted(x for g in _NAMED.findall(attributes) for x in g if x)) if attributes else ""
            up = open_[-1]
            order += 1
            self.elements.append((_key(self.elements[up][0], f"<{name} {named}"), up, name, frozenset(named.lower().split()), order))
            open_.append(len(self.elements) - 1)
            still[name] += 1
        if len(page) > last and not in_button:
            piece.append(page[last:])
            links += (len(page) - last) * (in_link > 0)
        end()
        self.away = [False] * len(self.elements)
        self.inside = [False] * len(self.elements)
        for i, (_, up, name, _, _) in enumerate(self.elements[1:], 1):
            self.inside[i] = self.inside[up] or name in _BODY
            self.away[i] = self.away[up] or name in _AWAY or name == "header" and not self.inside[up]

    def text_key(self, block: tuple) -> int:
        return _key(self.elements[block[0]][0], block[1])

    def sums(self) -> list[int]:
        """Characters, outside of links and of what goes by its tag, within each element."""
        out = [0] * len(self.elements)
        for at, text, links, _ in self.blocks:
            if not self.away[at]:
                out[at] += len(text) - links
        for i in range(len(out) - 1, 0, -1):
            out[self.elements[i][1]] += out[i]
        return out


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        every = []
        for source in pdf["html"]:
            page = Page(source)
            sums, own = page.sums(), {}
            depth = [0] * len(page.elements)
            for i, (key, up, name, _, order) in enumerate(page.elements):
                depth[i] = depth[up] + 1 if i else 0
                level = depth[i] if name in _CONTAINERS and not page.away[i] else 0
                n, at, level, chars = own.get((key, False), (0, order, level, 0))
                own[key, False] = (n + 1, at, level, chars + sums[i])
            for block in page.blocks:
                if not page.away[block[0]]:
                    key = page.text_key(block)
                    n, at, _, _ = own.get((key, True), (0, block[3], 0, 0))
                    own[key, True] = (n + 1, at, 0, 0)
            total = max(1, len(page.elements) + len(page.blocks))
            every.append([{"token": key, "text": text, "n": n, "at": at / total, "level": level, "chars": chars} for (key, text), (n, at, level, chars) in own.items()])
        yield pdf[["host", "page"]].assign(tokens=every)


def host(url):
    """Host of a URL column in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


@tidy
def templates(pages: DataFrame) -> DataFrame:
    """host and tokens (token, text, holds) of its template in order, for pages (host, html); the content container holds.

    Equal pages of a host count once.  A host of fewer than ``LEAST_PAGES``
    different pages has no template.  As a token needs a tenth of its host's
    pages, a template has at most ten times the tokens of an average page, however
    large the host is.
    """
    pages = pages.where("html is not null").select("host", F.xxhash64("html", F.length("html")).alias("page"), "html")
    each = keep(pages.groupBy("host", "page").agg(F.count("*").alias("m")), "pages")
    hosts = keep(each.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES), "hosts")
    copies = each.where("m > 1")
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    rows = pages.join(few(hosts.select("host")), "host", "left_semi")
    rows = rows.mapInPandas(_tokens, "host string, page long, tokens array<struct<token:long,text:boolean,n:int,at:double,level:int,chars:long>>")
    rows = rows.join(few(copies), ["host", "page"], "left").select("host", "page", (1 / F.coalesce("m", F.lit(1))).alias("w"), F.inline("tokens"))
    found = rows.groupBy("host", "token", "text").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"), F.round(F.sum("w")).alias("support"), F.max("n").alias("most"),
        (F.sum(F.col("at") * F.col("w")) / F.sum("w")).alias("at"), F.max("level").alias("level"), F.sum(F.col("chars") * F.col("w")).alias("chars"))
    found = found.where(F.col("support") >= LEAST_PAGES).join(few(hosts), "host").where(F.col("support") * ONE_IN >= F.col("pages"))
    one = F.struct("at", "token", "text", "level", "chars")
    classes = found.groupBy("host", "vector").agg(F.max("most").alias("most"), F.max("support").alias("support"), F.max("pages").alias("pages"), F.bool_or(~F.col("text")).alias("tags"), F.collect_list(one).alias("own"))
    classes = classes.where((F.col("most") == 1) & F.col("tags"))
    own = F.filter("own", lambda t: ~t["text"] | (F.col("support") * TEXT_IN >= F.col("pages")))
    whole = keep(classes.select("host", own.alias("own")).groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("all")), "templates")
    most = F.array_max(F.transform("all", lambda t: t["chars"]))
    within = F.filter("all", lambda t: (t["level"] > 1) & (t["chars"] >= CONTAINS * most))
    container = F.array_max(F.transform(within, lambda t: F.struct(t["level"].alias("level"), t["token"].alias("token"))))["token"]
    whole = whole.select("host", "all", container.alias("container"))
    return whole.select("host", F.transform("all", lambda t: F.struct(t["token"].alias("token"), t["text"].alias("text"), F.coalesce(t["token"] == F.col("container"), F.lit(False)).alias("holds"))).alias("tokens"))


class Template:
    """Order of the tokens (key, holds) of a host; ``container`` holds the content where pages have no article."""

    def __init__(self, tokens: list[tuple[int, bool]] = ()):
        self.order = {key: i for i, (key, _) in enumerate(tokens)}
        self.container = next((key for key, holds in tokens if holds), None)

    def align(self, page: Page) -> set[int]:
        """The template tokens that stand once, and in order, on a page."""
        if not self.order:
            return set()
        seen: dict[int, int] = {}
        stands = [(x[4], x[0]) for x in page.elements] + [(b[3], page.text_key(b)) for b in page.blocks if not page.away[b[0]]]
        for _, key in stands:
            seen[key] = seen.get(key, 0) + 1
        keys = [key for _, key in sorted(stands) if seen[key] == 1 and key in self.order]
        ends: list[int] = []  # of the best increasing runs, by length
        at: list[int] = []
        back = [-1] * len(keys)
        for i, key in enumerate(keys):
            k = bisect_left(ends, self.order[key])
            back[i] = at[k - 1] if k else -1
            ends[k:k + 1] = [self.order[key]]
            at[k:k + 1] = [i]
        out, i = set(), at[-1] if at else -1
        while i >= 0:
            out.add(keys[i])
            i = back[i]
        return out


def _articles(page: Page, own: set[int], sums: list[int]) -> list[int]:
    """The elements that are the article of a page; none if it marks none."""
    def outermost(name):
        found, inside = [], [False] * len(page.elements)
        for i, (_, up, tag, _, _) in enumerate(page.elements[1:], 1):
            inside[i] = inside[up] or tag == name
            if tag == name and not inside[up] and not page.away[i]:
                found.append(i)
        return found

    size = lambda at: sum(sums[i] for i in at)
    articles, mains = outermost("article"), outermost("main")
    if mains and 2 * size(articles) < size(mains):
        articles = mains
    known = [i for i in articles if page.elements[i][0] in own]
    if known and len(known) < len(articles):
        articles = known if 2 * size(known) >= size(articles) else [i for i in articles if i not in known]
    return articles


def main_text(source: str, template: Template | None = None) -> str:
    """Blocks of the slots that belong to the article, in page order, joined by an empty line.

    A page of which all article text belongs to the template keeps it.
    """
    page, template = Page(source), template or Template()
    own, sums, n = template.align(page), page.sums(), len(page.elements)
    articles = _articles(page, own, sums)
    region = set(articles)
    if not region:
        region = {i for i, x in enumerate(page.elements) if x[0] == template.container and x[0] in own} or {0}
    stays, goes, tied = [False] * n, page.away[:], [False] * n
    links = [0] * n
    for at, text, link, _ in page.blocks:
        links[at] += link
    for i in range(n - 1, 0, -1):
        links[page.elements[i][1]] += links[i]
    for i, (key, up, name, names, _) in enumerate(page.elements):
        if i:
            stays[i], goes[i], tied[i] = stays[up], goes[i] or goes[up], tied[up]
        stays[i] = stays[i] or i in region
        if i in region or not i:
            continue
        if articles:
            goes[i] = goes[i] or stays[i] and name in _LISTS and bool(names & _COMMENTS or names & _ADVERTS)
        elif stays[i] and name not in ("html", "body") and (not template.order or key in own):
            menu = name in _LISTS and links[i] >= 20 and links[i] > 2 * sums[i]
            tied[i] = tied[i] or menu or bool(names & (_TIES | _COMMENTS | _ADVERTS))
    text = lambda only: sum(len(t) - k for at, t, k, _ in page.blocks if stays[at] and not goes[at] and (tied[at] or not only))
    if any(tied) and text(True) >= CONTAINS * text(False):
        tied = [False] * n  # names that would take most of the text tell nothing
    heading = lambda at: not articles and page.elements[at][2] == "h1"
    slots = [b for b in page.blocks if (stays[b[0]] or heading(b[0])) and not goes[b[0]] and not tied[b[0]]]
    left = [b for b in slots if page.text_key(b) not in own] if own else slots
    return "\n\n".join(b[1] for b in left or slots)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, tuple[int, Template]] = {}
    for pdf in batches:
        out = []
        for page, name, tokens in zip(pdf["html"], pdf["host"], pdf["tokens"], strict=True):
            if name not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[name] = Template([] if tokens is None else [(t["token"], t["holds"]) for t in tokens])
            out.append(main_text(page, seen[name]) if page else "")
        yield pdf[["page_id", "url"]].assign(text=out, n_chars=[len(t) for t in out])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages`` (page_id, url, html).

    Null and empty html has the empty text.  Null ids and urls stay null.  Pages without a host share one
    template.  Repeated rows are extracted each and count once for the template.  Further columns are ignored;
    an empty table gives none.
    """
    # Ids travel as text, as pandas would turn those of a batch with a null into floats.
    rows = pages.select(F.col("page_id").cast("string"), "url", "html", host(F.col("url")).alias("host"))
    known = templates(rows.select("host", "html"))
    if (known.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= BROADCAST_TOKENS:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    out = rows.select("page_id", "url", "html", "host", "tokens").mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
