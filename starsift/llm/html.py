"""Main text of web pages by consensus paths of hosts.

1. Each page's containers are scored by the text of their blocks, links left out. A container's
   path is the tags and classes of its ancestors and itself, with numbers made alike.
2. In Spark, each page votes for the paths of its best containers. Paths that are best on enough of a
   host's pages win, so a host with several templates has several. Votes are summed before the
   shuffle, so a host that holds a third of all pages is no single task's work.
3. The text is taken anew from the containers on the first of the host's winning paths that the page
   has; a page without one falls back to its own best container.

Elements of any kind are left out by tag, role or class, at any level and of any length. Words of
classes are evidence, not proof: a layout that is named after what stands beside the text (a
"content-sidebar-wrap") is no sidebar. So where nothing outside such elements looks like an article, and
the page's best container lies within one, that container and what is around it stay; and the containers
of a host's winning path stay whatever is around them. Reader comments never stay for such reasons.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.storage import written

#: Paths that a page votes for, best first.
VOTES = 3
#: A path wins that is best on this share of the pages that the host's first path is best on.
WINS = 0.1

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")

RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "select", "title", "head"}
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "th", "table", "tbody", "tr", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "center", "dialog", "fieldset", "details", "menu", "figure"}
BLOCKS = CONTAINERS - {"td", "th"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "br", "hr", "figcaption", "address", "caption", "summary", "thead", "tfoot", "hgroup", "option", "legend"}
#: Elements, roles and words of class or id whose content is no main text.
OUT_TAGS = {"nav", "aside", "header", "footer", "form", "dialog", "menu", "button", "label"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promotion", "related", "recommended", "replies", "reply",
    "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets", "login", "search", "skip", "tags", "overlay", "paywall", "copyright", "alert", "feedback", "reactions", "discussion",
}
#: Of these, words that may be an article's own; words of reader comments beside those with "comment"; how further such words begin;
#: and words that make of a class a state of the page, which tells nothing ("has-sidebar").
DOUBTFUL = {"tags", "alert", "feedback", "discussion", "search", "related", "recommended", "reactions", "share", "skip", "copyright", "respond"}
READERS = {"disqus", "replies", "reply"}
STEMS = ("advert", "adsby", "sidebar", "sponsor", "cookie", "newsletter", "breadcrumb", "subscri")
STATES = {"has", "have", "with", "without", "no", "is", "open", "opened", "closed", "enabled", "disabled", "on", "off", "hide", "show"}
#: Words that, beside a word of the list, say nothing of their own. Words of up to two letters say nothing either.
PLAIN = {
    "article", "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "column", "container", "content", "entry", "footer", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer",
    "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "top", "unit", "user", "view", "wrap", "wrapper", "zone",
}
GOOD_TAGS, GOOD_WORDS = {"article", "main"}, {"article", "content", "entry", "post", "story", "main", "body", "text"}


@dataclass
class _Container:
    parent: int
    tag: str
    path: str
    out: bool  # as a tag, role or reader comments; after all by any reason, or within such
    good: bool
    tells: bool = False  # a class says that it's no main text
    doubtful: bool = False  # a class that may say so
    linked: bool = False  # a class that says so where most is links
    inline: bool = False  # an element that holds no article of its own
    headed: bool = False  # it has a heading of the page or a part
    own_out: bool = False  # out by itself
    never: bool = False  # out, or within what is, by tag, role or reader comments
    depth: int = 1


@dataclass
class _Page:
    """Containers in page order, and pieces of text as (container, block, text, in a link)."""

    containers: list[_Container] = field(default_factory=list)
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)


def _attributes(text: str) -> tuple[list[str], str]:
    """The words of class and id in order of the page, and the role."""
    words, role = [], ""
    if "=" in text:
        for name, value in _ATTRIBUTE.findall(text):
            value = value.strip("\"'").lower()
            if name.lower() == "role":
                role = value
            else:
                words += value.split()
    return words, role


def _tells(words: list[str]) -> str:
    """What the words of class and id say: "readers", "out", "doubtful", "linked" (out if mostly links) or nothing."""
    said = ""
    for word in words:
        parts = set(_WORDS.findall(word))
        found = {x for x in parts if x in OUT_WORDS or x.startswith(STEMS)}
        if any(x in READERS or (x.startswith("comment") and not x.startswith(("commentar", "commentat"))) for x in parts) and not parts & STATES:
            return "readers"
        if not found or parts & STATES:
            continue
        if found - DOUBTFUL:
            said = "out"
        elif said != "out":
            alone = all(x in OUT_WORDS or x in PLAIN or len(x) <= 2 for x in parts)
            said = "doubtful" if alone or said == "doubtful" else "linked"
    return said


def _scores(page: _Page, counted: list[bool]) -> list[float]:
    """For each container the letters of its own blocks outside links, and half of its children's, of those counted."""
    own = [0.0] * len(page.containers)
    for k, _, text, linked in page.pieces:
        if counted[k]:
            length = len(text) if not text.isspace() else 0
            own[k] += -length / 2 if linked else length
    total = list(own)
    for k, c in enumerate(page.containers[1:], 1):
        if counted[k] and own[k] > 0:
            total[c.parent] += own[k] / 2
    return [s * (1.5 if c.good else 1.0) for s, c in zip(total, page.containers, strict=True)]


def _settle(page: _Page) -> None:
    """Decide on elements whose classes tell, and give the texts of inline ones that stay to the container."""
    all_, top = page.containers, [0] * len(page.containers)
    length, linked = [0] * len(all_), [0] * len(all_)
    for k, _, text, in_link in page.pieces:
        n = len(text.strip())
        length[k] += n
        linked[k] += n * in_link
    for k in range(len(all_) - 1, 0, -1):
        length[all_[k].parent] += length[k]
        linked[all_[k].parent] += linked[k]
    for k, c in enumerate(all_[1:], 1):
        c.own_out = c.out
        c.never = c.out or all_[c.parent].never
        c.doubtful |= c.linked and 2 * linked[k] > length[k]
    if any(c.tells or c.doubtful for c in all_):
        below = [False] * len(all_)  # at or below an element that tells
        for k, c in enumerate(all_[1:], 1):
            below[k] = c.tells or c.doubtful or below[c.parent]

        def best(counted: list[bool]) -> int | None:
            scores = _scores(page, counted)
            return max((k for k, c in enumerate(all_) if counted[k] and not c.inline and scores[k] > 0), key=lambda k: (scores[k], -k), default=None)

        outside = best([not c.never and not b for c, b in zip(all_, below, strict=True)])
        if outside is None or not (all_[outside].good or all_[outside].headed):
            inside = best([not c.never and not c.tells for c in all_])
            if inside is None:  # all there is stands in elements that tell
                inside = best([not c.never for c in all_])
            while inside:
                all_[inside].tells = all_[inside].doubtful = False
                inside = all_[inside].parent
    for k, c in enumerate(all_[1:], 1):
        c.own_out |= c.tells or c.doubtful
        c.out = c.own_out or all_[c.parent].out
        top[k] = top[c.parent] if c.inline and not c.out else k
        c.parent = top[c.parent]
    page.pieces = [(top[k], block, text, in_link) for k, block, text, in_link in page.pieces]


def read(page: str) -> _Page:
    """Containers and texts of a page; end tags that lack are taken as given, others without a start are left out."""
    out = _Page([_Container(-1, "", "", False, False)])
    stack, block, link, at, n = [0], 0, 0, 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            text = page[at:start]
            if text[0] == "<" and m is None and re.match(r"<[a-zA-Z/!?]", text):
                break  # a tag that the page's end cuts off
            out.pieces.append((stack[-1], block, text, link > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag == "head":
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                else:
                    at = n
            continue
        if tag in BLOCKS:
            block += 1
        if tag == "a":
            link = 0 if closing else 1
        if tag in ("td", "th") and out.pieces:
            out.pieces.append((stack[-1], block, " ", False))
        # The elements within the innermost container that are on the stack for what they leave out.
        run = len(stack)
        while run > 1 and out.containers[stack[run - 1]].inline:
            run -= 1
        if closing:
            inline = tag not in CONTAINERS
            for k in range(len(stack) - 1, run - 1 if inline else 0, -1):
                found = out.containers[stack[k]]
                if found.tag == tag:
                    found.depth -= 1
                    if not found.depth:
                        del stack[k:]
                    break
            link = link if inline else 0
            continue
        if tag in VOID or rest.rstrip().endswith("/"):
            continue
        for k in range(run, len(stack)):
            found = out.containers[stack[k]]
            if (found.tag == "p" and tag in BLOCKS) or (found.tag == tag and tag in CLOSED_BY_NEXT):
                del stack[k:]  # an end tag that lacks
                break
            if found.tag == tag:
                found.depth += 1
        words, role = _attributes(rest)
        said = _tells(words) if words and tag not in ("html", "body", "main", "article") else ""
        bad = said == "readers" or tag in OUT_TAGS or role in OUT_ROLES or bool(rest and _HIDDEN.search(rest))
        inline = tag not in CONTAINERS
        if tag in ("h1", "h2"):
            out.containers[stack[run - 1]].headed = True
        if inline and not bad and not said:
            continue
        parent = stack[-1]
        above = out.containers[parent]
        parts = {p for w in words for p in _WORDS.findall(w)}
        name = ".".join([tag, *sorted({re.sub(r"\d+", "#", w) for w in words})])
        good = tag in GOOD_TAGS or bool(parts & GOOD_WORDS)
        out.containers.append(_Container(parent, tag, above.path if inline else f"{above.path}/{name}", bad, good and not inline, said == "out", said == "doubtful", said == "linked", inline))
        stack.append(len(out.containers) - 1)
    _settle(out)
    return out


def scored(page: _Page) -> list[tuple[float, int]]:
    """(score, container) of the containers with text of their own or of children, best first.

    A container has the letters of its own blocks outside links, and half of its children's; the
    article's element or a telling class makes it half as much again.
    """
    scores = _scores(page, [not c.out for c in page.containers])
    return sorted(((s, -k) for k, (s, c) in enumerate(zip(scores, page.containers, strict=True)) if s > 0 and not c.out), reverse=True)


def text_of(page: _Page, chosen: set[int]) -> str:
    """The blocks within the chosen containers, without what is no main text; what is around them doesn't count."""
    within = [False] * len(page.containers)
    for k, c in enumerate(page.containers):
        within[k] = not c.inline and ((k in chosen and not c.never) or (c.parent >= 0 and within[c.parent] and not c.own_out))
    blocks: dict[int, list[str]] = {}
    for k, block, text, _ in page.pieces:
        if within[k]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(page: str, paths: Sequence[str]) -> str:
    """The main text by the first of ``paths`` with text, or by the page's own best container.

    An article's element or class that stands on the page several times on one path is taken each time.
    """
    parsed = read(page)
    for path in paths:
        text = text_of(parsed, {k for k, c in enumerate(parsed.containers) if c.path == path and not c.inline})
        if text:
            return text
    ranked = scored(parsed)
    if not ranked:
        return ""
    best = parsed.containers[-ranked[0][1]]
    return text_of(parsed, {k for k, c in enumerate(parsed.containers) if c is best or (best.good and c.path == best.path and not c.inline and not c.out)})


def host(url_col: str) -> F.Column:
    """The host of a URL in lower case, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, paths): the first winning path of each host, and all of them, at most 1 / WINS.

    Paths are ordered by the number of pages on which they are best, then by votes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["host"], batch["html"], strict=True):
                parsed = read(text)
                best = scored(parsed)[:VOTES]
                top = best[0][0] if best else 1.0
                rows += [(name, parsed.containers[-k].path, s / top, int(not nth)) for nth, (s, k) in enumerate(best)]
            yield pd.DataFrame(rows, columns=["host", "path", "vote", "best"])

    voted = pages.select(host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html")).mapInPandas(run, "host string, path string, vote double, best long")
    votes = voted.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"), F.sum("best").alias("best"))
    votes = written(votes, "votes")
    most = votes.groupBy("host").agg(F.max("best").alias("most"))
    won = votes.join(most, "host").filter((F.col("best") > 0) & (F.col("best") >= F.col("most") * WINS))
    ranked = won.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("best"), F.desc("votes"), "path"))).filter(F.col("nth") <= round(1 / WINS))
    paths = F.transform(F.sort_array(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"])
    return ranked.groupBy("host").agg(paths.alias("paths")).select("host", F.col("paths")[0].alias("path"), "paths")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", paths: DataFrame | None = None) -> DataFrame:
    """``pages`` with the main text of each row as ``text_col`` (replaced if there is one).

    Null html counts as empty; its text is empty. Pages without a host share the empty host; a host on
    which two paths tie takes the one with more votes, then the first by name. Repeated rows stay, and
    other columns keep their names; very long pages are read whole; an empty table stays empty.
    ``paths`` may hold (host, paths) of an earlier run. Spark broadcasts the table of paths only where
    it is under its threshold; beyond it both sides are shuffled by host, and large hosts are split by
    adaptive skew joins.
    """
    paths = written(winning_paths(pages, url_col, html_col), "paths") if paths is None else paths

    @F.pandas_udf("string")
    def extracted(texts: pd.Series, chosen: pd.Series) -> pd.Series:
        return pd.Series([extract(t, () if p is None else p) for t, p in zip(texts, chosen, strict=True)], dtype=object)

    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("own")
    own = pages.select(row, host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("page"))
    joined = own.join(paths.select("host", "paths"), "host", "left")
    return joined.select(*(F.col(f"own.`{c}`") for c in pages.columns if c != text_col), extracted("page", "paths").alias(text_col))
