"""Main text of web pages by the maximum-scoring subsequence of their tokens.

Method: a page is a sequence of tags and words. Words score positive or negative by where they stand, tags score
negative; the weights are log odds counted on labelled pages (pages whose markup itself names the article). One
linear scan finds the contiguous region of the largest sum; its blocks are the text. Elements that are never
article text (menus, forms, scripts, comments ...) score far below zero and are left out of the region they lie in.

Defined results: null or empty html gives an empty text; repeated rows give repeated results; an empty table gives
an empty table; other columns of the input are ignored. White space is what Python's ``str.split`` splits at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages the weights are counted on, at most.
LABELLED_PAGES = 400

# Fixed values of HTML.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "video", "audio")
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr", "link", "meta",
}
#: Elements that an opening tag of the keys' kind ends where they are still open.
CLOSED_BY = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements whose text is never part of an article.
NEVER = {
    "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "label",
    "fieldset", "input", "option",
}
NEVER_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
    "menubar", "toolbar",
}
NEVER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "topbar", "header", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies",
    "discussion", "widget", "pagination", "pager", "toolbar", "disclaimer", "copyright", "form", "search", "skip",
}
MAIN = {"article", "main"}
MAIN_WORDS = {"articlebody", "article-body", "post-content", "entry-content", "article-content", "main-content"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?P<self>/?)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*>))*)>",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
HINTS = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z]+")


#: Parts of a class that say how an element is laid out, not what it holds: has-sidebar, page-with-header, side-by-side.
LAYOUT = {"has", "no", "with", "without", "by", "is", "not", "hide", "fixed"}
#: Words of a run of text that counts as running text where shares of a page are compared.
RUNNING = 5
#: Share of a page's running text from which an element with a listed word among others in a name is its wrapper.
WRAPPER = 0.75


class Element:
    """An open element: whether it is never article text, bears a listed name (2: the name is that word alone), is named
    the article by its markup, and how many words of running text it holds."""

    __slots__ = ("tag", "never", "listed", "main", "words")

    def __init__(self, tag: str, attrs: str, inside: bool) -> None:
        self.tag, self.words, self.listed = tag, 0, 0
        self.never, self.main = tag in NEVER or (tag == "header" and not inside), tag in MAIN
        for name, *values in HINTS.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.never = True
            elif name == "role":
                self.never, self.main = self.never or value in NEVER_ROLES, self.main or value == "main"
            elif name in ("class", "id") and tag not in ("body", "html"):
                names = value.split()
                self.main = self.main or any(n in MAIN_WORDS for n in names)
                if name == "id" and inside and (tag == "section" or re.fullmatch("h[1-6]", tag)):
                    continue  # an anchor
                for n in names:
                    parts = PART.findall(n)
                    if n not in MAIN_WORDS and not LAYOUT & set(parts) and set(parts) & NEVER_WORDS - ({"header"} if inside else set()):
                        self.listed = max(self.listed, 2 if len(parts) == 1 else 1)
            elif name == "itemprop":
                self.main = self.main or value == "articlebody"
                self.never = self.never or value == "comment"


def _settle(runs: list[tuple[int, tuple[Element, ...]]]) -> tuple[set[int], set[int], bool]:
    """Ids of elements that are never article text and of those named the article; whether the names hold most of the
    page's running text. ``runs``: words and open elements of each run of text."""
    whole = 0
    for n, stack in runs:
        if n >= RUNNING and not any(e.never for e in stack):
            whole += n
            for e in stack:
                e.words += n
    elements = {id(e): e for _, stack in runs for e in stack}
    never = {i for i, e in elements.items() if e.never or e.listed == 2 or e.listed and e.words < WRAPPER * max(whole, 1)}
    named = {i for i, e in elements.items() if e.main and i not in never}
    # if all named text stands in listed elements, those that hold half of the page are its wrappers
    if not any(ids & named and not ids & never for ids in ({id(e) for e in stack} for _, stack in runs)):
        for _, stack in runs:
            first = next((k for k, e in enumerate(stack) if id(e) in named), 0)
            never -= {id(e) for e in stack[:first] if e.listed and not e.never and 2 * e.words >= whole}
    held = sum(n for n, stack in runs if n >= RUNNING and not any(id(e) in never for e in stack) and any(id(e) in named for e in stack))
    rest = sum(n for n, stack in runs if n >= RUNNING and not any(id(e) in never for e in stack) and not any(id(e) in named for e in stack))
    return never, named, held >= rest


def tokens(page: str) -> list[tuple]:
    """The page in order: ("<tag", block) for tags and (text, standing, feature) for runs of text.

    standing: 2 in a part that is never article text, 1 within an element that the markup names the article, 3 within one
    on a page most of whose running text such names leave out (teaser cards), else 0.
    """
    out: list[tuple] = []
    stack: list[Element] = []
    runs: list[tuple[int, tuple[Element, ...]]] = []
    at, end = 0, len(page)

    def run(begin: int, stop: int) -> None:
        raw = page[begin:stop]
        if not raw or raw.isspace():
            if raw:
                out.append((" ", 0, ""))
            return
        block = next((x.tag for x in reversed(stack) if x.tag not in INLINE), "")
        link = any(x.tag == "a" for x in stack)
        out.append((entities.unescape(raw), -len(runs) - 1, f"{block}|{'a' if link else ''}"))
        runs.append((len(raw.split()), tuple(stack)))

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            run(at, end)
            break
        run(at, found.start())
        at = found.end()
        if name := found["raw"]:
            name = name.lower()
            out.append(("<" + name, True))
            if not found["self"]:
                closing = RAW_END[name].search(page, at)
                at = closing.end() if closing else end
            continue
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        block = tag not in INLINE
        if tag == "br":
            out.append((" ", 0, ""))
        out.append(("<" + tag, block))
        if found["close"]:
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in CLOSED_BY or block and tag not in VOID:
            ends = CLOSED_BY.get(tag, {"p"})  # a new block ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE and stack[k].tag not in ("td", "th"):
                    break
        if tag not in VOID and not found["attrs"].rstrip().endswith("/"):
            stack.append(Element(tag, found["attrs"], any(x.main for x in stack)))
    never, named, most = _settle(runs)
    for i, t in enumerate(out):
        if len(t) == 3 and t[1] < 0:
            ids = {id(e) for e in runs[-t[1] - 1][1]}
            standing = 2 if ids & never else (1 if most else 3) if ids & named else 0
            out[i] = (t[0], standing, t[2])
    return out


def count_labelled(page: str) -> Counter:
    """(kind, feature, inside) -> words or tags, for one page whose markup names its article; else empty."""
    parts = tokens(page)
    if not any(len(t) == 3 and t[1] == 1 for t in parts):
        return Counter()
    first = next(i for i, t in enumerate(parts) if len(t) == 3 and t[1] == 1)
    last = next(i for i in range(len(parts) - 1, -1, -1) if len(parts[i]) == 3 and parts[i][1] == 1)
    seen: Counter = Counter()
    for i, t in enumerate(parts):
        if len(t) == 3:
            if words := len(t[0].split()):
                seen["word", t[2], int(t[1] == 1)] += words
                seen["name", "in" if t[1] == 1 else "out", int(t[1] == 1)] += words
        else:
            seen["tag", t[0], int(first <= i <= last)] += 1
    return seen


def fit(counts: dict[tuple[str, str, int], float]) -> dict[str, float]:
    """Weights from the counts of labelled pages: log odds of standing inside the article.

    Words of a feature weigh at most 4 either way; a tag weighs -2 at least and -0.05 at most, so tags are
    never positive.
    """
    totals: dict[tuple[str, int], float] = defaultdict(float)
    for (kind, _, inside), n in counts.items():
        totals[kind, inside] += n
    weights = {}
    for kind, feature in {(k, f) for k, f, _ in counts}:
        inside, outside = (counts.get((kind, feature, i), 0) + 0.5 for i in (1, 0))
        if kind == "word":
            weights["w:" + feature] = max(-4.0, min(4.0, math.log(inside / outside)))
        elif kind == "name":
            weights["n:" + feature] = max(-6.0, min(6.0, math.log(inside / outside)))
        else:
            shares = inside / (totals["tag", 1] + 1), outside / (totals["tag", 0] + 1)
            weights["t:" + feature] = max(-2.0, min(-0.05, math.log(shares[0] / shares[1]) - 0.05))
    return weights


#: Scores that hold whatever the labelled pages say.
NEVER_WORD, TAG = -6.0, -0.2
#: What the markup's names add to a word's weight where no page was counted.
NAMES = {"in": 6.0, "out": -6.0, "card": -6.0}
DEFAULT_WORDS = {"p": 1.0, "h1": 1.0, "h2": 0.7, "h3": 0.7, "h4": 0.5, "blockquote": 0.8, "pre": 0.8, "li": 0.3, "td": 0.3}


def _scores(parts: list[tuple], weights: dict[str, float]) -> list[float]:
    named = any(len(t) == 3 and t[1] == 1 for t in parts)
    out = []
    for t in parts:
        if len(t) == 2:
            out.append(weights.get("t:" + t[0], TAG))
            continue
        words = len(t[0].split())
        if not words:
            out.append(0.0)
        elif t[1] == 2:
            out.append(NEVER_WORD * words if not named else -0.01 * words)
        else:
            block, _, link = t[2].partition("|")
            weight = weights.get("w:" + t[2])
            if weight is None:
                weight = DEFAULT_WORDS.get(block, 0.1)
            weight = min(weight, -0.5) if link and weight <= 0 else weight
            if named or t[1] == 3:
                name = "card" if t[1] == 3 else "in" if t[1] == 1 else "out"
                weight += weights.get("n:" + name, NAMES[name])
            out.append(weight * words)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range [begin, end) of the largest sum, by one scan; the earliest of equals; (0, 0) if none is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks in page order, joined by one newline."""
    if not page:
        return ""
    parts = tokens(page)
    begin, end = best_region(_scores(parts, weights))
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if text := " ".join("".join(open_block).split()):
            blocks.append(text)
        open_block.clear()

    for t in parts[begin:end]:
        if len(t) == 2:
            if t[1]:
                close()
        elif t[1] != 2:
            open_block.append(t[0])
    close()
    return "\n".join(blocks)


def label_counts(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int = LABELLED_PAGES) -> dict:
    """Word and tag counts on at most ``limit`` labelled pages, those of the smallest key hash.

    Only keys meet in one place to choose the sample; pages are parsed where they are and counts come back,
    one number for each tag name and standing.
    """
    named = F.lower(F.col(html)).rlike(r"<(article|main)\b")
    chosen = (
        pages.filter(named).select(F.xxhash64(key).alias("h")).distinct().orderBy("h").limit(limit).collect()
    )
    if not chosen:
        return {}

    def count(frames):
        for frame in frames:
            seen: Counter = Counter()
            for page in frame["html"]:
                seen.update(count_labelled(page))
            yield pd.DataFrame([(*k, float(n)) for k, n in seen.items()], columns=["kind", "feature", "inside", "n"])

    sample = pages.filter(F.xxhash64(key).isin([r["h"] for r in chosen]) & named).select(F.col(html).alias("html"))
    rows = (
        sample.mapInPandas(count, "kind string, feature string, inside int, n double")
        .groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n")).collect()
    )
    return {(r["kind"], r["feature"], r["inside"]): r["n"] for r in rows}


def extract_pages(
    pages: DataFrame, weights: dict[str, float] | None = None, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per page: key, url, text, n_chars (code points). Weights are counted on the pages themselves unless given."""
    model = fit(label_counts(pages, key, html)) if weights is None else weights

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(lambda page: extract(page, model))

    rows = pages.select(F.col(key), F.col(url), text_of(F.col(html).cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
