"""Main text of web pages by consensus of their hosts.

Every page votes for the container that holds most of its article: each element is scored by the text of its blocks, the element
that holds most of them is taken, and its path of tags and classes is generalised (two digits and more become #). Spark counts the votes of
each host and path, and every page is read again with the path that won on its host; a page without an element of that path is
read with its own container. What menus, forms, adverts, comments and the like hold is never text, by tag, role, class or id.

Blocks are what block elements and their edges part; <br> is white space inside a block. White space is what Unicode says it is.

Defined results: a null or empty html has no text; a null url or one without host votes with the others of host ''; ties of
votes go to the deeper path, then to the smaller one; repeated rows vote and are read one by one; malformed markup is read as
far as it goes (an open tag at the end is dropped, unclosed elements end with their parent); an empty table gives an empty
result; other columns are passed through whatever their names.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm._common import free_name, written

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p "
    "pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("applet aside audio button canvas dialog embed footer form frame frameset head iframe input label math menu meta nav noembed noframes noscript object script select style svg template textarea title video xmp".split())
CLOSES_P = BLOCK - {"option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag ends an open element of the same kind, up to the element that holds such parts.
PARTS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
NONE: tuple = ((), ())
PARTS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in PARTS.items()}
#: Words in classes, ids and roles of what is no article; a name is cut at anything but letters, and where a capital follows.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners alert alerts announcement billboard breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies "
    "copyright dfp disclaimer discussion disqus dropdown footer footers foot form forms gdpr header headers hidden legal login lightbox masthead menu menus menubar modal nav navbar navi navigation "
    "navs newsletter notice notices notification notifications offcanvas outbrain pager pagination paywall popup popups prefooter privacy promo promos promoted promotion recommendations recommended related "
    "replies reply respond responses rss search share sharing shares shoutbox sidebar sidebars sidenav signin signup skip skyscraper social sponsor sponsored sponsors subnav subscribe subscription taboola "
    "teaser teasers toolbar tooltip topbar toolbox trending warning widget widgets".split()
)
#: Those that count for headings and article elements too.
STRONG = frozenset("ad ads advert advertisement comment comments cookie footer menu nav promo related reply sidebar sponsored teaser".split())
#: Words for the article, for what may be around it, and for what says only how a page is laid out ("has-sidebar").
ARTICLE = frozenset("article body content entry main page post site story text".split())
WRAPPERS = frozenset("area container holder layout outer page wrap wrapper".split())
MODIFIERS = frozenset("has is no not with without".split())
#: End tags of the second kind close nothing outside of an element of the first kind.
FENCES, FENCED = frozenset("article body main table td th".split()), frozenset("a b em i li p span strong".split())
NAMED = re.compile(r"\.(?:\w+[-_])?(?:article|post|entry|story|content)(?:[-_](?:body|text|content))?(?![\w-])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'<])*?)(>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKED = re.compile(r"\b(?:class|id|role|itemprop|style|hidden)\b", re.IGNORECASE)
MARKS = ("class", "id", "role", "itemprop", "style", "hidden", "aria-hidden")


INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var".split())


class Element:
    """An element: parts are its text runs and elements in order, name its tag with its generalised classes (or id), off
    whether it is no article, inner whether it stands in an article element, chars what can be read in it."""

    __slots__ = ("chars", "inner", "name", "off", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: Element | None, name: str = "", off: bool = False) -> None:
        self.tag, self.parent, self.name, self.off, self.parts, self.chars = tag, parent, name or tag, off, [], 0
        self.inner = parent is not None and (parent.inner or parent.tag in ("article", "main"))

    def path(self) -> list[str]:
        names, here = [], self
        while here.parent:
            names.append(here.name)
            here = here.parent
        return names[::-1]


def _boilerplate(name: str, among: frozenset[str]) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in MODIFIERS or words[-1] in WRAPPERS and ARTICLE.intersection(words):
        return False
    return not among.isdisjoint(words)


def _start(tag: str, attributes: str, parent: Element) -> Element:
    """The element that a start tag opens."""
    off = parent.off or tag in NEVER or tag == "header" and not (parent.inner or parent.tag in ("article", "main"))
    found = {k.lower(): html_.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes) if k.lower() in MARKS} if MARKED.search(attributes) else {}
    if not found:
        return Element(tag, parent, off=off)
    classes, own = found.get("class", "").split(), found.get("id", "")
    name = tag + "".join(f".{c}" for c in sorted({re.sub(r"\d{2,}", "#", c) for c in classes}))
    if not classes and own:
        name += "#" + re.sub(r"\d{2,}", "#", own)
    if not off and tag not in ("html", "body"):
        among = STRONG if tag in ("article", "main", "h1", "h2", "h3", "h4", "h5", "h6") else BOILERPLATE
        off = any(_boilerplate(n, among) for n in (*classes, own, *found.get("role", "").split(), found.get("itemprop", "")))
        off = off or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    return Element(tag, parent, name, off)


def parse(html: str) -> list[Element]:
    """The elements of html in the order of their start tags, after the root."""
    here = Element("", None)
    all_, at, n = [here], 0, len(html)
    opened: dict[str, int] = dict.fromkeys(("p", *PARTS), 0)

    def back_to(there: Element) -> None:
        nonlocal here
        while here is not there:
            opened[here.tag] -= 1
            here = here.parent

    while at < n:
        found = TAG.search(html, at)
        if found is None:
            here.parts.append(html[at:])
            break
        start, stop = found.span()
        if start > at:
            here.parts.append(html[at:start])
        closing, tag, attributes, whole = found.groups()
        at = stop
        if not tag or not whole:
            continue
        tag = tag.lower()
        if closing:
            there = here
            if opened.get(tag):
                while there.tag != tag and not (tag in FENCED and there.tag in FENCES):
                    there = there.parent
                if there.tag == tag:
                    back_to(there.parent)
            continue
        if tag in CLOSES_P and opened["p"]:
            there = here
            while there.tag in INLINE:
                there = there.parent
            if there.tag == "p":
                back_to(there.parent)
        ends, holders = PARTS.get(tag, NONE)
        while ends and any(opened[x] for x in ends):
            there = here
            while there.parent and there.tag not in ends and there.tag not in holders:
                there = there.parent
            if there.tag not in ends:
                break
            back_to(there.parent)
        new = _start(tag, attributes, here)
        here.parts.append(new)
        all_.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            here = new
            opened[tag] = opened.get(tag, 0) + 1
    return all_


def blocks(element: Element) -> Iterator[tuple[str, Element, int]]:
    """Text, innermost block element and characters inside links of every block of element, in order."""
    run: list[str] = []
    holder, linked = element, 0
    stack: list[tuple[Element, Iterator, bool]] = [(element, iter(element.parts), element.tag == "a")]
    while True:
        here, parts, link = stack[-1]
        edge = there = None
        for part in parts:
            if isinstance(part, str):
                run.append(part)
                linked += len(part) if link else 0
            elif part.tag == "br":
                run.append("\n")
            elif part.tag in BLOCK:
                edge = there = part
                break
            elif not part.off:
                there = part
                break
        else:
            stack.pop()
            edge = here if here.tag in BLOCK or not stack else None
        if edge and run:
            text = "".join(run)
            if text := " ".join((html_.unescape(text) if "&" in text else text).split()):
                yield text, holder, min(linked, len(text))
            run.clear()
            linked = 0
        if there is None:
            if not stack:
                return
            if here.tag in BLOCK:
                holder = here.parent or element
        elif not there.off:
            if edge:
                holder = there
            stack.append((there, iter(there.parts), link or there.tag == "a"))


def _readable(text: str, linked: int) -> int:
    """How much a block counts for its container: nothing if half of it is links."""
    return 0 if 2 * linked > len(text) else len(text)


def _done(all_: list[Element]) -> None:
    """Take the tree apart, so that it goes without a search for cycles."""
    for e in all_:
        e.parts = e.parent = None


def container(all_: list[Element]) -> Element | None:
    """The deepest element that holds most of what can be read on the page, or the article element around it, or one
    named like an article that holds little more."""
    for text, holder, linked in blocks(all_[0]):
        holder.chars += _readable(text, linked)
    for e in reversed(all_[1:]):
        e.parent.chars += e.chars
    total = all_[0].chars
    holding = [e for e in all_[1:] if 10 * e.chars >= 6 * total > 0 and e.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", *INLINE)]  # from the outside in
    if not holding:
        return None
    articles = [e for e in holding if e.tag == "article"] or [e for e in holding if NAMED.search(e.name) and 20 * e.chars <= 23 * holding[-1].chars]
    return (articles or holding)[-1]


def _at(root: Element, path: list[str]) -> list[Element]:
    """The elements of that path, in the order of the page."""
    level = [root]
    for name in path:
        level = [p for e in level for p in e.parts if not isinstance(p, str) and p.name == name and not p.off]
    return level


def main_text(html: str | None, path: str | None) -> str:
    """The text of the page's elements of that path, or of its own container if it has none with text."""
    all_ = parse(html or "")
    found = [text for e in _at(all_[0], path.split("/")) for text, _, _ in blocks(e)] if path else []
    if not found:
        found = [text for text, _, _ in blocks(container(all_) or all_[0])]
    _done(all_)
    return "\n".join(found)


def host(url: Column) -> Column:
    """What follows the first :// of a url up to a slash, question mark or hash, A-Z lower-cased; '' without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path and depth of the container that each page (host, html) votes for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ = parse(text.as_py() or "")
                if best := container(all_):
                    path = best.path()
                    rows.append((at, "/".join(path), len(path)))
                _done(all_)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32()))], ["host", "path", "depth"])

    return pages.mapInArrow(run, "host string, path string, depth int")


def consensus(pages: DataFrame) -> DataFrame:
    """The path of most votes of every host of pages (host, html)."""
    counted = votes(pages).groupBy("host", "path", "depth").agg(F.count("*").alias("n"))
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("depth")).alias("depth"), "path")).alias("best"))
    return best.select("host", "best.path")


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """df without its html, with a struct column ``page`` (underscores follow if the name is taken): text and n_chars."""
    at, name = free_name(df, "host"), free_name(df, "page")
    rows = df.withColumn(at, host(F.col(f"`{url}`")))
    paths = written(consensus(rows.select(F.col(f"`{at}`").alias("host"), F.col(f"`{html}`").alias("html"))), "paths")
    won = free_name(rows, "path")
    joined = rows.join(paths.select(F.col("host").alias(at), F.col("path").alias(won)), at, "left").drop(at)
    kept = [f for f in joined.schema.fields if f.name not in (html, won)]
    body, path = joined.columns.index(html), joined.columns.index(won)
    names = [*(f.name for f in kept), name]
    kind = T.StructType([*kept, T.StructField(name, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(text.as_py(), p) for text, p in zip(batch.column(body), batch.column(path).to_pylist(), strict=True)]
            page = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["text", "n_chars"])
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i not in (body, path)), page], names)

    return joined.mapInArrow(run, kind)
