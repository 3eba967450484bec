"""Main text of web pages: site templates are found by counting element subtrees per host, and removed.

Every page is parsed into elements. A subtree's hash covers its host, its tags, its marks (class, id and role) and its
text. Spark counts, for each subtree of a containing element (``div``, ``nav``, ``section``, lists, tables, ...), in how
many contexts it occurs, the context being the two longest pieces of text on the page outside the subtree. A menu or a
notice stands beside many different articles; the parts of an article that is repeated on a host stand beside the same
one each time, and so count once. A subtree with ``LEAST_PAGES`` contexts is template and is deleted, except what holds an
article (``article``, ``main``, ``h1``), what lies within one and isn't mostly links, and what is most of the page's text
other than links, unless it stands on most pages of its host. The least number doesn't grow with the host.

What doesn't recur, as on a host of few pages, is judged by its markup after that: elements that the page itself calls
menus, headers, footers, asides, forms, scripts, styles, and blocks whose class, id or role says advert, notice, comment
and the like go, and where the page names its article, the rest. Paragraphs and headings are never counted as template,
and what stands inside a sentence goes with the sentence, whatever its class.

Null and empty html, and pages without article text, give an empty text. Pages of one url, repeated rows and ties are all
kept; copies of a page are one context. A page without a host counts with others of the same kind. Columns besides those
named are ignored, whatever their names; an empty table gives no rows. Pages are read whole, however long. Found templates
go to pages by a join on a key of url and html, salted so that a page with very many copies is spread; nothing is collected.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialise

#: A subtree is template if it occurs in this many contexts on a host.
LEAST_PAGES = 5
#: Parts that pages of one key are dealt to.
SALTS = 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_DROP = _RAW | frozenset("head nav header footer aside form button select option svg canvas object video audio dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that can be a site's template.
_FRAME = frozenset("div section ul ol dl table nav header footer aside form figure center fieldset details".split())
#: Elements that the start of one of the second kind closes.
_CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_MARKED = re.compile(r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|cookies?|consent|notices?|popup|modal|comments?|disqus|respond|share|sharing|social|related|newsletter|subscribe|widget|pagination|pager)(?![a-z])")
#: Marks of a page's layout; on what holds most of its text they say where it lies, not what it is.
_LAYOUT = re.compile(r"(?<![a-z])(?:banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|share|sharing|social|widget|pagination|pager)(?![a-z])")
#: Marks that say what a page has or lacks.
_STATE = re.compile(r"(?<![\w-])(?:no|not|has|with|without|is|hide)-[\w-]+")
#: What marks inside an article don't tell against: its own header.
_OWN = re.compile("header")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']+)*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A tag that ends with its own slash, not with that of an unquoted value.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_SPACE = re.compile(r"\s+")
#: Elements nested deeper than this lie beside each other.
_DEPTH = 200


@dataclass(slots=True)
class Element:
    tag: str
    marks: str = ""
    role: str = ""
    children: list = field(default_factory=list)  # elements and strings
    #: Of the subtree, once measured: hash, places of its pieces of text, their characters, and those in links.
    hash: int = 0
    first: int = 0
    last: int = 0
    chars: int = 0
    links: int = 0


def parse(page: str) -> Element:
    """A tree of elements; tags that nothing opens are ignored, open ones end with what holds them."""
    top = Element("")
    open_ = [top]
    at, end = 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            open_[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        while (closed := _CLOSED_BY.get(open_[-1].tag)) and tag in closed:
            open_.pop()
        if tag == "p":  # a paragraph left open inside inline elements ends here, too
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    del open_[k:]
                elif open_[k].tag not in _INLINE:
                    break
        element = Element(tag)
        if m[3] and "=" in m[3]:
            found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])}
            element.marks = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
            element.role = found.get("role", "").lower()
        open_[-1].children.append(element)
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            element.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in _VOID and not _CLOSED.search(m[3]) and len(open_) < _DEPTH:
            open_.append(element)
    if at < end:
        open_[-1].children.append(page[at:])
    return top


def holds(e: Element, tags: tuple[str, ...]) -> bool:
    return any(isinstance(c, Element) and (c.tag in tags or holds(c, tags)) for c in e.children)


def own_text(e: Element, link: bool = False) -> int:
    """Characters of a subtree's text other than links, and what is never shown."""
    if e.tag in _RAW or e.tag == "head":
        return 0
    link = link or e.tag in ("a", "button")
    return sum(own_text(c, link) if isinstance(c, Element) else 0 if link else len(c.strip()) for c in e.children)


def mostly(e: Element, root: Element) -> bool:
    """Whether an element holds most of a page's own text."""
    if not root.chars:
        root.chars = own_text(root)
    return 2 * own_text(e) > root.chars


def dropped(e: Element, inside: bool, amid: bool, root: Element) -> bool:
    """Whether the markup says that an element is no part of an article; marks don't count on what holds the article.

    ``inside`` an article its own header stays; ``amid`` text of its parent an inline element is part of that. A form around
    an article, or around most of the page's text, stays, and so does what is marked as layout but holds most of the text.
    """
    if e.tag == "form" or e.role == "form":
        return not holds(e, ("article", "main")) and not mostly(e, root)
    if e.tag in _DROP and not (inside and e.tag == "header") or e.role in _ROLES:
        return True
    if not e.marks or e.tag in ("html", "body", "article", "main") or amid and e.tag in _INLINE:
        return False
    marks = _STATE.sub("", _OWN.sub("", e.marks) if inside else e.marks)
    if not _MARKED.search(marks) or holds(e, ("article", "main")):
        return False
    return bool(_MARKED.search(_LAYOUT.sub("", marks))) or not mostly(e, root)


def measure(host: str, top: Element) -> list[tuple[int, int]]:
    """Fills in what is measured of all elements; lengths and hashes of the page's pieces of text, in order."""
    pieces: list[tuple[int, int]] = []
    salt = xxhash.xxh64_digest(host.encode("utf-8", "replace"))

    def walk(e: Element, link: bool) -> bytes:
        parts = [salt, e.tag.encode(), e.marks.encode(), e.role.encode()]
        e.first = len(pieces)
        link = link or e.tag in ("a", "button")
        for c in e.children:
            if isinstance(c, Element):
                parts.append(walk(c, link))
                e.chars += c.chars
                e.links += c.links
            else:
                text = _SPACE.sub(" ", c).strip().encode("utf-8", "replace")
                parts.append(text)
                if text and e.tag not in _RAW:
                    pieces.append((len(text), xxhash.xxh64_intdigest(text)))
                    e.chars += len(text)
                    e.links += len(text) if link else 0
        e.last = len(pieces)
        digest = xxhash.xxh64_digest(b"\0".join(parts))
        e.hash = int.from_bytes(digest, "big", signed=True)
        return digest

    walk(top, False)
    return pieces


def subtrees(host: str, page: str) -> set[tuple[int, int]]:
    """Hashes of the subtrees that can be template, each with that of its context."""
    top = parse(page)
    pieces = measure(host, top)
    longest = sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i))
    out: set[tuple[int, int]] = set()

    def walk(e: Element) -> None:
        for c in e.children:
            if isinstance(c, Element):
                if c.tag in _FRAME:
                    outside = itertools.islice((pieces[i][1] for i in longest if not c.first <= i < c.last), 2)
                    out.add((c.hash, xxhash.xxh64_intdigest(repr(list(outside))) - (1 << 63)))
                walk(c)

    walk(top)
    return out


def without(e: Element, template: dict[int, bool], whole: int, inside: bool = False) -> None:
    """Deletes template subtrees, given with whether they stand on most pages; ``whole`` is the page's text other than links."""
    kept: list = []
    for c in e.children:
        if isinstance(c, Element):
            if c.tag in _FRAME and (common := template.get(c.hash)) is not None and not holds(c, ("article", "main", "h1")):
                if 2 * c.links > c.chars or not inside and (common or 2 * (c.chars - c.links) <= whole):
                    kept.append(Element("hr"))  # what stood on either side doesn't become one block
                    continue
            without(c, template, whole, inside or c.tag in ("article", "main"))
        kept.append(c)
    e.children = kept


def blocks(top: Element, marks: bool = True, root: Element | None = None) -> list[str]:
    """Texts of the blocks that stay, in page order, of a page or of parts of the page ``root``."""
    root = root or top
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held)).replace("\xa0", " ")).strip()
            if text:
                out.append(text)
            held.clear()

    def walk(e: Element, inside: bool) -> None:
        amid = any(isinstance(c, str) and not c.isspace() for c in e.children)
        for c in e.children:
            if not isinstance(c, Element):
                held.append(c)
            elif c.tag == "br":
                held.append(" ")
            elif c.tag in _RAW or c.tag == "head" or marks and dropped(c, inside, amid, root):
                if c.tag not in _INLINE and c.tag not in _RAW:
                    flush()
            elif c.tag in _INLINE:
                walk(c, inside)
            else:
                flush()
                walk(c, inside or c.tag in ("article", "main"))
                flush()

    walk(top, False)
    flush()
    return out


def articles(e: Element, root: Element) -> list[Element]:
    """The outermost article or main elements that aren't inside something dropped."""
    found: list[Element] = []
    for c in e.children:
        if isinstance(c, Element) and not dropped(c, False, False, root):
            found.extend([c] if c.tag in ("article", "main") else articles(c, root))
    return found


def text_of(host: str, page: str, template: dict[int, bool] | None = None, marks: bool = True) -> str:
    """Text of a page; without ``marks`` only the template decides, and what is never shown."""
    top = parse(page)
    if template:
        measure(host, top)
        without(top, template, top.chars - top.links)
        top.chars = 0
    whole = Element("", children=found) if marks and (found := articles(top, top)) else top
    return "\n".join(blocks(whole, marks, top))


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Of rows (host, hash, key, context): hashes of the subtrees that recur in many contexts, and whether on most pages of their host."""
    contexts = found.select("host", "hash", "context").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    pages = found.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return contexts.join(pages, "host").select("hash", (F.col("n") * 2 > F.col("pages")).alias("common"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", marks: bool = True, **how) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("key", F.xxhash64("url", "html"))

    def spread(batches):
        for batch in batches:
            rows = []
            for k, u, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                host = host_of(u)
                number = xxhash.xxh64_intdigest(host.encode("utf-8", "replace")) - (1 << 63)
                rows += [(k, number, *r) for r in subtrees(host, page or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["key", "host", "hash", "context"])

    found = materialise(named.select("key", "url", "html").mapInArrow(spread, "key long, host long, hash long, context long"), "subtrees")
    met = found.select("key", "hash").join(templates(found, **how), "hash").groupBy("key").agg(F.collect_set(F.struct("hash", "common")).alias("met"))
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))

    def cut(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            texts = [text_of(host_of(u), page or "", {r["hash"]: r["common"] for r in own or ()}, marks) for u, page, own in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return salted.join(met, ["key", "salt"], "left").select("page_id", "url", "html", "met").mapInArrow(cut, schema)
