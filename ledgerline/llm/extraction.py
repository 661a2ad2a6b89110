"""The main text of web pages, without what their site repeats.

Every page is read into a tree, and every element gets a hash of its subtree. Spark counts, for each host, on how many pages of
different main text a subtree stands; those on ``MANY_PAGES`` (a number, whatever the size of the host) are the site's template,
and are deleted. Within a main part or article that is not enough, as texts repeat sections of their own: there a subtree must
also stand on ``MOST_PERCENT`` of the host's pages of different text, and paragraphs, headings and the like are never template.

Deleted too are elements that are no article by their tag, role, or a class or id. Classes and ids count as whole names, never by
a word within one; within a main part or article only names of adverts, comments and share bars count.

What is left of the page's main parts and of articles outside them is the text: a line for each block. Without main parts it is
the smallest element that holds all articles (of a lone article, what it stands in), and without articles the page. Copies of a page count once.

Defined cases: NULL html is empty, and an empty page has an empty text; a page whose host can't be told has no template; rows
that share a page_id are told apart by their html; equal rows give equal rows; unclosed, misnested and unknown tags are read as
browsers do in the common cases, in time that grows with the page however deep it is nested; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Set
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, pieces, sized

MANY_PAGES = 5
MOST_PERCENT = 50

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr "
    "ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li option tbody tfoot thead tr".split())
CLOSED_BY_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}
HOLDS_P = frozenset("table td th caption button object template html body".split())
DROPPED = frozenset(
    "audio button canvas datalist dialog embed footer form head iframe input aside menu nav noembed noframes noscript object "
    "script select style svg template textarea title video xmp".split())
MARKED = frozenset("div section ul ol dl table p span a ins figure header main details small".split())
# Names of classes and ids, as a whole: what is no article anywhere, and what is none outside a main part or article.
_PLACE = r"(?:(?:site|page|top|bottom|left|right|main|global|sticky)-)?"
_BOX = r"(?:-(?:box|bar|bars|block|area|section|container|wrap|wrapper|inner|list|links|buttons|widget|slot|unit|banner|[0-9]+))*"
_EXPLICIT = (
    r"ads?|adverts?|advertisement|advertising|adsense|sponsored|comments?|comment-?list|comment-form|comments-area|disqus|"
    r"disqus-thread|respond|replies|share|sharing|share-this|social-share|social-sharing|social-links|social-media|newsletter")
_OUTSIDE = (
    r"sponsors?|promos?|promotions?|banner|cookies?|cookie-(?:notice|consent|law|policy)|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"subscribe|subscription|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|social|related|"
    r"related-(?:posts|articles|links)|recommended|recommendations|pagination|pager|login|signup|search|search-form|skip-?link|"
    r"toolbar|topbar|site-?header|page-?header|site-?footer|page-?footer")
EXPLICIT = re.compile(rf"{_PLACE}(?:{_EXPLICIT}){_BOX}")
NO_ARTICLE = re.compile(rf"{_PLACE}(?:{_EXPLICIT}|{_OUTSIDE}){_BOX}")
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
IN_ARTICLE = frozenset("address aside details div dl figure footer form header menu nav ol section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|</([a-zA-Z][^\s/<>]*)[^<>]*>"
    r"|<([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b")
SPACE = re.compile(r"[ \t-\r]+")


class Element:
    __slots__ = ("tag", "attributes", "children", "parent", "is_main", "within", "holds", "hash", "has_text")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.is_main = tag == "main" or ("main" in attributes and MAIN_ROLE.search(attributes) is not None)
        self.within = parent is not None and (parent.within or parent.is_main or parent.tag == "article")
        self.holds = False  # an article or main part
        self.hash, self.has_text = 0, False


def _close(element: Element) -> None:
    """Hashes a subtree whose parts are complete."""
    parts = [element.tag]
    for child in element.children:
        if isinstance(child, str):
            text = SPACE.sub(" ", child).strip()
            if text:
                parts.append(text)
                element.has_text = True
        else:
            parts.append(f"\x00{child.hash:x}")
            element.has_text |= child.has_text
            element.holds |= child.holds or child.is_main or child.tag == "article"
    element.hash = xxhash.xxh3_64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass"))


def parse(html: str) -> Element:
    """The page as a tree; the root has no tag."""
    root = Element("", "", None)
    stack = [root]
    depths: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag are open
    open_blocks: list[int] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            if stack:
                depths[element.tag].pop()
                if element.tag in BLOCKS:
                    open_blocks.pop()
            _close(element)

    def deepest(tags) -> int:
        return max((depths[tag][-1] for tag in tags if depths.get(tag)), default=0)

    def last(tags, within) -> int:
        """The depth of the last open element of ``tags``, 0 if there is none or one of ``within`` was opened after it."""
        depth = deepest(tags)
        return depth if depth > deepest(within) else 0

    at = 0
    while found := TOKEN.search(html, at):
        if found.start() > at:
            stack[-1].children.append(unescape(html[at : found.start()]))
        at = found.end()
        if found[2]:
            tag = found[2].lower()
            if tag in CLOSES_P and (depth := last({"p"}, HOLDS_P)):
                close_to(depth)
            if tag in CLOSED_BY_LIKE and (depth := last(*CLOSED_BY_LIKE[tag])):
                close_to(depth)
            element = Element(tag, found[3], stack[-1])
            stack[-1].children.append(element)
            if tag in VOID:
                _close(element)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                element.children.append(html[at : end.start()])
                _close(element)
                at = end.end()
            else:
                depths[tag].append(len(stack))
                if tag in BLOCKS:
                    open_blocks.append(len(stack))
                stack.append(element)
        elif found[1]:
            tag = found[1].lower()
            depth = deepest((tag,))
            if depth and (tag in BLOCKS or not open_blocks or depth > open_blocks[-1]):
                close_to(depth)
        elif found[0].startswith("<![CDATA["):
            stack[-1].children.append(found[0][9:].removesuffix("]]>"))
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    close_to(0)
    return root


def _is_no_article(element: Element) -> bool:
    tag = element.tag
    if tag in DROPPED:
        return True
    if tag == "header" and not element.within and not element.holds:
        return True
    if not element.attributes or element.holds:
        return False
    given = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(element.attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return True
    if given.get("role") in ROLES:
        return True
    if tag in MARKED or tag == "article":
        names = f"{given.get('class', '')} {given.get('id', '')}".replace("_", "-").split()
        return any((EXPLICIT if element.within else NO_ARTICLE).fullmatch(name) for name in names)
    return False


def _inner(roots: list[Element], dropped) -> Iterator[Element | str | None]:
    """The parts below the roots in page order, None after an element's last; without what is dropped."""
    stack: list = list(reversed(roots))
    while stack:
        part = stack.pop()
        if isinstance(part, Element):
            if dropped(part):
                continue
            yield part
            stack.append((part,))
            stack.extend(reversed(part.children))
        elif isinstance(part, tuple):
            yield None if part[0].tag not in BLOCKS else part
        else:
            yield part


def _roots(elements: list[Element]) -> list[Element]:
    """Of elements in page order the outermost main parts and articles; without main parts what holds all articles."""
    covered: set[int] = set()  # elements that are in a root, or are one
    roots = []
    for element in elements:
        if id(element.parent) in covered:
            covered.add(id(element))
        elif element.tag == "article" or element.is_main:
            covered.add(id(element))
            roots.append(element)
    if not roots or any(element.is_main for element in roots):
        return roots
    held = dict.fromkeys(map(id, roots), 0)
    for article in roots:
        held[id(article.parent)] = held.get(id(article.parent), 0) + 1
    for element in reversed(elements):  # what an element holds comes before it
        if held.get(id(element)) == len(roots):
            return [element]
        if id(element) in held and element.parent is not None:
            held[id(element.parent)] = held.get(id(element.parent), 0) + held[id(element)]
    return []


def main_text(root: Element, template: Set[int] = frozenset(), everywhere: Set[int] = frozenset()) -> str:
    """The blocks of the page's main parts or articles, joined by line ends; without subtrees of the site's ``template``, and
    in main parts and articles without those that stand ``everywhere``."""
    def dropped(element: Element) -> bool:
        repeated = everywhere if element.within else template
        return _is_no_article(element) or (element.hash in repeated and _may_be_template(element))

    roots = _roots([part for part in _inner([root], dropped) if isinstance(part, Element)]) or [root]
    blocks, line = [], []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(line)).strip(" ")
        if text:
            blocks.append(text)
        line.clear()

    for part in _inner(roots, dropped):
        if isinstance(part, str):
            line.append(part)
        elif isinstance(part, tuple):
            flush()
        elif part is not None:
            if part.tag in BLOCKS:
                flush()
            elif part.tag in ("br", "td", "th"):
                line.append(" ")
    flush()
    return "\n".join(blocks)


def _may_be_template(element: Element) -> bool:
    if not element.has_text or element.holds or element.is_main or element.tag in ("", "html", "body", "article"):
        return False
    return not element.within or element.tag in IN_ARTICLE


def template_candidates(root: Element) -> set[int]:
    """The hashes of the subtrees that may be template."""
    return {part.hash for part in _inner([root], lambda element: element.tag in ("head", *RAW))
            if isinstance(part, Element) and _may_be_template(part)}


def host_of(url: Column) -> Column:
    """NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        hashes, bodies = [], []
        for html in batch.column("html").to_pylist():
            root = parse(html or "")
            hashes.append([h - (1 << 64) if h >> 63 else h for h in sorted(template_candidates(root))])
            body = xxhash.xxh3_64_intdigest(main_text(root).encode("utf-8", "surrogatepass"))
            bodies.append(body - (1 << 64) if body >> 63 else body)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("html_hash"), batch.column("host"),
             pa.array(hashes, pa.list_(pa.int64())), pa.array(bodies, pa.int64())],
            ["page_id", "html_hash", "host", "hashes", "body"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = []
        columns = (batch.column(name).to_pylist() for name in ("html", "template", "everywhere"))
        for html, *repeated in zip(*columns, strict=True):
            texts.append(main_text(parse(html or ""), *({h % (1 << 64) for h in hashes or ()} for hashes in repeated)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def site_templates(pages: DataFrame) -> DataFrame:
    """``page_id``, ``html_hash``, ``template`` (hashes of the page's subtrees that its host repeats), ``everywhere`` (of those on
    most of its pages)."""
    keyed = pages.select("page_id", F.xxhash64("html").alias("html_hash"), host_of(F.col("url")).alias("host"), "html")
    trees = cut(keyed.mapInArrow(
        _subtrees, "page_id long, html_hash long, host string, hashes array<long>, body long").filter("host is not null"))
    rows = trees.select("page_id", "html_hash", "host", "body", F.explode("hashes").alias("hash"))
    once = rows.groupBy("host", "hash", "body").agg(F.count("*").alias("n"))
    counted = once.groupBy("host", "hash").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MANY_PAGES)
    hosts = trees.groupBy("host", "body").agg(F.count("*").alias("n")).groupBy("host").agg(F.count("*").alias("all_pages"))
    everywhere = (F.col("pages") * 100 >= F.col("all_pages") * MOST_PERCENT).alias("everywhere")
    repeated = sized(cut(counted.join(hosts, "host").select("host", "hash", everywhere)))
    return rows.join(repeated, ["host", "hash"]).groupBy("page_id", "html_hash").agg(
        F.collect_set("hash").alias("template"), F.collect_set(F.when(F.col("everywhere"), F.col("hash"))).alias("everywhere"))


def extracted(pages: DataFrame) -> DataFrame:
    """A row for each page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    pages = pages.select("page_id", "url", "html")
    templates = site_templates(pages).select(F.col("page_id").alias("of"), F.col("html_hash").alias("of_hash"), "template", "everywhere")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.xxhash64("html") == F.col("of_hash"))
    return pages.join(templates, same, "left").select("page_id", "url", "html", "template", "everywhere").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
