"""Main text of web pages: site templates are found by counting, the rest of the page furniture by its markup.

Every page is parsed once (once more if furniture seems to hold all of its articles) and the subtrees of its
elements are hashed.  Spark counts on how many pages of a host each subtree stands; subtrees on many of them
are the site's template (menus, footers, slogans, boxes), and the blocks inside are deleted.  Counting cannot
tell for hosts of few pages and for furniture that differs from page to page (adverts, reader comments), so
what is left goes through the markup: elements that are furniture by tag, role or class go, and if the page
has an article (or main), what stands outside goes.

Pages of a host with the same main text count once, so copies of a page are no template of the host.  What
holds an article, the paragraphs, headings and lists of an article, what holds these, and what holds most of
its text are never taken for a template, however often they recur: copies of an article stay whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: A subtree is a template from this many pages and this share of the host's pages on.
MIN_PAGES = 3
MIN_SHARE = 0.01
#: Numbers in a table of templates that is sent to all tasks, at most (8 bytes each, and host names).
BROADCAST = 1 << 20

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""[^>"']*""")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul button label hr".split()
)
_FURNITURE = frozenset("nav footer aside form head select option button label fieldset dialog menu search input".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of an article that hold its text; only other elements there can be templates.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li ul ol dl dt dd table thead tbody tfoot tr caption figcaption figure article main body html".split())
_P = frozenset(["p"])
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_LIMIT = frozenset("ul ol dl table body html div section article main nav aside header footer form blockquote".split())
_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments replies reply disqus respond discussion toolbar widget widgets search skip copyright".split()
)
#: A class name with one of these words says what the element is beside, or what it lacks.
_BESIDE = frozenset("no not non without with has have hide hidden".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "up", "drop", "hash", "kids", "article", "holds", "first", "stop")

    def __init__(self, tag: str, up: int, drop: bool, article: bool) -> None:
        self.tag, self.up, self.drop, self.article = tag, up, drop, article
        self.kids: list[bytes] = []
        self.hash = self.first = self.stop = 0
        self.holds = False

    def candidate(self) -> bool:
        """Whether the subtree may be a template."""
        return bool(self.kids) and not self.holds and not (self.article and self.tag in _PROSE) and self.tag not in ("html", "body")


def _furniture(tag: str, attrs: str, named: bool = True) -> bool:
    """Whether the markup says so; by class or id only where ``named``."""
    if tag in _FURNITURE:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in _ROLES:
            return True
        if named and name in ("class", "id") and tag != "main":
            for words in map(_SPLIT.split, value.split()):
                if not _WORDS.isdisjoint(words) and _BESIDE.isdisjoint(words):
                    return True
    return False


def tokens(page: str):
    """Yield (kind, text, attributes): "text" with its text, "open" and "close" with the tag.

    Comments, declarations and the contents of scripts and the like are left out.  Every character is looked at a
    fixed number of times.  A ">" in quotes does not end a tag; once quotes are found to be unbalanced up to the
    end of the page, tags end at their first ">".
    """
    at, start, quotes = 0, 0, True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            kind, tag, attrs, at_next = None, "", "", end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            kind, tag, attrs, at_next = "text", html.escape(page[lt + 9 : end if end >= 0 else len(page)]), "", end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            kind, tag, attrs, at_next = None, "", "", end + 1 if end >= 0 else len(page)
        elif m := _NAME.match(page, lt):
            end = i = m.end()
            while quotes:
                end = _QUOTED.match(page, i).end()
                if end == len(page):
                    quotes = False
                elif page[end] == ">":
                    break
                else:
                    i = page.find(page[end], end + 1) + 1
                    quotes = i > 0
            if not quotes:
                end = page.find(">", m.end())
                if end < 0:
                    break  # no tag ends any more: the rest is text
            kind, tag, attrs, at_next = "close" if m[1] else "open", m[2].lower(), page[m.end() : end], end + 1
            if kind == "open" and tag in _RAW:
                stop = _RAW[tag].search(page, at_next)
                end = page.find(">", stop.end()) if stop else -1
                kind, tag, at_next = "text", " ", end + 1 if end >= 0 else len(page)
        else:
            at = lt + 1
            continue
        if start < lt:
            yield "text", page[start:lt], ""
        if kind:
            yield kind, tag, attrs
        at = start = at_next
    if start < len(page):
        yield "text", page[start:], ""


def parse(page: str, spare: frozenset[int] = frozenset()) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order, and blocks of text as (element, text).  Those in ``spare`` are no furniture by name."""
    nodes = [Node("#page", -1, False, False)]
    stack = [0]
    standing: Counter[str] = Counter()  # open elements by tag
    blocks: list[tuple[int, str]] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1], text))
                nodes[stack[-1]].kids.append(text.encode("utf-8", "surrogatepass"))

    def close(depth: int):
        while len(stack) > depth:
            n = nodes[stack.pop()]
            n.stop = len(blocks)
            standing[n.tag] -= 1
            if n.kids:
                digest = hashlib.blake2b(b"\0".join([n.tag.encode("utf-8", "surrogatepass"), *n.kids]), digest_size=8).digest()
                n.hash = int.from_bytes(digest, "big", signed=True)
                nodes[stack[-1]].kids.append(digest)

    for kind, tag, attrs in tokens(page):
        if kind == "text":
            held.append(tag)
            continue
        end = kind == "close"
        if tag not in _BLOCKS and not (tag in ("span", "b", "i", "a", "em", "strong", "font", "u") and not end and _furniture(tag, attrs)):
            open_inline = end and any(nodes[i].tag == tag for i in stack[-4:])
            if not open_inline:
                if tag in ("br", "td", "th", "img"):
                    held.append(" ")
                continue
        flush()
        if tag in ("hr", "input"):
            continue
        if end:
            if standing[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close(depth)
                        break
            continue
        shut = _CLOSED_BY.get(tag, _P) | (_HEADINGS if tag in _HEADINGS else _P) | _P
        if any(standing[t] for t in shut):
            for depth in range(len(stack) - 1, 0, -1):
                t = nodes[stack[depth]].tag
                if t in shut:
                    close(depth)
                    break
                if t in _LIMIT:
                    break
        up = nodes[stack[-1]]
        drop = up.drop or _furniture(tag, attrs, len(nodes) not in spare)
        if tag == "header":
            drop = True
        elif up.tag == "header" and up.article and tag in _HEADINGS:
            drop = nodes[up.up].drop  # the headline of an article stands in its header
        nodes.append(Node(tag, stack[-1], drop, up.article or tag in ("article", "main")))
        nodes[-1].first = len(blocks)
        standing[tag] += 1
        if tag in ("article", "main"):
            for i in reversed(stack):
                if nodes[i].holds:
                    break  # and so do all above it
                nodes[i].holds = True
        stack.append(len(nodes) - 1)
    flush()
    close(1)
    return nodes, blocks


def read(page: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int]]]:
    """Blocks of visible text, each with whether markup keeps it; template candidates as (hash, first block, stop)."""
    nodes, blocks = parse(page)
    main = [i for i, n in enumerate(nodes) if n.tag in ("article", "main")]
    if main and all(nodes[i].drop for i in main):  # a name on the page's main part, or on what holds it
        nodes, blocks = parse(page, frozenset(i for i, n in enumerate(nodes) if n.holds or n.tag in ("article", "main")))
    kinds = {n.tag for n in nodes if not n.drop}
    want = "article" if "article" in kinds else "main" if "main" in kinds else None
    inside, size = [want is None] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        inside[i] = inside[n.up] or n.tag == want
    keeps = [inside[i] and not nodes[i].drop for i, _ in blocks]
    for (i, text), keep in zip(blocks, keeps):
        if keep:
            size[i] += len(text)
    total = sum(size)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        size[n.up] += size[i]
        if n.article and size[i]:  # what holds prose of an article, or most of its text, is the article's
            n.holds |= 2 * size[i] > total
            if n.holds or n.tag in _PROSE:
                nodes[n.up].holds = True
    return [(text, keep) for (_, text), keep in zip(blocks, keeps)], [(n.hash, n.first, n.stop) for n in nodes[1:] if n.candidate()]


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_markup: one row for each row of pages.

    n_template: blocks of text that are the site's, by counting; n_markup: other blocks that went by their
    markup.  With ``markup`` false nothing goes by markup.  Null or empty html has an empty text.  A page whose
    url is null or names no host shares its templates with the others of that kind.  Pages of a host with the
    same main text, templates included, count as one page, and so do repeated rows; each row has its result.
    Broken markup is read as browsers do in the main cases (missing ends, unclosed quotes), in time that grows
    with the length of the page.  An empty table gives an empty table.  Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    base = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    page_kind = base.schema["page_id"].dataType.simpleString()

    def parsed(batches):
        block = pa.list_(pa.struct([("text", pa.string()), ("keep", pa.bool_())]))
        span = pa.list_(pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                rows = [read(x) for x in c.column(3).to_pylist()]
                blocks = [[{"text": t, "keep": k} for t, k in r[0]] for r in rows]
                spans = [[{"tree": h, "first": x, "stop": y} for h, x, y in r[1]] for r in rows]
                same = [int.from_bytes(hashlib.blake2b("\n".join(t for t, k in r[0] if k).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for r in rows]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), pa.array(blocks, block), pa.array(spans, span), pa.array(same, pa.int64())], names=["page_id", "url", "host", "blocks", "spans", "same"])

    seen = written(base.mapInArrow(tidy(parsed), f"page_id {page_kind}, url string, host string, blocks array<struct<text:string,keep:boolean>>, spans array<struct<tree:long,first:int,stop:int>>, same long"))
    once = seen.groupBy("host", "same").agg(F.min(F.array_distinct("spans.tree")).alias("trees"))
    # one pass: the number of pages of a host is the count of a marker that every page has
    counts = once.select("host", F.explode(F.array_append(F.col("trees"), F.lit(None).cast("long"))).alias("tree")).groupBy("host", "tree").agg(F.count("*").alias("n"))
    pages_of = counts.where("tree IS NULL").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("n") >= min_pages) & F.col("tree").isNotNull()).join(pages_of, "host").where(F.col("n") >= F.col("pages") * min_share)
    # each page has a bounded number of subtrees, so those on a fixed share of a host's pages are boundedly many
    site = written(often.groupBy("host").agg(F.collect_list("tree").alias("templates")))
    # a small table goes to all tasks and the texts stay where they are; a larger one is met by host
    small = (site.agg(F.sum(F.size("templates") + 8)).first()[0] or 0) <= BROADCAST
    site = F.broadcast(site) if small else site
    gone = F.filter("spans", lambda s: F.coalesce(F.array_contains("templates", s["tree"]), F.lit(False)))
    found = seen.join(site, "host", "left").select("page_id", "url", "blocks", gone.alias("gone"))
    rest = F.filter("blocks", lambda b, i: ~F.exists("gone", lambda s: (s["first"] <= i) & (i < s["stop"])))
    found = found.select("page_id", "url", F.size("blocks").alias("all"), rest.alias("rest"))
    kept = F.filter("rest", lambda b: b["keep"]) if markup else F.col("rest")
    found = found.select("page_id", "url", "all", F.size("rest").alias("left"), F.transform(kept, lambda b: b["text"]).alias("kept"))
    text = F.array_join("kept", "\n")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), (F.col("all") - F.col("left")).cast("long").alias("n_template"), (F.col("left") - F.size("kept")).cast("long").alias("n_markup"))


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
