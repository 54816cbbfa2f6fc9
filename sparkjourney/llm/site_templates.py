"""HTML extraction by site template removal.

Each element's subtree is hashed (tag, attributes, text, children); Spark counts
on how many distinct pages of a host (by the hash of the page without elements
that are named as something else, so copies of a page count once) each hash occurs.  Subtrees that recur on ``needed`` of a
host's distinct pages are its template and are deleted: a box or menu on a share of
them that falls as the host grows, since a large host has many sections and
languages; single lines (``LINES``) and inline elements, which prose may repeat, on
``SHARE`` of them; neither on fewer than ``LEAST``.  So are elements whose tag or role is something
other than an article, and those that a class or id names so; where a name is only part of one
(``share-price``), the element must also recur on the host, or be short and mostly links.  An
element that holds the article, or most of a page without one, never goes by its name.
What is left of the article (of the body, without one) is the main text.  Paragraphs, headings and
the like inside an article are never taken for template: articles may quote the same passage."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import cut

SHARE, LEAST = 0.5, 5
#: Fixed values of HTML and of its usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption table tr tbody thead ul ol dl".split())
#: Text blocks that are one line; the others are boxes of several.
LINES = TEXT_BLOCKS - frozenset("table tbody thead ul ol dl".split())
DROPPED = frozenset("nav header footer aside form script style noscript iframe template button select option input textarea "
                    "menu dialog head title svg canvas object embed video audio map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
NAMED = (r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|"
         r"masthead|comments?|comment-?list|respond|replies|disqus|cookies?|consent|gdpr|notices?|alerts?|pop-?up|modal|overlay|"
         r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager)")
#: What such names are put together with: words for boxes and places.
PLACED = (r"(?:box|boxes|bar|list|area|wrap|wrapper|container|inner|outer|section|block|module|panel|links?|buttons?|icons?|posts?|articles|stories|items?|"
          r"site|page|main|top|bottom|left|right|primary|secondary|global|form|feed|unit|slot|text|content|row|col|\d+|js|sticky|fixed|x?s|m|x?l)")
#: A class or id that is a name, alone or with words for boxes; and one that has a name somewhere in it.
NAME = re.compile(rf"(?:{PLACED}[_-])*{NAMED}(?:[_-](?:{PLACED}|{NAMED}))*", re.I)
MENTION = re.compile(rf"(?:^|[\s_-]){NAMED}(?:$|[\s_-])", re.I)
#: An element with less text than this, half of it links, is no prose.
SHORT = 200
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select article section div body html".split())
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
PLAIN = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    """``size`` is the length of the visible text, ``links`` that of links in it, and
    ``holds`` tells whether an article is in it or is it; ``hashed`` sets them."""
    __slots__ = ("tag", "attributes", "children", "hash", "size", "links", "holds")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.hash, self.size, self.links, self.holds = tag, attributes, [], 0, 0, 0, False


class Markup:
    """The tags of a page, in one forward pass."""

    def __init__(self, source: str):
        self.source, self.quotes, self.last = source, True, source.rfind(">")

    def end(self, at: int) -> int:
        """Where the tag's > is: the first one outside quotes, or, once quotes turned
        out not to be closed, the first one; -1 without any."""
        source = self.source
        if at > self.last:
            return -1
        start = at
        while self.quotes:
            at = PLAIN.match(source, at).end()
            if at >= len(source):
                break
            if source[at] == ">":
                return at
            closing = source.find(source[at], at + 1)
            if closing < 0:
                break
            at = closing + 1
        self.quotes = False
        return source.find(">", start)

    def __iter__(self):
        """(start, end, closing slash, tag, attributes); a comment or declaration has no tag.
        The reader may send the place to go on from, behind the end."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            m, at = TAG.match(source, start), start + 1
            if m:
                end = self.end(m.end())
                if end < 0:
                    return
                at = yield start, end + 1, m[1], m[2].lower(), source[m.end():end]
                at = end + 1 if at is None else at
            elif source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = len(source) if end < 0 else end + 3
                yield start, at, "", None, ""
            elif source[start + 1:start + 2] in ("!", "?"):
                end = source.find(">", start)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", None, ""


def parse(source: str) -> Node:
    """Tree of the page; children are nodes and pieces of undecoded text."""
    root = Node("#root")
    stack, at, size = [root], 0, len(source)
    opened = Counter()  # tags on the stack

    def close(depth):
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    tags = iter(Markup(source))
    found = next(tags, None)
    while found:
        start, end, slash, tag, attributes = found
        if start > at:
            stack[-1].children.append(source[at:start])
        at, jump = end, None
        if tag is None:
            pass
        elif slash:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
        else:
            if tag in CLOSES_P and opened["p"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        close(depth)
                        break
                    if stack[depth].tag not in INLINE:
                        break
            closes = SIBLINGS.get(tag)
            if closes and any(opened[c] for c in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in closes:
                        close(depth)
                        break
                    if stack[depth].tag in SCOPES:
                        break
            node = Node(tag, attributes.strip())
            stack[-1].children.append(node)
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                node.children.append(source[at:closing.start() if closing else size])
                at = jump = closing.end() if closing else size
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
                opened[tag] += 1
        try:
            found = tags.send(jump)
        except StopIteration:
            found = None
    if at < size:
        stack[-1].children.append(source[at:])
    return root


def _walk(root: Node) -> list[tuple[Node, bool]]:
    """Nodes, parents first, and whether each is inside an article."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    return out


def hashed(root: Node) -> list[tuple[Node, bool]]:
    """Sets every subtree's hash and sizes, children first, without recursion; gives ``_walk``.
    The hash's lowest bit tells whether the element is a box."""
    nodes = _walk(root)
    for node, _ in reversed(nodes):
        h = xxhash.xxh64(f"{node.tag} {node.attributes}\0")
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little", signed=True))
                node.size, node.links, node.holds = node.size + c.size, node.links + c.links, node.holds or c.holds
            else:
                text = " ".join(c.split())
                h.update(text.encode("utf-8", "surrogatepass"))
                node.size += len(text)
            h.update(b"\0")
        if node.tag in DROPPED and not (node.tag == "form" and node.holds):
            node.size, node.links, node.holds = 0, 0, False
        elif node.tag == "a":
            node.links = node.size
        node.holds = node.holds or node.tag in ("article", "main")
        box = node.tag not in LINES and node.tag not in INLINE
        node.hash = (h.intdigest() - (1 << 63)) & ~1 | box
    return nodes


def removable(node: Node, inside: bool) -> bool:
    """Whether the node may be template at all."""
    return node.tag not in ("#root", "html", "body", "article", "main", "br") and not (inside and (node.tag in TEXT_BLOCKS or node.tag in INLINE))


def _named_away(node: Node, root: Node, template=frozenset()) -> bool:
    """Whether the element is something other than the article, by its tag, role or name."""
    if node.tag in DROPPED:
        return not (node.tag == "form" and node.holds)
    if not node.attributes or node.tag in ("html", "body"):
        return False
    named = mentioned = False
    for name, value in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), entities.unescape(value.strip("\"'"))
        if name == "hidden" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            named = named or any(map(NAME.fullmatch, value.split()))
            mentioned = mentioned or MENTION.search(value) is not None
    if not (named or mentioned) or node.holds or not root.holds and 2 * node.size > root.size:
        return False
    return named or node.hash in template or node.size < SHORT and 2 * node.links >= node.size


def content(root: Node) -> int:
    """Hash of the page's tags and text without scripts, menus and whatever else is
    named away: the same for copies of a page that differ there only."""
    h, todo = xxhash.xxh64(), [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            h.update(" ".join(node.split()).encode("utf-8", "surrogatepass") + b"\0")
        elif node is root or not _named_away(node, root):
            h.update(f"<{node.tag}\0")
            todo.extend(reversed(node.children))
    return h.intdigest() - (1 << 63)


def main_text(root: Node, template) -> str:
    """Blocks of the article, in page order, one a line.  Without an article (or
    main) element the whole body counts."""
    away = lambda node: _named_away(node, root, template)
    gone = lambda node: node.hash in template or away(node)

    def kept(tags):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag in tags and not away(node):
                found.append(node)
            elif node.tag == "#root" or not gone(node):
                todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return found

    blocks, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in kept({"article"}) or kept({"main"}) or [root]:
        todo = [iter(top.children)]
        ends = [True]
        flush()
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
                if ends.pop():
                    flush()
            elif isinstance(child, str):
                line.append(entities.unescape(child))
            elif child.tag == "br":
                line.append(" ")
            elif not ((child.hash in template and removable(child, top is not root)) or away(child)):
                block = child.tag not in INLINE
                if block:
                    flush()
                todo.append(iter(child.children))
                ends.append(block)
        flush()
    return "\n".join(blocks)


def host_of(url):
    """Lower-cased (A-Z) host, after the first :// up to /, ? or #; empty for a null or other url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def needed(pages, box):
    """Pages of a host's ``pages`` distinct ones that make a subtree template: boxes
    need a share of pages ** (-1/3), at most SHARE (1/3 of 27, 1/10 of 1,000, 1/100 of a million)."""
    half = F.lit(SHARE) * pages
    return F.greatest(F.lit(float(LEAST)), F.when(box, F.least(half, F.pow(pages.cast("double"), F.lit(2 / 3)))).otherwise(half))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): hashes of the host's recurring subtrees.  Their number is
    at most the cube root of the host's distinct pages times the mean number of elements a page."""
    def subtrees(batches):
        for b in batches:
            seen = {}
            for host, source in zip(b["host"], b["html"]):
                root = parse(source)
                own = sorted({node.hash for node, inside in hashed(root) if removable(node, inside)})
                key = (host, content(root))
                seen[key] = min(own, seen.get(key, own))
            yield pd.DataFrame({"host": [h for h, _ in seen], "page": [x for _, x in seen], "hashes": list(seen.values())})

    distinct = (pages.where("host <> ''").mapInPandas(subtrees, "host string, page long, hashes array<long>")
                .groupBy("host", "page").agg(F.min("hashes").alias("hashes")))
    counted = (distinct.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("hash"))
               .groupBy("host", "hash").agg(F.count("*").alias("n")))
    total = counted.where("hash is null").select("host", F.col("n").alias("pages"))
    often = (counted.where(F.col("hash").isNotNull() & (F.col("n") >= LEAST)).join(total, "host")
             .where(F.col("n") >= needed(F.col("pages"), F.col("hash").bitwiseAND(F.lit(1)) == 1)))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages(page_id, url, html).

    Null html counts as empty and gives an empty text; a page without host (null
    url included) has no template; repeated rows repeat (and count as one page
    of their host); an empty table gives no rows; other columns are ignored."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))

    def extract(batches):
        for b in batches:
            out, sets = [], {}
            for host, source, template in zip(b["host"], b["html"], b["template"]):
                if host not in sets:
                    sets[host] = frozenset() if template is None else frozenset(map(int, template))
                root = parse(source)
                hashed(root)
                out.append(main_text(root, sets[host]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    return (_with_templates(pages, templates(pages)).select("page_id", "url", "html", "host", "template")
            .mapInPandas(extract, "page_id long, url string, text string, n_chars long"))


#: Template tables up to this size, counted in bytes, are broadcast.
BROADCAST_BYTES = 16 << 20


def _with_templates(pages: DataFrame, table: DataFrame) -> DataFrame:
    """The pages with their host's template.  Html is not shuffled while the table is
    small.  Beyond that, hosts with more rows than a quarter of a task's even share,
    of which there are four a task at most, are still joined by broadcast."""
    table = cut(table)
    if table.agg(F.coalesce(F.sum(F.size("template") * 8 + F.octet_length("host") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table), "host", "left")
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(pages.groupBy("host").agg(F.count("*").alias("n")))
    hot = cut(rows.where(F.col("n") * 4 * tasks > rows.agg(F.sum("n")).first()[0]).select("host"))
    many, few = F.broadcast(hot), table.join(F.broadcast(hot), "host", "left_anti")
    return (pages.join(many, "host", "left_semi").join(F.broadcast(table.join(many, "host", "left_semi")), "host", "left")
            .unionByName(pages.join(many, "host", "left_anti").join(few, "host", "left")))
