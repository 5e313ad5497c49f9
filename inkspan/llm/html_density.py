"""HTML main-text extraction by composite text density.

Per page: a small tolerant tree builder, then for every node the link-adjusted characters per tag, the sum of its
children's densities, and the subtree with the largest sum among nodes at least as dense as the thinnest node on the
path from body to the densest one. Pages are independent rows, so Spark only maps; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import fields, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body".split())
P_BORDERS = frozenset("td th table button object".split())
#: what a start tag ends when it is open, up to the given border
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("script style noscript template head title nav footer header aside form button select option textarea input iframe svg canvas object embed audio video menu dialog".split())
HINT = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|comments?|comment-\w+|replies|respond|"
    r"disqus|cookies?|consent|notice|gdpr|newsletter|subscribe|subscription|popup|modal|overlay|share|sharing|social|related|recommend\w*|widget|pagination|pager|toolbar|login|signup|search|skip|copyright|disclaimer)",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
KEPT_ANYWAY = frozenset("article main body html".split())


def hinted(value: str) -> bool:
    """Whether a whole class token, or each part of a hyphenated one, names something beside the main text."""
    return any(HINT.fullmatch(x) or all(HINT.fullmatch(y) for y in re.split("[_-]+", x)) for x in value.split())


class Node:
    __slots__ = ("tag", "parts", "parent", "drop", "hint", "chars", "tags", "link_chars", "link_tags", "density", "total", "paragraph")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, hint: bool = False) -> None:
        self.tag, self.parts, self.parent, self.drop, self.hint = tag, [], parent, drop or (hint and tag not in KEPT_ANYWAY), hint
        #: the open p that a block inside would end
        self.paragraph = self if tag == "p" else None if parent is None or tag in P_BORDERS else parent.paragraph


def parse(page: str) -> Node:
    """Tree of a page; every unclosed or misnested tag is closed where HTML would imply it."""
    root = Node("html", None)
    at, here, some_hint = 0, root, False
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                if up.tag in ("td", "th", "table") and tag not in BLOCKS:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            elif tag == "p":
                here.parts.append(Node("p", here))
            continue
        if tag in ("html", "body"):
            if tag == "body" and here.tag in ("html", "head") and not any(isinstance(x, Node) and x.tag == "body" for x in root.parts):
                here = root
                node = Node("body", root)
                root.parts.append(node)
                here = node
            continue
        if tag in CLOSES_P:
            if here.paragraph is not None:
                here = here.paragraph.parent
        if tag in ENDS:
            ended, border = ENDS[tag]
            up, found = here, None
            while up is not None and up.tag not in border:
                found = up if up.tag in ended else found
                up = up.parent
            if found is not None:
                here = found.parent
        if here.tag == "head" and tag not in ("title", "base", "link", "meta", "style", "script", "noscript", "template"):
            here = here.parent
        node = Node(tag, here, *((True,) if tag in DROPPED else _unwanted(m[3])))
        node.drop = node.drop and (tag in DROPPED or tag not in KEPT_ANYWAY)
        some_hint = some_hint or node.hint
        here.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            node.parts.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    if some_hint:
        _restore(root)
    return root


def _restore(root: Node) -> None:
    """A class or id drops no element that holds an article or main element, or most of the unlinked text of the article
    around it (of the page, where there is none)."""
    nodes = [root]
    for n in nodes:
        if n.hint or not n.drop:
            nodes.extend(c for c in n.parts if isinstance(c, Node))
    plain, article = {}, {}
    for n in reversed(nodes):
        inner = [c for c in n.parts if isinstance(c, Node) and c in plain]
        text = sum(len(x.strip()) for x in n.parts if isinstance(x, str)) + sum(plain[c] for c in inner)
        stays = n.hint or not n.drop
        plain[n] = text if stays and n.tag != "a" else 0
        article[n] = stays and (any(article[c] for c in inner) or (n.tag in ("article", "main") and not n.hint))
    around = {root: root}
    for n in nodes:
        if n is not root:
            around[n] = n.parent if n.parent.tag in ("article", "main") else around[n.parent]
        if n.hint and (article[n] or 2 * plain[n] > plain[around[n]]):
            n.drop = False


def _unwanted(attributes: str) -> tuple[bool, bool]:
    """Whether to drop an element for its role or as hidden, and whether its class or id hints so."""
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    hint = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        hint = hint or (name in ("class", "id") and hinted(value))
        if name == "role" and value.lower() in ROLES:
            return True, False
        if (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name == "aria-hidden" and value == "true"):
            return True, False
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes, re.I))
    return hidden, hint and not hidden


def _walk(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents first; no recursion, so deep nesting is safe."""
    nodes = [root]
    for n in nodes:
        nodes.extend(c for c in n.parts if isinstance(c, Node) and not c.drop)
    return nodes


def _measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for n in reversed(nodes):
        text = sum(len(x.strip()) for x in n.parts if isinstance(x, str))
        inner = [c for c in n.parts if isinstance(c, Node) and not c.drop]
        n.chars = text + sum(c.chars for c in inner)
        n.tags = sum(1 + c.tags for c in inner)
        n.link_chars = n.chars if n.tag == "a" else sum(c.link_chars for c in inner)
        n.link_tags = (1 + n.tags) if n.tag == "a" else sum(c.link_tags for c in inner)
    body = max(root.chars, 1)
    share = root.link_chars / body
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        plain = max(c - n.link_chars, 1)
        base = math.log(c / plain * n.link_chars + share * c + math.e) if c else 1.0
        n.density = c / t * math.log(c / lc * t / lt + 1) / math.log(base + math.e) if c else 0.0
        n.total = sum(x.density for x in n.parts if isinstance(x, Node) and not x.drop)
    return nodes


def main_node(root: Node) -> Node:
    """The subtree with the largest density sum among nodes as dense as the thinnest one between body and the densest node."""
    nodes = _measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    inside = [n for n in nodes if n.tag in BLOCKS] or nodes
    densest = max(inside, key=lambda n: n.density)
    threshold, up = densest.density, densest
    while up is not None and up is not body:
        threshold = min(threshold, up.density)
        up = up.parent
    threshold = min(threshold, body.density)
    best = max((n for n in inside if n.density >= threshold), key=lambda n: n.total, default=body)
    if best.total < densest.density:  # the text stands in one block
        best = densest
    # an article or main element around the best subtree is the article itself
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.parent
    return best


def blocks_of(node: Node) -> list[str]:
    """Text of each block in page order: references decoded, white space runs as one space, trimmed, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str | None]] = [(node,)]
    while stack:
        (x,) = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop and x is not node:
            continue
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append((None,))
            stack.extend((p,) for p in reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; '' for null, empty and text-free pages."""
    return "\n".join(blocks_of(main_node(parse(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points). Null html counts as empty; ids and urls pass through
    as they are, nulls included; repeated rows are extracted alike; an empty table gives an empty result."""
    p = fields(pages, id=id_col, url=url_col, html=html_col)
    kind = p.schema["id"].dataType.simpleString()
    out = p.mapInArrow(tidy(_extract), f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
