"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, a node's
points are discounted by its link density, and the best container is kept with
its siblings: all of them that are neither page furniture nor mostly links.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option datalist textarea input"
    " iframe object embed svg math canvas audio video map dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
# An opening tag ends an open element of these names, up to the nearest barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_BARRIERS = frozenset("table td th caption button object html body".split())
PARAGRAPHS = frozenset("p pre td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG_POINTS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0}
# Words of class, id and role names that mark a reader comment, also on an article element.
COMMENT = frozenset("comment comments disqus replies reply".split())
# Parts of names that may stand beside a word of NOT_ARTICLE that also has other meanings.
COMPANIONS = frozenset(
    "area author bar block body bottom box button buttons container content count form group header holder icon icons"
    " inner item items left link links list main meta outer panel post posts primary right row secondary section slot"
    " text thread title top unit wrap wrapper".split()
)
# Words of NOT_ARTICLE that name subjects as well: in front of a name they need companions.
AMBIGUOUS = frozenset(
    "ad ads banner comment consent cookie cookies menu modal notice notices promotion related reply search share sharing social".split()
)
# Elements whose presence makes their parent the frame of the page, not a part of the article.
FRAME = frozenset("nav header footer aside".split())
# Words of class, id and role names that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent"
    " contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice"
    " notices pager pagination popup promo promoted promotion related replies reply search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget".split()
)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>"']*+(?:(?:"[^"]*+"?|'[^']*+'?)[^>"']*+)*+)(?:>|\Z)
      |<[!?/][^>]*+(?:>|\Z)
      |(?P<text>[^<]++|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
COMMAS = re.compile("[,،、，]")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LISTS = frozenset("ul ol dl".split())
# A sibling, or a list outside of an article element, with more of its text in links is a menu.
MOST_LINKS = 0.5


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "score", "chars", "link_chars", "frame")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list = []
        self.score: float | None = None
        self.chars = self.link_chars = 0
        self.frame = False


def marks(name: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role name is one of ``words``, as a whole or as its first or last part.

    A word that names subjects too does so as first part only among other such
    words, companions and numbers: ``social-links`` is furniture, ``social-science`` is not.
    """
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not parts:
        return False
    if parts[-1] in words or name.lower() in words:
        return True
    if parts[-1].isdigit() and len(parts) == 2 and parts[0] in words:
        return True
    if parts[0] not in words:
        return False
    return parts[0] not in AMBIGUOUS or all(p in words or p in COMPANIONS or p.isdigit() or p == "x" for p in parts[1:])


def not_article(attrs: str, words: frozenset[str] = NOT_ARTICLE) -> bool:
    """Whether the attributes hide an element or mark it as page furniture by one of ``words``."""
    if not attrs or attrs.isspace():
        return False
    for found in ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), (found[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if name in ("class", "id", "role") and any(marks(one, words) for one in value.split()):
            return True
    return False


def parse(page: str) -> Node:
    """Element tree of a page; missing end tags are supplied as browsers do."""
    root = Node("html", None, False)
    stack, opened = [root], {"html": 1}

    def pop_to(index: int) -> None:
        for node in stack[index:]:
            opened[node.tag] -= 1
        del stack[index:]

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.match(page, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            stack[-1].parts.append(text)
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            if name in ("html", "body") or not opened.get(name):
                continue
            index = len(stack) - 1
            while stack[index].tag != name:
                index -= 1
            pop_to(index)
            continue
        if name in ("html", "body"):
            continue
        if name in BLOCKS and opened.get("p"):
            for index in range(len(stack) - 1, 0, -1):
                if stack[index].tag == "p":
                    pop_to(index)
                    break
                if stack[index].tag in P_BARRIERS:
                    break
        if name in ENDS and any(opened.get(x) for x in ENDS[name][0]):
            ended, barriers = ENDS[name]
            for index in range(len(stack) - 1, 0, -1):
                if stack[index].tag in ended:
                    pop_to(index)
                    break
                if stack[index].tag in barriers:
                    break
        attrs = token["attrs"]
        parent = stack[-1]
        dropped = parent.dropped or name in DROPPED or (
            name == "header" and not (opened.get("article") or opened.get("main"))
        ) or not_article(attrs, COMMENT if name in ("article", "main") else NOT_ARTICLE)
        if name in VOID:
            if name == "br" or name == "hr":
                parent.parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
        if name == "head" or attrs.endswith("/") and name in ("svg", "path"):
            # The head ends at the first element that cannot be in it; only its raw elements matter here.
            continue
        node = Node(name, parent, dropped)
        parent.parts.append(node)
        if dropped and name in FRAME:
            parent.frame = True
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1
    return root


def in_order(root: Node) -> list[Node]:
    """Kept nodes, each before its descendants."""
    nodes, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        nodes.append(node)
        waiting += [p for p in reversed(node.parts) if type(p) is Node and not p.dropped]
    return nodes


def visible(text: str) -> str:
    return references.unescape(text) if "&" in text else text


def blocks_of(roots: list[Node]) -> list[str]:
    """Texts of the blocks below ``roots`` in page order, white space collapsed."""
    blocks, inline = [], []

    def flush() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            blocks.append(text)

    waiting: list = list(reversed(roots))
    while waiting:
        part = waiting.pop()
        if part is None:
            flush()
        elif type(part) is str:
            inline.append(visible(part))
        elif not part.dropped:
            if part.tag in BLOCKS:
                flush()
                waiting.append(None)
            waiting += reversed(part.parts)
    flush()
    return blocks


def link_density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by one space, empty if there is none."""
    root = parse(page)
    nodes = in_order(root)
    for node in reversed(nodes):  # descendants first
        node.chars += sum(len(p.strip()) for p in node.parts if type(p) is str)
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    for node in nodes:
        paragraph = node.tag in PARAGRAPHS or (
            node.tag == "div" and node.chars and not any(type(p) is Node and p.tag in BLOCKS for p in node.parts)
        )
        if not paragraph:
            continue
        text = " ".join(blocks_of([node]))
        if not text:
            continue
        points = 1.0 + len(COMMAS.findall(text)) + min(len(text) / 100.0, 3.0)
        points *= 1.0 - link_density(node)
        above, share = node.parent, 1.0
        for level in range(3):
            if above is None:
                break
            if above.score is None:
                above.score = TAG_POINTS.get(above.tag, 0.0)
            above.score += points * share
            above, share = above.parent, 1.0 / (2 + 2 * level)
    scored = [n for n in nodes if n.score is not None]
    if not scored:
        return " ".join(blocks_of([root]))
    final = {id(n): n.score * (1.0 - link_density(n)) for n in scored}
    best = max(scored, key=lambda n: final[id(n)])
    enough = max(10.0, 0.2 * final[id(best)])
    # An element that says it is the article stays whole, if the best node is in it.
    article = best
    for above in ancestors(best):
        if above.tag == "article":
            article = above
    level, in_article = best, article.tag == "article"
    if not in_article:
        for node in nodes:
            node.dropped = node.tag in LISTS and link_density(node) > MOST_LINKS
    while level.parent is not None:
        above = level.parent
        # Beside the best node and in parts of an article, all but menus stays; in the frame of the page, what has points.
        inside = above.tag == "main" or level.tag not in ("article", "main") and (level is best or not above.frame)
        if level is article or not in_article:
            in_article = False
            above.parts = [
                p for p in above.parts
                if p is level or (inside if type(p) is str else not p.dropped and stays(p, inside, final.get(id(p), 0.0) >= enough))
            ]
        level = above
    return " ".join(blocks_of([level]))


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def stays(node: Node, inside: bool, scored: bool) -> bool:
    """Whether a sibling on the way from the best node to the root is part of the article."""
    density = link_density(node)
    if inside or node.tag in HEADINGS or scored:
        return bool(node.chars) and density <= MOST_LINKS
    return node.tag == "p" and (density < 0.25 if node.chars > 80 else node.chars > 0 and density == 0.0)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of each page; all columns stay, one named ``out`` is replaced.

    A null page counts as empty; a page without text gives an empty string. An
    empty table gives an empty result. Of nodes with equal points the first in
    page order is the best. Pages of any length are read whole, repeated rows are
    rows of their own.
    """
    kept = pages.drop(out)
    place = kept.columns.index(html_col)

    def run(batch):
        return [*batch.columns, [main_text(p) if p else "" for p in batch.column(place).to_pylist()]]

    return arrow_map(kept, run, kept.withColumn(out, F.lit("")).schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
