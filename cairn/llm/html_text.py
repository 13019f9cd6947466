"""Main text of web pages with a site style tree.

The element trees of all pages of a host are merged: a node is the path of
tags and classes that leads to an element. What a node holds varies from page
to page in the article and repeats in menus and notices. Over the m pages that
have a node, its presentations (the sequences of its children) and its contents
(the texts below it) have an importance: the entropy of the presentations, and
for each content 1 less the entropy of the pages it stands in, both to base m.
A node whose presentations and contents are of low importance is noise and is
removed with all below it from the pages of that host, but not from a page that
has a content of its own there: near copies of an article share most of it.

Hosts with few pages tell nothing, and menus may vary as well. So what HTML and
usual class names say comes first: ``nav``, ``footer``, ``form`` ... are noise
anywhere. Classes like ``ad`` or ``cookie`` are noise as whole names, but not on
headings and paragraphs, nor where the element holds most of the page's text and
no ``article`` or ``main`` stands outside such elements.
Where ``article`` and ``main`` hold most of the text outside noise, only what is in
them counts, and plain text elements in them always stay.

Blocks are joined by newlines; within one, character references are decoded
and white space becomes one blank. Null html gives an empty text; a null url is
a host of its own. Pages that are repeated count once in the tree, each keeps
its row in the result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.scale import staged

LEAST_PAGES = 4  # different pages of a host that must have a node
LOW = 0.1  # importance up to which a node is noise

# Elements by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
NOISE_TAGS = frozenset(
    "script style nav header footer aside form noscript template iframe button select option textarea input label "
    "fieldset dialog menu svg math canvas object embed video audio title head xmp noembed noframes datalist".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th tr tbody thead table ul ol dl".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())  # no name makes these noise
# Class names and ids that mark boilerplate, and words that may stand beside them in one name.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "aside footer foot header masthead comment comments disqus respond reply related recommended share sharing social "
    "toolbar widget pagination pager copyright disclaimer paywall".split()
)

BOX_NAMES = frozenset(
    "bar box block list links link wrap wrapper container area section panel group inner outer top bottom left right site "
    "global primary secondary buttons button icons icon unit slot form content main user users reader readers visitor".split()
)

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>",  # a value is quoted right behind its =
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    path: int  # hash of the tags and classes that lead here
    noise: bool
    content: bool  # within an article
    container: bool  # may be removed for its importance
    children: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    suspects: tuple[Element, ...] = ()  # elements from the top to here whose names mark boilerplate
    held: int = 0  # characters in a suspect


def marks_noise(name: str) -> bool:
    """Whether all words of a class name or id mark boilerplate or its box."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    return not NOISE_NAMES.isdisjoint(words) and all(w in NOISE_NAMES or w in BOX_NAMES for w in words)


def names_of(rest: str) -> tuple[str, bool, bool]:
    """(class and id in order, whether a name marks boilerplate, whether the element is hidden)."""
    found, marked, hidden = [], False, False
    for match in NAMED.finditer(rest):
        name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name in ("class", "id", "role"):
            found.append(value)
            marked |= any(map(marks_noise, value.split())) or value in ("complementary", "contentinfo", "search")
    return " ".join(found), marked, hidden


def hashed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) >> 1


class Page:
    """Blocks of text of a page and the elements that may be judged by the tree of its host."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, tuple[int, ...]]] = []  # text, in an article, containers around it
        self.nodes: list[Element] = []
        self.read_blocks: list[tuple[list, bool, list[Element]]] = []
        self.text: list[tuple[str, tuple[Element, ...]]] = []
        self.stack = [Element("", 0, False, False, False)]
        self.has_article = False
        self.read(source)

    def read(self, source: str) -> None:
        at, length = 0, len(source)
        last = source.rfind(">") + 1  # a tag that begins behind it has no end, and is text
        while at < last:
            match = MARK.search(source, at, last)
            self.characters(source[at : match.start() if match else last])
            if match is None:
                at = last
                break
            if match.end() == last and source.startswith("<!", match.start()):
                match = MARK.match(source, match.start())  # it may go on to the end of the page
            at = match.end()
            tag = (match["tag"] or "").lower()
            if match["cdata"]:
                self.characters(html.escape(match["cdata"]))
            elif not tag:
                continue
            elif match["end"]:
                self.close(tag)
            elif tag in RAW:  # its content is no markup and no text; a block goes on around it
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else length
            else:
                self.open(tag, match["rest"])
        if at < length:
            self.characters(source[at:].partition("<!")[0])
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        self.judge()

    def characters(self, text: str) -> None:
        if text and not self.stack[-1].noise:
            self.text.append((text, self.stack[-1].suspects))

    def flush(self) -> None:
        """End a block."""
        if self.text:
            self.read_blocks.append((self.text, self.stack[-1].content, [e for e in self.stack if e.container]))
            self.text = []

    def judge(self) -> None:
        """Suspects are noise; the blocks are what else there is.

        A suspect that holds over half of the text is spared, unless an
        article that is not in a suspect shows where the text is.
        """
        total, shown = 0, False
        for pieces, content, _ in self.read_blocks:
            for text, suspects in pieces:
                size = len("".join(text.split()))
                total += size
                shown |= content and size > 0 and not suspects
                for element in suspects:
                    element.held += size
        for pieces, content, containers in self.read_blocks:
            kept = [text for text, suspects in pieces if not any(shown or 2 * e.held <= total for e in suspects)]
            text = SPACE.sub(" ", html.unescape("".join(kept))).strip()
            if text:
                self.blocks.append((text, content, tuple(e.path for e in containers)))
                for element in containers:
                    element.texts.append(text)
        within = sum(len(text) for text, content, _ in self.blocks if content)
        self.has_article = within > 0 and 2 * within >= sum(len(text) for text, _, _ in self.blocks)

    def open(self, tag: str, rest: str) -> None:
        if tag in INLINE and tag != "a":
            if tag in ("br", "wbr", "img"):
                self.text += [(" ", self.stack[-1].suspects)] if tag == "br" and self.text else []
                return
        if tag not in INLINE:
            self.flush()
            while tag in TEXT_TAGS and self.stack[-1].tag == tag and tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
                self.pop()  # these end where the next begins
            if tag not in INLINE and self.stack[-1].tag == "p":
                self.pop()
        parent = self.stack[-1]
        names, marked, hidden = names_of(rest) if rest else ("", False, False)
        parent.children.append(tag)
        if tag in VOID:
            return
        content = tag in CONTENT_TAGS or parent.content
        noise = parent.noise or (tag in NOISE_TAGS and tag != "form") or (hidden and tag not in ("html", "body"))
        judged = tag not in INLINE and tag not in TEXT_TAGS and tag not in CONTENT_TAGS and tag not in ("html", "body")
        judged = judged and not noise
        path = hashed(parent.path, tag, names) if judged else parent.path
        element = Element(tag, path, noise, content and not noise, judged)
        element.suspects = parent.suspects
        if (marked or tag == "form") and not noise and tag not in PROSE_TAGS and tag not in ("html", "body"):
            element.suspects += (element,)
        self.stack.append(element)
        if element.container:
            self.nodes.append(element)

    def close(self, tag: str) -> None:
        depth = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag), 0)
        if not depth:
            if tag not in INLINE:
                self.flush()
            return
        if tag in INLINE and any(e.tag not in INLINE for e in self.stack[depth + 1 :]):
            return  # a stray end of an inline element doesn't end the blocks in it
        if tag not in INLINE:
            self.flush()
        del self.stack[depth:]

    def pop(self) -> None:
        self.flush()
        self.stack.pop()

    def main_blocks(self) -> list[tuple[str, tuple[int, ...]]]:
        """Blocks of the article, or of the page if it has none with most of the text, with the judged nodes around them."""
        return [(text, around) for text, content, around in self.blocks if content or not self.has_article]

    def main_nodes(self) -> list[Element]:
        return [n for n in self.nodes if n.texts and (n.content or not self.has_article)]


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


BLOCK = pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))])
TREE = pa.struct([("node", pa.int64()), ("presentation", pa.int64()), ("contents", pa.list_(pa.int64()))])
PARSED = (
    "page_id bigint, url string, host string, page bigint, blocks array<struct<text:string,around:array<bigint>>>, "
    "nodes array<struct<node:bigint,presentation:bigint,contents:array<bigint>>>"
)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with its blocks and its judged nodes; ``page`` is the hash of its blocks."""
    for batch in batches:
        hosts, hashes, blocks, nodes = [], [], [], []
        for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            page = Page(source or "")
            found = page.main_blocks()
            hosts.append(host_of(url))
            hashes.append(hashed(*[text for text, _ in found]))
            blocks.append([{"text": text, "around": around} for text, around in found])
            nodes.append(
                [
                    {"node": n.path, "presentation": hashed(*n.children), "contents": sorted({hashed(t) for t in n.texts})}
                    for n in page.main_nodes()
                ]
            )
        columns = [pa.array(hosts, "string"), pa.array(hashes, "int64"), pa.array(blocks, pa.list_(BLOCK)), pa.array(nodes, pa.list_(TREE))]
        names = ["page_id", "url", "host", "page", "blocks", "nodes"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def low_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, node) of the merged trees whose importance is low and in which the page has no content of its own.

    A frequent item is counted before it is shuffled; a host of any size is
    spread over its nodes and their items. The importance of presentations is
    the entropy of their shares p: - sum p log p / log m; a content that
    stands on n of m pages alike has entropy log n / log m.
    """
    found = pages.select("host", "page", F.explode("nodes").alias("node")).select("host", "page", "node.*")
    sizes = found.groupBy("host", "node").agg(F.count_distinct("page").alias("m")).filter(F.col("m") >= LEAST_PAGES)
    shown = found.groupBy("host", "node", "presentation").agg(F.count_distinct("page").alias("n"))
    held = (
        found.select("host", "node", "page", F.explode("contents").alias("content"))
        .groupBy("host", "node", "content")
        .agg(F.count_distinct("page").alias("n"), F.min("page").alias("page"))
    )
    # with N = sum n, the entropy is log N - sum n log n / N
    presentations = shown.groupBy("host", "node").agg(
        (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("spread")
    )
    # every page counts its contents alike: weights n
    contents = held.groupBy("host", "node").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("shared"))
    judged = sizes.join(presentations, ["host", "node"]).join(contents, ["host", "node"])
    base = F.log("m")
    importance = F.greatest(F.col("spread") / base, 1 - F.col("shared") / base)
    low = staged(judged.filter(importance <= LOW).select("host", "node"))
    own = held.filter("n = 1").join(low, ["host", "node"], "left_semi").select("host", "page", "node").distinct()
    return found.join(low, ["host", "node"], "left_semi").select("host", "page", "node").distinct().join(own, ["host", "page", "node"], "left_anti")


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are parsed once. Low nodes are listed per page and joined to the
    parsed pages; a page that has none loses nothing.
    """
    picked = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    rows = staged(picked.mapInArrow(parsed, PARSED))
    low = staged(low_nodes(rows).groupBy("host", "page").agg(F.array_sort(F.collect_set("node")).alias("low")))
    kept = F.filter("blocks", lambda block: F.col("low").isNull() | ~F.arrays_overlap(block["around"], F.col("low")))
    text = F.array_join(F.transform(kept, lambda block: block["text"]), "\n")
    return (
        rows.select("page_id", "url", "host", "page", "blocks")
        .join(low, ["host", "page"], "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
    )
