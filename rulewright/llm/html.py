"""HTML main-text extraction from flat text blocks.

A page is cut into flat text blocks. Each has the features of FEATURES: its word count and link density and
those of its neighbours; whether it is a heading or another element of text; how much of the page's words are in blocks of the same
element; whether it is inside the page's article or main element, whether the page has one, whether it is inside an
element that HTML keeps for furniture (nav, footer, aside, form), and whether a class, id or role around it reads like
furniture. A decision tree, trained with Spark on the blocks of labelled_pages(), says which blocks are main text; the
tree becomes one SQL expression over the page's array of blocks.

A name is a hint, never a verdict on what it surrounds: the name of an element that holds the article, or of one that
holds half of the page's words where no article is marked, is not read, nor is one on a paragraph or
heading that HTML has other means to mark, unless it is one of the plain words for adverts.

White space inside a block becomes one space (a line break is white space), and the chosen blocks are
joined in page order by a newline. Defined results: a null or empty page has no text; unclosed elements
are closed where HTML closes them; repeated rows are extracted row by row; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Elements whose content is no text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "math", "canvas", "select", "option", "textarea", "button"}
#: Elements that end a block on both sides.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
#: Words of a class, id or role: those that name furniture anywhere, and those that text may carry too.
PLAIN_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promoted", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
OTHER_NAMES = {"complementary", "contentinfo", "disclaimer", "discussion", "header", "notice", "related", "replies", "reply", "responses", "search", "toc"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of text; of their names only those of ADVERTS count.
TEXTS = {"p", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption", "caption", *HEADINGS}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "promo", "promoted", "sponsor", "sponsored"}
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What head can hold; any other opening tag, or text, closes it.
IN_HEAD = {"head", "base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
#: An opening tag closes an open element of these names, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class _Element:
    tag: str
    silent: bool = False
    link: bool = False
    furniture: bool = False
    main: int = -1
    boxes: tuple[int, ...] = ()


@dataclass
class Block:
    """A text block: its words, those in links, the element of its text, and the elements around it that matter."""

    text: str
    words: int
    linked: int
    tag: str
    furniture: bool
    main: int
    boxes: tuple[int, ...]


class _Blocks(HTMLParser):
    """The blocks of a page with text. Article and main elements, and named ones (their strength: 2 for plain names), are numbered."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.stack: list[_Element] = [_Element("")]
        self.text: list[str] = []
        self.linked: list[str] = []
        self.mains = 0
        self.strength: list[int] = []

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            top = self.stack[-1]
            tag = next((x.tag for x in reversed(self.stack) if x.tag in BLOCKS), "")
            self.out.append(Block(words, words.count(" ") + 1, len("".join(self.linked).split()), tag, top.furniture, top.main, top.boxes))
        self.text, self.linked = [], []

    def pop_to(self, at: int) -> None:
        if any(x.tag in BLOCKS for x in self.stack[at:]):
            self.flush()
        del self.stack[at:]

    def find(self, names: set[str], barrier: set[str]) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                return i
            if self.stack[i].tag in barrier:
                break
        return 0

    def close_head(self) -> None:
        """Closes head unless an element inside it is open; what follows then belongs to the body."""
        if self.stack[-1].tag == "head":
            self.pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" and (at := self.find({"head"}, {"template", "svg", "math"})):
            self.pop_to(at)
        elif tag not in IN_HEAD:
            self.close_head()
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "wbr", "img"):
                self.text.append(" " if tag != "wbr" else "")
            return
        if tag in CLOSES_P and (at := self.find({"p"}, {"table", "td", "button"})):
            self.pop_to(at)
        if tag in IMPLIED and (at := self.find(*IMPLIED[tag])):
            self.pop_to(at)
        if tag in BLOCKS:
            self.flush()
        over = self.stack[-1]
        main, boxes = over.main, over.boxes
        if tag in MAIN:
            main, self.mains = self.mains if main < 0 else main, self.mains + 1
        elif tag not in ("body", "html") and (strength := self.named(tag, attrs)):
            boxes, _ = (*boxes, len(self.strength)), self.strength.append(strength)
        kept = tag in FURNITURE or (tag == "header" and over.main < 0)
        self.stack.append(_Element(tag, over.silent or tag in SILENT, over.link or tag == "a", over.furniture or kept, main, boxes))

    @staticmethod
    def named(tag: str, attrs: list) -> int:
        """2 if a plain name for furniture is among its class, id and role, 1 for another one, 0 for none."""
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        found = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", marks).lower()))
        if tag in TEXTS:
            return 2 * bool(found & ADVERTS)
        return 2 if found & PLAIN_NAMES else int(bool(found & OTHER_NAMES))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if at := self.find({tag}, {"td", "table"} - {tag} if tag not in BLOCKS else set()):
            self.pop_to(at)
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.close_head()
        if not self.stack[-1].silent:
            self.text.append(data)
            if self.stack[-1].link:
                self.linked.append(data)


def page_blocks(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page, and the strength of every named element."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out, parser.strength


FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "heading", "text_element", "like_share", "main", "page_main", "furniture", "named")


def features(blocks: list[Block], strength: list[int]) -> list[list[float]]:
    """The features of every block of a page, in the order of FEATURES.

    The page's main element is the article or main with most words.
    """
    total = sum(b.words for b in blocks)
    alike, size, held = Counter(), Counter(), Counter()
    for b in blocks:
        alike[b.tag] += b.words
        if b.main >= 0:
            size[b.main] += b.words
        for box in b.boxes:
            held[box] += b.words
    article = max(size, key=lambda m: (size[m], -m)) if size else -1
    around = {box for b in blocks if b.main == article >= 0 for box in b.boxes}
    inside = {box for b in blocks if b.main == article >= 0 for box in b.boxes if held[box] < size[article]}
    wraps = around - inside | ({box for box in held if 2 * held[box] >= total} if article < 0 else set())
    own = [(float(b.words), b.linked / b.words) for b in blocks]
    side = lambda i: own[i] if 0 <= i < len(own) else (0.0, 0.0)
    named = [float(max((strength[x] for x in b.boxes if x not in wraps), default=0)) for b in blocks]
    return [
        [*own[i], *side(i - 1), *side(i + 1), float(b.tag in HEADINGS), float(b.tag in TEXTS), alike[b.tag] / total, float(b.main == article >= 0), float(article >= 0), float(b.furniture), named[i]]
        for i, b in enumerate(blocks)
    ]


#: Words that labelled pages are made of; the tree reads no words, only how many there are.
_FILL = "alder birch cedar elm fir hazel ivy juniper larch maple oak pine rowan spruce willow yew".split()
#: Labelled pages: N words stand for ``{N}``, elements with ``data-main`` are main text, all others are not. ``@`` takes any name.
LABELLED = (
    "<nav><ul><li><a>{1}</a></li><li><a>{2}</a></li></ul></nav><div class=ad>{9}</div><article><h1 data-main>{4}</h1><p data-main>{40}</p><p data-main>{2}</p><p data-main>{80}</p><p data-main>{1}</p></article><footer>{5}</footer>",
    "<header>{6}</header><main><h1 data-main>{3}</h1><p data-main><a>{3}</a></p><p data-main>{30}</p><section id=discussion><h2 data-main>{1}</h2><p data-main>{45}</p></section><p class=header data-main>{12}</p></main><aside>{12}</aside><section class=comments><p>{25}</p><p>{30}</p></section><form>{6}</form>",
    "<div id=menu><a>{1}</a> <a>{1}</a></div><div><p data-main>{30}</p><p data-main>{45}</p><p data-main>{3}</p><p data-main>{28}</p></div><div><a>{2}</a> <a>{2}</a></div><div class=cookie-notice>{14}</div>",
    "<ul><li><a>{2}</a></li><li><a>{1}</a></li><li><a>{3}</a></li></ul><h1 data-main>{5}</h1><p data-main>{35}</p><p data-main>{4}</p><p data-main>{50}</p><p><a>{4}</a></p><div id=sidebar>{7}</div>",
    "<article><p data-main>{1}</p><p data-main>{30}</p><aside class=related>{9}</aside><ul><li data-main>{4}</li><li data-main><a>{1}</a></li></ul><p data-main>{25}</p><div class=@>{8}</div><form>{6}</form></article><footer><p>{1}</p></footer>",
    "<div class=@><a>{1}</a> <a>{1}</a> <a>{2}</a></div><div class=@><h1 data-main>{4}</h1><p data-main>{40}</p><div class=@>{8}</div><p data-main>{55}</p><p data-main>{6}</p><p data-main>{33}</p></div><div class=@>{7}</div><div class=@>{5}</div>",
    "<div id='content-with-sidebar'><article><h1 data-main>{4}</h1><p data-main>{40}</p><p data-main>{3}</p><div class='ad banner'>{10}</div><p data-main>{60}</p></article><div id=sidebar>{16}</div></div><div class=@>{9}</div>",
    "<div class=@><div class=@>{3}</div><div class=@><a>{2}</a></div><div class=@><a>{3}</a></div></div><main><div class=@><div data-main>{40}</div><div data-main>{5}</div><div data-main>{35}</div></div></main><div class=@>{8}</div><div class=@><a>{1}</a></div>",
    "<table><tr><td><a>{1}</a></td><td><a>{1}</a></td></tr></table><p data-main>{60}</p><blockquote data-main>{20}</blockquote><p data-main>{45}</p><p data-main>{2}</p><p data-main>{30}</p><table><tr><td>{6}</td></tr></table><div class=@>{4}</div>",
    "<div class='page widget-page'><h1 data-main>{5}</h1><p data-main>{50}</p><h2 data-main>{2}</h2><p data-main>{33}</p><p data-main>{9}</p><p data-main>{27}</p><ul class=@><li><a>{3}</a></li><li><a>{4}</a></li><li><a>{3}</a></li></ul></div><div class=@>{10}</div>",
    "<main><article><h1 data-main>{3}</h1><p data-main>{70}</p><p class=ad>{6}</p><p data-main>{45}</p><header><p data-main>{8}</p></header><p data-main>{1}</p></article><div class=comments><article><p>{20}</p></article><article><p>{9}</p></article></div></main><div role=contentinfo>{5}</div>",
    "<nav><a>{1}</a></nav><div class=@>{14}</div><article><h1 data-main>{13}</h1><p data-main>{60}</p><h2 data-main>{9}</h2><p data-main>{40}</p><ul><li data-main>{12}</li><li data-main>{9}</li></ul><p data-main>{55}</p><blockquote data-main>{18}</blockquote><div class=@>{10}</div><p data-main>{48}</p></article><div class=@>{13}</div>",
    "<div class=@>{16}</div><div class=@><h1 data-main>{12}</h1><p data-main>{44}</p><h2 data-main>{8}</h2><p data-main>{52}</p><ol><li data-main>{10}</li><li data-main>{14}</li></ol><p data-main>{38}</p></div><div class=@>{12}</div><div class=@><p><a>{3}</a></p></div>",
    "<p data-main>{2}</p>",
    "<p data-main>{60}</p>",
    "<h1 data-main>{4}</h1><p data-main>{30}</p><p data-main>{14}</p>",
    "<nav><a>{1}</a></nav><article><h1 data-main>{3}</h1><p data-main>{50}</p><p data-main>{2}</p></article>",
    "<div data-main>{40}</div>",
    "<div data-main>{3}</div>",
    "<div class=@>{11}</div><article><h2 data-main>{3}</h2><p data-main>{22}</p><table><tr><td data-main>{2}</td><td data-main>{3}</td></tr></table><p data-main>{31}</p><pre data-main>{12}</pre></article><p>{6}</p><p><a>{2}</a></p>",
)


def labelled_pages(copies: int = 8, seed: int = 1) -> list[str]:
    """The labelled table: copies of every page with other word counts (by a half each way) and class names."""
    rng = random.Random(seed)
    count = lambda m: " ".join(rng.choice(_FILL) for _ in range(max(1, round(int(m[1]) * rng.uniform(0.6, 1.5)))))
    name = lambda m: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    return [re.sub("@", name, re.sub(r"\{(\d+)\}", count, page)) for page in LABELLED for _ in range(copies)]


class _Truth(HTMLParser):
    """Texts of the elements with data-main."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.texts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depth or any(k == "data-main" for k, _ in attrs):
            if not self.depth:
                self.texts.append("")
            self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        self.depth -= self.depth > 0

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.texts[-1] += data


def labelled_blocks(pages: list[str]) -> list[tuple[list[float], float]]:
    """Features and label of every block of pages; a block is main text if the next labelled text in page order is its own."""
    out = []
    for page in pages:
        truth = _Truth()
        truth.feed(page)
        left = [" ".join(t.split()) for t in truth.texts]
        blocks, strength = page_blocks(page)
        for x, b in zip(features(blocks, strength), blocks, strict=True):
            hit = bool(left) and b.text == left[0]
            left = left[hit:]
            out.append((x, float(hit)))
    return out


def train(spark: SparkSession) -> list:
    """The tree as nested lists [feature, threshold, low side, high side], leaves as True or False."""
    data = spark.createDataFrame([(Vectors.dense(x), y) for x, y in labelled_blocks(labelled_pages())], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=3, maxBins=64, seed=1).fit(data.coalesce(1))

    def walk(node) -> list | bool:
        if node.numDescendants() == 0:
            return node.prediction() > 0.5
        return [node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())]

    return walk(model._call_java("rootNode"))


def as_column(tree: list | bool, values: list[Column]) -> Column:
    if isinstance(tree, bool):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(values[feature] <= threshold, as_column(low, values)).otherwise(as_column(high, values))


_CUT = "page_id long, url string, blocks array<struct<text:string,x:array<double>>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("x", pa.list_(pa.float64()))]))
    for batch in batches:
        pages = [page_blocks(html or "") for html in batch.column(2).to_pylist()]
        cut = [[{"text": b.text, "x": x} for b, x in zip(blocks, features(blocks, strength), strict=True)] for blocks, strength in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, kind)], ["page_id", "url", "blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    tree = train(spark)
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_cut, _CUT)

    def chosen(block: Column) -> Column:
        return as_column(tree, [block["x"][i] for i in range(len(FEATURES))])

    text = F.array_join(F.transform(F.filter("blocks", chosen), lambda b: b["text"]), "\n")
    return cut.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
