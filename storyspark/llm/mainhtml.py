"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each is described by its words and link density, those of the
blocks before and after it, and by what kind of element holds it; a decision tree, grown from the blocks of
the small labelled pages below, tells content from boilerplate.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Elements of the HTML standard by their part in a page.
SILENT = frozenset("script style noscript template head title svg math object iframe canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul".split()
)
FRAME = frozenset("nav header footer aside form menu dialog search button select textarea fieldset option label".split())
BODY = frozenset("article main".split())
#: Names (class, id, role) of what is not the article's own text, and of what is.
FRAME_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|banner|sponsor\w*|promo\w*|consent|notices?|modal|sign-?up|log-?in|search|nav\d*|menu|widget|foot|header|related|"
    r"shar(?:e|ing)|social|repl(?:y|ies)|tags?)(?:$|[^a-z])"
    r"|advert|cookie|newsletter|subscri[bp]|sidebar|breadcrumb|footer|navigation|pagination|popup|comment(?!ar|at)"
)
BODY_WORDS = re.compile(r"(?:^|[^a-z])(?:article\w*|post|entry|story|content|main|body|text)(?:$|[^a-z])")
#: What may stand in a head; any other element, or text, ends one that is open.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SPACE = re.compile(r"\s+")
HEADING = re.compile("h[1-6]")
#: A tag that the end of the page cuts off.
UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_frame", "named", "in_body", "outside", "heading")

# The labelled pages: invented, read by hand. {n} stands for n words, {n/m} for n of which the first m are a
# link. The digits are the labels of a page's blocks in order, 1 for content.
LABELLED = (
    # an article with menu, advert and footer; its paragraphs are long and short
    ("<nav><ul><li>{1/1}<li>{1/1}<li>{2/2}</ul></nav><div class=ad>{9}</div><article><h1>{7}</h1><p>{85}<p>{64/2}<p>{3}<p>{41/6}<p>{1}<p>{12}</article><footer>{8}</footer>", "0000" "1111111" "0"),
    ("<nav>{5/5}</nav><div>{11}</div><article><h1>{9}</h1><p>{6}<p>{2}<p>{1}</article><div>{14/3}</div><footer>{12/2}</footer>", "00" "1111" "00"),
    # what an article holds besides its text: a menu of links, tools, asides, forms, readers
    ("<article><h1>{6}</h1><p>{30}<nav><ul><li>{3/3}<li>{2/2}<li>{4/4}<li>{3/3}</ul></nav><p>{25/5}<p>{6/6}<p>{28}<div class=share>{2/2}</div><aside>{25}</aside><form><label>{2}</label></form><p>{40}<section id=comments><p>{60}<p>{8}</section></article>", "11" "0000" "111" "000" "1" "00"),
    ("<article><p>{22}<div class=menu><p>{2/2}<p>{3/3}<p>{2/2}</div><p>{31/3}<p>{8/8}<p>{17/7}<ul><li>{2/2}<li>{4/1}<li>{3/3}</ul></article><aside><p>{35}<p>{4/4}</aside>", "1" "000" "111111" "00"),
    ("<article><p>{18}<p>{5/5}<p>{3/1}<p>{2/2}<p>{44}<div class=related>{30}<p>{4/4}</div></article><div class=newsletter>{40}</div>", "11111" "00" "0"),
    # short articles
    ("<header>{3}</header><main><h1>{8}</h1><p>{1}<p>{2}<p>{1}</main><footer>{20}</footer>", "0" "1111" "0"),
    ("<article><p>{3}</article>", "1"), ("<article><h1>{4}</h1><p>{150}</article><div>{40}</div>", "11" "0"), ("<article><p>{2/2}</article>", "1"),
    ("<nav>{3/3}</nav><article><h1>{5}</h1><p>{30}<p>{9}</article>", "0" "111"), ("<div>{2/2}</div><div>{4/4}</div><article><h2>{4}</h2><p>{2}</article><footer>{2/2}</footer>", "00" "11" "0"),
    ("<header>{2/2}<p>{6}</header><main><p>{4}<p>{19}<p>{3/3}<p>{5}<p>{1}</main><nav>{2/2}</nav>", "00" "11111" "0"),
    # short lines of an article behind links that are none of it
    ("<article><p>{40}<div class=share>{1/1}</div><ul><li>{2}<li>{2}</ul><nav>{3/3}</nav><p>{1}<p>{6}<aside>{5/5}</aside><p>{3}<aside>{30/30}</aside><h3>{2}</h3><p>{21}</article>", "1" "0" "11" "0" "11" "0" "1" "0" "11"),
    ("<nav>{25/25}</nav><article><h1>{1}</h1><p>{2}<div class=related>{22/22}</div><p>{5}<div class=social>{2/2}</div><p>{3}</article>", "0" "11" "0" "1" "0" "1"),
    ("<div>{3/3}</div><h1>{8}</h1><p>{49}<p>{22}<p>{2/2}", "0" "111" "0"), ("<div>{2/2}</div><h2>{5}</h2><div>{64}</div><div>{30}</div>", "0" "111"),
    # wrappers that are named for what they also hold, a form around the page, an article's own header
    ("<div class=content-sidebar-wrap><nav>{4/4}</nav><article><h1>{6}</h1><p>{70}<p>{4}<p>{35/3}</article><aside>{25}</aside></div><footer>{9}</footer>", "0" "1111" "0" "0"),
    ("<form><div class=menu>{3/3}</div><div id=content><h2>{4}</h2><p>{60}<p>{12}<div class=comments><p>{30}</div></div><label>{2}</label></form>", "0" "111" "0" "0"),
    ("<div class=has-sidebar><main><header><h1>{7}</h1><p>{5}</header><p>{45}<p>{3}</main><div id=sidebar><p>{28}</div></div>", "1" "0" "11" "0"),
    # names instead of elements
    ("<div id=header>{4}</div><div id=content><h2>{5}</h2><p>{50}<p>{4}<p>{33}<div class=ads>{16}</div><p>{9}</div><div id=sidebar><h3>{2}</h3><p>{30}<p>{25/4}</div><div class=cookie-notice>{25}</div>", "0" "1111" "0" "1" "000" "0"),
    ("<div class=menu><a>{1}</a> <a>{2}</a></div><div class=post><p>{12}<p>{70}</div><div class=comments><p>{45}</div>", "01" "10"),
    # neither elements nor names: long or dense runs of text are content, lone lines and links are not
    ("<div>{1/1}</div><div>{1/1}</div><div>{2/2}</div><div>{45}</div><div>{52/3}</div><div>{38}</div><div>{14}</div><div>{16}</div><div>{2/2}</div><div>{3/3}</div><div>{3}</div>", "000" "11111" "000"),
    ("<h1>{6}</h1><p>{45}<p>{5}<p>{50}<p>{3/3}", "1111" "0"), ("<p>{2/2}<p>{3}<p>{2/2}<p>{3}", "0000"), ("<p>{2/2}<p>{5}<p>{3/3}<p>{4}<p>{2/2}<p>{6}<p>{4/4}", "0000000"), ("<p>{150}", "1"), ("<p>{24}", "1"), ("<p>{3}", "0"),
    ("<div>{9/9}</div><div>{8/8}</div><div>{30/27}</div><h3>{4}</h3><div>{28/25}</div><div>{9/9}</div>", "000000"),
    ("<div>{5/5}</div><div>{40}</div><div>{4}</div><div>{48}</div><div>{11}</div><div>{24/2}</div><div>{5/4}</div><div>{3}</div>", "0" "11111" "00"),
    ("<div>{4/4}<p>{6}</div><h2>{7}</h2><p>{33}<p>{18}<h2>{3}</h2><p>{61/5}<div>{18/11}</div><div>{3/3}</div>", "00" "11111" "00"),
)
PLACEHOLDER = re.compile(r"\{(\d+)(?:/(\d+))?\}")


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: list[tuple]):
        labels = [r[-1] for r in rows]
        self.label = int(2 * sum(labels) >= len(labels))
        self.feature = None
        if len(set(labels)) < 2:
            return
        best = (1e9, 0, 0.0)
        for f in range(len(rows[0]) - 1):
            values = sorted({r[f] for r in rows})
            for low, high in zip(values, values[1:], strict=False):
                cut = (low + high) / 2
                score = 0.0
                for side in ([r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]):
                    p = sum(side) / len(side)
                    score += len(side) * p * (1 - p)
                best = min(best, (round(score, 9), f, cut))
        if best[0] == 1e9:
            return
        _, self.feature, self.cut = best
        self.low = Tree([r for r in rows if r[self.feature] <= self.cut])
        self.high = Tree([r for r in rows if r[self.feature] > self.cut])

    def predict(self, row: tuple) -> int:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.label


class Block:
    __slots__ = ("body", "frame", "heading", "held", "linked", "named", "text", "words")

    def __init__(self, text: str, linked: int, held: list[Element], heading: bool):
        self.text, self.words = text, len(text.split())
        self.linked = min(1.0, linked / max(1, self.words))
        self.held, self.heading = held, heading
        for e in held:
            e.words += self.words

    def settle(self, total: int) -> None:
        """Say what holds the block, once the page's words are known."""
        kinds = {e.kind for e in self.held if not e.wraps(total)}
        self.frame, self.named, self.body = ("frame" in kinds or ("lead" in kinds and not self.heading), "named" in kinds, "body" in kinds)


class Element:
    """An open element: kind is silent, frame, named, body, lead (an article's own header) or empty."""

    __slots__ = ("bodied", "kind", "tag", "within", "words")

    def __init__(self, tag: str, kind: str, within: bool):
        self.tag, self.kind, self.within = tag, kind, within
        self.words, self.bodied = 0, False

    def wraps(self, total: int) -> bool:
        """Whether a name or element that would make it a frame only dresses the page: the body and most words lie in it."""
        return self.kind in ("frame", "named") and self.bodied and not self.within and 2 * self.words > total


class BlockParser(HTMLParser):
    """Flat text blocks of a page. Elements left open end with what holds them; what opens a frame or
    the body counts for all inside it, however deep, unless it wraps the page's body. In the header of an article its
    headings are content."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.bodies = 0

    @staticmethod
    def _kind(tag: str, attrs: list) -> str:
        if tag in SILENT:
            return "silent"
        held = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in held or held.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", held.get("style", "")):
            return "silent"
        named = " ".join(held.get(k, "") for k in ("class", "id", "role"))
        if tag in FRAME:
            return "frame"
        if tag in ("html", "body") or HEADING.fullmatch(tag):
            return ""
        if FRAME_WORDS.search(named):
            return "named"
        return "body" if tag in BODY or BODY_WORDS.search(named) else ""

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            heading = any(HEADING.fullmatch(e.tag) for e in self.open)
            self.blocks.append(Block(text, self.linked, [e for e in self.open if e.kind], heading))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self._end_head()
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            self._break(tag)
            return
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or HEADING.fullmatch(tag):
            self._end_same(tag)
        kind, within = self._kind(tag, attrs), self.bodies > 0
        if kind == "body":
            for e in self.open:
                e.bodied = True
        if tag == "header" and kind == "frame" and within and not any(e.kind in ("frame", "named") and e.within for e in self.open):
            kind = "lead"
        self.open.append(Element(tag, kind, within))
        self.bodies += kind == "body"
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self._end_head()
        if tag in BLOCKS:
            self._flush()
        self._break(tag)

    def _break(self, tag: str) -> None:
        """A line break is white space inside its block."""
        if tag == "br":
            self.parts.append(" ")

    def _end_same(self, tag: str) -> None:
        """An open element of the same sort ends where the next begins, unless another block lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in BLOCKS:
                return

    def _end_head(self) -> None:
        """A head whose end tag is left out ends here, unless an element inside it is open."""
        if self.open and self.open[-1].tag == "head":
            self._close(len(self.open) - 1)

    def _close(self, k: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.open[k:])
        self.bodies -= sum(e.kind == "body" for e in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if tag not in BLOCKS and self.open[k].tag in BLOCKS and tag not in SILENT:
                return  # an inline end tag does not reach out of its block

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if data and not any(e.kind == "silent" for e in self.open):
            self.parts.append(data)
            if self.links:
                self.linked += len(data.split())


def text_blocks(page: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(UNFINISHED.sub("", page))
    parser.close()
    parser._flush()
    total = sum(b.words for b in parser.blocks)
    for b in parser.blocks:
        b.settle(total)
    return parser.blocks


def describe(blocks: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block; beyond either end there is an empty block. A block is outside if it
    is not in the body that the page has."""
    size = [0, *(b.words for b in blocks), 0]
    links = [0.0, *(b.linked for b in blocks), 0.0]
    bodied = any(b.body and not b.frame and not b.named for b in blocks)
    return [
        (b.words, b.linked, size[i], links[i], size[i + 2], links[i + 2], int(b.frame), int(b.named), int(b.body), int(bodied and not b.body), int(b.heading))
        for i, b in enumerate(blocks)
    ]


def labelled_rows(pages: tuple = LABELLED) -> list[tuple]:
    """A row of FEATURES and the label of every block of labelled pages."""

    def fill(m: re.Match) -> str:
        n, linked = int(m[1]), int(m[2] or 0)
        return f"<a href=x>{'link ' * linked}</a>" * (linked > 0) + " word" * (n - linked)

    rows = []
    for page, labels in pages:
        own = describe(text_blocks(PLACEHOLDER.sub(fill, page)))
        rows += [(*row, int(label)) for row, label in zip(own, labels, strict=True)]
    return rows


def main_text(page: str | None, tree: Tree) -> str:
    blocks = text_blocks(page or "")
    return "\n".join(b.text for b, row in zip(blocks, describe(blocks), strict=True) if tree.predict(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; text is empty where there is none, also for null html.

    Rows may repeat; other columns are ignored; an empty table gives no rows; markup that breaks off is
    read as far as it goes; a page is one value, read whole however long, and its blocks are held at once."""

    def run(batches):
        tree = Tree(labelled_rows())
        for b in batches:
            texts = [main_text(x.as_py(), tree) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
