"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into blocks at its block-level tags, in one pass and without a document tree. A block
has its count of words and the share of them in links, the same of its neighbours before and behind
it, whether it is a heading, and the zone it stands in (what the tags, classes and roles around it
say). A decision tree, trained on a small table of labelled blocks, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_outputs

# Fixed values of HTML: elements whose content is no text of the page (of RAW ones it goes on to the end of the
# page where it has none of its own), elements without an end, and block-level elements.
RAW = "script style title textarea xmp iframe noembed noframes"
SILENT = "noscript template select button object svg canvas audio video datalist"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul"
)
#: Elements that a new one of the same kind ends, and the elements that such an end does not leave.
IMPLIED = {
    "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
}
HOLDERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table td th ul".split())
#: Words of classes, ids and roles, and tags, that speak for and against the article.
AGAINST = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie"
    " cookies disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager"
    " pagination popup promo promoted recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe tags toolbar topbar widget complementary contentinfo alert alertdialog".split()
)
AGAINST_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
FOR = frozenset("article main".split())
#: Words before another that say it is only next to the element: with-sidebar.
BESIDE = frozenset("has no with without after before above below".split())

_RAW, _SILENT, _VOID, _BLOCK = (frozenset(x.split()) for x in (RAW, SILENT, VOID, BLOCK))
_IMPLIED = {k: frozenset(v.split()) for k, v in IMPLIED.items()}
_START = re.compile(r"<(?=[a-z!/?])", re.I)
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.I)
_PLAIN = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>[^>]*+)>", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in _RAW | _SILENT}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "zone", "heading"]
#: Zones: something around the block speaks against it, nothing does though the page marks an article
#: elsewhere, nothing does, the block stands in a marked article.
AGAINST_ZONE, ELSEWHERE, NEUTRAL, MARKED = -1.0, 0.0, 1.0, 2.0


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, attributes) of every tag of a page, and (start, end, False, "", "")
    for comments and silent elements. Linear in the page: what has no end is looked for once."""
    at, quotes, endless = 0, True, set()
    while m := _START.search(page, at):
        at = m.start()
        if page.startswith("<!--", at):
            end = _COMMENT.match(page, at).end()
            yield at, end, False, "", ""
            at = end
            continue
        tag = _TAG.match(page, at) if quotes else _PLAIN.match(page, at)
        if tag is None and page[at + 1].isalpha() and quotes:
            quotes, tag = False, _PLAIN.match(page, at)
        if tag is None:
            # a declaration, or a tag that the page ends within
            end = page.find(">", at) + 1 or len(page)
            yield at, end, False, "", ""
            at = end
            continue
        name, end = tag["name"].lower(), tag.end()
        if not tag["end"] and name in _ENDS and name not in endless and not (name == "svg" and tag["rest"].endswith("/")):
            closing = _ENDS[name].search(page, end)
            if closing or name in _RAW:
                end = closing.end() if closing else len(page)
                yield at, end, False, "", ""
                at = end
                continue
            endless.add(name)
        yield at, end, bool(tag["end"]), name, tag["rest"]
        at = end


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: float
    heading: bool


def speaks(name: str, rest: str, within_article: bool) -> int:
    """-1, 0 or 1: what an element's tag, class, id, role or hiding says of its content."""
    said = 1 if name in FOR else -1 if name in AGAINST_TAGS or (name == "header" and not within_article) else 0
    if not rest or name in ("html", "body"):
        return said
    for key, value in _NAMED.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return -1
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return -1
        if key in ("class", "id", "role"):
            for token in value.split():
                words = _WORD.findall(token)
                if any(w in AGAINST and (i == 0 or words[i - 1] not in BESIDE) for i, w in enumerate(words)):
                    return -1
                if said == 0 and words and words[-1] in FOR:
                    said = 1
    return said


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in its order; character references decoded, white space one space."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []  # open block-level elements: name, what they say
    names: Counter[str] = Counter()
    against = favoured = 0
    link_depth, marked, head = -1, False, False

    def close() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(p.split()) for p, in_link in pieces if in_link)
                zone = AGAINST_ZONE if against else MARKED if favoured else NEUTRAL
                words = text.count(" ") + 1
                out.append(Block(text, words, min(words, linked), zone, bool(stack) and stack[-1][0] in _HEADINGS))
            pieces.clear()

    def pop() -> None:
        nonlocal against, favoured, link_depth
        name, said = stack.pop()
        names[name] -= 1
        against -= said < 0
        favoured -= said > 0
        if len(stack) < link_depth:
            link_depth = -1

    def add(piece: str) -> None:
        if piece and not head:
            pieces.append((html.unescape(piece) if "&" in piece else piece, link_depth >= 0))

    at = 0
    for start, stop, ends_here, name, rest in tags_of(page):
        if start > at:
            add(page[at:start])
        at = stop
        if name == "head":
            head = not ends_here
        elif name == "a":
            link_depth = -1 if ends_here else len(stack)
        elif name == "br":
            add(" ")
        elif name in _BLOCK:
            if name == "body":
                head = False
            close()
            if ends_here:
                while names[name]:
                    last = stack[-1][0]
                    pop()
                    if last == name:
                        break
            elif name not in _VOID:
                ends = _IMPLIED.get(name)
                if ends and any(names[e] for e in ends):
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in ends and stack[k][0] not in HOLDERS:
                        k -= 1
                    if k >= 0 and stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                elif names["p"] and stack[-1][0] == "p":
                    pop()  # a paragraph holds no blocks
                said = speaks(name, rest, favoured > 0)
                stack.append((name, said))
                names[name] += 1
                against += said < 0
                favoured += said > 0
                marked = marked or (said > 0 and not against)
    if at < len(page):
        add(page[at:])
    close()
    if marked:
        for b in out:
            if b.zone == NEUTRAL:
                b.zone = ELSEWHERE
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of every block of a page; a missing neighbour has no words."""
    own = [(float(b.words), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], b.zone, float(b.heading)) for i, b in enumerate(blocks)]


# The labelled pages. {12} stands for twelve words, {a3} for a link of three; * marks a block of the article.
_MENU = "<ul><li>{a1}<li>{a2}<li>{a1}<li>{a1}</ul>"
LABELLED_PAGES = [
    f"<body><nav>{_MENU}</nav><div class=ad>{{9}}</div><article><h1>*{{8}}</h1><p>*{{60}}<p>*{{1}}<p>*{{25}}<p>*{{3}}</article><footer>{{14}}</footer>",
    f"<body><nav>{_MENU}</nav><div class=ad>{{40}}</div><article><h1>*{{4}}</h1><p>*{{5}}</article><footer>{{9}} {{a2}}</footer>",
    "<body><nav>{a1} {a2}</nav><article><p>*{1}</article><footer>{30}</footer>",
    f"<body><header>{{2}}{_MENU}</header><main><h1>*{{7}}</h1><p>*{{45}} {{a2}} {{20}}<h2>*{{3}}</h2><ul><li>*{{6}}<li>*{{9}}</ul><p>*{{15}}</main>"
    "<aside><h3>{2}</h3><p>{25}</p>{a4}</aside><footer><p>{12}<p>{a1} {a1}</footer>",
    f"<body><div id=menu>{_MENU}</div><div id=wrap><h1>*{{6}}</h1><p>*{{50}}<p>*{{30}}<p>*{{70}}</div><div id=footer>{{11}}</div>",
    f"<body><div>{_MENU}</div><div><h1>*{{6}}</h1><p>*{{55}}<p>*{{40}}<p>*{{35}}<p>*{{18}}</div><div>{{a1}} {{a1}} {{a2}}</div><div>{{6}}</div>",
    "<body><p>{a2} {a1} {a3}<h1>*{5}</h1><p>*{80}<p>*{22}<p>*{64}<p>{a2} {a2}<p>{4}",
    "<body><div>{3}</div><div>{a2}</div><h2>*{7}</h2><div>*{48}</div><div>*{33}</div><div>{a4}</div><div>{a3}</div><div>{5}</div>",
    "<body><article><h1>*{6}</h1><p>*{44}<p>*{a3}<p>*{38}<div class=related><h3>{2}</h3><ul><li>{a5}<li>{a6}</ul></div></article><div>{8}</div>",
    "<body><article><h1>*{9}</h1><p>*{31}<p>*{12} {a3}<p>*{28}<ul><li>{a5}<li>{a6}<li>{a4}<li>{a7}</ul></article><footer>{7}</footer>",
    "<body><main><h1>*{5}</h1><p>*{2}<p>*{4}<p>*{1}<blockquote>*{16}</blockquote><div class=promo>{20}</div><p>*{3}</main><section id=comments><h3>{2}</h3>"
    "<p>{35}<p>{18}<p>{52}</section><form><p>{6}<label>{2}</label></form>",
    "<body><div class=cookie-notice>{24} {a1}</div><nav>{a1} {a1} {a1}</nav><article><h1>*{10}</h1><p>*{90}<table><tr><td>*{1}<td>*{2}<tr><td>*{2}<td>*{1}</table>"
    "<p>*{26}<section class=comments><p>{44}<p>{17}</section></article><aside>{30}</aside>",
    "<body><div class=header>{4}</div><div class=sidebar>{a2}<p>{28}</div><div class=post><h1>*{6}</h1><p>*{61}<p>*{14}<p>*{37}</div><div class=footer>{10}</div>",
    "<body><nav>{a1} {a2} {a1}</nav><div class=ad>{12}</div><footer>{8}</footer>",
    "<body><p>{a1} {a1} {a1}<p>{3}",
    "<body><h1>*{4}</h1><p>*{42}<p>*{36}",
    "<body><p>*{57}",
    "<body><article><h1>*{3}</h1><p>*{2}<p>*{1}</article><div>{45}</div><div>{22} {a2}</div>",
    "<body><div>{20}</div><main><p>*{9}<p>*{70}<p>*{5}</main><div>{33}</div>",
    "<body><article><h1>*{5}</h1><p>*{20} {a3} {6}<p>*{1}</article>",
    "<body><article><p>*{3}<p>*{14} {a2}<p>*{40} {a4} {9}<p>*{2}</article>",
    "<body><article><h1>*{2}</h1><p>*{1}</article>",
    "<body><article>*{4}</article>",
    "<body><main><h1>*{3}</h1><p>*{8} {a4}<p>*{11}</main>",
    "<body><article><h1>*{4}</h1><p>*{12}<p>*{a2}<p>*{6}</article>",
    "<body><article><h1>*{3}</h1><p>*{2}<ul><li>{a5}<li>{a6}<li>{a4}</ul></article>",
    "<body><article><h1>*{2}</h1><p>*{a3}<p>*{20}<p>*{1}</article>",
    "<body><h1>*{5}</h1><p>*{33} {a2} {12}<p>*{41} {a1}<p>*{19}<p>{a2} {a1}",
]
_FILL = re.compile(r"\{(a?)(\d+)\}")


def _filled(page: str) -> str:
    words = lambda m: " ".join(["word"] * int(m[2]))
    return _FILL.sub(lambda m: f"<a href=x>{words(m)}</a>" if m[1] else words(m), page)


def labelled_blocks(spark: SparkSession, pages: list[str] = LABELLED_PAGES) -> DataFrame:
    """FEATURES and label of every block of the labelled pages."""
    rows = []
    for page in pages:
        blocks = blocks_of(_filled(page))
        rows += [(*f, float(b.text.startswith("*"))) for f, b in zip(features_of(blocks), blocks, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*FEATURES, "label")))


#: A node: (feature, threshold, below or equal, above), or the answer.
Tree = tuple | bool


def fitted_tree(labelled: DataFrame, depth: int = 6, seed: int = 7) -> Tree:
    """The decision tree of labelled blocks (FEATURES, label 0 or 1)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="f").transform(labelled)
    model = DecisionTreeClassifier(featuresCol="f", labelCol="label", maxDepth=depth, maxBins=64, seed=seed).fit(rows)

    def taken(node) -> Tree:
        if node.subtreeDepth() == 0:
            return node.prediction() > 0.5
        split = node.split()
        return split.featureIndex(), split.threshold(), taken(node.leftChild()), taken(node.rightChild())

    return taken(model._call_java("rootNode"))


def is_article(tree: Tree, features: tuple[float, ...]) -> bool:
    while tree is not True and tree is not False:
        feature, threshold, low, high = tree
        tree = low if features[feature] <= threshold else high
    return tree


def main_text(page: str, tree: Tree) -> str:
    """The article's blocks, a line each."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, f in zip(blocks, features_of(blocks), strict=True) if is_article(tree, f))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: DataFrame | None = None
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page and its length in code points.

    Blocks of the article are lines in page order; nothing is shortened. Null and empty pages and
    pages without an article have an empty text. Rows are judged each, so repeated ids and null ids
    or urls stay as they are. Elements left open and pages that end within a tag are read as far as
    they go. labelled (FEATURES, label) replaces the labelled blocks of this module. Columns beyond the
    three are not read.
    """
    tree = fitted_tree(labelled if labelled is not None else labelled_blocks(pages.sparkSession))

    def build() -> Callable[[list[bytes | None]], list[pa.Array]]:
        def run(texts: list[bytes | None]) -> list[pa.Array]:
            found = [main_text(t.decode("utf-8", "replace"), tree) if t else "" for t in texts]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return run

    keep = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url")]
    return with_outputs(pages, keep, F.col(html_col).cast("string"), {"text": "string", "n_chars": "bigint"}, build)
