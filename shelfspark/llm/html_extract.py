"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at the tags that start or end a block; inline tags
leave no trace and a line break is white space. The tree sees of each block its
word count and link density, those of the blocks before and behind it, whether
it is a heading or a list item, and two facts from the tags around it: whether
they say main text (``article``, ``main``) or something else (``nav``, ``aside``,
``form``, a class like ``sidebar`` or ``comment-list``). A name counts if all of its words do: ``market-share``
and ``post-header`` say nothing. Words in names count on block
elements only, not on html, body, main, nor where they name a layout (``has-sidebar``,
``no-banner``). ``main``, and the page's first ``article``, take the mark from
what is around them; an article does not take it from ``aside``, ``nav`` or an element whose
whole name is such a word, where teasers and comments stand. A form around the whole page is no
mark. The tree is trained with Spark ML on
the labelled table below: 600 small pages, of which half name neither article nor
menus. On such pages a block with at most about six tenths of its words in links is main text if it is
long enough, and a short one if what stands before and behind it is text and not links.
Outside ``article`` and ``main`` a block of a few words beside a list of links is no main text; a long
one that neither a tag nor a name sets apart is.

Results for odd input: null html counts as empty and gives an empty text, like a
page without blocks. Unclosed tags end with the page; an unclosed script, style
or comment hides the rest, as in a browser. Repeated rows give repeated rows; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.rows import bounded_batches

# Fixed values of HTML: elements whose content is no text, and those that start and end a block.
SILENT = ["script", "style", "noscript", "template", "title", "textarea", "select", "button", "svg", "iframe", "object", "canvas", "math"]
BLOCK = [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
VOID = ["hr", "br", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"]
#: A new one of these ends an open one.
CLOSES = {"p": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
MAIN = ["article", "main"]
ASIDE = ["nav", "aside", "footer", "form", "menu", "dialog", "fieldset"]
#: Words in a class, id or role that name something other than the main text.
ASIDE_WORDS = [
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "form", "gdpr",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "teaser", "toolbar", "topbar", "widget", "widgets",
]
#: Words that leave a name's meaning as it is when they stand beside one of those.
PLAIN_WORDS = ["area", "bar", "block", "bottom", "box", "container", "inner", "left", "links", "list", "policy", "posts", "right", "section", "site", "thread", "top", "wrap", "wrapper"]

_SILENT, _BLOCK, _VOID, _HEADINGS, _MAIN, _ASIDE, _WORDS, _PLAIN = map(frozenset, (SILENT, BLOCK, VOID, HEADINGS, MAIN, ASIDE, ASIDE_WORDS, PLAIN_WORDS))
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_LAYOUT = re.compile(r"(?:has|have|with|without|no|not)[-_]", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = ["words before", "words", "words behind", "links before", "links", "links behind", "heading", "item", "main", "aside"]
Block = tuple[str, int, int, bool, bool, bool, bool]  # text, words, words in links, heading, item, main, aside


def _aside(tag: str, attributes: str) -> int:
    """2: something other than main text; 1: likely so, unless the page's article is inside; 0: nothing says so."""
    if tag in ("html", "body"):
        return 0
    if _HIDDEN.search(attributes):
        return 2
    by_tag = (1 if tag in ("form", "fieldset") else 2) if tag in _ASIDE else 0
    if tag == "main" or tag not in _BLOCK or not attributes:
        return by_tag
    # ``has-sidebar`` and ``no-banner`` name a layout
    names = [n for found in _NAMED.findall(attributes) for n in "".join(found).split() if not _LAYOUT.match(n)]
    if any(n.lower() in _WORDS for n in names):
        return 2
    parts = [{w.lower() for w in _PART.findall(n)} for n in names]
    return by_tag or int(tag != "article" and any(p & _WORDS and p <= _WORDS | _PLAIN for p in parts))


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, main, aside
    pieces: list[str] = []
    linked: list[str] = []
    in_link = seen_article = False
    at, size = 0, len(page)

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            words = text.count(" ") + 1 if text else 0
            links = len("".join(linked).split())
            linked.clear()
            if words:
                top = stack[-1] if stack else ("", False, 0)
                tags = [t for t, _, _ in stack[-3:]]
                out.append((text, words, min(links, words), any(t in _HEADINGS for t in tags), "li" in tags, top[1], top[2] > 0))

    while at < size:
        found = _TAG.search(page, at)
        upto = found.start() if found else size
        if upto > at:
            text = html.unescape(page[at:upto])
            pieces.append(text)
            if in_link:
                linked.append(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in _SILENT:
            if not found[1] and not found[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else size
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not found[1]
            pieces.append("")
            if in_link:
                linked.append(" ")
        elif tag in _BLOCK or (found[3] and tag not in _VOID and not found[1] and _aside(tag, found[3])):
            end_block()
            if found[1]:
                places = [i for i, (t, _, _) in enumerate(stack) if t == tag]
                if places:
                    del stack[places[-1] :]
            elif tag not in _VOID:
                while stack and stack[-1][0] in CLOSES.get(tag, ["p"] if tag in _BLOCK else []):
                    stack.pop()
                own = _aside(tag, found[3])
                if tag == "form" and own == 1 and not out and all(t in ("html", "body") for t, _, _ in stack):
                    own = 0  # around the whole page
                hard = bool(stack) and stack[-1][2] > 1
                if not own and (tag == "main" or (tag == "article" and not seen_article and not hard)):
                    # what is around the main text is not aside
                    least = 3 if tag == "main" else 2
                    stack = [(t, m, a if a >= least else 0) for t, m, a in stack]
                    seen_article = seen_article or tag == "article"
                main, aside = stack[-1][1:] if stack else (False, 0)
                header = 2 * (tag == "header" and not main)
                stack.append((tag, main or tag in _MAIN, max(aside, header, own)))
        elif found[1] and any(t == tag for t, _, _ in stack):
            end_block()
            del stack[max(i for i, (t, _, _) in enumerate(stack) if t == tag) :]
    end_block()
    return out


def features(blocks: list[Block]) -> list[list[float]]:
    """A row of numbers for each block; there are no words and links before the first and behind the last."""
    words = [0.0, *(float(b[1]) for b in blocks), 0.0]
    links = [0.0, *(b[2] / b[1] for b in blocks), 0.0]
    return [[*words[i : i + 3], *links[i : i + 3], *map(float, blocks[i][3:])] for i in range(len(blocks))]


# --- the labelled table ------------------------------------------------------------------


def labelled_pages(n_pages: int = 600) -> list[str]:
    """Small pages of the usual layouts. A block is main text if it has the word ``main-text``.

    Half of the pages name neither their article nor their menus. Paragraphs have up to six tenths of their
    words in links, and short ones stand between long ones; what is named as something else is as long as
    paragraphs are; menus and lists of links are short and long.
    """
    draw = random.Random(6)

    def some(low: int, high: int = 0) -> str:
        return " ".join(["word"] * draw.randint(low, max(low, high)))

    def own(n: int, linked: float = 0.0) -> str:
        """A block of main text whose last words are a link."""
        in_link = round(n * linked)
        plain = [*["word"] * (n - in_link - 1), "main-text"]
        return " ".join([*plain, *([f'<a href="/x">{some(in_link)}</a>'] if in_link else [])])

    def menu(low: int, high: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{some(low, high)}</a></{item}>' for i in range(draw.randint(2, 7)))

    def bare_menu() -> str:
        """Links that no name marks."""
        return draw.choice([
            f"<div><ul>{menu(1, 3)}</ul></div>", f"<div>{menu(1, 3, 'span')}</div>", f"<table><tr>{menu(1, 3, 'td')}</tr></table>", f"<ul>{menu(1, 6)}</ul>",
            f'<p><a href="/">{some(2)}</a> | <a href="/a">{some(2, 3)}</a> | <a href="/b">{some(2)}</a></p>',
            f"<div><ul>{menu(5, 20)}</ul></div>", f"<div>{menu(5, 60, 'p')}</div>", f"<div>{menu(3, 40, 'div')}</div>",
        ])

    def named() -> str:
        """Something that a name marks, as long as a paragraph may be."""
        name = draw.choice(["ad", "sidebar", "cookie-notice", "newsletter", "related", "comments", "footer"])
        body = draw.choice([some(2, 12), f"<p>{some(10, 140)}</p>", f"<p>{some(5, 60)}</p><p>{some(5, 120)}</p>", f'{some(10, 40)} <a href="#">{some(1, 4)}</a>', f"<ul>{menu(1, 9)}</ul>"])
        return draw.choice([f'<div class="{name}">{body}</div>', f"<aside><h3>{some(1, 3)}</h3>{body}</aside>", f"<div><form>{body}</form></div>", f'<section id="{name}">{body}</section>'])

    pages = []
    for at in range(n_pages):
        tagged = at % 2 == 0
        blocks = [(draw.randint(10, 150), draw.choice([0, 0, 0, 0.05, 0.1, 0.25, 0.4, 0.6])) for _ in range(draw.randint(1, 5))]
        if tagged and at % 3 == 0:
            blocks = [(draw.randint(1, 9), draw.choice([0, 0, 0.5])) for _ in range(draw.randint(1, 4))]
        if len(blocks) > 2:  # a short one between long ones
            blocks.insert(draw.randint(1, len(blocks) - 1), (draw.randint(1, 9), 0))
        body = "".join(f"<p>{own(n, share)}</p>" for n, share in blocks)
        if draw.random() < 0.5:
            body = f"<h1>{own(draw.randint(1, 9))}</h1>" + body
        if tagged and draw.random() < 0.4:
            body += f"<ul><li>{own(5)}</li><li>{own(draw.randint(2, 12), 0.5)}</li><li><a href='/x'>{own(draw.randint(1, 9))}</a></li></ul>"
        if draw.random() < 0.4:
            body = named() + body if draw.random() < 0.5 else body + named()
        start, stop = draw.choice(
            [("<article>", "</article>"), ("<main>", "</main>"), ("<article><div>", "</div></article>")] if tagged else [("<div>", "</div>"), ("", ""), ('<div id="c1"><section>', "</section></div>")]
        )
        head = draw.choice(["", "", f"<header><p>{some(2, 30)}</p></header>", f'<div id="header"><h2>{some(3)}</h2>{some(2, 20)}</div>'])
        menus = f"<nav><ul>{menu(1, 3)}</ul></nav>" if tagged and draw.random() < 0.5 else bare_menu()
        end = draw.choice(["", named(), bare_menu(), f"<footer>&copy; {some(2, 30)}</footer>"])
        if draw.random() < 0.3:
            menus = f"<div>{some(1, 5)}</div>" + menus  # the name of the site
        elif draw.random() < 0.5:
            head = menus = ""
        if draw.random() < 0.3:
            end += bare_menu() + f"<div>&copy; {some(2, 8)}</div>"
        beside = [named() if draw.random() < 0.5 else "", bare_menu() if draw.random() < 0.5 else ""]
        pages.append(f"<body>{head}{menus}{beside[0]}{start}{body}{stop}{beside[1]}{end}</body>")
    return pages


Tree = tuple | float


def train(spark: SparkSession, depth: int = 10) -> Tree:
    """The tree as (feature, threshold, at most, above) with probabilities of main text at its leaves."""
    rows = []
    for page in labelled_pages():
        blocks = flat_blocks(page)
        rows += [(float("main-text" in b[0].split()), Vectors.dense(f)) for b, f in zip(blocks, features(blocks), strict=True)]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(table)
    return _read_tree(model.toDebugString.splitlines()[1:])


def _read_tree(lines: list[str]) -> Tree:
    """Spark's text form of a tree: indented lines ``If (feature 8 <= 0.5)``, ``Else (...)`` and ``Predict: 1.0``."""
    rest = iter([line.strip() for line in lines if line.strip()])

    def node() -> Tree:
        line = next(rest)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, limit = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line).groups()
        low = node()
        next(rest)  # Else
        return int(feature), float(limit), low, node()

    return node()


def is_main(tree: Tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str, tree: Tree) -> str:
    blocks = flat_blocks(page)
    return "\n\n".join(b[0] for b, row in zip(blocks, features(blocks), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    bounded_batches(pages.sparkSession)
    tree = train(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
