"""Main text of HTML pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A page becomes a flat list of text blocks (text between block-level tags). A block's features are its word count and
link density, those of its neighbours, whether it and they are headings, and marks of the regions it lies in: navigation,
footer, aside, form, header, names of classes and ids, article. The tree is grown on the blocks of two tables of small
pages with a label per block: ``PLAIN``, pages without any names, where counts and densities decide alone, and ``LABELLED``,
pages whose elements say what they are. It has no other rules. Content blocks are joined in page order.

Pages are independent: a task parses whole pages one after the other, and the tree (a few dozen numbers) travels with it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment, to the end if it isn't closed
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only after "=", and only if it is closed somewhere; others are stray and end in the tag
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

# element names of HTML, fixed values
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select
summary table tbody td tfoot th thead title tr ul""".split())
RAW = set("script style title textarea xmp noembed noframes iframe".split())  # their content is no markup
SILENT = RAW | set("noscript template svg annotation annotation-xml object canvas audio video select button datalist head map".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"br", "option", "title", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table section article aside div nav main body td th form".split())
REGION = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "search": "form", "dialog": "notice", "header": "header"}
ROLE = {"navigation": "nav", "menu": "nav", "menubar": "nav", "toolbar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside",
        "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "status": "notice"}
# words in class and id names that say what a part of a page is
NAMED = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar skip toc tabs",
    "footer": "footer foot copyright colophon legal",
    "aside": "sidebar sidenav aside widget widgets related recommended recommendations trending popular teaser share sharing social",
    "form": "login signup signin subscribe subscription newsletter search searchbox form",
    "notice": "cookie cookies consent gdpr notice notices notification popup modal overlay alert paywall disclaimer banner",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses reactions",
    "header": "header masthead",
}
WORD = {w: kind for kind, words in NAMED.items() for w in words.split()}
# names that also occur on parts of an article's own text; within an article they say nothing
VAGUE = set("legal social search searchbox tabs skip toc popular trending responses reactions discussion".split())
NOT_NAMED = {"has", "with", "no", "without", "hide", "is", "not"}  # "has-sidebar" is no sidebar
FLAGS = ("nav", "footer", "aside", "form", "notice", "advert", "comment", "header", "article", "heading", "any_article")
FEATURES = (*(f"{what}_{where}" for where in ("own", "before", "after") for what in ("words", "links")), *FLAGS, "heading_before", "heading_after", "heading_any", "any_name")
COUNTS = [i for i, f in enumerate(FEATURES) if f.startswith(("words", "links", "heading"))]


@dataclass
class Element:
    name: str
    marks: frozenset[str]
    silent: bool


@dataclass
class Block:
    marks: frozenset[str]
    heading: bool
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0


def _marks(name: str, attrs: str, within: bool) -> tuple[set[str], bool]:
    """The regions that an element opens, and whether its content isn't shown; ``within``: it lies in an article."""
    marks, hidden = set(), False
    if name in REGION:
        marks.add(REGION[name])
    if name in ("article", "main"):
        marks.add("article")
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
            if key in ("class", "id") and name not in ("html", "body", "main"):
                for label in value.split():
                    words = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", label).lower()
                    words = re.split(r"[-_:]+", words)
                    if words[0] not in NOT_NAMED:
                        found = {WORD[w] for w in words if w in WORD and not (within and w in VAGUE)}
                        marks |= found & {"comment", "advert", "aside"} if name == "article" else found
            elif key == "role":
                marks |= {ROLE[w] for w in value.lower().split() if w in ROLE}
                if value.strip().lower() in ("main", "article"):
                    marks.add("article")
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return marks, hidden


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page that hold any text, head, scripts, controls and hidden parts left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is open, so that no tag searches it
    scopes: list[int] = []
    headings: list[int] = []
    now: Block | None = None

    def text(s: str) -> None:
        nonlocal now
        if not s or stack and stack[-1].silent:
            return
        if "&" in s:
            s = html.unescape(s)
        if now is None:
            if s.isspace():
                return
            now = Block(stack[-1].marks if stack else frozenset(), bool(headings))
            out.append(now)
        now.parts.append(s)
        n = len(s.split())
        now.words += n
        now.linked += n if places["a"] else 0

    def pop_to(i: int) -> None:
        while len(stack) > i:
            name = stack.pop().name
            places[name].pop()
            for at in (scopes, headings):
                if at and at[-1] == len(stack):
                    at.pop()

    def innermost(*names: str) -> int:
        """The place of the innermost open element of these names, -1 if none is open."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                now = None
            continue
        if m[0][-1] != ">":
            break  # cut off within a tag
        name = name.lower()
        if name in BLOCK:
            now = None
        if m["close"]:
            i = innermost(name)
            # an end tag doesn't reach beyond its container
            if i >= 0 and (name in SCOPE or name in REGION or not scopes or i >= scopes[-1]):
                pop_to(i)
            continue
        scope = scopes[-1] if scopes else -1
        if name in ENDS_P or name in SIBLINGS:
            i = innermost(*(("p",) if name in ENDS_P else ()), *SIBLINGS.get(name, ()))
            if i >= max(scope, 0):
                pop_to(i)
            elif scope >= 0 and name in ("tr", "td", "th") and stack[scope].name in ("td", "th"):
                pop_to(scope)
        if name == "a":
            i = innermost("a")
            if i >= max(scopes[-1] if scopes else 0, 0):
                pop_to(i)
        if name == "body" and places["head"]:  # a body without an end of the head
            pop_to(places["head"][0])
        if name in VOID:
            continue
        above = stack[-1] if stack else None
        marks, hidden = _marks(name, m["attrs"] or "", bool(above and "article" in above.marks))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        places[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        if name in HEADING:
            headings.append(len(stack))
        held = above.marks if above else frozenset()
        stack.append(Element(name, held | marks if marks else held, bool(above and above.silent) or hidden or name in SILENT))
    return [b for b in out if b.words]


def features(page: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the page's ends word count and link density are 0."""
    n = len(page)
    words = np.array([0, *(b.words for b in page), 0], float)
    density = np.array([0, *(b.linked / b.words for b in page), 0], float)
    x = np.zeros((n, len(FEATURES)))
    for c, shift in enumerate((1, 0, 2)):
        x[:, 2 * c], x[:, 2 * c + 1] = words[shift:n + shift], density[shift:n + shift]
    any_article, any_name = any("article" in b.marks for b in page), any(b.marks for b in page)
    headings = [False, *(b.heading for b in page), False]
    for i, b in enumerate(page):
        x[i, 6:] = [*(f in b.marks for f in FLAGS[:9]), b.heading, any_article, headings[i], headings[i + 2], any(headings), any_name]
    return x


# The labelled table: small pages, and for each of their text blocks in order whether it is content. S and T stand for
# running text of an article, U for other text, A opens a link. Every page is used with texts of several lengths, so
# that within named regions length says nothing; pages without regions have longer texts only.
LABELLED: tuple[tuple[str, str], ...] = (
    ("<nav><ul><li>[A]Home</a><li>[A][U]</a></ul></nav><article><h1>River</h1><p>[S]</p><p>Short.</p><p>[T]</p></article><footer>&copy; Site. [U]</footer>", "0011110"),
    ("<header>[U] [A]Log in</a></header><article><h1>[S]</h1><p>[T]<p>[A]More on boats</a></p><ul><li>Oars</li><li>[A]Ropes</a></li></ul>"
     "<div class=ad>[U]</div><p>So.</p></article><aside>[U]</aside>", "011111010"),
    ("<article><p>[S]</p><aside>[U]</aside><p>[T]</p><div class=advert>[U]</div><p>One.</p><section class=comments><p>[U]</p><article class=comment>[U]</article></section></article>", "1010100"),
    ("<article><header><h1>Rain</h1><p>[U]</p></header><p>[S]</p><nav>[A]Next</a></nav><h2>Later</h2><p>[T]</p><footer>[U]</footer></article>", "1010110"),
    ("<div class=notice>[U]</div><main><h1>Bread</h1><p>[S]</p><form>[U]</form><table><tr><td>Flour</td><td>[T]</td></tr></table>"
     "<div class=notice>[U]</div><p>[A][S]</a></p></main><div>[U]</div>", "011011010"),
    ("<header><p>[U]</p></header><main><p>Hm.</p><div class=sponsored><p>[U]</p></div><p>[S]</p></main><div id=comments><p>[U]</p></div><div class=newsletter>[U]</div>", "010100"),
    ("<article><p>[S]</p></article><div><p>[U]</p></div><p>[U]</p><div>[A]Top</a></div>", "1000"),
    ("<div class=ads>[U]</div><article><h1>Mills</h1><p>[T]</p><div class=menu>[A]Mills</a> [U]</div><p>[A][S]</a> [T]</p></article><div class=sidebar>[U]</div><form>[U]</form><p>[A][U]</a></p>", "01101000"),
    ("<div class=menu>[A]Home</a></div><div><p>[S]</p><p>[T]</p></div><div class=footer>[U]</div>", "0110"),
    ("<div>[A]Home</a></div><div>[A]News and more</a></div><div>[S]</div><div>Yes.</div><div>[T]</div><div>[A]About us</a></div><div>[A]Terms of use</a> and so on</div>", "0011100"),
    ("<div class=cookie-notice>[U]</div><h1>Roads</h1><p>[S]</p><p>[T] [A]link</a></p><form><p>[U]</p><label>Name</label></form><div id=sidebar><p>[U]</p></div>", "0111000"),
    ("<div>[A]A</a> | [A]B</a> | [A]C</a></div><p>[S]</p><p>[T]</p><div>[A]Read this next: [U]</a></div><div>[A]Up</a></div>", "01100"),
    ("<p>[S]</p>", "1"),
    ("<p>Yes.</p>", "1"),
    ("<h1>Yes</h1><p>It is so.</p>", "11"),
    ("<div class=ad>[U]</div><p>[S]</p><div class=notice>[U]</div><p>[T]</p><div class=sidebar>[U]</div><p>[S]</p><nav>[U]</nav><p>[T]</p><footer>[U]</footer><p>[S]</p><form>[U]</form><p>[T]</p><div id=comments>[U]</div><p>[S]</p>", "01010101010101"),
    ("<nav>[U]</nav><form>[U]</form><header>[U]</header><aside>[U]</aside><div class=popup>[U]</div><div class=promo>[U]</div><h1>Hay</h1><p>[S]</p><p>[T]</p><div class=ad>[U]</div><div class=comments>[U]</div><aside>[U]</aside><footer>[U]</footer><nav>[U]</nav><form>[U]</form><div class=notice>[U]</div>", "0000001110000000"),
    ("<div class=header><h1>[U]</h1></div><h2>Boats</h2><p>[S]</p><div class=share>[A]Share</a></div><p>[T]</p><div class=comments><p>[U]</p></div><div class=ad>[U]</div>", "0110100"),
)
# pages without any names, where word counts, link densities and headings of a block and its neighbours are all there is.
# [V] is a short text that is no part of the article: above the first heading, or at the end of the page.
PLAIN: tuple[tuple[str, str], ...] = (
    ("<div><ul><li>[A]Home</a><li>[A]News</a><li>[A]Who we are</a></ul></div><div>[V]</div><div><h1>[H]</h1><p>[S]</p><p>[W]</p><p>[T]</p><p>[W]</p><p>[S]</p></div><div>[V]</div>", "00001111110"),
    ("<div>[A]Home</a></div><div>[A]Shop</a></div><div>[V]</div><div><h1>[H]</h1><p>[W]</p><p>[S]</p><p>[W]</p><h2>[H]</h2><p>[T]</p><p>[W]</p></div><div>[V]</div>", "00011111110"),
    ("<p>[A]Home</a><p>[A]Help</a><div><h1>[H]</h1><p>[W]</p><p>[T]</p><p>[W]</p></div><div>[V] [A]Terms</a></div>", "0011110"),
    ("<ul><li>[A]One</a><li>[A]Two</a></ul><div>[V]</div><div><h1>[H]</h1><p>[W]</p><p>[W]</p><p>[S]</p></div><div>[V]</div>", "00011110"),
    ("<div>[A]Up</a></div><div><h1>[H]</h1><ul><li>[W]</li><li>[W]</li></ul><p>[S]</p></div><div>[V]</div><div>[A]Terms</a></div>", "0111100"),
    ("<div>[V]</div><div><h1>[H]</h1><p>[S]</p><p>[W]</p></div><div>[V]</div>", "01110"),
    ("<div>[A]Up</a></div><div>[V]</div><div><h1>[H]</h1><p>[W]</p></div><div>[V]</div>", "00110"),
    ("<div>[A]Up</a></div><div>[V]</div><div><h1>[H]</h1><p>[S]</p></div><div>[V]</div>", "00110"),
    ("<p>[W]</p><p>[W]</p>", "11"), ("<p>[W]</p><p>[S]</p><p>[W]</p>", "111"), ("<div>[W]<br>[W]<br>[W]</div>", "111"), ("<p>[S]</p><p>[W]</p>", "11"), ("<h1>[H]</h1><p>[W]</p><p>[W]</p>", "111"),
    ("<h1>[H]</h1><p>[W]</p>", "11"), ("<p>[W]</p>", "1"), ("<p>[S]</p>", "1"), ("<h1>[H]</h1><p>[S]</p><p>[T]</p>", "111"), ("<p>[S]</p><p>[T]</p><p>[S]</p>", "111"),
    ("<div>[A]Home</a></div><div>[A]News and more</a></div><div>[S]</div><div>[W]</div><div>[T]</div><div>[A]About us</a></div><div>[A]Terms of use</a> and so on</div>", "0011100"),
    ("<div>[A]Home</a></div><div>[V]</div><div><h1>[H]</h1><p>[S] [A]boats</a> [W]</p><p>[T] [A]see there</a>, [A]and there</a> [S]</p><p>[W]</p><p>[W] [A]so</a> [S]</p></div><div>[A]About us</a> | [A]Terms</a></div>", "00111110"),
    ("<p>[A]Home</a> and [A]help</a> [A]here</a></p><p>[S] [A]one</a></p><p>[A]two</a> [T]</p><p>[W] [S]</p><p>[A]Read on</a> here</p>", "01110"),
    ("<div>[A]Home</a></div><div>[V]</div><h1>[H]</h1><p>[W]</p><p>[S]</p><h2>[H]</h2><p>[W]</p><p>[W]</p><h2>[H]</h2><h3>[H]</h3><p>[T]</p><p>[W]</p><h2>[H]</h2><p>[W]</p><p>[S]</p><div>[V]</div>", "0011111111111110"),
    ("<div>[A]A</a> | [A]B</a> | [A]C</a></div><p>[S]</p><p>[T]</p><div>[A]Read this next: [V]</a></div><div>[A]Up</a></div>", "01100"),
)
LENGTHS = ((1, 40, 9), (30, 2, 90), (120, 15, 1), (6, 1, 30), (60, 90, 4), (14, 200, 14), (2, 6, 250), (45, 25, 60))


def _filled(page: str, **words: str) -> str:
    texts = {"A": '<a href="/x">', **words}
    return re.sub(r"\[([A-Z])\]", lambda m: texts[m[1]].strip() if m[1] != "A" else texts["A"], page)


def labelled_pages() -> Iterator[tuple[str, str]]:
    for page, labels in LABELLED:
        named = "<article" in page or "<main" in page
        for s, t, u in LENGTHS:
            s, t = (s, t) if named else (s + 12, t + 12)
            yield _filled(page, S="word " * s, T="more " * t, U="other " * u), labels


def plain_pages() -> Iterator[tuple[str, str]]:
    """Pages of PLAIN with long texts [S] and [T], article texts [W] and others [V] of any few words, and headings [H]."""
    for page, labels in PLAIN:
        for k in range(60):
            s, t, w, v, h = 26 + k * 7 % 90, 26 + k * k % 300, 1 + k * 5 % 24 * (k % 3 > 0), 3 + k * 3 % 17, 1 + k % 19
            yield _filled(page, S="word " * s, T="more " * t, W="so " * w, V="short " * v, H="head " * h), labels


@dataclass
class Tree:
    """A classification tree: inner nodes by feature and threshold, leaves by label."""

    feature: int = -1
    threshold: float = 0.0
    label: bool = False
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.label)
        high, out = x[:, self.feature] > self.threshold, np.empty(len(x), bool)
        out[high], out[~high] = self.high.predict(x[high]), self.low.predict(x[~high])
        return out


def grow(x: np.ndarray, y: np.ndarray, order: list[int], depth: int = 12) -> Tree:
    """The split with the lowest Gini impurity, again and again until a node is pure. Earlier features of ``order`` win ties."""
    if depth == 0 or y.all() or not y.any():
        return Tree(label=bool(y.mean() >= 0.5))
    best = (np.inf, -1, 0.0)
    for f in order:
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            high = x[:, f] > t
            gini = sum(s.sum() * (1 - s.mean()) for s in (y[high], y[~high]))
            if gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best[1] < 0:
        return Tree(label=bool(y.mean() >= 0.5))
    high = x[:, best[1]] > best[2]
    return Tree(best[1], best[2], False, grow(x[~high], y[~high], order, depth - 1), grow(x[high], y[high], order, depth - 1))


def _table(pages: Iterator[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page}")
        x.append(features(found))
        y += [c == "1" for c in labels]
    return np.concatenate(x), np.array(y)


def train() -> Tree:
    """The tree's root asks whether a page names any region. With names, marks win over counts in ties, so a block in a named
    region needs no count; without, word counts, link densities and headings decide alone."""
    marks = [i for i in range(6, FEATURES.index("heading_before"))]
    named, plain = _table(labelled_pages()), _table(plain_pages())
    return Tree(FEATURES.index("any_name"), 0.5, False, grow(*plain, COUNTS, 9), grow(*named, [*marks, *range(6)]))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return " ".join(" ".join("".join(b.parts).split()) for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main_text``: the content blocks of ``html``, in order, joined by a space.

    Character references are decoded, white space within a block becomes one space. Null and empty html, and pages
    without content blocks, give an empty text. Cut-off pages count as far as they go; a tag cut off at the end is no
    text. Every row is extracted on its own: repeated rows give repeated results. Other columns pass through.
    """
    tree = train()

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(page, tree) for page in part], dtype=object)

    return pages.withColumn("main_text", run("html"))


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
