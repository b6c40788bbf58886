"""HTML extraction by a tree-structured graphical model.

Each block element and each run of text in it is a node that is content or not. Node potentials come from tag, names and
text; potentials between parent and child connect the nodes. Sum-product messages, up the tree and down again, give each
node's marginal probability; the text runs that are more likely content than not make up the main text, in page order.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
NESTED = frozenset("svg template".split())  # left out up to their own end tag
HELD = frozenset("button select datalist".split())  # inside a text run, which goes on behind them
MATH = frozenset("math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym br".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTENT_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "button", "select", "datalist", "option")
TEXT_TAGS = ("p", "h1", "h2", "h3", "blockquote", "pre", "li", "td", "div", "section", "ul", "body")
#: Words of class, id and role that tell what an element is for, with the prior's sign.
NAMES = (
    (r"ads?|advert\w*|sponsor\w*|promo\w*", -1), (r"comments?|respond|disqus|repl(?:y|ies)", -1), (r"side|sidebars?|aside|related|recommend\w*|widgets?", -1), (r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager", -1),
    (r"foot|footer|copyright|legal", -1), (r"cookies?|consent|notices?|banners?|popups?|modal|newsletter|subscribe", -1), (r"share|sharing|social|login|signup|search", -1), (r"articles?|contents?|posts?|entry|story|main|body", 1),
)
#: Words that may stand beside those; with any other word (as in share-price) a name tells nothing.
BESIDE = re.compile(r"\d*|bar|box|buttons?|btn|links?|list|icons?|wrapper|wrap|container|area|sections?|blocks?|slots?|units?|top|bottom|left|right|site|page|pages|form|items?|inner|outer|header|head|text|title|row|col|panel|primary|secondary|global|sub|complementary|info|in|up|policy|overlay", re.I)
# Quotes hold a value only behind an equals sign, as in a browser; elsewhere they are characters like any other.
_MARKUP, _TEXT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", r"[^<]+|<"
_OPEN = r"<(/?)([A-Za-z][^\s/>]*+)"
_TOKEN = re.compile(_MARKUP + r"|<[!?][^>]*>|" + _OPEN + r"((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)>|" + _TEXT, re.S)
_PLAIN = re.compile(_MARKUP + r"|<[!?][^>]*>|" + _OPEN + r"([^>]*+)>|" + _TEXT, re.S)  # where quotes do not close
_TAIL = re.compile(_MARKUP + r"|(?!)()()()|" + _TEXT, re.S)  # behind the last >
_ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAMES = [re.compile(p, re.I) for p, _ in NAMES]
FEATURES = ["bias_element", "bias_text", "landmark", *OTHER_TAGS, *(f"name{i}" for i in range(len(NAMES))), *(f"in_{t}" for t in TEXT_TAGS), "len1", "len2", "len3", "links", "stops", "copyright"]
_AT = {n: i for i, n in enumerate(FEATURES)}
#: The prior's mean: names and landmarks speak for themselves where no labelled page has them.
PRIOR = np.array([{"bias_element": 0.0, "links": -2.0, "len3": 0.5, "copyright": -2.0, "landmark": 20.0}.get(n, -6.0 if n in OTHER_TAGS else (8.0, 4.0)[NAMES[int(n[4:])][1] > 0] * NAMES[int(n[4:])][1] if re.fullmatch(r"name\d+", n) else 0.0) for n in FEATURES])
#: Log potentials by child kind (element, text), parent's and child's label.
PRIOR_EDGES = np.array([[[1.0, -1.0], [0.0, 0.0]], [[2.0, -2.0], [-2.0, 2.0]]])
#: The same where nothing can be trained: children of content lean to content.
UNTRAINED_EDGES = np.array([[[1.0, -1.0], [-0.5, 0.5]], [[2.0, -2.0], [-2.0, 2.0]]])


@dataclass
class Page:
    """Nodes in page order, parents first."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    active: list[list[int]] = field(default_factory=list)  # features
    text: list[str | None] = field(default_factory=list)  # of runs
    gold: list[bool] = field(default_factory=list)  # below a content landmark and no other one

    def add(self, parent: int, features: list[int], text: str | None, gold: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.active.append(features)
        self.text.append(text)
        self.gold.append(gold)
        return len(self.parent) - 1


def _named(attrs: str) -> set[int]:
    """Which of NAMES the class, id or role says."""
    out: set[int] = set()
    for token in " ".join(x.strip("\"'") for x in _ATTRS.findall(attrs)).split():
        words = re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token))
        which = [{i for i, p in enumerate(_NAMES) if p.fullmatch(w)} for w in words]
        if all(x or BESIDE.fullmatch(w) for w, x in zip(words, which, strict=True)):
            said = [i for x in which for i in sorted(x)]
            # related-posts are what is related; content-sidebar may be the layout of both
            out.update(i for i in said if NAMES[i][1] == NAMES[said[0]][1] or NAMES[said[0]][1] > 0)
    return out


#: Parts that hold articles of their own, which are not the page's: by name (without a name that speaks for content) or tag.
APART_NAMES, APART_TAGS = frozenset((0, 1, 2, 3, 4, 5, 6)), frozenset("aside nav footer dialog menu".split())


def _element(tag: str, attrs: str, inside: bool = False, apart: bool = False) -> tuple[list[int], bool]:
    """Features of an element, and whether it and what is below it stand apart from the page's content. A header inside an
    article heads it (its title), one outside heads the page; an article among comments or adverts is no landmark."""
    out, names = [_AT["bias_element"]], _named(attrs) if attrs else set()
    apart = apart or tag in APART_TAGS or bool(names & APART_NAMES and not any(NAMES[i][1] > 0 for i in names))
    if tag in CONTENT_TAGS and not apart:
        out.append(_AT["landmark"])
    elif tag in OTHER_TAGS and not (inside and tag == "header"):
        out.append(_AT[tag])
    return out + [_AT[f"name{i}"] for i in sorted(names)], apart


def _run(tag: str, text: str, linked: int) -> list[int]:
    out = [_AT["bias_text"]]
    if f"in_{tag}" in _AT:
        out.append(_AT[f"in_{tag}"])
    n = len(text)
    out.append(_AT["len1" if n < 25 else "len2" if n < 100 else "len3"])
    if 2 * linked > n:
        out.append(_AT["links"])
    if text[-1] in ".!?\"'”»…:":
        out.append(_AT["stops"])
    if "©" in text:
        out.append(_AT["copyright"])
    return out


def _ends(tag: str, source: str) -> dict[int, int]:
    """Where elements of a tag end that do, by the end of their start tag; inner ones of the name have their own end."""
    out, opened = {}, []
    for m in re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)>", re.I | re.S).finditer(source):
        if m[0].startswith("<!--"):
            continue
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


#: Formatting elements that an end tag is looked for in.
NESTING = 64


class Parser:
    """One page's tree in the making. Each step looks at a bounded part of the stack, so a page costs what its length does."""

    def __init__(self, source: str):
        self.source, self.page = source, Page()
        root = self.page.add(-1, [_AT["bias_element"]], None, False)
        self.stack = [("#root", root, False, "#root", False)]  # tag, node of the nearest block, gold, its tag, apart
        self.open: dict[str, int] = {}
        self.buffer: list[str] = []
        self.linked = self.anchors = 0
        self.held: list[tuple[int, list[str], int]] = []  # runs that go on behind an element: depth of the stack, buffer, linked
        self.ends: dict[str, dict[int, int]] = {}

    def push(self, tag: str, node: int, gold: bool, block: str, apart: bool) -> None:
        self.stack.append((tag, node, gold, block, apart))
        self.open[tag] = self.open.get(tag, 0) + 1

    def cut(self, k: int, last: int | None = None) -> None:
        for x in self.stack[k:last]:
            self.open[x[0]] -= 1
        del self.stack[k:last]

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            if text:
                _, node, gold, block, _ = self.stack[-1]
                self.page.add(node, _run(block, text, self.linked), text, gold)
            self.buffer.clear()
        self.linked = 0

    def resume(self) -> None:
        while self.held and self.held[-1][0] >= len(self.stack):
            _, before, of_links = self.held.pop()
            self.buffer[:0] = before
            self.linked += of_links

    def close(self, tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                self.flush()
                self.cut(k)
                self.resume()
                return
            if self.stack[k][0] in barrier:
                return

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        elif tag in INLINE:
            self.anchors -= tag == "a" and self.anchors > 0
            if self.open.get(tag):
                for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - NESTING), -1):
                    if self.stack[k][0] == tag:
                        self.cut(k, k + 1)
                        break
                    if self.stack[k][0] not in INLINE:
                        break
        elif tag == "p" and not self.open.get("p"):
            self.flush()
        else:
            self.close((tag,))

    def start_tag(self, tag: str, attrs: str, at: int) -> int:
        """Where to go on."""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.source, at)
            return end.end() if end else len(self.source)
        if tag in NESTED:
            if tag not in self.ends:
                self.ends[tag] = _ends(tag, self.source)
            return at if attrs.endswith("/") else self.ends[tag].get(at, at)
        if tag in HELD:
            after = re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).search(self.source, at)
            if after and after[1]:
                self.held.append((len(self.stack), self.buffer[:], self.linked))
                self.buffer.clear()
                self.linked = 0
                # a tree of its own: what a button is tells nothing of the paragraph around it
                self.push(tag, self.page.add(-1, _element(tag, attrs)[0], None, False), False, tag, False)
            return at
        if tag in VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ")
            if tag == "hr":
                self.flush()
            return at
        if tag in ("mtr", "mtd"):
            self.buffer.append(" ")
        if tag in MATH and attrs.endswith("/"):
            return at
        _, above, gold, block, apart = self.stack[-1]
        if tag in INLINE:
            self.anchors += tag == "a"
            self.push(tag, above, gold, block, apart)
            return at
        self.flush()
        self.anchors = 0
        if tag in CLOSES:
            self.close(CLOSES[tag], ("ul", "ol", "dl", "table", *HELD))
        for ended in ("option", "p"):
            self.close((ended,), ("td", "th", "li", "div", "article", "section", "body", *HELD))
        _, above, gold, block, apart = self.stack[-1]
        if tag in ("html", "head", "body"):  # their names tell of the whole page
            self.push(tag, above, gold, tag, apart)
            return at
        features, apart = _element(tag, attrs, any(self.open.get(t) for t in CONTENT_TAGS), apart)
        signs = [PRIOR[f] for f in features if abs(PRIOR[f]) > 3]
        gold = (gold or (tag in CONTENT_TAGS and not apart)) and not any(s < 0 for s in signs)
        self.push(tag, self.page.add(above, features, None, gold), gold, tag, apart)
        return at

    def run(self) -> Page:
        at, pattern, last = 0, _TOKEN, self.source.rfind(">")
        while m := (pattern if at <= last else _TAIL).match(self.source, at):
            if m[0] == "<" and pattern is _TOKEN and re.match(r"</?[A-Za-z]", self.source[at : at + 3]) and at <= last:
                pattern = _PLAIN  # the quotes from here on do not close before the end: they are characters
                continue
            at, tag = m.end(), m[2] and m[2].lower()
            if tag:
                if m[1]:
                    self.end_tag(tag)
                else:
                    at = self.start_tag(tag, m[3], at)
            elif not m[0].startswith("<") or m[0] == "<":
                self.buffer.append(m[0])
                self.linked += len(m[0]) if self.anchors else 0
            elif m[0].startswith("<![CDATA["):
                self.buffer.append(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))  # as it is, once decoded
        self.flush()
        if self.held:
            self.cut(self.held[0][0])
            self.resume()
            self.flush()
        return self.page


def parse(source: str) -> Page:
    """The tree of a page: block elements and text runs. Comments, scripts, styles, other raw elements, drawings and
    templates are left out, formulas are text, character references decoded, white space in a run made one blank; unclosed
    elements end where HTML says they do, and the tag of an unclosed drawing, template, button or list is passed over."""
    return Parser(source).run()


class Batch:
    """Nodes of many pages as arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=False)]) if pages else np.zeros(0, int)
        self.depth = np.array([d for p in pages for d in p.depth], int)
        self.is_text = np.array([t is not None for p in pages for t in p.text], int)
        self.gold = np.array([g for p in pages for g in p.gold], int)
        self.x = np.zeros((len(self.parent), len(FEATURES)))
        for i, active in enumerate(a for p in pages for a in p.active):
            self.x[i, active] = 1
        self.first = first

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content by node, and of each pair of labels by edge (parent, child), by messages up and down."""
        n = len(self.parent)
        own = np.stack([np.zeros(n), self.x @ weights], axis=1)
        order = np.argsort(self.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        table = edges[self.is_text]  # node's edge to its parent
        inside, up = own.copy(), np.zeros((n, 2))
        for at in levels[:0:-1]:
            up[at] = np.logaddexp(table[at, :, 0] + inside[at, None, 0], table[at, :, 1] + inside[at, None, 1])
            np.add.at(inside, self.parent[at], up[at])
        down, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for at in levels[1:]:
            outside = inside[self.parent[at]] + down[self.parent[at]] - up[at]  # the parent without this child
            joint = outside[:, :, None] + table[at] + inside[at][:, None, :]
            down[at] = np.logaddexp(outside[:, 0, None] + table[at, 0], outside[:, 1, None] + table[at, 1])
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = inside + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pair


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    edges: np.ndarray


def train(pages: list[Page], rounds: int = 60, rate: float = 0.3, pull: float = 0.02) -> Model:
    """Most likely potentials of labelled pages, drawn to the prior; the gradient compares what is observed with what the
    messages expect. Every second page is seen with its landmarks hidden, so that names, text and neighbours are learnt."""
    weights, edges = PRIOR.copy(), PRIOR_EDGES.copy()
    if not pages:
        return Model(weights, UNTRAINED_EDGES.copy())
    batch = Batch(pages)
    hidden = np.repeat(np.arange(len(pages)) % 2 == 1, np.diff(batch.first))
    batch.x[np.ix_(hidden, [_AT[t] for t in ("landmark", *OTHER_TAGS)])] = 0
    child = np.flatnonzero(batch.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (batch.is_text[child], batch.gold[batch.parent[child]], batch.gold[child]), 1)
    moved_w, moved_e = np.full_like(weights, 1e-6), np.full_like(edges, 1e-6)
    for _ in range(rounds):
        content, pair = batch.marginals(weights, edges)
        expected = np.stack([pair[child][batch.is_text[child] == k].sum(axis=0) for k in (0, 1)])
        gw = batch.x.T @ (batch.gold - content) / len(pages) - pull * (weights - PRIOR)
        ge = (seen - expected) / len(pages) - pull * (edges - PRIOR_EDGES)
        moved_w += gw**2
        moved_e += ge**2
        weights, edges = weights + rate * gw / np.sqrt(moved_w), edges + rate * ge / np.sqrt(moved_e)
    return Model(weights, edges)


#: What is put into every third labelled page, so that content elements with other things inside are learnt too: parts that
#: are no content, each with several kinds of text in it.
_PARTS = (
    '<aside class="sidebar">{}</aside>', '<form>{}<label>Name</label></form>', '<div class="comments"><div class="comment">{}</div></div>', '<section class="comments">{}</section>', '<div class="cookie-notice">{}</div>', '<footer>{}</footer>',
    '<div class="ad">{}</div>', '<div class="newsletter">{}</div>', '<div class="sidebar">{}</div>', '<nav>{}</nav>', '<div role="navigation">{}</div>', '<div class="share">{}</div>', '<div id="comments"><article class="comment">{}</article></div>',
    '<div class="related">{}</div>', '<section class="promo">{}</section>', '<div class="footer">{}</div>', '<aside>{}</aside>',
)
_INSIDE = ("<h3>{1}</h3><p>{0}</p>", "<p>{0}</p>", "<h2>{2}</h2><p>{0}</p><p>{1}</p>", "<ul><li>{1}</li><li>{0}</li></ul>", "{1}", '<h3>{2}</h3><ul><li><a href="#">{1}</a></li></ul>', "<article><h4>{1}</h4><p>{0}</p></article>")
_INSERTS = tuple(part.format(inside) for inside in _INSIDE for part in _PARTS)
#: What is put into every third other one: parts of an article that pages may not have, which are content.
_CONTENT = (
    "<table><thead><tr><th>{2}</th><th>{3}</th></tr></thead><tbody><tr><td>{1}</td><td>{2}</td></tr><tr><td>{3}</td><td>{0}</td></tr></tbody></table>", "<ul><li>{2}</li><li><p>{1}</p></li></ul>", "<header><h2>{1}</h2><p>{2}</p></header>",
    "<figure><figcaption>{1}</figcaption></figure>", "<dl><dt>{2}</dt><dd>{1}</dd></dl>", "<section><div><div>{3}</div><blockquote><p>{0}</p></blockquote></div></section>", "<pre>{1}</pre><div>{2}</div>",
)


def augmented(sources: list[str]) -> list[str]:
    """sources, with parts that are no content put between the paragraphs of every third, and parts that are in others."""
    out = []
    for n, source in enumerate(sources):
        parts = re.split(r"(?=<p\b)", source)
        made = (_INSERTS, _CONTENT, ())[n % 3]
        if made and len(parts) > 3:
            said = [re.sub(r"<[^>]*>", " ", x) for x in parts[1:]]
            for k in range(3):
                at, text = 2 + (7 * n + 5 * k) % (len(parts) - 2), said[k % len(said)]
                parts.insert(at, made[(n // 3 * 3 + k) % len(made)].format(text, text[:20], text[:6], text[-3:]))
            source = "".join(parts)
        out.append(source)
    return out


def fit(pages: DataFrame, max_pages: int = 300, max_chars: int = 100_000) -> Model:
    """Train on at most `max_pages` pages of at most `max_chars` characters that label themselves by an article or main
    element, those of least hash. Without any the prior is the model."""
    own = pages.where(F.col("html").rlike("(?i)<(?:article|main)[ >]") & (F.length("html") <= max_chars))
    # only ids are ordered; the pages themselves are fetched for the chosen ones
    ids = [r.page_id for r in own.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).collect()]
    rows = own.where(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"]).orderBy("page_id").collect() if ids else []
    return train([parse(x) for x in augmented([r.html for r in rows])])


def main_texts(sources: list[str | None], model: Model, at_once: int = 200) -> list[str]:
    out: list[str] = []
    for i in range(0, len(sources), at_once):
        pages = [parse(s or "") for s in sources[i : i + at_once]]
        batch = Batch(pages)
        content, _ = batch.marginals(model.weights, model.edges)
        for p, f in zip(pages, batch.first, strict=False):
            out.append("\n".join(t for t, c in zip(p.text, content[f : f + len(p.text)], strict=True) if t is not None and c >= 0.5))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (code points) of every row. A null or empty page has no text; pages
    are read whole; repeated rows are extracted alike; an empty table gives no rows; other columns are ignored."""
    model = model or fit(pages)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = main_texts(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
