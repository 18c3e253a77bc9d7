"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is content or not. Its own potential comes from its tag, the words of its class, id and role, and the text below it;
another potential joins it with its parent. Sum-product messages go up from the leaves and down from the root, which gives each
element's exact marginal, and text is kept where its element is more likely content. The weights are those of a conditional random
field, fitted by gradient ascent on labelled pages: ``labelled_pages`` composes them from marked parts in varying arrangements.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, widened

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object select option textarea button canvas".split())
#: Elements that begin and end a block of text; all others are within one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split()}
#: An implied end reaches no further than these.
WALLS = frozenset("article aside body div footer form header main nav ol section table td th ul blockquote figure details".split())
TAGS = (
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a", "nav menu", "header", "footer", "aside", "form fieldset input label legend",
    "figure figcaption img picture", "table thead tbody tfoot tr td th caption", "blockquote pre code", "html body", "b i em strong span small u mark sup sub cite q time abbr font", "dialog details summary",
)
TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
#: Words of class, id and role names that go with content, and those that go with what surrounds it.
GOOD = frozenset("article articlebody articles blog body content contents document entry main maincontent markdown page post posts prose story text".split())
BAD = frozenset(
    """ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus discussion feedback
    footer footnav form gdpr head header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion rail
    rating ratings recommendation recommendations recommended register related replies reply respond review reviews search share sharing sidebar side sign signin signup skip social sponsor sponsored sponsors
    subscribe subscription taboola tags teaser teasers toolbar topbar trending widget widgets""".split()
)
#: Last words of compounds that only say what shape a part has.
SHAPE = frozenset("area bar block body box card cell col column container content footer frame group holder inner item list module outer panel row section strip wrap wrapper zone".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FEATURES = len(TAGS) + 19
#: Elements that no page shows as text are never content.
NEVER = -50.0


ENDED_INSIDE = frozenset(("p", "li", "dt", "dd"))
NAMELESS = (False, False, False)


@lru_cache(1 << 14)
def named(names: str) -> tuple[bool, bool, bool]:
    """Whether a word of the names is ``GOOD``, whether one is ``BAD``, and whether one that says what a part is, is bad: the last word of a
    compound says that ("cookie-notice"), or the one before it where the last is a ``SHAPE`` ("cookie-bar"), and the words before say what
    of ("header-image")."""
    words = [[w.lower() for w in NAME.findall(name)] for name in names.split()]
    what = [ws[-2] if len(ws) > 1 and ws[-1] in SHAPE and ws[-1] not in BAD else ws[-1] for ws in words if ws]
    return any(w in GOOD for ws in words for w in ws), any(w in BAD for ws in words for w in ws), any(w in BAD for w in what)


class Tree(HTMLParser):
    """Elements in page order: parent, tag, attributes, own characters; and the runs of text with their element and block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.runs = [-1], ["html"], [NAMELESS], []
        self.open, self.block, self.whole = [0], 0, False

    def handle_starttag(self, tag, attrs):
        self.whole |= tag in ("html", "body")
        if tag in ("html", "body") and tag in self.tag and tag != "body":
            return
        if ends := CLOSES.get(tag):
            for i in range(len(self.open) - 1, 0, -1):
                now = self.tag[self.open[i]]
                if now in ends:
                    del self.open[i:]
                    break
                if now in WALLS:
                    break
        if tag not in BLOCKS and tag not in HIDDEN and tag not in VOID:
            self.imply()
        node = len(self.tag)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.words.append(named(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop"))) if attrs else NAMELESS)
        if tag in BLOCKS:
            self.block += 1
        if tag == "br" or tag == "img":
            self.runs.append((node, self.block, " "))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            now = self.tag[self.open[i]]
            if now == tag:
                del self.open[i:]
                break
            if now in WALLS and (tag not in BLOCKS or tag in ENDED_INSIDE):
                break
        if tag in BLOCKS:
            self.block += 1

    def imply(self):
        """Text and inline elements that stand directly in the page begin a paragraph of their own."""
        if self.tag[self.open[-1]] in ("html", "body"):
            self.handle_starttag("p", ())

    def handle_data(self, data):
        if data.strip():
            self.imply()
        self.runs.append((self.open[-1], self.block, data))


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def features(tree: Tree) -> np.ndarray:
    n = len(tree.tag)
    x = np.zeros((n, FEATURES))
    text, linked, stops, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    in_link, hidden = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        p = tree.parent[i]
        in_link[i] = tree.tag[i] == "a" or (p >= 0 and in_link[p])
        hidden[i] = tree.tag[i] in HIDDEN or (p >= 0 and hidden[p])
    for node, _, data in tree.runs:
        if not hidden[node]:
            size = len(data) - data.count(" ")
            text[node] += size
            runs[node] += size > 0
            stops[node] += data.count(".") + data.count(",")
            linked[node] += size * in_link[node]
    own = text.copy()
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for a in (text, linked, stops, runs):
            a[p] += a[i]
    k = len(TAGS)
    for i in range(n):
        if (t := TAG_OF.get(tree.tag[i])) is not None:
            x[i, t] = 1
    x[:, k : k + 3] = tree.words
    density = linked / np.maximum(text, 1)
    x[:, k + 16] = density
    x[:, k + 3] = np.log1p(text) / 5
    x[:, k + 4] = np.minimum(stops / np.maximum(text, 1) * 20, 2)
    x[:, k + 5] = (text > 200) & (density < 0.3)
    x[:, k + 6] = text == 0
    x[:, k + 7] = own > 80
    x[:, k + 8] = text / max(text[0], 1)
    parents = np.array(tree.parent)
    parents[0] = 0
    x[:, k + 9] = x[parents, k + 1]  # the parent's words
    x[:, k + 10] = x[parents, k]
    x[:, k + 11] = text / np.maximum(runs, 1) < 30
    x[:, k + 12] = 1
    # names say less of articles, and of what holds most of the page's text if no article stands beside it
    whole = x[:, 0] == 1
    holds, within = whole.astype(int), whole.copy()
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] += holds[i]
    for i in range(1, n):
        within[i] |= within[tree.parent[i]]
    large = (x[:, k + 8] > 0.5) & ((holds > 0) | within | (holds[0] == 0))
    x[:, k + 13] = x[:, k + 1] * large
    x[:, k + 14] = x[:, k + 1] * whole
    x[:, k + 15] = x[:, k + 2] * large * whole
    x[:, k + 17] = x[:, k + 2] * large
    # below a part that is named so and holds less than half of the text
    for i in range(1, n):
        p = tree.parent[i]
        x[i, k + 18] = x[p, k + 18] or (x[p, k + 2] and not large[p])
    x[hidden] = 0
    x[hidden, k + 6] = 1
    if not tree.whole:
        x[0] = 0  # a piece of a page has no element there that could be content or not
    return x


def marginals(parent: list[int], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """P(content) of each node, and the expected count of each (parent, child) label pair, by sum-product on the tree.

    Parents come before their children. Messages are kept as odds and scaled, so they can't vanish."""
    n = len(parent)
    up = [min(max(u, -60.0), 60.0) for u in unary]  # log odds of the node's subtree
    (p00, p01), (p10, p11) = pair
    e = [np.exp(v) for v in (p00, p01, p10, p11)]
    e00, e01, e10, e11 = map(float, e)
    message = [0.0] * n
    exp, log = _exp, _log
    for i in range(n - 1, 0, -1):
        o = exp(up[i])
        message[i] = log((e10 + e11 * o) / (e00 + e01 * o))
        up[parent[i]] = max(-60.0, min(60.0, up[parent[i]] + message[i]))
    total, expected = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
    total[0] = up[0]
    probability = [1 / (1 + exp(-up[0]))] + [0.0] * (n - 1)
    for i in range(1, n):
        above, o = total[parent[i]] - message[i], exp(up[i])
        a = exp(max(-60.0, min(60.0, above)))
        down = log((e01 + e11 * a) / (e00 + e10 * a))
        total[i] = max(-60.0, min(60.0, up[i] + down))
        probability[i] = 1 / (1 + exp(-total[i]))
        w00, w01, w10, w11 = e00, e01 * o, e10 * a, e11 * a * o
        z = w00 + w01 + w10 + w11
        expected[0][0] += w00 / z
        expected[0][1] += w01 / z
        expected[1][0] += w10 / z
        expected[1][1] += w11 / z
    return probability, expected


from math import exp as _exp  # noqa: E402
from math import log as _log  # noqa: E402

#: Parts of labelled pages: (markup around the text, whether the text is content). {t} is a sentence or more, {l} a short link text.
CONTENT = ("<p>{t}</p>", "<p>{t}<p>{t}", "<p><b>{t}<br><p>{t}</p>", "<h2>{w}</h2><p>{t}</p>", "<ul><li>{t}</li><li>{w}</li></ul>", "<blockquote>{t}</blockquote>", "<p>{t} <a href=x>{w}</a> {t}</p>", "<div>{t}</div>", "<table><tr><td>{w}</td><td>{t}</td></tr></table>", "<pre>{t}</pre>", "<figure><img><figcaption>{w}</figcaption></figure>", "<p>{w}.</p>", "<p><em>{t}</em> <a href=x>{w}</a></p>", "<section><h3>{w}</h3><p>{t}</p></section>")
OTHER = (
    "<nav><ul><li><a href=x>{l}</a></li><li><a href=x>{l}</a></li><li><a href=x>{l}</a></li></ul></nav>", "<div class=menu><a href=x>{l}</a> <a href=x>{l}</a></div>", "<div class=ad>{t}</div>", "<div class=advert><p>{t}</p></div>", "<div class=sponsored>{w}. {t}</div>",
    "<aside><h3>{w}</h3><p>{t}</p></aside>", "<div class=sidebar><h4>{w}</h4><ul><li><a href=x>{w}</a></li></ul><p>{t}</p></div>", "<form action=x><label>{w}</label><input><button>{l}</button><p>{t}</p></form>", "<div class=cookie-notice><p>{t}</p><button>{l}</button></div>",
    "<div class=notice>{t}</div>", "<section id=comments><h3>{w}</h3><div class=comment><p>{t}</p></div><div class=comment><p>{t}</p></div></section>", "<div class=comments><ol><li><b>{l}</b><p>{t}</p></li></ol></div>", "<div class=share><a href=x>{l}</a><a href=x>{l}</a></div>",
    "<div class=related><h4>{w}</h4><a href=x>{w}</a><a href=x>{w}</a></div>", "<div class=newsletter><p>{t}</p><input></div>", "<p class=breadcrumb><a href=x>{l}</a> / <a href=x>{l}</a></p>", "<div role=navigation><a href=x>{l}</a></div>", "<div role=complementary><p>{t}</p></div>",
)
OTHER += (
    "<section class=comments><article class=comment><h4>{w}</h4><p>{t}</p></article><article class=comment><p>{t}</p></article></section>", "<article class='teaser related'><h3><a href=x>{w}</a></h3><p>{t}</p></article>", "<div class=site-footer><p>{t}</p></div>", "<div id=cookieNotice><p>{t}</p></div>",
    "<ol class=commentlist><li class=comment><p>{t}</p><a href=x class=reply>{l}</a></li></ol>", "<div class='promo box'><p>{t}</p></div>",
)
#: Parts with made-up names: {b} is a bad word, {k} a compound that is bad, {n} a compound that says what of, with a bad word before it.
OTHER += (
    "<div class={k}><p>{t}</p></div>", "<div id={k}>{t}</div>", "<section id={k}><p>{t}</p></section>", "<section id={b}><div><p>{t}</p></div></section>", "<section class={k}><h4>{w}</h4><div><p>{t}</p></div><div><p>{t}</p></div></section>",
    "<aside class={k}><p>{t}</p></aside>", "<div class='{b} {g}'><p>{t}</p><a href=x>{l}</a></div>", "<ul class={k}><li><a href=x>{l}</a></li><li><a href=x>{l}</a></li></ul>", "<div class={b}><div><p>{t}</p></div></div>",
)
CONTENT += ("<div class={n}><img><p>{t}</p></div>", "<p class={n}>{t}</p>", "<div class={n}><p>{t}</p><p>{t}</p></div>", "<section class={g}><h3>{w}</h3><p>{t}</p><p>{t}</p></section>")
#: Text that stands in the page itself.
BARE = ("{t}", "{t}<br>{t}", "<b>{w}</b> {t}", "<h2>{w}</h2>{t}", "<p>{t}</p>")
ROOTS = (
    "<article class={n}>{}</article>", "<article class={k}>{}</article>", "<main class={n}>{}</main>", "<div class='page {n}'><div class=text>{}</div></div>", "<div class={k}><article>{}</article></div>", "<div id={k}><div class={g}>{}</div></div>", "<article>{}</article>", "<article>{}</article>",
    "<main>{}</main>", "<div class=content>{}</div>", "<div id=main-content><div class=post>{}</div></div>", "<main><article class=story>{}</article></main>", "<article><div class=entry-content>{}</div></article>", "<div class=page><section class=article-body>{}</section></div>", "<div>{}</div>", "<div class={g}>{}</div>", "{}",
)
HEADS = ("<header><h1>{w}</h1><a href=x>{l}</a></header>", "<div class=header>{w}</div>", "<header class=site-header><nav><a href=x>{l}</a></nav></header>", "")
FEET = ("<footer>&copy; {w} {t}</footer>", "<div class=footer><p>{t}</p></div>", "<footer><a href=x>{l}</a> {w}</footer>", "")


def labelled_pages(pages: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(html, label of each element) of pages put together from the parts, with boilerplate around and within the content.

    Names are drawn anew for each part, so that the model can't know them; some pages are text without an element around it.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "the", "ou", "é", "st", "ing", "ü")) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    text = lambda: ", ".join(some(3, 9) for _ in range(rng.randint(1, 14))) + "."

    bad, shape = sorted(BAD), sorted(SHAPE - BAD)
    kind = lambda: rng.choice(bad) + rng.choice(("", "", "-" + rng.choice(shape), rng.choice(shape).capitalize()))
    of = lambda: rng.choice(bad) + "-" + "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    names = {"t": text, "w": lambda: some(2, 8), "l": word, "b": lambda: rng.choice(bad), "k": kind, "n": of, "g": lambda: of().split("-")[1]}

    def fill(part: str, content: int) -> str:
        part = re.sub(r"\{(.)\}", lambda m: names[m[1]](), part)
        return re.sub(r"<(\w+)", lambda m: f"<{m[1]} data-y={content}", part)

    out = []
    for _ in range(pages):
        inner = [fill("<h1>{w}</h1>", 1)] if rng.random() < 0.8 else []
        root, boxes = rng.choice(ROOTS), rng.choice((0, 0.2, 0.5))
        for _ in range(rng.randint(1, 7)):
            inner.append(fill(rng.choice(BARE if root == "{}" else CONTENT), 1))
            if rng.random() < boxes:
                inner.append(fill(rng.choice(OTHER), 0))
        body = fill(root, 1).replace("{}", "".join(inner))
        around = [fill(rng.choice(OTHER), 0) for _ in range(rng.randint(1, 4))]
        cut = rng.randint(0, len(around))
        whole = f"<html data-y=0><body data-y=0>{fill(rng.choice(HEADS), 0)}{''.join(around[:cut])}{body}{''.join(around[cut:])}{fill(rng.choice(FEET), 0)}</body></html>"
        piece = rng.random() < 0.08
        whole = body if piece else whole
        tree = Labelled()
        tree.feed(whole)
        tree.close()
        tree.label[0] = int(piece)
        out.append((whole, tree.label))
    return out


class Labelled(Tree):
    def __init__(self):
        super().__init__()
        self.label = [0]

    def handle_starttag(self, tag, attrs):
        before = len(self.tag)
        super().handle_starttag(tag, attrs)
        if len(self.tag) > before:
            # an implied paragraph is content: only that stands in the page itself
            self.label.append(int(dict(attrs).get("data-y", 1)))


@lru_cache(1)
def trained(rounds: int = 120) -> tuple[tuple[float, ...], tuple[tuple[float, float], ...]]:
    """(weights, pair weights) with the largest penalised likelihood of the labelled pages, by Adam steps on exact gradients."""
    data = []
    for html, y in labelled_pages():
        tree = parse(html)
        data.append((tree.parent, features(tree), np.array(y, float)))
    w = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    nodes = sum(len(d[0]) for d in data)
    for t in range(1, rounds + 1):
        g = -0.02 * w
        pair = w[FEATURES:].reshape(2, 2).tolist()
        for parent, x, y in data:
            p, expected = marginals(parent, (x @ w[:FEATURES]).tolist(), pair)
            g[:FEATURES] += x.T @ (y - np.array(p))
            seen, up, own = np.zeros(4), y[np.array(parent[1:], int)], y[1:]
            np.add.at(seen, (2 * up + own).astype(int), 1)
            g[FEATURES:] += seen - np.array(expected).ravel()
        g /= nodes
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return tuple(w[:FEATURES].tolist()), tuple(map(tuple, w[FEATURES:].reshape(2, 2).tolist()))


def main_text(html: str, model: tuple) -> str:
    """Blocks of content in page order, joined by blank lines; empty if there are none."""
    tree = parse(html)
    weights, pair = model
    unary = (features(tree) @ np.array(weights)).tolist()
    hidden = [False] * len(tree.tag)
    for i, tag in enumerate(tree.tag):
        hidden[i] = tag in HIDDEN or (i > 0 and hidden[tree.parent[i]])
        if hidden[i]:
            unary[i] = NEVER
    p, _ = marginals(tree.parent, unary, pair)
    blocks: dict[int, list[str]] = {}
    for node, block, data in tree.runs:
        if p[node] >= 0.5 and not hidden[node] or (data == " " and tree.tag[node] in VOID):
            blocks.setdefault(block, []).append(data)
    lines = (" ".join("".join(b).split()) for _, b in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with main_text (never null) for every row; null or empty html gives an empty text. A column of that name is replaced.

    Repeated rows get one result each, an empty table gives an empty table, and a very long page is parsed whole, in a task of its own
    slice; ids and urls may be null and are only carried along.
    """
    kept = pages.drop("main_text")
    names, key = kept.columns, "_html"
    while key in names:
        key += "_"
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, key):
            text = [main_text(h or "", model) for h in b.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(text, pa.string())], names=[*names, "main_text"])

    return kept.withColumn(key, F.col(html_col).cast("string")).mapInArrow(run, widened(kept.schema, "main_text string"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
