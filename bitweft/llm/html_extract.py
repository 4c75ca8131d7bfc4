"""Main-text extraction with a tree-structured graphical model.

A page's block elements form a tree of binary variables (content or not). A node's potential comes from
features of the element and its text, an edge's potential from the labels of parent and child. Sum-product
message passing, upward and downward, gives each block's content marginal; blocks at 0.5 or more are the text.
The weights are trained by exact likelihood gradients on labelled pages (training_pages()).

Text: character references are decoded, white space within a block becomes one space, blocks are joined in
page order by two line feeds.

Edge cases: null, empty or text-free html gives the empty text; unclosed, misnested or cut-off elements are
closed where HTML closes them; repeated rows and null ids give a row each; an empty table gives an empty
result; extra columns are ignored; nesting of any depth is handled without recursion, and broken pages (unclosed or
unmatched elements, tags and quotes without an end) in linear time.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.llm.arrow import map_rows
from bitweft.session import pick, table

#: Elements that begin and end blocks (fixed values: HTML's block-level and form elements).
BLOCKS = frozenset("html head title body article aside section main header footer nav div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu table caption thead tbody tfoot tr td th form fieldset legend label button select option textarea input details summary dialog figure figcaption blockquote pre address center hr iframe noscript template object".split())
#: Elements whose text is never shown or is no markup.
RAW = frozenset("script style textarea title iframe noscript template noembed noframes xmp".split())
HIDDEN = frozenset("script style iframe noscript template noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, up to an element that bounds the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head", "title"}, {"html"})}
_KEEPS_P = frozenset("label button select option textarea input object".split())

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_QUOTED = re.compile(r"""([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+)>""")
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """Block tree of a page: parallel lists by node, parents before children, and the runs of text."""

    __slots__ = ("tag", "parent", "names", "runs", "own")

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [()]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters of links
        stack, pieces, links, link, at = [0], [], 0, False, 0
        places: dict[str, list[int]] = {}  # of each element, its places in the stack: closing looks nothing up by scanning

        def flush():
            nonlocal pieces, links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.runs.append((stack[-1], text, links))
                pieces, links = [], 0

        def close_from(i):
            while len(stack) > i:
                places[tag_of[stack.pop()]].pop()

        def innermost(tags):
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        tag_of = self.tag
        n, last, quotes = len(source), source.rfind(">"), True
        while at < n:
            m = _OPEN.search(source, at)
            stop = m.start() if m else n
            close = name = attributes = None
            after = n
            if not m:
                pass
            elif m[1]:
                end = source.find("-->", m.end())
                after = end + 3 if end >= 0 else n
            elif stop > last:
                m, stop = None, n  # no tag can end any more
            else:
                close, name = (m[3], None) if m[2] else (None, m[3])
                e = _QUOTED.match(source, m.end()) if name and quotes else None
                if e:
                    attributes, after = e[1], e.end()
                else:
                    # A quote that nothing ends: from here on every tag ends at the next ">", so no end is sought twice.
                    if name:
                        quotes = False
                    end = source.find(">", m.end())
                    if end < 0:
                        m, stop, close, name = None, n, None, None
                    else:
                        attributes, after = source[m.end() : end] if name else None, end + 1
            text = source[at:stop]
            if text:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if link:
                    links += len(text)
            if not m:
                break
            at = after
            if name:
                name = name.lower()
                if name == "br":
                    pieces.append(" ")
                    continue
                if name in BLOCKS or name in RAW:
                    flush()
                    if name in RAW:
                        end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at, max(last + 1, at))
                        stop, after = (end.start(), end.end()) if end else (n, n)
                        if name not in HIDDEN and (t := " ".join(html.unescape(source[at:stop]).split())):
                            self._node(name, stack[-1], attributes)
                            self.runs.append((len(tag_of) - 1, t, 0))
                        at = after
                        continue
                    if name not in _KEEPS_P and tag_of[stack[-1]] == "p":
                        places["p"].pop()
                        stack.pop()
                    if name in _CLOSES:
                        closed, bound = _CLOSES[name]
                        i = innermost(closed)
                        if i and i > innermost(bound):
                            close_from(i)
                    self._node(name, stack[-1], attributes)
                    if name not in VOID:
                        places.setdefault(name, []).append(len(stack))
                        stack.append(len(tag_of) - 1)
                    link = False
                elif name == "a":
                    link = True
            elif close:
                close = close.lower()
                if close in BLOCKS:
                    flush()
                    link = False
                    if tag_of[stack[-1]] == close:
                        places[close].pop()
                        stack.pop()
                    elif places.get(close):
                        close_from(places[close][-1])
                elif close == "a":
                    link = False
        flush()

    def _node(self, name: str, parent: int, attributes: str | None) -> None:
        self.tag.append(name)
        self.parent.append(parent)
        found = ()
        if attributes and "=" in attributes:
            found = tuple({p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m.group(1) or m.group(2) or m.group(3) or "")})
        self.names.append(found)

    def features(self) -> list[list[str]]:
        """Of each node: its element, words of class, id and role, and what its text and its subtree's text are like."""
        n = len(self.tag)
        words, signs, links, chars = [0] * n, [0] * n, [0] * n, [0] * n
        mark = [False] * n
        for node, text, link in self.runs:
            words[node] += text.count(" ") + 1
            chars[node] += len(text)
            links[node] += link
            signs[node] += text[-1] in ".!?…:;»”\"'"
            mark[node] |= "©" in text
        all_chars, all_links = chars[:], links[:]
        for i in range(n - 1, 0, -1):
            all_chars[self.parent[i]] += all_chars[i]
            all_links[self.parent[i]] += all_links[i]
        out = []
        for i in range(n):
            f = ["t=" + self.tag[i]]
            f += ["c=" + x for x in self.names[i]]
            if words[i]:
                w = words[i]
                f.append("w=0" if w < 5 else "w=1" if w < 10 else "w=2" if w < 25 else "w=3" if w < 50 else "w=4")
                if signs[i]:
                    f.append("end")
                if mark[i]:
                    f.append("mark")
            if all_chars[i]:
                d = all_links[i] / all_chars[i]
                f.append(x := "l=0" if d < 0.05 else "l=1" if d < 0.3 else "l=2" if d < 0.7 else "l=3")
                f.append(self.tag[i] + ":" + x)
            else:
                f.append("empty")
            out.append(f)
        return out


def _join(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class TreeModel:
    """Weights of node features (for content) and log potentials of (parent label, child label)."""

    def __init__(self, weight: dict[str, float] | None = None, edge: list[float] | None = None):
        self.weight = weight or {}
        self.edge = edge or [0.0, 0.0, 0.0, 0.0]

    def infer(self, parent: list[int], features: list[list[str]], pairs: bool = False):
        """Content marginals by sum-product; with pairs, also each edge's four joint probabilities."""
        get, n = self.weight.get, len(parent)
        e00, e01, e10, e11 = self.edge
        up0, up1 = [0.0] * n, [sum([get(x, 0.0) for x in f]) for f in features]
        m0, m1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # upward: what a subtree says about its parent's label
            a, b = up0[i], up1[i]
            x, y = _join(a + e00, b + e01), _join(a + e10, b + e11)
            m0[i], m1[i] = x, y
            p = parent[i]
            up0[p] += x
            up1[p] += y
        b0, b1 = up0[:], up1[:]
        joint = []
        for i in range(1, n):  # downward: what the rest of the page says about this node
            p = parent[i]
            r0, r1 = b0[p] - m0[i], b1[p] - m1[i]
            if pairs:
                four = [r0 + e00 + up0[i], r0 + e01 + up1[i], r1 + e10 + up0[i], r1 + e11 + up1[i]]
                top = max(four)
                four = [math.exp(x - top) for x in four]
                total = sum(four)
                joint.append([x / total for x in four])
            b0[i] += _join(r0 + e00, r1 + e10)
            b1[i] += _join(r0 + e01, r1 + e11)
        marginal = [1.0 / (1.0 + math.exp(min(max(x - y, -700.0), 700.0))) for x, y in zip(b0, b1)]
        return (marginal, joint) if pairs else marginal

    def fit(self, pages: list[tuple[list[int], list[list[str]], list[int]]], epochs: int = 40, rate: float = 0.2, l2: float = 0.003) -> TreeModel:
        """AdaGrad ascent on the log likelihood of labelled pages (parents, features, labels)."""
        seen: dict[str, float] = {}
        edge_seen = [1e-6] * 4
        for _ in range(epochs):
            for parent, features, label in pages:
                marginal, joint = self.infer(parent, features, pairs=True)
                gradient: dict[str, float] = {}
                for f, y, p in zip(features, label, marginal):
                    if abs(y - p) > 1e-4:
                        for x in f:
                            gradient[x] = gradient.get(x, 0.0) + y - p
                for x, g in gradient.items():
                    g -= l2 * self.weight.get(x, 0.0)
                    seen[x] = seen.get(x, 1e-6) + g * g
                    self.weight[x] = self.weight.get(x, 0.0) + rate * g / math.sqrt(seen[x])
                edge = [0.0] * 4
                for i, four in enumerate(joint, 1):
                    for k in range(4):
                        edge[k] -= four[k]
                    edge[2 * label[parent[i]] + label[i]] += 1.0
                for k in range(4):
                    g = edge[k] - l2 * self.edge[k]
                    edge_seen[k] += g * g
                    self.edge[k] += rate * g / math.sqrt(edge_seen[k])
        return self

    def text(self, source: str | None) -> str:
        page = Page(source or "")
        if not page.runs:
            return ""
        marginal = self.infer(page.parent, page.features())
        return "\n\n".join([t for node, t, _ in page.runs if marginal[node] >= 0.5])


#: Words that sites use in class and id names, for the training pages.
_CONTENT_NAMES = "content main article post entry story body text page-content post-content article-body entry-content main-content story-body".split()
_MENU = "nav navbar menu main-menu topnav navigation breadcrumb breadcrumbs pagination pager toc tabs".split()
_HEAD = "header masthead topbar banner site-header page-header logo branding".split()
_FOOT = "footer site-footer page-footer bottom copyright colophon legal".split()
_SIDE = "sidebar side aside widget related recommended trending popular tags archive rail more-stories see-also".split()
_NOTICE = "cookie cookies consent gdpr notice alert popup modal overlay toast warning-bar disclaimer announcement".split()
_AD = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense adbox".split()
_FORM = "form search newsletter subscribe signup login contact feedback search-form".split()
_SHARE = "share social sharing follow buttons author-box byline meta print tools".split()
_COMMENT = "comments comment commentlist respond discussion replies disqus reader-comments".split()


def training_pages(count: int = 220, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Labelled pages (html, blocks of the main text), drawn from the layouts that sites use."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyéöñ") for _ in range(rng.randint(2, 9)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pages = []
    for _ in range(count):
        text: list[str] = []

        def sentence(a, b):
            return some(a, b).capitalize() + rng.choice(["."] * 8 + ["?", "!", ""])

        def links(k):
            return "".join(f"<li><a href=/{word()}>{some(1, 3)}</a></li>" for _ in range(k))

        def named(names, tags=("div", "section", "div")):
            tag, name = rng.choice(tags), rng.choice(names)
            attribute = rng.choice(["class", "id"])
            return f'<{tag} {attribute}="{name}">', f"</{tag}>"

        def wrap(pair, inner):
            return pair[0] + inner + pair[1]

        def plain(tag):
            return f"<{tag}>", f"</{tag}>"

        def prose(k):
            return "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>"]).format(sentence(3, 60)) for _ in range(k))

        def menu():
            return wrap(rng.choice([plain("nav"), named(_MENU), named(_MENU, ("ul", "nav"))]), f"<ul>{links(rng.randint(3, 9))}</ul>" if rng.random() < 0.8 else "".join(f"<a href=/>{some(1, 2)}</a> | " for _ in range(5)))

        def header():
            return wrap(rng.choice([plain("header"), named(_HEAD)]), rng.choice([f"<h1>{some(1, 4)}</h1>", f"<div>{some(1, 4)}</div>", ""]) + rng.choice([f"<p>{sentence(3, 9)}</p>", f"<ul>{links(4)}</ul>"]))

        def footer():
            return wrap(rng.choice([plain("footer"), named(_FOOT)]), rng.choice([f"&copy; {some(2, 6)}. {sentence(2, 8)}", f"<p>{sentence(4, 20)}</p><ul>{links(3)}</ul>", f"<p>&copy; {some(1, 4)}</p>"]))

        def side():
            return wrap(rng.choice([plain("aside"), named(_SIDE), named(_SIDE, ("aside", "div"))]), f"<h3>{some(1, 3)}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", prose(2)]))

        def notice():
            return wrap(named(_NOTICE), rng.choice([sentence(5, 30), f"<p>{sentence(5, 30)}</p><button>{some(1, 2)}</button>"]))

        def advert():
            return wrap(named(_AD, ("div", "div", "aside")), rng.choice([sentence(4, 25), f"<p>{sentence(4, 25)}</p>", f"<a href=/>{some(3, 8)}</a>"]))

        def form():
            return wrap(rng.choice([plain("form"), named(_FORM, ("form", "div"))]), f"<label>{some(1, 3)}</label><input type=text><p>{sentence(3, 12)}</p><select><option>{some(1, 2)}<option>{some(1, 2)}</select><button>{some(1, 2)}</button>")

        def share():
            return wrap(named(_SHARE, ("div", "ul")), f"<li>{some(1, 2)}</li><li><a href=/>{some(1, 2)}</a></li>" if rng.random() < 0.5 else sentence(2, 8))

        def comments():
            one = lambda: f'<{(t := rng.choice(["div", "li", "article"]))} class="comment"><p>{some(1, 2)}</p><p>{sentence(4, 40)}</p></{t}>'
            return wrap(named(_COMMENT, ("section", "div", "ol")), f"<h3>{some(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 4))))

        def block(tag, words, inline=True):
            t = words
            text.append(t)
            shown = t
            if inline and rng.random() < 0.25:
                parts = t.split(" ")
                k = rng.randrange(len(parts))
                parts[k] = rng.choice(["<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "<span>{}</span>"]).format(parts[k])
                shown = " ".join(parts)
            return f"<{tag}>{shown}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>")

        def article():
            out = []
            if rng.random() < 0.8:
                h = block("h1", some(2, 9).capitalize(), inline=False)
                out.append(f"<header>{h}</header>" if rng.random() < 0.15 else h)
            for _ in range(rng.randint(2, 9)):
                r = rng.random()
                if r < 0.7:
                    out.append(block("p", sentence(1, 8) if rng.random() < 0.3 else sentence(8, 90)))
                elif r < 0.77:
                    out.append(block(rng.choice(["h2", "h3"]), some(1, 6).capitalize(), inline=False))
                elif r < 0.86:
                    tag = rng.choice(["ul", "ol"])
                    out.append(f"<{tag}>" + "".join(block("li", sentence(2, 15) if rng.random() < 0.7 else some(1, 5)) for _ in range(rng.randint(2, 6))) + f"</{tag}>")
                elif r < 0.9:
                    out.append("<blockquote>" + block("p", sentence(5, 30)) + "</blockquote>")
                elif r < 0.93:
                    out.append("<table>" + "".join("<tr>" + "".join(block("td", some(1, 4)) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
                else:
                    out.append(rng.choice([advert, share, side, notice, form])())
            return "".join(out)

        before = "".join(f() for f in rng.sample([menu, header, notice, advert, side, form], rng.randint(1, 4)))
        shape = rng.random()
        if shape < 0.5:
            body = wrap(plain("article"), article())
        elif shape < 0.62:
            body = wrap(plain("main"), article() if rng.random() < 0.5 else wrap(plain("article"), article()))
        elif shape < 0.9:
            body = wrap(named(_CONTENT_NAMES, ("div", "section", "article")), article())
        else:
            body = article()
        if rng.random() < 0.3:
            body = wrap(rng.choice([plain("div"), named(["wrapper", "container", "row", "layout"])]), body + rng.choice([side, share, menu])())
        after = "".join(f() for f in rng.sample([side, comments, footer, share, advert, form, menu], rng.randint(1, 5)))
        title = f"<head><title>{some(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        pages.append((f"<!DOCTYPE html><html>{title}<body>{before}{body}{after}" + rng.choice(["</body></html>", ""]), text))
    return pages


def labelled(source: str, blocks: list[str]) -> tuple[list[int], list[list[str]], list[int]]:
    """Parents, features and labels of a page: a node is content if content text stands in it or below it."""
    page = Page(source)
    label = [0] * len(page.tag)
    want = iter(blocks)
    nxt = next(want, None)
    for node, text, _ in page.runs:
        if nxt is not None and text == nxt:
            label[node] = 1
            nxt = next(want, None)
    for i in range(len(label) - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = 1
    return page.parent, page.features(), label


@functools.cache
def trained(count: int = 220, seed: int = 11) -> TreeModel:
    return TreeModel().fit([labelled(s, t) for s, t in training_pages(count, seed)])


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """A row per page: id, url, text."""
    model = model or trained()
    d = pick(pages, id=id_col, url=url_col, html=html_col)

    def make():
        return lambda batch: pa.record_batch({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array([model.text(x) for x in batch.column("html").to_pylist()], pa.string())})

    return map_rows(d, f"id {d.schema['id'].dataType.simpleString()}, url {d.schema['url'].dataType.simpleString()}, text string", "html", make)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
