"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a variable, content or not. Its potential comes from features (tag, words of class, id and role,
amount of text, share of link text, what stands above); parent and child are tied by potentials. One sum-product pass up and one down the tree give each
element's marginal, and the text of elements more likely content than not is kept. Weights maximise the conditional likelihood
(gradients from the same messages) of labelled pages, which `labelled_pages` makes by rule: articles among menus, headers, sidebars, notices,
adverts, forms, comments and footers in varied markup.

Text is what an HTML reader shows: character references decoded, white space inside a block made one space, blocks trimmed and joined by
two line feeds in page order; scripts, styles, comments and the head are never text; tags that are not closed are closed by what follows.
Formulas are text of their block. Controls, drawings and fallbacks (`HIDDEN`) are no text from their start to the end tag that matches it, nested ones
of one name included; one that nothing closes before its parent ends hides no more than what stands before the next block, and nothing if it is written as self-closed. Only scripts, styles, titles and
text areas are raw, and run to the end of the page if they are not closed, as in a browser. Tags are read by the rules of browsers: a stray quote is
part of a name, quoted values may hold angle brackets, and a tag that the page ends in is no text. Work grows with the length of a page.

Null and empty pages, and pages without content, give an empty text. Rows are judged one by one, equal rows alike; other columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table

#: a whole tag: end or start, name, attributes (a quote without its end is a character like others)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+\s*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
#: the same, in what is left of a page that ends within a tag
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?+")
NAMED = re.compile(r"</?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: elements that do not end a block of text
MATH = frozenset("maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea".split())
HIDDEN = frozenset("annotation annotation-xml noscript template iframe object svg select button audio video canvas".split())
HIDES = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})[\s/>]", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
ASIDE = frozenset("nav aside footer form header".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Tags:
    """The tags of a page one after the other, as a browser reads them, each character looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.loose = source, False

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it ends an element, name, attributes) of the next tag; comments and declarations have no name."""
        s = self.source
        while (start := s.find("<", at)) >= 0:
            if NAMED.match(s, start):
                m = None if self.loose else TAG.match(s, start)
                if m is None:  # no end of this tag: the page ends within it, or within a quotation of it
                    self.loose = True
                    m = LOOSE.match(s, start)
                return start, m.end(), bool(m[1]), m[2].lower(), m[3]
            if s.startswith("<!--", start):
                if s.startswith((">", "->"), start + 4):
                    return start, s.index(">", start + 4) + 1, False, "", ""
                end = COMMENT_END.search(s, start + 4)
                return start, end.end() if end else len(s), False, "", ""
            if s.startswith(("<!", "<?", "</"), start):
                return start, (s.find(">", start) + 1) or len(s), False, "", ""
            at = start + 1
        return None


class Open:
    """Open elements, innermost last, with where in the stack each name stands."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, value: int) -> None:
        self.at.setdefault(name, []).append(len(self.items))
        self.items.append((name, value))

    def pop(self) -> tuple[str, int]:
        self.at[self.items[-1][0]].pop()
        return self.items.pop()

    def last(self, names) -> int:
        """Place of the innermost element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


class Page:
    """Block elements of a page in page order: `parent`, `tag`, `words` of class, id and role, and blocks of text (element, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.blocks = [-1], ["#root"], [()], []
        stack = Open()
        stack.push("#root", 0)
        buf: list[str] = []
        linked, links, at, muted = 0, 0, 0, False
        hidden = self._hidden(source) if HIDES.search(source) else {}
        tags = Tags(source)

        def flush() -> None:
            nonlocal buf, linked
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                self.blocks.append((stack.items[-1][1], text, min(linked, len(text))))
            buf, linked = [], 0

        def pop_to(depth: int) -> None:
            nonlocal links
            while len(stack.items) > depth:
                if stack.items[-1][0] not in INLINE:
                    flush()
                links -= stack.pop()[0] == "a"

        def take(text: str) -> None:
            nonlocal linked
            if text and not muted:
                buf.append(text)
                linked += len(text) if links > 0 else 0

        while True:
            found = tags.after(at)
            take(source[at : found[0]] if found else source[at:])
            if not found:
                break
            start, at, ends, name, attrs = found
            if not name:
                continue
            if name not in INLINE and name not in HIDDEN and name not in ("option", "optgroup"):
                muted = False
            if ends:
                depth = stack.last((name,))
                if depth > 0:
                    pop_to(depth)
                continue
            if name in INLINE:
                if name in ("br", "mtd"):
                    take(" ")
                if name not in VOID and not attrs.endswith("/"):
                    links += name == "a"
                    stack.push(name, stack.items[-1][1])
                continue
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
                take(" ")
                continue
            if name in HIDDEN:
                take(" ")
                at = hidden.get(start, at)
                muted = muted or start not in hidden and not attrs.endswith("/")
                continue
            closed, within = (("p",), ("td", "th", "#root", "article", "div", "section")) if name in CLOSES_P else CLOSED_BY.get(name, ((), ()))
            depth = stack.last(closed)
            if depth > 0 and depth > stack.last(within):
                pop_to(depth)
            flush()
            if name not in VOID:
                said = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs)) if attrs else ""
                self.parent.append(stack.items[-1][1])
                self.tag.append(name)
                self.words.append(tuple({w.lower() for w in WORD.findall(said)}))
                stack.push(name, len(self.tag) - 1)
        flush()

    @staticmethod
    def _hidden(source: str) -> dict[int, int]:
        """Where each hidden element starts that is closed before its parent ends, and where it ends."""
        stack, tags = Open(), Tags(source)
        out, at, foreign = {}, 0, 0
        while found := tags.after(at):
            start, at, ends, name, attrs = found
            if not name or name in VOID:
                continue
            own = (name in ("svg", "math") or foreign) and attrs.endswith("/")
            if ends or name in ("button", "select"):  # neither holds another of its name
                depth = stack.last((name,))
                if depth >= 0:
                    if ends and name in HIDDEN:
                        out[stack.items[depth][1]] = at
                    while len(stack.items) > depth:
                        foreign -= stack.pop()[0] in ("svg", "math")
            if ends:
                continue
            if own:
                if name in HIDDEN:
                    out[start] = at
            elif name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            else:
                foreign += name in ("svg", "math")
                stack.push(name, start)
        return out

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        chars, linked, depth, named = [0] * n, [0] * n, [0] * n, [()] * n
        for node, text, link in self.blocks:
            chars[node] += len(text)
            linked[node] += link
        out = []
        for i in range(n):
            own = [f"tag={self.tag[i]}", *(f"word={w}" for w in self.words[i])]
            if i:  # whether a part of the page that is named for something else stands above
                depth[i] = depth[self.parent[i]] or int(self.tag[i] in ASIDE) or 2 * int(self.tag[i] in ("article", "main"))
                own.append(f"under={depth[i]},{'head' if self.tag[i][0] == 'h' and self.tag[i][1:].isdigit() else 'rest'}")
                named[i] = self.words[self.parent[i]] or named[self.parent[i]]
                own += [f"in={w}" for w in named[i]]
            if chars[i]:
                share = linked[i] / chars[i]
                own += [f"size={min(int(math.log2(chars[i])) // 2, 5)}", f"links={0 if share < 0.1 else 1 if share < 0.6 else 2}"]
            out.append(own)
        return out


class Model:
    """Weights of features and of parent-child states; `edge[p][c]` is for a parent in state p and a child in state c."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.edge = [[0.0, 0.0], [0.0, 0.0]]

    def marginals(self, parent: list[int], feats: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """Log odds of content of each element, and the expected number of edges in each pair of states."""
        n, get = len(parent), self.weight.get
        unary = [sum(get(f, 0.0) for f in own) for own in feats]
        (e00, e01), (e10, e11) = self.edge
        up, msg = unary[:], [0.0] * n  # in log odds; children stand after their parents
        for i in range(n - 1, 0, -1):
            msg[i] = _mix(up[i], e10, e11) - _mix(up[i], e00, e01)
            up[parent[i]] += msg[i]
        full, pair = up[:], [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            rest = full[parent[i]] - msg[i]
            full[i] = up[i] + _mix(rest, e01, e11) - _mix(rest, e00, e10)
            s = [[e00, e01 + up[i]], [e10 + rest, e11 + rest + up[i]]]
            top = max(map(max, s))
            z = sum(math.exp(x - top) for r in s for x in r)
            for a in (0, 1):
                for b in (0, 1):
                    pair[a][b] += math.exp(s[a][b] - top) / z
        return full, pair

    def odds(self, parent: list[int], feats: list[list[str]]) -> list[float]:
        n, get = len(parent), self.weight.get
        up, msg = [sum(get(f, 0.0) for f in own) for own in feats], [0.0] * n
        (e00, e01), (e10, e11) = self.edge
        for i in range(n - 1, 0, -1):
            msg[i] = _mix(up[i], e10, e11) - _mix(up[i], e00, e01)
            up[parent[i]] += msg[i]
        for i in range(1, n):
            rest = up[parent[i]] - msg[i]
            up[i] += _mix(rest, e01, e11) - _mix(rest, e00, e10)
        return up

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = 70, rate: float = 0.7, ridge: float = 3e-4) -> None:
        """Gradient ascent (with per-weight step sizes) on the conditional log likelihood of the labels."""
        made = [(p.parent, p.features(), y) for p, y in pages]
        size: dict = {}
        for _ in range(rounds):
            grad: dict[str, float] = {}
            edge = [[0.0, 0.0], [0.0, 0.0]]
            for parent, feats, y in made:
                full, pair = self.marginals(parent, feats)
                for i, own in enumerate(feats):
                    g = y[i] - 1 / (1 + math.exp(-max(-40.0, min(40.0, full[i]))))
                    for f in own:
                        grad[f] = grad.get(f, 0.0) + g
                    if i:
                        edge[y[parent[i]]][y[i]] += 1
                for a in (0, 1):
                    for b in (0, 1):
                        edge[a][b] -= pair[a][b]
            for f, g in grad.items():
                g = g / len(made) - ridge * self.weight.get(f, 0.0)
                size[f] = size.get(f, 1e-8) + g * g
                self.weight[f] = self.weight.get(f, 0.0) + rate * g / math.sqrt(size[f])
            for a in (0, 1):
                for b in (0, 1):
                    g = edge[a][b] / len(made) - ridge * self.edge[a][b]
                    size[a, b] = size.get((a, b), 1e-8) + g * g
                    self.edge[a][b] += rate * g / math.sqrt(size[a, b])


def _mix(x: float, off: float, on: float) -> float:
    """log(exp(off) + exp(on + x))"""
    on += x
    return on + math.log1p(math.exp(off - on)) if on > off else off + math.log1p(math.exp(on - off))


#: words that sites give to the parts of a page, by part
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar links tabs pagination pager skip",
    "header": "header masthead banner branding logo top site hero",
    "footer": "footer copyright legal bottom colophon contentinfo imprint credits",
    "sidebar": "sidebar aside related widget widgets recommended popular trending rail complementary tags teaser more latest archive author bio",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall warning message disclaimer",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner outbrain taboola",
    "form": "form search login signup register contact feedback",
    "comments": "comments comment reply replies respond discussion disqus thread reader",
    "share": "share social sharing follow twitter facebook buttons tools print",
}
MAIN = "article main content post entry body text story page single hentry prose".split()


def labelled_pages(count: int = 300, seed: int = 2) -> list[tuple[str, list[str]]]:
    """(html, blocks of the main text) of pages made by rule."""
    r = random.Random(seed)

    def words(n: int) -> str:
        w = ["".join(r.choice(("ta", "re", "in", "on", "el", "mo", "su", "ka", "ver", "li")) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(r.randint(3, 9), n, 9):
            w[i] += r.choice(",.,")
        if r.random() < 0.15:  # texts that repeat one word, tables and lists without a sentence
            return r.choice((" | ", " ", " ** ")).join(w[:1] * n if r.random() < 0.5 else w)
        return " ".join(w).capitalize() + "."

    def mark(tag: str, names: list[str], inner: str, bare: float = 0.15) -> str:
        attr = "" if r.random() < bare else f' {r.choice(("class", "class", "id", "role"))}="{r.choice(("", "", "site-", "page_", "js-"))}{r.choice(names)}{r.choice(("", "", "-wrap", "-box", "_inner", "-1"))}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def part(kind: str) -> str:
        names = NAMES[kind].split()
        link = lambda: f'<a href="/x">{words(r.randint(1, 4))[:-1]}</a>'
        if kind in ("menu", "share"):
            return mark(r.choice(("nav", "div", "ul")), names, "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>", 0.05)
        if kind in ("header", "footer"):
            inner = r.choice((f"<p>{words(r.randint(3, 16))}</p>", f"&copy; {words(r.randint(2, 12))}", f"<h1>{words(3)}</h1><p>{link()} {link()}</p>"))
            tag = r.choice((kind, kind, "div"))
            return mark(tag, names, inner, 0.5 if tag == kind else 0.0)
        if kind == "comments":
            each = "".join(mark(r.choice(("div", "li", "article")), ["comment", "reply", "comment-body"], f"<p>{words(r.randint(4, 60))}</p>" * r.randint(1, 2), 0.1) for _ in range(r.randint(1, 8)))
            return mark(r.choice(("section", "div", "ol")), names, f"<h3>{words(2)}</h3>{each}", 0.0)
        if kind == "sidebar":
            tag = r.choice(("aside", "aside", "div"))
            return mark(tag, names, f"<h3>{words(2)}</h3>" + r.choice((f"<p>{words(r.randint(5, 40))}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>")), 0.4 if tag == "aside" else 0.0)
        if kind == "form":
            return mark("form", names, f"<label>{words(2)}</label><input name=q><p>{words(r.randint(2, 15))}</p><button>{words(1)}</button>", 0.4)
        return mark(r.choice(("div", "div", "section", "p")), names, r.choice((words(r.randint(3, 25)), f"<p>{words(r.randint(5, 30))} {link()}</p>")), 0.0)

    out = []
    for _ in range(count):
        blocks, inner = [], ""
        if r.random() < 0.8:
            blocks.append(words(r.randint(2, 8)))
            inner += f"<h1>{blocks[-1]}</h1>"
        for _ in range(r.choice((1, 2, 4, 8, 15))):
            kind = r.random()
            b = words(r.choice((1, 2, 6, 20, 40, 90)))
            if kind < 0.7:
                inner += f"<p>{b}</p>" if r.random() < 0.8 else f"<p><b>{b}<br>"
                blocks.append(b)
            elif kind < 0.83:
                tag = r.choice(("h2", "h2", "h3", "h3", "h4", "pre", "figcaption", "div", "dd", "td", "section"))
                inner += f"<table><tr><td>{b}</td></tr></table>" if tag == "td" else f"<{tag}>{b}</{tag}>"
                blocks.append(b)
            elif kind < 0.88:
                items = [words(r.randint(2, 12)) for _ in range(3)]
                inner += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
                blocks += items
            elif kind < 0.93:
                inner += f"<blockquote><p>{b}</p></blockquote>"
                blocks.append(b)
            else:
                inner += part(r.choice(("advert", "share", "notice", "sidebar", "form")))
        if r.random() < 0.3:
            inner += part(r.choice(("comments", "share", "sidebar")))
        tag = r.choice(("article", "article", "main", "div", "section"))
        body = mark(tag, MAIN, inner, 0.7 if tag in ("article", "main") else 0.1)
        for _ in range(r.randint(0, 2)):
            body = mark(r.choice(("div", "main", "section")), [*MAIN, "container", "wrapper", "layout", "row", "col"], r.choice((body, body + part("sidebar"), part("menu") + body, body + part("comments"))), 0.3)
        front = "".join(part(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.45)
        back = "".join(part(k) for k in ("comments", "sidebar", "share", "notice", "advert", "footer") if r.random() < 0.45)
        out.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var a='<p>';</script></head><body>{front}{body}{back}</body></html>", blocks))
    return out


def labels(page: Page, content: set[str]) -> list[int]:
    """An element is content if most of the text in and below it is."""
    good, total = [0] * len(page.tag), [0] * len(page.tag)
    for node, text, _ in page.blocks:
        total[node] += len(text)
        good[node] += len(text) * (text in content)
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        total[page.parent[i]] += total[i]
    return [int(2 * g > t) for g, t in zip(good, total, strict=True)]


@lru_cache(maxsize=1)
def trained() -> Model:
    model = Model()
    model.fit([(page := Page(source), labels(page, set(blocks))) for source, blocks in labelled_pages()])
    return model


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    odds = model.odds(page.parent, page.features())
    return "\n\n".join(text for node, text, _ in page.blocks if odds[node] > 0)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), shared.value) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"), "html"))


QUERIES = {"op2_html_extract": op2_html_extract}
