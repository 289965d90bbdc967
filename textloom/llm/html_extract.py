"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its block elements.  Each is content or boilerplate; a
potential for each element comes from its features (tag, words in its class
and id, text and link density) and one for each parent and child from how
often the two agree.  Sum-product message passing, once up from the leaves and
once down from the root, gives each element's exact marginal; blocks whose
marginal for content is at least one half are the page's text.

Weights are fitted by maximum likelihood (the same message passing gives the
gradient) on labelled pages: ``training_pages`` lays out pages of many designs
by rule, each block with its label.  The fit takes seconds, is deterministic
and ships to the tasks as a few hundred numbers.

Defined cases: null and empty html, and pages without content, give the empty
text; unclosed and stray tags are repaired (a block element ends a paragraph,
an end tag closes up to its start tag or is ignored, a head ends at the first
tag or word that can't stand in it; a control that nothing closes ends at the
next block); a page that ends within a tag ends before it; pages of any length
are scanned in a time that grows with their length; formulas are text, drawings
and form controls are hidden within their line; an input column ``text`` is
replaced by the result; repeated rows give equal results, an empty table no
rows; nothing is cut off or dropped.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark
meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr
math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts
mtable mtr mtd mstyle mpadded mphantom merror button! select! option! datalist!""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head object canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template annotation annotation-xml".split())
#: Hidden within a line of text, up to their end tag: they break no paragraph.
SKIPPED = frozenset("svg button select option datalist".split())
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

IN_HEAD = frozenset("html head title meta link base basefont bgsound style script noscript noframes template".split())

NAMED = frozenset("class id role itemprop aria-label".split())
TAG_NAME = re.compile(r"[^\s/>]*")
ATTRIBUTE_NAME = re.compile(r"[\s/]*(=?[^\s/>=]*)")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)[^;]*", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WORD = re.compile(r"[a-z]+")

# Tags and words of class and id attributes that have a weight of their own.
TAGS = """body div p article main section h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure
figcaption nav header footer aside form fieldset address details summary center menu hr""".split()
GOOD_WORDS = "article content post entry story main body text page blog prose news document hentry".split()
BAD_WORDS = """nav menu navbar header footer sidebar side aside ad ads advert advertisement banner sponsor sponsored promo
cookie cookies consent notice alert warning popup modal overlay newsletter subscribe signup login comment comments
reply replies disqus discussion share social related recommended recommendations widget breadcrumb breadcrumbs
pagination pager toolbar search tags meta byline copyright legal disclaimer skip toc masthead topbar bottom links
form gdpr author bio rating feedback respond feed trending popular more""".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
WORD_AT = {w: len(TAGS) + 1 + i for i, w in enumerate(dict.fromkeys(GOOD_WORDS + BAD_WORDS))}
SHAPE_AT = len(TAGS) + 1 + len(WORD_AT)
SHAPES = 10
N_FEATURES = SHAPE_AT + SHAPES


class Node:
    __slots__ = ("tag", "words", "parent", "text", "linked", "blocks", "children")

    def __init__(self, tag: str, words: tuple[str, ...], parent: int):
        self.tag, self.words, self.parent = tag, words, parent
        self.text = self.linked = self.blocks = self.children = 0


class Scanner:
    """Tags and text of a page, front to back: nothing is looked at more than a few times, however untidy it is."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[str, int] = {}  # place of the next end tag by name, once looked for; -1: there is none

    def find(self, what: str, at: int) -> int:
        """As str.find, but an answer holds until it is passed, and "none" for ever."""
        known = self.ends.get(what, at - 1)
        if known != -1 and known < at or what not in self.ends:
            known = self.ends[what] = self.page.find(what, at)
        return known

    def next_end(self, tag: str, at: int) -> int:
        """Place of the next ``</tag`` in any case, or -1."""
        key = "</" + tag
        known = self.ends.get(key)
        if known is None or known != -1 and known < at:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(self.page, at)
            known = self.ends[key] = m.start() if m else -1
        return known

    def next_start(self, tag: str, at: int) -> int:
        key = "<" + tag
        known = self.ends.get(key)
        if known is None or known != -1 and known < at:
            m = re.compile(rf"<{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
            known = self.ends[key] = m.start() if m else -1
        return known

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Attributes from ``at`` on, the place behind the tag's ``>`` (or of the page's end) and whether ``/>`` ends it.

        As in HTML a quoted value ends at its quote and the next character starts
        an attribute.  A quote that nothing closes belongs to an unquoted value.
        """
        page, out = self.page, []
        while True:
            m = ATTRIBUTE_NAME.match(page, at)
            name, at = m[1], m.end()
            if not name:
                if at >= len(page):
                    return out, at, False
                return out, at + 1, page[at - 1] == "/"  # page[at] is ">"
            value = ""
            eq = EQUALS.match(page, at)
            if eq:
                at = eq.end()
                quote = page[at:at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1:end], end + 1
                else:
                    m = UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            out.append((name.lower(), value))

    def tokens(self) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
        """(kind, name or text, attributes, whether ``/>`` ends it); kinds are text, start, end and hidden."""
        page, at, begin = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            c = page[at + 1:at + 2]
            end_tag = c == "/"
            letter = page[at + 2:at + 3] if end_tag else c
            if not (letter.isascii() and letter.isalpha()) and c not in ("!", "?") and not (end_tag and letter):
                at += 1  # a bare <
                continue
            if at > begin:
                yield "text", page[begin:at], [], False
            if letter.isascii() and letter.isalpha():
                m = TAG_NAME.match(page, at + 1 + end_tag)
                tag = m[0].lower()
                attrs, at, closed = self.attributes(m.end())
                if at >= len(page) and page[-1:] != ">":
                    return  # the page ends within a tag
                begin = at
                if end_tag:
                    yield "end", tag, attrs, closed
                    continue
                if tag in RAW:
                    end = self.next_end(tag, at)
                    at = begin = len(page) if end < 0 else self.attributes(end + 2 + len(tag))[1]
                    yield "hidden", tag, attrs, closed
                    continue
                if tag in SKIPPED:
                    if tag == "svg" and closed:
                        continue
                    end = self.next_end(tag, at)
                    again = self.next_start(tag, at) if tag != "svg" else -1
                    if end >= 0 and (again < 0 or end < again):
                        at = begin = self.attributes(end + 2 + len(tag))[1]
                    elif tag != "svg":  # nothing ends it: it hides what comes up to the next block
                        yield "start", tag + "!", attrs, closed
                    continue
                yield "start", tag, attrs, closed
                continue
            if page.startswith("<!--", at):
                short = page.startswith((">", "->"), at + 4)
                end = at + 3 if short else self.find("-->", at + 4)
                at = page.find(">", end) + 1 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", at):
                end = self.find("]]>", at)
                at = end + 3 if end >= 0 else len(page)
            else:
                end = self.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            begin = at
        if begin < len(page):
            yield "text", page[begin:], [], False


def hides(attrs: list[tuple[str, str]]) -> bool:
    """Whether a start tag's attributes hide the element: hidden, aria-hidden=true or a style of display: none."""
    values: dict[str, str] = {}
    for name, value in attrs:
        values.setdefault(name, value)  # of a repeated attribute the first counts
    if "hidden" in values and values["hidden"].strip().lower() != "until-found":
        return True
    if values.get("aria-hidden", "").strip().lower() == "true":
        return True
    if "style" not in values:
        return False
    shown = list(DISPLAY.finditer(CSS_COMMENT.sub(" ", html_lib.unescape(values.get("style", "")))))
    shown = [m for m in shown if "!important" in m.group().replace(" ", "").lower()] or shown
    return bool(shown) and shown[-1][1].lower() == "none"


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements (a node's parent comes before it) and the blocks of text: (node, text)."""
    nodes = [Node("body", (), -1)]
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements with their block node
    blocks: list[tuple[int, str]] = []
    part: list[str] = []
    hidden: list[int] = []  # depths of the stack at which unseen elements began
    links = 0
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if part:
            text = " ".join(html_lib.unescape("".join(part)).split())
            part.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.text += len(text)
                node.linked += min(linked, len(text))
                node.blocks += 1
                blocks.append((stack[-1][1], text))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack[-1]
            if tag not in INLINE:
                flush()
            elif tag == "a":
                links = max(0, links - 1)
            stack.pop()
            if hidden and hidden[-1] >= len(stack):
                hidden.pop()

    def end_head() -> None:
        if stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    def words(s: str) -> None:
        nonlocal linked
        if s.strip(" \t\n\r\f"):
            end_head()
        if s and not hidden:
            part.append(s)
            if links:
                linked += len(s)

    for kind, tag, attrs, closed in Scanner(page).tokens():
        if kind == "text":
            words(tag)
            continue
        if kind == "hidden":
            continue
        if kind == "end":
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == tag:
                    pop_to(d)
                    break
                if tag in INLINE and stack[d][0] not in INLINE:
                    break  # an inline end tag doesn't close blocks
            if tag == "br":
                words(" ")
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in INLINE:
            if tag in VOID:
                words(" ")
                continue
            if tag == "a":
                links += 1
            if tag == "math" and closed:
                continue
            stack.append((tag, stack[-1][1]))
            if tag.endswith("!") or hides(attrs):
                hidden.append(len(stack) - 1)
            continue
        if tag in ("html", "body"):
            continue
        if tag == "head" and (len(stack) > 1 or len(nodes) > 1 or blocks or "".join(part).strip()):
            continue  # a second head, or one in the body, is ignored
        for d in range(len(stack) - 1, 0, -1):  # a block ends a control that nothing closed
            if stack[d][0].endswith("!"):
                pop_to(d)
            elif stack[d][0] not in INLINE:
                break
        if tag in ENDS_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == "p":
                    pop_to(d)
                    break
                if stack[d][0] not in INLINE:
                    break
        if tag in CLOSES:
            stop = SCOPE.get(tag, ())
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in CLOSES[tag]:
                    pop_to(d)
                elif stack[d][0] in stop:
                    break
        flush()
        if tag in VOID:
            continue
        if tag in UNSEEN:
            stack.append((tag, stack[-1][1]))
            hidden.append(len(stack) - 1)
            continue
        named = " ".join(value for name, value in attrs if name in NAMED)
        found = tuple(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
        nodes[stack[-1][1]].children += 1
        nodes.append(Node(tag, found, stack[-1][1]))
        stack.append((tag, len(nodes) - 1))
        if hides(attrs):
            hidden.append(len(stack) - 1)
        if not closed:
            continue
        if tag not in ENDS_P:
            pop_to(len(stack) - 1)
    pop_to(1)
    flush()
    return nodes, blocks


def node_features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: (node, feature) pairs, all of weight one, and the shape buckets among them."""
    total, links, units = ([getattr(n, k) for n in nodes] for k in ("text", "linked", "blocks"))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        total[p] += total[i]
        links[p] += links[i]
        units[p] += units[i]
    rows, cols = [], []
    for i, n in enumerate(nodes):
        own = {TAG_AT.get(n.tag, len(TAGS)), *(WORD_AT[w] for w in n.words if w in WORD_AT)}
        density = links[i] / max(total[i], 1)
        own.add(SHAPE_AT + (0 if density < 0.2 else 1 if density < 0.6 else 2))
        mean = total[i] / max(units[i], 1)
        own.add(SHAPE_AT + (3 if mean < 25 else 4 if mean < 80 else 5 if mean < 200 else 6))
        share = total[i] / max(total[0], 1)
        own.add(SHAPE_AT + (7 if share < 0.1 else 8 if share < 0.5 else 9))
        rows.extend([i] * len(own))
        cols.extend(own)
    return np.array(rows), np.array(cols)


class Forest:
    """Many pages' trees in arrays, by depth, for message passing in a few steps."""

    def __init__(self, pages: list[list[Node]]):
        parent, rows, cols = [], [], []
        base = 0
        self.first = []
        for nodes in pages:
            self.first.append(base)
            parent.extend(n.parent + base if n.parent >= 0 else -1 for n in nodes)
            r, c = node_features(nodes)
            rows.append(r + base)
            cols.append(c)
            base += len(nodes)
        self.n = base
        self.parent = np.array(parent, np.int64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, int)
        self.cols = np.concatenate(cols) if cols else np.zeros(0, int)
        depth = np.zeros(base, np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of nodes (n, 2) and of edges (n, 2, 2; parent's value first), and the log-partition.

    ``unary`` (n, 2) and ``pair`` (2, 2) are log-potentials.
    """
    up = np.zeros((forest.n, 2))  # message to the parent
    inside = unary.copy()
    for level in reversed(forest.levels):
        m = np.logaddexp(pair[:, 0] + inside[level, :1], pair[:, 1] + inside[level, 1:])
        up[level] = m
        np.add.at(inside, forest.parent[level], m)
    belief = inside.copy()
    edges = np.zeros((forest.n, 2, 2))
    for level in forest.levels:
        rest = belief[forest.parent[level]] - up[level]  # the parent without this child
        joint = rest[:, :, None] + pair[None] + inside[level][:, None, :]
        joint = joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
        edges[level] = np.exp(joint)
        belief[level] = inside[level] + np.logaddexp(rest[:, :1] + pair[0], rest[:, 1:] + pair[1])
    roots = np.flatnonzero(forest.parent < 0)
    log_z = float(np.logaddexp(inside[roots, 0], inside[roots, 1]).sum())
    marginal = np.exp(belief - np.logaddexp(belief[:, :1], belief[:, 1:]))
    return marginal, edges, log_z


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def unary(self, forest: Forest) -> np.ndarray:
        score = np.bincount(forest.rows, self.weights[forest.cols], minlength=forest.n)
        return np.stack([-score / 2, score / 2], axis=1)

    def extract(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(p) for p in pages]
        forest = Forest([nodes for nodes, _ in parsed])
        content = sum_product(forest, self.unary(forest), self.pair)[0][:, 1] >= 0.5 if forest.n else np.zeros(0, bool)
        return ["\n\n".join(t for n, t in blocks if content[base + n])
                for base, (_, blocks) in zip(forest.first, parsed)]


def fit(pages: list[tuple[str, list[str]]], rounds: int = 200, ridge: float = 0.001, rate: float = 0.3) -> Model:
    """Maximum likelihood on (html, content texts): a node's label is 1 if its own text is content.

    Elements without text of their own take the majority of what they hold.
    """
    trees, labels = [], []
    for page, content in pages:
        nodes, blocks = parse(page)
        good = np.zeros(len(nodes))
        all_ = np.zeros(len(nodes))
        wanted = set(content)
        for n, t in blocks:
            good[n] += len(t) * (t in wanted)
            all_[n] += len(t)
        own = all_ > 0
        y = (good * 2 >= all_) & own
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
            all_[nodes[i].parent] += all_[i]
        y = np.where(own, y, (good * 2 >= all_) & (all_ > 0))
        trees.append(nodes)
        labels.append(y)
    forest, y = Forest(trees), np.concatenate(labels).astype(int)
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen_w = np.bincount(forest.cols, y[forest.rows], minlength=N_FEATURES)
    seen_pair = np.zeros((2, 2))
    np.add.at(seen_pair, (y[forest.parent[child]], y[child]), 1)
    m_w, m_p, v_w, v_p = np.zeros_like(w), np.zeros_like(pair), np.zeros_like(w), np.zeros_like(pair)
    for t in range(1, rounds + 1):  # Adam on the mean log-likelihood
        model = Model(w, pair)
        marginal, edges, _ = sum_product(forest, model.unary(forest), pair)
        g_w = (seen_w - np.bincount(forest.cols, marginal[forest.rows, 1], minlength=N_FEATURES)) / len(trees) - ridge * w
        g_p = (seen_pair - edges[child].sum(axis=0)) / len(trees) - ridge * pair
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w ** 2
        m_p, v_p = 0.9 * m_p + 0.1 * g_p, 0.99 * v_p + 0.01 * g_p ** 2
        w = w + rate * (m_w / (1 - 0.9 ** t)) / (np.sqrt(v_w / (1 - 0.99 ** t)) + 1e-8)
        pair = pair + rate * (m_p / (1 - 0.9 ** t)) / (np.sqrt(v_p / (1 - 0.99 ** t)) + 1e-8)
        rate *= 0.985
    return Model(w, pair)


# ------------------------------------------------------------------ labelled pages


def training_pages(count: int = 500, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Labelled pages of many designs: (html, the blocks that are content).

    Designs differ in the element and names around the article, in which
    boilerplate stands where (also inside the article), in unclosed tags, and
    in how long and how linked blocks are.
    """
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi wo xa ye zo an er in or ul".split()

    def sentence(lo: int, hi: int) -> str:
        ws = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        return " ".join(ws).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{sentence(1, 2)}</a></li>' for i in range(n))

    def named(tag: str, names: list[str], inner: str) -> str:
        kind = rng.choice(["class", "id", "class"])
        name = rng.choice(names) + rng.choice(["", "-box", "-wrap", " block", "_1"])
        return f'<{tag} {kind}="{name}">{inner}</{tag}>' if rng.random() < 0.85 else f"<{tag}>{inner}</{tag}>"

    def boilerplate(kind: str) -> str:
        p = f"<p>{sentence(4, 40)}</p>"
        line = sentence(4, 25)
        must = lambda tag, names, inner: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">{inner}</{tag}>'
        if kind == "nav":
            return rng.choice([f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>",
                               must("div", ["menu", "nav", "navbar", "main-menu", "top-nav"], f"<ul>{links(6)}</ul>"),
                               must("ul", ["menu", "nav", "breadcrumbs", "pagination"], links(5))])
        if kind == "header":
            return rng.choice([f"<header><h1>{sentence(1, 4)}</h1><p>{sentence(2, 9)}</p></header>",
                               f"<header><a href='/'>{sentence(1, 3)}</a><p>{line}</p></header>",
                               must("div", ["header", "masthead", "site-header", "topbar", "banner"], f"<h2>{sentence(1, 4)}</h2>{line}")])
        if kind == "footer":
            return rng.choice([f"<footer>&copy; {line}</footer>", f"<footer><p>{line}</p><ul>{links(3)}</ul></footer>",
                               must("div", ["footer", "site-footer", "copyright", "legal", "bottom-links"], p)])
        if kind == "aside":
            return rng.choice([f"<aside><h3>{sentence(1, 3)}</h3><p>{line}</p></aside>", f"<aside>{line}</aside>",
                               must("div", ["sidebar", "side", "widget", "related", "recommended", "popular"], f"<h3>{sentence(1, 3)}</h3><ul>{links(4)}</ul>{p}")])
        if kind == "ad":
            return must(rng.choice(["div", "div", "section", "p", "aside"]),
                        ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "banner"], rng.choice([line, p]))
        if kind == "notice":
            return must(rng.choice(["div", "div", "section", "p"]),
                        ["cookie-notice", "cookie", "consent", "notice", "alert", "gdpr", "popup", "newsletter", "subscribe"], rng.choice([line, p, p + p]))
        if kind == "form":
            return rng.choice([f"<form action='/s'><label>{sentence(1, 3)}</label><input name=q><p>{line}</p><button>go</button></form>",
                               f"<form><fieldset>{line}<select><option>{line}</option></select></fieldset></form>",
                               must("div", ["search", "login", "signup", "newsletter"], f"<form>{line}</form>")])
        if kind == "share":
            return must("div", ["share", "social", "tags", "meta", "byline", "author-bio", "related", "toolbar"], rng.choice([f"<ul>{links(3)}</ul>", line]))
        inner = "".join(must(rng.choice(["div", "li", "article", "p", "div"]), ["comment", "reply", "comment-body", "comment"],
                             rng.choice([f"<p>{sentence(5, 60)}</p>", sentence(5, 60), f"<b>{sentence(1, 2)}</b><p>{sentence(5, 50)}</p>"]))
                        for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.5:
            inner = f"<h3>{sentence(1, 2)}</h3>" + inner
        return rng.choice([must(rng.choice(["section", "div", "ol", "ul"]), ["comments", "comment-list", "discussion", "disqus", "respond", "replies"], inner)])

    def article() -> tuple[str, list[str]]:
        out, texts = [], []

        def block(tag: str, t: str, close: bool = True) -> None:
            texts.append(t)
            inner = t
            if rng.random() < 0.25 and len(t.split()) > 3:
                ws = t.split(" ")
                k = rng.randrange(len(ws) - 1)
                ws[k] = f"<{(e := rng.choice(['b', 'i', 'em', 'a href=/x', 'span']))}>{ws[k]}</{e.split()[0]}>"
                inner = " ".join(ws)
            out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))

        if rng.random() < 0.8:
            block(rng.choice(["h1", "h1", "h2"]), sentence(2, 12))
        unclosed = rng.random() < 0.2
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.1:
                block(rng.choice(["h2", "h3"]), sentence(1, 6))
            elif r < 0.16:
                items = [sentence(2, 15) for _ in range(rng.randint(2, 4))]
                texts.extend(items)
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{t}</li>" for t in items) + f"</{tag}>")
            elif r < 0.2:
                t = sentence(5, 40)
                texts.append(t)
                out.append(f"<blockquote>{t}</blockquote>" if rng.random() < 0.5 else f"<pre>{t}</pre>")
            elif r < 0.24:
                cells = [sentence(1, 4) for _ in range(4)]
                texts.extend(cells)
                out.append("<table><tr>" + "".join(f"<td>{t}</td>" for t in cells) + "</tr></table>")
            elif r < 0.27:
                t = sentence(3, 10)
                texts.append(t)
                out.append(f"<figure><img src=x><figcaption>{t}</figcaption></figure>")
            else:
                block("p", sentence(*rng.choice([(1, 6), (5, 30), (20, 90), (60, 200)])), not unclosed)
            if rng.random() < 0.12:
                out.append(boilerplate(rng.choice(["ad", "share", "notice", "aside", "form", "ad"])))
        return "".join(out), texts

    pages = []
    for _ in range(count):
        body, texts = article()
        wrap = rng.choice(["article", "article", "main", "section", "div", "div", "both"])
        names = ["content", "post", "entry-content", "article-body", "story", "main", "main-content", "post-text", "blog-post", "page-body"]
        if wrap == "both":
            body = f"<main><article>{body}</article>{boilerplate('comments') if rng.random() < 0.4 else ''}</main>"
        elif wrap in ("div", "section"):
            body = f'<{wrap} {rng.choice(["class", "id"])}="{rng.choice(names)}">{body}</{wrap}>'
        else:
            body = named(wrap, names, body)
        if rng.random() < 0.4:
            body = named("div", ["container", "wrapper", "page", "layout", "row"],
                         body + (boilerplate("aside") if rng.random() < 0.5 else ""))
        before = [boilerplate(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "nav"], rng.randint(1, 4))]
        after = [boilerplate(k) for k in rng.sample(["comments", "aside", "share", "ad", "footer", "form", "nav"], rng.randint(0, 4))]
        end = boilerplate("footer") if rng.random() < 0.8 else ""
        pages.append((f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title><style>p{{}}</style></head><body>"
                      f"{''.join(before)}{body}{''.join(after)}{end}" + rng.choice(["</body></html>", ""]), texts))
    return pages


def trained() -> Model:
    return fit(training_pages())


# -------------------------------------------------------------------- Spark jobs


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, and ``text``; one row for each input row."""
    names = [c for c in pages.columns if c not in (html_col, "text")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in [*names]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = model.extract(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(texts, pa.string())],
                                                 names=[*names, "text"])

    return pages.select(*names, F.col(html_col)).mapInArrow(run, schema)
