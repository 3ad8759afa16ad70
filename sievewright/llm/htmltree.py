"""HTML extraction with a tree-structured graphical model.

A page is parsed into a tree of block elements. Every element has a hidden state: off (menus, adverts, comments and the
like), content, or layout, a box that holds parts of the page and whose own state says nothing about them. It depends
on its parent's state by a pairwise potential, chosen by the child's tag and by words in its class, id and role: a
paragraph in content is content, a footer hardly ever is, and in a layout box the name of a child, if it has a telling
one, counts, or else its text. And it explains what can be seen of the element (the emission): the share of its text
that lies in links, its share of the page's text, how much text is its own and how that is punctuated. Sum-product
messages go from the leaves to the root and back and give each element's exact marginals; text of elements that are
rather content than off is the main text.

Both potentials are relative frequencies in labelled pages: elements marked ``data-main`` 0, 1 or 2 (layout), others as
their parent. ``labelled_pages`` writes such pages, a bounded number of them (``TRAINING_PAGES``), in varied layouts,
named and unnamed; pages labelled elsewhere can be given to ``train`` instead. Marks are never read when text is
extracted.

Defined cases: null or empty html has no text; end tags may be missing or stray; what follows an unclosed script,
style, textarea, title, iframe or comment is part of it, while other elements end with their parent, and buttons and
other controls with the next block of the page too; drawings and templates are left out where they are closed; a tag
that never ends is text; a page without any block belongs to one root element; very long pages are parsed whole, in time
linear in their length; repeated rows each get their row; other columns of the input play no part; an empty table gives
an empty result; text is never cut.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 900
#: Off, content, layout.
OFF, MAIN, BOX = STATES = range(3)
#: Power of the emissions: the texts of neighbours are alike, so each counts for less than an independent one.
TEMPER = 0.25
#: Rows of a potential seen less often than about this lean on those of the hint, the tag, or all.
SMOOTH = 1.0

# Elements of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover semantics annotation".split())
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist", "optgroup"}, "optgroup": {"select"}}
SKIPPED = frozenset("svg template".split())
LAYOUT = frozenset("main article section div header footer nav aside form fieldset address details dialog figure table tr td ul ol li dl p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button select optgroup option datalist".split())
ENDS_CONTROLS = CLOSES_P | frozenset("body tr td th".split())
#: Words of names, by what they tell. The first three are telling; ``weak`` ones also occur in names of content.
HINTS = {
    "off": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toolbar skip header masthead topbar footer foot copyright sidebar aside widget widgets",
    "ad": "ad ads advert adverts advertisement advertising adslot adbox banner sponsor sponsored promo promotion outbrain taboola doubleclick affiliate",
    "notice": "cookie cookies consent gdpr popup modal overlay paywall subscribe subscription newsletter signup login search",
    "talk": "comments comment commentlist disqus reply replies respond discussion",
    "weak": "head bottom legal side rail notice notices notification alert dialog form contact thread review reviews share sharing social related recommended more tag tags meta byline author teaser",
    "main": "article articlebody content main post entry story body text prose copy",
}
KIND_OF_WORD = {word: kind for kind, words in HINTS.items() for word in words.split()}
TELLING = ("off", "ad", "notice", "talk")

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|data-main)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_SKIP = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED}
_STOPS = re.compile(r"[.,;:!?…。，、؟]")


class Node:
    __slots__ = ("tag", "parent", "hint", "mark", "chars", "linked", "own", "stops", "share")

    def __init__(self, tag: str, parent: int, hint: str = "none", mark: int | None = None):
        self.tag, self.parent, self.hint, self.mark = tag, parent, hint, mark
        self.chars = self.linked = self.own = self.stops = 0
        self.share = 0.0


def _hint(attributes: str) -> tuple[str, int | None]:
    """What an element's attributes tell, and its mark."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "none", None
    words, mark, named = set(), None, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "data-main":
            mark = int(value) if value in ("0", "1", "2") else None
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return "hidden", mark
        elif name != "style" and value:
            named = True
            words.update(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
    kinds = {KIND_OF_WORD[w] for w in words if w in KIND_OF_WORD}
    for telling in TELLING:
        if telling in kinds:
            return ("mixed" if "main" in kinds else telling), mark
    if len(kinds) == 1:
        return kinds.pop(), mark
    return ("other" if named else "none"), mark


class _Tags:
    """The tags of a page, front to back; what it has found to be missing it never looks for again, so it is linear."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quotes = {q: html.rfind(q) for q in "\"'"}
        self.ends: dict[str, dict[int, int]] = {}

    def end(self, at: int) -> int:
        """Behind the sign that ends the tag which begins at ``at``, or -1; signs in quotes end nothing, open quotes are none."""
        while at <= self.last:
            m = _STOP.search(self.html, at)
            if m is None:
                return -1
            at = m.end()
            if m[0] == ">":
                return at
            if self.quotes[m[0]] >= at:
                at = self.html.find(m[0], at) + 1
        return -1

    def next(self, at: int) -> tuple[int, str, str, str]:
        """For the sign at ``at``: where its tag ends, then "/" of an end tag, name and attributes; no name for comments and the like, -1 for text."""
        html = self.html
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(html)), "", "", ""
        if html.startswith(("<!", "<?"), at):
            return (html.find(">", at) + 1 if at < self.last else -1), "", "", ""
        m = _NAME.match(html, at + 1)
        end = self.end(m.end()) if m else -1
        return (end, m[1], m[2].lower(), html[m.end() : end - 1]) if end >= 0 else (-1, "", "", "")


    def skip(self, tag: str, at: int) -> int:
        """Behind the end tag of the element that opens before ``at``, or ``at`` where there is none."""
        if tag not in self.ends:
            ends, opened = self.ends.setdefault(tag, {}), []
            for m in _SKIP[tag].finditer(self.html):
                if not m[1] and not m[0].endswith("/>"):
                    opened.append(m.end())
                elif m[1] and opened:
                    ends[opened.pop()] = m.end()
        return self.ends[tag].get(at, at)


class _Stack:
    """The open elements, the root first, and how many of each tag are among them, so that none is sought in vain."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.open, self.count = nodes, [0], Counter()

    def push(self, i: int) -> None:
        self.open.append(i)
        self.count[self.nodes[i].tag] += 1

    def close(self, tags: Iterable[str], scopes: Iterable[str] = ()) -> None:
        """Ends the innermost open element with one of the tags, and all in it, unless one of the scopes comes before."""
        if not any(self.count[t] for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[at]].tag
            if tag in scopes:
                return
            if tag in tags:
                for i in self.open[at:]:
                    self.count[self.nodes[i].tag] -= 1
                del self.open[at:]
                return


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the text blocks in page order as (element, raw text with references)."""
    nodes = [Node("html", -1)]
    stack, tags = _Stack(nodes), _Tags(html)
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    links = 0
    where, size = 0, len(html)

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if not text.isspace():
                blocks.append((stack.open[-1], text))

    def text(piece: str) -> None:
        run.append(piece)
        n = 0 if piece.isspace() else len(piece)
        node = nodes[stack.open[-1]]
        node.chars += n
        node.own += n
        node.stops += len(_STOPS.findall(piece))
        if links:
            node.linked += n

    while where < size:
        at = html.find("<", where)
        if at < 0:
            text(html[where:])
            break
        if at > where:
            text(html[where:at])
        end, closing, tag, attributes = tags.next(at)
        if end < 0:  # a lone sign, or a tag that never ends
            text("<")
            where = at + 1
            continue
        where = end
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = _RAW_END[tag].search(html, where)
                where = close.end() if close else size
                run.append(" ")
            continue
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                where = tags.skip(tag, end)
                run.append(" ")
            continue
        if tag in INLINE and tag not in CONTROLS:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br" or tag == "img":
                run.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            stack.close((tag,))
            continue
        if tag in ("html", "body", "head"):
            mark = _hint(attributes)[1]
            nodes[0].mark = nodes[0].mark if mark is None else mark
            continue
        if tag in ENDS_CONTROLS:
            stack.close(("button", "select", "datalist"))
        if tag in CLOSES_P:
            stack.close(("p",))
        elif tag in SIBLINGS:
            stack.close(SIBLINGS[tag], SCOPES.get(tag, ()))
        links = 0
        hint, mark = _hint(attributes)
        nodes.append(Node(tag, stack.open[-1], hint, mark))
        if not attributes.endswith("/"):
            stack.push(len(nodes) - 1)
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars += node.chars
        up.linked += node.linked
    for node in nodes:
        node.share = node.chars / max(1, nodes[0].chars)
    return nodes, blocks


def kind(node: Node) -> tuple[str, str]:
    """What selects an edge's potential: a tag that tells something, or none, and the hint of the child."""
    tag = "td" if node.tag == "th" else "heading" if node.tag in HEADINGS else node.tag
    return (tag if tag in LAYOUT or tag == "heading" else "plain", node.hint)


def features(node: Node) -> tuple[tuple, tuple, tuple]:
    """What a node's state explains: links and share of the page for all of its text, size and stops for its own."""
    density = node.linked / node.chars if node.chars else -1.0
    linked = 0 if density < 0 else 1 if density == 0 else 2 if density < 0.25 else 3 if density < 0.6 else 4
    share = sum(node.share >= x for x in (0.02, 0.1, 0.3, 0.6))
    own = sum(node.own >= x for x in (1, 25, 80, 200, 600))
    stops = sum(node.stops >= x for x in (1, 2, 4))
    return (linked, own > 0), (share, own > 0), (own, stops)


class TreeModel:
    """Potentials as plain probabilities: roots[s], pairs[kind of edge][s of the parent][s], and the emissions by state."""

    def __init__(self, pages: Iterable[str], smooth: float = 0.5):
        roots = [smooth] * len(STATES)
        fresh = lambda: [[0.0] * len(STATES) for _ in STATES]
        pairs: dict = {}
        seen: list[list[Counter]] = [[Counter() for _ in range(3)] for _ in STATES]
        for html in pages:
            nodes, _ = parse(html)
            state: list[int] = []
            for node in nodes:
                s = node.mark if node.mark is not None else state[node.parent] if node.parent >= 0 else BOX
                state.append(s)
                if node.parent < 0:
                    roots[s] += 1
                else:
                    tag, hint = kind(node)
                    for k in ((tag, hint), (tag, None), (None, hint), (None, None)):
                        pairs.setdefault(k, fresh())[state[node.parent]][s] += 1
                for c, f in zip(seen[s], features(node)):
                    c[f] += 1
        self.roots = [x / sum(roots) for x in roots]
        self.counts = pairs
        self.pairs: dict[tuple, list[list[float]]] = {}
        self.emit: list[dict] = []
        for j in range(3):
            values = set().union(*(seen[s][j] for s in STATES))
            total = [sum(seen[s][j].values()) + smooth * (len(values) + 1) for s in STATES]
            self.emit.append({v: tuple((seen[s][j][v] + smooth) / total[s] for s in STATES) for v in values})
        self.memory: dict[tuple, list[float]] = {}

    def pair(self, node: Node) -> list[list[float]]:
        """The potential of the edge to a node: its kind's frequencies, leaning on those of its hint or its tag, and of all."""
        key = kind(node)
        if (out := self.pairs.get(key)) is None:
            tag, hint = key
            # A telling name says more than the tag; where the name says nothing the tag does.
            wider = [(None, None), (tag, None), (None, hint)] if hint not in ("none", "other") else [(None, None), (None, hint), (tag, None)]
            rows = [[0.9 if a == b else 0.05 for b in STATES] for a in STATES]
            for k in (*wider, key):
                if counts := self.counts.get(k):
                    rows = [[(n + SMOOTH * x) / (sum(have) + SMOOTH) for n, x in zip(have, row)] for have, row in zip(counts, rows)]
            out = self.pairs[key] = rows
        return out

    def evidence(self, node: Node) -> list[float]:
        key = features(node)
        if (out := self.memory.get(key)) is None:
            out = [1.0] * len(STATES)
            for table, value in zip(self.emit, key):
                out = [x * y for x, y in zip(out, table.get(value, (1.0,) * len(STATES)))]
            out = self.memory[key] = _scaled([x**TEMPER for x in out])
        return out

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Probabilities of the states for every node, by messages up and then down the tree."""
        up = [self.evidence(x) for x in nodes]  # evidence at and below the node
        up[0] = _scaled([x * y for x, y in zip(up[0], self.roots)])
        sent: list[list[float]] = [[1.0] * len(STATES)] * len(nodes)  # the message each node sends to its parent
        edges = [None, *map(self.pair, nodes[1:])]
        for i in range(len(nodes) - 1, 0, -1):
            x, y, z = up[i]
            sent[i] = m = _scaled([p * x + q * y + r * z for p, q, r in edges[i]])
            j = nodes[i].parent
            x, y, z = up[j]
            up[j] = _scaled([x * m[0], y * m[1], z * m[2]])
        out = [up[0]]  # the belief at the node, once its parent's message is in
        for i in range(1, len(nodes)):
            above, m, edge = out[nodes[i].parent], sent[i], edges[i]
            x, y, z = above[0] / m[0], above[1] / m[1], above[2] / m[2]
            out.append(_scaled([u * (edge[0][s] * x + edge[1][s] * y + edge[2][s] * z) for s, u in enumerate(up[i])]))
        return out

    def extract(self, html: str | None, threshold: float = 0.5) -> str:
        nodes, blocks = parse(html or "")
        belief = self.marginals(nodes)
        kept = (" ".join((unescape(t) if "&" in t else t).split()) for i, t in blocks if belief[i][MAIN] > threshold * (belief[i][MAIN] + belief[i][OFF]))
        return "\n".join(t for t in kept if t)


def _scaled(values: list[float]) -> list[float]:
    whole = sum(values)
    return [x / whole for x in values]


# --- labelled pages ---------------------------------------------------------------------------------------------------

_SYLLABLES = "an be ca do el fi ga ho in ja ku lo me no or pa qu re si ta un ve wi xe yo za".split()
#: Names of boxes, which tell nothing; of content; of the rest. Some of these share their words with names of the others.
_BOX_NAMES = "wrap wrapper container container-fluid row col-md-8 col-12 column columns grid inner outer site layout single region box center left block page holder area canvas root app group".split()
_MAIN_NAMES = "content article-body post entry-content main story text single-post prose body-copy more-text related-content-body post-meta-text page-content side-story top-story".split()
_DOUBTFUL_NAMES = "review notice teaser legal meta author contact more side alert thread".split()
_OFF_NAMES = {
    "menu": "nav menu navbar main-menu site-nav breadcrumb pagination toolbar share social related tags".split(),
    "ad": "ads advert advertising adslot banner sponsored promo ad-content ad-box-text".split(),
    "notice": "cookie-notice consent notice popup newsletter alert cookie-text subscribe-box login".split(),
    "side": "sidebar widget side rail sidebar-content widget-text related more recommended".split(),
    "talk": "comments comment-list discussion disqus comment-content reply-body".split(),
    "top": "header site-header masthead topbar header-main".split(),
    "foot": "footer site-footer copyright footer-content legal bottom".split(),
}


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> Iterator[str]:
    """Pages in varied layouts, named and unnamed; elements marked with data-main."""
    rng = random.Random(seed)
    pick = lambda *ways: rng.choice(ways)()
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: f"{words(2, 9).capitalize()}{rng.choice(('', '', ', ' + words(2, 6)))}{rng.choice('...?!')}"
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 2, 3, 4, 6, 10))))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    many = lambda tag, say, a=2, b=5: "".join(f"<{tag}>{say()}</{tag}>" for _ in range(rng.randint(a, b)))

    def tagged(state: int, tag: str, inner: str, names: list[str], named: float = 0.7) -> str:
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"' if names and rng.random() < named else ""
        return f'<{tag} data-main="{state}"{name}>{inner}</{tag}>'

    def off(tag: str, inner: str, kind: str, named: float = 1.0) -> str:
        return tagged(OFF, tag, inner, _OFF_NAMES[kind], named)

    def heading() -> str:
        return many(rng.choice(("h2", "h3", "h4", "p")), lambda: words(1, 4), 1, 1)

    def menu() -> str:
        """A list of links that is no element marked by itself."""
        return pick(lambda: "<ul>" + many("li", link, 3, 9) + "</ul>", lambda: "<ul>" + many("li", link, 3, 9) + "</ul>", lambda: " | ".join(link() for _ in range(rng.randint(2, 7))), lambda: many("p", link), lambda: "<table><tr>" + many("td", link) + "</tr></table>")

    def menu_part() -> str:
        return pick(
            lambda: off("nav", menu(), "menu", 0.4), lambda: off("nav", menu(), "menu", 0.4), lambda: off("div", menu(), "menu", 0.6), lambda: off("ul", many("li", link, 3, 9), "menu", 0.4),
            lambda: off("section", heading() + menu(), "menu", 0.5), lambda: off("p", " ".join(link() for _ in range(rng.randint(2, 6))), "menu", 0.2), lambda: off("td", menu(), "menu", 0.2),
        )

    def junk() -> str:
        say = lambda: pick(prose, lambda: words(2, 12), link, lambda: f"<p>{prose()}</p>", lambda: f"<p>{words(2, 9)} {link()}</p><p>{prose()}</p>")
        return pick(
            lambda: off("div", say(), "ad"), lambda: off(rng.choice(("div", "section", "p")), say() + rng.choice(("", "<button>ok</button>")), "notice"),
            lambda: off("aside", pick(menu, prose, lambda: f"<p>{prose()}</p>", lambda: heading() + menu()), "side", 0.5),
            lambda: off(rng.choice(("div", "section")), heading() + pick(menu, lambda: f"<p>{prose()}</p>", lambda: many("li", lambda: words(1, 8)), lambda: f"<div>{prose()}</div>"), "side"),
            lambda: off("form", pick(lambda: f"<p>{words(2, 8)}</p>", heading, lambda: f"<table><tr><td>{words(1, 3)}</td></tr></table>", lambda: f"<fieldset>{words(1, 4)}</fieldset>", str) + f"<label>{words(1, 3)}</label><input name=q>", "notice", 0.5),
            lambda: off("div", pick(link, menu), "menu"), menu_part,
        )

    def talk() -> str:
        each = lambda: pick(
            lambda: f"<p>{prose()}</p>", lambda: f'<div class="comment"><p>{words(1, 3)}</p><p>{prose()}</p></div>', lambda: f"<li><p>{prose()}</p></li>", lambda: f'<article class="comment"><p>{prose()}</p></article>',
            lambda: f"<blockquote>{prose()}</blockquote><p>{prose()}</p>", lambda: f"<div>{prose()}</div>", lambda: f"<h4>{words(1, 2)}</h4><p>{prose()}</p>",
        )
        return off(rng.choice(("section", "div", "div", "ol")), heading() + "".join(each() for _ in range(rng.randint(1, 6))), "talk")

    def main_part() -> list[str]:
        """Tag and inside of a part of the article."""
        return pick(
            *[lambda: ("p", prose())] * 6, lambda: ("p", f"{prose()} {link()} {prose()}"), lambda: ("p", f"{words(2, 8)} <b>{words(1, 4)}</b> {prose()}"), lambda: ("p", words(1, 6) + "."),
            lambda: (rng.choice(("h2", "h3", "h4")), words(2, 6)), lambda: ("blockquote", pick(prose, lambda: f"<p>{prose()}</p>")), lambda: ("pre", words(3, 20)),
            lambda: ("ul", many("li", lambda: words(3, 14))), lambda: ("ol", many("li", prose)), lambda: ("table", "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(rng.randint(2, 4)))),
            lambda: ("dl", many("dt", lambda: words(1, 3), 1, 1) + many("dd", prose, 1, 2)), lambda: ("figure", f"<figcaption>{words(3, 9)}.</figcaption>"), lambda: ("section", f"<h2>{words(2, 5)}</h2>" + many("p", prose, 1, 3)),
            lambda: ("div", prose()), lambda: ("div", many("p", prose, 1, 3)), lambda: (f'div class="{rng.choice(_MAIN_NAMES + _BOX_NAMES + _DOUBTFUL_NAMES)}"', many("p", prose, 1, 3)), lambda: ("header", f"<h1>{words(2, 6)}</h1>"),
        )

    def parts(marked: bool) -> list[str]:
        """The article, its elements marked where no element around them is; now and then something else in between."""
        mark = f' data-main="{MAIN}"' if marked else ""
        out = [f"<h1{mark}>{words(2, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 3, 3, 5, 8, 12))):
            tag, inner = main_part()
            out.append(f"<{tag}{mark}>{inner}</{tag.split()[0]}>")
            if rng.random() < 0.06:
                out.append(junk())
        if rng.random() < 0.12:
            out.append(talk())
        return out

    def boxed(inner: list[str], depth: int) -> list[str]:
        """What stands side by side, in boxes within boxes, with other parts of the page before and after."""
        for _ in range(depth):
            tag = rng.choice(("div", "div", "div", "section", "main", "center", "td"))
            inner = [tagged(BOX, tag, "".join(inner), _BOX_NAMES, 0.6)]
            if tag == "td":
                side = [tagged(OFF, "td", menu(), [])] if rng.random() < 0.6 else []
                inner = [f'<table data-main="{BOX}"><tr>{"".join(side + inner)}</tr></table>']
            if rng.random() < 0.35:
                inner.insert(rng.randint(0, 1), junk())
        return inner

    def top() -> list[str]:
        out = [menu_part()] if rng.random() < 0.75 else []
        if rng.random() < 0.5:
            say = pick(lambda: words(1, 4), heading, lambda: heading() + menu(), lambda: heading() + f"<nav>{link()}{link()}</nav>", lambda: f"<p>{words(2, 8)}</p>", lambda: f"<div>{words(1, 3)}</div>" + menu())
            out.insert(0, pick(lambda: off("header", say, "top", 0.4), lambda: off("div", say, "top")))
        return out

    def low() -> list[str]:
        say = pick(lambda: words(2, 9) + ".", lambda: f"<p>{prose()}</p>", menu, lambda: heading() + menu(), lambda: f"<div>{words(2, 8)}</div>", lambda: f"<table><tr><td>{words(1, 3)}</td></tr></table>", lambda: f"{words(2, 5)}, {prose()}")
        out = [pick(lambda: off("footer", say, "foot", 0.3), lambda: off("footer", say, "foot", 0.3), lambda: off("div", say, "foot"), lambda: tagged(OFF, rng.choice(("p", "div", "address")), f"&copy; {words(1, 4)}", []))] if rng.random() < 0.85 else []
        return [talk(), *out] if rng.random() < 0.3 else out

    for _ in range(n):
        if rng.random() < 0.1:  # a bare page: all of its body is content
            yield f"<html><body data-main={MAIN}>{pick(prose, lambda: words(1, 9))}{''.join(parts(False)[: rng.randint(0, 6)])}</body></html>"
            continue
        core = pick(
            lambda: [tagged(MAIN, "article", "".join(parts(False)), _MAIN_NAMES, 0.4)], lambda: [tagged(MAIN, "article", "".join(parts(False)), _MAIN_NAMES, 0.4)],
            lambda: [tagged(MAIN, rng.choice(("main", "section")), "".join(parts(False)), _MAIN_NAMES + _BOX_NAMES, 0.5)], lambda: [tagged(MAIN, "div", "".join(parts(False)), _MAIN_NAMES, 1.0)],
            lambda: [tagged(MAIN, rng.choice(("div", "div", "td", "section")), "".join(parts(False)), _BOX_NAMES, 0.6)], lambda: parts(True), lambda: parts(True),
        )
        extra = lambda k: [junk() for _ in range(rng.randint(0, k))]
        inside = boxed(core, rng.choice((0, 0, 0, 1, 1, 2, 3)))
        if rng.random() < 0.35:  # all of the page in a box
            body = boxed([*top(), *extra(1), *inside, *extra(2), *low()], 1)
        else:
            body = [*top(), *extra(2), *inside, *extra(2), *low()]
        yield f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(body)}</body></html>"


def train(pages: Iterable[str] | None = None) -> TreeModel:
    return TreeModel(labelled_pages() if pages is None else pages)


def extract_pages(pages: DataFrame, *, model: TreeModel | None = None, threshold: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text and n_chars of the main text."""
    fitted = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [fitted.extract(h.as_py(), threshold) for h in b.column("html")]
            counts = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
