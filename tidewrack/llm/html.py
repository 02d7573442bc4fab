"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text within the same innermost block element, in page order. Each has
the tags, classes, ids and roles of its ancestors and the shape of its text as features. A chain over the
blocks labels each as content or not; it is trained by gradient ascent on labelled pages and decoded by Viterbi.

The labelled pages are made here: many layouts of made-up words, in which every block's label is known by
construction. They stand in for a hand-labelled set; ``train`` takes any other.

Character references are decoded, white space inside a block becomes one space, a line break counts as white
space. Scripts, styles and embedded things are no blocks. Null, empty and text-less pages give an empty text.
Repeated rows are extracted each; other columns are not read.

Any page is read in time linear in its length, at any length, malformed ones as follows. Elements left open end with
their parent, stray end tags are passed over. ``/>`` closes drawings and formulas, as in HTML, and is else passed
over. Raw text whose end tag is missing has no content, but a script or style goes to the page's end. A ``<`` that
opens no tag is text; where a quoted value or a tag never ends, quotes count as other characters and the tag's start as
text from there on.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches

#: Elements by how the HTML standard treats them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul caption head title button select".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and of these those that run to the page's end without one.
RAW = frozenset("script style iframe noembed noframes textarea xmp".split())
ENDLESS = frozenset("script style".split())
#: Elements whose content is read as others' is, but isn't shown; ``/>`` closes the foreign ones.
HIDDEN = frozenset("noscript template object canvas audio video svg math".split())
FOREIGN = frozenset("svg math".split())
#: Elements whose start ends an open paragraph, and elements that end an open one of their own kind.
ENDS_P = BLOCKS - frozenset("html head body title button select option optgroup caption tbody td tfoot th thead tr dd dt li legend summary".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = frozenset("ul ol dl table td th body div article section select foreignobject".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag up to its end: a value may be quoted after an equals sign, elsewhere quotes mean nothing.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Place:
    """Where a block stands: the tags of the blocks around it, the innermost tag, the two innermost blocks, how deep, and what they are named after."""

    inside: frozenset[str] = frozenset()
    leaf: str = ""
    last: tuple[str, ...] = ()
    depth: int = 0
    groups: frozenset[str] = frozenset()

    def within(self, tag: str, groups: frozenset[str]) -> Place:
        groups = groups if groups <= self.groups else self.groups | groups
        if groups <= self.groups:
            groups = self.groups
        if tag not in BLOCKS:
            return Place(self.inside, tag, self.last, self.depth, groups)
        return Place(self.inside if tag in self.inside else self.inside | {tag}, tag, (*self.last[-1:], tag), min(8, self.depth + 1), groups)


@dataclass
class Block:
    """A leaf block: its text, its place, and the length of link text."""

    text: str
    place: Place
    linked: int = 0


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, the rest) of the tags; comments and such have no name."""
    at, last, quotes = 0, page.rfind(">"), True
    raw_end: dict[str, bool] = {}
    while (a := page.find("<", at)) >= 0:
        c = page[a + 1 : a + 2]
        if page.startswith("<!--", a):
            end = page.find("-->", a + 2)
            at = end + 3 if end >= 0 else len(page)
            yield a, at, False, "", ""
            continue
        if c in ("!", "?"):
            end = page.find(">", a)
            at = end + 1 if end >= 0 else len(page)
            yield a, at, False, "", ""
            continue
        closing = c == "/"
        m = NAME.match(page, a + 1 + closing) if a < last else None
        if not m:
            at = a + 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if not rest:
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                at = a + 1
                continue
            end += 1
        else:
            end = rest.end()
        tag, attributes = m[0].lower(), page[m.end() : end - 1]
        yield a, end, closing, tag, attributes
        at = end
        if not closing and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, end) if raw_end.get(tag, True) else None
            raw_end[tag] = bool(close)
            if close:
                at = close.start()
            elif tag in ENDLESS:
                at = len(page)
            if at > end:
                yield end, at, False, "", ""


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = hidden = 0
    page, at = page or "", 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else Place(), min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links, hidden
        if any(t in BLOCKS for t, _ in stack[upto:]):
            flush()
        for t, _ in stack[upto:]:
            opened[t] -= 1
            links -= t == "a"
            hidden -= t in HIDDEN
        del stack[upto:]

    def shown(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text.strip())

    for start, end, closing, tag, attributes in tags_of(page):
        shown(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS and tag not in HIDDEN:
                    break  # an inline end tag doesn't end a block
            continue
        if tag in RAW or tag == "br":
            shown(" ")
            continue
        if tag in BLOCKS and tag != "title" and any(opened[t] for t in FOREIGN) and not opened["foreignobject"]:
            close(next(k for k, (t, _) in enumerate(stack) if t in FOREIGN))  # a block doesn't stand in a drawing
        if tag in BLOCKS:
            if not hidden:
                flush()
            own = ENDS_OWN.get(tag, ())
            if tag in ENDS_P and opened["p"] or any(opened[t] for t in own):
                for k in range(len(stack) - 1, -1, -1):
                    if tag in ENDS_P and stack[k][0] == "p" or stack[k][0] in own:
                        close(k)
                        break
                    if stack[k][0] in STOPS:
                        break
        if tag in VOID or tag in FOREIGN and attributes.endswith("/"):
            continue
        if tag in HIDDEN:
            shown(" ")
        groups = frozenset(GROUP[w] for x in ATTRIBUTE.finditer(attributes) for w in map(str.lower, WORDS.findall(x[2] or x[3] or x[4] or "")) if w in GROUP)
        stack.append((tag, (stack[-1][1] if stack else Place()).within(tag, groups)))
        opened[tag] += 1
        links += tag == "a"
        hidden += tag in HIDDEN
    shown(page[at:])
    flush()
    return out


#: Attribute words by what they name; fixed values. Words outside are features by themselves only in training data.
NAMED = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs toc sitemap",
    "top": "header masthead banner topbar logo branding",
    "bottom": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular more",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted banner",
    "form": "form search login signup subscribe newsletter subscription",
    "comment": "comment comments reply replies respond discussion disqus reader readers response responses feedback",
    "share": "share social follow tags tag meta byline author date",
    "content": "content article post entry story main body text page",
}
GROUP = {w: k for k, ws in NAMED.items() for w in ws.split()}
LABELS, DIMS = 2, 1 << 12


def _slot(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % DIMS


@functools.lru_cache(maxsize=100_000)
def _place_features(place: Place) -> tuple[int, ...]:
    out = {f"in:{t}" for t in place.inside} | {f"leaf:{place.leaf}", f"leaf2:{'/'.join(place.last)}", f"depth:{place.depth}"}
    out |= {f"named:{g}" for g in place.groups}
    return tuple(_slot(x) for x in sorted(out))


@functools.cache
def _shape_slot(kind: str, value: int) -> int:
    return _slot(f"{kind}:{value}")


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Slots of the active features of each block."""
    out, longest = [], max((len(b.text) for b in blocks), default=1)
    for i, b in enumerate(blocks):
        t = b.text
        n = len(t)
        spaces = t.count(" ")
        shape = (
            ("len", min(12, n.bit_length())),
            ("links", 4 * b.linked // n),
            ("stops", min(4, t.count(". ") + t.count("! ") + t.count("? "))),
            ("ends", ".!?:;".find(t[-1])),
            ("commas", min(3, t.count(","))),
            ("words", min(8, (spaces + 1).bit_length())),
            ("starts", t[0].isupper() + 2 * t[0].isdigit() + 4 * (t[0] in "\xa9|»<>")),
            ("digits", min(3, 8 * sum(map(t.count, "0123456789")) // n)),
            ("share", 4 * n // longest),
            ("first", i == 0),
            ("last", i == len(blocks) - 1),
        )
        out.append([*_place_features(b.place), *(_shape_slot(k, int(v)) for k, v in shape)])
    return out


@dataclass
class ChainModel:
    """Weights of a chain with two labels: 1 is content."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, LABELS)))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(LABELS))

    def viterbi(self, slots: list[list[int]]) -> list[int]:
        """The likeliest labels; ties go to 0."""
        if not slots:
            return []
        lens = [len(s) for s in slots]
        flat = self.emission[np.fromiter((x for s in slots for x in s), np.int64, sum(lens))]
        scores = np.add.reduceat(flat, np.cumsum([0, *lens[:-1]]), axis=0).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for e0, e1 in scores[1:]:
            f0, f1 = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((0 if f0 else 1, 0 if f1 else 1))
            a, b = (a + t00 if f0 else b + t10) + e0, (a + t01 if f1 else b + t11) + e1
        labels = [0 if a >= b else 1]
        for f in reversed(back):
            labels.append(f[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> ChainModel:
    """``pages``: (html, labels of its leaf blocks). Full-batch Adam on the regularised conditional likelihood."""
    data = [(block_features(leaf_blocks(p)), y) for p, y in pages]
    data = [(x, y) for x, y in data if x]
    n, length, width = len(data), max(len(x) for x, _ in data), max(len(s) for x, _ in data for s in x)
    slots = np.full((n, length, width), DIMS, np.int64)
    truth, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (x, y) in enumerate(data):
        for j, s in enumerate(x):
            slots[i, j, : len(s)] = s
        truth[i, : len(y)], mask[i, : len(y)] = y, True
    theta = np.zeros((DIMS + 1) * LABELS + LABELS * LABELS + LABELS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.eye(LABELS)[truth] * mask[..., None]
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w = theta[: (DIMS + 1) * LABELS].reshape(-1, LABELS)
        trans, start = theta[-LABELS * LABELS - LABELS : -LABELS].reshape(LABELS, LABELS), theta[-LABELS:]
        e = w[slots].sum(axis=2)
        alpha, beta = np.zeros((n, length, LABELS)), np.zeros((n, length, LABELS))
        alpha[:, 0] = e[:, 0] + start
        for j in range(1, length):
            nxt = np.logaddexp.reduce(alpha[:, j - 1, :, None] + trans, axis=1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], nxt, alpha[:, j - 1])
        for j in range(length - 2, -1, -1):
            nxt = np.logaddexp.reduce(trans + (e[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(mask[:, j + 1, None], nxt, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        diff = gold - marginal
        g_w = np.zeros_like(w)
        for k in range(LABELS):
            g_w[:, k] = np.bincount(slots.ravel(), np.repeat(diff[:, :, k].ravel(), width), DIMS + 1)
        g_w[DIMS] = 0
        both = mask[:, 1:] & mask[:, :-1]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        g_t = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1))
        g_s = diff[rows, 0].sum(0)
        g = np.concatenate([g_w.ravel(), g_t.ravel(), g_s]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w = theta[: DIMS * LABELS].reshape(-1, LABELS)
    return ChainModel(w.copy(), theta[-LABELS * LABELS - LABELS : -LABELS].reshape(LABELS, LABELS).copy(), theta[-LABELS:].copy())


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Made-up pages of many layouts with the labels of their leaf blocks."""
    r = Random(seed)
    syllables = "ba ten or li mu sha per est on da vier lo gra ni que tra sol".split()

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def sentence(low: int = 1, high: int = 18) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + r.choice(".....!?")

    def prose() -> str:
        t = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))
        if r.random() < 0.2:
            t = " ".join(w + r.choice(["&amp;&amp;", "***", "%%%", "$$$", "!!", " |"]) for w in t.split())
        if r.random() < 0.15:
            t = f'<a href="/{word()}">{word()}</a> {t}'
        return t

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (word() for _ in range(k)))

    def few() -> str:
        return r.choice([" ".join(word() for _ in range(r.randint(1, 6))), sentence(), sentence() + " " + sentence(), prose()])

    pages = []
    for i in range(n):
        out: list[str] = []
        labels: list[int] = []

        def add(text: str, label: int = 0, blocks: int = 1) -> None:
            out.append(text)
            labels.extend([label] * blocks)

        def boiler() -> None:
            kind = r.randrange(9)
            if kind == 0:
                k = r.randint(3, 8)
                add(r.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>', '<div role="navigation"><ul>{}</ul></div>']).format(links(k)), 0, k)
            elif kind == 1:
                c = r.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-banner"])
                add(f'<div class="{c}">{r.choice(["", "<p>"])}{few()}</div>')
            elif kind == 2:
                c = r.choice(['aside', 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="widget"'])
                add(f"<{c}><h3>{word()}</h3><p>{few()}</p></{c.split()[0]}>", 0, 2)
            elif kind == 3:
                c = r.choice(["cookie-notice", "consent", "notice", "alert", "cookie", "popup", "siteNotice", "cookieBanner"])
                add(f'<div class="{c}"><p>{few()}</p><button>{word()}</button></div>', 0, 2)
            elif kind == 4:
                c = r.choice(["", ' class="newsletter"', ' id="search"', ' class="subscribe"'])
                add(f'<form{c} action="/x"><label>{few()}</label><input name="q"><button>{word()}</button></form>', 0, 2)
            elif kind == 5:
                c = r.choice(['div class="comments"', 'section id="comments"', 'div class="reader-comments"', 'ol class="replies"'])
                k = r.randint(1, 4)
                item = r.choice(["<p>{}</p>", '<div class="comment">{}</div>', "<li>{}</li>", "<article class=\"comment\"><p>{}</p></article>"])
                add(f"<{c}><h2>{word()}</h2>" + "".join(item.format(prose()) for _ in range(k)) + f"</{c.split()[0]}>", 0, k + 1)
            elif kind == 6:
                c = r.choice(["footer", 'div class="footer"', 'div id="footer"', 'div class="legal"'])
                add(f"<{c}>{r.choice(['&copy; ', '', '<p>'])}{word()}.example &middot; {few()}</{c.split()[0]}>")
            elif kind == 7:
                c = r.choice(["header", 'div class="header"', 'div id="masthead"', 'div role="banner"'])
                add(f'<{c}><a href="/">{word()}</a> {few()}</{c.split()[0]}>')
            else:
                c = r.choice(["share", "social", "breadcrumbs", "tags", "byline", "pagination"])
                add(f'<div class="{c}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>')

        def article() -> None:
            open_, close_ = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><article>', "</article></div>"), ('<div class="post entry">', "</div>"), ('<main><div class="article-body">', "</div></main>"), ('<article class="post">', "</article>"), ("", ""), ("", ""), ('<div class="wrap"><div class="post-body">', "</div></div>"), ('<table><tr><td class="content">', "</td></tr></table>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><div>", "</div></div>")])
            out.append(open_)
            if r.random() < 0.85:
                add(f"<h1>{r.choice([sentence(2, 10), ' '.join(word() for _ in range(6))])}</h1>", 1)
            for _ in range(r.randint(1, 14)):
                x = r.random()
                if x < 0.72:
                    add(f"<p>{prose()}" + r.choice(["</p>", "</p>", ""]), 1)
                elif x < 0.82:
                    add(f"<p><b>{sentence()}<br>", 1)
                elif x < 0.88:
                    h = r.choice(["h2", "h2", "h3", "h4"])
                    add(f"<{h}>{' '.join(word() for _ in range(r.randint(1, 6)))}</{h}>", 1)
                elif x < 0.92:
                    k = r.randint(1, 4)
                    add("<ul>" + "".join(f"<li>{few()}</li>" for _ in range(k)) + "</ul>", 1, k)
                elif x < 0.95:
                    add(f"<blockquote>{r.choice(['<p>', ''])}{prose()}</blockquote>", 1)
                elif x < 0.96:
                    add(f"<pre>{sentence()}</pre>", 1)
                elif x < 0.97:
                    k = r.randint(1, 4)
                    add("<table>" + "".join(f"<tr><th>{word()}</th><td>{few()}</td></tr>" for _ in range(k)) + "</table>", 1, 2 * k)
                elif x < 0.98:
                    k = r.randint(1, 4)
                    c = r.choice(['aside class="related"', "aside", 'div class="related-stories"', 'section class="more"'])
                    add(f"<{c}><h4>{word()} {word()}</h4><ul>{links(k)}</ul></{c.split()[0]}>", 0, k + 1)
                elif x < 0.985:
                    c = r.choice(["p", "div"])
                    add(f'<{c} class="{r.choice(["byline", "post-meta", "date", "author"])}">{word()} <a href="/">{word()} {word()}</a></{c}>', 0)
                else:
                    add(f'<div class="{r.choice(["ad", "promo", "share", "newsletter", "related"])}">{few()}</div>')
            out.append(close_)

        add(f"<html><head><title>{few()}</title><script>var t='</p>';</script><style>p{{}}</style></head><body>")
        for _ in range(r.randint(0, 4)):
            boiler()
        article()
        for _ in range(r.randint(0, 4)):
            boiler()
        if r.random() < 0.9:
            out.append("</body></html>")
        pages.append(("".join(out), labels))
    return pages


@functools.cache
def model() -> ChainModel:
    return train([(p, y) for p, y in labelled_pages() if len(leaf_blocks(p)) == len(y)])


def main_text(page: str | None, chain: ChainModel) -> str:
    blocks = leaf_blocks(page)
    labels = chain.viterbi(block_features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, chain: ChainModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    bound_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(chain or model())  # DIMS x 2 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t, held.value) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
