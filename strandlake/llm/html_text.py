"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (leaves: runs of text between block-level tags).  Each block enters a
bidirectional LSTM as the sum of hashed vectors of its tag path (tags, and tags with class and id
words), the mean of hashed vectors of its words (of a block of any length), and a few lengths; the states, which have seen
the whole page, decide for every block whether it is main text.

The labeller is trained in numpy on pages that this module composes itself from common page
parts, so no page of the corpus is needed and the weights are the same on every run.

Defined results: a null or empty page has empty text; text without any tag is one block in no
element; unclosed elements end with their parent or the page, stray end tags are ignored,
comments, scripts, styles, declarations and embedded objects hold no text; a line break inside a block is white
space; repeated pages are read each; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fresh, map_arrow, slices, strings, table

#: Elements that do not end a block, those of formulas among them (fixed values of the public standards).
FORMULA = frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none semantics".split())
INLINE = FORMULA | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and is dropped up to the end tag.
RAW = frozenset("script style textarea".split())
#: Elements whose content is markup, and is dropped; they do not end a block.
DROPPED = frozenset("noscript template svg iframe object select datalist annotation annotation-xml".split())
#: A start tag on the left ends an open element on the right, up to the nearest container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS |= {h: {"p", "h1", "h2", "h3", "h4", "h5", "h6"} for h in ("h1", "h2", "h3", "h4", "h5", "h6")}
ENDS |= {t: {"p"} for t in "div article section main nav aside header footer ul ol dl table form blockquote pre fieldset figure address hr".split()}

#: A tag without quotes, and one whose quotes are closed.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*)>""")
QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"\w+")

PATH_ROWS, WORD_ROWS = 4096, 2048
PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 16, 8, 6, 12
INPUT = PATH_DIM + WORD_DIM + EXTRA
PAGES, STEPS, BATCH = 1400, 420, 24


#: Levels up to which a block's path is a list of its rows; of deeper ones only sums are kept.
SHALLOW = 64


class Level:
    """An open element that ends blocks: its rows and the one around it, which all blocks within share."""

    __slots__ = ("around", "depth", "rows")

    def __init__(self, around: Level | None, rows: tuple[int, ...]):
        self.around, self.rows, self.depth = around, rows, 1 + around.depth if around else 1


def path_rows(level: Level | None) -> tuple[int, ...]:
    """Rows of an element and all around it, the outermost first."""
    found = []
    while level:
        found.append(level.rows)
        level = level.around
    return tuple(r for rows in reversed(found) for r in rows)


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: Level | None, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _row(token: str, rows: int) -> int:
    return zlib.crc32(token.encode()) % rows


@lru_cache(maxsize=4096)
def _element(name: str, attributes: str) -> tuple[int, ...]:
    """Rows of path vectors for one element."""
    out = [_row(name, PATH_ROWS)]
    for kind, *value in ATTRIBUTE.findall(attributes) if attributes else ():
        out += [_row(f"{kind.lower()}={w}", PATH_ROWS) for w in WORD.findall("".join(value).lower().replace("_", " "))]
    return tuple(out)


def tags(html: str, foreign=lambda: False):
    """(text before, is it an end tag, name, attributes) of each tag, in time linear in the page.

    Comments, declarations and what stands in RAW elements come as no tag and no text.  A quote
    may hold a ``>`` as long as all quotes of a page close; from a tag whose quotes do not, every tag
    ends at the next ``>``.  Where ``foreign`` says so, a RAW element may end with its start tag.
    """
    at, n, close, sound, said = 0, len(html), -1, True, 0
    while (i := html.find("<", at)) >= 0:
        kind = html[i + 1 : i + 2]
        if kind == "!" and html.startswith("<!--", i):
            yield html[said:i], False, "", ""
            at = html.find("-->", i + 4)
            said = at = n if at < 0 else at + 3
            continue
        if close < i:
            close = html.find(">", i)
            if close < 0:
                break
        if kind in ("!", "?"):
            yield html[said:i], False, "", ""
            said = at = close + 1
            continue
        m = TAG.match(html, i)
        if not m and (m := NAME.match(html, i)):
            quoted = QUOTED.match(html, i) if sound else None
            sound, m = sound and quoted is not None, quoted or m
        if not m:
            at = i + 1
            continue
        name, attributes = m[2].lower(), m[3] if m.re is not NAME else html[m.end() : close]
        yield html[said:i], bool(m[1]), name, attributes
        said = at = close + 1 if m.re is NAME else m.end()
        if name in RAW and not m[1] and not (attributes.endswith("/") and foreign()):
            low = _RAW_END[name].search(html, at)
            end = html.find(">", low.end()) if low else -1
            yield "", False, "", ""
            said = at = n if end < 0 else end + 1
    yield html[said:], False, "", ""


_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in page order, white space folded and references decoded."""
    if not html:
        return []
    out: list[Block] = []
    stack: list[str] = []
    levels: list[tuple[int, Level | None]] = []  # elements on the stack that end blocks
    places: dict[str, list[int]] = {}  # where on the stack elements of a name are
    parts: list[str] = []
    path: list[Level | None] = [None]
    links, linked = 0, 0
    drop = wall = -1  # where on the stack the outermost dropped element is, and the last level before it

    def push(name: str, rows: tuple[int, ...] = ()) -> None:
        if name not in INLINE:
            around = levels[-1][1] if levels else None
            levels.append((len(stack), Level(around, rows) if rows else around))
        places.setdefault(name, []).append(len(stack))
        stack.append(name)

    def pop(k: int) -> None:
        for name in stack[k:]:
            places[name].pop()
        del stack[k:]
        while levels and levels[-1][0] >= k:
            levels.pop()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path[0], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and drop < 0:
            if not parts:
                path[0] = levels[-1][1] if levels else None
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    for raw, ends, name, attributes in tags(html, lambda: drop >= 0):
        say(raw)
        if not name:
            continue
        if not ends:
            if name in RAW:
                continue
            if name in DROPPED or drop >= 0:
                if name not in VOID and not attributes.endswith("/"):
                    if drop < 0:
                        drop, wall = len(stack), levels[-1][0] if levels else -1
                    push(name)
                continue
            if name in INLINE:
                if name == "br":
                    say(" ")
                elif name == "a":
                    links += 1
                    push(name)
                elif name not in VOID:
                    push(name)
                continue
            flush()
            links = 0
            while levels and stack[levels[-1][0]] in ENDS.get(name, ()):  # what this start tag ends
                pop(levels[-1][0])
            if name not in VOID:
                push(name, _element(name, attributes.rstrip("/")))
        else:
            ended = places[name][-1] if places.get(name) else -1
            if name in INLINE and ended < (wall if drop >= 0 else levels[-1][0] if levels else -1):
                ended = -1  # a stray inline end tag does not close blocks
            if drop >= 0 and not 0 <= ended < drop:  # within a dropped element, or its end
                if ended >= 0:
                    pop(ended)
                    drop = drop if ended > drop else -1
                continue
            if name not in INLINE and name not in DROPPED:
                flush()
                links = 0
            if ended >= 0:
                if name == "a":
                    links = max(0, links - 1)
                pop(ended)
                drop = -1
    flush()
    return out


def block_inputs(page: list[Block]) -> tuple[list[tuple[int, ...] | Level], list[list[int]], np.ndarray]:
    """Path rows, word rows and lengths of each block."""
    extra = np.zeros((len(page), EXTRA), np.float32)
    rows = []
    for k, b in enumerate(page):
        rows.append([_row(x, WORD_ROWS) for x in WORD.findall(b.text.lower())])
        size = len(b.text)
        extra[k] = (1.0, min(np.log1p(size) / 8, 2), b.linked / size, k / max(1, len(page) - 1), size < 40, b.text[-1] in ".!?")
    return [path_rows(b.path) if b.path is None or b.path.depth <= SHALLOW else b.path for b in page], rows, extra


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Weights of the bidirectional LSTM (about 0.4 MB)."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: g.normal(0, scale, shape).astype(np.float32)
        self.path, self.word = draw(PATH_ROWS, PATH_DIM, scale=0.2), draw(WORD_ROWS, WORD_DIM, scale=0.05)
        self.p = {"o": draw(2 * HIDDEN), "q": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: draw(INPUT, 4 * HIDDEN), "U" + d: draw(HIDDEN, 4 * HIDDEN), "c" + d: np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def vectors(self, inputs) -> np.ndarray:
        paths, words, extra = inputs
        out = np.zeros((len(paths), INPUT), np.float32)
        sums: dict[Level, np.ndarray] = {}  # of deep paths: each level adds its rows to the sum around it
        for k, (p, w) in enumerate(zip(paths, words)):
            if isinstance(p, Level):
                new, level = [], p
                while level and level not in sums:
                    new.append(level)
                    level = level.around
                total = sums[level] if level else np.zeros(PATH_DIM, np.float32)
                for level in reversed(new):
                    sums[level] = total = total + self.path[list(level.rows)].sum(axis=0)
                out[k, :PATH_DIM] = total
            elif p:
                out[k, :PATH_DIM] = self.path[list(p)].sum(axis=0)
            if w:
                out[k, PATH_DIM : PATH_DIM + WORD_DIM] = self.word[w].mean(axis=0)
        out[:, PATH_DIM + WORD_DIM :] = extra
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        steps, size = mask.shape
        H, U = HIDDEN, self.p["U" + d]
        xs = x @ self.p["W" + d] + self.p["c" + d]
        h, c = np.zeros((size, H), np.float32), np.zeros((size, H), np.float32)
        out = np.empty((steps, size, H), np.float32)
        for t in range(steps):
            g = xs[t] + h @ U
            ifo = _sigmoid(g[:, : 3 * H])
            i, f, o = ifo[:, :H], ifo[:, H : 2 * H], ifo[:, 2 * H :]
            n = np.tanh(g[:, 3 * H :])
            on = mask[t][:, None]
            c2 = np.where(on, f * c + i * n, c)
            tc = np.tanh(c2)
            h2 = np.where(on, o * tc, h)
            if keep is not None:
                keep.append((h, c, i, f, o, n, tc))
            h, c = h2, c2
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None):
        f = self._run(x, mask, "f", kept and kept["f"])
        b = self._run(x[::-1], mask[::-1], "b", kept and kept["b"])[::-1]
        both = np.concatenate([f, b], axis=2)
        return both, both @ self.p["o"] + self.p["q"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        H = HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        f = self._run(x, mask, "f", kept["f"])
        b = self._run(x[::-1], mask[::-1], "b", kept["b"])[::-1]
        both = np.concatenate([f, b], axis=2)
        p = _sigmoid(both @ self.p["o"] + self.p["q"][0])
        n = mask.sum()
        loss = float(-(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n)
        dl = (p - y) * mask / n
        g = {"o": (both * dl[:, :, None]).sum(axis=(0, 1)), "q": np.array([dl.sum()])}
        dboth = dl[:, :, None] * self.p["o"]
        dx = np.zeros_like(x)
        for d, grad, m, xx in (("f", dboth[:, :, :H], mask, x), ("b", dboth[::-1, :, H:], mask[::-1], x[::-1])):
            U = self.p["U" + d]
            dg = np.zeros((*mask.shape, 4 * H), np.float32)
            dU = np.zeros_like(U)
            dh, dc = np.zeros((mask.shape[1], H), np.float32), np.zeros((mask.shape[1], H), np.float32)
            for t in range(len(m) - 1, -1, -1):
                h, c, i, fg, o, nn, tc = kept[d][t]
                on = m[t][:, None]
                all_h = dh + grad[t]
                act = all_h * on
                dcc = (dc + act * o * (1 - tc * tc)) * on
                dg[t] = np.concatenate([dcc * nn * i * (1 - i), dcc * c * fg * (1 - fg), act * tc * o * (1 - o), dcc * i * (1 - nn * nn)], axis=1)
                dU += h.T @ dg[t]
                dh = dg[t] @ U.T + all_h * ~on
                dc = dcc * fg + dc * ~on
            g["U" + d] = dU
            g["W" + d] = np.tensordot(xx, dg, ([0, 1], [0, 1]))
            g["c" + d] = dg.sum(axis=(0, 1))
            own = dg @ self.p["W" + d].T
            dx += own[::-1] if d == "b" else own
        return loss, g, dx

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        group: list[int] = []
        for k in [*order, None]:
            if group and (k is None or len(group) >= 256 or len(pages[k]) > 2 * len(pages[group[0]]) + 8):
                x, mask = _stack([self.vectors(block_inputs(pages[j])) for j in group])
                logit = self.logits(x, mask)[1]
                for c, j in enumerate(group):
                    out[j] = logit[: len(pages[j]), c] >= 0
                group = []
            if k is not None:
                group.append(k)
        return out


def _stack(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, vectors))
    x = np.zeros((steps, len(vectors), INPUT), np.float32)
    mask = np.zeros((steps, len(vectors)), bool)
    for k, v in enumerate(vectors):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


# -- pages composed for training ------------------------------------------------------------------

#: How pages hold their main text: (open, close).
_MAIN = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>")]
#: Class and id words of main text, alone or joined in pairs.
_BODY = "content post entry article body story text main page blog news detail".split()
_SHORT = [("<nav><ul>", "<li><a href='/x'>{}</a></li>", "</ul></nav>"), ("<nav>", "<a href='/x'>{}</a> ", "</nav>"), ("<header>", "<div>{}</div>", "</header>"), ("<footer>", "{}", "</footer>"), ("<footer>", "<p>{}</p>", "</footer>"), ("<aside>", "<p>{}</p>", "</aside>"), ("<aside>", "<h3>{}</h3>", "</aside>"), ("<form>", "<label>{}</label><input>", "</form>"), ("<form>", "<p>{}</p><button>{}</button>", "</form>")]
#: Class and id words of parts that are not main text.
_BESIDE = """menu nav navbar navigation header footer sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent
notice notification alert popup modal newsletter subscribe share social related recommended comments comment reply replies discussion respond
breadcrumb breadcrumbs pagination toolbar topbar widget login search copyright legal disclaimer masthead responses thread reviews
feedback subnav submenu byline meta tags authorbox sharing adsense sponsorship""".split()
#: Roles of parts that are not main text (fixed values of the public standard).
_ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()
#: Those of readers' comments, whose text is most like an article's.
_READERS = "comments comment reply replies discussion respond responses".split()
#: Names of elements that hold whole pages or columns; they say nothing of what is in them.
_SITE = "wrapper wrap container page site outer layout row col column grid inner app root".split()
_SAID = """home about contact login subscribe newsletter cookies accept copyright privacy terms share comments reply search menu next previous
advertisement sponsored rights reserved sign up follow us related""".split()
_SYLLABLES = "an be ci da en fo ga he in ju ka lo me no or pa qu re st ti un ve wo xi yo zu er ion ing".split()


def compose(g: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is main text."""
    any_of = lambda x: x[int(g.integers(len(x)))]
    word = lambda: "".join(any_of(_SYLLABLES) for _ in range(int(g.integers(1, 5))))

    def prose(lo: int, hi: int, stop: float = 0.9) -> str:
        return " ".join(word() for _ in range(int(g.integers(lo, hi)))).capitalize() + ("." if g.random() < stop else "")

    def named(words: list[str]) -> str:
        return any_of(words) if g.random() < 0.5 else any_of(["{}-{}", "{}_{}", "{} {}", "{}__{}"]).format(any_of(words), any_of(words))

    out, want = ["<!DOCTYPE html><html><head>"], []

    def put(html: str, main: bool) -> None:
        n = len(blocks(f"<div>{html}</div>"))
        out.append(html)
        want.extend([main] * n)

    if g.random() < 0.9:
        put(f"<title>{prose(2, 9, 0.4)}</title>", False)
    out.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")

    def beside() -> None:
        say = lambda: " ".join([prose(1, 5, 0.2), *([any_of(_SAID)] if g.random() < 0.5 else [])])
        notice = lambda: " ".join(f"{prose(6, 25, 0.5)} {any_of(_SAID)}" for _ in range(int(g.integers(5, 16))))
        if g.random() < 0.45:
            a, each, z = any_of(_SHORT)
        else:
            tag = any_of(["div", "div", "section", "aside", "ul", "table"])
            kind = any_of(_BESIDE if g.random() < 0.75 else _READERS)
            if g.random() < 0.5:  # a part is what its class says last, whatever it is a part of
                kind = any_of(["{}-{}", "{}-{}", "{}_{}", "{}__{}"]).format(any_of(_BODY if g.random() < 0.7 else _SITE), kind)
            kind += any_of(["", "", "-box", "-wrap", " block", "-list", "-section"])
            each = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag) or any_of(["{} ", "<p>{}</p>", "<p>{}</p>", "<a href='/y'>{}</a> ", "<div>{}</div>", "<h3>{}</h3>", "<p><b>{}</b></p>", "<ul><li>{}</li></ul>", "<div class='item'><p>{}</p></div>", "<article><p>{}</p></article>"])
            a, z = f'<{tag} {any_of(["class", "class", "id"])}="{kind}">', f"</{tag}>"
            if g.random() < 0.15:
                a = f'<{tag} role="{any_of(_ROLES)}">'
        long, lengthy = g.random() < 0.4, g.random() < 0.1
        rows = int(g.integers(1, 8)) if not long else int(g.integers(1, 5))
        put(a + "".join(each.format(*([notice() if lengthy else prose(5, 40) if long else say()] * 2)) for _ in range(rows)) + z, False)

    around = [f'<div {any_of(["class", "id"])}="{any_of(_SITE)}{any_of(["", "", "-inner"])}">' for _ in range(int(g.integers(0, 3)))] if g.random() < 0.4 else []
    out += around
    for _ in range(int(g.integers(0, 5))):
        beside()
    if g.random() < 0.5:
        a, z = any_of(_MAIN) if g.random() < 0.6 else _MAIN[0]
    else:
        tag = any_of(["div", "div", "section", "article"])
        a, z = f'<{tag} {any_of(["class", "class", "id"])}="{named(_BODY)}">', f"</{tag}>"
    if g.random() < 0.2:
        a, z = a + f'<div class="{any_of([*_SITE, *_BODY])}">', "</div>" + z
    if g.random() < 0.1:
        a, z = '<div role="main">', "</div>"
    out.append(a)
    if g.random() < 0.85:
        put(f"<h1>{prose(1, 12, 0.5)}</h1>", True)
    cell = lambda: str(int(g.integers(0, 5000))) if g.random() < 0.4 else prose(1, 4, 0.1)
    plain = g.random() < 0.12  # pages whose paragraphs are div elements
    for _ in range(int(g.integers(1, 16)) if g.random() < 0.95 else int(g.integers(30, 80))):
        kind = g.random()
        text = prose(60, 300) if g.random() < 0.1 else prose(1, 60) if g.random() < 0.8 else prose(1, 4)
        if g.random() < 0.02:  # articles use the words of notices too
            text = f"{prose(1, 4, 0)} {any_of(_SAID)} {any_of(_SAID)}." if g.random() < 0.5 else f"{any_of(_SAID)} {any_of(_SAID)}.".capitalize()
        if kind < 0.56:
            put(f"<div>{text}</div>" if plain else f"<p>{text}</p>" if g.random() < 0.8 else f"<p>{text}", True)
        elif kind < 0.64:
            put(f"<p><b>{text}<br>", True)
        elif kind < 0.70:
            put(f"<{(h := any_of(['h2', 'h2', 'h3', 'h4']))}>{prose(1, 6, 0.2)}</{h}>", True)
        elif kind < 0.78:
            tag = any_of(["ul", "ol"])
            put(f"<{tag}>" + "".join(f"<li>{prose(2, 40 if g.random() < 0.3 else 12)}</li>" for _ in range(int(g.integers(1, 7)))) + f"</{tag}>", True)
        elif kind < 0.82:
            put(f"<blockquote>{text}</blockquote>" if g.random() < 0.6 else f"<blockquote><p>{text}</p></blockquote>", True)
        elif kind < 0.86:
            put(f"<p>{prose(1, 8, 0)} <a href='/z'>{prose(1, 3, 0)}</a> {text}</p>", True)
        elif kind < 0.91:
            wide = int(g.integers(1, 5))
            head = "<tr>" + "".join(f"<th>{prose(1, 3, 0)}</th>" for _ in range(wide)) + "</tr>" if g.random() < 0.6 else ""
            put("<table>" + head + "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(wide)) + "</tr>" for _ in range(int(g.integers(1, 6)))) + "</table>", True)
        elif kind < 0.95:
            a_div = any_of(["", "", f' class="{any_of(["row", "col", "paragraph", "section", "inner", "lead", "intro", "note"])}"'])
            put(f"<div{a_div}>{text}</div>" if g.random() < 0.5 else f"<div{a_div}><p>{text}</p><p>{prose(1, 40)}</p></div>", True)
        elif kind < 0.97:
            put("<dl>" + "".join(f"<dt>{prose(1, 3, 0)}</dt><dd>{prose(1, 15)}</dd>" for _ in range(int(g.integers(1, 5)))) + "</dl>", True)
        elif kind < 0.985:
            put(f"<pre>{text}</pre>", True)
        else:
            put(f"<figure><img src='/i'><figcaption>{prose(2, 12)}</figcaption></figure>", True)
        if g.random() < 0.04:
            out.append("<!-- -->")
            beside()
    if g.random() < 0.2:  # readers' comments and the like at the end of the article itself, or next to it
        if z.startswith("</article></"):
            out.append("</article>")
            z = z.removeprefix("</article>")
        beside()
    out.append(z)
    for _ in range(int(g.integers(0, 5))):
        beside()
    out += ["</div>"] * len(around)
    if g.random() < 0.8:
        out.append("</body></html>")
    html = "".join(out)
    return (html, want) if len(blocks(html)) == len(want) else compose(g)


@lru_cache(maxsize=2)
def trained(seed: int = 11) -> Labeller:
    """The labeller after training on composed pages."""
    net, g = Labeller(seed), np.random.default_rng(seed)
    pages = [compose(g) for _ in range(PAGES)]
    inputs = [block_inputs(blocks(h)) for h, _ in pages]
    size = np.array([len(y) for _, y in pages])
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    speed = {"path": np.full(PATH_ROWS, 1e-6, np.float32), "word": np.full(WORD_ROWS, 1e-6, np.float32)}
    for step in range(1, STEPS + 1):
        pick = g.choice(PAGES, 3 * BATCH, replace=False)
        pick = pick[np.argsort(size[pick])][int(g.integers(0, 3)) :: 3]
        x, mask = _stack([net.vectors(inputs[i]) for i in pick])
        y = np.zeros(mask.shape, np.float32)
        for c, i in enumerate(pick):
            y[: size[i], c] = pages[i][1]
        _, grads, dx = net.gradients(x, mask, y)
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, v in grads.items():
            m, s = state[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        for name, part, which, mean in (("path", slice(0, PATH_DIM), 0, False), ("word", slice(PATH_DIM, PATH_DIM + WORD_DIM), 1, True)):
            weights = getattr(net, name)
            total = np.zeros_like(weights)
            for c, i in enumerate(pick):
                for t, rows in enumerate(inputs[i][which]):
                    if rows:
                        np.add.at(total, list(rows), dx[t, c, part] / (len(rows) if mean else 1))
            row = np.flatnonzero(total.any(axis=1))
            speed[name][row] += (total[row] ** 2).mean(axis=1)
            weights[row] -= 0.05 * total[row] / np.sqrt(speed[name][row])[:, None]
    return net


def main_text(page: list[Block], main: np.ndarray) -> str:
    return "\n".join(b.text for b, keep in zip(page, main) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """``pages`` without ``html`` but with ``out``, the main text; rows stand alone, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())
    rest = [c for c in pages.columns if c not in (html, out)]
    raw = fresh("html", rest)
    src = pages.select(*[pages[c] for c in rest], pages[html].alias(raw))
    schema = src.select(*rest).schema.add(out, "string")

    def run(batches):
        net = shared.value
        for whole in batches:
            for batch in slices(whole, raw, 4_000_000):
                cut = [blocks(h) for h in strings(batch.column(len(rest)))]
                text = [main_text(p, m) for p, m in zip(cut, net.label(cut))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(text, pa.string())], names=[*rest, out])

    return map_arrow(src, run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
