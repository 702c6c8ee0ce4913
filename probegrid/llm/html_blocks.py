"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags. Each
block becomes a vector: hashed tags, classes and ids of its path, hashed words,
and a few measures (length, share of link text, punctuation, place). A
bidirectional LSTM in numpy reads the page's blocks in order, so that each is
labelled in the light of the whole page, and the text blocks are joined.

The network is fitted by gradient descent on pages made here from a seed, with
many layouts, so no labelled page is needed and every driver gets the same one.

Scale: a page is handled where it is read. Pages of similar length are stepped
through together; nothing is shuffled.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, HIDDEN = 192, 32, 24
PAGES, EPOCHS = 600, 16
THRESHOLD = 0.5
#: Blocks of a page that the network reads at a time; the next ones go on from its state.
SPAN = 4096

#: A quote without its second one is an ordinary character. Nothing is matched in two ways, so the time is linear.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?=[!?])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"(?:[^\"]*+\")?+|'(?:[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: tags of HTML by how they are laid out
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe "
    "label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_SILENT = frozenset("script style noscript template svg math head title iframe object textarea select".split())
_RAW = frozenset("script style textarea title".split())
#: What can stand in head; anything else there, text too, ends a head that was left open.
_IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
#: Silent elements that hold their own kind; the others are over when the next of the name opens.
_NESTS = frozenset("object svg math template".split())
#: Block tags that do not end a silent element without an end tag.
_STANDS_IN = {"select": {"option", "legend", "hr"}, "svg": {"title"}, "math": {"title"}}
#: An opening tag closes an open one of its group, up to the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Path:
    """An open element with its hashed names, and the one around it: blocks share what they have in common."""

    __slots__ = ("parent", "names")

    def __init__(self, parent: "Path | None", names: tuple[str, ...]):
        self.parent, self.names = parent, names

    def inner(self, n: int) -> list[str]:
        """The last ``n`` names."""
        out: list[str] = []
        at: Path | None = self
        while at is not None and len(out) < n:
            out = [*at.names[max(0, len(at.names) - n + len(out)):], *out]
            at = at.parent
        return out


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | None, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _opens(m: re.Match) -> bool:
    return not m[1] and m[2].lower() not in _VOID and not m[0].endswith("/>")


def _tags(page: str) -> list[tuple[re.Match, int]]:
    """Tags and comments of a page, each with the place to go on from: behind its end tag for a raw element."""
    out, m = [], _TAG.search(page)
    while m:
        at = m.end()
        if m[2] and m[2].lower() in _RAW and _opens(m):
            # nothing inside is markup but its own end
            end = re.compile(rf"</{m[2]}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        out.append((m, at))
        m = _TAG.search(page, at)
    return out


def _unended(tags: list[tuple[re.Match, int]]) -> set[int]:
    """Where silent elements start that have no end tag of their own (head and raw elements apart)."""
    waiting: dict[str, list[int]] = {}
    out: set[int] = set()
    for m, _ in tags:
        name = (m[2] or "").lower()
        if name not in _SILENT or name in _RAW or name == "head":
            continue
        starts = waiting.setdefault(name, [])
        if m[1]:
            if starts:
                starts.pop()
        elif _opens(m):
            if name not in _NESTS:
                out.update(starts)
                starts.clear()
            starts.append(m.start())
    return out.union(*waiting.values())


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, with decoded text; silent elements and comments give none.

    An open head ends where something starts that cannot stand in it. A silent
    element without an end tag ends at the next block tag or with its parent.
    """
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}  # places on the stack by name
    walls: list[int] = []  # places of block elements
    parts: list[str] = []
    open_ended: list[int] = []  # places of silent elements without an end tag
    linked, links, silent, at = 0, 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else None, text, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links, silent
        for name, _ in stack[k:]:
            links -= name == "a"
            silent -= name in _SILENT
            places[name].pop()
        del stack[k:]
        for of in (walls, open_ended):
            while of and of[-1] >= k:
                of.pop()

    def wall() -> int:
        """Place of the innermost block element that an inline end tag does not reach beyond."""
        for k in reversed(walls):
            n = bisect_left(open_ended, k)
            if n == len(open_ended) or open_ended[n] != k:
                return k
        return -1

    tags = _tags(page)
    unended = _unended(tags)
    for m, following in [*tags, (None, len(page))]:
        text = page[at:m.start() if m else len(page)]
        if silent and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if not silent:
            if text:
                parts.append(text)
                linked += len(text) if links else 0
        if not m:
            break
        at = following
        name = (m[2] or "").lower()
        if name:
            if name in _BLOCK:
                for k in open_ended:
                    if name not in _STANDS_IN.get(stack[k][0], ()):
                        close(k)
                        break
            if not m[1]:
                if name == "body":
                    close(next(iter(places.get("head", ())), len(stack)))
                elif stack and stack[-1][0] == "head" and name not in _IN_HEAD:
                    close(len(stack) - 1)
            if name in _BLOCK or name in _SILENT:
                end_block()
            if m[1]:
                # an inline end tag does not close the block around it
                if places.get(name) and (name in _BLOCK or places[name][-1] > wall()):
                    close(places[name][-1])
            elif name not in _VOID and not m[0].endswith("/>"):
                group = _CLOSES.get(name, {"p"} if name in _BLOCK else ())
                for k in reversed(walls) if group else ():
                    if stack[k][0] in group:
                        close(k)
                        break
                    if stack[k][0] in _HOLDS.get(name, ()) or stack[k][0] not in ("p", "li", "dd", "dt", "td", "th"):
                        break
                names = [name]
                for a in _ATTRIBUTE.finditer(m[3] or ""):
                    names += [f"{a[1].lower()}={w}" for w in re.findall(r"[a-z]+", (a[2] or a[3] or a[4] or "").lower())]
                places.setdefault(name, []).append(len(stack))
                if name in _BLOCK:
                    walls.append(len(stack))
                stack.append((name, Path(stack[-1][1] if stack else None, tuple(names))))
                links += name == "a"
                silent += name in _SILENT
                if m.start() in unended:
                    open_ended.append(len(stack) - 1)
                if name in _RAW:
                    close(len(stack) - 1)
    end_block()
    return out


# --- features --------------------------------------------------------------------

def _bucket(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % size, 1.0 if h & 0x80000000 else -1.0


def features(page: list[Block], memo: dict[str, tuple[int, float]]) -> np.ndarray:
    """A row per block: hashed path (the inner part counts more), hashed words, measures."""
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + 10), dtype=np.float32)
    whole: dict[int, np.ndarray] = {}

    def bucket(name: str) -> tuple[int, float]:
        key = "/" + name
        return memo.get(key) or memo.setdefault(key, _bucket(key, PATH_DIM))

    def summed(path: Path) -> np.ndarray:
        """All names of a path, each ancestor's sum taken once."""
        chain = []
        at: Path | None = path
        while at is not None and id(at) not in whole:
            chain.append(at)
            at = at.parent
        total = whole[id(at)] if at is not None else np.zeros(PATH_DIM, dtype=np.float32)
        for one in reversed(chain):
            total = total.copy()
            for name in one.names:
                k, sign = bucket(name)
                total[k] += sign
            whole[id(one)] = total
        return total

    for i, b in enumerate(page):
        if b.path is not None:
            x[i, :PATH_DIM] = summed(b.path) * np.float32(0.7)
            for name in b.path.inner(6):
                k, sign = bucket(name)
                x[i, k] += sign * 0.3
        words = b.text.lower().split()
        for w in words:
            at = memo.get(w) or memo.setdefault(w, _bucket(w, WORD_DIM))
            x[i, PATH_DIM + at[0]] += at[1]
        size = len(b.text)
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] *= 0.4 / max(1.0, len(words)) ** 0.5
        x[i, -10:] = (
            np.log1p(size) / 5, np.log1p(len(words)) / 3, min(1.0, b.linked / size), sum(b.text.count(c) for c in ".!?") / (1 + len(words)) * 5, float(b.text[-1] in ".!?:"),
            i / len(page), 1 / (1 + i), 1 / (len(page) - i), sum(c.isdigit() for c in b.text) / size, float(b.text[0].isupper()),
        )
    return x


# --- the network -----------------------------------------------------------------

def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _run(p: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Hidden states of one direction for a batch (time, page, feature); masked steps leave the state as it is."""
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    pre = x @ p[f"{side}x"] + p[f"{side}b"]
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = pre[t] + h @ p[f"{side}h"]
        i, f, o = np.split(_sigmoid(z[:, :3 * HIDDEN]), 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN:])
        new = f * c + i * g
        tanh = np.tanh(new)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, tanh, m))
        c = np.where(m, new, c)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out, (h, c)


def predict(p: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of being main text, for the blocks of each page."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        group = order[at:at + 64]
        if len(pages[group[-1]]) > SPAN:
            group = group[:1] if len(pages[group[0]]) > SPAN else [i for i in group if len(pages[i]) <= SPAN]
        at += len(group)
        steps = max(len(pages[i]) for i in group)
        x = np.zeros((steps, len(group), pages[group[0]].shape[1]), np.float32)
        mask = np.zeros((steps, len(group)), bool)
        for k, i in enumerate(group):
            x[:len(pages[i]), k], mask[:len(pages[i]), k] = pages[i], True
        sides = []
        for side, way in (("f", 1), ("b", -1)):
            state, parts = None, []
            xs, ms = x[::way], mask[::way]
            for s in range(0, steps, SPAN):
                h, state = _run(p, side, xs[s:s + SPAN], ms[s:s + SPAN], state=state)
                parts.append(h)
            sides.append(np.concatenate(parts)[::way])
        y = _sigmoid(np.concatenate(sides, axis=2) @ p["out"] + x @ p["skip"] + p["bias"])
        for k, i in enumerate(group):
            out[i] = y[:len(pages[i]), k]
    return out


def _step(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of a batch."""
    kept: dict[str, list] = {"f": [], "b": []}
    hf, _ = _run(p, "f", x, mask, kept["f"])
    hb, _ = _run(p, "b", x[::-1], mask[::-1], kept["b"])
    both = np.concatenate([hf, hb[::-1]], axis=2)
    d = (_sigmoid(both @ p["out"] + x @ p["skip"] + p["bias"]) - y) * mask / mask.sum()
    g = {"out": np.tensordot(both, d, ([0, 1], [0, 1])), "skip": np.tensordot(x, d, ([0, 1], [0, 1])), "bias": d.sum()}
    dh_all = d[:, :, None] * p["out"]
    for side, dh_side, xs in (("f", dh_all[:, :, :HIDDEN], x), ("b", dh_all[::-1, :, HIDDEN:], x[::-1])):
        dz_all = np.zeros((*xs.shape[:2], 4 * HIDDEN), np.float32)
        gh = np.zeros_like(p[f"{side}h"])
        dh = dc = np.zeros((xs.shape[1], HIDDEN), np.float32)
        for t in range(len(xs) - 1, -1, -1):
            h, c, i, f, o, gate, tanh, m = kept[side][t]
            total = dh + dh_side[t]
            on = np.where(m, total, 0)
            dcell = np.where(m, dc, 0) + on * o * (1 - tanh * tanh)
            dz = np.concatenate([dcell * gate * i * (1 - i), dcell * c * f * (1 - f), on * tanh * o * (1 - o), dcell * i * (1 - gate * gate)], axis=1)
            dz_all[t] = dz
            gh += h.T @ dz
            dh = np.where(m, dz @ p[f"{side}h"].T, total)
            dc = np.where(m, dcell * f, dc)
        g[f"{side}h"] = gh
        g[f"{side}x"] = np.tensordot(xs, dz_all, ([0, 1], [0, 1]))
        g[f"{side}b"] = dz_all.sum(axis=(0, 1))
    return g


# --- pages to learn from ---------------------------------------------------------

#: In front of main text in made pages: a private-use character.
MARK = "\uE000"
_SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "le", "ment", "que", "oi", "sch", "ung", "ein", "ch", "ado", "ción", "os", "la", "ti", "es"]
_CHROME_WORDS = "home about contact login register search menu subscribe newsletter cookies privacy terms share follow next previous archive tags category popular related sponsored advert copyright rights reserved reply comments".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _prose(r: random.Random) -> str:
    odd = r.random()
    if odd < 0.08:
        return " | ".join(_words(r, 1) for _ in range(r.randint(2, 30)))
    if odd < 0.14:
        return " ".join(_words(r, 1) + r.choice(["%%%", "###", "***", "$$$", "!!"]) for _ in range(r.randint(2, 40)))
    if odd < 0.2:
        return r.choice([_words(r, r.randint(1, 12)).upper() + "!", f"{_words(r, 3)} {r.randint(1, 10 ** 6)} {_words(r, 1)}", _words(r, 1).capitalize() + ".", f"{r.randint(1, 99)}, {r.randint(1, 99)}."])
    return " ".join(_words(r, r.randint(3, 16)).capitalize() + r.choice([".", ".", ".", "?", "!"]) for _ in range(r.choice([1, 1, 2, 4, 7])))


def _chrome(r: random.Random) -> str:
    return r.choice([lambda: " ".join(r.choice(_CHROME_WORDS) for _ in range(r.randint(1, 4))), lambda: _words(r, r.randint(1, 6)), lambda: _prose(r)])()


def _attr(r: random.Random, names: list[str]) -> str:
    n = r.choice(names)
    return r.choice([f' class="{n}"', f' id="{n}"', f" class='{n} {r.choice(['box', 'wide', 'c1', 'row'])}'", f' class="{n}" id="x{r.randint(1, 9)}"'])


def made_page(r: random.Random) -> str:
    """A page whose main text carries marks (U+E000 in front of each block)."""
    mark = MARK

    def paragraphs(tag: str = "p") -> str:
        out = []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.62:
                body = _prose(r)
                if r.random() < 0.3:
                    body = f"<b>{body}" + r.choice(["</b>", "<br>", ""])
                if r.random() < 0.2:
                    body += f' <a href="/x">{_words(r, 2)}</a> ' + _words(r, 3)
                out.append(f"<{tag}>{mark}{body}" + r.choice([f"</{tag}>", f"</{tag}>", "" if tag == "p" else f"</{tag}>"]))
            elif kind < 0.72:
                out.append(f"<h{r.randint(2, 4)}>{mark}{_words(r, r.randint(1, 6))}</h3>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{mark}{_words(r, r.randint(2, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote>{mark}{_prose(r)}</blockquote>")
            elif kind < 0.9:
                out.append(f"<table><tr><td>{mark}{_words(r, 2)}</td><td>{mark}{_words(r, 3)}</td></tr></table>")
            elif kind < 0.95:
                out.append(f"<div{_attr(r, ['ad', 'advert', 'ads', 'banner', 'promo', 'sponsored', 'related', 'share', 'social'])}>{_chrome(r)}</div>")
            else:
                out.append(f"<pre>{mark}{_words(r, 8)}</pre>")
        return "".join(out)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_chrome(r)}</a></li>' for i in range(n)) + "</ul>"

    def extra(where: str) -> str:
        many = {
            "nav": lambda: r.choice([f"<nav>{links(r.randint(2, 8))}</nav>", f"<div{_attr(r, ['nav', 'menu', 'navbar', 'breadcrumb', 'topbar'])}>{links(r.randint(2, 6))}</div>"]),
            "header": lambda: r.choice([f"<header>{r.choice(['', '<h1>' + _words(r, 2) + '</h1>'])}<p>{_chrome(r)}</p></header>", f"<div{_attr(r, ['header', 'masthead', 'site-header', 'logo'])}>{_chrome(r)}</div>"]),
            "ad": lambda: f"<div{_attr(r, ['ad', 'ads', 'advert', 'banner', 'sponsor', 'promo'])}>{_chrome(r)}</div>",
            "notice": lambda: f"<div{_attr(r, ['cookie', 'notice', 'consent', 'alert', 'popup', 'gdpr', 'modal'])}>{r.choice(['<p>', ''])}{_chrome(r)} <button>{_words(r, 1)}</button></div>",
            "aside": lambda: r.choice([f"<aside>{r.choice([links(3), '<p>' + _prose(r) + '</p>'])}</aside>", f"<div{_attr(r, ['sidebar', 'widget', 'related', 'recommended', 'trending'])}><h3>{_words(r, 2)}</h3>{r.choice([links(4), '<p>' + _prose(r) + '</p>'])}</div>"]),
            "form": lambda: f"<form{r.choice(['', _attr(r, ['search', 'newsletter', 'subscribe', 'login'])])}><label>{_chrome(r)}</label><input name=q><button>{_words(r, 1)}</button></form>",
            "comments": lambda: r.choice(["<section", "<div"]) + f"{_attr(r, ['comments', 'comment-list', 'responses', 'disqus', 'discussion'])}><h2>{_words(r, 2)}</h2>" + "".join(
                f'<{r.choice(["div", "li", "article"])} class="comment"><p>{_prose(r)}</p></div>' for _ in range(r.randint(1, 5))) + "</div>",
            "footer": lambda: r.choice([f"<footer>{r.choice(['<p>', '', '&copy; ', '&copy; www.' + _words(r, 1) + '.example.com &middot; '])}{_chrome(r)}{r.choice(['', links(3)])}</footer>", f"<div{_attr(r, ['footer', 'site-footer', 'copyright', 'bottom', 'legal'])}>{_chrome(r)}</div>"]),
        }
        return many[where]()

    top = "".join(extra(w) for w in ("notice", "header", "nav", "ad", "form") if r.random() < 0.55)
    title = f"<h1>{mark}{_words(r, r.randint(2, 8))}</h1>" if r.random() < 0.8 else ""
    if title and r.random() < 0.2:
        title = f"<header>{title}</header>"
    body = title + paragraphs(r.choice(["p", "p", "p", "p", "div"]))
    wrap = r.random()
    if wrap < 0.45:
        body = f"<article{r.choice(['', _attr(r, ['post', 'entry', 'story'])])}>{body}</article>"
    elif wrap < 0.6:
        body = f"<main>{body}</main>"
    elif wrap < 0.68:
        pass
    else:
        body = f"<div{_attr(r, ['content', 'post', 'article', 'entry-content', 'main', 'story', 'text', 'post-body'])}>{body}</div>"
    if r.random() < 0.25:
        body = f"<main><section>{body}</section></main>"
    if r.random() < 0.3:
        body = f"<div{_attr(r, ['page', 'wrapper', 'container', 'layout'])}>{body}{extra('aside')}</div>"
    bottom = "".join(extra(w) for w in ("aside", "comments", "form", "ad", "footer") if r.random() < 0.5)
    if r.random() < 0.06:
        return r.choice(["<html><body>", "", "<body>"]) + paragraphs()
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>{top}{body}{bottom}" + r.choice(["</body></html>", ""])


@cache
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01) -> dict[str, np.ndarray]:
    """The network's weights, by Adam on made pages."""
    r, rng, memo = random.Random(seed), np.random.default_rng(seed), {}
    data = []
    for _ in range(pages):
        page = blocks_of(made_page(r))
        y = np.array([b.text.startswith(MARK) for b in page], np.float32)
        for b in page:
            b.text = b.text.replace(MARK, "").strip() or "-"
        if len(page):
            data.append((features(page, memo), y))
    width = data[0][0].shape[1]
    p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "skip": np.zeros(width, np.float32), "bias": np.float32(0)}
    for side in "fb":
        p[f"{side}x"] = rng.normal(0, width ** -0.5, (width, 4 * HIDDEN)).astype(np.float32)
        p[f"{side}h"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"{side}b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
    m, v, t = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i:i + 12] for i in range(0, len(data), 12)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            batch = batches[k]
            steps = max(len(y) for _, y in batch)
            x, y, mask = np.zeros((steps, len(batch), width), np.float32), np.zeros((steps, len(batch)), np.float32), np.zeros((steps, len(batch)), bool)
            for j, (a, b) in enumerate(batch):
                x[:len(b), j], y[:len(b), j], mask[:len(b), j] = a, b, True
            t += 1
            for name, g in _step(p, x, mask, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.995 * v[name] + 0.005 * g * g
                p[name] = (p[name] - rate * min(1.0, 2 - 2 * t / (epochs * len(batches))) * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v[name] / (1 - 0.995 ** t)) + 1e-7)).astype(np.float32)
    return p


# --- Spark -----------------------------------------------------------------------

def main_texts(pages: list[str], weights: dict[str, np.ndarray], memo: dict, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(main text, its blocks, all blocks) of each page."""
    cut = [blocks_of(p) for p in pages]
    labels = predict(weights, [features(b, memo) for b in cut])
    out = []
    for page, y in zip(cut, labels, strict=True):
        kept = [b.text for b, q in zip(page, y, strict=True) if q >= threshold]
        out.append(("\n".join(kept), len(kept), len(page)))
    return out


def extract_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars, n_kept, n_blocks``, one row per row of ``pages``.

    Null html counts as empty and gives an empty text, as do pages without main
    text. Repeated rows and rows without page_id are handled each by its own html.
    """
    weights = weights or train()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                if len(memo) > 500_000:
                    memo.clear()
                found = main_texts([h or "" for h in part.column(2).to_pylist()], weights, memo, threshold)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()),
                    pa.array([k for _, k, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
