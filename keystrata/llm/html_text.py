"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks at block-level tags; scripts, styles, comments and the head are never text. Each block
becomes a vector: hashed tokens of its tag path (names, classes, ids, and the path's nearest parts once more), all of its
words hashed, and a few measures (length, link share, position, ..). A bidirectional LSTM in numpy reads the whole
sequence of a page's blocks, so that each block's label rests on the document around it; the blocks labelled main are
joined.

The labeller is trained here, on pages generated from a seeded grammar of containers, classes (telling, misleading and
missing ones), words (of links, notices, adverts, comments and prose in four languages) and damage (missing end tags,
stray markup) whose labels are known by construction. No page is cut or capped: sequences of any length are read. An
element that is never closed ends where its block does, and a quote that is never closed ends with its tag. Null or
empty html has an empty text. A score of just one half (a tie) is not main text. Repeated rows each get a result; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .features import Adam, sigmoid

PATH_BITS, NEAR_BITS, WORD_BITS = 6, 5, 6
N_MEASURES = 8
WIDTH = (1 << PATH_BITS) + (1 << NEAR_BITS) + (1 << WORD_BITS) + N_MEASURES
HIDDEN = 16
TRAINING_PAGES = 1200
EPOCHS = 18

# Elements inside a line, elements without content, and those whose content is not text.
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg math iframe object canvas head title select textarea button".split())
#: Of these: closed by "/>" too, may lie in themselves, run to the page's end when never closed.
FOREIGN, NESTING, TO_THE_END = {"svg", "math"}, {"svg", "math", "object", "template"}, {"script", "style"}
BLOCK_TAG = re.compile(r"</?(?:address|article|aside|blockquote|body|center|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul)\b", re.I)
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Comments, tags (attributes with closed quotes, else all up to the next ">"), declarations, text, a bare "<".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)|([^>]*+))>|<[!?][^>]*>|([^<]+)|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("path", "text", "linked", "size")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked
        self.size = len(text)


_TAGS: dict[str, re.Pattern] = {}


def silent_end(page: str, at: int, name: str) -> int:
    """Where the silent element that begins before ``at`` ends. One that is never closed, or only after another of its
    kind begins, ends at the next block-level tag; scripts and styles run to the page's end."""
    if name not in _TAGS:
        _TAGS[name] = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I)
    depth = 1
    for m in _TAGS[name].finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif name in NESTING:
            depth += not m[0].endswith("/>")
        elif name not in TO_THE_END:
            break
    if name in TO_THE_END:
        return len(page)
    m = BLOCK_TAG.search(page, at)
    return at if name == "head" else m.start() if m else len(page)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path (a list of token lists, outermost first), text, characters inside links."""
    found: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append(Block([t for name, t in stack if name not in INLINE], text, min(linked, len(text))))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[5] is not None:
            text = html.unescape(m[5]) if "&" in m[5] else m[5]
            parts.append(text)
            if links:
                linked += len(text.strip())
        elif m[2] is None:
            if m[0] == "<":
                parts.append("<")
        else:
            name, inside = m[2].lower(), m[3] if m[3] is not None else m[4]
            if m[1]:
                if name in INLINE:
                    links -= name == "a" and links > 0
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i]
                            break
                        if stack[i][0] not in INLINE:
                            break
                    continue
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name in VOID:
                parts.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in SILENT:
                if not (name in FOREIGN and inside.endswith("/")):
                    at = silent_end(page, at, name)
                parts.append(" ")
                continue
            if name in INLINE:
                links += name == "a"
                stack.append((name, [name]))
                continue
            flush()
            links = 0
            open_now = CLOSES.get(name, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in open_now:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
            tokens = [name]
            if inside and "=" in inside:
                for a in ATTRIBUTE.finditer(inside):
                    tokens += PART.findall((a[2] or a[3] or a[4] or "").lower())
            stack.append((name, tokens))
    flush()
    return found


class Hashes(dict):
    """Token to hash, emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[token] = zlib.crc32(token.encode())
        return h


HASHES = Hashes()


def vectors(page: list[Block]) -> np.ndarray:
    """One row of WIDTH per block."""
    out = np.zeros((len(page), WIDTH), np.float32)
    near_at, word_at, rest_at = 1 << PATH_BITS, (1 << PATH_BITS) + (1 << NEAR_BITS), WIDTH - N_MEASURES
    total = sum(b.size for b in page) or 1
    before = 0
    words = [PART.findall(b.text.lower()) for b in page]
    count = np.array([len(w) for w in words], np.int64)
    if count.any():
        h = np.fromiter((x for w in words for x in map(HASHES.__getitem__, w)), np.int64, int(count.sum()))
        place = np.repeat(np.arange(len(page)) << WORD_BITS, count) + (h & ((1 << WORD_BITS) - 1))
        sums = np.bincount(place, weights=np.where(h >> 16 & 1, 1.0, -1.0), minlength=len(page) << WORD_BITS)
        out[:, word_at:rest_at] = sums.reshape(len(page), -1) / (count + 4)[:, None]
    for i, b in enumerate(page):
        row = out[i]
        for k, tokens in enumerate(b.path):
            for t in tokens:
                if t in ("html", "body"):
                    continue
                h = HASHES[t]
                row[h & ((1 << PATH_BITS) - 1)] = 1.0 if h >> 20 & 1 else -1.0
                if k >= len(b.path) - 2:
                    row[near_at + (h >> 7 & ((1 << NEAR_BITS) - 1))] = 1.0 if h >> 21 & 1 else -1.0
        row[rest_at:] = (np.log1p(b.size) / 6, b.linked / b.size, before / total, b.size / total, i / len(page), b.text[-1] in ".!?", min(len(b.path), 12) / 12, 1.0)
        before += b.size
    return out


# The network -----------------------------------------------------------------------------------------------------


class BiLstm:
    """Two LSTMs over padded sequences (time, page, width), a logistic read-out of both, and its gradients."""

    def __init__(self, seed: int = 11, width: int = WIDTH, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden, self.width = hidden, width
        self.shapes = [(width + hidden, 4 * hidden), (4 * hidden,)] * 2 + [(2 * hidden,), (1,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        self.cuts = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = rng.normal(0, 0.12, self.cuts[-1])
        for k in (1, 3):
            bias = self.part(k)
            bias[:] = 0
            bias[hidden : 2 * hidden] = 1.0

    def part(self, k: int, flat: np.ndarray | None = None) -> np.ndarray:
        source = self.flat if flat is None else flat
        return source[self.cuts[k] : self.cuts[k + 1]].reshape(self.shapes[k])

    def _run(self, x: np.ndarray, mask: np.ndarray, k: int, keep: bool):
        h_size = self.hidden
        w, b = self.part(k), self.part(k + 1)
        drive = x @ w[: self.width] + b
        h = c = np.zeros((x.shape[1], h_size))
        out, trace = np.zeros((x.shape[0], x.shape[1], h_size)), []
        steps = range(x.shape[0]) if k == 0 else range(x.shape[0] - 1, -1, -1)
        for t in steps:
            z = drive[t] + h @ w[self.width :]
            s = sigmoid(z[:, : 3 * h_size])
            i, f, o, g = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :], np.tanh(z[:, 3 * h_size :])
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
            out[t] = h
        return out, trace

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, ta = self._run(x, mask, 0, keep)
        back, tb = self._run(x, mask, 2, keep)
        both = np.concatenate((ahead, back), axis=2)
        return sigmoid(both @ self.part(4) + self.part(5)[0]), (both, ta, tb)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        p, (both, ta, tb) = self.forward(x, mask, keep=True)
        n, hs = mask.sum(), self.hidden
        loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / n
        d = np.where(mask, p - y, 0) / n
        g = np.zeros_like(self.flat)
        self.part(4, g)[:] = (both * d[:, :, None]).sum((0, 1))
        self.part(5, g)[:] = d.sum()
        for k, trace, lo in ((0, ta, 0), (2, tb, hs)):
            w, gw, gb = self.part(k), self.part(k, g), self.part(k + 1, g)
            out = d[:, :, None] * self.part(4)[lo : lo + hs]
            dh = dc = np.zeros((x.shape[1], hs))
            for t, h, c, i, f, o, gate, tc, m in reversed(trace):
                dh = dh + out[t]
                dz_c = np.where(m, dc + dh * o * (1 - tc * tc), 0)
                do = np.where(m, dh * tc, 0)
                dz = np.concatenate((dz_c * gate * i * (1 - i), dz_c * c * f * (1 - f), do * o * (1 - o), dz_c * i * (1 - gate * gate)), axis=1)
                gw[: self.width] += x[t].T @ dz
                gw[self.width :] += h.T @ dz
                gb += dz.sum(0)
                dh = np.where(m, 0, dh) + dz @ w[self.width :].T
                dc = np.where(m, dz_c * f, dc)
        return loss, g


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, seqs))
    x, mask = np.zeros((longest, len(seqs), seqs[0].shape[1]), np.float32), np.zeros((longest, len(seqs)), bool)
    for j, s in enumerate(seqs):
        x[: len(s), j], mask[: len(s), j] = s, True
    return x, mask


def groups(lengths: list[int], budget: int = 6000) -> Iterator[list[int]]:
    """Sequences of like length together, about ``budget`` padded steps at a time; a longer one stands alone."""
    order, held = sorted(range(len(lengths)), key=lengths.__getitem__), []
    for i in order:
        if held and lengths[i] * (len(held) + 1) > budget:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


# Training pages ------------------------------------------------------------------------------------------------------

MAIN = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body entry"', 'section class="article-text"', 'div role="main"']
ASIDE = [
    "nav", "header", "footer", "aside", 'div class="ad"', 'div class="ads banner"', 'div class="sidebar"', 'div id="menu"', 'ul class="nav"', 'div class="cookie-notice"', 'div class="comments"',
    'section id="comments"', 'div class="related-links"', 'div class="share social"', 'form', 'div class="newsletter form"', 'div class="promo advert"', 'div class="breadcrumb"', 'div id="footer"', 'div class="notice popup"', 'div class="header top"',
]


# Words that boilerplate of each kind, and running prose, are made of.
TELLING = {
    "links": "home about contact login register menu search privacy terms shop news sitemap help faq archive categories startseite kontakt impressum datenschutz suche inicio contacto buscar accueil recherche next previous more".split(),
    "notice": "we use cookies to improve your experience accept all consent policy settings agree wir verwenden cookies zustimmen utilizamos aceptar nous utilisons accepter javascript enable browser".split(),
    "advert": "advertisement sponsored buy now sale offer discount free shipping price order limited deal anzeige angebot kaufen oferta comprar publicité promo click here".split(),
    "comment": "posted by reply says ago comments comment like report thanks great post agree anonymous user kommentar antworten responder comentario répondre commentaire i you my".split(),
    "form": "subscribe newsletter email address sign up enter your name send submit password abonnieren suscribirse correo inscrire envoyer".split(),
    "footer": "copyright all rights reserved powered by inc ltd contact imprint follow us rechte vorbehalten derechos reservados tous droits réservés".split(),
    "related": "related articles read also popular posts recommended trending you may like see more tags share facebook twitter".split(),
}
PROSE = {
    "en": "the of and to in a is that for it was on are as with they at be this from have or by one had not but what all were when there can an which their if will each".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son".split(),
}
SYLLABLES = "an er on th re le qu st ció für ing ta mo ñe ée sch ka lu the ent ou ai men ble ver auf".split()
NEUTRAL = "a b box x1 row col c12 wrap inner block item grp sec el css jsx main-wrapper container".split()
KINDS = {"nav": "links", "ul": "links", "header": "links", "footer": "footer", "aside": "related", "form": "form"}


def training_page(rng: np.random.Generator, named: float = 0.65) -> tuple[str, list[int]]:
    """A page from the grammar, and the label of each of its blocks. named: the share of pages whose classes tell."""
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    language, telling, talks = pick(list(PROSE)), rng.random() < named, rng.random() < 0.6
    invented = lambda: "".join(pick(SYLLABLES) for _ in range(rng.integers(1, 4)))
    prose_share = 0.0 if rng.random() < 0.3 else 0.4

    def words(lo, hi, kind=None):
        source = TELLING[kind] if kind and talks else PROSE[language]
        share = 0.75 if kind and talks else prose_share
        return " ".join(pick(source) if rng.random() < share else invented() for _ in range(rng.integers(lo, hi)))

    out, labels = [], []

    def leaf(tag, text, label):
        closed = rng.random() < 0.9
        out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed or tag.split()[0] not in ("p", "li") else ""))
        labels.append(label)

    def boilerplate():
        tag = str(pick(ASIDE))
        name = tag.split()[0]
        kind = KINDS.get(name) or pick(list(TELLING))
        for mark, known in (("cookie", "notice"), ("notice", "notice"), ("comment", "comment"), ("ad", "advert"), ("promo", "advert"), ("newsletter", "form"), ("related", "related"), ("footer", "footer")):
            if mark in tag:
                kind = known
        if not telling and name in ("div", "section"):
            tag = pick([name, f'{name} class="{pick(NEUTRAL)}"'])
        elif not telling and rng.random() < 0.6 and name != "ul":
            name = "div"
            tag = pick(["div", f'div class="{pick(NEUTRAL)}"', f'div id="{pick(NEUTRAL)}"'])
        out.append(f"<{tag}>")
        shape = 0 if kind == "links" or name in ("nav", "ul") else rng.integers(0, 4)
        if not talks and not telling and name in ("div", "section"):
            shape = 0  # neither classes nor words tell: only shape can
        if shape == 0:
            inner = "" if name == "ul" else "<ul>"
            out.append(inner)
            for _ in range(rng.integers(1, 9)):
                leaf("li", f'<a href="/x">{words(1, 4, kind)}</a>', 0)
            out.append("</ul>" if inner else "")
        elif shape == 1:
            out.append(words(2, 30, kind) + ("." if rng.random() < 0.7 else ""))
            labels.append(0)
        elif shape == 2:
            for _ in range(rng.integers(1, 5)):
                leaf("p", words(3, 50, kind) + ".", 0)
        else:
            leaf(pick(["div", "p", "h3"]), f"{words(1, 6, kind)} <a href='#'>{words(1, 4, kind)}</a> {words(1, 25, kind)}", 0)
        out.append(f"</{name}>")

    out.append(f"<html><head><title>{words(3, 9)}</title><script>var a='<p>';</script></head><body>")
    wrap = rng.random() < 0.3
    out.append('<div class="page wrapper">' if wrap else "")
    for _ in range(rng.integers(0, 4)):
        boilerplate()
    tag = str(pick(MAIN)) if telling or rng.random() < 0.2 else pick(["div", f'div class="{pick(NEUTRAL)}"', f'section id="{pick(NEUTRAL)}"', ""])
    if rng.random() < 0.97:
        out.append(f"<{tag}>" if tag else "")
        if rng.random() < 0.8:
            leaf("h1", words(3, 12), 1)
        for _ in range(rng.integers(0, 14)):
            kind = rng.random()
            if kind < 0.06:
                boilerplate()
            elif kind < 0.12:
                out.append(f"<p><b>{words(1, 40)}.<br>")
                labels.append(1)
            elif kind < 0.2:
                leaf(pick(["h2", "h3", "blockquote", "pre", "td", "div"]), words(1, 20), 1)
            elif kind < 0.26:
                out.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    leaf("li", words(1, 15), 1)
                out.append("</ul>")
            else:
                attribute = f' class="{pick(NEUTRAL)}"' if not telling and rng.random() < 0.2 else ""
                text = words(1, 90 if rng.random() < 0.7 else 6) + rng.choice([".", "!", ""], p=[0.8, 0.1, 0.1]) + (f' <a href="#">{words(1, 4)}</a>' if rng.random() < 0.1 else "")
                for _ in range(1 if rng.random() < 0.95 else rng.integers(2, 9)):
                    leaf("p" + attribute, text, 1)
        out.append(f"</{tag.split()[0]}>" if tag else "")
    for _ in range(rng.integers(0, 4)):
        boilerplate()
    out.append(("</div>" if wrap else "") + ("</body></html>" if rng.random() < 0.8 else ""))
    return "".join(out), labels


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 5) -> BiLstm:
    rng = np.random.default_rng(seed)
    seqs, targets = [], []
    while len(seqs) < pages:
        page, labels = training_page(rng)
        found = blocks(page)
        if found and len(found) == len(labels):
            seqs.append(vectors(found))
            targets.append(np.array(labels, float)[:, None])
    net, batches = BiLstm(), []
    for group in groups([len(s) for s in seqs], 800):
        x, mask = padded([seqs[i] for i in group])
        batches.append((x, mask, padded([targets[i] for i in group])[0][:, :, 0]))
    adam, mean, taken = Adam(len(net.flat), 0.01), np.zeros_like(net.flat), 0
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs // 2 else 0.003 if epoch < epochs * 5 // 6 else 0.001
        for i in rng.permutation(len(batches)):
            adam.step(net.flat, net.gradient(*batches[i])[1])
            if epoch >= epochs * 5 // 6:  # the last weights' mean is steadier than any of them
                mean, taken = mean + net.flat, taken + 1
    net.flat = mean / taken if taken else net.flat
    return net


def main_texts(net: BiLstm, pages: list[str]) -> list[str]:
    """Main text of each page: labelled blocks, one a line."""
    cut = [blocks(p) for p in pages]
    some = [i for i, b in enumerate(cut) if b]
    texts = [""] * len(pages)
    rows = {i: vectors(cut[i]) for i in some}
    for group in groups([len(cut[i]) for i in some]):
        ids = [some[g] for g in group]
        p, _ = net.forward(*padded([rows[i] for i in ids]))
        for j, i in enumerate(ids):
            texts[i] = "\n".join(b.text for b, s in zip(cut[i], p[: len(cut[i]), j], strict=True) if s > 0.5)
    return texts


def extract(pages: DataFrame, net: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    flat = (net or train()).flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BiLstm()
        model.flat = flat
        for piece in common.pieces(batches, "html"):
            texts = main_texts(model, [h or "" for h in piece.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id").cast(pa.int64()), piece.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
