"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the
path of open tags and their class and id words. A bidirectional LSTM in numpy reads the
sequence of blocks - the mean of the hashed path vectors, the mean of the hashed word vectors, and
a few numbers - so that every block is classified in the context of the whole page.

There are no labelled pages. The labeller is trained on a bounded sample of the pages
themselves, whose elements that stand for content or for page furniture by their name are
taken as labels, and on pages laid out anew from the sample's own texts: main text in
containers of various names, between menus, headers, footers, sidebars, notices, adverts, forms,
sharing bars, related links and reader comments, also inside the article.

Defined results: null or empty html gives an empty text. Unclosed tags, cut-off tags and entities,
and text outside any tag do no harm; only an unclosed script or style reaches to the end of the page, as HTML has it.
Text in noscript, object, canvas, audio, video, template, svg and math is read like any other and left to the labeller;
what an iframe holds for browsers without frames, and the name of a drawing, are not shown and not read.
Repeated rows get equal results.
"""

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tuned, worker_state
from .samples import sampled

#: Pages that the labeller is trained on, the most blocks of a page in training, and the fewest pages laid out anew.
SAMPLE, LONGEST, MADE = 200, 80, 600
PATH_BUCKETS, WORD_BUCKETS, PATH_SIZE, WORD_SIZE, HIDDEN = 1 << 12, 1 << 13, 16, 6, 16
NUMBERS = 4
EPOCHS, BATCH, RATE = 10, 32, 0.02
REMEMBERED = 200_000

#: Elements that start a block of their own. Fixed by HTML.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noframes ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without content. Fixed by HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is code, to their closing tag or the end of the page. Fixed by HTML.
RAW = {"script", "style"}
#: Elements that name a drawing and are not shown. Fixed by SVG.
DRAWING_NAMES = {"title", "desc"}
#: Path word of a noscript that stands in the body itself: a block of its own. Elsewhere its text is part of what it stands in.
NOTICE = ".noscript"
#: Elements that an opening tag of the same kind closes. Fixed by HTML.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: Elements that end an open paragraph. Fixed by HTML.
ENDS_P = BLOCK - {"body", "html", "head", "title", "option", "button", "label", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
#: A tag that the end of the page cuts off.
CUT_OFF = re.compile(r"<[!/?a-zA-Z][^<>]*\Z")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPLIT_NAME = re.compile(r"[^a-z0-9]+")


def named(word: str) -> str:
    """A class or id word of a path; one thing and many of them count as the same name."""
    return "." + (word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 2 else word)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path words, text, linked characters) of every block that has text, in page order."""
    out, stack, parts, linked = [], [], [], 0
    links, at, path = 0, 0, ()

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked))
            parts, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if links else 0

    def close(i):
        nonlocal links, path
        if any(name in BLOCK or words[0] == NOTICE for name, words in stack[i:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[i:])
        del stack[i:]
        path = tuple(w for _, words in stack for w in words)

    page = CUT_OFF.sub("", page)
    while True:
        found = TOKEN.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            flush()
            return out
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        empty = found[3].rstrip().endswith("/")
        drawing = name in ("svg", "math") or any(n in ("svg", "math") for n, _ in stack)
        if name in RAW or name == "iframe" or drawing and name in DRAWING_NAMES:
            if not empty:
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page) if name in RAW else at
            continue
        if drawing and empty and name not in BLOCK:
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr") and name == "br":
                add("\n")
            continue
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    close(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in ("p",):
                    break
        if name in BLOCK:
            flush()
        words = [name]
        for value in NAMES.findall(found[3]) if found[3] else ():
            words += [named(w) for w in SPLIT_NAME.split(value.lower().strip("\"'")) if w]
        if name == "noscript" and all(n in ("html", "body") for n, _ in stack):
            flush()
            words[0] = NOTICE
        stack.append((name, words))
        links += name == "a"
        path = tuple(w for _, ws in stack for w in ws if w in BLOCK or w[0] == "." or w == "a")


class PathIds(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 3) % PATH_BUCKETS
        return found


class WordIds(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.lower(), 4) % WORD_BUCKETS
        return found


def bags(lists, known) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each list has; an empty list has id 0."""
    ids = [[known[w] for w in words] or [0] for words in lists]
    return np.array([i for x in ids for i in x]), np.array([len(x) for x in ids])


def mean_rows(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def numbers(page) -> np.ndarray:
    """Length, share of linked characters, closing mark and place of each block."""
    n = len(page)
    out = np.empty((n, NUMBERS))
    for i, (_, text, linked) in enumerate(page):
        out[i] = np.log1p(len(text)) / 6, min(1.0, linked / len(text)), text[-1] in ".!?", i / n
    return out


class Labeller:
    """Hashed vectors, two LSTM directions and a logistic output."""

    def __init__(self, rng):
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        self.p = {
            "path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)),
            **{f"x{d}": rng.normal(0, size**-0.5, (size, 4 * HIDDEN)) for d in "fb"},
            **{f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)) for d in "fb"},
            **{f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fb"},
            "out": rng.normal(0, 0.2, 2 * HIDDEN), "direct": np.zeros(size), "bias": np.zeros(1),
        }

    def inputs(self, features) -> np.ndarray:
        paths, words, nums = features
        return np.concatenate([mean_rows(self.p["path"], *paths), mean_rows(self.p["word"], *words), nums], axis=1)

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logits of all blocks; pages are stepped together, longest first."""
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        size = sizes[order]
        active = [int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)]
        hidden = np.empty((len(x), 2 * HIDDEN), dtype=x.dtype)
        tape = []
        for d, side in (("f", 0), ("b", HIDDEN)):
            gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
            h, c = np.zeros((len(sizes), HIDDEN), dtype=x.dtype), np.zeros((len(sizes), HIDDEN), dtype=x.dtype)
            for t, a in enumerate(active):
                at = first[:a] + t if d == "f" else first[:a] + size[:a] - 1 - t
                z = gates[at] + h[:a] @ self.p[f"h{d}"]
                s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
                before_h, before_c = h[:a].copy() if keep else None, c[:a].copy() if keep else None
                c[:a] = f * c[:a] + i * g
                q = np.tanh(c[:a])
                h[:a] = o * q
                hidden[at, side : side + HIDDEN] = h[:a]
                if keep:
                    tape.append((d, side, at, a, i, f, o, g, q, before_h, before_c))
        logits = hidden @ self.p["out"] + x @ self.p["direct"] + self.p["bias"][0]
        return (logits, hidden, tape) if keep else logits

    def gradients(self, features, x, sizes, labels) -> dict:
        logits, hidden, tape = self.run(x, sizes, keep=True)
        wrong = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(labels)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("path", "word")}
        g["out"], g["direct"], g["bias"] = hidden.T @ wrong, x.T @ wrong, np.array([wrong.sum()])
        dx = wrong[:, None] * self.p["direct"]
        d_hidden = wrong[:, None] * self.p["out"]
        carry = {}
        for d, side, at, a, i, f, o, gg, q, before_h, before_c in reversed(tape):
            if d not in carry:
                carry[d] = (np.zeros((len(sizes), HIDDEN)), np.zeros((len(sizes), HIDDEN)))
            dh_next, dc_next = carry[d]
            dh = d_hidden[at, side : side + HIDDEN] + dh_next[:a]
            dc = dh * o * (1 - q * q) + dc_next[:a]
            dz = np.concatenate([dc * gg * i * (1 - i), dc * before_c * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            dh_next[:a] = dz @ self.p[f"h{d}"].T
            dc_next[:a] = dc * f
            g[f"h{d}"] += before_h.T @ dz
            g[f"x{d}"] += x[at].T @ dz
            g[f"c{d}"] += dz.sum(axis=0)
            dx[at] += dz @ self.p[f"x{d}"].T
        for name, (ids, many), part in (("path", features[0], slice(0, PATH_SIZE)), ("word", features[1], slice(PATH_SIZE, PATH_SIZE + WORD_SIZE))):
            rows, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros((len(rows), part.stop - part.start))
            np.add.at(total, inverse, np.repeat(dx[:, part] / many[:, None], many, axis=0))
            g[name] = (rows, total)
        return g


def features(pages, path_ids, word_ids):
    flat = [b for page in pages for b in page]
    return (
        bags((b[0] for b in flat), path_ids),
        bags((b[1].split() for b in flat), word_ids),
        np.concatenate([numbers(p) for p in pages if p]) if flat else np.zeros((0, NUMBERS)),
    )


#: Names that mark page furniture, and containers that mark main text, for the training labels.
FURNITURE = {w if w[0] != "." else named(w[1:]) for w in (
    "nav header footer aside form menu button select label legend textarea option dialog .nav .navbar .menu .header .footer .sidebar .side .ad .ads "
    ".advert .advertisement .banner .promo .sponsored .cookie .cookies .consent .notice .popup .modal .newsletter .subscribe .share "
    ".sharing .social .related .recommended .breadcrumb .breadcrumbs .pagination .comment .comments .respond .replies .disqus .login .search "
    ".toolbar .widget .copyright .legal .tags .alert .notification .disclaimer .topbar .masthead head title".split()
)}
CONTAINERS = [
    ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="post-content"'),
    ("section", 'class="entry-content"'), ("div", 'class="story"'), ("div", 'id="main"'), ("div", 'role="main"'), ("article", 'class="post"'),
    ("div", 'class="text"'),
]
PARTS = [
    ("nav", "", "ul"), ("div", 'class="menu"', "ul"), ("ul", 'class="navbar"', "li"), ("div", 'class="breadcrumbs"', "a"), ("header", "", "p"),
    ("div", 'class="header"', "p"), ("div", 'id="header"', "p"), ("footer", "", ""), ("div", 'class="footer"', "p"), ("div", 'id="footer"', ""), ("aside", "", "p"),
    ("div", 'class="sidebar"', "ul"), ("aside", 'class="sidebar"', "p"), ("div", 'id="sidebar"', "p"), ("div", 'class="ad"', ""), ("div", 'class="advert"', "p"),
    ("div", 'class="advertisement"', ""), ("div", 'class="banner"', "p"), ("div", 'class="promo"', "p"), ("div", 'class="sponsored"', "p"),
    ("div", 'class="cookie-notice"', "p"), ("div", 'id="cookie-banner"', ""), ("div", 'class="consent"', "p"), ("div", 'class="notice"', ""),
    ("div", 'class="popup modal"', "p"), ("form", "", "label"), ("form", 'class="search"', "p"), ("div", 'class="newsletter"', "p"),
    ("div", 'class="subscribe"', "form"), ("div", 'class="login"', "form"), ("div", 'class="share"', "a"), ("div", 'class="social"', "a"),
    ("div", 'class="related"', "ul"), ("section", 'class="recommended"', "ul"), ("section", 'class="comments"', "p"), ("div", 'id="comments"', "p"),
    ("div", 'class="comment"', "p"), ("ol", 'class="comments"', "li"), ("div", 'class="pagination"', "a"), ("div", 'class="widget"', "p"), ("div", 'class="copyright"', ""),
    ("div", 'role="navigation"', "ul"), ("div", 'role="banner"', "p"), ("div", 'role="contentinfo"', "p"), ("div", 'role="complementary"', "p"),
    ("div", 'role="search"', "form"), ("div", 'role="dialog"', "p"), ("div", 'role="alert"', ""), ("div", 'class="alert"', "p"),
    ("div", 'class="notification"', ""), ("div", 'class="disclaimer"', "p"), ("div", 'class="topbar"', "a"), ("div", 'class="left sidebar"', "ul"),
    ("div", 'id="nav"', "ul"), ("ul", 'class="menu"', "li"), ("ol", 'class="breadcrumb"', "li"), ("section", 'id="reader-comments"', "p"),
    ("div", 'class="user-comment"', "p"), ("aside", 'class="ad"', "p"), ("p", 'class="notice"', ""), ("p", 'class="ad"', ""),
    ("section", 'class="related"', "p"), ("dialog", "", "p"), ("div", 'class="ads"', ""), ("header", 'class="masthead"', "p"), ("footer", "", "p"),
    ("noscript", "", "p"), ("noscript", "", ""),
]


def is_main(path: tuple[str, ...]) -> bool:
    """The training label of a block by the names in its path."""
    inside = any(w in ("article", "main") for w in path)
    return inside and not any(w in FURNITURE for w in path)


def element(kind, attributes, inner, texts, rng) -> str:
    """One piece of page furniture around texts of the sample."""
    some = [texts[i] for i in rng.integers(0, len(texts), int(rng.integers(1, 5)))]
    if inner == "ul":
        body = "<ul>" + "".join(f'<li><a href="/x">{" ".join(t.split()[:3])}</a></li>' for t in some) + "</ul>"
    elif inner in ("li", "a"):
        body = "".join(f'<{inner} href="/x">{" ".join(t.split()[:4])}</{inner}>' for t in some)
    elif inner == "form":
        body = f"<form><label>{' '.join(some[0].split()[:3])}</label><button>{some[0].split()[0]}</button></form>"
    elif inner:
        body = "".join(f"<{inner}>{t}</{inner}>" for t in some)
    else:
        body = some[0]
    if inner not in ("", "li") and rng.random() < 0.35:
        size = int(rng.integers(1, 5))
        body = f"<h{size}>{' '.join(some[-1].split()[:4])}</h{size}>{body}"
    if inner not in ("", "li") and rng.random() < 0.25:
        body = f'<div class="{rng.choice(["inner", "box", "wrap", "item", "content"])}">{body}</div>'
    return f"<{kind} {attributes}>{body}</{kind}>"


def laid_out(texts, rng) -> tuple[list, np.ndarray]:
    """A page made of the sample's texts, and the labels of its blocks."""
    texts = [html.escape(t) for t in texts]
    mark, kind = "\ue000", rng.integers(0, len(CONTAINERS))
    tag, attributes = CONTAINERS[kind]
    furniture = lambda most: "".join(element(*PARTS[i], texts, rng) for i in rng.integers(0, len(PARTS), int(rng.integers(0, most + 1))))
    body = []
    for i in range(int(rng.integers(1, 12)) if rng.random() < 0.97 else int(rng.integers(40, LONGEST))):
        t = texts[int(rng.integers(0, len(texts)))]
        if rng.random() < 0.2:  # paragraphs may be as short as a menu entry
            t = " ".join(t.split()[: int(rng.integers(1, 4))])
        name = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p", "p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td", "div"])
        inner = f"<b>{mark}{t}" if rng.random() < 0.15 else mark + (f'{t} <a href="/y">{t.split()[0]}</a>' if rng.random() < 0.2 else t)
        whole = {"li": f"<ul><li>{inner}</li></ul>", "td": f"<table><tr><td>{inner}</td></tr></table>"}.get(name)
        body.append(whole or f"<{name}>{inner}" + ("" if name == "p" and rng.random() < 0.3 else f"</{name}>"))
        if rng.random() < 0.1:
            body.append(element(*PARTS[int(rng.integers(0, len(PARTS)))], texts, rng))
    outer = rng.random() < 0.4
    head = "" if rng.random() < 0.2 else f"<html><head><title>{texts[0][:60]}</title></head><body>"
    before, after = ("" if rng.random() < 0.25 else furniture(5)), ("" if rng.random() < 0.25 else furniture(4))
    page = f"{head}{'<div class=wrapper>' if outer else ''}{before}"
    page += f"<{tag} {attributes}>{''.join(body)}{furniture(1) if rng.random() < 0.5 else ''}</{tag}>{after}</body></html>"
    found = blocks(page)
    labels = np.array([mark in t for _, t, _ in found], dtype=float)
    return [(p, t.replace(mark, ""), k) for p, t, k in found], labels


def train(pages: list, seed: int = 11, epochs: int = EPOCHS) -> Labeller:
    """The labeller from sampled pages (as blocks) and as many pages again laid out from their texts."""
    rng = np.random.default_rng(seed)
    cases = []
    for page in pages:
        short = page if len(page) <= LONGEST else page[: LONGEST // 2] + page[-LONGEST // 2 :]
        if short:
            cases.append((short, np.array([is_main(p) for p, _, _ in short], dtype=float)))
    own = len(cases)
    texts = [" ".join(t.split()[:60]) for page, _ in cases for _, t, _ in page] or ["a text"]
    for _ in range(max(3 * own, MADE)):
        some = [texts[i] for i in rng.integers(0, len(texts), 12)]
        page, labels = laid_out(some, rng)
        if page:
            cases.append((page, labels))
    # a small sample counts as often as a full one would
    cases += cases[:own] * (SAMPLE // max(1, own) - 1)
    model, path_ids, word_ids = Labeller(rng), PathIds(), WordIds()
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-3
        # pages of like length go together, so that few steps run for few pages
        order = np.argsort([len(c[0]) * rng.uniform(0.8, 1.25) for c in cases])
        batches = np.array_split(order, max(1, len(cases) // BATCH))
        for i in rng.permutation(len(batches)):
            batch = batches[i]
            some = [cases[i][0] for i in batch]
            # half of the blocks are learned without their words, so that names and places carry the decision
            f = features([[(p, t if rng.random() < 0.5 else t[-1:], k) for p, t, k in page] for page in some], path_ids, word_ids)
            f = (*f[:2], np.concatenate([numbers(page) for page in some]))
            sizes = np.array([len(p) for p in some])
            grads = model.gradients(f, model.inputs(f), sizes, np.concatenate([cases[i][1] for i in batch]))
            for k, grad in grads.items():
                rows, g = grad if isinstance(grad, tuple) else (slice(None), grad)
                m, v = state[k]
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.99 * v[rows] + 0.01 * g * g
                model.p[k][rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-6)
    return model


def fit(pages: DataFrame, key: str = "page_id", column: str = "html", sample: int = SAMPLE) -> Labeller:
    """The labeller trained on a bounded sample of pages, the first ones in hash order."""
    rows = sampled(pages.where(F.col(column).isNotNull()).select(key, column), [key, column], sample).collect()
    model = train([blocks(r[1]) for r in rows])
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    full = [p for p in found if p]
    if not full:
        return [""] * len(pages)
    path_ids, word_ids = worker_state("html paths", PathIds), worker_state("html words", WordIds)
    x = model.inputs(features(full, path_ids, word_ids)).astype(np.float32)
    main = iter(model.run(x, np.array([len(p) for p in full])) > 0)
    return ["\n\n".join([t for (_, t, _), keep in zip(p, [next(main) for _ in p], strict=True) if keep]) for p in found]


def main_text(column: Column, model: Labeller, spark) -> Column:
    """Main text of a page; blocks in page order, an empty line between them."""
    load = ship(spark, model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = load()
        for some in batches:
            yield pd.Series(main_texts(labeller, [x or "" for x in some]), dtype=object)

    return run(column)


def extracted(pages: DataFrame, model: Labeller, column: str = "html", name: str = "text") -> DataFrame:
    """All columns and the main text."""
    return pages.withColumn(name, main_text(F.col(column), model, tuned(pages.sparkSession)))
