"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is described by a hashed vector of its tag path (tags
and words of class, id and role), a hashed vector of its words and a few ratios; a bidirectional LSTM reads the
sequence from both sides and labels every block as main text or not. Training pages come from a bounded sample,
labelled by what their paths say, and from made-up sequences of the same texts in other layouts.

Null and empty pages, and pages without a main block, give an empty text. Unclosed tags, comments and scripts end
where a browser would end them. Only elements of raw text are dropped; what stands in drawings, objects, canvases and
templates is labelled like other blocks, and formulas belong to the text around them. Repeated rows are extracted alike; other columns are kept.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import hash63, map_arrow, sliced

SAMPLE_PAGES, SAMPLE_BLOCKS, MADE_UP, HIDDEN, EPOCHS, BATCH, SEED = 120, 40, 420, 12, 10, 32, 7
PATH_DIMS, WORD_DIMS = 64, 16
DIMS = PATH_DIMS + WORD_DIMS + 5

# fixed values: element kinds of the HTML standard
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = "script|style|iframe|noembed|noframes"
CLOSE_THEMSELVES = frozenset("svg object canvas template".split())  # by "/>", and everything inside svg
# an opening tag of the key closes an open element of the values
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}}
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# words in a path that speak against or for main text, as labels of the training sample
AGAINST = frozenset("""head nav header footer aside form script style noscript button select textarea ad ads advert advertisement adverts adv banner promo promotion sponsor sponsored
    cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond disqus sidebar menu breadcrumb breadcrumbs share sharing social
    related recommended newsletter subscribe signup login search pagination pager copyright widget toolbar""".split())
FOR = frozenset("article main content post entry story articlebody maincontent".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|(?P<open><(?P<drop>%s)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)(?:.*?</(?P=drop)(?=[\s/>])[^>]*+>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>/?[a-zA-Z][a-zA-Z0-9:-]*)[^>]*+>|<[!?/][^>]*+>" % DROPPED, re.S | re.I)
_NO_TEXT = re.compile(r"(?:\s*+<(?!/?svg[\s/>])[^<>]*+>)*+\s*+</svg\s*>", re.I)  # the rest of a drawing without text
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks of a page in order: words of the tag path, text, characters inside links."""
    out, stack, parts, linked, at = [], [], [], 0, 0
    page = page or ""

    def flush():
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((tuple(w for _, words in stack for w in words), text, min(linked, len(text))))
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text)

    while m := _TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if m["drop"] and page[m.end("open") - 2] == "/" and any(tag == "svg" for tag, _ in stack):
            at = m.end("open")
        tag = (m["tag"] or m["odd"] or "").lower()
        close = m["close"] == "/" or tag.startswith("/")
        tag = tag.lstrip("/")
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a" and close:
                _pop(stack, {"a"})
            elif tag == "a":
                _pop(stack, {"a"})
                stack.append(("a", ()))
            continue
        closed = not close and page[m.end() - 2] == "/"
        if tag == "svg" and not close and (closed or (rest := _NO_TEXT.match(page, at))):
            at = at if closed else rest.end()
            continue
        flush()
        if tag in VOID or closed and (tag in CLOSE_THEMSELVES or any(t == "svg" for t, _ in stack)):
            continue
        if close:
            _pop(stack, {tag})
            continue
        if tag in P_CLOSERS:
            _pop(stack, {"p"})
        if tag in CLOSES:
            _pop(stack, CLOSES[tag], every=True)
        words = [tag]
        if m["attrs"]:
            for a in _ATTR.findall(m["attrs"]):
                words += [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", a[0] or a[1] or a[2])]
        stack.append((tag, tuple(words)))
    add(page[at:])
    flush()
    return out


# elements that hold what is inside: a tag to be closed is not sought outside of them
_WALLS = frozenset("table ul ol dl td th article section div body html main nav aside footer header form".split())


def _pop(stack: list, tags: set[str], every: bool = False) -> None:
    """Close the innermost open element of `tags` (with `every`, all up to the next wall), and what is inside it."""
    found = None
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            found = i
            if not every:
                break
        elif stack[i][0] in _WALLS and (every or tags & {"p", "a"}):
            break
    if found is not None:
        del stack[found:]


def path_label(path: tuple[str, ...]) -> bool:
    """What the words of a path say about a block: inside an article and in no part against it."""
    return not AGAINST.intersection(path) and bool(FOR.intersection(path))


class Features:
    """Vectors of blocks; those of paths and words are kept."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def of(self, page: list[tuple]) -> np.ndarray:
        x = np.zeros((len(page), DIMS), np.float32)
        for i, (path, text, linked) in enumerate(page):
            v = self.paths.get(path)
            if v is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                v = np.zeros(PATH_DIMS, np.float32)
                for w in path:
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
                    h = zlib.crc32(b"2" + w.encode("utf-8", "surrogatepass"))
                    v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
                self.paths[path] = v = np.clip(v, -2, 2)
            x[i, :PATH_DIMS] = v
            tokens = text.split(" ")
            if len(self.words) > 200_000:
                self.words.clear()
            ids = []
            for w in tokens:
                h = self.words.get(w)
                if h is None:
                    h = self.words[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIMS
                ids.append(h)
            x[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.bincount(ids, minlength=WORD_DIMS) / len(tokens)
            x[i, -5:] = np.log1p(len(text)) / 5, linked / len(text), min(len(tokens), 100) / 100, (i + 1) / len(page), text[-1] in ".!?:"
        return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", r.normal(0, 0.15, (DIMS, 4 * h))), ("h", r.normal(0, 0.2, (h, 4 * h))), ("c", np.zeros(4 * h)))}
        self.w |= {"o": r.normal(0, 0.2, 2 * h), "ob": np.zeros(1)}
        for d in "fb":
            self.w[f"c{d}"][h:2 * h] = 1  # remember at first
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits (batch, time). x: (batch, time, DIMS), padded at the end."""
        b, t, _ = x.shape
        back = np.where(np.arange(t) < lengths[:, None], lengths[:, None] - 1 - np.arange(t), np.arange(t))
        rows = np.arange(b)[:, None]
        logits, kept = np.full((b, t), self.w["ob"][0]), {}
        for d, view in (("f", x), ("b", x[rows, back])):
            z, w = view @ self.w[f"x{d}"] + self.w[f"c{d}"], self.w[f"h{d}"]
            h, c, steps, hs = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), [], np.zeros((b, t, HIDDEN), np.float32)
            for k in range(t):
                a = z[:, k] + h @ w
                s = _sigmoid(a[:, :3 * HIDDEN])
                i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
                new = f * c + i * g
                tc = np.tanh(new)
                if keep:
                    steps.append((i, f, o, g, c, tc, h))
                h, c = o * tc, new
                hs[:, k] = h
            hs = hs if d == "f" else hs[rows, back]
            logits = logits + hs @ self.w["o"][:HIDDEN] if d == "f" else logits + hs @ self.w["o"][HIDDEN:]
            kept[d] = view, steps, hs
        return (logits, kept, rows, back) if keep else logits

    def gradients(self, x, lengths, y):
        b, t, _ = x.shape
        logits, kept, rows, back = self.run(x, lengths, keep=True)
        mask = np.arange(t) < lengths[:, None]
        dl = np.where(mask, _sigmoid(logits) - y, 0).astype(np.float32) / mask.sum()
        g = {"ob": np.array([dl.sum()], np.float32), "o": np.concatenate([np.einsum("bt,bth->h", dl, kept[d][2]) for d in "fb"])}
        for d, o in (("f", self.w["o"][:HIDDEN]), ("b", self.w["o"][HIDDEN:])):
            view, steps, _ = kept[d]
            own = dl if d == "f" else dl[rows, back]
            da = np.zeros((b, t, 4 * HIDDEN), np.float32)
            dh, dc, gh = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), np.zeros_like(self.w[f"h{d}"])
            for k in reversed(range(t)):
                i, f, og, gg, c, tc, h = steps[k]
                dh = dh + own[:, k, None] * o
                dc = dc + dh * og * (1 - tc * tc)
                da[:, k] = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * og * (1 - og), dc * i * (1 - gg * gg)], 1)
                gh += h.T @ da[:, k]
                dh, dc = da[:, k] @ self.w[f"h{d}"].T, dc * f
            g |= {f"h{d}": gh, f"c{d}": da.sum((0, 1)), f"x{d}": np.einsum("btd,btz->dz", view, da, optimize=True)}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over padded batches of (features, labels)."""
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = sorted(r.permutation(len(pages)), key=lambda i: len(pages[i][1]))  # batches of like lengths, shuffled
            for at in r.permutation(range(0, len(order), BATCH)):
                x, y, n = padded([pages[i] for i in order[at:at + BATCH]])
                step += 1
                for k, g in self.gradients(x, n, y).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)


def padded(pages):
    n = np.array([len(y) for _, y in pages])
    x, y = np.zeros((len(pages), n.max(), DIMS), np.float32), np.zeros((len(pages), n.max()), np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, :len(b)], y[i, :len(b)] = a, b
    return x, y, n


# layouts of made-up training pages (fixed values): paths of parts around and inside a main part
_MAINS = [("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post", "content"), ("section", "entry"), ("div", "main"), ("div", "article", "body"), ("div", "main", "content"),
          ("div", "container", "article"), ("article", "post"), ("div", "story"), ("div", "wrapper", "main", "div", "entry")]
_INSIDE = [("p",)] * 8 + [("h1",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div", "p"), ("section", "p"), ()]
_OUTSIDE = [("head", "title"), ("nav", "ul", "li"), ("header",), ("header", "h1"), ("header", "p"), ("footer",), ("footer", "p"), ("aside",), ("aside", "p"), ("aside", "ul", "li"), ("div", "ad"), ("div", "ads"),
            ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("div", "promo"), ("div", "sponsored"), ("div", "cookie", "notice"), ("div", "cookie", "banner", "p"), ("div", "consent"), ("div", "notice"),
            ("form",), ("form", "p"), ("form", "label"), ("div", "newsletter"), ("form", "button"), ("div", "sidebar"), ("div", "sidebar", "p"), ("div", "menu"), ("ul", "menu", "li"), ("div", "breadcrumb"),
            ("div", "share"), ("div", "social"), ("div", "related", "p"), ("section", "related"), ("div", "popup"), ("noscript",), ("div", "pagination"), ("div", "widget"), ("div", "login"), ("div", "search"),
            ("section", "comments"), ("section", "comments", "p"), ("div", "comment"), ("div", "comments", "div", "comment", "p"), ("ol", "comment", "list", "li", "p"), ("div", "comments", "article", "comment", "p"),
            ("div", "reply"), ("section", "comments", "h2"), ("div", "disqus"), ("div", "id", "respond"), ("section", "reader", "comments", "article", "p")]


def made_up(texts: list[str], count: int, seed: int = SEED) -> list[tuple[list[tuple], list[bool]]]:
    """Block sequences in many layouts with texts of real pages."""
    r, out = np.random.default_rng(seed), []
    pick = lambda items: items[int(r.integers(len(items)))]
    outer = ("html", "body")

    def other(inside=()):
        path = pick(_OUTSIDE)
        return [((*outer, *(inside if path[0] != "head" else ()), *path), pick(texts)[:int(r.integers(8, 400))]) for _ in range(int(r.integers(1, 4)))]

    for _ in range(count):
        main, page, y = pick(_MAINS), [], []
        for _ in range(int(r.integers(1, 5))):
            new = other()
            page += new
            y += [False] * len(new)
        for _ in range(int(r.integers(1, 9))):
            if r.random() < 0.2:
                new = other(main)
                page += new
                y += [False] * len(new)
            else:
                page.append(((*outer, *main, *pick(_INSIDE)), pick(texts)))
                y.append(True)
        for _ in range(int(r.integers(0, 4))):
            new = other(main if r.random() < 0.2 else ())
            page += new
            y += [False] * len(new)
        out.append(([(p, t, len(t) if {"nav", "menu", "breadcrumb"} & set(p) else 0) for p, t in page if t], [k for k, (_, t) in zip(y, page) if t]))
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller trained on `sample_pages` pages at most, those with the least hash of the id, and `SAMPLE_BLOCKS` blocks of each."""
    def leaves(batches):
        for batch in batches:
            for b in map(blocks, batch.column("html").to_pylist()):
                b = [x for x in b if x[1]][:SAMPLE_BLOCKS]
                if b:
                    yield pa.RecordBatch.from_arrays([pa.array([[" ".join(p) for p, _, _ in b]], pa.list_(pa.string())), pa.array([[t[:600] for _, t, _ in b]], pa.list_(pa.string())),
                                                      pa.array([[n for _, _, n in b]], pa.list_(pa.int64()))], ["paths", "texts", "links"])

    # only ids are sorted; the pages are fetched by them
    chosen = pages.select("page_id").distinct().orderBy(hash63(F.col("page_id"), "pages"), "page_id").limit(sample_pages)
    sample = (pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").mapInArrow(leaves, "paths array<string>, texts array<string>, links array<bigint>")
              .limit(2 * sample_pages).collect())
    known = [[(tuple(p.split(" ")), t, min(n, len(t))) for p, t, n in zip(r.paths, r.texts, r.links)] for r in sorted(sample)]
    model, features = Labeller(), Features()
    texts = [t for page in known for _, t, _ in page] or ["Text."]
    train = [(page, [path_label(p) for p, _, _ in page]) for page in known] + made_up(texts, MADE_UP)
    model.fit([(features.of(page), np.array(y, np.float32)) for page, y in train if page])
    return model


def main_texts(pages: list[str | None], model: Labeller, features: Features, batch: int = 128) -> list[str]:
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = max(1, min(batch, 40_000 // len(found[order[min(at + batch, len(order)) - 1]])))
        own = order[at:at + n]
        x, _, lengths = padded([(features.of(found[i]), np.zeros(len(found[i]))) for i in own])
        logits = model.run(x, lengths)
        for k, i in enumerate(own):
            out[i] = "\n".join(t for (_, t, _), z in zip(found[i], logits[k]) if z > 0)
        at += n
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """The columns of the pages but html, with text and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields)

    def run(batches):
        features = Features()
        for b in sliced(batches, 512):
            texts = main_texts(b.column("html").to_pylist(), held.value, features)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return map_arrow(pages.select(*names, "html"), run, f"{schema}, text string, n_chars bigint")
