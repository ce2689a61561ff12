"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: the runs of text between block-level tags, with the open tags above them. Features are
the tags and class or id words above a block and statistics of its text. The field has two labels (article or not), is
trained on labelled pages that this module authors from templates (`labelled_pages`, seeded, `PAGES` of them) and
decoded by Viterbi; the blocks of the article are joined by line feeds.

Null or empty html gives an empty text, and so does a page without article blocks. Character references are decoded
once. An unfinished tag at the end is markup. A form that holds parts of a page (an article, a menu, a footer), or most of
its words with few of them in labels and buttons, is the page's own frame and no sign against what stands in it. Repeated rows are extracted as
rows of their own, an empty table gives none, and other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches

PAGES, STEPS, RATE, L2 = 400, 150, 0.15, 1e-3

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page; without an end tag it reaches to the page's end, as in HTML.
RAW_TAGS = frozenset("script style template textarea title noscript iframe".split())
#: Their content is no text of the page if they end; else the page goes on after the start tag.
EMBEDDED_TAGS = frozenset("svg object canvas audio video".split())
#: What an opening tag closes if open, up to the tags that hold such tags.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A quote that nothing closes within its tag is part of the tag.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|["'](?=[^"'<>]*>))*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

FEATURE_TAGS = "article main section nav header footer aside form ul ol li table h1 h2 h3 p blockquote pre figure figcaption button label select dl div a body".split()
#: Words of class, id and role values, by what they speak of.
WORDS = {
    "content": "content article post entry story text main prose body",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "top": "header masthead top topbar banner branding logo hero",
    "bottom": "footer bottom colophon copyright legal imprint",
    "side": "sidebar side aside rail widget widgets related recommended more trending popular",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner warning disclaimer",
    "social": "share sharing social follow like tweet",
    "reader": "comment comments reply replies discussion disqus respond commentlist feedback",
    "form": "form search login signup subscribe newsletter register contact",
}
WORD_KIND = {w: k for k, words in WORDS.items() for w in words.split()}
#: Parts of a page that no form for entries holds.
PAGE_PARTS = frozenset("article main nav header footer".split())
LINKED, SIZED = (0.0, 0.3, 0.7), (2, 5, 12, 30, 80)
FEATURES = ["one", *(f"in_{t}" for t in FEATURE_TAGS), *(f"on_{t}" for t in FEATURE_TAGS), *(f"word_{k}" for k in WORDS), *(f"linked_{x}" for x in LINKED), *(f"words_{x}" for x in SIZED), "stop_at_end", "copyright", "first", "last", "bare_header", "inside_article", "page_form"]
INDEX = {f: i for i, f in enumerate(FEATURES)}


class Open:
    """An open tag: what holds for all that it contains."""

    __slots__ = ("above", "form", "frames", "holder", "kinds", "name")

    def __init__(self, name: str, words: list[str], over: Open | None):
        self.name = name
        self.above = over.above if over else frozenset()
        if name not in self.above:
            self.above |= {name}
        self.kinds = over.kinds if over else frozenset()
        if new := {WORD_KIND[w] for w in words if w in WORD_KIND} - self.kinds:
            self.kinds |= new
        self.holder = name if name in BLOCK_TAGS else over.holder if over else "body"
        self.form = over.form if over and over.form else self if name == "form" else None  # the outermost one
        self.frames = False
        if self.form and name in PAGE_PARTS:
            self.form.frames = True


class Block:
    __slots__ = ("above", "form", "holder", "kinds", "linked", "text")

    def __init__(self, text: str, inner: Open | None, linked: float):
        self.text, self.linked = text, linked
        self.above, self.kinds, self.holder, self.form = (inner.above, inner.kinds, inner.holder, inner.form) if inner else (frozenset(), frozenset(), "body", None)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, white space folded, none empty."""
    out: list[Block] = []
    stack: list[Open] = []
    open_tags: Counter[str] = Counter()
    run: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked / max(1, sum(map(len, run)))))
            run.clear()
        linked = 0

    def cut(at: int) -> None:
        for x in stack[at:]:
            open_tags[x.name] -= 1
        del stack[at:]

    def leave(names: set[str] | frozenset[str], holders: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes the outermost of `names` that is open inside the nearest of `holders`."""
        if not any(open_tags[x] for x in names):
            return
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in holders:
                break
            if stack[i].name in names:
                found = i
        if found >= 0:
            cut(found)

    at, raw, unclosed = 0, None, set()
    while True:
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif raw in RAW_TAGS:
                break
            else:
                unclosed.add(raw)
            raw = None
        tag = TAG.search(page, at)
        piece = page[at : tag.start() if tag else len(page)]
        if piece:
            run.append(piece)
            if open_tags["a"]:
                linked += len(piece)
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK_TAGS:
                close()
            if open_tags[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        cut(i)
                        break
                    if name not in BLOCK_TAGS and stack[i].name in BLOCK_TAGS:
                        break
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in RAW_TAGS or name in EMBEDDED_TAGS:
            run.append(" ")
            if not tag[3].rstrip().endswith("/") and name not in unclosed:
                raw = name
            continue
        if name in BLOCK_TAGS:
            close()
            leave({"p"}, {"button", "table", "td", "th"})
            if name in CLOSED_BY:
                leave(*CLOSED_BY[name])
        if name not in VOID_TAGS:
            given = tag[3]
            words = [w for m in NAMES.finditer(given) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())] if "=" in given else []
            stack.append(Open(name, words, stack[-1] if stack else None))
            open_tags[name] += 1
    close()
    return out


def feature_rows(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features that hold, block by block."""
    out = []
    words: Counter[Open | None] = Counter()
    asked: Counter[Open | None] = Counter()
    for b in blocks:
        n = b.text.count(" ") + 1
        words[b.form] += n
        asked[b.form] += n * (b.holder in ("label", "button", "option"))
    framing = {f for f, n in words.items() if f and (f.frames or 2 * n > words.total() and 4 * asked[f] < n)}
    for i, b in enumerate(blocks):
        found = [INDEX["one"]]
        above = b.above
        framed = b.form in framing
        found += [INDEX[f"in_{t}"] for t in FEATURE_TAGS if t in above and not (framed and t == "form")]
        if framed:
            found.append(INDEX["page_form"])
        if f"on_{b.holder}" in INDEX and not (framed and b.holder == "form"):
            found.append(INDEX[f"on_{b.holder}"])
        found += [INDEX[f"word_{kind}"] for kind in sorted(b.kinds)]
        found += [INDEX[f"linked_{x}"] for x in LINKED if b.linked > x]
        size = b.text.count(" ") + 1
        found += [INDEX[f"words_{x}"] for x in SIZED if size >= x]
        if b.text[-1] in ".!?":
            found.append(INDEX["stop_at_end"])
        if "©" in b.text or "copyright" in b.text.lower():
            found.append(INDEX["copyright"])
        if i == 0:
            found.append(INDEX["first"])
        if i == len(blocks) - 1:
            found.append(INDEX["last"])
        article = "article" in above or "main" in above
        if article:
            found.append(INDEX["inside_article"])
        elif "header" in above:
            found.append(INDEX["bare_header"])
        out.append(found)
    return out


def emissions(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    return np.array([weights[:, r].sum(1) for r in rows]).reshape(-1, 2)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best labels of a chain; ties stay with label 0."""
    a, b = scores[0].tolist()
    (m00, m01), (m10, m11) = moves.tolist()
    back = []
    for x, y in scores[1:].tolist():
        from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
        a, b = (a + m00 if from0 == 0 else b + m10) + x, (a + m01 if from1 == 0 else b + m11) + y
        back.append((from0, from1))
    label = 0 if a >= b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def fit_field(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (2, features) and moves (2, 2) that maximise the labels' conditional likelihood (Adam)."""
    n, longest = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, longest, len(FEATURES)))
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, r in enumerate(rows):
            x[i, j, r] = 1
        y[i, : len(labels)] = labels
        live[i, : len(labels)] = True
    gold = np.eye(2)[y] * live[..., None]
    pairs = live[:, 1:]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    weights, moves = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    first = [np.zeros_like(weights), np.zeros_like(moves)]
    second = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        e = x @ weights.T
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            here = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            forward[:, t] = np.where(live[:, t, None], here, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            here = np.logaddexp.reduce(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], here, 0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - whole[:, None, None]) * live[..., None]
        joint = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = np.einsum("ntab->ab", np.exp(np.where(pairs[..., None, None], joint, -np.inf)))
        slopes = [np.einsum("ntk,ntf->kf", gold - chance, x) / n - l2 * weights, (gold_moves - expected) / n - l2 * moves]
        for k, (value, slope) in enumerate(zip((weights, moves), slopes)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            value += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Authored pages and the label of each of their leaf blocks."""
    rng = random.Random(seed)
    sounds = "an be da er fi go hu in ka lo mi no or pe ra sa te un va wi".split()

    def word() -> str:
        return "".join(rng.choices(sounds, k=rng.randint(1, 3))) + rng.choice(["", "", "", "", "###", "12", "!"])

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence(low: int = 1, high: int = 40) -> str:
        text = words(low, high) + rng.choice([".", ".", ".", "", "!"])
        return text.upper() if rng.random() < 0.1 else text.capitalize()

    def tag(name: str, inner: str, *kinds: str) -> str:
        named = rng.choice(kinds) if kinds else ""
        return f'<{name} {rng.choice(["class", "id"])}="{named}">{inner}</{name}>' if named else f"<{name}>{inner}</{name}>"

    def pick(kind: str) -> str:
        return rng.choice(WORDS[kind].split())

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def entry() -> tuple[str, list[int]]:
        told = rng.choice(["<p>{}</p>", "<h3>{}</h3>", "<div>{}</div>", "<li>{}</li>", "{}"]).format(sentence(2, 25))
        return f"<form>{told}<p>{words(1, 8)}</p><input><button>{words(1, 2)}</button></form>", [0, 0, 0]

    def article() -> list[tuple[str, list[int]]]:
        parts = [(f"<h1>{words(2, 12)}</h1>", [1])]
        if rng.random() < 0.2:
            parts[0] = (f"<header>{parts[0][0]}</header>", [1])
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            shape = rng.random()
            if shape < 0.6:
                parts.append((f"<p>{sentence()}</p>", [1]))
            elif shape < 0.66:
                parts.append((f"<h2>{words(1, 6)}</h2>", [1]))
            elif shape < 0.71:
                n = rng.randint(1, 4)
                parts.append(("<ul>" + "".join(f"<li>{sentence(2, 15)}</li>" for _ in range(n)) + "</ul>", [1] * n))
            elif shape < 0.76:
                parts.append((f"<blockquote>{sentence()}</blockquote>", [1]))
            elif shape < 0.8:
                parts.append((f"<p>{sentence(3, 9)} <a href='/y'>{words(1, 4)}</a> {sentence(1, 9)}</p>", [1]))
            elif shape < 0.84:
                parts.append(("<p>" + rng.choice(["All rights reserved.", "Copyright notice.", "Licensed under terms."]) + "</p>", [1]))
            elif shape < 0.88:
                parts.append((f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", [1, 1]))
            elif shape < 0.92:
                parts.append((tag("div", sentence(2, 20), pick("advert")), [0]))
            elif shape < 0.95:
                parts.append((tag("aside", f"<p>{sentence(2, 20)}</p>", "", pick("side")), [0]))
            elif shape < 0.97:
                parts.append((tag("div", f"<a href='/s'>{words(1, 2)}</a>", pick("social")), [0]))
            elif shape < 0.985:
                parts.append(entry())
            else:
                parts.append((f"<pre>{sentence(3, 20)}</pre>", [1]))
        return parts

    def remarks() -> tuple[str, list[int]]:
        n = rng.randint(1, 4)
        inner = "".join(rng.choice(["<div>{}</div>", "<p>{}</p>", "<li>{}</li>", "<article><p>{}</p></article>"]).format(sentence(3, 40)) for _ in range(n))
        return tag(rng.choice(["section", "div", "ul", "ol"]), inner, pick("reader")), [0] * n

    def joined(parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        return "".join(p for p, _ in parts), [x for _, labels in parts for x in labels]

    pages = []
    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []
        if rng.random() < 0.4:
            parts.append((tag("header", f"<p>{words(1, 8)}</p>", "", pick("top")) if rng.random() < 0.6 else tag("div", words(1, 8), pick("top")), [0]))
        if rng.random() < 0.8:
            n = rng.randint(1, 7)
            parts.append((tag(rng.choice(["nav", "nav", "div"]), links(n), pick("menu")) if rng.random() < 0.5 else f"<nav>{links(n)}</nav>", [0] * n))
        if rng.random() < 0.3:
            parts.append((tag("div", f"<p>{sentence(4, 25)}</p>", pick("notice")), [0]))
        if rng.random() < 0.6:
            parts.append((tag("div", sentence(3, 20), pick("advert")), [0]))
        if rng.random() < 0.2:
            parts.append((f"<form><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>", [0, 0]))
        inner, labels = joined(article() + ([remarks()] if rng.random() < 0.15 else []))
        shell = rng.random()
        if shell < 0.55:
            parts.append((tag("article", inner, "", "", pick("content")), labels))
        elif shell < 0.7:
            parts.append((f"<main>{inner}</main>", labels))
        elif shell < 0.9:
            parts.append((tag("div", inner, pick("content")), labels))
        else:
            parts.append((inner, labels))
        if rng.random() < 0.3:
            n = rng.randint(1, 5)
            parts.append((tag(rng.choice(["aside", "div"]), f"<p>{sentence(3, 25)}</p>" + links(n), pick("side")), [0] * (n + 1)))
        if rng.random() < 0.35:
            parts.append(remarks())
        if rng.random() < 0.15:
            parts.append((tag("div", f"<p>{sentence(4, 25)}</p><button>{words(1, 2)}</button>", pick("form")), [0, 0]))
        if rng.random() < 0.85:
            end = rng.choice(["&copy; ", "Copyright ", ""]) + sentence(2, 15)
            parts.append((f"<footer>{end}</footer>" if rng.random() < 0.7 else tag("div", f"<p>{end}</p>", pick("bottom")), [0]))
        if rng.random() < 0.1:
            parts.insert(rng.randint(0, len(parts)), entry())
        inner, labels = joined(parts)
        if rng.random() < 0.12 and "<form" not in inner:
            inner = f'<form method="post" action="/x" {rng.choice(["id", "class"])}="{rng.choice(["form1", "aspnetForm", "form", "page"])}"><input type="hidden">{inner}</form>'
        pages.append((f"<html><head><title>{words(1, 4)}</title></head><body>{inner}</body></html>", labels))
    return pages


@lru_cache(maxsize=1)
def trained_field() -> tuple[np.ndarray, np.ndarray]:
    rows = []
    for page, labels in labelled_pages():
        found = blocks_of(page)
        if len(found) != len(labels):
            raise AssertionError("an authored page has other blocks than labels")
        rows.append((feature_rows(found), labels))
    return fit_field(rows)


def main_text(page: str | None, field: tuple[np.ndarray, np.ndarray]) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    weights, moves = field
    labels = viterbi(emissions(weights, feature_rows(blocks)), moves)
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    field = trained_field()  # a few hundred numbers, trained on the driver

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            texts = [main_text(p, field) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
