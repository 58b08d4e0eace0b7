"""Main text of web pages by a linear-chain CRF over the leaf blocks of the DOM.

A page becomes a chain of leaf blocks: runs of text between block-level tags. A block's
features are its ancestors' tags and the words in their class, id and role, and its text:
length, share of links, punctuation, place on the page; those of its neighbours count too.
The field is trained on labelled pages and the best labels are decoded by Viterbi.

Labelled pages are made by a seeded generator of page layouts (menus, notices, adverts,
sidebars, forms, comments, footers around and inside articles) and, from the table itself, a
bounded sample of pages that mark their article; there the blocks inside it are the main text.
The sample is of rows of any length with at most SAMPLE_BLOCKS blocks together; tasks send on its
features, not its pages.

Cases: null, empty and blank html and pages without a good block give the empty text;
comments, scripts, styles and tags that never close end with the page, others where browsers end them
(a comment at once after its dashes or at ``--!>``, a script at any end tag of its name); what stands in scripts, styles,
templates, drawings, frames and text areas is shown by no browser as text, or is a form's, and goes; a quote opens a value
only after an equals sign, so one inside a bare value is part of it; unknown tags are
inline, and what stands in math, objects, canvases and noscript is text like other; very long pages
are parsed whole in one task, in time proportional to their length; pages of equal html give equal
texts, and of labels that fit equally well the block is left out; repeated rows are extracted each;
an empty table gives no rows; other columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .crf import Chains, Crf
from .textkit import pieces

SAMPLE_PAGES, SAMPLE_BLOCKS, MADE_PAGES = 200, 200_000, 400  # training pages from the table (about, those of least hash), their blocks, and pages from the generator

# Elements by kind, and words in attributes that tell what an element is for.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TAGS = "article main nav header footer aside form ul ol li table h1 h2 h3 p blockquote section div title head a button label figure dl pre".split()
HINTS = (
    r"\bnav|menu|breadcrumb|toolbar|pagination|pager",
    r"footer|copyright|legal|colophon",
    r"sidebar|aside|related|widget|recommend|trending|popular",
    r"\bads?\b|\bad[-_]|[-_]ad\b|advert|sponsor|promo|banner",
    r"comment|repl(?:y|ies)|discussion|disqus|respond|feedback",
    r"notice|cookie|consent|alert|newsletter|subscri|popup|modal|gdpr|warning",
    r"content|article|post|entry|story|\bmain\b|body|text",
    r"share|social|\btags?\b|meta|byline|author|toolbox|login|search",
    r"header|masthead|branding|logo|\btop\b",
    r"hidden|display\s*:\s*none|visually-hidden|sr-only",
)
_HINTS = [re.compile(h, re.I) for h in HINTS]
_TAG_BIT = {t: 1 << k for k, t in enumerate(TAGS)}
N_BITS = len(TAGS) + len(HINTS)
N_TEXT = 9

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|template|svg|iframe|textarea)(?=[\s/>])(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|style|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b", re.I)


@lru_cache(20_000)
def _bits(tag: str, attributes: str) -> int:
    bits = _TAG_BIT.get(tag, 0)
    if attributes:
        said = " ".join(a or b for a, b in _ATTRIBUTE.findall(attributes))
        if said:
            for k, hint in enumerate(_HINTS):
                if hint.search(said):
                    bits |= 1 << (len(TAGS) + k)
    return bits


def blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, bits of its ancestors, share of its characters in links) of each leaf block."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = []
    holders: list[int] = []  # places of block elements in the stack
    opened: Counter[str] = Counter()
    bits, held, linked, in_link = 0, [], 0, 0

    def close() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, bits, min(1.0, linked / max(1, len(text)))))
        held, linked = [], 0

    def pop(to: int) -> None:
        nonlocal bits, in_link
        for name, _ in stack[to:]:
            in_link -= name == "a"
            opened[name] -= 1
        del stack[to:]
        while holders and holders[-1] >= to:
            holders.pop()
        bits = stack[-1][1] if stack else 0

    for found in _TOKEN.finditer(page):
        shut, tag, attributes = found.group(2, 3, 4)
        if tag is None:
            text = found.group()
            if text[0] != "<" or text == "<":
                held.append(entities.unescape(text))  # a reference never goes on past a tag
                linked += in_link and len(text.strip())
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            close()
        if shut:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
            continue
        if tag in VOID:
            if tag == "br":  # the others part no words
                held.append(" ")
            continue
        if tag in BLOCKS:
            # A paragraph ends where a block begins; items and cells end their like.
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            if holders and stack[holders[-1]][0] in ("p", *ends):
                pop(holders[-1])
            holders.append(len(stack))
        stack.append((tag, bits | _bits(tag, attributes)))
        bits = stack[-1][1]
        opened[tag] += 1
        in_link += tag == "a"
    close()
    return out


def features(pages: list[list[tuple[str, int, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of features, first row of each page): own, of the block before and of the one after."""
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    n = int(first[-1])
    own = np.zeros((n, N_BITS + N_TEXT), np.float32)
    if n:
        flat = [b for p in pages for b in p]
        bits = np.array([b[1] for b in flat], np.uint64)
        own[:, :N_BITS] = (bits[:, None] >> np.arange(N_BITS, dtype=np.uint64)) & np.uint64(1)
        size = np.diff(first)
        place = np.arange(n) - np.repeat(first[:-1], size)
        words = np.array([b[0].count(" ") + 1 for b in flat], np.float32)
        chars = np.array([len(b[0]) for b in flat], np.float32)
        own[:, N_BITS] = np.log(words)
        own[:, N_BITS + 1] = [b[2] for b in flat]
        own[:, N_BITS + 2] = [b[0][-1] in ".!?:;\"'”»)" for b in flat]
        own[:, N_BITS + 3] = np.array([b[0].count(".") + b[0].count(",") for b in flat], np.float32) / words
        own[:, N_BITS + 4] = words < 4
        own[:, N_BITS + 5] = chars / words
        own[:, N_BITS + 6] = place / np.maximum(np.repeat(size, size) - 1, 1)
        own[:, N_BITS + 7] = [b[0][0].isupper() for b in flat]
        own[:, N_BITS + 8] = ["©" in b[0] or "(c)" in b[0].lower() for b in flat]
    width = N_BITS + N_TEXT
    x = np.zeros((n, 3 * width + 2), np.float32)
    x[:, :width] = own
    some = np.diff(first) > 0
    x[first[:-1][some], -2], x[first[1:][some] - 1, -1] = 1, 1
    if n > 1:
        page = np.repeat(np.arange(len(pages)), np.diff(first))
        joined = page[1:] == page[:-1]
        x[1:, width : 2 * width][joined] = own[:-1][joined]
        x[:-1, 2 * width : 3 * width][joined] = own[1:][joined]
    return x, first


def marked(page: list[tuple[str, int, float]]) -> list[int] | None:
    """Labels of a page that marks its article, or None: blocks inside it, but for those in parts of
    it that are for something else."""
    inside = _TAG_BIT["article"] | _TAG_BIT["main"]
    other = sum(_TAG_BIT[t] for t in ("nav", "header", "footer", "aside", "form", "button")) | sum(1 << (len(TAGS) + k) for k in (0, 1, 2, 3, 4, 5, 9))
    y = [int(bool(bits & inside) and not bits & other) for _, bits, _ in page]
    return y if any(y) else None


def made_pages(n: int, seed: int = 11) -> list[tuple[list[tuple[str, int, float]], list[int]]]:
    """Seeded pages of many layouts, with the labels of their blocks."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("etaoinshrdlucmfwypvbgkéàüñ"))

    def words(a: int, b: int, end: str = ".") -> str:
        out = ["".join(rng.choice(letters, rng.integers(1, 10))) for _ in range(rng.integers(a, b))]
        return " ".join([out[0].capitalize(), *out[1:]]) + end

    def pick(*options):
        return options[rng.integers(len(options))]

    pages = []
    for _ in range(n):
        good: set[str] = set()

        def text(a: int, b: int, end: str = ".", keep: bool = False) -> str:
            t = words(a, b, end)
            if keep:
                good.add(t)
            return t

        def links(k: int) -> str:
            return "".join(f"<li><a href='#'>{words(1, 4, '')}</a></li>" for _ in range(k))

        def body() -> str:
            parts = [f"<h1>{text(3, 14, '', True)}</h1>"] if rng.random() < 0.8 else []
            for _ in range(rng.integers(1, 9)):
                kind = rng.random()
                if kind < 0.72:
                    parts.append(f"<p>{text(1 if kind < 0.1 else 8, 90, keep=True)}" + pick("</p>", "", "</p>\n"))
                elif kind < 0.8:
                    parts.append(f"<h{rng.integers(2, 4)}>{text(2, 8, '', True)}</h2>".replace("</h2>", pick("</h2>", "</h3>")))
                elif kind < 0.86:
                    parts.append(f"<blockquote>{text(8, 40, keep=True)}</blockquote>")
                elif kind < 0.92:
                    parts.append("<ul>" + "".join(f"<li>{text(3, 16, keep=True)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
                elif kind < 0.95:
                    parts.append(f"<div class='{pick('ad', 'advert', 'promo-box', 'ad-slot')}'>{text(2, 14)}</div>")
                elif kind < 0.97:
                    parts.append(f"<form><label>{text(2, 8, '')}</label><button>{text(1, 3, '')}</button></form>")
                else:
                    parts.append(f"<aside><h3>{text(2, 4, '')}</h3><ul>{links(3)}</ul></aside>")
            return "".join(parts)

        comments = lambda: f"<{(t := pick('section', 'div'))} {pick('id', 'class')}='{pick('comments', 'comment-list', 'discussion', 'reader-comments', 'replies')}'><h3>{text(1, 3, '')}</h3>" + "".join(f"<div class='comment'><p>{text(3, 40)}</p></div>" if rng.random() < 0.6 else f"<p>{text(3, 40)}</p>" for _ in range(rng.integers(1, 5))) + f"</{t}>"
        inner = body()
        if rng.random() < 0.25:
            inner += comments()
        holder = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='post-body'>", "</div>"), ("<div class='entry-text'>", "</div>"))
        parts = [f"<title>{text(3, 10, '')}</title>"]
        if rng.random() < 0.5:
            parts.append(f"<header><{(h := pick('h1', 'h2', 'div'))}>{text(1, 4, '')}</{h}>" + (f"<p>{text(3, 8)}</p>" if rng.random() < 0.4 else "") + "</header>")
        if rng.random() < 0.85:
            parts.append(f"<{(t := pick('nav', 'nav', 'div class=menu'))}><ul>{links(rng.integers(3, 8))}</ul></{t.split()[0]}>")
        if rng.random() < 0.4:
            parts.append(f"<div class='{pick('cookie-notice', 'notice', 'alert', 'newsletter', 'consent-banner')}'><p>{text(5, 30)}</p></div>")
        if rng.random() < 0.6:
            parts.append(f"<div class='{pick('ad', 'advert', 'sponsor', 'banner-ad')}'>{text(2, 20)}</div>")
        side = f"<{(t := pick('aside', 'div class=sidebar', 'div id=related'))}><h3>{text(1, 4, '')}</h3>" + pick(f"<ul>{links(4)}</ul>", f"<p>{text(5, 30)}</p>") + f"</{t.split()[0]}>" if rng.random() < 0.5 else ""
        before = rng.random() < 0.4
        parts += [side if before else "", holder[0] + inner + holder[1], "" if before else side]
        if rng.random() < 0.35:
            parts.append(comments())
        if rng.random() < 0.3:
            parts.append(f"<form><label>{text(2, 8, '')}</label><p>{text(4, 12)}</p><button>{text(1, 2, '')}</button></form>")
        if rng.random() < 0.9:
            parts.append(f"<{(t := pick('footer', 'footer', 'div class=footer'))}>" + pick(f"&copy; {text(2, 14)}", f"<p>{text(3, 20)}</p>", f"<ul>{links(3)}</ul><p>© {text(2, 8)}</p>") + f"</{t.split()[0]}>")
        found = blocks("<html><body>" + "".join(parts) + "</body></html>")
        pages.append((found, [int(t in good) for t, _, _ in found]))
    return pages


def fit(pages: DataFrame) -> Crf:
    """The field, from made pages and a bounded sample of pages that mark their article."""
    made = made_pages(MADE_PAGES)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html is not null")
    picked = common.hash_sample(known, SAMPLE_PAGES, pages.count(), "page_id", "html")

    def learned(batches):
        for batch in batches:
            for k, page in enumerate(batch.column(1).to_pylist()):
                found = blocks(page)
                y = marked(found)
                if y is not None:
                    x = features([found])[0]
                    yield pa.RecordBatch.from_pydict({"page_id": batch.column(0)[k : k + 1], "n": pa.array([len(y)], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([bytes(y)], pa.binary())})

    found = picked.mapInArrow(common.tidy(learned), "page_id long, n int, x binary, y binary")
    held = common.settle(found.withColumn("key", F.xxhash64("page_id", "x", "y")), "blocks")
    rows = sorted(common.within(held, "key", "n", SAMPLE_BLOCKS).collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["x"], r["y"]))
    x, first = features([p for p, _ in made])
    x = np.concatenate([x, *(np.frombuffer(r["x"], np.float32).reshape(-1, x.shape[1]) for r in rows)])
    y = np.array([v for _, labels in made for v in labels] + [v for r in rows for v in r["y"]], np.int64)
    first = np.concatenate([first, first[-1] + np.cumsum([len(r["y"]) for r in rows], dtype=np.int64)])
    return Crf(x.shape[1]).fit(x, y, first, rounds=120)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def extracted(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                found = [blocks(h) if h else [] for h in piece.column(2).to_pylist()]
                x, first = features(found)
                y = model.viterbi(x, Chains(first)) if len(x) else np.zeros(0, np.int8)
                text = ["\n\n".join(b[0] for b, keep in zip(p, y[a : a + len(p)].tolist()) if keep) for p, a in zip(found, first.tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(common.tidy(extracted), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
