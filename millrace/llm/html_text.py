"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page, decoded by Viterbi.

A leaf block is a stretch of text between block-level tags. Its features are the tags, classes and ids above it and
what its text looks like; its tag is article text or not. The field is trained on labelled pages that are put together
here by rule from the parts that pages have: menus, headers, adverts, notices, forms, sidebars, articles, reader
comments and footers, in several mark-ups each.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Crf

# HTML's block-level elements, elements whose content is not text, and what an opening tag closes.
BLOCK_TAGS = frozenset("html head title body main article section nav header footer aside div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th form fieldset legend label figure figcaption address details summary dialog hr menu noscript select option textarea button".split())
RAW_TAGS = ("script", "style", "template", "svg", "iframe", "object", "math")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
#: Without an end tag these run to the end of the page; of the others only the tag itself is no text.
RAW_TO_END = frozenset(("script", "style"))
#: These are empty if their tag closes itself.
SELF_CLOSED = frozenset(("svg", "math"))
VOID_TAGS = frozenset(("hr",))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head", "title")}
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK_TAGS - {"label", "button", "select", "option", "textarea", "noscript"}
#: How far up an implied end may reach.
SCOPES = frozenset(("ul", "ol", "dl", "table", "html", "menu", "select"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW_TAGS) + r")(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<>]*(?:>|\Z)|)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
#: Elements that name a part of the page by themselves.
PARTS = frozenset(("article", "main", "aside", "nav", "header", "footer", "form", "table", "figure"))


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of linked text) of each leaf block that has text; path: (tag, class and id words) from the top."""
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    texts: list[str] = []
    linked = total = links = 0

    def flush() -> None:
        nonlocal linked, total
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append((tuple(stack), text, linked / max(1, total)))
            texts.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            total += len(text)
            linked += len(text) * bool(links)

    def close(names: tuple) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in SCOPES:
                return

    at, unclosed = 0, set()
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            raw = m[1].lower()
            if raw in SELF_CLOSED and m[2].endswith("/>"):
                continue
            end = None if raw in unclosed else RAW_END[raw].search(page, at)
            if end:
                at = end.end()
            elif raw in RAW_TO_END:
                at = len(page)
            else:
                unclosed.add(raw)
            continue
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag == "a":
            links = 0 if m[3] else 1
        elif tag in ("br", "img", "input", "wbr"):
            texts.append(" " if tag != "wbr" else "")
        elif tag in BLOCK_TAGS:
            flush()
            if m[3]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID_TAGS:
                if tag in ENDS_P and stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in CLOSES:
                    close(CLOSES[tag])
                if not m[5].rstrip().endswith("/") or tag != "p":
                    names = " ".join(a or b or c for a, b, c in NAMED.findall(m[5])).lower() if "=" in m[5] else ""
                    stack.append((tag, tuple(WORDS.findall(names)[:6])))
    add(page[at:])
    flush()
    return out


@lru_cache(1 << 14)
def _path_features(path: tuple) -> tuple:
    tags = list(dict.fromkeys(t for t, _ in path if t not in ("html", "body")))[-6:]
    names = list(dict.fromkeys(w for _, ws in path for w in ws))[-6:]
    last = path[-1][0] if path else "none"
    near = next((ws for _, ws in reversed(path) if ws), ())
    part = next(((t, ws) for t, ws in reversed(path) if t in PARTS or ws), ("none", ()))
    row = [f"t={last}", f"d={part[0]}|{bool(part[1])}", *(f"a={t}" for t in tags), *(f"w={w}" for w in names), *(f"n={w}" for w in near[:3])]
    return tuple(row + [""] * (17 - len(row)))


# Words of notices and forms.
CUES = re.compile(r"\b(?:cookies?|subscribe|newsletter|log in|sign up|sign in|privacy|terms|advertisement|sponsored|all rights reserved|copyright|reply|comments?|share|search|menu|related|skip to)\b|©", re.I)
SENTENCE = re.compile(r"[.!?…:][\"'”»)]?$")


def features(parts: list[tuple[tuple, str, float]]) -> list[list[str]]:
    rows = []
    for path, text, share in parts:
        size = len(text)
        bucket = next(k for k, top in enumerate((12, 30, 60, 120, 300, float("inf"))) if size <= top)
        rows.append([*_path_features(path), f"z={bucket}", f"l={int(share * 3 + 0.5)}", f"s={bool(SENTENCE.search(text[-3:]))}", f"c={size < 400 and bool(CUES.search(text))}", f"tn={path[-1][0] if path else 'none'}|{bucket}", "bias"])
    return rows


MARK = "\ue000"


def labelled_pages(n: int = 240, seed: int = 5) -> Iterator[str]:
    """Pages in which MARK stands in each block of the article."""
    r = random.Random(seed)
    stems = "al be cor du en fa gri ho is jun kel lo mar nu or pa qui ro sta tu ver wi xe yo zan".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(4, 14).capitalize() + r.choice((".", ".", ".", "!", "?")) for _ in range(r.randint(a, b)))

    def items(a: int, b: int, each) -> str:
        return "".join(f"<li>{each()}" + r.choice(("</li>", "</li>", "")) for _ in range(r.randint(a, b)))

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def menu() -> str:
        name = r.choice(("nav", "menu", "navbar", "site-nav", "breadcrumb"))
        return r.choice((f"<nav><ul>{items(3, 8, link)}</ul></nav>", f'<div class="{name}"><ul>{items(3, 8, link)}</ul></div>', f'<div id="{name}">{" | ".join(link() for _ in range(4))}</div>', f'<nav class="{name}">{link()} {link()}</nav>'))

    def top() -> str:
        return r.choice(("", f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>", f'<div class="header"><h2>{words(1, 3)}</h2><p>{sentences(1, 1)}</p></div>', f'<header id="top"><div class="logo">{words(1, 2)}</div>{menu()}</header>'))

    def advert() -> str:
        name = r.choice(("ad", "ads", "advert", "sponsored", "promo", "banner"))
        return r.choice(("", f'<div class="{name}">{sentences(1, 3)}</div>', f'<div class="{name}"><p>{sentences(1, 2)}</p></div>', f'<section id="{name}"><h3>{words(2, 4)}</h3><p>{sentences(1, 3)}</p></section>', f'<aside class="{name}">{sentences(1, 2)}</aside>'))

    def notice() -> str:
        name = r.choice(("cookie", "cookie-banner", "notice", "consent", "alert", "newsletter", "popup"))
        said = r.choice(("We use cookies. ", "Subscribe to our newsletter. ", "", "Please log in. "))
        return r.choice(("", f'<div class="{name}">{said}{sentences(1, 2)}</div>', f'<div id="{name}"><p>{said}{sentences(1, 3)}</p><button>{words(1, 2)}</button></div>', f'<div role="{name}">{said}{sentences(1, 2)}</div>'))

    def form() -> str:
        return r.choice(("", f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button></form>', f"<form><p>{sentences(1, 2)}</p><select><option>{words(1, 1)}<option>{words(1, 1)}</select><textarea>{words(2, 5)}</textarea></form>"))

    def side() -> str:
        name = r.choice(("sidebar", "side", "related", "widget", "recommended"))
        inner = r.choice((f"<h3>{words(1, 3)}</h3><ul>{items(2, 6, link)}</ul>", f"<h2>{words(1, 3)}</h2><p>{sentences(1, 3)}</p>", f"<p>{sentences(2, 4)}</p>"))
        return r.choice(("", f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<section id="{name}">{inner}</section>', f'<aside class="{name}">{inner}</aside>'))

    def comments() -> str:
        name = r.choice(("comments", "comment", "comment-list", "discussion", "responses", "replies"))

        def said() -> str:
            return f"<p>{sentences(1, 3)}</p>" + r.choice(("", f"<p>{words(1, 2)}</p>"))

        return r.choice(("", f'<div id="{name}"><h3>{words(1, 2)}</h3>{said()}{said()}</div>', f'<section class="{name}"><ol>{items(1, 5, said)}</ol></section>', f'<div class="{name}"><article class="comment">{said()}</article></div>', f'<ul class="{name}">{items(2, 4, said)}</ul>'))

    def foot() -> str:
        said = f"&copy; {words(1, 2)} &middot; {sentences(1, 2)}"
        return r.choice((f"<footer>{said}</footer>", f"<footer><p>{said}</p>{link()}</footer>", f'<div class="footer"><p>{said}</p></div>', f'<div id="footer">{said}<ul>{items(1, 4, link)}</ul></div>', ""))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.7:
            end = r.choice(("</p>", "</p>", "</p>", "<p>", ""))
            return f"<p>{MARK}{r.choice(('', '<b>'))}{sentences(1, 5) if kind < 0.55 else words(1, 6) + r.choice(('', '.'))}{r.choice(('', '<br>'))}{end}"
        return r.choice(
            (
                f"<h2>{MARK}{words(1, 6)}</h2>",
                f"<h3>{MARK}{words(1, 6)}</h3>",
                f"<ul>{items(2, 5, lambda: MARK + words(1, 9))}</ul>",
                f"<ol>{items(2, 4, lambda: MARK + sentences(1, 1))}</ol>",
                f"<blockquote><p>{MARK}{sentences(1, 2)}</p></blockquote>",
                f"<pre>{MARK}{words(3, 9)}</pre>",
                f"<table><tr><td>{MARK}{words(1, 2)}</td><td>{MARK}{words(1, 3)}</td></tr></table>",
                f"<figure><figcaption>{MARK}{words(2, 6)}</figcaption></figure>",
                f'<p>{MARK}{sentences(1, 1)} {link()} {sentences(1, 1)}</p>',
            )
        )

    def article() -> str:
        title = f"<h1>{MARK}{words(2, 9)}</h1>" if r.random() < 0.9 else ""
        body = [paragraph() for _ in range(r.randint(1, 9))]
        for part in (advert, side, notice):
            if r.random() < 0.25:
                body.insert(r.randint(0, len(body)), part())
        after = comments() if r.random() < 0.4 else ""
        inner = title + "".join(body) + after
        name = r.choice(("content", "article", "post", "entry", "story", "main-content", "article-body", "text"))
        return r.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f'<article class="{name}">{inner}</article>', f'<div role="main">{inner}</div>'))

    for _ in range(n):
        before = [menu(), top(), advert(), notice(), form(), side()]
        after = [side(), comments(), advert(), form(), notice(), foot()]
        r.shuffle(before)
        head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        page = head + "".join(before) + article() + "".join(after) + "</body></html>"
        yield page if r.random() < 0.9 else page[: int(len(page) * r.uniform(0.4, 1))]


@lru_cache(1)
def model() -> Crf:
    data = []
    for page in labelled_pages():
        parts = blocks(page)
        tags = ["main" if MARK in text else "other" for _, text, _ in parts]
        data.append((features([(p, t.replace(MARK, ""), s) for p, t, s in parts]), tags))
    return Crf(("other", "main")).fit(data, rounds=25)


def main_texts(pages: list[str], crf: Crf) -> list[str]:
    parts = [blocks(p) for p in pages]
    tags = crf.decode([crf.ids(features(p)) for p in parts])
    return [" ".join(t for (_, t, _), tag in zip(p, y) if tag) for p, y in zip(parts, tags)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html).

    A null page, and one without article text, has the empty text. Unclosed and cut-off mark-up is read as far as it
    goes. Other columns are ignored.
    """
    crf = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts([h or "" for h in batch.column("html").to_pylist()], crf.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
