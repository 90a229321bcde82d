"""Operator 8: main text of web pages by a linear-chain conditional random field.

A tolerant tokenizer walks the page with a stack of open elements and cuts its text into
leaf blocks at block-level tags; scripts, styles, comments and other text that isn't shown
are no blocks.  Each block has features of its ancestors' tags, of the words in their class
and id attributes, and of its text.  A two-label field (main or not), trained on labelled
pages of a seeded generator (`examples`), labels all blocks of a page together by Viterbi.

In a block, character references are decoded (once), runs of white space become one blank,
and ends are trimmed; main blocks are joined by line feeds in page order.

Defined cases: a null, empty or textless page has an empty text; markup that is cut off or
not closed is read as far as it goes: a script, style or other element of raw text runs to the
end of the page, any other element ends with its parent, and an embedded object hides its content only
if it has an end tag.  `<br>` is white space within its block.  Whole pages are read, of any
length; repeated rows are read one by one; of equal scores Viterbi takes the label "not main".
page_id and url are carried, other columns ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.crf import Crf

_SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|iframe|noembed|noframes|title|textarea|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</\1\b[^>]*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Element names by what they do.  HIDDEN: what stands between start and end tag isn't shown.
HIDDEN = frozenset("template svg object audio video canvas annotation annotation-xml datalist button select option optgroup label".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("option legend caption td th tr tbody thead tfoot summary".split())
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("html",)), "tbody": (("thead", "tbody", "tr"), ("table",)),
}
AREAS = ("none", "article", "main", "nav", "header", "footer", "aside", "form", "head", "noscript", "dialog")
LEAVES = ("other", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "pre", "blockquote", "figcaption", "dt", "dd", "section", "article", "main", "a", "option", "button", "summary", "caption", "body", "header", "footer", "nav", "aside", "form", "head", "span", "legend")
#: Words of class and id attributes that tell what a part is for.
NAMES = {
    "content": "content article post story entry body text main prose articlebody maincontent",
    "nav": "nav navbar menu menus breadcrumb breadcrumbs pager pagination toc topbar navigation skip sitemap tabs",
    "header": "header masthead banner logo top branding hero",
    "footer": "footer colophon copyright legal bottom foot",
    "side": "sidebar side aside widget related recommended rail more trending popular promoted teaser links",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion adslot adbox banner-ad dfp",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay toast paywall disclaimer warning",
    "comments": "comment comments discussion disqus reply replies respond reader feedback reviews commentlist",
    "form": "form newsletter subscribe signup login search input contact",
    "social": "share sharing social follow twitter facebook like tags byline meta author date",
}
KINDS = ("none", *NAMES)
_NAMED = {w: i + 1 for i, words in enumerate(NAMES.values()) for w in words.split()}
#: Words of texts that are about the page rather than of it.
HINTS = re.compile(r"©|\b(?:copyright|cookies?|subscribe|newsletter|advertisement|sponsored|sign up|log ?in|all rights reserved|privacy|share|read more|comments?|repl(?:y|ies)|menu|home|contact|click)\b", re.I)
_HIDING = "\0"  # on the stack of open elements: one that hides its content
_AREA, _LEAF = {t: i for i, t in enumerate(AREAS)}, {t: i for i, t in enumerate(LEAVES)}
SIZES = (len(AREAS), len(LEAVES), len(KINDS), 2**7, 6 * 4, 2 * 2 * 6, len(LEAVES) * 2, len(AREAS) * len(KINDS), len(AREAS) * len(AREAS))
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def _kind(attrs: str) -> int:
    """What an element's class, id, role and itemprop say it is for."""
    found = 0
    for m in _ATTR.finditer(attrs):
        for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
            k = _NAMED.get(w, 0)
            if k > 1:
                return k
            found = found or k
    return found


def hiding(tokens: list[re.Match]) -> set[int]:
    """Numbers of the start and end tags of HIDDEN elements that have both; the outermost of nested ones alone.

    A start tag that is empty (`/>`), or whose end tag is missing where its parent ends, hides nothing.
    """
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    pairs = []
    for number, m in enumerate(tokens):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if not m[2]:
            if tag not in VOID and not m[5]:
                stack.append((tag, number))
                opened[tag] += 1
        elif opened[tag]:
            while True:
                name, start = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            if tag in HIDDEN:
                pairs.append((start, number))
    out, last = set(), -1
    for start, end in sorted(pairs):
        if start > last:
            out |= {start, end}
            last = end
    return out


def blocks(page: str) -> list[tuple[str, tuple]]:
    """(text, (leaf, area, outer area, kind, flags, share of linked characters, ends a sentence)) of each leaf block."""
    tokens = list(_SPLIT.finditer(page))
    hides = hiding(tokens)
    stack: list[tuple[str, int]] = []
    out: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = 0
    links = 0
    hidden = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            leaf, own = next(((t, k) for t, k in reversed(stack) if t in _LEAF and t != "span"), ("other", 0))
            areas = [_AREA[t] for t, _ in stack if t in _AREA]
            kinds = [k for _, k in stack if k]
            bad = [k for k in kinds if k > 1]
            flags = (
                bool(areas and 1 in areas) | bool(2 in areas) << 1 | bool({3, 4, 5, 6, 7, 8, 9, 10} & set(areas)) << 2
                | bool(bad) << 3 | bool(1 in kinds) << 4 | (sum(a == 1 for a in areas) > 1) << 5
                | (len(bad) == 1 and own > 1) << 6
            )
            out.append((text, (leaf, areas[-1] if areas else 0, areas[-2] if len(areas) > 1 else 0, bad[-1] if bad else (kinds[-1] if kinds else 0), flags, min(1.0, linked / len(text)), text[-1] in ".!?:;\"”»…)")))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if hidden:
            return
        parts.append(text)
        if links:
            linked += len(text)

    def close(i: int) -> None:
        nonlocal links, hidden
        for t, _ in stack[i:]:
            opened[t] -= 1
        links -= sum(t == "a" for t, _ in stack[i:])
        hidden -= sum(t == _HIDING for t, _ in stack[i:])
        del stack[i:]

    at = 0
    opened: Counter[str] = Counter()
    for number, m in enumerate(tokens):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if m[2] and opened[_HIDING] and number in hides:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == _HIDING))
            elif not m[2] and number in hides:
                stack.append((_HIDING, 0))
                opened[_HIDING] += 1
                hidden += 1
            continue
        if hidden:
            continue
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            take(" ")
        if m[2]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in ENDS:
            ends, stops = ENDS[tag]
            cut = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ends:
                    cut = i
            if cut is not None:
                close(cut)
        if tag not in VOID and not m[5]:
            stack.append((tag, _kind(m[4]) if m[4] else 0))
            opened[tag] += 1
            links += tag == "a"
    rest = page[at:]
    if rest and not re.match(r"<[a-zA-Z/!?]", rest):
        take(rest)
    flush()
    return out


def features(found: list[tuple[str, tuple]]) -> np.ndarray:
    rows, prev = [], (0, 0)
    for text, (leaf, area, outer, kind, flags, link, stop) in found:
        n = len(text)
        size = 0 if n < 15 else 1 if n < 40 else 2 if n < 80 else 3 if n < 200 else 4 if n < 500 else 5
        linked = 0 if link == 0 else 1 if link < 0.3 else 2 if link < 0.8 else 3
        same = int((area, kind) == prev)
        leaf_id = _LEAF.get(leaf, 0)
        rows.append((area, leaf_id, kind, flags, size * 4 + linked, (stop * 2 + (HINTS.search(text) is not None)) * 6 + size, leaf_id * 2 + same, area * len(KINDS) + kind, area * len(AREAS) + outer))
        prev = (area, kind)
    return np.array(rows, np.int64).reshape(-1, len(SIZES)) + OFFSETS[:-1]


def examples(n: int = 500, seed: int = 8, odd: float = 0.0):
    """(html, main text blocks) of n generated pages; a share `odd` of the main parts is called as if it were something else."""
    r = random.Random(seed)
    syllables = ["an", "the", "re", "tion", "er", "on", "st", "li", "ma", "que", "ung", "ció", "eau", "ver", "é", "so", "ti", "pa"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 7)))
    cls = lambda kind: r.choice(["class", "id"]) + '="' + r.choice(NAMES[kind].split()[:6]) + r.choice(["", "-box", " wide", "-" + word()]) + '"'

    def named(t: str) -> str:
        """Main text whose element, or the element around it, is called as if it were something else."""
        kind = r.choice(list(NAMES)[1:])
        w = r.choice(NAMES[kind].split())
        name = r.choice(["class", "id"]) + '="' + r.choice(["{}", "{}", "article-{}", "{}-" + word(), word() + "-{}"]).format(w) + '"'
        if r.random() < 0.35:
            return f"<div {name}>{t}</div>"
        return re.sub(r"^<(p|div|h2)>", rf"<\1 {name}>", t)

    def navigation() -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 9)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f"<div {cls('nav')}><ul>{items}</ul></div>", f"<nav {cls('nav')}>{items}</nav>", f'<ul {cls("nav")}>{items}</ul>'])

    def junk(inside: bool) -> str:
        kinds = [
            lambda: f"<div {cls('ad')}>{r.choice([prose(), words(2, 8)])}</div>", lambda: f"<div {cls('notice')}><p>{sentence()}</p><button>OK</button></div>",
            lambda: f"<form action=\"/s\"><label>{words(1, 4)}</label><input name=q><button>{word()}</button></form>", lambda: f"<div {cls('form')}><p>{sentence()}</p><form><input><button>Subscribe</button></form></div>",
            lambda: f"<div {cls('social')}>{words(1, 4)}</div>", lambda: "<script>var a = '<p>no</p>';</script>", lambda: f"<!-- {words(1, 5)} -->", lambda: "<style>p > a { color: red }</style>",
            lambda: f"<aside>{r.choice(['<p>' + prose() + '</p>', navigation()])}</aside>",
        ]
        if not inside:
            kinds += [lambda: f"<div {cls('side')}><h3>{words(1, 3)}</h3><p>{r.choice([prose(), words(3, 9)])}</p></div>", lambda: f"<aside {cls('side')}><p>{prose()}</p></aside>", navigation]
        return r.choice(kinds)()

    def comments() -> str:
        one = lambda: r.choice([f"<li><b>{word()}</b><p>{prose()}</p></li>", f"<div class=\"comment\"><span>{word()}</span><p>{prose()}</p></div>", f'<article class="comment"><p>{prose()}</p></article>'])
        body = "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice([f"<section {cls('comments')}><h2>Comments</h2>{body}</section>", f"<div {cls('comments')}><h3>{r.randint(1, 9)} comments</h3><ul>{body}</ul></div>", f'<div id="comments">{body}</div>'])

    def inline(t: str) -> str:
        ws = t.split(" ")
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(ws))
            ws[i] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(ws[i])
        return " ".join(ws)

    def part() -> tuple[str, list[str]]:
        x = r.random()
        if x < 0.6:
            t = prose()
            return r.choice([f"<p>{inline(t)}</p>", f"<p>{inline(t)}", f"<p><b>{t}<br>", f"<div>{inline(t)}</div>"]), [t]
        if x < 0.7:
            t = words(2, 6)
            return f"<h2>{t}</h2>", [t]
        if x < 0.78:
            ts = [sentence(2, 12) for _ in range(r.randint(2, 5))]
            return "<ul>" + "".join(f"<li>{inline(t)}</li>" for t in ts) + "</ul>", ts
        if x < 0.84:
            t = prose()
            return f"<blockquote><p>{t}</p></blockquote>", [t]
        if x < 0.89:
            ts = [words(1, 3) for _ in range(4)]
            return f"<table><tr><th>{ts[0]}</th><th>{ts[1]}</th></tr><tr><td>{ts[2]}</td><td>{ts[3]}</td></tr></table>", ts
        if x < 0.94:
            t = sentence()
            return f'<figure><img src="a.png"><figcaption>{t}</figcaption></figure>', [t]
        t = words(2, 9)
        return f"<pre>{t}</pre>", [t]

    for _ in range(n):
        title, body, main = words(2, 9), [], []
        tag = r.choice(["h1", "h1", "h1", "h2"])
        if r.random() < 0.9:
            body.append(r.choice([f"<{tag}>{title}</{tag}>", f"<header><{tag}>{title}</{tag}></header>" if r.random() < 0.1 else f"<{tag}>{title}</{tag}>"]))
            if "<header>" not in body[-1]:
                main.append(title)
        for _ in range(r.choice([1, 2, 4, 6, 9, 14])):
            markup, texts = part()
            body.append(named(markup) if r.random() < odd else markup)
            main += texts
            if r.random() < 0.12:
                body.append(junk(True))
        inner = "".join(body)
        tail = comments() if r.random() < 0.35 else ""
        inside = r.random() < 0.4
        if inside:
            inner += tail
        box = r.choice(["<article>{}</article>", "<article>{}</article>", f"<article {cls('content')}>{{}}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f"<div {cls('content')}>{{}}</div>", f"<section {cls('content')}>{{}}</section>", f"<div {cls('content')}><article>{{}}</article></div>"])
        top = r.choice([f"<header><h2>{words(1, 3)}</h2>{navigation()}</header>", navigation(), f"<div {cls('header')}><p>{words(2, 6)}</p></div>{navigation()}"])
        foot = r.choice([f"<footer>&copy; {word()} &middot; {r.choice([sentence(), words(2, 5)])}</footer>", f"<div {cls('footer')}><p>{sentence()}</p>{navigation()}</div>", f"<footer><p>{prose()}</p></footer>", ""])
        around = [junk(False) for _ in range(r.randint(0, 3))]
        after = [junk(False) for _ in range(r.randint(0, 2))]
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{top}{''.join(around)}{box.format(inner)}{'' if inside else tail}{''.join(after)}{foot}"
        yield page + r.choice(["</body></html>", "</body></html>", ""]), main


@functools.cache
def model() -> Crf:
    sequences = []
    for page, main in examples(700, odd=0.12):
        found, y, i = blocks(page), [], 0
        for text, _ in found:
            hit = i < len(main) and text == main[i]
            i += hit
            y.append(int(hit))
        sequences.append((features(found), np.array(y, np.int64)))
    return Crf(int(OFFSETS[-1]), 2).train(sequences, epochs=15)


def extract(pages: list[str | None], field: Crf) -> list[str]:
    found = [blocks(p) if isinstance(p, str) else [] for p in pages]
    count = np.array([len(f) for f in found], np.int64)
    if not count.sum():
        return ["" for _ in pages]
    e = field.scores(np.concatenate([features(f) for f in found if f]))
    first = np.cumsum(count) - count
    y = field.viterbi(e, first, count)
    return ["\n".join(t for (t, _), label in zip(f, y[a : a + n]) if label) for f, a, n in zip(found, first, count)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                yield pd.DataFrame({"page_id": part.page_id.astype("Int64"), "url": part.url, "text": extract(part.html.tolist(), sent.value)})

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
