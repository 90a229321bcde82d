"""Operator 5: licence scans by Aho-Corasick and a shunting-yard parser of expressions.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII bytes.  One automaton
over the words joined by blanks finds the phrases of licence notices and the tag
`spdx license identifier`; after each tag, the expression is read from the text itself, up to
the end of the line or the next tag, and parsed (shunting-yard: WITH binds tighter than AND,
AND tighter than OR; parentheses).

Labels: the phrases' labels, `spdx:<id>` of each licence in a well-formed expression,
`choice` or `joint` if it holds OR or AND, and `exception:<id>` after WITH.  Score: one
minus the product of (1 - weight) over the distinct labels: 0.5 for a base phrase, 0.4 for
another, 0.9 for a well-formed tag.

Defined cases: null or empty texts have no words and no labels (empty strings, score 0,
null places); a malformed expression (unknown operator order, unbalanced) gives the label
`spdx:invalid`.  Labels are sets, so phrases that start at one place all count and their order makes no
difference; repeated rows are scanned one by one; very long texts and expressions are read whole;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: More notice phrases and their labels.
MORE = {
    "permission is hereby granted free of charge": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd-notice",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons": "cc",
    "cc0 1 0 universal": "cc0",
    "the unlicense": "unlicense",
    "this is free and unencumbered software": "unlicense",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "end user license agreement": "eula",
}
TAG = "spdx license identifier"

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[\x20\t]*:?[\x20\t]*", re.I)
_LINE = re.compile(rb"[^\r\n]*")
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """Postfix form of a licence expression (identifiers lower-cased, operators and/or/with), or None if malformed.

    Text after a complete expression is left aside: a tag stands in a line of prose or of a comment.
    """
    out: list[str] = []
    stack: list[str] = []
    at, operand, depth, done = 0, True, 0, 0
    while m := _TOKEN.match(expression, at):
        t = m[1]
        low = t.lower()
        if operand:
            if t == "(":
                stack.append(t)
                depth += 1
            elif t == ")" or low in _RANK:
                return None
            else:
                out.append(low.strip(".:") if low.strip(".:") else low)
                operand = False
                if stack and stack[-1] == "with":
                    out.append(stack.pop())
                if t[-1] in ".:" and not depth:
                    break
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif t == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
        at = m.end()
    if operand or depth:
        return None
    while stack:
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str]) -> set[str]:
    """Labels of an expression."""
    stack: list[set[str]] = []
    for t in postfix:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                b = {"exception:" + x[5:] for x in b}
            else:
                b.add("choice" if t == "or" else "joint")
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
            stack.append(a)
        else:
            stack.append({"spdx:" + t})
    return stack[0]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in ((0, BASE), (1, MORE), (2, {TAG: ""})):
        for p, label in phrases.items():
            a.add_word(f" {p} ", (kind, label, len(p.split())))
    a.make_automaton()
    return a


def scan(text: str | None):
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of a text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    words = raw.translate(FOLD).split()
    n_base, starts, base, more, tagged = 0, [], set(), set(), False
    begins = None
    if words:
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        for end, (kind, label, size) in automaton().iter(joined):
            if kind == 0:
                if begins is None:
                    begins = list(itertools.accumulate((len(w) + 1 for w in words), initial=1))
                n_base += 1
                starts.append(bisect.bisect_left(begins, end) - size)
                base.add(label)
            elif kind == 1:
                more.add(label)
            else:
                tagged = True
    sure = set()
    if tagged:
        tags = [m.span() for m in _TAG.finditer(raw)]
        for (_, at), (stop, _) in zip(tags, tags[1:] + [(len(raw), None)]):
            p = parse(_LINE.match(raw, at, stop)[0].decode("utf-8", "replace"))
            sure |= evaluate(p) if p else {"spdx:invalid"}
    miss = 1.0
    for label in base | more | sure:
        miss *= 0.5 if label in base else 0.1 if label in sure and label != "spdx:invalid" else 0.6
    return len(words), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more | sure)), 1 - miss


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs` (doc_id, text)."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([scan(t) for t in pdf.text], columns=names)
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
