"""Operator 10: secret scans by patterns and a linear-chain conditional random field.

Base spans come from three fixed patterns (`BASE`), leftmost and non-overlapping for each.
The field adds spans: it tags tokens (runs of [A-Za-z0-9_+/.-] and non-ASCII bytes, and runs
of other visible bytes) as outside, begin or inside of a secret, from their shape, their
neighbours and features of the whole text, decoded by Viterbi.  A tagged span is added
unless it lies within a base span.  Spans are code points, end exclusive; a base span is the
whole match, with its keyword.

There are no labelled secrets to learn from, so the field is trained on lines from a seeded
generator (`examples`): invented prose with secrets of common kinds, and with numbers,
addresses, identifiers and paths that aren't secrets.

Defined cases: a null or empty text has no spans (hash of the empty string); spans that start
together come in the order of the kinds; where labels score alike Viterbi takes the first (outside); repeated rows are scanned
one by one; very long texts are read whole, piece by piece; ids and other columns are carried or
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.crf import Crf
from narrata.llm.kernel import LOWER, SPACE, Words, pieces

#: Kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_HEX = 12, 16
#: Words that announce a secret, and words that announce something else.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "passphrase", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "access_key", "secret_key", "client_secret", "key", "login", "basic")
OTHERWISE = ("id", "sha", "commit", "version", "phone", "tel", "isbn", "order", "card", "iban", "http", "https", "www", "mail", "ip", "md5", "uuid", "file", "path")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/.-":
    _KIND[_c] = 1
_KIND[128:] = 1
_KIND[:32] = 0
_TYPE = np.zeros(256, np.uint8)  # 1 digit, 2 lower, 3 upper, 4 symbol, 5 other
_TYPE[48:58], _TYPE[97:123], _TYPE[65:91], _TYPE[128:] = 1, 2, 3, 5
for _c in b"_+/.-=":
    _TYPE[_c] = 4
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_SHAPES, _CLASSES, _DOCS = 9 * 5 * 5 * 2 * 2 * 4, 8, 6
SLOTS = 6
SIZES = (_SHAPES, _CLASSES, _CLASSES * _CLASSES, _CLASSES, _CLASSES * _SHAPES, _DOCS * 9)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


@functools.cache
def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the listed words and of assignment marks, and their classes: 1 keyword, 2 otherwise, 3 assignment."""
    marks = [a + b + c for a in ("", '"', "'") for b in ("=", ":", "=>", ":=") for c in ("", '"', "'")]
    every = [(x, 1) for x in KEYWORDS] + [(x, 2) for x in OTHERWISE] + [(x, 3) for x in marks]
    h = np.array([Words([x.encode()], _KIND, LOWER).hashes()[0] for x, _ in every])
    order = np.argsort(h)
    return h[order], np.array([c for _, c in every])[order]


def _per_word(flag: np.ndarray, w: Words) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=total[1:])
    return total[w.end] - total[w.start]


def features(w: Words) -> np.ndarray:
    """Feature ids (positions x SLOTS) of the tokens of w."""
    kind = _TYPE[w.buf]
    size = (w.end - w.start).astype(np.int32)
    digit, lower, upper, symbol = (_per_word(kind == k, w) for k in (1, 2, 3, 4))
    change = np.zeros(len(w.buf), bool)
    alike = np.where(kind == 3, 2, kind)
    change[1:] = alike[1:] != alike[:-1]
    if len(w.start):
        change[w.start] = False
    turns = _per_word(change, w)
    raw = w.buf[w.start]
    long = np.digitize(size, [4, 8, 12, 16, 20, 32, 40, 64])
    ratio = np.where(digit == 0, 0, np.where(digit == size, 4, 1 + np.digitize(digit / np.maximum(size, 1), [0.2, 0.5])))
    letters = lower + upper
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2, np.where((upper == 1) & (_TYPE[raw] == 3), 3, 4))))
    is_hex = _per_word(_HEX[w.buf], w) == size
    shape = ((((long * 5 + ratio) * 5 + case) * 2 + is_hex) * 2 + (symbol > 0)) * 4 + np.digitize(turns, [1, 3, 6])
    known, classes = _lookup()
    v = Words.__new__(Words)
    v.buf, v.start, v.end = LOWER[w.buf], w.start, w.end
    h = v.hashes()
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    cls = np.where(known[i] == h, classes[i], np.where(_KIND[raw] == 2, 4, np.where(digit > 0, 5, np.where(case == 1, 6, 7))))
    n = len(w.start)

    def near(by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        src = np.arange(n) + by
        ok = (src >= 0) & (src < n)
        ok[ok] = w.doc[src[ok]] == w.doc[ok]
        out[ok] = cls[src[ok]]
        return out

    before, before2, after = near(-1), near(-2), near(1)
    share = np.bincount(w.doc, (cls == 3) | (cls == 1), w.n) / np.maximum(w.count, 1)
    doc = np.digitize(share, [1e-9, 0.005, 0.02, 0.1, 0.3])[w.doc]
    ids = np.stack([shape, before, before * _CLASSES + before2, after, before * _SHAPES + shape, doc * 9 + long], 1)
    return ids + OFFSETS[:-1]


def examples(n: int = 2500, seed: int = 10):
    """(text, [(start, end) of each secret]) of n generated lines."""
    r = random.Random(seed)
    part = ["an", "the", "re", "tion", "er", "on", "st", "li", "ma", "que", "ung", "ció", "eau", "ver", "é", "so", "ti", "pa", "lo", "w"]
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))

    def word() -> str:
        t = "".join(r.choice(part) for _ in range(r.randint(1, 5)))
        t = t.capitalize() if r.random() < 0.12 else t
        return t + r.choice(["", "", "", "", "", ",", ".", "###", "***", "%%%", "$$$", "&&&"])

    def secret() -> str:
        return r.choice([
            lambda: of("0123456789abcdef", r.choice([32, 40, 64])), lambda: "ghp_" + of(low + up + num, 36), lambda: "sk-" + of(low + up + num, 40),
            lambda: "xoxb-" + of(num, 12) + "-" + of(low + up + num, 24), lambda: of(low + up + num + "+/", 40), lambda: "AKIA" + of(up + num, 16),
            lambda: "eyJ" + of(low + up + num, 20) + "." + of(low + up + num + "_-", 40) + "." + of(low + up + num + "_-", 30), lambda: "AIza" + of(low + up + num + "_-", 35),
            lambda: of(low + up + num, r.randint(20, 32)),
        ])()

    def plain() -> str:
        return r.choice([
            lambda: of(num, r.randint(1, 10)), lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"+{r.randint(1, 99)} ({of(num, 3)}) {of(num, 3)}-{of(num, 4)}",
            lambda: f"{word().strip('.,')}.{of(num, 2)}@mail{r.randint(1, 9)}.example.com", lambda: f"https://{of(low, 8)}.example.org/{of(low, 4)}/{of(num, 3)}", lambda: f"{of(num, 4)}-{of(num, 2)}-{of(num, 2)}",
            lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "".join(r.choice(part) for _ in range(9)), lambda: of(num, 16), lambda: f"/usr/{of(low, 5)}/{of(low, 7)}_{of(low, 5)}.txt",
            lambda: f"{r.choice(OTHERWISE)}: {of(num, 5)}", lambda: "".join(r.choice(part).capitalize() for _ in range(3)), lambda: of(up, r.randint(2, 12)), lambda: f"{r.choice(KEYWORDS)} {word()}", lambda: f"{word()} = {word()}",
        ])()

    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(3, 40)):
            x = r.random()
            if x < 0.05:
                mark = r.choice([" = ", "=", ": ", ":", ' = "', "='", '": "', " := "])
                text += r.choice(KEYWORDS if r.random() < 0.8 else part) + mark
                s = secret() if r.random() < 0.8 else of(low + up + num, r.randint(8, 16))
                spans.append((len(text), len(text) + len(s)))
                text += s + ('"' if '"' in mark else "'" if "'" in mark else "")
            elif x < 0.07:
                s = secret()
                spans.append((len(text), len(text) + len(s)))
                text += s
            else:
                text += plain() if x < 0.2 else word()
            text += r.choice([" ", " ", " ", "\n"])
        yield text, spans


@functools.cache
def model() -> Crf:
    sequences = []
    for text, spans in examples():
        w = Words([text.encode()], _KIND)
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        y = np.zeros(len(w.start), np.int64)
        for a, b in spans:
            own = np.flatnonzero((w.start < at[b]) & (w.end > at[a]))
            y[own] = INSIDE
            y[own[0]] = BEGIN
        sequences.append((features(w), y))
    return Crf(int(OFFSETS[-1]), 3).train(sequences)


def _runs(flag: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ok = b - a >= least
    return list(zip(a[ok].tolist(), b[ok].tolist()))


def find(held: list[bytes], field: Crf) -> list[list[tuple[int, int, int]]]:
    """(start, number of the kind, end) of each span of each text, in code points, sorted."""
    w = Words(held, _KIND)
    out: list[list[tuple[int, int, int]]] = [[] for _ in held]
    point = np.cumsum((w.buf & 0xC0) != 0x80) if w.n else np.zeros(0, np.int64)
    base = np.concatenate([[0], point])
    for a, b in _runs(_HEX[w.buf], MIN_HEX):
        i = int(np.searchsorted(w.at, a, "right")) - 1
        o = base[w.at[i]]
        out[i].append((int(base[a] - o), 2, int(base[b] - o)))
    for i, t in enumerate(held):
        assign, access = b":" in t or b"=" in t, b"AKIA" in t
        if assign or access:
            s = t.decode("utf-8", "surrogatepass")
            if assign:
                out[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= MIN_ASSIGN]
            if access:
                out[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(s)]
    if len(w.start):
        y = field.decode(field.scores(features(w)), w.first, w.count)
        begin = np.flatnonzero(y == BEGIN)
        for j in begin.tolist():
            e = j
            while e + 1 < len(y) and y[e + 1] == INSIDE and w.doc[e + 1] == w.doc[j]:
                e += 1
            i = int(w.doc[j])
            o = base[w.at[i]]
            a, b = int(base[w.start[j]] - o), int(base[w.end[e]] - o)
            if not any(s <= a and b <= t for s, k, t in out[i] if k < 3):
                out[i].append((a, 3, b))
    for spans in out:
        spans.sort()
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (kind:start:end, comma-joined) for each row of `docs` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def scan(batches):
        for pdf in batches:
            for first, held in pieces(pdf.text.tolist()):
                rows = find(held, sent.value)
                join = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x)
                yield pd.DataFrame({
                    "doc_id": pdf.doc_id.iloc[first : first + len(held)].astype("Int64").to_numpy(),
                    **{f"n_{k}": [sum(x[1] == j for x in r) for r in rows] for j, k in enumerate(KINDS[:3])},
                    "base_spans": [join(x for x in r if x[1] < 3) for r in rows], "spans": [join(r) for r in rows],
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    )


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with each secret span of its text replaced by <SECRET>; other columns unchanged, n_chars counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    at = docs.columns.index("text")

    def scan(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, held in pieces(texts):
                for i, spans in enumerate(find(held, sent.value)):
                    t = texts[first + i]
                    if t and spans:
                        out, done = [], 0
                        for a, _, b in spans:
                            if a >= done:
                                out += [t[done:a], "<SECRET>"]
                            done = max(done, b)
                        texts[first + i] = "".join([*out, t[done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
