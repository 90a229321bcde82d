"""Operator 6: hierarchical language identification.

A text's features are relative frequencies of hashed byte bigrams, trigrams and 4-grams of
its lower-cased (A-Z) letters.  Linear support vector machines, one for each pair, first
choose the language family, then the language within it (one-versus-one votes, ties by
summed margins).  As the features are frequencies, a margin is a mean of weights over the
places of a text, so whole texts are read and nothing is kept for each n-gram.

Learning uses text and non-null lang of rows outside fold 0, at most about `SAMPLE` rows of
each language, picked by a hash of the id; the rest of a language's rows only adds to its
count.  Families are a fixed table; a language that isn't listed is a family of its own.

Defined cases: a null text, or one without a letter, gives `und` with score 0; with nothing
to learn from all rows give `und`; one language only: that one.  Rows with a null id are
predicted, never learned from, and not held out.  Votes and margins that are equal too go to the
language that comes first by name; repeated rows are predicted one by one, and each counts in the sample.  Very long texts are read
whole, piece by piece.  Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.kernel import LOWER, pieces
from narrata.llm.store import fold_of

SAMPLE, BINS, EPOCHS, COST = 800, 1 << 12, 12, 10.0
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "celtic": "ga cy gd br",
    "sinitic": "zh yue",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = re.compile(r"[^\W\d_]")
_WORDY = np.full(256, 0x20, np.uint8)
for _c in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _WORDY[_c] = LOWER[_c]


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], "own:" + lang)


def bins(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bin) of each n-gram; texts are padded by blanks."""
    buf = _WORDY[np.frombuffer(b"".join(b"\n" + t + b"\n\n\n\n" for t in held), np.uint8)]
    doc = np.repeat(np.arange(len(held)), [len(t) + 5 for t in held])
    b = buf.astype(np.uint32)
    n = len(b) - 3
    two = b[:n] << 8 | b[1 : n + 1]
    three = two << 8 | b[2 : n + 2]
    four = three << 8 | b[3 : n + 3]
    some = np.flatnonzero(three != 0x202020)
    out, top = [], np.uint32(32 - BINS.bit_length() + 1)
    with np.errstate(over="ignore"):
        for k, g in enumerate((two, three, four)):
            out.append((((g[some] + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(5)) * np.uint32(0x85EBCA77)) >> top)
    return np.concatenate([doc[some]] * 3), np.concatenate(out)


def histograms(held: list[bytes]) -> np.ndarray:
    doc, b = bins(held)
    h = np.bincount(doc * BINS + b, minlength=len(held) * BINS).reshape(len(held), BINS).astype(np.float32)
    return h / np.maximum(h.sum(1, keepdims=True), 1)


def svm(x: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine (hinge loss, dual coordinate descent)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(a[i] - g / q[i], 0), COST)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, langs: np.ndarray) -> dict:
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    scale = scale / np.sqrt(((x * scale) ** 2).sum(1).mean())
    z = (x * scale).astype(np.float32)
    families = np.array([family(v) for v in langs])
    weights, bias, levels = [], [], {}
    groups = {"": families} | {f: np.where(families == f, langs, None) for f in sorted(set(families))}
    for name, of in groups.items():
        names = sorted({v for v in of if v is not None})
        levels[name] = (names, [])
        for p, q in itertools.combinations(range(len(names)), 2):
            some = np.flatnonzero((of == names[p]) | (of == names[q]))
            w, b = svm(z[some], np.where(of[some] == names[p], 1.0, -1.0))
            levels[name][1].append((p, q, len(bias)))
            weights.append(w * scale)
            bias.append(b)
    w = np.array(weights, np.float32).T.copy() if weights else np.zeros((BINS, 0), np.float32)
    return {"w": w, "bias": np.array(bias), "levels": levels}


def choose(level, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the chosen name, confidence) for each row."""
    names, machines = level
    votes, sums = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    for p, q, i in machines:
        m = margins[:, i]
        votes[:, p] += m > 0
        votes[:, q] += m <= 0
        sums[:, p] += m
        sums[:, q] -= m
    won = (votes + np.tanh(sums / 100) / 4).argmax(1)
    sure = np.ones(len(margins))
    for p, q, i in machines:
        part = (won == p) | (won == q)
        sure = np.where(part, np.minimum(sure, 1 / (1 + np.exp(-2 * np.abs(margins[:, i])))), sure)
    return won, sure


def predict(held: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    doc, b = bins(held)
    n = np.maximum(np.bincount(doc, minlength=len(held)), 1)
    margins = np.stack([np.bincount(doc, model["w"][:, i][b], len(held)) / n for i in range(len(model["bias"]))], 1) + model["bias"] if len(model["bias"]) else np.zeros((len(held), 0))
    top, sure = choose(model["levels"][""], margins)
    lang = np.empty(len(held), object)
    for i, f in enumerate(model["levels"][""][0]):
        at = np.flatnonzero(top == i)
        if len(at):
            own, s = choose(model["levels"][f], margins[at])
            lang[at] = np.array(model["levels"][f][0], object)[own]
            sure[at] = np.minimum(sure[at], s)
    return lang, sure


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    rows = docs.filter((fold_of() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(1.0, sample / n))) for v, n in sorted(counts.items())])
    u = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1_000_000

    def vectors(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                for first, held in pieces(part.text.tolist()):
                    h = histograms(held)
                    ok = h.sum(1) > 0
                    yield pd.DataFrame({"doc_id": part.doc_id.to_numpy()[first : first + len(held)], "lang": part.lang.to_numpy()[first : first + len(held)], "x": [v.tobytes() for v in h]})[ok]

    got = rows.filter(u < rate).select("doc_id", "lang", "text").mapInPandas(vectors, "doc_id long, lang string, x binary").toArrow().to_pandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "doc_id"]).groupby("lang").head(2 * sample)
    return fit(np.frombuffer(b"".join(got.x), np.float32).reshape(-1, BINS), got.lang.to_numpy(object))


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for pdf in batches:
            texts = pdf.text.tolist()
            for first, held in pieces(texts):
                letters = np.array([isinstance(t, str) and any(m[0].isalpha() for m in _LETTER.finditer(t)) for t in texts[first : first + len(held)]])
                lang, sure = predict(held, m) if m else (np.full(len(held), "und", object), np.zeros(len(held)))
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[first : first + len(held)].astype("Int64").to_numpy(), "lang_pred": np.where(letters, lang, "und"), "score": np.where(letters, sure, 0.0)})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
