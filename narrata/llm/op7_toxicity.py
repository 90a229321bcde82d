"""Operator 7: toxicity by class-conditional Kneser-Ney models of the letters of words.

Two interpolated Kneser-Ney models of order `ORDER` over the bytes of lower-cased (A-Z)
words, one of toxic and one of ordinary text.  Only the highest order is counted by class;
all lower orders are continuation counts of both classes together, so an expression that
is rare in either class backs off to the same distribution in both; n-grams seen fewer than
`MIN_COUNT` times are left to that shared back-off and say nothing.  A word's evidence is
the difference of its two log-likelihoods.  A text has two length-normalised figures: the
mean evidence of its words, and the mean of what each word has beyond `MARGIN` (the plain
mean alone drowns a few insults in the noise of many words).  A logistic curve over both,
fitted on a training fold of its own, gives the score.

Counts come from every labelled training row (crc32(doc_id as text) mod 5 in 1, 2, 3); the
curve is fitted on at most `CALIBRATE` rows of fold 4, by ascending hash of the id.  The
model holds all n-grams at every size.  Up to `MAX_GRAMS` distinct ones it is fitted on the
driver and sent to the executors (12 bytes each); beyond that it is fitted as a table, and
the words of the texts are joined to it.  Both ways compute the same.

Defined cases: null or wordless texts have no evidence (the curve at 0); null labels or ids
don't train; several labels of one id: the largest counts; with no rows of one class, every
score is 0.  Repeated rows train and are scored one by one, and equal texts have equal scores; a very long text is read
whole, in pieces of a batch; a score of exactly 0.5 is predicted toxic.  Other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.kernel import LOWER, PIECE, Words, pieces
from narrata.llm.store import drop, fold_of, keep

ORDER, MAX_GRAMS, CALIBRATE = 6, 4_000_000, 50_000
MIN_COUNT, MARGIN = 3, 4.0
_PAD, _KEY = 0x20, "_op7_text"
_FULL = np.uint64(2 ** (8 * ORDER) - 1)


def word_grams(w: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into `some`, key) of the n-grams of the words `some`, a blank before and after each; a key packs ORDER bytes."""
    size = w.end[some] - w.start[some] + 1
    which = np.repeat(np.arange(len(some)), size)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    at, last = w.start[some][which] + offset, size[which] - 1
    key = np.zeros(len(which), np.uint64)
    for back in range(ORDER):
        byte = np.where(offset == last, np.uint8(_PAD), w.buf[np.minimum(at, len(w.buf) - 1)]) if back == 0 else np.where(offset >= back, w.buf[np.maximum(at - back, 0)], np.uint8(_PAD))
        key |= byte.astype(np.uint64) << np.uint64(8 * back)
    return which, key


def _count(batches):
    for pdf in batches:
        for toxic in (0, 1):
            for _, held in pieces(pdf.text[pdf.toxic == toxic].tolist()):
                w = Words(held, fold=LOWER)
                if not len(w.start):
                    continue
                _, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                which, key = word_grams(w, first)
                keys, where = np.unique(key, return_inverse=True)
                n = np.bincount(where, n[which], len(keys)).astype(np.int64)
                zero = np.zeros(len(keys), np.int64)
                yield pd.DataFrame({"gram": keys.view(np.int64), "c0": zero if toxic else n, "c1": n if toxic else zero})


def _discounted(keys: np.ndarray, c: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(last byte | context) of each key: absolute discounting of the counts c, interpolated with `lower`."""
    _, where = np.unique(keys >> np.uint64(8), return_inverse=True)
    n1, n2 = (c == 1).sum(), (c == 2).sum()
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    total, types = np.bincount(where, c), np.bincount(where, c > 0)
    back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
    return np.maximum(c - d * (c > 0), 0) / np.maximum(total, 1)[where] + back[where] * lower


def fit(keys: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> dict:
    """Log-likelihood ratio that each n-gram adds."""
    low, levels = keys, [keys]
    for k in range(ORDER - 1, 0, -1):
        low = np.unique(low & np.uint64(2 ** (8 * k) - 1))
        levels.append(low)
    p = None
    for k in range(1, ORDER):  # from the shortest: continuation counts of both classes
        own, above = levels[ORDER - k], levels[ORDER - k - 1]
        c = np.bincount(np.searchsorted(own, above & np.uint64(2 ** (8 * k) - 1)), minlength=len(own)).astype(float)
        under = np.full(len(own), 1 / 256) if p is None else p[np.searchsorted(levels[ORDER - k + 1], own & np.uint64(2 ** (8 * (k - 1)) - 1))]
        p = _discounted(own, c, under)
    under = p[np.searchsorted(levels[1], keys & np.uint64(2 ** (8 * (ORDER - 1)) - 1))]
    llr = np.log(_discounted(keys, c1, under)) - np.log(_discounted(keys, c0, under))
    some = c0 + c1 >= MIN_COUNT
    return {"keys": keys[some], "llr": llr[some].astype(np.float32)}


def evidence(w: Words, model: dict) -> np.ndarray:
    """Two rows: mean evidence of the words of each text, and mean evidence beyond MARGIN."""
    if not len(w.start) or not len(model["keys"]):
        return np.zeros((2, w.n))
    _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    which, key = word_grams(w, first)
    keys, where = np.unique(key, return_inverse=True)
    i = np.minimum(np.searchsorted(model["keys"], keys), len(model["keys"]) - 1)
    llr = np.where(model["keys"][i] == keys, model["llr"][i], 0)
    of_word = np.bincount(which, llr[where], len(first))[back]
    return np.stack([np.bincount(w.doc, x, w.n) for x in (of_word, np.maximum(of_word - MARGIN, 0))]) / np.maximum(w.count, 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[list[float], float]:
    """Slopes and intercept by Newton's method with a little ridge on standardised columns."""
    scale = x.std(0) + 1e-9
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return (w[:-1] / scale).tolist(), float(w[-1])


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def count_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """gram, c0, c1: how often each n-gram stands in ordinary and in toxic training rows."""
    rows = docs.filter(fold_of().isin(1, 2, 3)).join(known_labels(labels).hint("merge"), "doc_id").select("toxic", "text")
    return keep(rows.mapInPandas(_count, "gram long, c0 long, c1 long").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))


def fit_here(grams: DataFrame) -> dict:
    """The model as arrays on the driver."""
    got = grams.toArrow()
    keys, c0, c1 = (got.column(c).to_numpy() for c in ("gram", "c0", "c1"))
    order = np.argsort(keys.view(np.uint64))
    return fit(keys.view(np.uint64)[order], c0[order].astype(float), c1[order].astype(float))


def _ending(n: int):
    """The last n bytes of an n-gram."""
    return F.col("gram").bitwiseAND(F.lit(2 ** (8 * n) - 1))


def _discounted_table(t: DataFrame, of: dict[str, str]) -> DataFrame:
    """`t` (gram, under, counts) with the column `of[c]` for each count c: what `_discounted` gives."""
    once = t.agg(*(F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in of for n in (1, 2))).first()
    same = Window.partitionBy(F.shiftright("gram", 8))
    for c, name in of.items():
        n1, n2 = once[f"{c}_1"], once[f"{c}_2"]
        d = F.lit(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
        total, types = F.sum(c).over(same), F.count_if(F.col(c) > 0).over(same)
        back = F.when(total > 0, d * types / F.greatest(total, F.lit(1))).otherwise(1.0)
        t = t.withColumn(name, F.when(F.col(c) > 0, F.col(c) - d).otherwise(0.0) / F.greatest(total, F.lit(1)) + back * F.col("under"))
    return t


def fit_table(grams: DataFrame) -> DataFrame:
    """gram, llr: what `fit` gives, without collecting the n-grams."""
    levels = [grams]
    for k in range(ORDER - 1, 0, -1):
        levels.append(keep(levels[-1].groupBy(_ending(k).alias("gram")).agg(F.count("*").alias("c"))))
    p, made = None, levels[1:]
    for k in range(1, ORDER + 1):
        t = levels[ORDER - k]
        if p is None:
            t = t.withColumn("under", F.lit(1 / 256))
        else:
            t = t.withColumn("ending", _ending(k - 1)).join(p.select(F.col("gram").alias("ending"), F.col("p").alias("under")).hint("merge"), "ending").drop("ending")
        t = keep(t)
        made.append(t)
        if k < ORDER:
            p = _discounted_table(t, {"c": "p"})
    ratio = _discounted_table(t, {"c0": "p0", "c1": "p1"})
    out = keep(ratio.filter(F.col("c0") + F.col("c1") >= MIN_COUNT).select("gram", (F.log("p1") - F.log("p0")).cast("float").cast("double").alias("llr")))
    drop(*made)
    return out


def _words(batches):
    """Words of each text with their number; long ones go by a digest, which has a blank so that no word is equal to it."""
    for pdf in batches:
        for first, held in pieces(pdf.text.tolist()):
            w = Words(held, fold=LOWER)
            if not len(w.start):
                continue
            h = w.hashes()
            order = np.lexsort((h, w.doc))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(w.doc[order]) != 0) | (h[order][1:] != h[order][:-1])]))
            some = order[new]
            held = [w.buf[a:b].tobytes() for a, b in zip(w.start[some], w.end[some])]
            word = [x if len(x) <= 32 else hashlib.sha256(x).digest() + b" " for x in held]
            whole = [None if len(x) <= 32 else x for x in held]
            yield pd.DataFrame({_KEY: pdf[_KEY].to_numpy()[first + w.doc[some]], "word": word, "whole": whole, "n": np.diff(np.append(new, len(order)))})


def _grams_of_words(batches):
    for pdf in batches:
        held = [word if whole is None else whole for word, whole in zip(pdf.word, pdf.whole)]
        piece = np.cumsum([len(x) for x in held]) // PIECE
        for some in np.split(np.arange(len(held)), np.flatnonzero(np.diff(piece)) + 1) if held else ():
            which, key = word_grams(Words([held[i] for i in some]), np.arange(len(some)))
            yield pd.DataFrame({"word": pdf.word.to_numpy()[some[which]], "gram": key.view(np.int64)})


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))


def evidence_table(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Evidence of each text that has words, by a hash of the text: what `evidence` gives, with the model as a table.

    A text that stands in several rows counts that many times above and below the line.
    """
    words = keep(_keyed(docs.select("text")).mapInPandas(_words, f"{_KEY} binary, word binary, whole binary, n long"))
    grams = words.select("word", "whole").distinct().mapInPandas(_grams_of_words, "word binary, gram long")
    known = grams.join(model.hint("merge"), "gram").groupBy("word").agg(F.sum("llr").alias("e"))
    e, n = F.coalesce("e", F.lit(0.0)), F.col("n")
    rows = words.join(known.hint("merge"), "word", "left")
    out = keep(rows.groupBy(_KEY).agg((F.sum(n * e) / F.sum(n)).alias("evidence"), (F.sum(n * F.greatest(e - MARGIN, F.lit(0.0))) / F.sum(n)).alias("beyond")))
    drop(words)
    return out


def with_evidence(docs: DataFrame, table: DataFrame) -> DataFrame:
    """`docs` with the columns evidence and beyond, 0 for texts without words."""
    rows = _keyed(docs).join(table.hint("merge"), _KEY, "left").drop(_KEY)
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("evidence", "beyond")})


def _evidences(texts, model: dict):
    """(index of the first text, evidence) of each piece."""
    for first, held in pieces(texts):
        yield first, evidence(Words(held, fold=LOWER), model)


def calibrate(docs: DataFrame, labels: DataFrame, sent, sample: int = CALIBRATE) -> tuple[list[float], float]:
    """Slopes and intercept of the curve from evidence to score, from fold 4."""

    def run(batches):
        for pdf in batches:
            for first, e in _evidences(pdf.text.tolist(), sent.value):
                part = pdf.iloc[first : first + e.shape[1]]
                yield pd.DataFrame({"doc_id": part.doc_id, "toxic": part.toxic, "evidence": e[0], "beyond": e[1]})

    rows = docs.filter(fold_of() == 4).join(known_labels(labels).hint("merge"), "doc_id").select("doc_id", "toxic", "text")
    if isinstance(sent, DataFrame):
        rows = with_evidence(rows, sent).drop("text")
    else:
        rows = rows.mapInPandas(run, "doc_id long, toxic int, evidence double, beyond double")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow().to_pandas()
    if got.toxic.nunique() < 2:
        return [0.0, 1.0], -0.5
    return _logistic(got[["evidence", "beyond"]].to_numpy(), got.toxic.to_numpy(float))


def fitted(docs: DataFrame, labels: DataFrame, max_grams: int):
    """(broadcast model or evidence table of `docs`, slopes, intercept), or None if there is nothing to learn from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = count_grams(docs, labels)
    n, *each = grams.agg(F.count("*"), F.sum("c0"), F.sum("c1")).first()
    if not all(each):
        return None
    if n <= max_grams:
        sent = docs.sparkSession.sparkContext.broadcast(fit_here(grams))
    else:
        model = fit_table(grams)
        sent = evidence_table(docs, model)
        drop(model)
    drop(grams)
    return sent, *calibrate(docs, labels, sent)


def toxicity(docs: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, beyond for each row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out")
    got = fitted(docs, labels, max_grams)
    if got is None:
        zero = F.lit(0.0)
        return docs.select("doc_id", held_out, zero.alias("score"), F.lit(0).alias("predicted"), zero.alias("evidence"), zero.alias("beyond"))
    sent, slopes, b = got

    def run(batches):
        for pdf in batches:
            for first, e in _evidences(pdf.text.tolist(), sent.value):
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[first : first + e.shape[1]].astype("Int64"), "evidence": e[0], "beyond": e[1]})

    p = 1 / (1 + F.exp(-(F.lit(slopes[0]) * F.col("evidence") + F.lit(slopes[1]) * F.col("beyond") + F.lit(b))))
    out = with_evidence(docs, sent) if isinstance(sent, DataFrame) else docs.mapInPandas(run, "doc_id long, evidence double, beyond double")
    return out.select("doc_id", held_out, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "evidence", "beyond")


def without_toxic(docs: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Rows of `docs` that are not predicted toxic, with all their columns."""
    got = fitted(docs, labels, max_grams)
    if got is None:
        return docs
    sent, slopes, b = got
    if isinstance(sent, DataFrame):
        line = sent.select(_KEY, (F.lit(slopes[0]) * F.col("evidence") + F.lit(slopes[1]) * F.col("beyond") + F.lit(b)).alias("_op7_line"))
        return _keyed(docs).join(line.hint("merge"), _KEY, "left").filter(F.coalesce("_op7_line", F.lit(b)) < 0).drop(_KEY, "_op7_line")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            stays = np.zeros(batch.num_rows, bool)
            for first, e in _evidences(batch.column(at).to_pylist(), sent.value):
                stays[first : first + e.shape[1]] = slopes[0] * e[0] + slopes[1] * e[1] + b < 0
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
