"""Operator 2: exact removal of repeated word windows, with a count-min prefilter.

A window is `window` consecutive words.  A word goes if some window over it has a word
sequence that also starts in a document with a smaller id.  Windows are judged on the
input.

How it runs.  Rows that are the same in id and text go through as one and are multiplied again
at the end.  Texts are dealt into blocks of a bounded size by a hash of id and text (one
shuffle, reused by all three passes over the text), so that an id that many rows share is
spread over the blocks:

1. each block makes a partition sketch: the sorted count-min cells of its windows, coded
   as gaps (about two bytes a window), cut into shards of the cell space;
2. shards merge the sketches of all blocks, and answer each block with one bit a cell:
   estimated repeated or not.  The sketch is never held in one place, so its width follows
   the corpus; an estimate is never too small, so no repeated window is lost;
3. blocks emit only windows estimated repeated, under 96-bit hashes; these are grouped
   exactly (smallest id of each), and each block gets back the windows to remove.

Whole copies of a text are found first by digest and skip the window passes: if they have
a full window, all their words go.

The sketch is a count-min sketch of depth one whose counters end at two, with
`CELLS_PER_WINDOW` cells for each window of the corpus at every size.  A pair of block and
shard is a row between the passes, so beyond about 1 TB those rows hold few windows each.

Defined cases: a null text has no words; a null id counts as larger than all others; rows
that share an id are judged one by one and never against each other; repeated rows have the
same result each; fewer words than a window: nothing is removed.  A very long text is a block
of its own and is read whole.  Columns other than doc_id and text are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.kernel import Words, ngram_hash, pieces
from narrata.llm.store import keep

WINDOW = 13
#: Bytes of text in a block, cells of a shard, sketch cells for each window of the corpus.
BLOCK_BYTES, SHARD_CELLS, CELLS_PER_WINDOW = 4_000_000, 1 << 20, 16
LAST = 2**63 - 1


def _windows(texts, n: int):
    """For texts in pieces: (index of the first text, Words, starts, 64-bit hash, 32-bit hash, text of each window)."""
    for first, held in pieces(texts):
        w = Words(held)
        h, at = w.hashes(), w.windows(n)
        yield first, w, at, ngram_hash(h, at, n, 1), (ngram_hash(h, at, n, 2) >> np.uint64(32)).astype(np.int32), w.doc[at]


def _sources(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Text rows of a block, and which of them are copies of a text with a smaller id."""
    marks = rows[rows.mark.notna()]
    rows = rows[rows.mark.isna()].reset_index(drop=True)
    copy = np.zeros(len(rows), bool)
    if len(marks):
        known = set(zip(marks.k, marks.mark))
        for i in np.flatnonzero(rows.k.isin(set(marks.k)).to_numpy()):
            t = rows.text[i]
            copy[i] = isinstance(t, str) and (rows.k[i], hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()) in known
    return rows, copy


def _cells(rows: pd.DataFrame, copy: np.ndarray, n: int, bits: int):
    """Sorted distinct cells of the block's windows, and which of them two of its texts share."""
    texts = [None if c else t for t, c in zip(rows.text, copy)]
    found = []
    for _, _, _, h, _, doc in _windows(texts, n):
        cell = h >> np.uint64(64 - bits)
        order = np.lexsort((cell, doc))
        cell, doc = cell[order], doc[order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
        found.append(cell[new])
    cells = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    if not len(cells):
        return cells, np.zeros(0, bool)
    first = np.concatenate([[True], cells[1:] != cells[:-1]])
    return cells[first], np.diff(np.concatenate([np.flatnonzero(first), [len(cells)]])) > 1


def _code(cells: np.ndarray) -> bytes:
    gaps = np.diff(cells, prepend=np.uint64(0))
    kind = np.uint16 if gaps[1:].max(initial=0) < 2**16 and gaps[0] < 2**16 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes()


def _decode(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.uint64))


def substring_dedup(docs: DataFrame, window: int = WINDOW, cells_per_window: int = CELLS_PER_WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if `texts`, kept_text for each row of `docs` (doc_id, text)."""
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.col("text"))
    ids = keep(base.select("k", md5.alias("mark"), F.octet_length("text").alias("b")))
    total = ids.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    blocks = max(64, math.ceil(total / BLOCK_BYTES))
    bits = min(60, max(20, math.ceil(math.log2(max(1, total / 6) * cells_per_window))))  # cells are the first bits of a 64-bit hash
    block_of = lambda mark: F.pmod(F.xxhash64("k", mark), F.lit(blocks)).cast("int").alias("block")
    again = keep(ids.groupBy("k", "mark").agg(F.count("*").alias("times")).filter("times > 1"))
    repeats = not again.isEmpty()
    if repeats:
        marked = base.withColumn("again", md5)
        same = (F.col("k") == F.col("ak")) & (F.col("again") == F.col("mark"))
        of = again.select(F.col("k").alias("ak"), "mark").hint("merge")
        one = marked.join(of, same, "left_semi").dropDuplicates(["k", "again"])
        base = marked.join(of, same, "left_anti").unionByName(one).select("doc_id", "k", "text")
    shard_bits = min(bits - 8, max(4, math.ceil(math.log2(max(1, total / 6) / SHARD_CELLS))))
    low = bits - shard_bits

    copies = keep(ids.groupBy("mark").agg(F.min("k").alias("least"), F.max("k").alias("most")).filter("least < most"))  # a table: joins of hot digests can be split
    marks = ids.join(copies, "mark").filter("k > least").select("k", "mark").distinct()
    rows = base.select(block_of(md5), "k", "doc_id", "text", F.lit(None).cast("string").alias("mark")).unionByName(
        marks.select(block_of(F.col("mark")), "k", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "mark")
    )

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf.block.iloc[0])
        cells, twice = _cells(*_sources(pdf), window, bits)
        cut = np.searchsorted(cells >> np.uint64(low), np.arange(2**shard_bits + 1))
        out = [
            (b, s, _code(cells[i:j] & np.uint64(2**low - 1)), np.packbits(twice[i:j]).tobytes())
            for s, (i, j) in enumerate(itertools.pairwise(cut))
            if i < j
        ]
        return pd.DataFrame(out, columns=["block", "shard", "cells", "twice"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_decode(c) for c in pdf.cells]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(p)].astype(bool) for t, p in zip(pdf.twice, parts)]
        cells, where, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = n > 1
        many[where[np.concatenate(twice)]] = True
        cut = np.cumsum([0, *map(len, parts)])
        bits_of = [np.packbits(many[where[i:j]]).tobytes() for i, j in itertools.pairwise(cut)]
        return pd.DataFrame({"block": pdf.block, "shard": pdf.shard, "n": [len(p) for p in parts], "many": bits_of})

    answers = (
        rows.groupBy("block").applyInPandas(sketch, "block int, shard int, cells binary, twice binary")
        .groupBy("shard").applyInPandas(merge, "block int, shard int, n int, many binary")
    )

    def suspects(pdf: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(said):
            return pd.DataFrame({"h": [], "g": [], "k": [], "block": []}).astype({"h": "int64", "g": "int32", "k": "int64", "block": "int32"})
        rows_, copy = _sources(pdf)
        cells, _ = _cells(rows_, copy, window, bits)
        said = said.sort_values("shard")
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(said.many, said.n)]).astype(bool)
        cells = cells[many]
        ks, out = rows_.k.to_numpy(), []
        texts = [None if c else t for t, c in zip(rows_.text, copy)]
        for first, _, _, h, g, doc in _windows(texts, window):
            cell = h >> np.uint64(64 - bits)
            i = np.minimum(np.searchsorted(cells, cell), max(0, len(cells) - 1))
            hit = cells[i] == cell if len(cells) else np.zeros(len(cell), bool)
            out.append(pd.DataFrame({"h": h[hit].view(np.int64), "g": g[hit], "k": ks[first + doc[hit]]}).drop_duplicates())
        return pd.concat(out).assign(block=pdf.block.iloc[0])

    flagged = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(suspects, "h long, g int, k long, block int")
    flagged = keep(flagged)
    least = flagged.groupBy("h", "g").agg(F.min("k").alias("least"), F.max("k").alias("most")).filter("least < most")
    gone = flagged.join(least, ["h", "g"]).filter("k > least").select("block", "k", "h", "g")

    def remove(pdf: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        rows_, copy = _sources(pdf)
        gone = gone.sort_values(["k", "h"])
        gk, gh, gg = gone.k.to_numpy(), gone.h.to_numpy(), gone.g.to_numpy()
        ks, out = rows_.k.to_numpy(), []
        for first, w, at, h, g, doc in _windows(rows_.text.tolist(), window):
            h = h.view(np.int64)
            for i in range(w.n):
                raw = w.buf[w.at[i] : (w.at[i + 1] if i + 1 < w.n else len(w.buf))].tobytes()
                words, n = raw.split(), int(w.count[i])
                kept = words
                lo, hi = np.searchsorted(gk, [ks[first + i]], "left")[0], np.searchsorted(gk, [ks[first + i]], "right")[0]
                if copy[first + i]:
                    kept = words if n < window else []
                elif lo < hi and n >= window:
                    a, b = np.searchsorted(doc, [i, i + 1])
                    known = gh[lo:hi]
                    p = np.searchsorted(known, h[a:b])
                    hit = (p < len(known)) & (known[np.minimum(p, len(known) - 1)] == h[a:b])
                    pairs = set(zip(gh[lo:hi].tolist(), gg[lo:hi].tolist()))
                    hit[hit] = [x in pairs for x in zip(h[a:b][hit].tolist(), g[a:b][hit].tolist())]
                    cover = np.zeros(n + 1, np.int32)
                    s = at[a:b][hit] - w.first[i]
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                    kept = list(itertools.compress(words, (np.cumsum(cover[:n]) == 0).tolist()))
                joined = b" ".join(kept)
                mark = hashlib.md5(raw[:-1]).hexdigest() if repeats else None
                out.append((rows_.doc_id[first + i], n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if texts else None, mark))
        pdf = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "mark"])
        return pdf.astype({"doc_id": "Int64"})

    out = rows.groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(
        remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, mark string"
    )
    if repeats:
        out = out.withColumn("k", F.coalesce("doc_id", F.lit(LAST))).join(again.hint("merge"), ["k", "mark"], "left")
        out = out.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts)
