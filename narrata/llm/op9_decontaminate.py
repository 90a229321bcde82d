"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded to caseless (Unicode) words of letters, digits and non-ASCII
bytes, joined by single blanks.  A text and its upper-case form fold to the same words, also
where upper case has other letters (ß and SS, ı and I).  An item of n bytes may differ by k = max(1, n // ERROR_ONE_IN)
edits.  It is cut into k + 1 pieces: with at most k edits, one piece stands unchanged
(pigeonhole), at a place that tells where the item would begin.  Piece hits are found by the hash of
the `width` bytes with which each piece begins: all places of a batch of texts are hashed at once, a bit table
lets few of them through to a search in the sorted hashes, and a hit counts only if the whole piece stands there.
Around each hit, Myers' bit-parallel algorithm finds the least edit distance of the item to any stretch of the text.

Items are a stated query set: they go to the executors in blocks of at most `BLOCK_BYTES`, so that no
broadcast grows with the benchmark.  A block needs about twice its own size in hashes and no automaton; bit masks
are made for an item only when it is hit.  Items of one block need one scan of the documents.

Result: one row per document and matched item: doc_id, item_id, distance (least), start and
end (of the earliest best stretch, bytes of the folded text, end exclusive).

Defined cases: null or wordless texts and items match nothing; items with a null id are not
searched; equal items each match; rows that share a doc_id are searched one by one.  Items
shorter than `MIN_BYTES` after folding match only whole and unchanged, between word borders.  Of
equal distances the stretch that begins first is reported, then the shortest.  Texts of any length are searched whole.
Other columns are ignored; empty tables give an empty one.  Beyond `BLOCK_BYTES` of items, each further
block reads the documents once more.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.kernel import PIECE, mix

ERROR_ONE_IN, MIN_BYTES, BLOCK_BYTES = 20, 24, 16_000_000
#: Bytes of a piece that are hashed, at most; places that are hashed at once.
WIDTH, SLAB = 16, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bytes to themselves in lower case; all that isn't a letter, a digit or non-ASCII to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text) -> str:
    """The folded words joined by blanks, one character for each byte."""
    return b" ".join(text.upper().casefold().encode("utf-8", "surrogatepass").translate(FOLD).split()).decode("latin-1") if isinstance(text, str) else ""


def budget(n: int, one_in: int = ERROR_ONE_IN) -> int:
    return 0 if n < MIN_BYTES else max(1, n // one_in)


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(least distance, its first end) of a pattern of m characters to any stretch of text, if at most k."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= k else None


def best_match(item: str, peq: dict[str, int], text: str, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best stretch within text[lo:hi]; the longest of those that end first."""
    found = myers(peq, len(item), text[lo:hi], k)
    if not found:
        return None
    d, end = found
    back = text[lo : lo + end][::-1]
    _, size = myers(masks(item[::-1]), len(item), back[: len(item) + k], k) or (d, len(item))
    return d, lo + end - size, lo + end


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of `width` bytes: polynomials, whose widths are doubled."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    h, size, power = buf.astype(np.uint64), 1, _BASE
    with np.errstate(over="ignore"):
        for bit in bin(width)[3:]:
            h = h[:-size] * power + h[size:]
            size, power = 2 * size, power * power
            if bit == "1":
                h = h[:-1] * _BASE + buf[size:]
                size, power = size + 1, power * _BASE
    return mix(h)


class Matcher:
    """Pieces of one block of items, (item_id, folded text), as sorted hashes; short items as a map."""

    def __init__(self, items: list[tuple[int, str]], one_in: int):
        self.items = items
        self.budget = [budget(len(t), one_in) for _, t in items]
        self.short: dict[str, list[int]] = {}
        uses = []
        for i, (_, t) in enumerate(items):
            if self.budget[i] == 0:
                self.short.setdefault(t, []).append(i)
            else:
                uses += [(i, a, b) for a, b in cut(len(t), self.budget[i] + 1)]
        self.sizes = sorted({len(t) for t in self.short})
        self.uses = np.array(uses, np.int64).reshape(-1, 3)
        self.width = int(min((self.uses[:, 2] - self.uses[:, 1]).min(), WIDTH)) if uses else 0
        heads = b"".join(items[i][1][a : a + self.width].encode("latin-1") for i, a, _ in uses)
        keys = _hashes(np.frombuffer(heads, np.uint8), self.width)[:: self.width] if uses else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.uses = keys[order], self.uses[order]
        bits = min(26, max(12, (8 * len(keys)).bit_length()))
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True
        self.masks_of = functools.lru_cache(10_000)(lambda i: masks(items[i][1]))

    def hits(self, buf: np.ndarray):
        """(place, first, end of the uses) of each place where a piece may begin."""
        for first in range(0, len(buf) if len(self.keys) else 0, SLAB):
            h = _hashes(buf[first : first + SLAB + self.width - 1], self.width)
            at = np.flatnonzero(self.seen[h >> self.shift])
            lo, hi = (np.searchsorted(self.keys, h[at], side) for side in ("left", "right"))
            some = lo < hi
            yield from zip((first + at[some]).tolist(), lo[some].tolist(), hi[some].tolist())

    def short_hits(self, text: str, buf: np.ndarray):
        """(place, item) of each short item that stands between word borders."""
        if not self.sizes:
            return
        gap = np.concatenate([[True], (buf == 32) | (buf == 10), [True]])  # gap[p]: before place p; gap[p + 1]: at place p
        starts = np.flatnonzero(gap[:-1])
        for size in self.sizes:
            at = starts[: np.searchsorted(starts, len(buf) - size, "right")]
            for p in at[gap[at + size + 1]].tolist():
                for i in self.short.get(text[p : p + size], ()):
                    yield p, i

    def find(self, texts: list[str]):
        """(index of the text, of the item, distance, start, end) of each matched item of folded texts."""
        text = "\n".join(texts)  # no folded text holds a line feed, so nothing matches across texts
        buf = np.frombuffer(text.encode("latin-1"), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = ends - [len(t) for t in texts]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p, i in self.short_hits(text, buf):
            d = int(np.searchsorted(ends, p, "right"))
            lo = p - int(begins[d])
            found.setdefault((d, i), (0, lo, lo + len(self.items[i][1])))
        spans: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for p, first, end in self.hits(buf):
            d = int(np.searchsorted(ends, p, "right"))
            for i, a, b in self.uses[first:end].tolist():
                item, k = self.items[i][1], self.budget[i]
                if text.startswith(item[a:b], p):
                    begin = p - int(begins[d]) - a
                    lo, hi = max(0, begin - k), min(len(texts[d]), begin + len(item) + k)
                    if hi - lo >= len(item) - k:
                        spans.setdefault((d, i), set()).add((lo, hi))
        for (d, i), held in spans.items():
            item, k, best = self.items[i][1], self.budget[i], None
            for lo, hi in merged(held):
                whole = texts[d].find(item, lo, hi)
                m = (0, whole, whole + len(item)) if whole >= 0 else best_match(item, self.masks_of(i), texts[d], lo, hi, k)
                if m and (best is None or m < best):
                    best = m
            if best:
                found[d, i] = best
        for (d, i), best in found.items():
            yield d, i, *best


@functools.lru_cache(2)
def _matcher(items: tuple[tuple[int, str], ...], one_in: int) -> Matcher:
    return Matcher(list(items), one_in)


def _folded(texts):
    """Folded texts in slices of about `PIECE` bytes, or of one longer text: (first index, list)."""
    first, held, size = 0, [], 0
    for n, t in enumerate(texts):
        held.append(folded(t))
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            first, held, size = n + 1, [], 0
    if held:
        yield first, held


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """Folded items in blocks of at most `size` bytes (or one longer item), by ascending id, streamed through the driver."""
    held, room = [], size
    for item_id, text in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        t = folded(text)
        if t:
            if held and len(t) > room:
                yield tuple(held)
                held, room = [], size
            held.append((item_id, t))
            room -= len(t)
    if held:
        yield tuple(held)


def contamination(docs: DataFrame, benchmark: DataFrame, one_in: int = ERROR_ONE_IN) -> DataFrame:
    """doc_id, item_id, distance, start, end: matches of the items in `docs` (doc_id, text)."""
    schema = "doc_id long, item_id long, distance int, start long, end long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, sent=sent):
            m = _matcher(sent.value, one_in)
            for pdf in batches:
                ids = pdf.doc_id.astype("Int64")
                rows = [(ids.iloc[first + j], m.items[i][0], d, a, b) for first, held in _folded(pdf.text) for j, i, d, a, b in m.find(held)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64"})

        found = docs.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, one_in: int = ERROR_ONE_IN) -> DataFrame:
    """Rows of `docs` that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, sent=sent):
            m = _matcher(sent.value, one_in)
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for first, held in _folded(batch.column(at).to_pylist()):
                    stays[[first + j for j, *_ in m.find(held)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
