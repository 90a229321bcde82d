"""Operator 13: byte-exact removal of repeated passages by a distributed merge sort of suffixes.

Texts are UTF-8 bytes.  A byte goes if a string of `LENGTH` bytes over it also starts anywhere else,
in the same text or another; strings are judged on the input and never cross texts.

How it runs.  Not all suffixes are sorted, only those at anchors: an anchor is a position whose next `HEAD` bytes
(its head) have the smallest hash among the heads of some window of `LENGTH` bytes.  A window and
its copies have the same anchor at the same distance, so equal windows meet at equal heads.  The span of
an anchor holds all windows that it can be the anchor of: up to LENGTH - HEAD bytes left of it and
LENGTH bytes right of it.

1. Texts are put into compressed packs of a bounded size, kept in the shared folder.  Each pack names the anchors'
   heads and spans by 64-bit hashes, each span once.  Rows meet by head: a head that stands in the corpus once is out;
   a span that stands there twice is repeated in full, and only its first pack goes on with it; so copies, however many, send no text.
2. Packs sort the spans that share a head with other spans by (hash of the head, bytes from the anchor on): a sorted suffix
   run.  Runs are cut into ranges of the hash, front-coded, and exchanged.
3. Each range merges its runs in a loser tree.  A run's code says how long a prefix each suffix shares with the one before
   it, and the tree keeps for every loser the length of the prefix that it shares with the last winner, so bytes known to be equal are
   never compared again.  The merged order comes with the common prefix of neighbours; the bytes before the anchors are
   sorted from the anchor backwards likewise.
4. The window that begins d bytes before the anchor equals another one exactly if the suffixes share LENGTH - d
   bytes and the bytes before the anchors share d.  For each d both orders fall into classes, at the places where neighbours share less; a
   pair of classes that two spans have is a repeated window.  This is exact and takes no pairs of spans.
5. Packs get their repeated spans and windows back and put the remaining bytes together.

A head with more than `CROWD` different spans isn't merged in one task: its windows are grouped by Spark under 128-bit
digests instead (same result).

Defined cases: a null or short text loses nothing; a null id is carried through; rows are texts of their own whatever their id, so
repeated rows repeat each other; very long texts are packs of their own and hashed in overlapping
segments; ties of hashes are all anchors, as in runs of one byte; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm import kernel
from narrata.llm.kernel import acyclic, common, mix
from narrata.llm.store import keep

LENGTH, HEAD = 200, 50
#: Bytes of a pack and of a segment of a long text; spans of a range (by expectation); spans of a head that one task merges.
PACK, SEGMENT, PER_RANGE, CROWD = 2_000_000, 2_000_000, 8_192, 200_000


def _slide(a: np.ndarray, n: int, least) -> np.ndarray:
    """least(a[i:i + n]) for each i."""
    size = 1
    while 2 * size <= n:
        a, size = least(a[:-size], a[size:]), 2 * size
    return least(a[: len(a) - (n - size)], a[n - size :]) if size < n else a


def anchors(body: np.ndarray, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, ...]:
    """(position, bytes to the left, bytes to the right, hash of the head, hash of the span) of each anchor of one text."""
    n, reach = len(body), length - head
    found = []
    for start in range(0, n if n >= length else 0, SEGMENT):
        first, last = max(0, start - 2 * length), min(n, start + SEGMENT + 2 * length)
        part = body[first:last]
        if len(part) < length:
            continue
        kernel._powers(len(part) + 1)
        power, inverse = kernel._POW[: len(part)], kernel._INV
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
            h = mix((total[head:] - total[:-head]) * inverse[: len(part) - head + 1], 3)
            low = _slide(h, reach + 1, np.minimum)
            edge = np.zeros(reach, np.uint64)
            p = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), reach + 1, np.maximum) == h)
            p = p[(p + first >= start) & (p + first < start + SEGMENT)]
            a, b = np.maximum(p - reach, 0), np.minimum(p + length, len(part))
            g = mix((total[b] - total[a]) * inverse[a] + mix(((p - a) * 1024 + (b - p)).astype(np.uint64), 4), 5)
        found.append((p + first, p - a, b - p, h[p].view(np.int64), g.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def _packs(batches):
    """Packs of a partition; their numbers are unique as the table is written once."""
    number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
    press = zstandard.ZstdCompressor(3)

    def row():
        own, blank = [i or 0 for i in ids], [k for k, i in enumerate(ids) if i is None]
        return pd.DataFrame({"pack": [number], "ids": [own], "blank": [blank], "sizes": [list(map(len, texts))], "body": [press.compress(b"".join(texts))]})

    for pdf in batches:
        for i, t in zip(pdf.doc_id.astype("Int64"), pdf.text):
            b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
            if texts and size + len(b) > PACK:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(None if i is pd.NA else int(i))
            texts.append(b)
            size += len(b)
    if texts:
        yield row()


def _texts(sizes, body: bytes):
    """(where it begins, bytes) of each text of a pack, and the whole."""
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if len(body) else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    return whole, at


def _name(length: int, head: int):
    """Each span of a pack once: hashes of head and span, and `place`: where its first anchor is, the bytes on both sides, and whether it stands there again."""

    def run(batches):
        for pdf in batches:
            for pack, sizes, body in zip(pdf.pack, pdf.sizes, pdf.body):
                whole, at = _texts(sizes, body)
                found = [anchors(whole[a:b], length, head) for a, b in zip(at, at[1:])]
                p, left, right, h, g = (np.concatenate([x[k] + (a if k == 0 else 0) for x, a in zip(found, at)]) for k in range(5))
                order = np.lexsort((p, g, h))
                p, left, right, h, g = (x[order] for x in (p, left, right, h, g))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                again = np.zeros(len(h), bool)
                again[:-1] = ~new[1:]
                place = (p << 21) | (left << 11) | (right << 1) | again
                yield pd.DataFrame({"h": h[new], "g": g[new], "pack": np.full(new.sum(), pack), "place": place[new]})

    return run


def _apart(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 21, (place >> 11) & 1023, (place >> 1) & 1023


def front_coded(keys: list[bytes]) -> tuple[list[int], bytes]:
    """Bytes that each key shares with the one before it, and the rest of all."""
    shared, rest, before = [], [], b""
    for k in keys:
        n = common(before, k, 0)
        shared.append(n)
        rest.append(k[n:])
        before = k
    return shared, b"".join(rest)


class LoserTree:
    """Merges sorted runs of (key, bytes shared with the key before it in the run, anything).

    Iterating gives (key, bytes shared with the key before it, anything) in order.  `shared[i]` is what the head of run i
    shares with the last key that went out; on the path of the next winner all losers lost to that
    key, so two heads need comparing only if they share equally much with it, and only beyond that.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs, self.compared = runs, 0
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.leaves - len(runs))
        self.shared = [0 if x else -1 for x in self.heads]
        self.losers = [0] * self.leaves
        self.winner = self._first(1)

    def _first(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        winner, self.losers[node] = self._match(self._first(2 * node), self._first(2 * node + 1))
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); what the loser shares is brought up to the winner."""
        m, n = self.shared[a], self.shared[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        if m < 0:
            return a, b
        x, y = self.heads[a][0], self.heads[b][0]
        both = common(x, y, m)
        self.compared += both - m + 1
        if both == len(x) or (both < len(y) and x[both] < y[both]):
            self.shared[b] = both
            return a, b
        self.shared[a] = both
        return b, a

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield head[0], self.shared[w], head[2]
            self.heads[w] = fresh = next(self.runs[w], None)
            self.shared[w] = fresh[1] if fresh else -1
            node = (w + self.leaves) >> 1
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node >>= 1
            self.winner = w


def _runs(bits: int):
    """The sorted suffix run of a pack, cut into ranges."""

    def run(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(packs) and len(asked):
            whole, _ = _texts(packs.sizes.iloc[0], packs.body.iloc[0])
            whole, press = whole.tobytes(), zstandard.ZstdCompressor(3)
            p, left, right = _apart(asked.place.to_numpy())
            h = asked.h.to_numpy().view(np.uint64)
            many = asked.many.to_numpy().astype(np.int64)
            spans = zip(h.tolist(), p.tolist(), left.tolist(), right.tolist(), many.tolist())
            spans = sorted((x.to_bytes(8) + whole[at : at + r], whole[at - lo : at], at, m) for x, at, lo, r, m in spans)
            at = np.sort(h)
            cut = at >> np.uint64(64 - bits) if bits else np.zeros(len(at), np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1], [True]]))
            for a, b in zip(edges, edges[1:]):
                keys, lefts, places, marks = zip(*spans[a:b])
                shared, rest = front_coded(list(keys))
                numbers = np.array([shared, list(map(len, keys)), list(map(len, lefts)), places, marks], np.int64)
                out.append((int(cut[a]), packs.pack.iloc[0], b - a, press.compress(numbers.tobytes()), press.compress(rest), press.compress(b"".join(lefts))))
        return pd.DataFrame(out, columns=["range", "pack", "n", "numbers", "rest", "lefts"]).astype({"range": "int64", "pack": "int64", "n": "int32"})

    return run


def _decoded(pack: int, n: int, numbers: bytes, rest: bytes, lefts: bytes):
    """A run as (key, shared, (left bytes, pack, place, many))."""
    raw = zstandard.ZstdDecompressor()
    shared, sizes, left, places, many = np.frombuffer(raw.decompress(numbers), np.int64).reshape(5, n).tolist()
    rest, lefts, key, i, j = raw.decompress(rest) if any(sizes) else b"", raw.decompress(lefts) if any(left) else b"", b"", 0, 0
    for s, size, lo, place, m in zip(shared, sizes, left, places, many):
        key = key[:s] + rest[i : i + size - s]
        yield key, s, (lefts[j : j + lo], pack, place, m)
        i, j = i + size - s, j + lo


def repeated(keys: list[bytes], shared: list[int], lefts: list[bytes], length: int, head: int) -> np.ndarray:
    """For spans in merged order (key: 8 bytes of hash, then the suffix): which of the windows that begin 0 to length - head bytes before the anchor two of them have."""
    n, reach = len(keys), length - head
    suffix = np.array(shared, np.int64) - 8
    suffix[suffix < head] = -1
    suffix[:1] = -1
    order = sorted(range(n), key=lambda i: (keys[i][:8], lefts[i][::-1]))
    size = np.array([len(x) for x in lefts], np.int64)
    turned = np.zeros((n, reach), np.uint8)
    for k, i in enumerate(order):
        turned[k, : size[i]] = np.frombuffer(lefts[i][::-1], np.uint8)
    differ = turned[1:] != turned[:-1]
    before = np.full(n, -1)
    of = size[order]
    before[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), reach), np.minimum(of[1:], of[:-1])) if n > 1 and reach else 0
    heads = [keys[i][:8] for i in order]
    before[1:][np.array([x != y for x, y in zip(heads, heads[1:])], bool)] = -1
    right = np.array([len(k) - 8 for k in keys], np.int64)
    out, back = np.zeros((n, reach + 1), bool), np.empty(n, np.int64)
    for d in range(reach + 1):
        some = np.flatnonzero((size >= d) & (right >= length - d))
        if len(some) < 2:
            continue
        back[order] = np.cumsum(before < d)
        pair = np.cumsum(suffix < length - d)[some] * (n + 1) + back[some]
        rank = np.argsort(pair, kind="stable")
        same = np.diff(pair[rank]) == 0
        twice = np.zeros(len(some), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[some[rank[twice]], d] = True
    return out


def _merge(length: int, head: int):
    """Merges the runs of a range; gives repeated windows of spans that are not repeated in full: (pack, at, low, high), distances before the anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [_decoded(*x) for x in zip(pdf.pack, pdf.n, pdf.numbers, pdf.rest, pdf.lefts)]
        with acyclic():
            keys, shared, more = zip(*LoserTree(runs))
        lefts, packs, places, many = zip(*more)
        hit = repeated(list(keys), list(shared), list(lefts), length, head)
        hit[np.array(many, bool)] = False
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pd.DataFrame({"pack": np.array(packs, np.int64)[i], "at": np.array(places, np.int64)[i], "low": low.astype(np.int32), "high": (high - 1).astype(np.int32)})

    return run


def _windows(length: int):
    """Digests of all windows of crowded spans: (d, w, pack, at, many)."""

    def run(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(packs) and len(asked):
            whole = _texts(packs.sizes.iloc[0], packs.body.iloc[0])[0].tobytes()
            p, left, right = (x.tolist() for x in _apart(asked.place.to_numpy()))
            for at, lo, r, many in zip(p, left, right, asked.many.tolist()):
                for d in range(max(0, length - r), lo + 1):
                    out.append((d, hashlib.blake2b(whole[at - d : at - d + length], digest_size=16).digest(), packs.pack.iloc[0], at, many))
        return pd.DataFrame(out, columns=["d", "w", "pack", "at", "many"]).astype({"d": "int32", "pack": "int64", "at": "int64", "many": "bool"})

    return run


def _remove(length: int, head: int, texts: bool):
    def run(packs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(packs):
            whole, at = _texts(packs.sizes.iloc[0], packs.body.iloc[0])
            cover = np.zeros(len(whole) + 1, np.int32)
            full, some = marks[marks.full], marks[~marks.full]
            known = set(zip(full.h, full.g))
            for a, b in zip(at, at[1:]) if known else []:
                p, left, right, h, g = anchors(whole[a:b], length, head)
                use = np.fromiter((x in known for x in zip(h.tolist(), g.tolist())), bool, len(h)) & (left + right >= length)
                np.add.at(cover, a + (p - left)[use], 1)
                np.add.at(cover, a + (p + right)[use], -1)
            np.add.at(cover, (some["at"] - some.high).to_numpy(), 1)
            np.add.at(cover, (some["at"] - some.low + length).to_numpy(), -1)
            gone = np.cumsum(cover[:-1]) > 0
            blank = set(packs.blank.iloc[0])
            ids = [None if k in blank else int(i) for k, i in enumerate(packs.ids.iloc[0])]
            for i, a, b in zip(ids, at, at[1:]):
                own = gone[a:b]
                edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = whole[a:b][~own].tobytes()
                row = (i, b - a, int(own.sum()), len(starts), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, np.column_stack([starts, ends]).tolist()) if texts else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "removed"] * texts]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, head: int = HEAD, per_range: int = PER_RANGE, crowd: int = CROWD, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept (bytes) and removed ([start, end] of each run)."""
    packs = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_packs, "pack long, ids array<long>, blank array<long>, sizes array<long>, body binary"))
    named = packs.select("pack", "sizes", "body").mapInPandas(_name(length, head), "h long, g long, pack long, place long").repartition("h")
    one_span, one_head = Window.partitionBy("h", "g"), Window.partitionBy("h")
    spans = named.withColumns({
        "many": (F.count("*").over(one_span) > 1) | (F.max(F.col("place") % 2).over(one_span) == 1), "own": F.min("pack").over(one_span) == F.col("pack"),
    }).withColumn("crowd", F.sum(F.col("own").cast("long")).over(one_head))
    spans = keep(spans.filter("crowd > 1 or many"))
    asked = spans.filter("own and crowd > 1").select("h", "pack", "place", "many", "crowd")
    bits = max(0, math.ceil(math.log2(max(1, asked.count() / per_range))))
    by_pack = packs.select("pack", "sizes", "body").groupBy("pack")
    sortable = asked.filter(F.col("crowd") <= crowd).select(F.col("pack").alias("of"), "h", "place", "many")
    runs = by_pack.cogroup(sortable.groupBy("of")).applyInPandas(_runs(bits), "range long, pack long, n int, numbers binary, rest binary, lefts binary")
    hits = runs.groupBy("range").applyInPandas(_merge(length, head), "pack long, at long, low int, high int")
    crowded = asked.filter(F.col("crowd") > crowd).select(F.col("pack").alias("of"), "h", "place", "many")
    if not crowded.isEmpty():
        windows = keep(by_pack.cogroup(crowded.groupBy("of")).applyInPandas(_windows(length), "d int, w binary, pack long, at long, many boolean"))
        twice = windows.groupBy("d", "w").agg(F.count("*").alias("n")).filter("n > 1").select("d", "w")
        own = windows.filter("not many").join(twice.hint("merge"), ["d", "w"])
        hits = hits.unionByName(own.select("pack", "at", F.col("d").alias("low"), F.col("d").alias("high")))
    hits = keep(hits)
    zero = [F.lit(0).cast("long").alias(c) for c in ("h", "g", "at", "low", "high")]
    marks = spans.filter("many").select(F.col("pack").alias("of"), F.lit(True).alias("full"), "h", "g", *zero[2:])
    marks = marks.unionByName(hits.select(F.col("pack").alias("of"), F.lit(False).alias("full"), *zero[:2], "at", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))
    out = RESULT + (", kept binary, removed array<array<long>>" if texts else "")
    return packs.groupBy("pack").cogroup(marks.groupBy("of")).applyInPandas(_remove(length, head, texts), out)
