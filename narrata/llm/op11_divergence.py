"""Operator 11: how far the vocabulary of each source departs from the others of its language.

Null text, lang and source are ''.  Terms are runs of ASCII letters and code points beyond
ASCII; only A-Z are lower-cased.  A language keeps the V terms that stand in at least `MIN_DOCS` of
its documents.  In a group (a source of a language, or the whole language) with N occurrences of
kept terms, a kept term with `count` of them weighs

    p = 1 + floor(1,000,000,000 * (count + 5) / (N + 5 * V))

For two groups f = |p - q|.  Part `pair`: for each other source of the language the sum of f over all
kept terms, all ranks.  Part `term`: kept terms of the group with count > 0 and p above the language's
q, by f, ranks to `TOP`.

How it runs.

1. Each task counts the terms of its texts into one radix trie over UTF-8 bytes for each language; a
   leaf has the number of documents and a counter for each source.  A trie that reaches `LEAVES`
   counters goes out and a new one begins, so memory is bounded and nothing is dropped.
2. Tries leave as subtrees: one front-coded row for each prefix of `CUT` bytes.  Rows are dealt out by ranges of
   prefixes and merged in order, one prefix's trie at a time, so that a task holds no more than a prefix has terms.
   Merged ranges lose the terms below `MIN_DOCS` and are kept.
3. V and N are sums over the merged rows; p and f are exact integers (long division in steps of
   1,000, exact up to 9e15 occurrences).
4. Each task walks its merged tries in byte order, that is in UTF-8 order of the terms.  Pairs:
   the differences are summed in blocks of `TILE` sources by `TILE`, one partial row for each pair and task.
   Terms: the task's best `TOP` for each group; equal values keep the order of the walk.  Partial rows are added up, partial
   lists ranked; what one group receives is bounded by the number of tasks.

Defined cases: a group without terms has count 0 for each kept term; with V = 0 all values are 0;
a language with one source has no pairs; rows are documents, repeated ids and repeated rows count each;
ties go to the smaller item in UTF-8 order; a very long text is read piece by piece; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.kernel import acyclic, common
from narrata.llm.store import keep

MIN_DOCS, TOP = 30, 50
#: Counters of a task's tries before they go out; bytes of a prefix; counters of a merged row; sources of a tile; bytes of a long text's pieces.
LEAVES, CUT, RANGE, TILE, PIECE = 400_000, 3, 20_000, 256, 8_000_000

#: Bytes outside terms to spaces, A-Z to a-z.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Trie:
    """A radix trie over bytes.  A node is [edges by first byte: (label, node), documents, counters by source]."""

    def __init__(self):
        self.root: list = [{}, 0, None]
        self.leaves = 0
        #: The nodes passed by the last term with their depths; terms mostly come in order and go on from there.
        self.last, self.path = b"", [(0, self.root)]

    def add(self, term: bytes, docs: int, counts: dict[str, int]) -> None:
        """Adds to a term's leaf; `counts` may become the leaf's own."""
        path, known = self.path, common(self.last, term)
        while path[-1][0] > known:
            path.pop()
        (at, node), self.last = path[-1], term
        while at < len(term):
            edge = node[0].get(term[at])
            if edge is None:
                fresh = [{}, 0, None]
                node[0][term[at]] = (term[at:], fresh)
                node, at = fresh, len(term)
            else:
                label, child = edge
                if term.startswith(label, at):
                    node, at = child, at + len(label)
                else:
                    n = common(label, term[at:])
                    middle = [{label[n]: (label[n:], child)}, 0, None]
                    node[0][term[at]] = (label[:n], middle)
                    node, at = middle, at + n
            path.append((at, node))
        node[1] += docs
        own = node[2]
        if own is None:
            node[2] = counts
            self.leaves += len(counts)
            return
        before = len(own)
        for source, n in counts.items():
            own[source] = own.get(source, 0) + n
        self.leaves += len(own) - before

    def walk(self):
        """(term, documents, counters) in byte order."""
        stack = [(b"", self.root)]
        while stack:
            term, node = stack.pop()
            if node[2] is not None:
                yield term, node[1], node[2]
            stack += [(term + label, child) for _, (label, child) in sorted(node[0].items(), reverse=True)]

    def merge(self, code: bytes, numbers: bytes, sources) -> None:
        for term, docs, counts in decoded(code, numbers, sources):
            self.add(term, docs, counts)


def coded(leaves) -> tuple[bytes, bytes, list[str]]:
    """Front-coded leaves: new bytes of each term; (shared bytes, new bytes, documents, counters, (source, count)...) as longs; the sources."""
    code, numbers, index, before = [], [], {}, b""
    for term, docs, counts in leaves:
        n = min(len(before), len(term))
        if before[:n] != term[:n]:
            n -= ((int.from_bytes(before[:n]) ^ int.from_bytes(term[:n])).bit_length() + 7) // 8
        code.append(term[n:])
        for source in counts:
            if source not in index:
                index[source] = len(index)
        numbers += (n, len(term) - n, docs, len(counts))
        numbers += [x for source, count in counts.items() for x in (index[source], count)]
        before = term
    return b"".join(code), np.array(numbers, np.int64).tobytes(), list(index)


def decoded(code: bytes, numbers: bytes, sources):
    x, at, byte, term = np.frombuffer(numbers, np.int64).tolist(), 0, 0, b""
    while at < len(x):
        n, new, docs, k = x[at : at + 4]
        term = term[:n] + code[byte : byte + new]
        at, byte = at + 4, byte + new
        yield term, docs, {sources[x[i]]: x[i + 1] for i in range(at, at + 2 * k, 2)}
        at += 2 * k


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_pieces(text: str, size: int = PIECE):
    """The UTF-8 bytes of a text in pieces that end where a term cannot go on."""
    if len(text) <= size:
        yield text.encode("utf-8", "surrogatepass")
        return
    at = 0
    while at < len(text):
        gap = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, min(len(text), at + size))
        end = gap.end() if gap else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass")
        at = end


PREFIXES = "lang string, prefix binary, code binary, numbers binary, sources array<string>"
_NAMES = ["lang", "prefix", "code", "numbers", "sources"]


def _subtrees(lang: str, trie: Trie, cut: int = CUT) -> pd.DataFrame:
    parts = itertools.groupby(trie.walk(), lambda leaf: leaf[0][:cut])
    return pd.DataFrame([(lang, prefix, *coded(leaves)) for prefix, leaves in parts], columns=_NAMES)


def _count(limit: int):
    def run(batches):
        tries: dict[str, Trie] = defaultdict(Trie)
        for pdf in batches:
            for lang, of_lang in pdf.groupby("lang", sort=False):
                docs: Counter = Counter()
                counts: dict[bytes, dict[str, int]] = defaultdict(dict)
                for source, texts in of_lang.groupby("source", sort=False).text:
                    total: Counter = Counter()
                    for t in texts:
                        seen: set[bytes] = set()
                        for piece in term_pieces(t):
                            found = terms(piece)
                            total.update(found)
                            seen.update(found)
                        docs.update(seen)
                    for term, n in total.items():
                        counts[term][source] = n
                trie = tries[lang]
                for term in sorted(counts):
                    trie.add(term, docs[term], counts[term])
                if trie.leaves >= limit:
                    yield _subtrees(lang, tries.pop(lang))
        for lang, trie in tries.items():
            yield _subtrees(lang, trie)

    return run


def _merge(least: int, span: int):
    """Merges rows that come sorted by language and prefix.  Terms below `least` documents go; neighbouring prefixes share a row of up to `span` counters."""

    def run(batches):
        key, trie, held, n, out = None, Trie(), [], 0, []

        def close() -> None:
            nonlocal held, n
            if held:
                out.append((key[0], held[0][0][:CUT], *coded(held)))
            held, n = [], 0

        def end(fresh) -> None:
            """The rows of a prefix are over."""
            nonlocal n
            leaves = [leaf for leaf in trie.walk() if leaf[1] >= least]
            held.extend(leaves)
            n += trie.leaves
            if n >= span or fresh is None or fresh[0] != key[0]:
                close()

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if (row.lang, row.prefix) != key:
                    if key is not None:
                        end((row.lang, row.prefix))
                    key, trie = (row.lang, row.prefix), Trie()
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=_NAMES)
                        out.clear()
                trie.merge(row.code, row.numbers, row.sources)
        if key is not None:
            end(None)
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def _totals(batches):
    """Occurrences of each source and the number of terms (source null), for each merged row."""
    for pdf in batches:
        out = []
        for lang, code, numbers, sources in zip(pdf.lang, pdf.code, pdf.numbers, pdf.sources):
            total: Counter = Counter()
            n = 0
            for _, _, counts in decoded(code, numbers, sources):
                total.update(counts)
                n += 1
            out += [(lang, s, x) for s, x in total.items()] + [(lang, None, n)]
        yield pd.DataFrame(out, columns=["lang", "source", "n"])


def weights(count: np.ndarray, n, v: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (n + 5 v)), exactly."""
    d = np.asarray(n, np.int64) + 5 * v
    left, out = count.astype(np.int64) + 5, np.zeros(np.broadcast(count, d).shape, np.int64)
    out, left = left // d, left % d
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // d, left % d
    return out + 1


def _walk(top: int, tile: int):
    """Partial sums of pairs and best terms; each input row has the language's v, n, sources and ns."""

    def flush(lang, names, pairs, best):
        out = []
        for (i, j), m in pairs.items():
            for a, b in zip(*np.nonzero(m)):
                out.append((lang, names[i * tile + a], "pair", names[j * tile + b], int(m[a, b])))
        for s, heap in best.items():
            out += [(lang, names[s], "term", back(item).decode("utf-8", "surrogatepass"), value) for value, item in heap]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    def run(batches):
        lang, state = None, ()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.lang != lang:
                    if state:
                        yield flush(lang, *state)
                    lang, names = row.lang, list(row.all)
                    at, ns, v = {s: i for i, s in enumerate(names)}, np.asarray(row.ns, np.int64), int(row.v)
                    state = (names, defaultdict(lambda: np.zeros((tile, tile), np.int64)), defaultdict(list))
                    total = int(row.n)
                leaves = decoded(row.code, row.numbers, row.sources)
                while block := list(itertools.islice(leaves, max(1, 2_000_000 // max(1, len(names))))):
                    count = np.zeros((len(block), len(names)), np.int64)
                    for k, (_, _, counts) in enumerate(block):
                        for s, n in counts.items():
                            count[k, at[s]] = n
                    p, q = weights(count, ns[None, :], v), weights(count.sum(1), total, v)
                    for i in range(0, len(names), tile):
                        for j in range(i, len(names), tile):
                            add_pairs(state[1][i // tile, j // tile], p[:, i : i + tile], p[:, j : j + tile])
                    more = np.where((count > 0) & (p > q[:, None]), p - q[:, None], 0)
                    for s in np.flatnonzero(more.any(0)):
                        heap, hit = state[2][s], np.flatnonzero(more[:, s])
                        if len(hit) > top:  # all ties stay until the order of terms decides
                            least = np.partition(more[hit, s], len(hit) - top)[len(hit) - top]
                            hit = hit[more[hit, s] >= least]
                        for k in hit.tolist():
                            x = (int(more[k, s]), turned(block[k][0]))
                            if len(heap) < top:
                                heapq.heappush(heap, x)
                            elif x > heap[0]:
                                heapq.heapreplace(heap, x)
        if state:
            yield flush(lang, *state)

    return run


def turned(term: bytes) -> bytes:
    """Bytes whose order is the reverse of the terms' order, so that of equal values a heap drops the largest term."""
    return term.translate(_TURN) + b"\xff"


def back(x: bytes) -> bytes:
    return x[:-1].translate(_TURN)


_TURN = bytes(range(255, -1, -1))


def add_pairs(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """m[i, j] += sum |a[:, i] - b[:, j]|."""
    for i in range(a.shape[1]):
        m[i, : b.shape[1]] += np.abs(b - a[:, i : i + 1]).sum(0)


def _quietly(f, batches):
    with acyclic():
        yield from f(batches)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, leaves: int = LEAVES, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    quiet = lambda f: lambda batches: _quietly(f, batches)
    base = docs.select(blank("lang"), blank("source"), blank("text"))
    partial = keep(base.mapInPandas(quiet(_count(leaves)), PREFIXES))  # a table: ranges are found by a look at it
    merged = keep(partial.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInPandas(quiet(_merge(min_docs, RANGE)), PREFIXES))

    numbers = merged.mapInPandas(quiet(_totals), "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    numbers = keep(numbers)
    groups = base.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    groups = keep(groups.join(numbers.filter("source is not null"), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    v = numbers.filter("source is null").select("lang", F.col("n").alias("v"))
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("n"))  # names and one number each: no texts
    stats = lists.join(v, "lang").select("lang", "v", "n", F.col("g.source").alias("all"), F.col("g.n").alias("ns"))
    partial_rows = merged.join(stats.hint("merge"), "lang").select("lang", "prefix", "code", "numbers", "sources", "v", "n", "all", "ns")
    found = partial_rows.mapInPandas(quiet(_walk(top, tile)), "lang string, source string, part string, item string, value long")
    found = keep(found)

    one_way = found.filter("part = 'pair' and source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A tile on the diagonal has each pair both ways, the others have it one way.
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    known = both.groupBy("lang", "source", "item").agg(F.max("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(known, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best.select(ranked.columns))
