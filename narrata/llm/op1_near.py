"""Operator 1: MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of five lower-cased (A-Z) words, or its whole
word sequence if it has fewer.  Two documents are linked if 100 * |intersection| >=
percent * |union|; classes are the connected components.

How it runs.  One pass over the texts hashes each into a set digest, `bands` bucket hashes and
a MinHash signature of `K` values of four bits.  Documents with equal sets collapse to one node.
Nodes that agree on a whole band share a bucket.  Candidate pairs inside buckets are never
all emitted:

1. each bucket names one pivot, the member that has most bucket mates, and pairs the others
   with it; survivors of verification become links, and links components;
2. a bucket whose members are all in one component is done.  Each of the rest names the best
   connected member outside its largest component as a fresh pivot and pairs it with the
   members of other components; this is repeated up to `ROUNDS` times while links come in;
3. in buckets that are open even then, members outside the largest component meet those of
   other components, each pair in the first band it shares.  Bayesian pruning is a part of the join's
   condition, so only pairs that survive the whole signature leave the join.

Verification is BayesLSH-like: signature values are compared in growing batches (`BATCHES`; `IN_JOIN`
in step 3), and a pair is dropped as soon as the posterior probability (uniform prior; chance agreement of
four-bit values counted in) that its similarity reaches the threshold falls below `MISS`.
Survivors are verified exactly on full sets.  Bands have as many rows as leave at most
`UNBANDED` of the pairs at the threshold unfound (32 bands of 7 at 0.85, 37 of 6 at 0.8); more
similar pairs are found more surely.  A pair at the threshold itself is lost by pruning with a
probability of about len(BATCHES) * MISS.

Step 3 compares (members outside) x (members) of a bucket where no pivot finds links, as in a
large family of texts that all lie just under the threshold: its rows stay few, its comparisons don't.

Defined cases: null or wordless texts have an empty set and are linked with nothing; rows
with a null id are not compared (component null, kept true); rows that share an id count as
one document that is linked with whatever any of its texts is linked with; repeated rows and
equal texts with different ids are linked.  Ties between pivots go to the smallest id.  Very
long texts are whole sets, hashed in one piece.  Other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.components import components
from narrata.llm.kernel import LOWER, Words, mix, ngram_hash, pieces
from narrata.llm.store import drop, keep

SHINGLE, PERCENT = 5, 80
#: Signature values; of these, values that bands use; bits of each that are compared.
K, BANDED, BITS = 512, 224, 4
BATCHES, IN_JOIN, MISS, UNBANDED, ROUNDS = (64, 128, 256, 512), (64, 512), 1e-4, 2e-5, 2


def banding(t: float, k: int = BANDED, miss: float = UNBANDED) -> tuple[int, int]:
    """(bands, rows): the most rows at which a pair of similarity t shares no band with probability at most `miss`."""
    rows = max((r for r in range(1, 17) if (1 - t**r) ** (k // r) <= miss), default=1)
    return k // rows, rows


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of each distinct shingle, sorted."""
    h, at = w.hashes(), w.windows(size)
    s, doc = [ngram_hash(h, at, size)], [w.doc[at]]
    for n in range(1, size):
        short = np.flatnonzero(w.count == n)
        s.append(ngram_hash(h, w.first[short], n, n))
        doc.append(short)
    s, doc = np.concatenate(s), np.concatenate(doc)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], s[new]


@functools.cache
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, k, dtype=np.uint32)


def signatures(s: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """One row of k 16-bit MinHash values for each non-empty run of s."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    a, b = _family(k)
    out = np.empty((len(starts), k), np.uint16)
    with np.errstate(over="ignore"):
        for i in range(k):
            m = np.minimum.reduceat((x ^ b[i]) * a[i], starts)
            out[:, i] = (m * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def band_hashes(m: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """One 64-bit hash of each band of each signature; the number of the band is a part of it."""
    out = np.empty((len(m), n_bands), np.uint64)
    for i in range(n_bands):
        h = np.full(len(m), i + 1, np.uint64)
        for j in range(n_rows):
            h = mix(h + m[:, i * n_rows + j], 31)
        out[:, i] = h
    return out


def _describe(size: int, n_bands: int, n_rows: int):
    def run(batches):
        for pdf in batches:
            for first, held in pieces(pdf.text.tolist()):
                w = Words(held, fold=LOWER)
                doc, s = shingle_sets(w, size)
                n = np.bincount(doc, minlength=w.n)
                full = np.flatnonzero(n)
                d = np.zeros((2, w.n), np.int64)
                bands, lanes = np.zeros((w.n, n_bands), np.int64), np.zeros((w.n, K * BITS // 64), np.int64)
                if len(full):
                    starts = np.searchsorted(doc, full)
                    with np.errstate(over="ignore"):
                        for j in (0, 1):
                            d[j, full] = np.add.reduceat(mix(s, 11 + j), starts).view(np.int64)
                        m = signatures(s, starts, K)
                        bands[full] = band_hashes(m, n_bands, n_rows).view(np.int64)
                    low = (m & 15).astype(np.uint8)
                    lanes[full] = np.ascontiguousarray(low[:, 0::2] | low[:, 1::2] << 4).view(np.int64)
                at = slice(first, first + w.n)
                yield pd.DataFrame({
                    "k": pdf.k.iloc[at].array, "t": pdf.t.iloc[at].to_numpy(), "n": n.astype(np.int64), "d1": d[0], "d2": d[1],
                    "lanes": list(lanes), "bands": list(bands),
                })

    return run


def least_matches(t: float, batches: tuple[int, ...], bits: int, miss: float) -> list[int]:
    """For each number of compared values: fewest matches with posterior P(similarity >= t) >= miss."""
    x = (np.arange(20_000) + 0.5) / 20_000
    p_match = x + (1 - x) / 2**bits
    out = []
    for n in batches:
        for m in range(n + 1):
            logp = m * np.log(p_match) + (n - m) * np.log1p(-p_match)
            p = np.exp(logp - logp.max())
            if p[x >= t].sum() >= miss * p.sum():
                break
        out.append(m)
    return out


def _exact(size: int, percent: int):
    def run(batches):
        for pdf in batches:
            texts = [t for pair in zip(pdf.ta, pdf.tb) for t in pair]
            ok, seen = np.zeros(len(pdf), bool), 0
            for i in range(0, len(pdf), 64):
                w = Words([t.encode() for t in texts[2 * i : 2 * i + 128]], fold=LOWER)
                doc, s = shingle_sets(w, size)
                pair = doc // 2
                n = np.bincount(pair, minlength=w.n // 2)
                order = np.lexsort((s, pair))
                s, pair = s[order], pair[order]
                same = (s[1:] == s[:-1]) & (pair[1:] == pair[:-1])
                both = np.bincount(pair[1:][same], minlength=w.n // 2)
                ok[i : i + w.n // 2] = 100 * both >= percent * (n - both)
                seen += w.n
            yield pdf[["a", "b"]][ok]

    return run


@functools.cache
def _most_different(percent: int, batches: tuple[int, ...]) -> list[tuple[int, int]]:
    """(compared values, most of them that may differ) for each batch; the driver works it out, tasks get it."""
    return [(n, n - m) for n, m in zip(batches, least_matches(percent / 100, batches, BITS, MISS))]


def _bayes(percent: int):
    steps = _most_different(percent, BATCHES)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.bitwise_xor(np.stack(pdf.la), np.stack(pdf.lb)).view(np.uint8)
            v = (v | v >> 2) & 0x33
            differs = (v | v >> 1) & 0x11  # one bit for each of the two values of a byte
            alive, seen, at = np.arange(len(pdf)), np.zeros(len(pdf), np.int64), 0
            for n, most in steps:
                seen = seen + np.bitwise_count(differs[alive, at // 2 : n // 2]).sum(1)
                alive, seen, at = alive[seen <= most], seen[seen <= most], n
            yield pdf[["a", "b"]].iloc[alive]

    return run


def _may_link(percent: int):
    """The same test of two rows x, y (n, lanes) as a condition of a join; the sizes must allow a link, too."""
    each = 64 // BITS
    ones = F.lit(0x1111111111111111)

    def differ(n: int):
        total = F.lit(0)
        for i in range(n // each):
            v = F.col("x.lanes")[i].bitwiseXOR(F.col("y.lanes")[i])
            v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
            total = total + F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(ones))
        return total

    out = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    for n, most in _most_different(percent, IN_JOIN):
        out = out & (differ(n) <= most)
    return out


def near_dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text)."""
    n_bands, n_rows = banding(percent / 100)
    base = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("t"), "text")
    every = keep(
        base.mapInPandas(_describe(shingle, n_bands, n_rows), "k long, t long, n long, d1 long, d2 long, lanes array<long>, bands array<long>")
    )
    some = every.filter("n > 0 and k is not null")
    # A node is one text of one id, (k, t), and stands for all rows of its digest.
    reps = keep(some.groupBy("d1", "d2").agg(F.min(F.struct("k", "t")).alias("u")))  # a table, so that Spark can split the join of a hot digest
    nodes = some.join(reps, ["d1", "d2"]).filter((F.col("k") == F.col("u.k")) & (F.col("t") == F.col("u.t")))
    nodes = keep(nodes.select("u", "n", "lanes", "bands").dropDuplicates(["u"]))
    texts_of_ids = some.groupBy("k").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high").select("k")
    same_id = keep(some.join(texts_of_ids, "k").join(reps, ["d1", "d2"]).select(F.col("k").alias("a"), F.col("u.k").alias("b")).filter("a <> b").distinct())

    in_bands = nodes.select(F.posexplode("bands").alias("band", "bucket"), "u")
    sizes = keep(in_bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    mates = keep(in_bands.join(sizes.hint("merge"), "bucket"))
    known = keep(nodes.join(mates.groupBy("u").agg(F.sum("size").alias("c")), "u"))
    texts = base.select(F.struct("k", "t").alias("u"), "text").join(known.select("u").hint("merge"), "u", "left_semi")  # the same plan at every size
    texts = keep(texts.dropDuplicates(["u"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b: nodes) that full sets confirm, as ids."""
        full = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), "ta", "tb")
        return keep(full.mapInPandas(_exact(shingle, percent), "a long, b long").filter("a <> b").distinct())

    def with_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
        """Links between the members of buckets and the buckets' pivots (bucket, p)."""
        pairs = members.join(pivots, "bucket").filter("u <> p")
        pairs = keep(pairs.select(F.least("u", "p").alias("a"), F.greatest("u", "p").alias("b")).distinct())
        a, b = (known.select(F.col("u").alias(c), F.col("n").alias("n" + c), F.col("lanes").alias("l" + c)).hint("merge") for c in "ab")
        both = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        out = keep(both.select("a", "b", "la", "lb").mapInPandas(_bayes(percent), pairs.schema))
        found = linked(out)
        drop(pairs, out)
        return found

    def placed_in(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of ids, and members of buckets that several components share."""
        comp = keep(components(links))  # (node, component)
        placed = mates.withColumn("k", F.col("u.k")).join(comp.toDF("k", "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
        main = parts.groupBy("bucket").agg(F.max(F.struct("m", "component")).component.alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        return comp, keep(placed.join(main.select("bucket", "main"), "bucket").select("bucket", "band", "u", "component", "main"))

    central = known.select("u", "c")
    first = mates.join(central, "u").groupBy("bucket").agg(F.max(F.struct("c", (-F.col("u.k")).alias("i"), "u")).u.alias("p"))
    links = with_pivots(mates.select("bucket", "u"), first).unionByName(same_id)
    comp, left = placed_in(links)
    for _ in range(ROUNDS):
        fresh = left.filter("component <> main").join(central, "u").groupBy("bucket")
        fresh = fresh.agg(F.max(F.struct("c", (-F.col("u.k")).alias("i"), "u", "component")).alias("p")).select("bucket", "p.u", "p.component")
        others = left.join(fresh.toDF("bucket", "p", "of"), "bucket").filter("component <> of")
        more = with_pivots(others.select("bucket", "u"), fresh.select("bucket", F.col("u").alias("p")))
        if more.isEmpty():
            break
        drop(left)
        comp, left = placed_in(comp.toDF("a", "b").unionByName(more))

    of = left.join(known.select("u", "n", "lanes", "bands"), "u")
    x, y = of.filter("component <> main").alias("x"), of.alias("y")
    first_shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.u") < F.col("y.u"))
    cross = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & once & _may_link(percent) & first_shared)
    cross = keep(cross.select(F.col("x.u").alias("a"), F.col("y.u").alias("b")))
    final = keep(components(comp.toDF("a", "b").unionByName(linked(cross))))
    drop(mates, sizes, known, left, texts, cross, same_id)

    flat = every.select("k", "n", "d1", "d2")
    out = (
        flat.filter("n > 0 and k is not null").join(reps, ["d1", "d2"]).withColumn("rep", F.col("u.k"))
        .join(final.toDF("rep", "component"), "rep", "left")
        .select("k", "n", F.coalesce("component", "rep").alias("component_id"))
        .unionByName(flat.filter("n = 0 or k is null").select("k", "n", F.col("k").alias("component_id")))
    )
    return out.select(
        F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` but one document of each class, with all their columns; of equal rows of one id, one stays."""
    gone = near_dedup(docs, percent).filter(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.limit(1).count():
        out = out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)
    return out
