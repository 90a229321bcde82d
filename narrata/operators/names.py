"""Known names of several words in texts: windows of words met by their hashes where the texts lie.

A name and a window of as many words have the same 128-bit hash if they are the same words, so texts don't move:
tasks hold the hashes of the names that are asked for most often, as sorted arrays of a bounded size, and scan their
texts by windows of each length that a name has.  Names beyond that bound are held as one bitmap of a fixed size,
and only windows that it lets through are shuffled to meet these names, word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.graph import cut

#: Names that a task holds by their hashes (16 bytes each), bits of the map of all others, words that are looked at together.
HELD, MAP_BITS, WORDS = 1 << 22, 28, 1 << 18
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def words(text: Column) -> Column:
    """Runs of a-z and digits, in any case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _hashes(flat: pa.Array) -> np.ndarray:
    """128 bits of each word, as two columns."""
    coded = flat.dictionary_encode()
    made = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in coded.dictionary.to_pylist())
    return np.frombuffer(made, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]


def _flat(column) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and where each row's begin."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def hashed(names: DataFrame) -> DataFrame:
    """(name, n, uses, h1, h2) of names (name): each once, as its words, with how often it is there; those without a word are left out."""

    def run(batches):
        for batch in batches:
            flat, start = _flat(batch.column("ws"))
            sizes, h = np.diff(start), np.zeros((batch.num_rows, 2), np.uint64)
            own = _hashes(flat)
            for n in range(int(sizes.max(initial=0))):
                rows = np.nonzero(sizes > n)[0]
                h[rows] = h[rows] * _STEP + own[start[rows] + n]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int32()), batch.column("uses"), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))], ["name", "n", "uses", "h1", "h2"])

    split = names.select(words(F.col("name")).alias("ws")).filter("size(ws) > 0").groupBy("ws").agg(F.count("*").alias("uses")).withColumn("name", F.array_join("ws", " "))
    return split.mapInArrow(run, "name string, n int, uses long, h1 long, h2 long")


def _held(known: DataFrame) -> tuple[dict, DataFrame]:
    """The hashes of the names of the most uses, by number of words, and all other names."""
    top, least, total = 1000, 1001, 0
    for r in known.groupBy(F.least("uses", F.lit(top)).alias("uses")).count().orderBy(F.desc("uses")).collect():
        total += r["count"]
        if total > HELD:
            break
        least = r.uses
    t = known.filter(F.col("uses") >= least).select("n", "h1", "h2").toArrow()
    n, h = t["n"].to_numpy(), np.stack([t[c].to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1)
    out = {}
    for size in np.unique(n):
        of = h[n == size]
        of = of[np.argsort(of[:, 0], kind="stable")]
        most = int(np.unique(of[:, 0], return_counts=True)[1].max())  # names that share the first half of a hash: 1 as a rule
        out[int(size)] = (np.ascontiguousarray(of[:, 0]), np.ascontiguousarray(of[:, 1]), most)
    return out, known.filter(F.col("uses") < least)


def _map_of(names: DataFrame) -> np.ndarray | None:
    """One bit for each name, or none without names."""
    slot = F.shiftrightunsigned("h1", 64 - MAP_BITS)
    t = names.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits")).toArrow()
    if not t.num_rows:
        return None
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[t["at"].to_numpy()] = t["bits"].to_numpy()
    return out.view(np.uint64)


def name_hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(item, name, first_word, last_word): every place of every name (name) in texts (item, text), overlapping ones too; words count from 0.

    A null or wordless text has none; repeated names count once, repeated texts each; an empty table of either gives none.
    """
    known = cut(hashed(names))
    held, others = _held(known)
    lengths = sorted({r.n for r in known.select("n").distinct().collect()})
    shared = texts.sparkSession.sparkContext.broadcast((held, _map_of(others), lengths))

    def scan(items, column):
        held, bits, lengths = shared.value
        flat, start = _flat(column)
        own, of = _hashes(flat), np.repeat(np.arange(len(start) - 1), np.diff(start))
        h, done = own, 1
        for n in lengths:
            while done < n and len(h) > 1:
                h, done = h[:-1] * _STEP + own[done:], done + 1
            if done < n or not len(h):
                return
            inside = of[: len(h)] == of[n - 1 :]
            sure = np.zeros(len(h), bool)
            if n in held:
                first, second, most = held[n]
                at = np.searchsorted(first, h[:, 0])
                for i in range(most):
                    j = np.minimum(at + i, len(first) - 1)
                    sure |= (first[j] == h[:, 0]) & (second[j] == h[:, 1])
            hit = sure
            if bits is not None:
                slot = h[:, 0] >> np.uint64(64 - MAP_BITS)
                hit = sure | (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            i = np.nonzero(hit & inside)[0]
            if len(i):
                text = flat.take(pa.array(i)) if n == 1 else pc.binary_join_element_wise(*[flat.take(pa.array(i + j)) for j in range(n)], " ")
                place = (i - start[of[i]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([items.take(pa.array(of[i])), text, pa.array(place), pa.array(place + np.int32(n - 1)), pa.array(sure[i])], ["item", "name", "first_word", "last_word", "sure"])

    def run(batches):
        for batch in batches:
            ends, a = np.cumsum(pc.list_value_length(batch.column("ws")).to_numpy(zero_copy_only=False)), 0
            while a < batch.num_rows:  # rows of about WORDS words, one at least
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS)))
                yield from scan(batch.column("item").slice(a, b - a), batch.column("ws").slice(a, b - a))
                a = b

    kind = texts.schema["item"].dataType.simpleString()
    rows = texts.select("item", words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    found = rows.mapInArrow(run, f"item {kind}, name string, first_word int, last_word int, sure boolean")
    hits = found.filter("sure").drop("sure")
    if others.isEmpty():
        return hits
    return hits.unionByName(found.filter("not sure").drop("sure").join(others.select("name"), "name", "left_semi"))
