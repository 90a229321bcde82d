"""Operator 3: document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where masked bits of it are
zero.  Chunk sizes are normalised: a stricter mask below the target size, a looser one above
it, with a least and a greatest size.  Boundaries depend on the last 32 bytes alone, so an
edit moves only the chunks near it.  The fingerprint lists the text's distinct chunks as
`digest:bytes`; the likeness of two fingerprints is containment: the bytes of shared chunks
over the bytes of the smaller chunk set.

The edited text of a row needs the text of its neighbour in descending order of ids.  Rows
are dealt by ranges of ids into buckets of about `BUCKET_BYTES` at every size of the table (one
shuffle), sorted, and streamed; each bucket also receives, as a guest, the first row of the
next bucket.  Quantiles cut the ids into at most `PARTS` ranges; each range is cut evenly into
as many buckets as its share of the bytes needs.  An id that fills whole ranges by itself, and
the rows without an id, are cut by a hash of the text.

Defined cases: null texts are empty; the fingerprint of an empty text is empty, two empty
fingerprints have likeness 1, an empty and a full one 0; rows with a null id come last; rows
that share an id follow one another by a hash of the text, then by text; repeated rows each
have a result; a single row is its own neighbour; a very long text is one row of its bucket and
is cut whole; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.store import keep

LEAST, TARGET, MOST = 16, 48, 192
STRICT, LOOSE = 7, 5  # bits that must be zero below and above the target size
BUCKET_BYTES, PARTS = 64_000_000, 2048
EXACT = 2**53  # ids beyond it aren't told apart as doubles
_GEAR = np.random.default_rng(3).integers(0, 2**32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16):  # after each step, h covers twice as many bytes
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    top = h >> np.uint32(32 - LOOSE)
    cand = np.flatnonzero(top == 0)
    strict = ((h[cand] >> np.uint32(32 - STRICT)) == 0).tolist()
    cand = (cand + 1).tolist()
    ends, start, i, m = [], 0, 0, len(cand)
    while start < n:
        end = min(start + MOST, n)
        while i < m and cand[i] - start < LEAST:
            i += 1
        j = i
        while j < m and cand[j] <= end:
            if cand[j] - start >= TARGET or strict[j]:
                end = cand[j]
                break
            j += 1
        i = j
        ends.append(end)
        start = end
    return ends


def chunks(text: str) -> dict[str, int]:
    """Digest and bytes of each distinct chunk."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data):
        out[xxhash.xxh3_64_hexdigest(data[start:end])[:12]] = end - start
        start = end
    return out


def fingerprint(c: dict[str, int]) -> str:
    return ",".join([f"{d}:{n}" for d, n in c.items()])


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    return min(1.0, sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def bucketed(docs: DataFrame, total: int, nulls: float, least: float, most: float, bucket_bytes: int) -> DataFrame:
    """`docs` (at, h, ...) with part and sub: the bucket of a row; buckets in order of (part, sub) follow the order of (at, h).

    total: bytes of text; nulls: share of the rows without an id; least, most: outer values of near.
    """
    spark = docs.sparkSession
    n = min(PARTS, max(48, math.ceil(total / bucket_bytes)))
    each = max(1, math.ceil(total / (n * bucket_bytes)))  # buckets in a range
    cuts = docs.filter("at is not null").approxQuantile("near", [i / n for i in range(1, n)], 1 / (8 * n))
    often = Counter(cuts)  # a cut that comes again and again is an id with many rows
    edges = sorted(often)
    if edges:
        docs = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="near", outputCol="part", handleInvalid="keep").transform(docs)
    else:
        docs = docs.withColumn("part", F.lit(0.0))
    docs = docs.withColumn("part", F.when(F.col("at").isNull(), F.lit(len(edges) + 1)).otherwise(F.col("part").cast("int")))
    ranges = [(i, lo, hi, often[lo] * each if often[lo] > 1 and abs(lo) < EXACT else 1) for i, (lo, hi) in enumerate(zip([least - 1, *edges], [*edges, most + 1]))]
    ranges.append((len(edges) + 1, 0.0, 0.0, max(1, math.ceil(n * each * nulls))))
    # at most PARTS + 1 rows
    docs = docs.join(F.broadcast(spark.createDataFrame(ranges, "part int, lo double, hi double, many int")), "part")
    by_hash = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("many"))
    by_id = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("near") - F.col("lo")) / (F.col("hi") - F.col("lo")) * each)).otherwise(0)
    alone = F.col("at").isNull() | ((F.col("many") > 1) & (F.col("near") == F.col("lo")))
    sub = F.when(alone, F.least(by_hash, F.col("many") - 1)).otherwise(F.col("many") + F.least(by_id, F.lit(each - 1)))
    return docs.withColumn("sub", sub.cast("long")).drop("lo", "hi", "many")


def fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs` (doc_id, text)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("at", F.bitwise_not("doc_id")).withColumn("near", F.col("at").cast("double")).withColumn("h", F.xxhash64("text"))
    total, n, known, least, most = base.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id"), F.min("near"), F.max("near")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    base = bucketed(base, total, 1 - known / n, least or 0.0, most or 0.0, bucket_bytes).select("part", "sub", "at", "h", "doc_id", "text")
    # the first row of each bucket visits the bucket before it (the first bucket's visits the last)
    lead = base.groupBy("part", "sub").agg(F.min(F.struct("at", "h")).alias("first"))
    before = Window.orderBy("part", "sub")  # one row for each bucket
    lead = lead.withColumn("to", F.lag(F.struct("part", "sub")).over(before))
    lead = keep(lead.withColumn("to", F.coalesce("to", F.max(F.struct("part", "sub")).over(Window.partitionBy()))))
    firsts = (  # some 50 bytes are broadcast for each bucket of 64 MB
        base.join(F.broadcast(lead.withColumnRenamed("part", "p").withColumnRenamed("sub", "s")), (F.col("part") == F.col("p")) & (F.col("sub") == F.col("s")) & F.col("at").eqNullSafe(F.col("first.at")) & (F.col("h") == F.col("first.h")))
        .groupBy("to").agg(F.min(F.struct("text", "at", "h", "doc_id")).alias("r"))
        .select("to.part", "to.sub", F.lit(1).alias("guest"), "r.at", "r.h", "r.doc_id", "r.text")
    )
    rows = base.select("part", "sub", F.lit(0).alias("guest"), "at", "h", "doc_id", "text").unionByName(firsts)
    rows = rows.repartitionByRange(lead.count(), "part", "sub").sortWithinPartitions("part", "sub", "guest", "at", "h", "text")

    def run(batches):
        held, out = None, []  # the row before, with its chunks
        for pdf in batches:
            for bucket, guest, doc, text in zip(zip(pdf.part, pdf["sub"]), pdf.guest, pdf.doc_id.astype("Int64"), pdf.text):
                c = chunks(text)
                if held is not None and held[0] == bucket:
                    _, d, t, own = held
                    e = edited(t, text)
                    ec = chunks(e)
                    out.append((d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(ec), likeness(own, ec), likeness(own, c)))
                held = None if guest else (bucket, doc, text, c)
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                    out = []
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInPandas(run, schema)
