"""Vector search, re-ranking and rank fusion."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.vector import distance, literal, similarity
from narrata.operators.filters import Filters, Visibility, apply_filters, visible
from narrata.operators.graph import cut
from narrata.operators.index import Index, build, search

logger = logging.getLogger(__name__)
OVERSAMPLE, RRF, BOOST = 3, 60, 0.05
TILE = 2048  # vectors on each side of one matrix product


def scored(chunks: DataFrame, query: list[float]) -> DataFrame:
    """Adds the normalised cosine to a query vector; opposite and incomparable vectors go."""
    return chunks.withColumn("score", F.round(similarity(F.col("embedding"), literal(query)), 6)).filter("score > 0")


def semantic_search(chunks: DataFrame, query: list[float], k: int, filters: Filters = Filters(), visibility: Visibility | None = None, mode: str = "oversample") -> DataFrame:
    """Best k chunks by score, then id.

    `oversample` takes 3 k candidates before filtering, as an index without filters does, and
    may return fewer than k rows; `prefilter` filters first and is exact.
    """
    rows = scored(chunks, query)
    keep = lambda df: apply_filters(df, filters.resolved()).filter(visible(visibility))
    order = [F.desc("score"), F.asc("chunk_id")]
    if mode == "prefilter":
        return keep(rows).orderBy(*order).limit(k)
    if mode != "oversample":
        raise ValueError(f"unknown mode {mode}")
    return keep(rows.orderBy(*order).limit(k * OVERSAMPLE)).orderBy(*order).limit(k)


def rerank(results: DataFrame, entities: Column, names: Column, boost: float = BOOST) -> DataFrame:
    """Order by score plus `boost` for each entity among a row's names (any case); the score itself stays."""
    low = F.transform(entities, F.lower)
    hits = F.size(F.filter(F.array_distinct(F.transform(names, F.lower)), lambda x: F.array_contains(low, x)))
    return results.withColumn("boosted", F.round(F.col("score") + F.lit(boost) * hits, 6)).orderBy(F.desc("boosted"), F.asc("rank"))


def similar_pairs(items: DataFrame, floor: float, k: int | None = None, tile: int = TILE) -> DataFrame:
    """(scope, source, target, score) of items (scope, id, kind, embedding) of one scope and different kinds, score at or above the floor.

    A scope of n items is dealt into about n / `tile` tiles by a hash of the id.  Every unordered
    pair of tiles is one task's work: a matrix product of two blocks of bounded size, from which only pairs above
    the floor leave, and with `k` only the best k of each item, in both directions.  Scopes of one tile share a task,
    some four tiles' items at a time.  Without k
    each pair comes once (source < target).  An item whose kind is null meets every other item;
    vectors of another dimension or without length meet none.
    """
    id_type = items.schema["id"].dataType.simpleString()
    scope_type = items.schema["scope"].dataType.simpleString()
    rows = items.filter("scope is not null and id is not null and embedding is not null").withColumn("size", F.size("embedding"))
    counts = cut(rows.groupBy("scope", "size").agg(F.count("*").alias("n"))).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    packs = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // (4 * tile)))
    rows = rows.join(counts, ["scope", "size"]).select("scope", "size", "id", F.col("kind").cast("string").alias("kind"), "embedding", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("own"), "tiles")
    # One task's work: a pair of tiles, or some scopes of one tile each.
    work = lambda own, other: F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("scope", "size"), F.lit(packs))).otherwise(F.xxhash64("scope", "size", own, other))
    left = rows.select("*", F.explode(F.sequence("own", F.col("tiles") - 1)).alias("other")).withColumn("work", work("own", "other")).drop("tiles")
    right = rows.select("*", F.explode(F.sequence(F.lit(0), "own")).alias("other")).withColumn("work", work("other", "own")).drop("tiles")
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        v = np.stack(pdf.embedding).astype(float)
        length = np.linalg.norm(v, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return v / length[:, None]

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> list[pd.DataFrame]:
        out = []
        a, b = a.sort_values("id", ignore_index=True), b.sort_values("id", ignore_index=True)
        score = np.round((1 + unit(a) @ unit(b).T) / 2, 6)
        ia, ib = a.id.to_numpy(), b.id.to_numpy()
        kinds = pd.factorize(pd.concat([a.kind, b.kind]))[0]
        ka, kb = kinds[: len(a)], kinds[len(a) :]
        good = (score >= floor) & (ia[:, None] != ib) & ((ka[:, None] != kb) | (ka[:, None] < 0))
        if a.own.iloc[0] == b.own.iloc[0]:
            good &= ia[:, None] < ib
        for s, x, y, ok in ((score, ia, ib, good), (score.T, ib, ia, good.T)) if k else ((score, ia, ib, good),):
            if k and ok.shape[1] > k:
                best = np.argsort(np.where(ok, -s, np.inf), axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(s)), k), best.ravel()
                r, c = r[ok[r, c]], c[ok[r, c]]
            else:
                r, c = np.nonzero(ok)
            out.append(pd.DataFrame({"scope": a["scope"].iloc[0], "source": x[r], "target": y[c], "score": s[r, c]}))
        return out

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns=lambda c: c.removeprefix("r_"))
        others = dict(list(b.groupby(["scope", "size", "other", "own"]))) if len(b) else {}
        out = [x for key, part in (a.groupby(["scope", "size", "own", "other"]) if len(a) else ()) if key in others for x in pair(part, others[key])]
        return pd.concat(out) if out else pd.DataFrame({"scope": [], "source": [], "target": [], "score": []})

    met = left.groupBy("work").cogroup(right.groupBy("r_work")).applyInPandas(meet, f"scope {scope_type}, source {id_type}, target {id_type}, score double")
    if not k:
        return met.select("scope", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "score")
    best = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def neighbours(events: DataFrame, k: int = 8, floor: float = 0.70, dimensions: int | None = None, mode: str = "exact") -> DataFrame:
    """(book_id, source, target, score): each event's best k events of the same book, other chapter, at or above the floor.

    `exact` compares within the book.  `oversample` asks an index without filters: of the k * OVERSAMPLE
    nearest events of all books, the event itself among them, those of the book and of other chapters stay.  With
    `dimensions`, events whose vector has another size are skipped.
    """
    if dimensions:
        events = events.filter(F.size("embedding") == dimensions)
    if mode == "exact":
        rows = similar_pairs(events.select(F.col("book_id").alias("scope"), F.col("event_id").alias("id"), F.col("chapter_id").alias("kind"), "embedding").filter("kind is not null"), floor, k)
        return rows.select(F.col("scope").alias("book_id"), "source", "target", "score")
    if mode != "oversample":
        raise ValueError(f"unknown mode {mode}")
    index = build(events.select(F.col("event_id").alias("id"), "embedding"))
    return neighbours_indexed(index, events, events, k, floor)


def neighbours_indexed(index: Index, events: DataFrame, asked: DataFrame, k: int = 8, floor: float = 0.70, probes: int | None = None) -> DataFrame:
    """(book_id, source, target, score) for the events `asked`: of the k * OVERSAMPLE nearest events that the index (id: event_id) finds, itself among them, those of the book and other chapters."""
    near = search(index, asked.select(F.col("event_id").alias("query"), "embedding").dropDuplicates(["query"]), k * OVERSAMPLE, probes).filter("query <> id")
    best = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    near = near.select(F.col("query").alias("source"), F.col("id").alias("target"), "score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") < k * OVERSAMPLE).drop("rank")
    at = lambda name: events.select(F.col("event_id").alias(name), F.col("book_id").alias(name + "_book"), F.col("chapter_id").alias(name + "_chapter"))
    rows = near.join(at("source"), "source").join(at("target"), "target").filter(f"source_book = target_book and source_chapter <> target_chapter and score >= {floor}")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("source_book").alias("book_id"), "source", "target", "score")


def visible_indexed(index: Index, chunks: DataFrame, queries: DataFrame, k: int, visibility: Visibility | None = None, probes: int | None = None) -> DataFrame:
    """(query, chunk_id, score, rank): `semantic_search` in its oversampling mode for a table of queries (query, embedding), by an index (id: chunk_id)."""
    near = search(index, queries, k * OVERSAMPLE, probes).filter("score > 0").select("query", F.col("id").alias("chunk_id"), "score")
    rows = near.join(chunks.drop("embedding"), "chunk_id").filter(visible(visibility))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "chunk_id", "score", "rank")


def canonical_pairs(pairs: DataFrame, *by: str) -> DataFrame:
    """One row for each unordered pair with the best score: event_id_1 < event_id_2."""
    return pairs.groupBy(*by, F.least("source", "target").alias("event_id_1"), F.greatest("source", "target").alias("event_id_2")).agg(F.max("score").alias("score"))


def cap_pairs(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Greedy by descending score, then ids, within each book: a pair stays while both ends have fewer than `most` pairs.

    Rounds of locally best pairs give what the sequential walk gives: a pair that is among the first open ones of both its ends, as
    many as these may still take, stays whatever becomes of the others; pairs of an end that is full go.  The best open pair
    always stays, so the rounds end; each is two shuffles by an event, and no task holds a book.
    """
    order = ["book_id", F.desc("score"), "event_id_1", "event_id_2"]
    both = F.explode(F.array("event_id_1", "event_id_2")).alias("end")
    kept, rest, rounds = None, cut(pairs.withColumn("pair", F.struct("book_id", "event_id_1", "event_id_2"))), 0
    taken = rest.select("book_id", both).limit(0).withColumn("taken", F.lit(0).cast("long"))
    while not rest.isEmpty():
        place = F.row_number().over(Window.partitionBy("book_id", "end").orderBy(*order[1:]))
        ends = rest.select("book_id", "score", "event_id_1", "event_id_2", "pair", both).withColumn("place", place)
        ends = ends.join(taken, ["book_id", "end"], "left").withColumn("fits", F.col("place") <= most - F.coalesce("taken", F.lit(0)))
        stays = cut(ends.groupBy("pair").agg(F.bool_and("fits").alias("stays")).filter("stays").select("pair"))
        new = cut(rest.join(stays, "pair", "left_semi"))
        kept = new if kept is None else kept.unionByName(new)
        counts = new.select("book_id", both).groupBy("book_id", "end").agg(F.count("*").alias("more"))
        taken = cut(taken.join(counts, ["book_id", "end"], "full").select("book_id", "end", (F.coalesce("taken", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("taken")))
        full = taken.filter(F.col("taken") >= most).select("book_id", "end")
        rest = rest.join(stays, "pair", "left_anti")
        for c in ("event_id_1", "event_id_2"):
            rest = rest.join(full.withColumnRenamed("end", c), ["book_id", c], "left_anti")
        rest = cut(rest.select(*pairs.columns, "pair"))
        rounds += 1
        logger.info("cap_pairs: round %d done", rounds)
    return pairs.limit(0) if kept is None else kept.select(pairs.columns)


def fuse(branches: dict[str, DataFrame], k: int, first: str = "vector") -> DataFrame:
    """Reciprocal rank fusion of branches (chunk_id, rank): score desc, branches desc, best rank, rank in `first`, id.

    A chunk that a branch lists twice counts twice.
    """
    rows = None
    for name, df in branches.items():
        one = df.select("chunk_id", "rank", F.lit(name).alias("branch"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("chunk_id").agg(
        F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 9).alias("fused"), F.count("*").alias("branches"), F.min("rank").alias("best_rank"),
        F.min(F.when(F.col("branch") == first, F.col("rank"))).alias("first_rank"),
    )
    return out.orderBy(F.desc("fused"), F.desc("branches"), "best_rank", F.asc_nulls_last("first_rank"), "chunk_id").limit(k)


def ranked(df: DataFrame, k: int) -> DataFrame:
    """A branch: the best k rows by score, then id, numbered from 1."""
    best = df.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def catalog_matches(queries: DataFrame, catalog: DataFrame, threshold: float = 0.25, top: int = 3) -> DataFrame:
    """Nearest definitions of each query below the distance threshold, best first, with a near-miss flag.

    The catalog is the small side and is broadcast only as far as the planner's own size limit allows.
    """
    d = F.round(distance(F.col("embedding"), F.col("definition_embedding")), 6)
    pairs = queries.join(catalog, F.col("kind") == F.col("definition_kind")).withColumn("distance", d).filter(F.col("distance") < threshold)
    w = Window.partitionBy("query_id").orderBy("distance", "definition_id")
    pairs = pairs.withColumn("rank", F.row_number().over(w)).withColumn("near_miss", F.coalesce(F.lead("distance").over(w) <= F.col("distance") * 1.10, F.lit(False)))
    return pairs.filter(F.col("rank") <= top).select("query_id", "definition_id", "distance", "rank", "near_miss")


def available(entities: DataFrame) -> DataFrame:
    """One row: how many rows there are, how many have a vector, and whether a search can find anything."""
    n = F.count("embedding")
    return entities.agg(F.count("*").alias("entities"), n.alias("embedded"), (n > 0).alias("available"))
