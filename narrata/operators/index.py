"""An inverted-list index over vectors: cells by k-means, a table partitioned by cell, probes that prune the scan, exact scores.

    rows  -> build()   -> <path>/rows   (partitioned by cell), <path>/state (one row a version)
    query -> search()  -> the best k of the probed cells, or of all (exact, by the cells' radii)
    rows  -> refresh() -> appended, or rebuilt if the vectors have another size or no longer fit the cells

Cells are fitted on a bounded sample (`SAMPLE` rows, the first by hash of the id); every row is assigned and
stored.  A cell with many rows is several parts of about `PART_ROWS`, each a file and a task of its own, so a
crowded cell is not one task's work.  Vectors are compared by the normalised cosine (1 + cos) / 2.

Rows without a vector, with one of no length, or of another size than the index stay out.  A repeated id is
stored as often.  Ties of a score go to the smaller id.  An empty table gives an index without rows.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narrata.operators.graph import cut, shared_folder

SAMPLE, ROUNDS, MOST_CELLS, PART_ROWS = 20_000, 10, 1_024, 16_384
#: One task's work in a search: so many rows and queries at most; smaller blocks, but no smaller than LEAST_BLOCK, if there were fewer than LEAST_TASKS.
BIN_ROWS, BLOCK, LEAST_BLOCK, LEAST_TASKS = 65_536, 32_768, 2_048, 16
#: An index is rebuilt if it has so many times the rows of its fit, or new rows are so much farther from their cells.
GROWN, DRIFT = 4, 0.1


def unit(vectors) -> np.ndarray:
    v = np.stack(vectors).astype(float)
    return v / np.linalg.norm(v, axis=1)[:, None]


def fit_cells(v: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n unit centres by spherical k-means from rows spread over the sample; a cell that falls empty takes the worst placed row."""
    n = min(n, len(v))
    centres = v[np.linspace(0, len(v) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = v @ centres.T
        own, best = near.argmax(1), near.max(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        empty = np.setdiff1d(np.arange(n), own)
        total[empty] = v[np.argsort(best)[: len(empty)]]
        length = np.linalg.norm(total, axis=1)
        centres = np.where(length[:, None] > 0, total / np.maximum(length, 1e-12)[:, None], centres)
    return centres


@dataclass
class Index:
    """`low`: the smallest cosine of a cell's rows to its centre; `parts`: files of a cell; `fitted`: rows and their mean cosine at the fit."""

    spark: SparkSession
    path: str
    version: int
    generation: str
    dimension: int
    centres: np.ndarray
    low: np.ndarray
    parts: np.ndarray
    rows: int
    fitted_rows: int
    fitted_mean: float
    schema: str

    def table(self, cells=None) -> DataFrame:
        """The stored rows; `cells` is a condition on the partition column, so other cells' files are not opened."""
        df = self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/rows-{self.generation}")
        return df if cells is None else df.filter(F.col("cell").isin([int(c) for c in cells]))

    def probe(self, vector, n: int) -> list[int]:
        """The n cells whose centres are nearest to a vector."""
        return np.argsort(-(self.centres @ np.asarray(vector, float)), kind="stable")[:n].tolist()

    def nearest(self, vector, k: int, probes: int) -> DataFrame:
        """The best k rows of the probed cells, all their columns and `score`; the scan reads only these cells."""
        v = np.asarray(vector, float)
        v = F.array(*[F.lit(float(x)) for x in v / np.linalg.norm(v)])
        dot = F.aggregate(F.zip_with("unit", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        rows = self.table(self.probe(vector, probes)).withColumn("score", F.round((1 + dot) / 2, 6))
        return rows.orderBy(F.desc("score"), "id").limit(k).drop("unit", "near")


def _assigned(rows: DataFrame, centres: np.ndarray, dimension: int) -> DataFrame:
    """Rows that fit the index with cell, cosine to its centre (near) and unit vector."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                v = unit(pdf.embedding)
                near = v @ centres.T
                yield pdf.drop(columns="embedding").assign(cell=near.argmax(1).astype(np.int32), near=near.max(1), unit=list(v))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    fit = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dimension) & (length > 0) & (length < float("inf")))
    return fit.mapInPandas(run, f"{fields}, cell int, near double, unit array<double>")


def _store(assigned: DataFrame, folder: str, parts: np.ndarray, mode: str) -> None:
    of = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)
    rows = assigned.withColumn("part", F.pmod(F.xxhash64("id"), of).cast("int"))
    rows.repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode(mode).partitionBy("cell").parquet(folder)


def _write_state(index: Index) -> Index:
    row = (index.version, index.generation, index.dimension, index.centres.tolist(), index.low.tolist(), [int(p) for p in index.parts], index.rows, index.fitted_rows, index.fitted_mean, index.schema)
    kind = "version int, generation string, dimension int, centres array<array<double>>, low array<double>, parts array<int>, rows long, fitted_rows long, fitted_mean double, schema string"
    index.spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{index.path}/state")
    return index


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/state").orderBy(F.desc("version")).first()
    return Index(spark, path, r.version, r.generation, r.dimension, np.array(r.centres, float), np.array(r.low), np.array(r.parts), r.rows, r.fitted_rows, r.fitted_mean, r.schema)


def _sizes(assigned: DataFrame, n_cells: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and smallest cosine of each cell (at most MOST_CELLS rows), and the mean cosine of all."""
    n, low, total = np.zeros(n_cells, np.int64), np.ones(n_cells), 0.0
    for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.sum("near").alias("s")).collect():
        n[r.cell], low[r.cell], total = r.n, r.low, total + r.s
    return n, low, total / max(1, n.sum())


def build(rows: DataFrame, path: str | None = None, dimension: int | None = None, cells: int | None = None, part_rows: int = PART_ROWS, version: int = 0) -> Index:
    """Index of rows (id, embedding: array<double>, any other columns) in a folder that driver and executors share."""
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if dimension is None:
        sizes = rows.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = sizes["d"] if sizes else 1
    sample = [r.embedding for r in rows.filter(F.size("embedding") == dimension).orderBy(F.xxhash64("id"), "id").select("embedding").limit(SAMPLE).collect()]
    sample = [v for v in sample if 0 < sum(x * x for x in v) < math.inf]
    n_cells = cells or int(min(MOST_CELLS, max(1, round(rows.count() ** 0.5))))
    centres = fit_cells(unit(sample), n_cells) if sample else np.ones((1, dimension)) / dimension**0.5
    assigned = cut(_assigned(rows, centres, dimension))
    n, low, mean = _sizes(assigned, len(centres))
    parts = np.maximum(1, np.ceil(n / part_rows)).astype(int)
    generation = uuid.uuid4().hex
    kept = StructType([f for f in assigned.schema if f.name != "cell"]).add("part", "integer").add("cell", "integer")
    _store(assigned, f"{path}/rows-{generation}", parts, "error")
    return _write_state(Index(spark, path, version, generation, dimension, centres, low, parts, int(n.sum()), int(n.sum()), float(mean), kept.json()))


def refresh(spark: SparkSession, path: str, rows: DataFrame, dimension: int | None = None) -> tuple[Index, str]:
    """The index of `rows` (all of them), and what was done: `kept`, `appended` or `rebuilt`.

    Another vector size, `GROWN` times the rows, or new rows whose cosine to their cells' centres is lower by `DRIFT` than it
    was at the fit make a new index; readers of the old generation go on reading its files.
    """
    index = load(spark, path)
    if dimension is not None and dimension != index.dimension:
        return build(rows, path, dimension, version=index.version + 1), "rebuilt"
    new = cut(_assigned(rows.join(index.table().select("id"), "id", "left_anti"), index.centres, index.dimension))
    n, low, mean = _sizes(new, len(index.centres))
    if not n.sum():
        return index, "kept"
    if index.rows + n.sum() > GROWN * max(1, index.fitted_rows) or mean < index.fitted_mean - DRIFT:
        return build(rows, path, index.dimension, version=index.version + 1), "rebuilt"
    _store(new, f"{path}/rows-{index.generation}", index.parts, "append")
    index.version, index.low, index.rows = index.version + 1, np.minimum(index.low, low), index.rows + int(n.sum())
    return _write_state(index), "appended"


def _nearest_cells(n: int):
    def pick(near, low, worst):
        order = np.argsort(-near, axis=1, kind="stable")[:, :n]
        out = np.zeros(near.shape, bool)
        out[np.arange(len(near))[:, None], order] = True
        return out

    return pick


def _reachable(near, low, worst):
    """Cells that may hold a row as good as the worst one found: the angle to a row is at least that to the centre less the cell's radius."""
    angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(low, -1, 1))[None, :]
    return (1 + np.cos(np.maximum(angle, 0))) / 2 + 1e-6 >= worst[:, None]


def _bins(index: Index) -> list[np.ndarray]:
    """The bin of each part of each cell: parts in order, about BIN_ROWS rows a bin."""
    n = np.zeros(len(index.centres), np.int64)
    for r in index.table().groupBy("cell").count().collect():  # at most MOST_CELLS rows
        n[r.cell] = r["count"]
    out, at, filled = [], 0, 0
    for cell, parts in enumerate(index.parts):
        own = []
        for _ in range(parts):
            if filled and filled + n[cell] / parts > BIN_ROWS:
                at, filled = at + 1, 0
            own.append(at)
            filled += n[cell] / parts
        out.append(np.array(own))
    return out


def _sent(queries: DataFrame, index: Index, pick, bins: list[np.ndarray]) -> DataFrame:
    """(bin, query, unit, worst) for the bins with a cell that pick(cosines to the centres, low, worst) marks; a query goes once to a bin, whatever the cells."""
    centres, low, dimension = index.centres, index.low, index.dimension
    holds = np.zeros((len(centres), bins[-1][-1] + 1), bool)
    for cell, own in enumerate(bins):
        holds[cell, own] = True

    def run(batches):
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == dimension and 0 < np.linalg.norm(v) < np.inf for v in pdf.embedding]]
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                v = unit(some.embedding)
                worst = some.worst.fillna(-1).to_numpy()
                q, to = np.nonzero(pick(v @ centres.T, low, worst) @ holds)
                yield pd.DataFrame({"bin": to.astype(np.int32), "query": some["query"].to_numpy()[q], "unit": list(v[q]), "worst": worst[q]})

    kind = queries.schema["query"].dataType.simpleString()
    return queries.mapInPandas(run, f"bin int, query {kind}, unit array<double>, worst double")


def _best(v: np.ndarray, thr: np.ndarray, mask: np.ndarray, own: np.ndarray, cell: np.ndarray, order: np.ndarray, k: int, tile: int = 2_048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best k rows each of a few queries, among rows (in order of their cell) whose cell is in the query's mask.

    Only scores that reach `thr`, or the k-th found so far, leave a tile of the product; ties go to the smaller order.
    """
    thr, q, j, s, more, n = thr.copy(), *[np.zeros(0, t) for t in (np.int64, np.int64, float)], [], 0

    def merged(q, j, s):
        q, j, s = (np.concatenate(x) for x in zip((q, j, s), *more))
        by = np.lexsort((order[j], -s, q))
        q, j, s = q[by], j[by], s[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        np.maximum.at(thr, q[place == k - 1], s[place == k - 1])
        return q[place < k], j[place < k], s[place < k]

    for at in range(0, len(own), tile):
        wanted = np.flatnonzero(mask[:, np.unique(cell[at : at + tile])].any(1))
        if not len(wanted):
            continue
        dot = v[wanted] @ own[at : at + tile].T
        least = 2 * thr[wanted] - 1 - 4e-6  # below what rounds to the score that is needed
        hit = dot >= least[:, None]
        crowded = np.flatnonzero(hit.sum(1) > 4 * k)
        if len(crowded):
            own_dot = np.where(mask[wanted[crowded]][:, cell[at : at + tile]], dot[crowded], -2)
            least[crowded] = np.maximum(least[crowded], np.partition(own_dot, dot.shape[1] - k, axis=1)[:, dot.shape[1] - k] - 4e-6)
            hit[crowded] = own_dot >= least[crowded, None]
        a, b = np.nonzero(hit)
        score = np.round((1 + dot[a, b]) / 2, 6)
        ok = (score >= thr[wanted[a]]) & mask[wanted[a], cell[at + b]]
        more.append((wanted[a[ok]], at + b[ok], score[ok]))
        n += ok.sum()
        if n > len(v) * k // 2:
            q, j, s = merged(q, j, s)
            more, n = [], 0
    return merged(q, j, s)


def _meet(asked: DataFrame, index: Index, k: int, pick) -> DataFrame:
    """(query, id, cell, score, rank): the best k rows of the cells that pick marks for each query.

    Parts of cells are put together in bins, and the queries of a bin are dealt into blocks; one task's work is a block and a
    bin, of bounded size each, whose product is made tile by tile.  So a query travels once a bin and a row once a block.
    """
    bins = _bins(index)
    sent = _sent(asked, index, pick, bins)
    n = np.zeros(bins[-1][-1] + 1, np.int64)
    for r in sent.groupBy("bin").count().collect():  # a row a bin
        n[r.bin] = r["count"]
    least = np.minimum(math.ceil(LEAST_TASKS / max(1, (n > 0).sum())), np.ceil(n / LEAST_BLOCK))
    blocks = F.lit(np.maximum(1, np.maximum(np.ceil(n / BLOCK), least)).astype(int).tolist())
    sent = sent.withColumn("block", F.pmod(F.xxhash64("query"), F.element_at(blocks, F.col("bin") + 1)).cast("int"))
    of, first = F.lit(np.concatenate(bins).tolist()), F.lit(np.cumsum([0, *[len(x) for x in bins]]).tolist())
    cells = [cell for cell, own in enumerate(bins) if n[own].any()]
    rows = index.table(cells).select(F.element_at(of, F.element_at(first, F.col("cell") + 1) + F.col("part") + 1).cast("int").alias("r_bin"), "id", "cell", F.col("unit").alias("own"))
    rows = rows.filter(F.element_at(F.lit(n.tolist()), F.col("r_bin") + 1) > 0)
    rows = rows.select("r_bin", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("r_bin") + 1).cast("int") - 1)).alias("r_block"), "id", "cell", "own")
    centres, low = index.centres, index.low
    kinds = [sent.schema["query"].dataType, rows.schema["id"].dataType]
    out = StructType().add("query", kinds[0]).add("id", kinds[1]).add("cell", "integer").add("score", "double")

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        arrow = pa.schema([("query", q.schema.field("query").type), ("id", r.schema.field("id").type), ("cell", pa.int32()), ("score", pa.float64())])
        if not len(q) or not len(r):
            return arrow.empty_table()
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        r = r.sort_by("cell")
        v, own, cell, worst = matrix(q["unit"]), matrix(r["own"]), r["cell"].to_numpy(), q["worst"].to_numpy()
        order = np.empty(len(r), np.int64)
        order[pc.sort_indices(r["id"]).to_numpy()] = np.arange(len(r))
        near = np.concatenate([(v[at : at + 512] @ centres.T).argmax(1) for at in range(0, len(v), 512)])
        by, found = np.argsort(near, kind="stable"), []
        for at in range(0, len(by), 256):
            some = by[at : at + 256]
            a, b, s = _best(v[some], worst[some], pick(v[some] @ centres.T, low, worst[some]), own, cell, order, k)
            found.append((some[a], b, s))
        a, b, s = (np.concatenate(x) for x in zip(*found))
        return pa.table([q["query"].take(pa.array(a)), r["id"].take(pa.array(b)), pa.array(cell[b], pa.int32()), pa.array(s)], schema=arrow)

    met = sent.groupBy("bin", "block").cogroup(rows.groupBy("r_bin", "r_block")).applyInArrow(best, out)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, id, cell, score, rank) of queries (query: unique, embedding): the best k rows each.

    With `probes`, of the nearest so many cells.  Without, of all rows: a query meets its nearest cell first, and then
    those cells whose radius lets them hold a row that is as good as the worst of its k so far.
    """
    asked = cut(queries.select("query", F.col("embedding").cast("array<double>").alias("embedding")))
    unknown = asked.withColumn("worst", F.lit(None).cast("double"))
    if probes:
        return _meet(unknown, index, k, _nearest_cells(probes))
    first = _meet(unknown, index, k, _nearest_cells(1))
    worst = cut(first.groupBy("query").agg(F.min("score").alias("worst"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n"))
    return _meet(asked.join(worst, "query", "left"), index, k, _reachable)


def probes_for(index: Index, k: int, target: float = 0.95, sample: int = 64) -> int:
    """The fewest probes at which `sample` stored rows (the first by hash) find `target` of their true best k."""
    some = index.table().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select(F.col("id").alias("query"), F.col("unit").alias("embedding")).dropDuplicates(["query"])
    some = cut(some)
    truth = search(index, some, k).select("query", "cell").toPandas()  # sample x k rows
    vectors = {r["query"]: np.array(r.embedding) for r in some.collect()}
    order = {q: np.argsort(np.argsort(-(index.centres @ v), kind="stable")) for q, v in vectors.items()}
    needed = np.sort([order[q][c] + 1 for q, c in zip(truth["query"], truth.cell)])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) if len(needed) else 1
