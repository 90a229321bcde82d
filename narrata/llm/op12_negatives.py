"""Operator 12: hard negatives by a pivot table.

A row takes part if its label, its vector and every component are there and finite.  Where
vec_id is divisible by 7 the label first becomes (label + 1) % 10.  A component x becomes
floor(256 * x); a score is the integer inner product with the anchor.  Anchors are the rows
whose vec_id is divisible by `every`; positives are an anchor's first `positives` rows of its
label, negatives the first `negatives` rows of another label with
50 * positive_score <= 100 * negative_score <= 95 * positive_score.  Higher scores come first,
ties by smaller vec_id.

How it runs.  With M the largest squared norm, a row x is augmented to (x, sqrt(M - |x|^2)) and an
anchor q to (q, 0); then |q - x|^2 = |q|^2 + M - 2 <q, x>, and the triangle inequality over the
distances to common pivots brackets the score:

    max |d(q,p) - d(x,p)| <= |q - x| <= min d(q,p) + d(x,p)

1. `PIVOTS` rows, far apart among a bounded sample (`SAMPLE` rows by hash), become pivots; every
   row stores its distances to them, the pivot table.
2. Rows form groups: cells of the nearest pivot, cut into rings of equal size by the distance to
   it, and beyond `GROUP_ROWS` by a hash; a cell that holds most rows is many groups.  A small
   row of each group has the range of each pivot's distances.
3. Each anchor meets its own group first; its fifth best positive there is a bound.  Then it goes to
   the groups whose bracket reaches the bound; there rows are bracketed one by one and the survivors'
   scores are computed in whole-block products.  Partial lists of each group are merged.
4. Negatives go the same way, with the range of scores that the positives allow.

Anchors travel in blocks of `BLOCK` and meet a group as one block product; neither side is ever
gathered whole.  Scores are exact: products of doubles are used only while sums stay below 2**53,
else 64-bit integers (components are taken to be below 2**24, i.e. x below 65,536).

Defined cases: vectors shorter than the longest count as padded with zeros, an empty one as all
zeros; rows with an anchor's vec_id are neither its positives nor its negatives; other repeated rows are
rows of their own; an anchor row that is repeated in full gives its result as often; a null vec_id is
no anchor and comes last among ties; where 7 divides vec_id, a label is a plain integer modulo 10.
Other columns are ignored; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.store import drop, keep

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
PIVOTS, SAMPLE = 16, 256
#: Rows of a group at most (by expectation), of a ring at least; anchors of a block; group rows of a page.
GROUP_ROWS, RING_ROWS, BLOCK, PAGE = 32_768, 4_096, 8_192, 4_096
LAST = 2**63 - 1


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _far_apart(v: np.ndarray, lift: float, n: int) -> np.ndarray:
    """n rows of the sample, each farthest from those before it, in the augmented space."""
    full = np.column_stack([v, np.sqrt(np.maximum(lift - (v**2).sum(1), 0))])
    chosen, near = [0], ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(v)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((full - full[chosen[-1]]) ** 2).sum(1))
    return full[chosen]


def usable(embeddings: DataFrame) -> DataFrame:
    """(i, label, v): rows that take part, with their new labels and integer vectors."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("i"), label.alias("label"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v")
    )


class PivotTable:
    """Rows with their distances to the pivots, dealt into groups; see the module."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, ring_rows: int = RING_ROWS):
        norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        about = rows.agg(F.max(norm).alias("lift"), F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
        self.lift, self.dim, self.n = float(about["lift"] or 0), int(about["dim"] or 0), about["n"]
        sample = rows.orderBy(F.xxhash64("i", "label"), "i").limit(SAMPLE).select("v").collect()  # a bounded sample, the same each time
        self.pivots = _far_apart(_matrix([r.v for r in sample], self.dim), self.lift, pivots) if sample else np.zeros((0, self.dim + 1))
        rows = keep(rows.mapInPandas(self._distances(), "i long, label long, v array<long>, dist array<double>, cell int, home double"))
        cuts = rows.groupBy("cell").agg(
            F.percentile_approx("home", F.array(*[F.lit(q / 64) for q in range(1, 64)]), F.lit(2000)).alias("cuts"),
            F.ceil(F.count("*") / ring_rows).alias("rings"),
        )
        part = F.size(F.filter("cuts", lambda c: c < F.col("home")))
        ringed = rows.join(F.broadcast(cuts), "cell").withColumn("ring", F.floor(part * F.least("rings", F.lit(64)) / 64).cast("int")).drop("cuts", "rings", "home")
        sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("salts"))  # cells x rings: 1,024 rows at most
        salted = ringed.join(F.broadcast(sizes), ["cell", "ring"])
        group = F.xxhash64("cell", "ring", F.pmod(F.xxhash64("i", "v"), F.col("salts")))
        self.rows = keep(salted.select(group.alias("group"), "i", "label", "v", "dist"))
        drop(rows)
        each = [f(F.col("dist")[j]).alias(f"{n}{j}") for j in range(len(self.pivots)) for n, f in (("low", F.min), ("high", F.max))]
        ranges = self.rows.groupBy("group").agg(F.count("*").alias("n"), *each)
        arrays = [F.array(*[F.col(f"{n}{j}") for j in range(len(self.pivots))]).cast("array<double>").alias(n) for n in ("low", "high")]
        self.pages = max(1, math.ceil(self.n / ring_rows / PAGE))
        self.ranges = keep(ranges.select("group", F.pmod("group", F.lit(self.pages)).alias("page"), *arrays))

    def _distances(self):
        pivots, lift, dim = self.pivots, self.lift, self.dim

        def run(batches):
            for pdf in batches:
                v = _matrix(pdf.v, dim)
                d = far(np.column_stack([v, np.sqrt(np.maximum(lift - (v**2).sum(1), 0))]), pivots)
                cell = d.argmin(1) if d.size else np.zeros(len(v), int)
                yield pdf[["i", "label", "v"]].assign(dist=list(d), cell=cell.astype(np.int32), home=d.min(1, initial=np.inf))

        return run

    def anchors(self, every: int, block: int = BLOCK) -> DataFrame:
        """(a, i, label, v, times, group, block): each distinct anchor row once, with a key of its own."""
        rows = self.rows.filter((F.col("i") != LAST) & (F.col("i") % every == 0)).groupBy("i", "label", "v").agg(F.count("*").alias("times"), F.first("group").alias("group"))
        n = max(1, math.ceil(self.n / every / block))
        return rows.select(F.xxhash64("i", "label", "v").alias("a"), "i", "label", "v", "times", "group", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(n)).cast("int").alias("block"))

    def reachable(self, anchors: DataFrame) -> DataFrame:
        """(a, group) for each anchor (a, v, block, least, most) and group whose bracket meets the scores least to most (null: open)."""
        pivots, lift, dim = self.pivots, self.lift, self.dim

        def run(anchors: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
            if not len(anchors) or not len(ranges):
                return pd.DataFrame({"a": np.zeros(0, np.int64), "group": np.zeros(0, np.int64)})
            low, high, groups, out = np.stack(ranges.low), np.stack(ranges.high), ranges.group.to_numpy(), []
            q = _matrix(anchors.v, dim)
            d, square = far(np.column_stack([q, np.zeros(len(q))]), pivots), (q**2).sum(1)
            least, most = anchors.least.fillna(-np.inf).to_numpy(), anchors.most.fillna(np.inf).to_numpy()
            for k, a in enumerate(anchors.a):
                near = np.maximum(np.maximum(low - d[k], d[k] - high).max(1), 0)
                upper, lower = bracket(near, (d[k] + high).min(1), square[k], lift)
                at = np.flatnonzero((upper >= least[k]) & (lower <= most[k]))
                out.append(pd.DataFrame({"a": np.full(len(at), a), "group": groups[at]}))
            return pd.concat(out)

        every_page = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.pages - 1).cast("long")))
        paged = anchors.withColumn("page", every_page).select("page", "block", "a", "v", "least", "most")
        blocks = anchors.select("block").distinct()
        ranges = self.ranges.join(blocks.withColumn("page", every_page), "page")
        ranges = ranges.toDF(*ranges.columns)  # columns of their own, as both sides come from one table
        return paged.groupBy("page", "block").cogroup(ranges.groupBy("page", "block")).applyInPandas(run, "a long, group long")

    def best(self, anchors: DataFrame, pairs: DataFrame, n: int, negative: bool) -> DataFrame:
        """Each anchor's best rows in each group it is sent to: (a, slot, i, score, rank), partial lists.

        Positives (slot 0): rows of the anchor's label with a score of at least `least`.  Negatives: for
        each of the anchor's `slots` (positive scores), rows of other labels in the range it allows.
        """
        pivots, lift, dim = self.pivots, self.lift, self.dim

        def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(anchors) and len(rows):
                q = _matrix(anchors.v, dim)
                dq, square = far(np.column_stack([q, np.zeros(len(q))]), pivots), (q**2).sum(1)
                least, most = anchors.least.fillna(-np.inf).to_numpy(), anchors.most.fillna(np.inf).to_numpy()
                found: list[list] = [[] for _ in range(len(anchors))]
                for at in range(0, len(rows), 2048):
                    some = rows.iloc[at : at + 2048]
                    v, d = _matrix(some.v, dim), np.stack(some.dist)
                    ids, labels = some.i.to_numpy(), some.label.to_numpy()
                    for b in range(0, len(q), 512):
                        part = slice(b, b + 512)
                        near, away = np.zeros((len(q[part]), len(v))), np.full((len(q[part]), len(v)), np.inf)
                        for j in range(len(pivots)):
                            near = np.maximum(near, np.abs(dq[part, j, None] - d[None, :, j]))
                            away = np.minimum(away, dq[part, j, None] + d[None, :, j])
                        upper, lower = bracket(near, away, square[part, None], lift)
                        alive = (upper >= least[part, None]) & (lower <= most[part, None])
                        alive &= (labels[None, :] != anchors.label.to_numpy()[part, None]) == negative
                        alive &= ids[None, :] != anchors.i.to_numpy()[part, None]
                        use = np.flatnonzero(alive.any(0))
                        if not len(use):
                            continue
                        s = _scores(q[part], v[use])
                        for k in range(len(s)):
                            hit = np.flatnonzero(alive[k, use])
                            if len(hit):
                                found[b + k].append((s[k, hit], ids[use[hit]]))
                for k, parts in enumerate(found):
                    if not parts:
                        continue
                    s, i = (np.concatenate(x) for x in zip(*parts))
                    for slot, p in enumerate(anchors.slots.iloc[k] if negative else [None]):
                        own = np.flatnonzero((50 * p <= 100 * s) & (100 * s <= 95 * p)) if negative else np.arange(len(s))
                        if len(own) > n:
                            own = own[s[own] >= np.partition(s[own], len(own) - n)[len(own) - n]]
                        own = own[np.lexsort((i[own], -s[own]))][:n]
                        out += [(anchors.a.iloc[k], slot, x, y) for x, y in zip(i[own].tolist(), s[own].tolist())]
            return pd.DataFrame(out, columns=["a", "slot", "i", "score"]).astype({"a": "int64", "slot": "int32", "i": "int64", "score": "int64"})

        sent = pairs.join(anchors.drop("group"), "a").select("group", "block", "a", "i", "label", "v", "least", "most", "slots")
        to = sent.select("group", "block").distinct()
        rows = self.rows.join(to, "group").select("group", "block", "i", "label", "v", "dist").toDF("group", "block", "i", "label", "v", "dist")
        lists = sent.groupBy("group", "block").cogroup(rows.groupBy("group", "block")).applyInPandas(run, "a long, slot int, i long, score long")
        rank = F.row_number().over(Window.partitionBy("a", "slot").orderBy(F.desc("score"), "i"))
        return lists.withColumn("rank", rank).filter(F.col("rank") <= n)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0)) if len(b) else np.zeros((len(a), 0))


def bracket(near, away, square, lift):
    """(upper, lower) bounds of scores at distances between near and away, widened by more than rounding can move them."""
    base = square + lift
    slack = 1e-6 * (base + 1)
    return (base - np.asarray(near) ** 2) / 2 + slack, (base - np.asarray(away) ** 2) / 2 - slack


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module."""
    table = PivotTable(usable(embeddings), **sizes)
    anchors = keep(table.anchors(every))
    open_ = F.lit(None).cast("double")
    plain = anchors.withColumns({"least": open_, "most": open_, "slots": F.lit(None).cast("array<long>")})
    home = table.best(plain, plain.select("a", "group"), positives, False)
    fifth = home.groupBy("a").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("a", F.when(F.col("n") == positives, F.col("low")).cast("double").alias("least"))
    bounded = keep(plain.drop("least").join(fifth, "a", "left"))
    good = keep(table.best(bounded, table.reachable(bounded), positives, False))

    ranked = good.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "i", "score"))).alias("good"))  # `positives` rows an anchor
    scores = F.col("good.score")
    allowed = {"slots": scores, "least": F.array_min(scores) * 0.5, "most": F.array_max(scores) * 0.95}
    asked = keep(anchors.join(ranked, "a").withColumns(allowed).filter("array_max(slots) >= 0"))  # below 0 the range is empty
    bad = table.best(asked, table.reachable(asked), negatives, True)
    out = bad.join(asked.select("a", F.col("i").alias("anchor_id"), "good", "times"), "a")
    out = out.withColumns({"p": F.col("good")[F.col("slot")], "one": F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))})
    null_last = lambda c: F.when(c != LAST, c)
    return out.select(
        "anchor_id", null_last(F.col("p.i")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), null_last(F.col("i")).alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
