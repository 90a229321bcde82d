"""Reading order, story time and the algebra of temporal relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.text import certainty_weight

#: Interval relations, their canonical relation, and whether the ends swap.
CANONICAL = {
    "before": ("before", False), "after": ("before", True), "meets": ("before", False), "met_by": ("before", True), "overlaps": ("overlaps", False), "overlapped_by": ("overlaps", True),
    "starts": ("starts", False), "started_by": ("starts", True), "during": ("during", False), "contains": ("during", True), "finishes": ("finishes", False), "finished_by": ("finishes", True), "equals": ("overlaps", False),
}
#: What the relation of the previous scene to this one says of this one.
INVERSE = {"before": "after", "meets": "after", "after": "before", "met_by": "before", "overlaps": "overlapped_by", "contains": "during", "during": "contains"}
PREFIX = "R:temporal."


def _base(c: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), F.lit("r:temporal."), F.lit(""))


def _mapped(c: Column, pairs: dict, default: Column) -> Column:
    out = default
    for k, v in pairs.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def canonical(df: DataFrame, kind: str = "temporal_type") -> DataFrame:
    """Relations (from_id, to_id, kind) in canonical form: inverse ones swap their ends; unknown ones stay as they are."""
    base = _base(F.col(kind))
    flip = F.coalesce(base.isin([k for k, (_, f) in CANONICAL.items() if f]), F.lit(False))
    new = _mapped(base, {k: PREFIX + v for k, (v, _) in CANONICAL.items()}, F.col(kind))
    return df.select(
        *[c for c in df.columns if c not in ("from_id", "to_id", kind)],
        F.when(flip, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(flip, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), new.alias(kind),
    )


def inverted(c: Column) -> Column:
    """Relation of the current scene to the previous one, from that of the previous to the current; else null."""
    return _mapped(_base(c), {k: PREFIX + v for k, v in INVERSE.items()}, F.lit(None).cast("string"))


def reading_edges(scenes: DataFrame) -> DataFrame:
    """NEXT edges: within chapters, and from the last scene of chapter n to the first of chapter n + 1 of a book.

    scenes: book_id, chapter_id, chapter_number, scene_index, scene_id.
    """
    w = Window.partitionBy("chapter_id").orderBy("scene_index")
    inner = scenes.select("book_id", F.col("scene_id").alias("from_id"), F.lead("scene_id").over(w).alias("to_id"), F.lit("in_chapter").alias("source")).filter("to_id is not null")
    ends = scenes.groupBy("book_id", "chapter_number").agg(F.min_by("scene_id", "scene_index").alias("head"), F.max_by("scene_id", "scene_index").alias("tail"))
    following = ends.select("book_id", (F.col("chapter_number") - 1).alias("chapter_number"), F.col("head").alias("to_id"))
    cross = ends.join(following, ["book_id", "chapter_number"]).select("book_id", F.col("tail").alias("from_id"), "to_id", F.lit("cross_chapter").alias("source"))
    return inner.unionByName(cross)


def new_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    return edges.join(existing.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def triads(scenes: DataFrame) -> DataFrame:
    """Previous and next scene of each scene in reading order, across chapter borders of a book."""
    w = Window.partitionBy("book_id").orderBy("chapter_number", "scene_index")
    return scenes.select("book_id", F.lag("scene_id").over(w).alias("previous_id"), F.col("scene_id").alias("current_id"), F.lead("scene_id").over(w).alias("next_id"))


def windows(scenes: DataFrame, size: int = 3) -> DataFrame:
    """Sliding windows of `size` scenes of a chapter, step 1; a shorter chapter is one window. (chapter_id, window, scene_ids)"""
    order = Window.partitionBy("chapter_id").orderBy("scene_index")
    span = order.rowsBetween(0, size - 1)
    rows = scenes.select(
        "chapter_id", (F.row_number().over(order) - 1).alias("window"), F.count("*").over(Window.partitionBy("chapter_id")).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("scene_index", "scene_id")).over(span)), lambda x: x.scene_id).alias("scene_ids"),
    )
    return rows.filter((F.size("scene_ids") == size) | ((F.col("n") < size) & (F.col("window") == 0))).select("chapter_id", "window", "scene_ids")


def bounds(scenes: DataFrame) -> DataFrame:
    """Renumbers scenes 0..n-1 by start offset and ends each at the next start, the last at text_length; flags the outer ones."""
    w = Window.partitionBy("chapter_id").orderBy("start_offset")
    return scenes.withColumn("scene_number", (F.row_number().over(w) - 1).cast("int")).withColumn(
        "end_offset", F.coalesce(F.lead("start_offset").over(w), F.col("text_length"))
    ).withColumn("is_first", F.lag("start_offset").over(w).isNull()).withColumn("is_last", F.lead("start_offset").over(w).isNull())


def edge_requests(analyses: DataFrame) -> DataFrame:
    """Temporal edges asked for by scene analyses (previous_id, current_id, next_id and for both neighbours type, certainty, evidence)."""
    before = F.struct(F.col("previous_id").alias("from_id"), F.col("current_id").alias("to_id"), F.col("previous_type").alias("temporal_type"), F.col("previous_certainty").alias("certainty"), F.col("previous_evidence").alias("evidence"))
    after = F.struct(F.col("current_id").alias("from_id"), F.col("next_id").alias("to_id"), F.col("next_type").alias("temporal_type"), F.col("next_certainty").alias("certainty"), F.col("next_evidence").alias("evidence"))
    rows = analyses.select(F.posexplode(F.array(before, after)).alias("direction", "r")).select("direction", "r.*")
    return rows.filter("from_id is not null and to_id is not null and temporal_type is not null").withColumn("weight", certainty_weight(F.col("certainty")))


_REQUEST = ("from_id", "to_id", "temporal_type", "certainty", "raw_from", "raw_to", "raw_type", "seq")


class _Pair:
    """The requests of one unordered pair in order of arrival, see `_reconciled`."""

    def __init__(self):
        self.way, self.old, self.sure = None, None, None  # the pair's one edge
        self.refused: dict = {}  # direction -> last refused request
        self.clashes = 0

    def add(self, from_id, to_id, new, certainty, raw_from, raw_to, raw_type, seq):
        overlap, during, contains = PREFIX + "overlaps", PREFIX + "during", PREFIX + "contains"
        asked, raw, old = (from_id, to_id), (raw_from, raw_to), self.old
        if self.way == raw and old == during and raw_type == contains:
            self.clashes += 1
            self.refused[raw] = (contains, certainty, old, seq)
        elif old is None or new is None or old == new or (old, new) == (overlap, during):
            self.way, self.old, self.sure = asked, new, certainty
        elif (old, new) == (during, overlap):
            self.way, self.sure = asked, certainty
        else:
            self.clashes += 1
            self.refused[asked] = (new, certainty, old, seq)

    def rows(self) -> list[tuple]:
        out = [(*at, kind, certainty, 0, existing, seq) for at, (kind, certainty, existing, seq) in self.refused.items()]
        return out if self.way is None else [*out, (*self.way, self.old, self.sure, self.clashes, None, None)]


def _fold(batches, most: int = 10_000):
    """Folds rows (a, b and those of _REQUEST) that come pair by pair, in order of arrival; a pair may go on in the next batch, and only its state is held."""
    at, pair, out, made = None, None, [], None
    for batch in batches:
        if made is None:
            ids = batch.schema.field("from_id").type
            made = pa.schema([("from_id", ids), ("to_id", ids), ("temporal_type", pa.string()), ("certainty", pa.string()), ("ambiguous", pa.int64()), ("existing_type", pa.string()), ("seq", pa.int64())])
        for a, b, *request in zip(*(batch[c].to_pylist() for c in ("a", "b", *_REQUEST))):
            if pair is None or at != (a, b):
                if pair is not None:
                    out += pair.rows()
                at, pair = (a, b), _Pair()
            pair.add(*request)
            if len(out) >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)
                out = []
    if pair is not None:
        out += pair.rows()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)


def _reconciled(requests: DataFrame) -> DataFrame:
    """The edge of each unordered pair and, with `seq`, its refused requests.

    A pair has one edge.  Types are compared whatever their direction: an equal type or none replaces the
    edge by the incoming one, in its direction; an enclosure beats an overlap and an overlap turns an enclosure
    round but leaves it one; what contradicts is refused, as is `contains` where `during` stands in the same
    direction.  Of the refused requests of a direction the last stays.  Spark sorts the requests by pair and
    arrival, so that a task folds its pairs in one pass, however many there are and however long they are.
    """
    raw = requests.withColumns({"raw_from": F.col("from_id"), "raw_to": F.col("to_id"), "raw_type": F.concat(F.lit(PREFIX), _base(F.col("temporal_type")))})
    rows = canonical(raw).withColumn("a", F.least("from_id", "to_id")).withColumn("b", F.greatest("from_id", "to_id")).select("a", "b", *_REQUEST)
    ids = requests.schema["from_id"].dataType.simpleString()
    order = ["a", "b", F.asc_nulls_last("seq"), "raw_from", "raw_type"]
    return rows.repartition("a", "b").sortWithinPartitions(*order).mapInArrow(_fold, f"from_id {ids}, to_id {ids}, temporal_type string, certainty string, ambiguous long, existing_type string, seq long")


def reconcile(requests: DataFrame) -> DataFrame:
    """One temporal edge for each unordered pair of scenes from requests (from_id, to_id, temporal_type, certainty, seq).

    `ambiguous` counts the requests of the pair that contradicted; they don't change the edge.
    """
    return _reconciled(requests).filter("seq is null").drop("seq", "existing_type")


def ambiguous_relations(requests: DataFrame) -> DataFrame:
    """The last refused request of each direction of a pair, with the type that stood against it."""
    return _reconciled(requests).filter("seq is not null").select("seq", "from_id", "to_id", F.col("temporal_type").alias("incoming_type"), "existing_type", "certainty")


def later(edges: DataFrame, event_id) -> DataFrame:
    """Events that follow one along an edge."""
    return edges.filter(F.col("from_id") == event_id).select(F.col("to_id").alias("id")).distinct()


def earlier(edges: DataFrame, event_id) -> DataFrame:
    """Events that one follows along an edge."""
    return edges.filter(F.col("to_id") == event_id).select(F.col("from_id").alias("id")).distinct()


def neighbours_of(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(id, later, earlier): for each of `events` (id), how many events follow it along an edge and how many it follows."""
    e = edges.select("from_id", "to_id").distinct()
    out, into = e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("later")), e.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("earlier"))
    rows = events.select("id").distinct().join(out, "id", "left").join(into, "id", "left")
    return rows.select("id", F.coalesce("later", F.lit(0)).cast("long").alias("later"), F.coalesce("earlier", F.lit(0)).cast("long").alias("earlier"))


def neighbour_lists(edges: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """(id, direction, n, other): the events that follow each of `events` (id and the columns of `order`) along an edge, and those that it follows, in that order, then by id."""
    e = edges.select("from_id", "to_id").distinct()
    rows = e.select(F.col("from_id").alias("id"), F.lit("later").alias("direction"), F.col("to_id").alias("other")).unionByName(e.select(F.col("to_id").alias("id"), F.lit("earlier").alias("direction"), F.col("from_id").alias("other")))
    rows = rows.join(events.select("id"), "id", "left_semi").join(events.select(F.col("id").alias("other"), *order), "other", "left")
    n = F.row_number().over(Window.partitionBy("id", "direction").orderBy(*[F.asc_nulls_last(c) for c in order], "other"))
    return rows.withColumn("n", n).select("id", "direction", "n", "other")


def scene_events(scenes: DataFrame, chapter_id=None, label: str = "Event") -> DataFrame:
    """Scenes that carry a label (labels: array), of one chapter if it is given, in order of chapter and scene index."""
    rows = scenes.filter(F.array_contains("labels", label))
    if chapter_id is not None:
        rows = rows.filter(F.col("chapter_id") == chapter_id)
    return rows.orderBy("chapter_id", "scene_index")


def edge_counts(scenes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chapter_id, edges): edges that leave the scenes of each chapter."""
    n = edges.groupBy(F.col("from_id").alias("scene_id")).agg(F.count("*").alias("n"))
    return scenes.select("chapter_id", "scene_id").join(n, "scene_id", "left").groupBy("chapter_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


def structure(chapters: DataFrame, scenes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): counts that tell whether a library is whole: chapters and scenes, chapters without scenes, scenes without a chapter, edges by type."""
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.lit(None).cast("string").alias("name"), F.count("*").alias("n"))
    of = scenes.select("chapter_id")
    parts = [
        count(chapters, "chapters"), count(scenes, "scenes"), count(chapters.join(of, "chapter_id", "left_anti"), "empty chapters"),
        count(scenes.join(chapters.select("chapter_id"), "chapter_id", "left_anti"), "orphan scenes"),
        edges.groupBy(F.col("temporal_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "name", "n"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def boundary_pairs(scenes: DataFrame) -> DataFrame:
    """(book_id, chapter_number, last_scene, next_chapter, first_scene) of adjacent chapters that both have scenes."""
    ends = scenes.groupBy("book_id", "chapter_number").agg(F.max_by("scene_id", "scene_index").alias("last_scene"), F.min_by("scene_id", "scene_index").alias("first_scene"))
    following = ends.select("book_id", F.col("chapter_number").alias("next_chapter"), (F.col("chapter_number") - 1).alias("chapter_number"), "first_scene")
    return ends.drop("first_scene").join(following, ["book_id", "chapter_number"])
