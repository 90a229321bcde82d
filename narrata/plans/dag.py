"""The stage graph of an ingestion job, and the state machine over it."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators.filters import SATISFYING, TERMINAL, older

#: Lanes of entities, and the stages in their order of declaration.
_LANES = ("INDIVIDUAL", "COLLECTIVE", "LOCATION", "OBJECT", "CONCEPT")
STEPS = (
    "SCENE_SEGMENTATION", "CHUNKING", "EMBEDDING",
    "CHAPTER_INDIVIDUAL_CONSOLIDATION", "CHAPTER_COLLECTIVE_CONSOLIDATION", "CHAPTER_LOCATION_CONSOLIDATION", "CHAPTER_OBJECT_CONSOLIDATION", "CHAPTER_EVENT_CONSOLIDATION", "CHAPTER_CONCEPT_CONSOLIDATION",
    "BOOK_INDIVIDUAL_CONSOLIDATION", "BOOK_COLLECTIVE_CONSOLIDATION", "BOOK_LOCATION_CONSOLIDATION", "BOOK_OBJECT_CONSOLIDATION", "BOOK_CONCEPT_CONSOLIDATION",
    "CHAPTER_EVENT_EMBEDDING", "BOOK_EVENT_CANDIDATE_GENERATION", "INGESTION_COMPLETE",
)
STATES = ("PENDING", "TRIGGERED", "RUNNING", *TERMINAL)
ROOT, LAST = STEPS[0], STEPS[-1]


class StageDag:
    """Children, parents and closures of the stages."""

    def __init__(self) -> None:
        chains = [["CHUNKING", "EMBEDDING"], *([f"CHAPTER_{x}_CONSOLIDATION", f"BOOK_{x}_CONSOLIDATION"] for x in _LANES)]
        chains.append(["CHAPTER_EVENT_CONSOLIDATION", "CHAPTER_EVENT_EMBEDDING", "BOOK_EVENT_CANDIDATE_GENERATION"])
        self.edges = [(a, b) for chain in chains for a, b in zip([ROOT, *chain], [*chain, LAST])]

    def roots(self) -> list[str]:
        ends = {b for _, b in self.edges}
        return [s for s in STEPS if s not in ends]

    def children_of(self, step: str) -> list[str]:
        return [b for a, b in self.edges if a == step]

    def parents_of(self, step: str) -> list[str]:
        return [a for a, b in self.edges if b == step]

    def downstream(self, step: str) -> set[str]:
        """All stages that follow a stage, itself excluded."""
        seen, queue = set(), deque(self.children_of(step))
        while queue:
            s = queue.popleft()
            if s not in seen:
                seen.add(s)
                queue.extend(self.children_of(s))
        return seen

    def depth(self, step: str) -> int:
        return max((1 + self.depth(p) for p in self.parents_of(step)), default=0)

    def deepest_first(self, steps) -> list[str]:
        return sorted(steps, key=lambda s: (-self.depth(s), STEPS.index(s)))

    def unreachable(self) -> set[str]:
        return set(STEPS) - set(self.roots()) - {x for r in self.roots() for x in self.downstream(r)}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges, "parent string, child string")


def segment_of(step: str) -> str:
    """The stage's part of a URL."""
    return step.lower().replace("_", "-")


def closure(spark: SparkSession, dag: StageDag | None = None) -> DataFrame:
    """(ancestor, descendant) of the stage graph, by a recursive query."""
    return spark.sql(
        """
      WITH RECURSIVE reach(ancestor, descendant) AS (
        SELECT parent, child FROM {edges} UNION ALL SELECT r.ancestor, e.child FROM reach r JOIN {edges} e ON r.descendant = e.parent)
      SELECT DISTINCT ancestor, descendant FROM reach""",
        edges=(dag or StageDag()).frame(spark),
    )


#: What can be asked for, by URL name, its scope and what it waits for, in order of the pipeline; the descriptions are ours.
_SUBJECTS = (
    ("scene-segmentation", "finds where the scenes of a chapter begin and end", "chapter", ""), ("chunking", "cuts scenes into pieces of a size that can be embedded", "chapter", "scene-segmentation"),
    ("embedding", "gives every piece its vector", "chapter", "chunking"),
    *((f"chapter-consolidate-{x}s", f"joins what the scenes of a chapter say of one {x}", "chapter", "scene-segmentation") for x in ("individual", "collective", "location", "object")),
    ("chapter-consolidate-events", "joins what the scenes of a chapter say of one event", "chapter", "scene-segmentation"), ("chapter-event-embedding", "gives the events of a chapter their vectors", "chapter", "chapter-consolidate-events"),
    *((f"book-consolidate-{x}s", f"joins the {x}s of all chapters of a book", "book", f"chapter-consolidate-{x}s") for x in ("individual", "collective", "location", "object")),
    ("book-event-candidate-generation", "pairs events of different chapters that may be one", "book", "chapter-event-embedding"),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """The stages that can be asked for: place, key, description, scope, prerequisites (comma-joined)."""
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(_SUBJECTS)], "place int, key string, description string, scope string, prerequisites string")


def ready(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """PENDING stages (job_id, step) all of whose parents are completed or skipped; a stage without parents is ready."""
    state = stages.select("job_id", F.col("step").alias("parent"), F.col("status").alias("parent_status"))
    waiting = stages.filter("status = 'PENDING'").join(edges.withColumnRenamed("child", "step"), "step", "left")
    good = F.coalesce(F.col("parent_status").isin(*SATISFYING), F.col("parent").isNull())
    return waiting.join(state, ["job_id", "parent"], "left").groupBy("job_id", "step").agg(F.bool_and(good).alias("ok")).filter("ok").select("job_id", "step")


def trigger(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Stages after the barrier: ready ones become TRIGGERED with one more attempt."""
    now = ready(stages, edges).withColumn("go", F.lit(True))
    return stages.join(now, ["job_id", "step"], "left").select(
        *[c for c in stages.columns if c not in ("status", "attempts")],
        F.when(F.col("go"), "TRIGGERED").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.coalesce(F.col("go").cast("int"), F.lit(0))).alias("attempts"),
    )


def recover(stages: DataFrame, as_of, triggered_s: int = 60, running_s: int = 300, attempts: int = 3) -> DataFrame:
    """Stages triggered or running for too long, and what becomes of them: TRIGGERED again, or FAILED after `attempts`."""
    at = F.lit(as_of).cast(stages.schema["triggered_at"].dataType)
    lost = ((F.col("status") == "TRIGGERED") & older(F.col("triggered_at"), at, triggered_s)) | ((F.col("status") == "RUNNING") & older(F.col("triggered_at"), at, running_s))
    again = (F.col("status") == "TRIGGERED") | (F.col("attempts") < attempts)
    return stages.filter(lost).withColumn("new_status", F.when(again, "TRIGGERED").otherwise("FAILED"))


def rerun(stages: DataFrame, job_id, step: str, dag: StageDag | None = None) -> DataFrame:
    """Stages after a rerun is asked for: the step TRIGGERED, all that follow it PENDING."""
    after = list((dag or StageDag()).downstream(step))
    own = F.col("job_id") == job_id
    status = F.when(own & (F.col("step") == step), "TRIGGERED").when(own & F.col("step").isin(after), "PENDING").otherwise(F.col("status"))
    return stages.withColumn("status", status)


class Dispatcher:
    """Runs handlers of stages by name; an error becomes a FAILED result instead of leaving the loop."""

    def __init__(self) -> None:
        self.handlers: dict = {}

    def register(self, step: str, handler) -> None:
        if step not in STEPS:
            raise ValueError(f"unknown stage {step}")
        if step in self.handlers:
            raise ValueError(f"{step} has a handler")
        self.handlers[step] = handler

    def run(self, step: str, *args) -> tuple[str, object]:
        if step not in self.handlers:
            return "SKIPPED", None
        try:
            return "COMPLETED", self.handlers[step](*args)
        except Exception as e:  # the boundary between the runner and a stage's own code
            return "FAILED", str(e)[:200]
