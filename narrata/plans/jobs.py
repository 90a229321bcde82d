"""Jobs: overall status, progress, pages, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.filters import TERMINAL


def summaries(stages: DataFrame, last_step, order: tuple | None = None) -> DataFrame:
    """job_id, status, progress_percent, completed_at from stages (job_id, step, status, triggered_at).

    COMPLETE if the last step is done; else FAILED if any failed; else the first step that isn't
    over; else COMPLETE.  Progress is whole percents, -1 if failed.  Steps come in their own order,
    or in the declared one if `order` lists them (steps that it doesn't list come last).
    """
    over = F.col("status").isin(*TERMINAL)
    rank = F.col("step")
    if order:
        place = F.array_position(F.array(*map(F.lit, order)), F.col("step"))
        rank = F.when(place > 0, place).otherwise(len(order) + 1)
    done = F.max((F.col("step") == last_step) & (F.col("status") == "COMPLETED"))
    g = stages.groupBy("job_id").agg(
        done.alias("done"), F.bool_or(F.col("status") == "FAILED").alias("failed"), F.min_by("step", F.when(~over, rank)).alias("open"),
        F.count_if(over).alias("ended"), F.count("*").alias("total"), F.max(F.when(F.col("step") == last_step, F.col("triggered_at"))).alias("last_at"), F.max("triggered_at").alias("any_at"),
    )
    status = F.when(F.col("done"), F.lit("COMPLETE")).when(F.col("failed"), "FAILED").when(F.col("open").isNotNull(), F.col("open").cast("string")).otherwise("COMPLETE")
    percent = F.when(status == "FAILED", F.lit(-1)).otherwise(F.floor(F.col("ended") * 100 / F.col("total")).cast("int"))
    return g.select("job_id", status.alias("status"), percent.alias("progress_percent"), F.coalesce("last_at", "any_at").alias("completed_at"))


def page(jobs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, undated last, then by id."""
    return jobs.orderBy(F.desc_nulls_last("created_at"), "job_id").offset(offset).limit(limit)


def page_of(jobs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page with the total of all jobs and whether more follow; an empty page of a full list has no rows."""
    total = jobs.agg(F.count("*").alias("total"))  # one row
    return page(jobs, limit, offset).join(F.broadcast(total), how="cross").withColumn("has_more", F.lit(limit + offset) < F.col("total"))


def details(stages: DataFrame, order: tuple) -> DataFrame:
    """The stages of each job in declared order, with their place: job_id, place, step, status, attempts."""
    return stages.select("job_id", F.array_position(F.array(*map(F.lit, order)), F.col("step")).cast("int").alias("place"), "step", "status", "attempts")


def by_status(jobs: DataFrame, status: str | None) -> DataFrame:
    """Jobs with a status, or the ACTIVE ones; other names are refused."""
    if status is None:
        return jobs
    if status == "ACTIVE":
        return jobs.filter(~F.col("status").isin("COMPLETE", "FAILED"))
    if not status.replace("_", "").isalnum() or status != status.upper():
        raise ValueError(f"unknown status {status}")
    return jobs.filter(F.col("status") == status)


def in_universe(jobs: DataFrame, chapters: DataFrame, universe: str) -> DataFrame:
    return jobs.join(chapters.filter(F.col("universe") == universe).select("chapter_id"), "chapter_id", "left_semi")


def latest(records: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest record of each key."""
    rest = [c for c in records.columns if c not in (*keys, at, tie)]
    return records.groupBy(*keys).agg(F.max(F.struct(at, tie, *rest)).alias("r")).select(*keys, "r.*")


def with_calls(records: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Telemetry records with their requests and responses gathered (each call has a few)."""
    gather = lambda df, name: df.groupBy("call_id").agg(F.array_sort(F.collect_set("body")).alias(name))
    return records.join(gather(requests, "requests"), "call_id", "left").join(gather(responses, "responses"), "call_id", "left")


def health(calls: DataFrame, by: str, ok: Column, seconds: Column, attempts: Column) -> DataFrame:
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successes"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"),
        F.round(F.avg(F.when(ok, seconds)), 6).alias("avg_seconds"), F.round(F.avg(attempts), 6).alias("avg_attempts"),
    )
