"""Model answers wired to what reads them: scene analyses with retries, validation and cleaning; co-reference by window.

A model is a plain function (see `models`); it is called in tasks, row by row, and what it answers is parsed and checked
in the JVM.  A call that fails to the end, or an answer that can't be read, is a row with a problem, never a lost one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.text import blank_to_null
from narrata.models import fake_coreference, fake_triad, with_retry
from narrata.operators.analysis import normalized_items, validated

_RELATION = "struct<type string, certainty string, evidence string>"
ANSWER = f"individuals array<struct<name: string, aliases: array<string>, description: string, certainty: string>>, previous {_RELATION}, next {_RELATION}"


def scene_analyses(triads: DataFrame, scenes: DataFrame, generate=fake_triad, attempts: int = 4) -> DataFrame:
    """Analyses of scenes with their neighbours (previous_id, current_id, next_id) whose texts are in scenes (scene_id, text).

    Gives the ids, individuals (cleaned, nameless ones dropped), for both sides type, certainty and evidence, and `problem`:
    FAILED (no call succeeded), UNREADABLE, MISSING_* and INVALID_* of validation, or null.
    """
    text = lambda side: scenes.select(F.col("scene_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
    rows = triads.select("previous_id", "current_id", "next_id").join(text("current"), "current_id").join(text("previous"), "previous_id", "left").join(text("next"), "next_id", "left")
    ids = ["previous_id", "current_id", "next_id"]

    def run(batches):
        for pdf in batches:
            answers, failed = [], []
            for p, c, n in zip(*(pdf[f"{side}_text"] for side in ("previous", "current", "next"))):
                try:
                    answers.append(with_retry(lambda _warmth, p=p, c=c, n=n: generate(p, c, n), attempts))
                    failed.append(False)
                except Exception:
                    answers.append(None)
                    failed.append(True)
            yield pdf[ids].assign(answer=answers, failed=failed)

    kinds = ", ".join(f"{c} {triads.schema[c].dataType.simpleString()}" for c in ids)
    parsed = rows.mapInPandas(run, f"{kinds}, answer string, failed boolean").withColumn("a", F.from_json("answer", ANSWER))
    side = lambda s: [blank_to_null(F.col(f"a.{s}.{c}")).alias(f"{s}_{c}") for c in ("type", "certainty", "evidence")]
    empty = F.col("a").isNull() | (F.col("a.individuals").isNull() & F.col("a.previous").isNull() & F.col("a.next").isNull())
    items = normalized_items(F.coalesce(F.col("a.individuals"), F.array().cast("array<struct<name: string, aliases: array<string>, description: string, certainty: string>>")), "individual")
    out = validated(parsed.select(*ids, items.alias("individuals"), *side("previous"), *side("next"), "failed", (~F.col("failed") & empty).alias("unreadable")))
    problem = F.when(F.col("failed"), "FAILED").when(F.col("unreadable"), "UNREADABLE").otherwise(F.col("problem"))
    return out.withColumn("problem", problem).drop("failed", "unreadable")


def coreference_answers(windows: DataFrame, mentions: DataFrame, judge=fake_coreference) -> tuple[DataFrame, DataFrame]:
    """(responses, allowed) for `consolidate.coreference`: a model's groups (window, mention_ids, confidence) of the mentions (scene_id, id, name) of each window (window, scene_ids), and which ids belong to it (window, id)."""
    allowed = windows.select("window", F.explode("scene_ids").alias("scene_id")).join(mentions.select("scene_id", "id", "name"), "scene_id")
    listed = allowed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("listed"))  # the mentions of some three scenes

    def run(batches):
        for pdf in batches:
            rows = [(w, list(g["mention_ids"]), float(g["confidence"])) for w, items in zip(pdf.window, pdf.listed) for g in judge([(x["id"], x["name"]) for x in items])]
            yield pd.DataFrame(rows, columns=["window", "mention_ids", "confidence"])

    kinds = windows.schema["window"].dataType.simpleString(), mentions.schema["id"].dataType.simpleString()
    return listed.mapInPandas(run, f"window {kinds[0]}, mention_ids array<{kinds[1]}>, confidence double"), allowed.select("window", "id")
