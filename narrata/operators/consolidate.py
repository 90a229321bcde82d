"""Mentions to chapter entities to book entities, for every lane; events by co-reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.text import blank_to_null, name_keys
from narrata.operators.graph import clusters, cut, hubs_within, min_labels, set_clusters, settled

#: Lanes and the attributes an entity of the lane carries.
LANES = {
    "individual": (), "location": (), "object": ("type", "material", "purpose", "description"),
    "collective": ("collective_type", "certainty", "evidence"), "concept": ("concept_type", "description", "certainty", "evidence"),
}
MERGE_CONFIDENCE = 0.75


def most_frequent(c: str) -> Column:
    """The most frequent non-blank value, the smallest of equals."""
    return F.mode(blank_to_null(F.col(c)), True)


def ordered_distinct(rank: Column, values: Column) -> Column:
    """Distinct elements of an array column over a group, in order of rank."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), values.alias("v")))), lambda x: x.v)))


def key_set(keys: Column) -> Column:
    """The keys of a row as a value that equal sets share."""
    return F.array_sort(F.array_distinct(keys))


def _consolidated(mentions: DataFrame, scope: str, lane: str, local: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities as `consolidate` gives them, with the rank of their representative (first_rank), and (scope, keys, cluster): the entity of each set of keys, with repeats.

    Rows are aggregated by their keys and aliases before anything else, so what is clustered and joined are sets
    of names, not mentions, and mentions are read once.  With `local` (scopes that are one row of the input, as chapters are)
    mentions are dealt by scope once, and hubs of keys are found where they lie.
    """
    rows = mentions.filter("id is not null and size(keys) > 0").withColumnRenamed(scope, "scope").withColumn("keys", key_set(F.col("keys")))
    valued = {a: blank_to_null(F.col(a)) for a in LANES[lane]}
    rows = rows.select("scope", "keys", "aliases", "id", F.struct("rank", "id", "display_name", "normalized_name").alias("first"), *[F.when(v.isNotNull(), F.struct("rank", "id", v.alias("v"))).alias(a) for a, v in valued.items()])
    parts = (rows.repartition("scope") if local else rows).groupBy("scope", "keys", "aliases").agg(F.min("id").alias("item"), F.count("*").alias("n"), F.min("first").alias("first"), *[F.min(a).alias(a) for a in valued])
    if local:
        parts = settled(cut(hubs_within(parts)))
    else:
        parts = cut(parts)
        parts = parts.join(set_clusters(cut(parts.groupBy("scope", "keys").agg(F.min("item").alias("rep")))), ["scope", "keys"])
    out = parts.groupBy("scope", "cluster").agg(
        F.min("first").alias("first"), ordered_distinct(F.struct("first.rank", "first.id"), F.col("aliases")).alias("aliases"), F.sum("n").alias("mention_count"), *[F.min(a).alias(a) for a in valued],
    ).select(
        "scope", "cluster", "first.display_name", "first.normalized_name", "aliases", "mention_count", F.col("first.id").alias("representative_id"), *[F.col(a)["v"].alias(a) for a in valued], F.col("first.rank").alias("first_rank"),
    )
    return out, parts.select("scope", "keys", "cluster")


def consolidate(mentions: DataFrame, scope: str, lane: str = "individual") -> DataFrame:
    """Entities of a scope from mentions (scope, id: unique in its scope, rank, display_name, normalized_name, aliases, keys, lane attributes).

    The representative is the member of the lowest rank; aliases come in rank order.
    """
    return _consolidated(mentions, scope, lane)[0].drop("first_rank")


def resolvable(mentions: DataFrame) -> DataFrame:
    """Mentions (display_name, normalized_name, aliases) with their keys; those without any name are left out."""
    keys = name_keys(F.coalesce(blank_to_null(F.col("normalized_name")), F.col("display_name")), F.col("aliases"))
    return mentions.withColumn("keys", keys).filter(F.size("keys") > 0)


def _of_chapters(mentions: DataFrame, lane: str) -> tuple[DataFrame, DataFrame]:
    out, sets = _consolidated(resolvable(mentions), "chapter_id", lane, local=True)
    name = F.concat_ws("/", F.col("scope").cast("string"), F.col("cluster").cast("string"))
    return out.drop("first_rank").withColumn("id", name).withColumnRenamed("scope", "chapter_id"), sets.select(F.col("scope").alias("chapter_id"), "keys", name.alias("chapter_entity"))


def _of_books(entities: DataFrame, chapters: DataFrame, lane: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Book entities, (book_id, id, keys) of the chapter entities and (book_id, keys, book_entity), so that each may be cut down before they meet."""
    rank = F.struct(F.col("normalized_name").isNull(), "normalized_name", F.col("display_name").isNull(), "display_name", "chapter_id")
    rows = resolvable(entities.drop("cluster").join(chapters.select("chapter_id", "book_id"), "chapter_id"))
    out, sets = _consolidated(rows.withColumn("rank", rank), "book_id", lane)
    books = out.withColumnsRenamed({"scope": "book_id", "mention_count": "chapter_count"}).withColumn("first_seen_chapter_id", F.col("first_rank")["chapter_id"]).drop("first_rank")
    return books, rows.select("book_id", "id", key_set(F.col("keys")).alias("keys")), sets.distinct().withColumnsRenamed({"scope": "book_id", "cluster": "book_entity"})


def chapter_entities(mentions: DataFrame, lane: str = "individual") -> DataFrame:
    """One lane's entities of every chapter, from mentions (chapter_id, id, rank, names, aliases, attributes of the lane)."""
    return _of_chapters(mentions, lane)[0]


def book_entities(entities: DataFrame, chapters: DataFrame, lane: str = "individual") -> DataFrame:
    """One lane's entities of every book, from chapter entities and chapters (chapter_id, book_id).

    Members are in order of name, display name, chapter and id; the first of them names the
    entity, is its representative, and gives the chapter in which it was first seen.
    """
    return _of_books(entities, chapters, lane)[0]


def lane_tables(mentions: DataFrame, chapters: DataFrame, lane: str = "individual") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One lane as tables that are made once: chapter entities, book entities, (book_id, id, book_entity) of chapter entities, (chapter_id, keys, chapter_entity) of a mention's keys."""
    entities, named = _of_chapters(mentions, lane)
    entities = cut(entities)
    books, members, sets = _of_books(entities, chapters, lane)
    return entities, cut(books), cut(members.join(sets, ["book_id", "keys"]).select("book_id", "id", "book_entity")), named.distinct()


def named_members(mentions: DataFrame, chapters: DataFrame, names: DataFrame, lane: str = "individual") -> DataFrame:
    """(chapter_id, keys, chapter_entity, book_id, book_entity, display_name, normalized_name, first_seen_chapter_id): the sets of keys by which mentions reach the book entities of some names (normalized_name), a table.

    The names are asked of the books first, and what they leave is followed down, so nothing is linked that no name reaches.
    """
    entities, named = _of_chapters(mentions, lane)
    books, members, sets = _of_books(cut(entities), chapters, lane)
    books = books.join(names.select("normalized_name").distinct(), "normalized_name", "left_semi")
    asked = cut(books.select("book_id", F.col("cluster").alias("book_entity"), "display_name", "normalized_name", "first_seen_chapter_id"))
    reached = cut(members.join(cut(sets.join(asked, ["book_id", "book_entity"])), ["book_id", "keys"]).drop("keys").withColumnRenamed("id", "chapter_entity"))
    return cut(named.join(reached, "chapter_entity").distinct())


def book_entities_after(changed: DataFrame, members: DataFrame, fresh: DataFrame, chapters: DataFrame, books: DataFrame, lane: str = "individual") -> tuple[DataFrame, DataFrame]:
    """(kept, rewritten) book entities of a lane after some chapters (changed: chapter_id) were consolidated anew.

    members: the chapter entities so far with the book_id and the book_entity that each refers to; fresh: the chapter entities
    that the changed chapters have now.  Touched are the book entities that a changed chapter was part of, and those that share a
    key with a fresh entity of their book.  Nothing else can split or join, so only these are built again, from their
    members in other chapters and the fresh ones; kept and rewritten together are what building all anew gives.
    """
    old = resolvable(members)
    asked = resolvable(fresh).join(chapters.select("chapter_id", "book_id"), "chapter_id").select("book_id", F.explode("keys").alias("key")).distinct()
    meets = old.select("book_id", "book_entity", F.explode("keys").alias("key")).join(asked, ["book_id", "key"], "left_semi").select("book_id", "book_entity")
    was = old.join(changed.select("chapter_id"), "chapter_id", "left_semi").select("book_id", "book_entity")
    touched = cut(meets.unionByName(was).distinct())
    others = old.join(changed.select("chapter_id"), "chapter_id", "left_anti").join(touched, ["book_id", "book_entity"], "left_semi")
    inside = others.select(fresh.columns).unionByName(fresh)
    kept = books.join(touched.withColumnRenamed("book_entity", "cluster"), ["book_id", "cluster"], "left_anti").select(books.columns)
    return kept, book_entities(inside, chapters, lane).select(books.columns)


def refers_to(members: DataFrame, scope: str) -> DataFrame:
    """(item, cluster): which entity of a scope (book or chapter) each member (scope, id, names) belongs to."""
    keyed = resolvable(members)
    return clusters(keyed.select(F.col(scope).alias("scope"), F.col("id").alias("item"), "keys")).select("scope", "item", "cluster")


def linked_mentions(mentions: DataFrame, links: DataFrame, scope: str) -> DataFrame:
    """Mentions with the entity they refer to and their status: `resolved` where there is a link (scope, item, cluster), else `unresolved`."""
    to = links.select(F.col("scope").alias(scope), F.col("item").alias("id"), F.col("cluster").alias("entity"))
    return mentions.drop("resolution_status").join(to, [scope, "id"], "left").withColumn("resolution_status", F.when(F.col("entity").isNotNull(), "resolved").otherwise("unresolved"))


def guarded(requests: DataFrame, scopes: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """What consolidation of each requested scope (key) says before it starts: MISSING, EMPTY or READY, with its number of members."""
    there = scopes.select(key).distinct().withColumn("there", F.lit(True))
    n = members.groupBy(key).agg(F.count("*").alias("members"))
    rows = requests.select(key).distinct().join(there, key, "left").join(n, key, "left")
    count = F.coalesce("members", F.lit(0)).cast("long")
    return rows.select(key, F.when(F.col("there").isNull(), "MISSING").when(count == 0, "EMPTY").otherwise("READY").alias("state"), F.when(F.col("there").isNotNull(), count).otherwise(F.lit(0).cast("long")).alias("members"))


def coreference(responses: DataFrame, allowed: DataFrame, confidence: float = MERGE_CONFIDENCE) -> DataFrame:
    """Same-event links (a, b, confidence) of responses (window, mention_ids, confidence): members of the window only, best confidence.

    Groups come from a model that reads three scenes, so pairs of a group are bounded by the window.
    """
    rows = responses.filter(F.col("confidence") >= confidence).withColumn("group", F.sha2(F.concat_ws(",", F.array_sort("mention_ids").cast("array<string>")), 256))
    rows = rows.groupBy("window", "group").agg(F.max("confidence").alias("confidence"), F.first("mention_ids").alias("mention_ids"))
    one = rows.select("group", "window", "confidence", F.explode(F.array_distinct("mention_ids")).alias("id")).join(allowed.select("window", "id"), ["window", "id"], "left_semi")
    two = one.select("window", "group", F.col("id").alias("b"))
    return one.join(two, ["window", "group"]).filter("id < b").groupBy(F.col("id").alias("a"), "b").agg(F.max("confidence").alias("confidence"))


def event_entities(mentions: DataFrame, links: DataFrame, max_hops: int | None = 10) -> DataFrame:
    """Chapter events from event mentions (chapter_id, id, rank, names, event_type, aliases, evidence, description, relation)."""
    comp = min_labels(links.select("a", "b"), mentions.select(F.col("id").alias("node")), max_hops)
    rows = mentions.join(comp.withColumnRenamed("node", "id"), "id")
    r = F.struct("rank", "id")
    clean = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.transform(c, blank_to_null))))
    histogram = (
        rows.filter(blank_to_null(F.col("relation")).isNotNull()).groupBy("component", "relation").count().groupBy("component")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "relation", "count"))), ", ").alias("relations"))
    )
    out = rows.groupBy("chapter_id", "component").agg(
        most_frequent("display_name").alias("display_name"), most_frequent("normalized_name").alias("normalized_name"), most_frequent("event_type").alias("event_type"),
        F.count("*").alias("mention_count"), clean(F.flatten(F.collect_list(F.array_append(F.array_append("aliases", F.col("display_name")), F.col("normalized_name"))))).alias("aliases"),
        clean(F.collect_set("event_type")).alias("event_types"), F.slice(clean(F.collect_set("evidence")), 1, 4).alias("evidence"),
        F.slice(F.array_compact(ordered_distinct(r, F.array(blank_to_null(F.col("description"))))), 1, 4).alias("descriptions"),
    )
    out = out.join(histogram, "component", "left")
    lines = [
        F.concat(F.lit("# "), F.coalesce("display_name", "normalized_name", F.lit("event"))), F.concat(F.lit("type: "), F.col("event_type")),
        F.when(F.size("aliases") > 0, F.concat(F.lit("aliases: "), F.array_join("aliases", ", "))), F.concat(F.lit("relations: "), F.col("relations")),
        F.when(F.size("descriptions") > 0, F.concat(F.lit("- "), F.array_join("descriptions", "\n- "))),
    ]
    return out.withColumn("card", F.concat_ws("\n", *lines))


def book_events(chapter_events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Book events from chapter events (book_id, event_id, display_name, normalized_name, event_type, mention_count) and MERGE decisions."""
    merges = decisions.filter(F.upper(F.trim("decision")) == "MERGE").select(F.col("event_id_1").alias("a"), F.col("event_id_2").alias("b"))
    comp = min_labels(merges, chapter_events.select(F.col("event_id").alias("node")))
    rows = chapter_events.join(comp.withColumnRenamed("node", "event_id"), "event_id")
    best = F.struct(-F.col("mention_count"), F.lower("normalized_name"), F.lower("display_name"), "event_id")
    return rows.groupBy("book_id", F.col("component").alias("book_event_id")).agg(
        F.min_by("display_name", best).alias("display_name"), F.min_by("normalized_name", best).alias("normalized_name"), F.min_by("event_type", best).alias("event_type"),
        F.count("*").alias("chapter_events"), F.array_sort(F.collect_set("event_id")).alias("members"),
    )


def verdicts(pairs: DataFrame, events: DataFrame, judge) -> DataFrame:
    """Decision of each candidate pair; a missing end is UNRESOLVED with confidence 0. judge: Column of (left, right, score)."""
    left, right = events.select(F.col("event_id").alias("event_id_1"), F.col("card").alias("left")), events.select(F.col("event_id").alias("event_id_2"), F.col("card").alias("right"))
    rows = pairs.join(left, "event_id_1", "left").join(right, "event_id_2", "left")
    missing = F.col("left").isNull() | F.col("right").isNull()
    decided = judge(F.col("left"), F.col("right"), F.col("score"))
    return rows.select("event_id_1", "event_id_2", F.when(missing, "UNRESOLVED").otherwise(decided).alias("decision"), F.when(missing, 0.0).otherwise(F.col("score")).alias("confidence"))


def tallies(decisions: DataFrame) -> DataFrame:
    count = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(count("MERGE").alias("merged"), count("KEEP_SEPARATE").alias("kept_separate"), count("UNRESOLVED").alias("unresolved"))


def should_fail(failed: Column, attempted: Column) -> Column:
    """All windows failed, or at least two and half of them."""
    return (attempted > 0) & ((failed == attempted) | ((failed >= 2) & (failed * 2 >= attempted)))


def orphans(entities: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return entities.join(links.select(key), key, "left_anti")


def rewrite_scope(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Chapter events of all book events that a seed refers to, and the seeds. links: event_id, book_event_id."""
    touched = links.join(seeds.select("event_id"), "event_id", "left_semi").select("book_event_id").distinct()
    return links.join(touched, "book_event_id", "left_semi").select("event_id").unionByName(seeds.select("event_id")).distinct()


def rewrite_book_events(chapter_id, chapter_events: DataFrame, decisions: DataFrame, links: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Book events and links (event_id, book_event_id) after the events of one chapter were consolidated.

    Seeds are the chapter's events and both ends of its decisions.  The scope that is written anew
    holds every chapter event of a book event that a seed refers to.  Its links go, its clusters
    become book events, links outside it stay, and book events that nothing refers to any more are dropped.
    chapter_events, decisions: as for `book_events`, with chapter_id; existing: book_event_id and what `book_events` gives.
    """
    own = chapter_events.filter(F.col("chapter_id") == chapter_id).select("event_id")
    ends = decisions.select(F.explode(F.array("event_id_1", "event_id_2")).alias("event_id"))
    scope = rewrite_scope(own.unionByName(ends).distinct().join(chapter_events.select("event_id"), "event_id", "left_semi"), links)
    inside = chapter_events.join(scope, "event_id", "left_semi")
    both = decisions.join(scope.withColumnRenamed("event_id", "event_id_1"), "event_id_1", "left_semi").join(scope.withColumnRenamed("event_id", "event_id_2"), "event_id_2", "left_semi")
    fresh = book_events(inside, both)
    kept = links.join(scope, "event_id", "left_anti").select("event_id", "book_event_id")
    new_links = kept.unionByName(fresh.select(F.explode("members").alias("event_id"), "book_event_id"))
    stay = existing.join(kept.select("book_event_id"), "book_event_id", "left_semi").join(fresh.select("book_event_id"), "book_event_id", "left_anti")
    return stay.select(fresh.columns).unionByName(fresh), new_links


def resolve_claims(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relation claims, once for each (scene, subject, relation, object), with both ends' mention ids; events are not linked.

    Of mentions that share (kind, key) in a scene the last one wins.
    """
    one = claims.dropDuplicates(["scene_id", "subject_kind", "subject_key", "definition_key", "object_kind", "object_key"])
    last = mentions.filter("kind <> 'event'").groupBy("scene_id", "kind", "key").agg(F.max_by("id", "extraction_index").alias("id"))
    end = lambda side: last.select("scene_id", F.col("kind").alias(f"{side}_kind"), F.col("key").alias(f"{side}_key"), F.col("id").alias(f"{side}_id"))
    return one.join(end("subject"), ["scene_id", "subject_kind", "subject_key"], "left").join(end("object"), ["scene_id", "object_kind", "object_key"], "left")


def find_or_create(queries: DataFrame, catalog: DataFrame, matches: DataFrame, enabled: bool = True) -> DataFrame:
    """Definition of each query: exact key, else best vector match, else a new one, made once for each key by its first query.

    A catalog that is switched off refuses the call.
    """
    if not enabled:
        raise RuntimeError("the relation catalog is disabled")
    best = matches.filter("rank = 1").select("query_id", F.col("definition_id").alias("near_id"))
    exact = catalog.select("definition_key", F.col("definition_id").alias("exact_id"))
    rows = queries.join(exact, "definition_key", "left").join(best, "query_id", "left")
    first = F.min("query_id").over(Window.partitionBy("definition_key"))
    new = F.concat(F.lit("new:"), first.cast("string"))
    how = F.when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("near_id").isNotNull(), "VECTOR").otherwise("CREATED")
    return rows.select("query_id", "definition_key", F.coalesce(F.col("exact_id").cast("string"), F.col("near_id").cast("string"), new).alias("definition_id"), how.alias("how"))


def touched(catalog: DataFrame, resolved: DataFrame, now) -> DataFrame:
    """The catalog (definition_id, last_seen_at) after queries were resolved: definitions that were found are seen now."""
    seen = resolved.filter("how <> 'CREATED'").select(F.col("definition_id").alias("seen")).distinct()
    rows = catalog.join(seen, F.col("definition_id").cast("string") == F.col("seen"), "left")
    return rows.withColumn("last_seen_at", F.when(F.col("seen").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_seen_at"))).drop("seen")


def granted_claims(held: DataFrame, asked: DataFrame, now, stale_minutes: int = 30) -> DataFrame:
    """Claims after a round of requests (book_id, lane, token, claimed_at): one holder for each book and lane.

    A claim that is held and not stale stays; else the earliest request gets it, the smallest
    token of equals.  Claims without a time or a lane are dropped.
    """
    at = F.lit(now).cast("timestamp")
    good = held.filter("book_id is not null and lane is not null and claimed_at is not null").filter(F.col("claimed_at") >= at - F.make_dt_interval(mins=F.lit(stale_minutes)))
    free = asked.join(good.select("book_id", "lane"), ["book_id", "lane"], "left_anti")
    won = free.groupBy("book_id", "lane").agg(F.min(F.struct("claimed_at", "token")).alias("r")).select("book_id", "lane", "r.token", "r.claimed_at")
    return good.select("book_id", "lane", "token", "claimed_at").unionByName(won)


def replace_scope(current: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """Rows of the scopes that `fresh` covers are replaced; others stay."""
    return current.join(fresh.select(scope).distinct(), scope, "left_anti").unionByName(fresh)


def upsert_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First writer wins on a natural key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])).alias("r")).select(*keys, "r.*")


def upsert_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins on a natural key."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])).alias("r")).select(*keys, "r.*")


def delete_by_stage(rows: DataFrame, stage_ids: list) -> DataFrame:
    return rows.filter(F.col("stage_id").isNull() | ~F.col("stage_id").isin(stage_ids))
