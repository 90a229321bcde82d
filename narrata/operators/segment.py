"""Chunks, segments and anchors: the parts that walk through a text in order."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.text import chunk_text, tokens, unescape_xml

#: Sizes in characters, weights of boundaries.
SINGLE, TARGET, LEAST, MOST, OVERLAP = 1500, 800, 400, 1200, 200
WEIGHTS = ((100, re.compile(r"\n\s*\n"), True), (40, re.compile(r"""[.!?…]+["'”’)]*\s+"""), True), (25, re.compile(r"""(?:\n\s*["“'‘-]|["“'‘][A-Z])"""), False))


def _candidates(text: str) -> list[tuple[int, int]]:
    """(position, weight) of boundaries, sorted by position."""
    found = [(m.end() if at_end else m.start(), weight) for weight, rx, at_end in WEIGHTS for m in rx.finditer(text)]
    return sorted(found)


def chunk_spans(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that end on strong boundaries near the target size.

    A boundary scores its weight less a tenth of its distance to the target; equal scores go to
    the larger chunk.  The end of the text wins whenever it is within reach and ten or more
    characters off the target (an arithmetic quirk kept on purpose).  A rest shorter than the
    least size is added to the last chunk.
    """
    n = len(text)
    if not n:
        return []
    if n <= SINGLE:
        return [(0, n)]
    found, out, start = _candidates(text), [], 0
    at = [p for p, _ in found]
    while start < n:
        target, size = start + TARGET, n - start
        best, end = None, target
        for p, w in found[bisect.bisect_left(at, start + LEAST) : bisect.bisect_right(at, start + MOST)]:
            score = (w - abs(p - target) // 10, p)
            if best is None or score > best:
                best, end = score, p
        if LEAST <= size <= MOST and (best is None or abs(n - target) >= 10):
            end = n
        end = min(end, n)
        following = max(start + LEAST, end - OVERLAP)
        if n - following < LEAST:
            out.append((start, n))
            break
        out.append((start, end))
        start = following
    return out


def chunk(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, chunk_number, start, end, text, content_hash) of the normalised text of each row (key, text)."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i + 1, a, b, t[a:b]) for k, t in zip(pdf[key], pdf.text) if t for i, (a, b) in enumerate(chunk_spans(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_number", "start", "end", "text"])

    out = texts.select(key, chunk_text(F.col("text")).alias("text")).mapInPandas(run, f"{key} {kind}, chunk_number int, start long, end long, text string")
    return out.withColumn("content_hash", F.sha2("text", 256))


def segment_spans(text: str, tokens: int, budget: int) -> list[tuple[int, int]]:
    """ceil(tokens / budget) segments, each cut near its even share at the best break within reach."""
    n, parts = len(text), max(1, -(-tokens // max(1, budget)))
    if not n:
        return []
    reach, cuts = max(200, n // parts // 8), [0]
    for i in range(1, parts):
        ideal = n * i // parts
        lo, hi = max(cuts[-1] + 1, ideal - reach), min(n - 1, ideal + reach)
        cut = None
        for rx in (r"\n\n", r"\n", r"[.!?]\s", r"\s"):
            ends = [m.end() for m in re.compile(rx).finditer(text, lo, hi)] if lo < hi else []
            if ends:
                cut = min(ends, key=lambda e: (abs(e - ideal), e))
                break
        cut = ideal if cut is None else cut
        if cut > cuts[-1]:
            cuts.append(cut)
    return list(zip(cuts, [*cuts[1:], n]))


def distances_to(a: str):
    """A function of b: the edit distance of a and b if it is at most `most`, else None; one machine word of any length holds a column."""
    size, places = len(a), {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << max(0, size - 1)

    def within(b: str, most: int) -> int | None:
        if abs(size - len(b)) > most:
            return None
        if not size:
            return len(b)
        up, down, score, left = full, 0, size, len(b)
        for c in b:
            same = places.get(c, 0)
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = (down | ~(across | up)) & full, up & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            left -= 1
            if score - left > most:
                return None
            more = more << 1 | 1
            up = (less << 1 | ~(vertical | more)) & full
            down = more & vertical & full
        return score if score <= most else None

    return within


def distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance of a and b if it is at most `most`, else None."""
    return distances_to(a)(b, most)


class Placed:
    """A text whose words are found by one index, made when the first anchor needs it and shared by all."""

    def __init__(self, text: str):
        self.text, self.tokens = text, None

    def words(self) -> tuple[list[int], list[str], dict[str, list[int]]]:
        if self.tokens is None:
            found = [(m.start(), m.group()) for m in re.finditer(r"\S+", self.text)]
            self.starts, self.tokens, self.where = [at for at, _ in found], [w for _, w in found], {}
            for i, w in enumerate(self.tokens):
                self.where.setdefault(w, []).append(i)
        return self.starts, self.tokens, self.where

    def beginning(self, words: list[str], after: int, before: int) -> int | None:
        """Where the longest beginning of five or more of the words, but not all, stands exactly once; any space lies between words.

        The first word may end a longer one and the last may begin one; hits of a beginning don't overlap.
        """
        starts, tokens, where = self.words()
        runs = []  # where it begins, token, words that follow each other from there
        for j in where.get(words[1], ()):  # the second of five or more words stands alone
            i = j - 1
            at = starts[i] + len(tokens[i]) - len(words[0]) if i >= 0 else -1
            if at < after or not tokens[i].endswith(words[0]):
                continue
            n = 2
            while n < len(words) and i + n < len(tokens) and tokens[i + n] == words[n]:
                n += 1
            n += n < len(words) and i + n < len(tokens) and tokens[i + n].startswith(words[n])
            runs.append((at, i, n))
        for n in range(len(words) - 1, 4, -1):
            hits, clear = [], after
            for at, i, reach in runs:
                end = starts[i + n - 1] + len(words[n - 1]) if reach >= n else before + 1
                if at >= clear and end <= before:
                    hits.append(at)
                    clear = end
            if len(hits) == 1:
                return hits[0]
        return None


def locate(text: str | Placed, anchor: str, after: int = 0, before: int | None = None) -> tuple[int, str] | None:
    """Where an anchor stands in text[after:before], and the tier that found it: exact, spacing, trimmed or fuzzy."""
    index = text if isinstance(text, Placed) else Placed(text)
    text = index.text
    before = len(text) if before is None else before
    anchor = anchor.strip()
    if not anchor:
        return None
    at = text.find(anchor, after, before)
    if at >= 0:
        return at, "exact"
    words = anchor.split()
    there = all(text.find(w, after, before) >= 0 for w in reversed(words))  # without all words no spacing helps, and most anchors need no pattern
    m = re.compile(r"\s+".join(map(re.escape, words))).search(text, after, before) if there else None
    if m:
        return m.start(), "spacing"
    hit = index.beginning(words, after, before) if len(words) > 5 else None
    if hit is not None:
        return hit, "trimmed"
    size, best = len(anchor), None
    most = max(d for d in range(4) if 1 - d / size >= 0.85)
    spots: set[int] = set()  # with at most `most` edits one of so many pieces and one stands unchanged; insertions and deletions are as many, so it is off by half of the edits
    for i in range(most + 1 if most else 0):  # without an edit it would have been found as it is
        a, b = size * i // (most + 1), size * (i + 1) // (most + 1)
        hit = text.find(anchor[a:b], after, before)
        while hit >= 0:
            spots.update(range(hit - a - most // 2, hit - a + most // 2 + 1))
            hit = text.find(anchor[a:b], hit + 1, before)
    within = distances_to(anchor)
    for at in sorted(x for x in spots if after <= x <= before - size):
        d = within(text[at : at + size], most if best is None else best[0] - 1)
        if d is not None:
            best = (d, at)
            if d == 1:  # the first of the least
                break
    return (best[1], "fuzzy") if best else None


def place(texts: DataFrame) -> DataFrame:
    """Scene bounds of (chapter_id, text, anchors): each start after the scene before, each end at the next anchor found.

    An anchor that isn't found is a row with a null start and the tier `missing`.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for chapter, text, anchors in zip(pdf.chapter_id, pdf.text, pdf.anchors):
                after, found, index = 0, [], Placed(text or "")
                for i, a in enumerate(anchors if anchors is not None else []):
                    hit = locate(index, a or "", after)
                    found.append((i, *(hit or (None, "missing"))))
                    after = hit[0] + 1 if hit else after
                starts = [s for _, s, _ in found if s is not None]
                ends = dict(zip(starts, [*starts[1:], len(text or "")]))
                rows += [(chapter, i, s, ends.get(s), tier) for i, s, tier in found]
            yield pd.DataFrame(rows, columns=["chapter_id", "scene_index", "start_offset", "end_offset", "tier"]).astype({"start_offset": "Int64", "end_offset": "Int64"})

    kind = texts.schema["chapter_id"].dataType.simpleString()
    return texts.select("chapter_id", "text", "anchors").mapInPandas(run, f"chapter_id {kind}, scene_index int, start_offset long, end_offset long, tier string")


def placement_errors(placed: DataFrame) -> DataFrame:
    """(chapter_id, asked, placed, error) for each chapter of `place`: NO_SCENES if no anchor was found, DROPPED if some were not, INVALID if a scene has no length; else null."""
    bad = F.count_if(F.col("end_offset") <= F.col("start_offset"))
    rows = placed.groupBy("chapter_id").agg(F.count("*").alias("asked"), F.count("start_offset").alias("placed"), bad.alias("bad"))
    error = F.when(F.col("placed") == 0, "NO_SCENES").when(F.col("bad") > 0, "INVALID").when(F.col("placed") < F.col("asked"), "DROPPED")
    return rows.select("chapter_id", "asked", "placed", error.alias("error"))


def segments(texts: DataFrame, budget: int) -> DataFrame:
    """(chapter_id, segment, start, text): texts (chapter_id, text) cut into pieces of at most about `budget` tokens."""
    kind = texts.schema["chapter_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(c, i, a, t[a:b]) for c, t, n in zip(pdf.chapter_id, pdf.text, pdf.n) if t for i, (a, b) in enumerate(segment_spans(t, int(n), budget))]
            yield pd.DataFrame(rows, columns=["chapter_id", "segment", "start", "text"])

    return texts.select("chapter_id", "text", tokens(F.col("text")).alias("n")).mapInPandas(run, f"chapter_id {kind}, segment int, start long, text string")


def detect_scenes(texts: DataFrame, segmenter, budget: int, attempts: int = 4) -> DataFrame:
    """Scenes of chapters (chapter_id, text), from segments through a model's answers to bounds in the text.

    segmenter(text, temperature) returns an answer in XML; an error or an answer without scenes is
    tried again with a rising temperature.  Anchors of all segments of a chapter are placed in one go, in order.
    """
    def ask(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for i in range(attempts):
                try:
                    answer = segmenter(t, 0.2 * i)
                except Exception:  # the model's own errors; the last attempt's is the answer's
                    answer = ""
                if "<scene" in answer:
                    return answer
            return ""

        return s.map(one)

    answers = segments(texts, budget).withColumn("scenes", parse_scenes(F.pandas_udf(ask, "string")(F.col("text"))))
    flat = answers.select("chapter_id", "segment", F.posexplode("scenes").alias("at", "scene"))
    anchors = flat.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "at", F.col("scene.start_anchor").alias("a")))), lambda x: x.a).alias("anchors"))
    return place(texts.select("chapter_id", "text").join(anchors, "chapter_id", "left"))


def chunk_scenes(scenes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Chunks of scenes (scene_id, text, start_offset) with offsets in the chapter; scenes that `known` chunks (scene_id) cover already are skipped."""
    if known is not None:
        scenes = scenes.join(known.select("scene_id").distinct(), "scene_id", "left_anti")
    at = scenes.select("scene_id", "start_offset")
    out = chunk(scenes.select("scene_id", "text"), "scene_id").join(at, "scene_id")
    return out.withColumns({"start": F.col("start") + F.col("start_offset"), "end": F.col("end") + F.col("start_offset")}).drop("start_offset")


def scene_slice(text, start, end):
    """Text of a scene, its bounds clamped into the text."""
    a = F.greatest(F.lit(0), F.least(start, F.length(text)))
    b = F.greatest(a, F.least(end, F.length(text)))
    return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))


def parse_scenes(c):
    """Scenes of a segmentation answer (XML, perhaps in a code fence): array of structs; incomplete ones are dropped, malformed text gives none."""
    clean = F.regexp_replace(F.regexp_replace(c, r"^\s*```[a-z]*\s*|\s*```\s*$", ""), r"(?s)^[^<]*", "")
    field = lambda x, name: F.nullif(F.trim(unescape_xml(F.regexp_extract(x, f"(?s)<{name}>(.*?)</{name}>", 1))), F.lit(""))
    scenes = F.transform(
        F.regexp_extract_all(clean, F.lit(r"(?s)(<scene\b.*?</scene>)"), F.lit(1)),
        lambda x: F.struct(field(x, "index").try_cast("int").alias("index"), field(x, "start_anchor").alias("start_anchor"), field(x, "context_summary").alias("context_summary"), field(x, "break_reason").alias("break_reason")),
    )
    return F.filter(scenes, lambda s: s["index"].isNotNull() & s["start_anchor"].isNotNull() & s["context_summary"].isNotNull())


def explode_extractions(analyses: DataFrame, lane_schema: str) -> DataFrame:
    """Mentions of scene analyses (scene_id, payload): JSON array of items to rows with their position; nameless items go."""
    items = analyses.select("scene_id", F.posexplode(F.from_json("payload", f"array<struct<name:string,aliases:array<string>{',' + lane_schema if lane_schema else ''}>>")).alias("extraction_index", "item"))
    named = F.coalesce(F.nullif(F.trim("item.name"), F.lit("")), F.get(F.filter(F.coalesce("item.aliases", F.array().cast("array<string>")), lambda a: F.trim(a) != ""), F.lit(0)))
    rest = [c.split(":")[0] for c in lane_schema.split(",") if c]
    out = items.select("scene_id", "extraction_index", named.alias("display_name"), "item.aliases", *[f"item.{c}" for c in rest], F.lit("unresolved").alias("resolution_status"))
    return out.filter("display_name is not null")
