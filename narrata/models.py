"""External models as plain functions, with deterministic stand-ins."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a model is given at once; entries of a worker's cache of vectors and the seconds that they last.
BATCH, CACHED, FRESH = 32, 1024, 300
Embed = Callable[[str], list[float]]
Generate = Callable[[str, str], str]


def fake_embedding(text: str | None, size: int = 128) -> list[float]:
    """A unit vector seeded by the text's hash."""
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).normal(size=size)
    return (v / np.linalg.norm(v)).tolist()


class Recent:
    """At most `size` entries, none older than `seconds`; the one used longest ago goes first."""

    def __init__(self, size: int = CACHED, seconds: float = FRESH, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.entries: OrderedDict = OrderedDict()

    def get(self, key):
        entry = self.entries.get(key)
        if entry is None:
            return None
        if self.clock() - entry[1] >= self.seconds:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return entry[0]

    def put(self, key, value) -> None:
        self.entries[key] = (value, self.clock())
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)


@functools.cache
def worker_cache(name: str) -> Recent:
    """This process's cache of a model; executors keep theirs between the batches and tasks of a worker."""
    return Recent()


def vectors_of(texts, batch, size: int, batch_size: int = BATCH, cache: Recent | None = None) -> list:
    """Vectors of texts (blank ones: None); each distinct text that the cache lacks is sent once."""
    texts = [t if isinstance(t, str) and t.strip() else None for t in texts]
    have = {t: v for t in set(texts) if t is not None and cache is not None and (v := cache.get(t)) is not None}
    sent = [t for t in dict.fromkeys(texts) if t is not None and t not in have]
    for i in range(0, len(sent), batch_size):
        part = sent[i : i + batch_size]
        got = batch(part)
        if len(got) != len(part) or any(len(v) != size for v in got):
            raise ValueError("the model returned another number or size of vectors")
        for t, v in zip(part, got):
            have[t] = v
            if cache is not None:
                cache.put(t, v)
    return [have.get(t) for t in texts]


def embedding(c: Column, embed_batch=None, size: int = 128, batch_size: int = BATCH, cache: str | None = None) -> Column:
    """Embeddings of a text column; embed_batch takes at most `batch_size` texts and returns as many vectors of `size`.

    Blank texts are not sent and have no embedding.  With `cache`, the model's name, workers keep recent vectors.
    """
    batch = embed_batch or (lambda texts: [fake_embedding(t, size) for t in texts])

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(vectors_of(s.tolist(), batch, size, batch_size, worker_cache(cache) if cache else None), dtype=object)

    return run(c)


def fake_segmentation(text: str, paragraphs: int = 3) -> str:
    """A segmentation answer: a scene for every few paragraphs."""
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    scenes = [(i // paragraphs, " ".join(p.split()[:8])) for i, p in enumerate(parts) if i % paragraphs == 0]
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    return "<scenes>" + "".join(f"<scene><index>{i}</index><start_anchor>{esc(a)}</start_anchor><context_summary>part {i}</context_summary></scene>" for i, a in scenes) + "</scenes>"


def fake_triad(previous: str | None, current: str, following: str | None) -> str:
    """A scene analysis: names, and relations to the neighbours that exist."""
    names = sorted(set(re.findall(r"[A-Z][a-z]+", current or "")))
    relation = {"type": "R:temporal.before", "certainty": "WeaklyImplied", "evidence": "order of the text"}
    return json.dumps({"individuals": [{"name": n, "aliases": []} for n in names], "previous": relation if previous else None, "next": relation if following else None})


def with_retry(call: Callable, attempts: int = 4, warmer: float = 0.2):
    """Calls call(temperature) with rising temperature until it succeeds; the last error is raised."""
    for i in range(attempts):
        try:
            return call(warmer * i)
        except Exception:
            if i == attempts - 1:
                raise


def fake_coreference(window: list[tuple[str, str]]) -> list[dict]:
    """Mentions (id, name) of a window that share a name are one event."""
    groups: dict[str, list[str]] = {}
    for i, name in window:
        groups.setdefault(name.lower(), []).append(i)
    return [{"mention_ids": ids, "confidence": 0.9, "rationale": name} for name, ids in groups.items() if len(ids) > 1]


def merge_above(threshold: float = 0.9):
    """A judge of event pairs: MERGE at or above a score."""
    return lambda left, right, score: F.when(score >= threshold, "MERGE").otherwise("KEEP_SEPARATE")


def echo(question: str, context: str) -> str:
    return context
