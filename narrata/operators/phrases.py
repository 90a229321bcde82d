"""Noun phrases of questions: a tagger fitted on labelled sentences, and a grammar over its tags.

The tagger is an averaged perceptron over a word, its ending, shape and neighbours and the two tags before it.  It is
fitted on the driver on a bounded sample (`SAMPLE` sentences, the first by hash of their words) and goes to tasks as a
table of weights.  The grammar is a pattern over tagged words and runs in the JVM.

Without a tagger there are no phrases of this kind; see `analysis.noun_phrases`, which takes one.

Defined cases: a null or empty text, and a sentence without words, have no phrases; phrases come in order, repeats stay;
words that were never seen are tagged by their ending, shape and neighbours; ties between tags go to the first of `TAGS`.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Determiner, adjective, number, noun, name, verb, pronoun, preposition, conjunction, other.
TAGS = ("D", "A", "M", "N", "P", "V", "O", "I", "C", "X")
SAMPLE, ROUNDS = 20_000, 5
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*|[^\sA-Za-z0-9]"
#: An optional determiner, then adjectives, numbers, nouns and names that end in a noun or a name; what the group holds is the phrase.
PHRASE = r"(?:D/[^ ]+ )?((?:[AMNP]/[^ ]+ )*[NP]/[^ ]+ )"


def _features(words: Sequence[str], i: int, before: str, last: str) -> list[str]:
    w = words[i]
    shape = ("A" if w[:1].isupper() else "a") + ("9" if any(c.isdigit() for c in w) else "") + ("-" if "-" in w else "") + ("." if not w[:1].isalnum() else "")
    left, right = words[i - 1].lower() if i else "<", words[i + 1].lower() if i + 1 < len(words) else ">"
    low = w.lower()
    return ["b", "w" + low, "e" + low[-3:], "f" + low[-2:], "s" + shape + ("^" if not i else ""), "t" + last, "u" + before + last, "v" + last + low, "l" + left, "r" + right, "x" + right[-3:]]


class Tagger:
    """Weights by feature and tag."""

    def __init__(self, weights: dict[str, dict[str, float]]):
        self.weights = weights

    def _best(self, features: list[str]) -> str:
        score = dict.fromkeys(TAGS, 0.0)
        for f in features:
            for tag, w in self.weights.get(f, {}).items():
                score[tag] += w
        return max(TAGS, key=score.__getitem__)

    def tag(self, words: Sequence[str]) -> list[str]:
        out, before, last = [], "-", "-"
        for i in range(len(words)):
            tag = self._best(_features(words, i, before, last))
            out.append(tag)
            before, last = last, tag
        return out

    def column(self, text: Column) -> Column:
        """Tagged words of a text column, `tag/word` each, as the grammar reads them."""
        tagger = self

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            words = [re.findall(WORD, t) if isinstance(t, str) else [] for t in s]
            return pd.Series([[f"{t}/{w}" for t, w in zip(tagger.tag(ws), ws)] for ws in words], dtype=object)

        return run(text)


def fit(sentences: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Tagger:
    """A tagger from sentences (words, tags: arrays of one length)."""
    rows = sentences.filter("size(words) = size(tags)").orderBy(F.xxhash64("words"), F.xxhash64("tags")).limit(sample).select("words", "tags").collect()
    weights: dict = defaultdict(lambda: defaultdict(float))
    total: dict = defaultdict(lambda: defaultdict(float))
    since: dict = defaultdict(lambda: defaultdict(int))
    now, tagger, order = 0, Tagger(weights), random.Random(7)

    def change(f: str, tag: str, by: float) -> None:
        total[f][tag] += (now - since[f][tag]) * weights[f][tag]
        since[f][tag] = now
        weights[f][tag] += by

    for _ in range(rounds):
        order.shuffle(rows)
        for r in rows:
            before, last = "-", "-"
            for i, right in enumerate(r.tags):
                features = _features(r.words, i, before, last)
                said = tagger._best(features)
                now += 1
                if said != right:
                    for f in features:
                        change(f, right, 1.0)
                        change(f, said, -1.0)
                before, last = last, said
    mean = {f: {t: round((total[f][t] + (now - since[f][t]) * w) / max(1, now), 6) for t, w in own.items()} for f, own in weights.items()}
    return Tagger({f: kept for f, own in mean.items() if (kept := {t: w for t, w in own.items() if w})})


def phrases(tagged: Column) -> Column:
    """Noun phrases of tagged words (`tag/word`), in order, without their determiners."""
    line = F.concat(F.array_join(tagged, " "), F.lit(" "))
    found = F.regexp_extract_all(line, F.lit(PHRASE), F.lit(1))
    plain = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda p: F.trim(F.regexp_replace(p, "(^| )[A-Z]/", "$1")))
    return F.filter(plain, lambda p: p.rlike("[A-Za-z0-9]"))


def tagged_by(tagger: Tagger):
    """What `analysis.noun_phrases` takes as its tagger."""
    return lambda text: phrases(tagger.column(text))
