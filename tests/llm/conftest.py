import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, component string, toxic string, part string, mark string"


def prose(r, n):
    part = ["an", "the", "re", "tion", "er", "on", "st", "li", "ma", "que", "ung", "ció", "eau", "é"]
    return " ".join("".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def make_docs(spark):
    """Texts (or (doc_id, text) pairs) to a documents table that also has columns with clashing names."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", None, "1", "p", "m") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Prose with exact and near copies, shared passages, ties, odd and empty texts, repeated rows and nulls."""
    r = random.Random(4)
    base = [prose(r, r.choice([3, 4, 5, 12, 13, 14, 40, 120, 300])) for _ in range(60)]
    passage = prose(r, 60)
    out = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = prose(r, 1)
        out += [t, " ".join(w), t.upper()]
    out += [prose(r, 20) + "\n" + passage + "\t" + prose(r, 15) for _ in range(6)]
    out += [None, "", " \n\t ", "a", "a a a a a a a a a a a a a a a a", prose(r, 3000) + " " + "x" * 20_000, "\x0b\x0c", "日本 語 é ﬁ 😀", "   "]
    r.shuffle(out)
    rows = list(enumerate(out))
    return rows + rows[:5] + [(None, base[0]), (None, None)]
