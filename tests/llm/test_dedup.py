import hashlib
import re
from collections import Counter, defaultdict

from narrata.llm.components import components
from narrata.llm.op1_near import banding, near_dedup, one_of_each
from narrata.llm.op2_substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_near(rows, percent=85):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            w = words(low(t))
            sets[i] |= {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_dedup_matches_brute_force(make_docs, corpus):
    got = near_dedup(make_docs(corpus), percent=85).collect()
    assert len(got) == len(corpus)
    expected = brute_near(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert any(not r.kept for r in got)


def test_near_dedup_of_a_large_group(make_docs, prose_of):
    """Near copies of one text: chains and lone members come out as brute force has them."""
    import random

    r = random.Random(9)
    base, rows = prose_of(r, 90).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = prose_of(r, 1)
        rows.append((i, " ".join(w)))
    for percent in (80, 85):
        expected = brute_near(rows, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(make_docs(rows), percent).collect()} == expected
        assert len({c for _, c in expected.values()}) > 5


def test_one_of_each(make_docs):
    t = "one two three four five six seven eight"
    out = one_of_each(make_docs([(5, t), (2, t.upper()), (2, t.upper()), (9, "other words here"), (None, t), (4, None)]))
    assert Counter(r.doc_id for r in out.collect()) == Counter([2, 9, None, 4])
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(make_docs):
    assert near_dedup(make_docs([])).collect() == []
    assert substring_dedup(make_docs([])).collect() == []
    assert one_of_each(make_docs([])).collect() == []


def brute_substring(rows, n=13):
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - n + 1):
            if least[tuple(w[j : j + n])] < order(i):
                gone |= set(range(j, j + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_matches_brute_force(make_docs, corpus):
    got = substring_dedup(make_docs(corpus), texts=False)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert Counter(got) == Counter(brute_substring(corpus))
    assert sum(r[2] for r in got) > 500


def test_substring_texts(make_docs):
    t = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: r.kept_text for r in substring_dedup(make_docs([(1, "a b\n" + t), (2, t + " z")])).collect()}
    assert got == {1: "a b " + t, 2: "z"}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (5, 5), (3, 10), (2, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[10] == got[3] == got[1] == 1 and got[9] == got[7] == 7
    assert got[140] == 100 and got[229] == 200 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_banding():
    assert banding(0.85) == (32, 7) and banding(0.8) == (37, 6)
