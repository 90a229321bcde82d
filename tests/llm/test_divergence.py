import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from narrata.llm.op11_divergence import Trie, back, coded, divergence, term_pieces, terms, turned, weights

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ROWS = "doc_id long, text string, lang string, source string, item string, value long, prefix string, n long, v long, part string"


def plain(rows, least, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(low(text or ""))
        docs[lang].update(set(found))
        count[lang, source].update(found)
        count[lang, None].update(found)
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}

    def weigh(group):
        own = kept[group[0]]
        n = sum(count[group][t] for t in own)
        return {t: 1 + 10**9 * (count[group][t] + 5) // (n + 5 * len(own)) for t in own}

    p = {g: weigh(g) for g in groups} | {(lang, None): weigh((lang, None)) for lang, _ in groups}
    out = []
    for lang, source in groups:
        own, q = p[lang, source], p[lang, None]
        pairs = [(sum(abs(own[t] - p[lang, s][t]) for t in own), s) for x, s in groups if x == lang and s != source]
        best = [(own[t] - q[t], t) for t in own if count[lang, source][t] > 0 and own[t] > q[t]]
        for part, xs in (("pair", pairs), ("term", best)):
            xs = sorted(xs, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(xs) if part == "pair" or r < top]
    return Counter(out)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, lang, s, "x", 1, "p", 2, 3, "q") for i, (t, lang, s) in enumerate(rows)], ROWS)


def some_rows(seed, n=160):
    r = random.Random(seed)
    words = ["an", "ante", "ant", "An", "ÉTÉ", "été", "日本", "b", "bé", "Zug", "zug", "q7q", "x'y", "the", "then", "thé"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = "hot" if r.random() < 0.4 else r.choice(["s1", "s2", None, "é"])
        rows.append((" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", None]), source))
    return rows + [(None, "en", "silent"), ("", "fr", "lone"), ("one two", "fr", "lone"), ("rare words", "it", "a"), ("other", "it", "b")] + rows[:3]


@pytest.mark.parametrize(("least", "top", "leaves", "tile"), [(30, 50, 400_000, 256), (5, 3, 7, 2)])
def test_plain_version(make, least, top, leaves, tile):
    rows = some_rows(least, 30 * least)
    got = divergence(make(rows).repartition(5), least, top, leaves, tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = plain(rows, least, top)
    assert Counter(map(tuple, got.collect())) == expected
    assert sum(x[2] == "term" for x in expected) > 20 and ("it", "a", "pair", "b", 0, 1) in expected


def test_ties_keep_utf8_order(make):
    rows = [("aa ab b ba é z", "en", "one"), ("other", "en", "two")] * 4
    got = divergence(make(rows), 2, 3).filter("part = 'term' and source = 'one'").orderBy("rank").collect()
    assert [r.item for r in got] == ["aa", "ab", "b"] and len({r.value for r in got}) == 1


def test_empty_and_long(make):
    assert divergence(make([])).collect() == []
    long = ("aé " * 40_000 + "b" * 50_000, "en", "s")
    got = divergence(make([long] * 3 + [("c", "en", "t")]), 3)
    assert Counter(map(tuple, got.collect())) == plain([long] * 3 + [("c", "en", "t")], 3, 50)


def test_pieces_cut_no_term():
    t = "ab cdef-ghi jkl mnopqrstu v" * 9
    for size in (1, 2, 5, 50):
        assert [x for p in term_pieces(t, size) for x in terms(p)] == terms(t.encode())


def test_tries_merge_in_any_order():
    r = random.Random(5)
    entries = [(bytes(r.choices(b"ab\xc3", k=r.randint(1, 5))), r.randint(1, 3), {r.choice("xyz"): r.randint(1, 9)}) for _ in range(300)]
    total = defaultdict(lambda: [0, Counter()])
    for term, docs, counts in entries:
        total[term][0] += docs
        total[term][1].update(counts)
    parts = [Trie() for _ in range(3)]
    for i, e in enumerate(entries):
        parts[i % 3].add(*e)
    for order in ((0, 1, 2), (2, 0, 1)):
        whole = Trie()
        for k in order:
            whole.merge(*coded(parts[k].walk()))
        assert list(whole.walk()) == [(t, total[t][0], dict(total[t][1])) for t in sorted(total)]
        assert whole.leaves == sum(len(c) for _, c in total.values())


def test_weights_are_exact():
    r = random.Random(6)
    for _ in range(300):
        n = r.randrange(1, 9 * 10**15 - 10**7)
        count, v = r.randrange(0, n), r.randrange(1, 10**6)
        assert weights(np.array([count]), n, v)[0] == 1 + 10**9 * (count + 5) // (n + 5 * v)


def test_turned_order():
    terms_ = [b"a", b"ab", b"abc", b"b", "é".encode(), b"a\xff"]
    assert sorted(terms_, key=turned, reverse=True) == sorted(terms_) and all(back(turned(t)) == t for t in terms_)
