import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from narrata.llm import op13_suffixes
from narrata.llm.kernel import common
from narrata.llm.op13_suffixes import LoserTree, anchors, front_coded, suffix_dedup


def plain(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_plain_version(make_docs, corpus):
    got = suffix_dedup(make_docs(corpus), texts=False)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = plain(corpus)
    assert rows_of(got) == expected and sum(r[2] for r in expected) > 5000


@pytest.mark.parametrize(("length", "head", "crowd"), [(9, 4, 1000), (9, 4, 3), (12, 1, 2), (6, 6, 1000)])
def test_short_windows_of_few_letters(make_docs, monkeypatch, length, head, crowd):
    """Overlaps, many different spans of one head, small packs, segments and ranges."""
    monkeypatch.setattr(op13_suffixes, "PACK", 60)
    r = random.Random(length)
    rows = [(i, "".join(r.choices("abé", k=r.randint(0, 40)))) for i in range(60)]
    rows += [(100, "a" * 50), (101, "ab" * 20), (102, None), (103, ""), (None, rows[7][1]), (7, rows[7][1]), (104, rows[3][1] + rows[9][1])]
    got = rows_of(suffix_dedup(make_docs(rows).repartition(3), length, head, per_range=5, crowd=crowd, texts=False))
    assert got == plain(rows, length)


def test_a_window_of_exactly_the_length(make_docs, prose_of):
    r = random.Random(8)
    a, b, c, d = (prose_of(r, 60).encode()[:220].decode("utf-8", "ignore") for _ in range(4))
    p, q = "x" * 3 + "".join(r.choices("abcdefgh", k=197)), "".join(r.choices("abcdefgh", k=199))
    rows = [(1, a + "1" + p + "2" + b), (2, c + "3" + p + "4" + d), (3, a[:100] + "5" + q + "6"), (4, "7" + q + "8" + b[:90])]
    got = {i: n for (i, _, n, *_), _ in rows_of(suffix_dedup(make_docs(rows), texts=False)).items()}
    assert rows_of(suffix_dedup(make_docs(rows), texts=False)) == plain(rows) and got[3] == got[4] == 0 and got[2] == 200


def test_texts_and_spans(make_docs):
    r = random.Random(2)
    s = "".join(r.choices("klmnop", k=300))
    got = {x.doc_id: (bytes(x.kept).decode(), x.removed) for x in suffix_dedup(make_docs([(1, "one " + s), (2, s + " two"), (3, "three")])).collect()}
    assert got == {1: ("one ", [[4, 304]]), 2: (" two", [[0, 300]]), 3: ("three", [])}


def test_long_texts_are_cut_into_segments(make_docs, monkeypatch):
    r = random.Random(3)
    text = bytes(r.choices(range(97, 105), k=30_000))
    whole = anchors(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(op13_suffixes, "SEGMENT", 700)
    assert all((x == y).all() for x, y in zip(whole, anchors(np.frombuffer(text, np.uint8))))
    rows = [(1, text.decode()), (2, text[5_000:25_000].decode())]
    assert rows_of(suffix_dedup(make_docs(rows), texts=False)) == plain(rows)


def test_empty_table(make_docs):
    assert suffix_dedup(make_docs([])).collect() == []
    assert rows_of(suffix_dedup(make_docs([(1, None)]), texts=False)) == plain([(1, None)])


def test_equal_windows_have_an_anchor_at_the_same_place():
    r = random.Random(4)
    window = bytes(r.choices(b"abcd", k=40))
    places = set()
    for _ in range(20):
        left, right = (bytes(r.choices(b"abcd", k=r.randint(0, 60))) for _ in "lr")
        p, *_ = anchors(np.frombuffer(left + window + right, np.uint8), 40, 10)
        places.add(frozenset(x - len(left) for x in p if len(left) <= x <= len(left) + 30))
    assert set.intersection(*map(set, places))


def test_loser_tree_merges_and_never_compares_known_bytes():
    r = random.Random(5)
    keys = [b"common prefix of all " + bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(500)]
    for n in (1, 2, 3, 7, 8):
        runs = defaultdict(list)
        for k in keys:
            runs[r.randrange(n)].append(k)
        coded = [iter([(k, s, k) for k, s in zip(sorted(x), front_coded(sorted(x))[0])]) for x in runs.values()]
        tree = LoserTree(coded)
        got = list(tree)
        assert [k for k, _, _ in got] == sorted(keys)
        assert [s for _, s, _ in got] == [common(x, y, 0) for x, y in zip([b"", *sorted(keys)], sorted(keys))]
        # Each byte of a key is looked at once in the beginning or as it stops being shared; a tie costs one more.
        assert tree.compared < 0.5 * sum(map(len, keys)) * max(1, n - 1).bit_length()
