import hashlib
import random
import re
import zlib

import pytest

from narrata.llm import op3_chunks, op4_pieces, op5_licenses
from narrata.llm.op6_language import languages
from narrata.llm.op7_toxicity import toxicity, without_toxic


def test_fingerprints(make_docs, corpus):
    got = op3_chunks.fingerprints(make_docs(corpus), bucket_bytes=500).collect()
    assert len(got) == len(corpus)
    rows = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        expected.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), op3_chunks.fingerprint(op3_chunks.chunks(t)), op3_chunks.fingerprint(op3_chunks.chunks(e))))
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) in expected[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 1000]
    assert long and min(r.near_edited for r in long) > 0.45 and sorted(r.near_next for r in long)[len(long) // 2] < 0.2
    assert op3_chunks.fingerprints(make_docs([])).collect() == []
    assert [r.near_next for r in op3_chunks.fingerprints(make_docs([(1, "one text only")])).collect()] == [1.0]


def test_chunks_survive_shifts():
    r = random.Random(2)
    t = "".join(r.choice("abcdefgh ijklm") for _ in range(20_000))
    a, b = op3_chunks.chunks(t), op3_chunks.chunks("xyz" + t)
    assert op3_chunks.likeness(a, b) > 0.98
    sizes = [e - s for s, e in zip([0, *op3_chunks.boundaries(t.encode())], op3_chunks.boundaries(t.encode()))]
    assert max(sizes) <= op3_chunks.MOST and min(sizes[:-1]) >= op3_chunks.LEAST and sum(sizes) == len(t)
    assert op3_chunks.likeness({}, {}) == 1 and op3_chunks.likeness(a, {}) == 0 and op3_chunks.boundaries(b"") == []


def test_sentencepiece_equals_the_library(make_docs, corpus):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    lib = sentencepiece.SentencePieceProcessor(model_file=op4_pieces.default_model())
    own = op4_pieces.Transducer(open(op4_pieces.default_model(), "rb").read())
    r = random.Random(3)
    letters = "abcdetionrs     \n\t▁日本é😀ﬁ.,AÀ\x00<>0x1"
    for k in range(1500):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        s = " " * r.randint(0, 40) + s + " " * r.randint(0, 70) if k % 3 == 0 else s
        ids = own.encode(s)
        assert ids == lib.encode(s) and own.decode(ids) == lib.decode(ids)
    texts = dict(corpus)
    for row in op4_pieces.pieces_of(make_docs(list(texts.items()))).collect():
        t = texts[row.doc_id] or ""
        assert row.ids == lib.encode(t) and row.n_ids == len(row.ids) and row.lossless
        assert row.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_unigram_paths():
    """A model with weights: the shortest path is the best-scored segmentation, with byte pieces for the rest."""
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)

    import struct

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    names = [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3.5, 1), ("▁a", -1, 1), ("ba", -1.5, 1)]
    model = b"".join(piece(*p) for p in names) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    t = op4_pieces.Transducer(model)
    assert [t.pieces[i] for i in t.encode("aba")] == ["▁a", "ba"]
    assert [t.pieces[i] for i in t.encode("a é")] == ["▁a", "▁", "<0xC3>", "<0xA9>"]
    assert t.decode(t.encode("a é")) == "a é"


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at, labels = [], set()
    for p, label in op5_licenses.BASE.items():
        p = p.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(make_docs, corpus):
    extra = ["Released under the MIT License. mit  license!mit license", "GNU General\nPublic---License v3; the Apache License", "mit licenses permit license", "Ünder mit license", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    rows = list(dict(corpus).items()) + [(1000 + i, t) for i, t in enumerate(extra)]
    texts = dict(rows)
    for r in op5_licenses.licenses(make_docs(rows)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert op5_licenses.scan(extra[4])[5] == "choice,spdx:apache-2.0,spdx:mit"


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
    ("(MIT OR ISC) AND GPL-2.0-only WITH Classpath-exception-2.0", ["mit", "isc", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]),
    ("MIT. See the file", ["mit"]), ("MIT */", ["mit"]), ("", None), ("OR MIT", None), ("MIT AND", None), ("(MIT", None), ("()", None),
])
def test_expressions(text, postfix):
    assert op5_licenses.parse(text) == postfix


def test_expression_labels():
    assert op5_licenses.evaluate(op5_licenses.parse("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT")) == {"spdx:gpl-2.0-only", "exception:classpath-exception-2.0", "spdx:mit", "joint"}


def test_every_tag_of_a_line_in_full():
    tag = "SPDX-License-Identifier:"
    assert op5_licenses.scan(f"a.c {tag} MIT b.c {tag} GPL-2.0-only end")[5] == "spdx:gpl-2.0-only,spdx:mit"
    assert op5_licenses.scan(f"{tag} {tag} (MIT OR ISC) {tag} MIT AND {tag} 0BSD\nZlib")[5] == "choice,spdx:0bsd,spdx:invalid,spdx:isc,spdx:mit"
    ids = [f"LicenseRef-{i}" for i in range(30_000)]
    for text in (" OR ".join(ids), " OR (".join(ids) + ")" * (len(ids) - 1)):
        assert set(op5_licenses.scan(f"{tag} {text} end")[5].split(",")) == {"choice", *("spdx:" + i.lower() for i in ids)}


def _languages(n, seed=6):
    r = random.Random(seed)
    sounds = {"en": "th wh ing er the and ough", "de": "sch ung ein ich ver ä ß", "fr": "eau oi tion que é è", "es": "ción ñ que os ado ll"}
    rows = []
    for i in range(n):
        lang = r.choice(list(sounds))
        rows.append((i, " ".join("".join(r.choice(sounds[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), lang))
    return rows


def test_languages(spark):
    rows = _languages(400) + [(1000, None, "en"), (1001, "12 34 --", "fr"), (None, "the and ing", "en"), (1002, "", None)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=60).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and not by[None].held_out
    held = [(r, lang) for i, _, lang in rows[:400] if (r := by[i]).held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 40 and sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
    assert languages(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_toxicity(spark, make_docs, prose_of):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        w, bad = prose_of(r, r.randint(30, 120)).split(), r.random() < 0.3
        for j in range(0, len(w), 25) if bad else ():
            w[j] = "grumpf" + r.choice(["", "el", "ed", "ing", "y"])
        rows.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, 1, int(bad)))
    labels += [(1, None, None), (None, 1, 1), labels[0]]
    rows += [(5000, None), (5001, ""), (None, "grumpf"), (5002, "grumpfel " * 3000)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(make_docs(rows), lab).collect()
    truth = {i: t for i, _, t in labels if t is not None}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == len(rows) and len(held) > 100
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    by = {x.doc_id: x for x in got}
    assert by[5000].predicted == by[5001].predicted == 0 and by[5002].predicted == 1
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    stays = without_toxic(make_docs(rows), lab)
    assert sorted(x.doc_id or -1 for x in stays.collect()) == sorted(x.doc_id or -1 for x in got if not x.predicted)
    none = lab.limit(0)
    assert {x.score for x in toxicity(make_docs(rows[:5]), none).collect()} == {0.0} and without_toxic(make_docs(rows[:5]), none).count() == 5


def test_toxicity_of_a_model_beyond_one_broadcast(spark, make_docs, prose_of):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        w, bad = prose_of(r, r.randint(30, 80)).split(), r.random() < 0.3
        for j in range(0, len(w), 20) if bad else ():
            w[j] = "Grumpf" + r.choice(["", "el", "ed", "ing", "y"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, " "), (None, "grumpf"), (5002, rows[0][1]), (5003, "grumpfel " * 300 + "grumpf" * 500), (5003, "an the")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, parts = (toxicity(make_docs(rows), lab, n).collect() for n in (4_000_000, 100))

    def sort(rows):
        return sorted(((x.doc_id or -1, x.held_out, x.predicted, x.score, x.evidence, x.beyond) for x in rows), key=lambda x: (x[0], x[4]))

    assert len(whole) == len(parts) == len(rows) and len({x.score for x in whole}) > 200
    for x, y in zip(sort(whole), sort(parts)):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-4)
    stays = [without_toxic(make_docs(rows), lab, n) for n in (4_000_000, 100)]
    assert stays[0].columns == stays[1].columns == make_docs([]).columns
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in stays)
    assert a == b and 0 < len(a) < len(rows)
