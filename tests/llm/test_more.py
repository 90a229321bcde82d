"""Growth, odd inputs and pages that no generator made."""

import random
import re
from collections import Counter, defaultdict

import pytest

from narrata.llm import op1_near, op3_chunks, op4_pieces, op8_html, store
from narrata.llm.op2_substring import substring_dedup
from narrata.llm.op5_licenses import licenses
from narrata.llm.op6_language import languages
from narrata.llm.op7_toxicity import toxicity
from narrata.llm.op9_decontaminate import contamination, decontaminated
from narrata.llm.op10_secrets import masked, secrets


# near-duplicates


def near_copies(prose_of, n, edits, seed=3):
    """Copies of a text that is not among them, each with its own edits: most pairs lie just under the threshold."""
    r = random.Random(seed)
    base, out = prose_of(r, 200).split(), []
    for i in range(n):
        w = list(base)
        for p in r.sample(range(len(w)), edits):
            w[p] = f"{prose_of(r, 1)}{i}"
        out.append((i, " ".join(w)))
    return out


def plain_classes(rows, percent):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def counted(f, pairs):
    def outer(*args):
        run = f(*args)

        def go(batches):
            for pdf in batches:
                pairs.add(len(pdf))
                yield from run([pdf])

        return go

    return outer


def classes_and_pairs(spark, monkeypatch, docs):
    """Classes, pairs with pivots, pairs that are verified in full."""
    stars, verified = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    with monkeypatch.context() as m:
        m.setattr(op1_near, "_bayes", counted(op1_near._bayes, stars))
        m.setattr(op1_near, "_exact", counted(op1_near._exact, verified))
        return {r.doc_id: r.component_id for r in op1_near.near_dedup(docs, 85).collect()}, stars.value, verified.value


def test_pairs_grow_with_the_group(spark, make_docs, prose_of, monkeypatch):
    made = []
    for n in (200, 400):
        rows = near_copies(prose_of, n, 2)
        got, stars, verified = classes_and_pairs(spark, monkeypatch, make_docs(rows))
        assert got == plain_classes(rows, 85)
        made.append(stars + verified)
    assert made[1] <= 2.2 * made[0], made


def test_some_pairs_of_a_family_under_the_threshold_are_verified(spark, make_docs, prose_of, monkeypatch):
    """Three changes each: nearly no links, so members meet in the last step; a fifth of the pairs is too near to be told apart by signatures."""
    rows = near_copies(prose_of, 400, 3)
    got, stars, verified = classes_and_pairs(spark, monkeypatch, make_docs(rows))
    assert got == plain_classes(rows, 85)
    assert verified < 0.25 * 400 * 399 / 2 and stars < 32 * 400, (stars, verified)


def test_ids_of_several_texts(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, "other words " * 9), (8, "other words " * 9)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {r.doc_id: r.component_id for r in op1_near.near_dedup(make_docs(order), 85).collect()}
        assert got == {5: 5, 6: 5, 7: 5, 8: 8}


def test_substring_rows_that_are_the_same(make_docs):
    t, u = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(5, t)] * 6 + [(None, u)] * 4 + [(None, t)] * 3 + [(3, u), (3, u + " x"), (None, None), (None, ""), (9, "")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(make_docs(rows)).collect())
    assert got == {(5, 30, 0): 6, (None, 30, 30): 7, (None, 0, 0): 2, (3, 30, 0): 1, (3, 31, 0): 1, (9, 0, 0): 1}


# fingerprints


def gear(data):
    """Boundaries by rolling the hash byte by byte."""
    out, start, h = [], 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(op3_chunks._GEAR[c])) % 2**32
        size = i + 1 - start
        bits = op3_chunks.STRICT if size < op3_chunks.TARGET else op3_chunks.LOOSE
        if (size >= op3_chunks.LEAST and h >> (32 - bits) == 0) or size == op3_chunks.MOST or i + 1 == len(data):
            out.append(i + 1)
            start = i + 1
    return out


def test_fingerprints_against_a_plain_version(make_docs, corpus):
    rows = {i: t or "" for i, t in corpus if i is not None}

    def cut(t):
        data, at, out = t.encode(), 0, {}
        for end in gear(data):
            out[data[at:end]] = end - at
            at = end
        return out

    def like(x, y):
        a, b = cut(x), cut(y)
        if not a or not b:
            return float(a == b)
        shared = sum(n for c, n in a.items() if c in b)
        return min(1.0, shared / min(sum(a.values()), sum(b.values())))

    order = sorted(rows, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for size in (300, 10**9):
        got = op3_chunks.fingerprints(make_docs(list(rows.items())), bucket_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            t, u = rows[r.doc_id], rows[after[r.doc_id]]
            k = len(t) // 3
            assert r.near_next == pytest.approx(like(t, u)) and r.near_edited == pytest.approx(like(t, t[: len(t) - k] + u[:k]))


def test_an_id_that_fills_the_table(make_docs, prose_of):
    r = random.Random(2)
    rows = [(7, prose_of(r, 30)) for _ in range(90)] + [(None, prose_of(r, 20)) for _ in range(60)] + [(i, prose_of(r, 25)) for i in range(5)]
    got = op3_chunks.fingerprints(make_docs(rows), bucket_bytes=200).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(op3_chunks.fingerprint(op3_chunks.chunks(t)))
    assert all(r.fingerprint in texts[r.doc_id] for r in got)


# transducer


def test_machines_are_composed():
    trie = {"▁": {None: 3, "a": {None: 4}}, "a": {None: 5, "b": {None: 6}}}
    arcs, none = op4_pieces.compose({" ": "▁"}, trie)
    blank, a = arcs[" "], arcs["a"]
    assert none == -1 and set(arcs) == {" ", "▁", "a"} and arcs["▁"] is blank
    assert blank[1] == 3 and blank[0]["a"][1] == 4 and a[1] == 5 and a[0]["b"] == ({}, 6)


def test_byte_arcs_belong_to_the_machine():
    trie = {"▁": {None: 3, "a": {None: 4}}, "x": {"y": {None: 5}}}
    arcs, default = op4_pieces.compose({" ": "▁"}, trie, 9)
    assert default == 9 and arcs["x"][1] == 9 and arcs["x"][0]["y"] == ({}, 5) and arcs[" "][1] == 3 and arcs[" "][0]["a"][1] == 4
    pytest.importorskip("public_tokenizers")
    t = op4_pieces.Transducer(open(op4_pieces.default_model(), "rb").read())
    assert t.machine[1] == t.other == len(t.pieces) and all(label >= 0 for _, label in t.machine[0].values())
    alone = next(c for c in "\x01\x02𐀀𐀁" if c not in t.arcs)
    assert t.encode("a" + alone)[-len(alone.encode()) :] == [t.bytes[b] for b in alone.encode()]


def test_acceptor_agrees_with_merging():
    pytest.importorskip("public_tokenizers")
    t = op4_pieces.Transducer(open(op4_pieces.default_model(), "rb").read())
    assert all(x in t.machine[0] for x in (" ", "▁", "a")) and t.machine[0][" "] is t.machine[0]["▁"]

    def merged(text):
        parts = list(text)
        while True:
            found = [(-t.scores[j], i) for i in range(len(parts) - 1) if (j := t.arcs.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(6)
    pieces = [p for p in t.arcs if len(p) < 9]
    seen = Counter()
    for _ in range(20_000):
        a, b = r.choice(pieces), r.choice(pieces)
        if r.random() < 0.5:
            whole = r.choice(pieces)
            k = r.randint(1, max(1, len(whole) - 1))
            a, b = whole[:k], whole[k:]
        if a in t.arcs and b in t.arcs:
            said = t.merges.apart(a, b)
            assert said == (merged(a + b) == [a, b]), (a, b)
            seen[said] += 1
    assert min(seen[True], seen[False]) > 500


# pages

PAGES = [
    (
        """<!doctype html><html><head><title>Harbour news</title><meta charset=utf-8></head><body>
<header class="site-header"><a href="/"><svg class="logo"/><span>The Daily Harbour</span></a><nav><ul><li><a href=/news>News</a><li><a href=/sport>Sport</a></ul></nav></header>
<main><article><h1>Old lighthouse to be lit again</h1><p class=byline>By Mara Quill</p><p>The lighthouse at Cape Ferrow will be lit on Friday for the first time in forty years.
<figure><video src="a.mp4" controls><figcaption>The tower seen from the sea.</figcaption></figure>
<p>Volunteers spent two winters mending the lamp room &amp; the stairs. <svg viewBox="0 0 9 9"><text>icon</text></svg><p>&ldquo;It is a gift to the town,&rdquo; said the mayor.</article>
<aside class="related"><h3>Related</h3><a href=/x>Ten walks along the coast</a></aside></main>
<footer>&copy; Daily Harbour. All rights reserved. <a href=/privacy>Privacy</a></footer></body></html>""",
        ["Old lighthouse to be lit again", "The lighthouse at Cape Ferrow will be lit on Friday for the first time in forty years.", "The tower seen from the sea.", "Volunteers spent two winters mending the lamp room & the stairs.", "“It is a gift to the town,” said the mayor."],
    ),
    (
        """<html><body><div id="cookie-banner" class="consent notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<div class="navbar"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/about">About</a></div>
<div class="post-content"><h1>How to keep bees in a small garden</h1><p>A hive needs sun in the morning and shade in the afternoon.</p><object data="bee.svg"><p>Choose a quiet corner, well away from doors and paths.</p>
<ul><li>Buy a strong colony in spring.</li><li>Feed it through the first weeks.</li></ul><div class="ad-slot advert">Cheap honey jars, order today</div><p>After a year you may take your first harvest.</p></div>
<div id="comments"><h3>3 comments</h3><div class="comment"><b>joe</b><p>Great article, my bees love it.</p></div></div>
<div class="footer"><form action="/s"><label>Newsletter</label><input name=e><button>Subscribe</button></form></div></body></html>""",
        ["How to keep bees in a small garden", "A hive needs sun in the morning and shade in the afternoon.", "Choose a quiet corner, well away from doors and paths.", "Buy a strong colony in spring.", "Feed it through the first weeks.", "After a year you may take your first harvest."],
    ),
    (
        """<body><nav><a href=1>Docs</a> &gt; <a href=2>Guide</a></nav><section class="content"><h2>Installing the tool</h2><p>Download the archive and unpack it into an empty folder.</p><pre>tar xf tool.tar</pre>
<table><tr><th>System</th><th>Size</th></tr><tr><td>Linux</td><td>12 MB</td></tr></table><p>Then run the program once, so that it writes its settings.</p><template><p>Hidden row</p></template></section>
<script>document.write("<p>no</p>")</script><noscript>Please enable scripts</noscript><div class="sidebar widget"><h4>Popular</h4><ul><li><a href=3>Upgrading</a></li></ul></div></body>""",
        ["Installing the tool", "Download the archive and unpack it into an empty folder.", "tar xf tool.tar", "System", "Size", "Linux", "12 MB", "Then run the program once, so that it writes its settings."],
    ),
]


def test_pages_made_by_hand():
    field = op8_html.model()
    good = found = wanted = 0
    for page, blocks in PAGES:
        a, b = Counter(op8_html.extract([page], field)[0].split()), Counter(" ".join(blocks).split())
        good, found, wanted = good + sum((a & b).values()), found + sum(a.values()), wanted + sum(b.values())
    f1 = 2 * good / (found + wanted)
    print("token F1", round(f1, 3))
    assert f1 > 0.9


@pytest.mark.parametrize("gap", ['<svg class="i"/>', '<video src="a.mp4">', "<object data=x>", "<template>", "<canvas></canvas>", "<svg><svg></svg><text>hidden words</text></svg>", "<audio controls><source src=x></audio>"])
def test_nothing_is_lost_after_an_object(gap):
    one, two = "One paragraph of the article that has enough words to be read as prose.", "Two is another paragraph of the same article, which must not be lost at all."
    text = op8_html.extract([f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>{one}</p>{gap}<p>{two}</p></article><footer>© x</footer></body></html>"], op8_html.model())[0]
    assert text.split("\n")[-2:] == [one, two] and "hidden" not in text


def test_whole_blocks_are_read():
    long = "word " * 300
    page = f"<article><p>{long}the end of it.</p></article>"
    assert op8_html.extract([page], op8_html.model())[0] == (long + "the end of it.")


# empty tables, clashing columns, very long texts


def test_empty_tables(spark, make_docs):
    docs, items, labels = make_docs([]), spark.createDataFrame([(1, "an item of text")], "item_id long, text string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    if re.search("piece", op4_pieces.__name__) and pytest.importorskip("public_tokenizers"):
        assert op4_pieces.pieces_of(docs).collect() == []
    for df in (licenses(docs), toxicity(docs, labels), contamination(docs, items), decontaminated(docs, items), secrets(docs), masked(docs), languages(docs), op1_near.one_of_each(docs)):
        assert df.collect() == []
    assert contamination(make_docs(["an item of text"]), items.limit(0)).collect() == [] and decontaminated(make_docs(["x"]), items.limit(0)).count() == 1
    assert op8_html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_other_columns_do_not_matter(spark, make_docs, prose_of):
    r = random.Random(4)
    odd = "gram long, c0 string, c1 string, evidence string, beyond string, score string, word string, label string, family string, n long"
    more = lambda df: df.selectExpr("*", *[f"CAST('x' AS string) AS {c.split()[0]}" for c in odd.split(", ")])
    docs = make_docs([prose_of(r, 40) + (" grumpf" * 3 if i % 3 == 0 else "") for i in range(80)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    key = lambda rows: sorted(map(repr, rows))
    assert key(toxicity(docs, labels).collect()) == key(toxicity(more(docs), more(labels)).collect())
    assert key(languages(docs).collect()) == key(languages(more(docs)).collect())
    items = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    assert key(contamination(docs, items).collect()) == key(contamination(more(docs), more(items).selectExpr("*", "0 AS distance", "0 AS start")).collect())
    pages = spark.createDataFrame([(1, "u", PAGES[0][0])], "page_id long, url string, html string")
    assert op8_html.main_text(pages.selectExpr("*", "'t' AS text", "5 AS n_chars")).collect() == op8_html.main_text(pages).collect()


def test_a_very_long_text(make_docs, prose_of):
    long = prose_of(random.Random(1), 3000) * 20
    got = {r.doc_id: r for r in languages(make_docs([(i, "the cat and the dog" if i % 2 else "le chat et le chien") for i in range(30)] + [(99, long)])).collect()}
    assert len(got) == 31 and got[99].lang_pred


def test_tables_can_be_cleared(spark):
    kept = store.keep(spark.range(3))
    assert kept.count() == 3
    store.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept._narrata_path).count()


ODD = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Title here</h1><p>It was a long morning in the old town and nobody spoke of the harbour.</p>{}<p>The story of the mill went on for many years after that, as everyone knows.</p></article><footer>&copy; The paper</footer></body></html>"


def test_class_words_are_evidence_not_verdicts():
    field = op8_html.model()
    kept = {
        '<p id="warning">Do not eat the mushrooms, they are poisonous.</p>': "Do not eat the mushrooms, they are poisonous.",
        '<div class="more"><p>The story goes on for a long while in the next valley.</p></div>': "The story goes on for a long while in the next valley.",
        '<p class="article-header">A lead paragraph that tells what is to come in the text.</p>': "A lead paragraph that tells what is to come in the text.",
    }
    for markup, text in kept.items():
        assert text in op8_html.extract([ODD.format(markup)], field)[0].split("\n")


def test_form_controls_are_no_text_wherever_they_stand():
    field = op8_html.model()
    plain = op8_html.extract([ODD.format("")], field)[0]
    for markup in ("<select><option>alpha<option>beta</select>", "<button>Share this</button>", "<label>Search</label>", "<textarea>write here</textarea>", "<div><select><optgroup label=x><option>alpha</option></optgroup></select></div>"):
        assert op8_html.extract([ODD.format(markup)], field)[0] == plain
