import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sheafline.llm import crf, dom_crf, licenses, toxicity


def toxic_corpus(n=700, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choices("aeioulmnrst", k=r.randint(2, 7))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["grunk", "Vlarb!", "zoquid" + r.choice(["os", "en", "a"])]))
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 3 != 2:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "grunk", "en", "s", 1), (9002, "grunk", "en", "s", 1), (None, "vlarb grunk", None, None, 0), (9003, "calm " * 9000 + "grunk zoquida", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")
    lab = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark, df, lab).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(700))
    held = [(by[i].predicted, y) for i, _, y in labels if by[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert by[9000].predicted == by[9001].predicted == 0 and by[9002].predicted == by[9003].predicted == by[None].predicted == 1
    text = dict((i, t) for i, t, *_ in rows)
    spans = {text[i].encode()[s.begin : s.end].decode().lower() for i in range(0, 700, 6) for s in by[i].spans}
    assert {"grunk", "vlarb"} <= spans
    assert toxicity.toxicity(spark, df.limit(0), lab.limit(0)).count() == 0


def test_field_against_enumeration():
    r = np.random.default_rng(3)
    f = crf.ChainCRF(2, 5)
    f.emit, f.move, f.start, f.stop = r.normal(size=(5, 2)), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2)
    offsets = np.array([0, 4, 4, 5, 8])
    x = r.integers(0, 5, 8)
    e = f.scores(x, np.arange(9))
    chains = crf.Chains(offsets)
    m = f.forward_backward(e, chains)[0]
    v = f.viterbi(e, chains)
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = b - a
        if not n:
            continue
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        s = np.array([f.start[p[0]] + f.stop[p[-1]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(f.move[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        w = np.exp(s - s.max())
        w /= w.sum()
        for i in range(n):
            assert m[a + i, 1] == pytest.approx(sum(q for q, p in zip(w, paths) if p[i]))
        assert v[a:b].tolist() == paths[int(s.argmax())]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 128])
def test_marginals_in_pieces(piece):
    r = np.random.default_rng(8)
    for labels in (2, 3):
        f = crf.ChainCRF(labels, 6)
        f.emit, f.move, f.start, f.stop = r.normal(size=(6, labels)) * 3, r.normal(size=(labels, labels)), r.normal(size=labels), r.normal(size=labels)
        offsets = np.array([0, 0, 5, 6, 29, 29, 31, 400])
        e = f.scores(r.integers(0, 6, 400), np.arange(401))
        assert np.allclose(f.marginals(e, offsets, piece), f.forward_backward(e, crf.Chains(offsets))[0])
    assert f.marginals(np.zeros((0, 3)), np.array([0, 0]), piece).shape == (0, 3)


PAGES = [
    ("<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One   line,\n here.<p>Two<br>three &eacute;&nbsp;x.</article><footer>&copy; them</footer>", "A & B One line, here. Two three é x."),
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies, a lot of them.</p></div><div id=content><h1>Title of it</h1><p>Body text of the page, in sentences.</p></div><aside>Related things</aside><div class=comments><p>First! I like it, really.</p></div></body>", "Title of it Body text of the page, in sentences."),
    ("<main><p>Some <b>bold</b>face words, and more of them.</p><script>var a='<p>no</p>'</script><form><label>Name</label></form></main>", "Some boldface words, and more of them."),
    (None, ""),
    ("", ""),
    ("<p>", ""),
]


def test_html(spark):
    rows = [(i, f"http://h/{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(0, "http://h/0", PAGES[0][0], "x"), (None, None, PAGES[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = dom_crf.extract(spark, df).collect()
    want = Counter([(i, t) for i, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1]), (None, PAGES[0][1])])
    assert Counter((r.page_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert dom_crf.extract(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("attribute", ['aria-hidden="false"', 'data-hidden="0"', 'title="the hidden cost"', "data-title='Hidden gems'", 'aria-label="Hidden Figures"', "href=/a/hidden"])
def test_hidden_inside_other_attributes(attribute):
    found = dom_crf.blocks(f"<article {attribute}><p>Some <a {attribute}>linked</a> words.</p><p hidden>no</p><p class=x HIDDEN=''>no</p></article>")
    assert [b.text for b in found] == ["Some linked words."]


def test_scores_are_those_of_all_features():
    model = dom_crf.train(dom_crf.training_pages(seed=3, count=60))
    odd = "<div class='a b'><p>x<b class=c>y<div>z</b></p><h2>t</h3>u</b><ul><li>v<li class=a>w</ul></div></i>end<a href=q>link</a> more"
    for page in [odd, "<p>a<p>b</td><tr><td>c<td>d", *(p for p, _ in dom_crf.training_pages(seed=4, count=40))]:
        with_numbers, with_scores = dom_crf.blocks(page), dom_crf.blocks(page, model.emit)
        rows = dom_crf.features(with_numbers)
        want = model.scores(np.array([x for f in rows for x in f]), np.cumsum([0, *(len(f) for f in rows)]))
        assert np.allclose(dom_crf.page_scores(model, [with_scores]), want)
        assert [b.text for b in with_numbers] == [b.text for b in with_scores]


@pytest.mark.parametrize("piece", ["<div class='k{}'>x", "<b>y</i></b></b>", "<p><b>z</h2>", "<h1>w</td>", "<ul><li><a>q</b>", "</b></x>t<i>"])
def test_deep_pages_take_linear_time(piece):
    import time

    model = dom_crf.train(dom_crf.training_pages(seed=3, count=60))

    def seconds(n):
        page = "".join(piece.replace("{}", "abcdefgh"[i % 8] * (1 + i % 7)) for i in range(n))
        began = time.process_time()
        dom_crf.main_texts(model, [page])
        return time.process_time() - began

    seconds(500)
    assert seconds(40_000) < 16 * seconds(5_000) + 0.5


def test_math_text_is_kept():
    page = "<article><h1>A title of it</h1><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> be so, in words.</p></article>"
    assert dom_crf.main_texts(dom_crf.train(), [page]) == ["A title of it Let x=2 be so, in words."]


def test_html_held_out_accuracy():
    model = dom_crf.train()
    held = dom_crf.training_pages(seed=1234, count=300)
    found = dom_crf.main_texts(model, [p for p, _ in held])
    right = total = 0
    for page, label in held:
        b = dom_crf.blocks(page)
        want = dict(label)
        rows = dom_crf.features(b)
        y = model.viterbi(model.scores(np.array([x for f in rows for x in f]), np.cumsum([0, *(len(f) for f in rows)])), crf.Chains(np.array([0, len(b)])))
        right += sum(int(k == want.get(x.text, 0)) for k, x in zip(y, b))
        total += len(b)
    assert right / total > 0.985
    assert np.mean([f == " ".join(t for t, y in label if y) for f, (_, label) in zip(found, held)]) > 0.85


def test_real_pages(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in dom_crf.extract(spark, pages).join(pages.select("page_id", "html"), "page_id").collect():
        title = " ".join(re.search("<h1>(.*?)</h1>", r.html, re.S)[1].replace("&amp;", "&").split())
        assert r.text.startswith(title) and "©" not in r.text


def test_licenses(spark):
    text = "Some code here\n# Licensed under the Apache License, Version 2.0\nmore code"
    rows = [
        ("LICENSE", "Released under the MIT License.", True, 1),
        ("a.py", "print(1)", False, 2),
        ("src/x/b.py", text, False, 3),
        ("src/x/c.py", "nothing of it", False, 4),
        ("src/LICENSE", "This work is licensed under the GNU General Public License, version 3.", True, 5),
        ("src/LICENSE", "This work is licensed under the GNU General Public License, version 3.", True, 5),
        ("src/x/y/d.py", None, False, 6),
        (None, "", False, 7),
        ("other/e.py", "long " * 30000 + "\nLicensed under CC BY-NC 4.0", None, 8),
    ]
    df = spark.createDataFrame(rows, "path string, text string, is_license_file boolean, directory int")
    got = {r.directory: r for r in licenses.scan(spark, df, carry=("directory",)).collect()}
    assert {k: (r.license, r.license_from) for k, r in got.items()} == {
        1: ("MIT", "."), 2: ("MIT", ""), 3: ("Apache-2.0", "."), 4: ("GPL-3.0", "src"), 5: ("GPL-3.0", "."), 6: ("GPL-3.0", "src"), 7: ("MIT", ""), 8: ("CC-BY-NC-4.0", "."),
    }
    assert got[3].line == 1 and got[8].line == 1 and got[4].own_license is None
    assert licenses.scan(spark, df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice shall be included in all copies of the Software.
""" + "THE SOFTWARE IS PROVIDED AS IS.\n" * 12


def test_whole_license_texts_are_license_files(spark, tmp_path):
    from sheafline.llm import queries

    prose = "calm words of a story that goes on\n" * 5
    apache = "\n\n    Apache License\n    Version 2.0, January 2004\n" + "terms and conditions of use\n" * 200 + 'Licensed under the Apache License, Version 2.0 (the "License");'
    texts = {0: MIT, 1: "print(1)", 64: apache, 65: prose, 128: prose + "Released under the MIT License.", 129: prose, 192: "short\nReleased under the MIT License.", 193: None, 256: "", 257: prose + "license " * 3, 320: "Copyright 2020 X\n\n" + MIT.split("\n\n", 2)[2], 321: prose}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    marked = {r.doc_id for r in spark.createDataFrame(list(texts.items()), "doc_id long, text string").where(licenses.is_license_file(queries.F.col("text"))).collect()}
    assert marked == {0, 64, 192, 320}
    got = {r.doc_id: (r.license, r.license_from) for r in queries.op6_license_tfidf(spark, f"file://{tmp_path}").collect()}
    assert got[1] == ("MIT", "s/en/0") and got[65] == ("Apache-2.0", "s/en/1") and got[193] == ("MIT", "s/en/3")
    assert got[128] == ("MIT", ".") and got[129] == got[257] == (None, None)


def test_cosine_against_plain():
    t = licenses.Templates({"A": "alpha beta beta", "B": "gamma beta"})
    t.weigh(10, np.array([1] * len(t.vocabulary)))
    import pyarrow as pa

    from sheafline.llm.units import text_blocks

    for _, _, data, offsets in text_blocks(pa.array(["beta alpha delta"])):
        codes, at = licenses.terms(data, offsets)
        got = t.cosines(codes, np.zeros(len(codes), int), 1)[0]
    idf, other = np.log(11 / 2) + 1, np.log(11) + 1
    norm = np.sqrt(2 * idf**2 + other**2)
    assert got[0] == pytest.approx((idf * idf + idf * 2 * idf) / norm / np.sqrt(5 * idf**2))
    assert got[1] == pytest.approx(idf * idf / norm / np.sqrt(2 * idf**2))


def plain_scan(rows):
    """Every row's best (cosine, license, line) over lines, paragraphs and the whole text, by dictionaries."""
    import math
    import re
    from itertools import groupby

    say = lambda t: re.findall(r"[0-9a-z\x80-\xff]+", (t or "").lower().encode().decode("latin-1"))
    named = [(k, say(x)) for k in sorted(licenses.TEMPLATES) for x in licenses.TEMPLATES[k]]
    vocabulary = {w for _, t in named for w in t}
    seen = Counter(w for t in rows for w in set(say(t)) & vocabulary)
    n = len(rows)
    idf = lambda w: math.log((1 + n) / (1 + seen[w])) + 1 if w in vocabulary else math.log(1 + n) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    templates = [(k, vector(t)) for k, t in named]

    def near(t):
        v = vector(say(t))
        return max(((sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), k) for k, u in templates), key=lambda x: x[0])

    out = []
    for t in rows:
        lines = (t or "").split("\n")
        units = [(line, i) for i, line in enumerate(lines)]
        at = 0
        for blank, run in groupby(lines, lambda x: x == ""):
            run = list(run)
            units += [("\n".join(run), at + k) for k in [next((k for k, x in enumerate(run) if say(x)), 0)] if not blank]
            at += len(run)
        units.append((t, -1))
        best = (0, None, None)
        for text, i in units:
            score, k = near(text)
            if score >= licenses.THRESHOLD and score > best[0] + 1e-9:
                best = (score, k, i)
        out.append(best)
    return out


def test_licenses_against_plain(spark):
    r = random.Random(6)
    notices = [x for xs in licenses.TEMPLATES.values() for x in xs]
    rows = [None, "", "\n\n", MIT]
    for _ in range(80):
        w = r.choice(notices).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice("alpha beta license the of gnu 2".split())
        cut = r.randint(1, len(w))
        header = " ".join(w[:cut]) + r.choice(["\n * ", "\n", " "]) + " ".join(w[cut:])
        rows.append("code line one\n" * r.randrange(3) + r.choice(["", "\n", "\n\n\n"]) + header + r.choice(["", "\n", "\n\nmore of it", "\nmore"]))
    df = spark.createDataFrame([(f"f{i}", t, False) for i, t in enumerate(rows)], "path string, text string, is_license_file boolean")
    got = {r.path: r for r in licenses.scan(spark, df).collect()}
    for i, (score, name, line) in enumerate(plain_scan(rows)):
        g = got[f"f{i}"]
        assert (g.own_license, g.line) == (name, line), (rows[i], g)
        assert name is None or g.similarity == pytest.approx(score)
