import random
from collections import Counter

import numpy as np
import pytest

from sheafline.llm import near_dup, positional_index

from .brute import contamination, near_links

SCHEMA = "doc_id long, text string, d string, n_words string, class_id string"


def corpus(seed=3):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one"), (5, "one two three"), (6, "one  two\nthree"), (7, "one two four")]
    base = text(120)
    for i in range(8, 90):
        w = base.split()
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = "new" + str(r.randrange(999))
        rows.append((i, " ".join(w)))
    rows += [(i, text(r.randint(1, 200))) for i in range(90, 140)] + [(140, text(3000)), (141, rows[20][1])]
    rows += [(141, rows[20][1])]
    return rows


@pytest.mark.parametrize("group_words", [3_000_000, 1500])
def test_near_duplicates(spark, group_words):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = near_dup.near_duplicates(spark, df, group_words=group_words).collect()
    assert len(got) == len(rows)
    want = near_links(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    kept = [r.class_id for r in got if r.kept]
    assert sorted(kept) == sorted(set(want.values()))
    assert near_dup.near_duplicates(spark, df.limit(0)).count() == 0


def test_large_groups_are_linked_across_blocks(spark):
    """Chains of documents, each like the next only, dealt out to many blocks: the pivot joins few of them."""
    w = [f"v{i}" for i in range(900)]
    rows = [(i * 37 % 150, " ".join(w[4 * i : 4 * i + 100])) for i in range(150)] + [(500 + i, " ".join(w[:100] + [f"q{i}"])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    want = near_links(rows)
    assert len(set(want.values())) == 1
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark, df, group_words=900).collect()} == want


def test_rows_without_ids_and_shared_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, b), (None, a), (None, b), (None, "c d e f g h"), (None, None), (None, None), (3, None), (1, a)]
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == sorted(
        [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("1", "1", 3), ("2", "1", 3), ("None", "1", 3), ("None", "None", 1), ("None", "None", 2), ("None", "None", 2), ("3", "3", 1)]
    )
    assert sum(r.kept for r in got) == 5


def test_recall_on_documents(spark):
    """Pairs of sf0.001 with a shingle Jaccard of 0.8 or more, found by comparing all: nine in ten or more share a class."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").split())}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 5
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_near_duplicates_that_repeat_differently(spark):
    rows = []
    for k in range(24):  # equal shingle sets but for the seam; the weighted similarity is about 0.56
        passage, rest = [" ".join(f"{c}{k}w{j}" for j in range(n)) for c, n in (("p", 30), ("q", 70))]
        rows += [(2 * k, f"{passage} {rest}"), (2 * k + 1, f"{passage} " * 300 + rest)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    want = near_links(rows)
    assert set(want.values()) == set(range(0, 48, 2))
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark, df).collect()} == want


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 200).astype(float)
    a, b = elements[:200], elements[100:]
    m = 4096
    sig = near_dup.prob_minhash(np.repeat([0, 1], 200), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    pa, pb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = 0.0
    for x in set(pa) & set(pb):
        want += 1 / sum(max(pa.get(y, 0) / pa[x], pb.get(y, 0) / pb[x]) for y in set(pa) | set(pb))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5
    assert set(sig[0].tolist()) <= set(a.tolist())


def decontamination_rows(seed=4):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "b", "C", "é", "x9", "Zz"]) for _ in range(n))
    items = [(i, text(r.randint(1, 30))) for i in range(12)] + [(12, None), (13, ""), (14, "--"), (15, "rare unique"), (15, "rare unique")]
    rows = [(0, None), (1, ""), (2, "RARE-unique, and more " + "pad " * 60)]
    for i in range(3, 80):
        w = text(r.randint(0, 60))
        rows.append((i, w + (" ... " + items[i % 12][1].upper() + "! " + text(9) if i % 2 else "")))
    rows.append((80, text(5000) + " " + items[3][1]))
    return rows, items


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_contamination(spark, block):
    rows, items = decontamination_rows()
    docs = spark.createDataFrame([(i, t, 1, "y", "z") for i, t in rows], "doc_id long, text string, row int, n_words string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in positional_index.decontaminate(spark, docs, bench, block_terms=block).collect()}
    assert got == contamination(rows, items)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert positional_index.decontaminate(spark, docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in positional_index.decontaminate(spark, docs, bench.limit(0)).collect()] == [False, False]
    assert sorted(r.contaminated for r in positional_index.decontaminate(spark, docs, bench).collect()) == [False, True]


def test_contamination_of_repeated_rows_and_carried_columns(spark):
    rows, items = decontamination_rows()
    rows = [(i, t) for i, t in rows[3:20]] * 2 + [(None, rows[5][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, k, "p") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, postings string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(list(enumerate(t for _, t in rows)), items)
    got = positional_index.decontaminate(spark, docs, bench, block_terms=200, carry=("text", "row", "postings")).collect()
    assert {r.row: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert all((r.doc_id, r.text) == rows[r.row] and r.postings == "p" for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x gamma y alpha z beta q"), (2, "alpha " + "p " * 30 + "beta gamma"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Alpha beta gamma")], "item_id long, text string")
    got = [tuple(r) for r in positional_index.proximity(spark, docs, bench, span=8).collect()]
    assert got == [(1, "7", 1, 6)]


def test_proximity_against_brute_force(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("aaabbbccdef") for _ in range(n))
    # In the first document gamma is the rarest term, and alpha stands on both sides of it.
    rows = [(0, "alpha p p p p gamma p p p p p alpha beta"), (1, "alpha beta alpha beta"), (2, None), *[(i, text(r.randint(0, 60))) for i in range(3, 60)]]
    rows.append(rows[9])
    items = [(7, "Alpha beta gamma"), *[(i, text(r.randint(1, 6))) for i in range(10, 22)]]
    want = Counter()
    for i, t in rows:
        w = (t or "").split()
        for item, phrase in items:
            need = Counter(phrase.lower().split())
            holds = lambda a, b, w=w, need=need: not need - Counter(w[a:b])
            want.update({(i, str(item), a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 8) + 1) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)})
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want[0, "7", 5, 13] == 1
    assert Counter(tuple(r) for r in positional_index.proximity(spark, docs, bench, span=8).collect()) == want
