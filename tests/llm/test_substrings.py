import random

import pytest

from sheafline.llm import lyndon_suffix, substring_tree

from .brute import substring_bytes, substring_words

SCHEMA = "doc_id long, text string, w string, `key` string"


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(300)]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
    passage, base = text(90), text(400)
    rows = [(0, None), (1, ""), (2, "one"), (3, " \n\t "), (4, base), (5, base), (6, "ab " * 700), (7, "z" * 900)]
    for i in range(8, 60):
        w = base.split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        kind = i % 4
        rows.append((i, " ".join(w) if kind == 0 else text(r.randint(1, 150)) + passage + text(r.randint(0, 80)) if kind == 1 else passage[r.randint(0, 300) :] if kind == 2 else text(r.randint(1, 300))))
    rows += [(63, text(12_000) + passage + text(12_000)), (60, text(4000) + passage + text(10)), (61, "\x00" * 250 + "a"), (62, "b" + "\x00" * 230)]
    return [(i, t, "x", "y") for i, t in rows]


@pytest.mark.parametrize("group", [1024, 2])
def test_words(spark, group):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_tree.deduplicate(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), group=group).collect()}
    assert got == substring_words([(i, t) for i, t, _, _ in rows])


@pytest.mark.parametrize("group", [1024, 2])
def test_bytes(spark, group):
    rows = corpus()
    rows.append(rows[30])  # a repeated row
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lyndon_suffix.deduplicate(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), group=group).collect()), key=str)
    assert got == substring_bytes([(i, t) for i, t, _, _ in rows])


def test_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_tree.deduplicate(spark, df).collect())
    assert got == [("3", 0), ("3", 0), ("None", 120), ("None", 120)]
    assert substring_tree.deduplicate(spark, df.limit(0)).count() == 0
    assert lyndon_suffix.deduplicate(spark, df.limit(0)).count() == 0


def test_two_texts_of_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " x"), (None, a), (None, None), (1, a)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_tree.deduplicate(spark, df).collect())
    assert got == [("1", 120, 0), ("1", 120, 0), ("1", 120, 0), ("2", 121, 120), ("None", 0, 0), ("None", 120, 120)]


def test_bytes_without_ids_and_two_texts_of_one_id(spark):
    a, b = ("".join(f"{c}{i}," for i in range(150)) for c in "ab")
    rows = [(1, a), (1, b), (2, "x" + b), (None, a[50:]), (None, a[50:]), (None, None), (None, "short")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lyndon_suffix.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == substring_bytes(rows)


def test_suffix_array():
    r = random.Random(1)
    for _ in range(600):
        s = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))]
        array = lyndon_suffix.suffix_array(s)
        assert array == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = lyndon_suffix.common_prefixes(s, array)
        for k in range(1, len(s)):
            a, b = s[array[k - 1] :], s[array[k] :]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[k] == n
