"""The stages against brute force on a small fixture."""

import random
from collections import Counter

import corpus_pipeline as p
from sheafline.llm import mixing, queries

from .brute import contamination, near_links
from .test_models import toxic_corpus


def tables(spark, at):
    r = random.Random(9)
    rows, labels = toxic_corpus(400)
    rows = [(i, t, "en", f"s{i % 3 and 1}", len(t)) for i, t, *_ in rows]
    items = [(k, " ".join(f"item{k}w{j}" for j in range(30))) for k in range(5)]
    for i in range(1000, 1040):
        text = " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(60))
        rows.append((i, text, "en", "s1", 1))
        if i % 4 == 0:
            rows.append((i + 100, text + " end", "en", "s1", 1))
        if i % 5 == 0:
            rows.append((i + 200, text[:200] + " " + items[i % 5][1], "fr", "s0", 1))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s2", 0)]
    # Rows without doc_id: toxic, twice a copy of a clean text, contaminated, and clean.
    rows += [(None, "calm grunk Vlarb! grunk words", "en", "s1", 1), (None, rows[401][1], "en", "s1", 1), (None, rows[401][1], "en", "s1", 1), (None, "see " + items[2][1], "en", "s1", 1), (None, "alone " * 3 + "clean row without an id", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows, items = tables(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [s for s, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.columns == list(p.COLUMNS)
        out.write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        kept.append(docs.collect())
    ids = [{r.doc_id for r in x} for x in kept]
    toxic = {i for i in range(400) if i % 6 == 0}
    assert len(toxic & ids[0]) <= 4 and len({i for i, *_ in rows} - toxic - ids[0]) <= 2
    text = {r.doc_id: r.text for r in kept[0]}
    del text[None]
    classes = near_links(list(text.items()))
    assert ids[1] == set(classes.values()) | {None}
    bare = [[r.text for r in x if r.doc_id is None] for x in kept]
    assert not any("grunk" in t for t in bare[0]) and len(bare[0]) == 4
    assert sorted(t[:5] for t in bare[1]) == ["alone", "see i"] and [t[:5] for t in bare[2]] == ["alone"]
    found = contamination([(r.doc_id, r.text) for r in kept[1] if r.doc_id is not None], items)
    assert ids[2] == {i for i, v in found.items() if not v[4]} | {None}
    mixed = Counter(r.doc_id for r in mixing.mix(spark, spark.read.parquet(f"{at}/stage-2")).collect())
    assert Counter(r.doc_id for r in kept[3]) == mixed
    assert Counter(r.doc_id for r in kept[4]) == mixed and {r.shard for r in kept[4]} <= set(range(16))


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    at = f"file://{tmp_path}"
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, d long, kept boolean, shard int, postings binary, tokens long"
    spark.createDataFrame([], names).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert p.run(spark, at).count() == 0
    row = (1, "some words here", "en", "s", 15, 0.5, 7, True, 3, bytearray(b"x"), 2)
    docs = spark.createDataFrame([row, row, (None,) * 11], names)
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, docs, at)
        assert docs.columns == list(p.COLUMNS)
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["1", "None"]


def test_run_and_names(spark, tmp_path):
    at = f"file://{tmp_path}"
    tables(spark, at)
    out = p.run(spark, at)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "sheafline", tmp_path / "sheafline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n[:2] == 'op' and n[2].isdigit() for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
