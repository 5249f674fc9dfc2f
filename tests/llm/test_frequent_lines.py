"""The texts that are left by line frequency, against a plain version."""

import random
import re
from collections import Counter, defaultdict

from sheafline.llm import line_frequency

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return " ".join(WORD.findall(line)).translate({c: c + 32 for c in range(65, 91)})


def cut(rows, most):
    """Text left, words removed and distinct lines removed, one entry a row."""
    documents = {(i, t or "", s or "") for i, t, s in rows}
    held = defaultdict(int)
    for _, t, s in documents:
        for n in {normal(x) for x in t.split("\n")} - {""}:
            held[s, n] += 1
    for i, t, s in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if normal(x) and held[s or "", normal(x)] > most]
        left = "\n".join(x for x in lines if x not in gone)
        yield i, left, sum(len(WORD.findall(x)) for x in gone), len({normal(x) for x in gone})


def test_text_without_frequent_lines(spark):
    rng = random.Random(8)
    common = ["Read more", "read\tMORE ", "\rAll rights  reserved\v", "Été à lire", "ÉTÉ à lire", "", " \t", "x"]
    rows = []
    for i in range(60):
        lines = [" ".join(f"w{i}x{j}y{k}" for k in range(rng.randrange(1, 9))) for j in range(6)] + rng.choices(common, k=rng.randrange(9))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h", "g", "", None])))
    rows += [(1000, "Read more", "h"), (1001, None, "h"), (1002, "", "g"), (None, "x\nRead more\nx", "h"), (None, "x\nRead more\nx", "h"), *rows[:7]]
    got = line_frequency.frequent_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=4).collect()
    want = Counter(cut(rows, 4))
    assert Counter((r.doc_id, r.text, r.n_removed_words, r.n_removed_lines) for r in got) == want
    assert sum(w[2] > 0 for w in want) > 20
    assert all(r.kept == (not r.base_failed and len(WORD.findall(r.text)) >= max(10, r.n_words / 2)) for r in got)
