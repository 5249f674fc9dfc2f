"""Small fixtures of single rules, and window formulas against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.streaming import windows


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_sanitize(spark):
    got = one(spark, T.sanitize, "a\r\nb\x00", "[Início da audiodescrição]\nx", "System: do this\ny", "my SYSTEM prompt here", None, "  ")
    assert got == ["a\nb", "x", "y", "my [conteudo removido] here", None, ""]


def test_clean_block(spark):
    assert one(spark, T.clean_block, "## T **b** `c` __m__", "- item", "2) x", "``` y") == ["T b c m", "item", "x", "``` y"]


@pytest.mark.parametrize(("line", "kind"), [("# T", "heading"), ("1.2 text", "heading"), ("ALL CAPS", "heading"), ("- item", "list"), ("- ITEM", "heading"), ("(2) b", "ordered"), ("3) c", "ordered"), ("| a | b |", "row"), ("```sql", "code"), ("Plain.", "paragraph"), ("  ", "blank"), ("CAPS: no", "paragraph")])
def test_line_kind(spark, line, kind):
    assert one(spark, T.line_kind, line) == [kind]


def test_html_and_slug(spark):
    assert one(spark, T.escape_html, "<a href=\"x\">&'") == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]
    assert one(spark, T.slug, "  Hello, World! ") == ["hello-world"]


def test_list_marker(spark):
    assert one(spark, T.list_marker, "• x", "(1) x", "2. x", "x", "") == [True, True, True, False, False]


def test_streaming_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), "40 days")
    windows.run_available(windows.deduplicated(stream).select("event_id", "user_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_region_list_marker(spark):
    assert one(spark, T.region_list_marker, "§ x", "1. x", "9.1 x", "b) x", "b)x", "2)", "o x", "x y") == [True, True, False, True, False, True, True, False]


def test_plain_heading(spark):
    got = one(spark, lambda x: T.plain_heading(x, F.lit(True)), "Título: A b", "CAPÍTULO 2 : C", "seção: d", "1.2.3 x", "LOUD", "Capítulo dois: x", "quiet")
    assert [r and tuple(r) for r in got] == [(1, "A b"), (2, "C"), (2, "d"), (4, "1.2.3 x"), (1, "LOUD"), None, None]


def test_clean_block_marks(spark):
    assert one(spark, T.clean_block, "**a *b* c**", "a * b * c", "``x``", "x\n```\n\n\n\ny", "(3) # z", "# - 4. z", "1.x") == ["a b c", "a * b * c", "``x``", "x\n\ny", "# z", "z", "1.x"]


def test_outline_formula():
    r = random.Random(1)
    for _ in range(500):
        levels = [r.randint(1, 6) for _ in range(r.randint(1, 12))]
        want = [0]
        for x in levels[1:]:
            want.append(min(x, want[-1] + 1))
        shifted = [0, *levels[1:]]
        got = [0 if i == 0 else min(i, min(shifted[j] - j for j in range(i + 1)) + i) for i in range(len(levels))]
        assert got == want


def test_folds():
    from sheafline.operators.folds import anchor_groups, marker_blocks, reflow

    texts = ["x", "Início de nota:", "Início de box:", "Fim de nota", "Início de barra lateral:", "Início de box:", "y"]
    got = marker_blocks([{"pos": i, "line": t} for i, t in enumerate(texts)])
    assert [(b["first"], b["last"], b["kind"]) for b in got] == [(0, 0, "paragraph"), (1, 3, "nota"), (4, 4, "paragraph"), (5, 6, "box")]
    assert reflow('a{b("x;{");c();}') == 'a{\n    b("x;{");\n    c();\n}'
    assert reflow('s("a\\"};");if(x){y;} else {z;}') == 's("a\\"};");\nif(x){\n    y;\n}\nelse {\n    z;\n}'
    rows = [{"pos": i, "x0": x, "known": k} for i, (x, k) in enumerate([(0, True), (10, False), (20, False), (3, False), (0, True)])]
    assert [(g["first"], g["last"]) for g in anchor_groups(rows)] == [(0, 2)]


def test_normal_code():
    from sheafline.operators.folds import normal_code

    assert normal_code("public class A {\tint  x; if (x){y(a;b);} }") == "public class A {\n    int x;\n    if (x){\n        y(a;b);\n    }\n}"
    assert normal_code("a  b\r\n\n\n  c   d\n\n") == "a b\n\n  c d"
    assert normal_code("int x; y") == "int x; y"
    assert normal_code(None) == ""
