"""Folds that need one pass in order: marker regions, callout anchors, code re-flow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import boxes, lines, read

# Regions that a spoken marker opens and closes.
REGIONS = ("nota", "aviso", "lista", "box", "imagem", "código-fonte")


def per_document(rows: DataFrame, key: str, fields: tuple[str, ...], fold: Callable[[list[dict]], list], out: str, result: pa.DataType, kind: str) -> DataFrame:
    """Apply ``fold`` to the ordered rows of each document; a document is one array, a task folds many a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(r) for r in batch.column(1).to_pylist()], result)], names=[key, out])

    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return grouped.mapInArrow(run, f"{key} long, {out} {kind}")


def marker_blocks(rows: list[dict]) -> list[dict]:
    """Regions from left to right: an opener of a known kind takes all lines to its closer, or to the end; openers
    inside are content; an unknown kind is a paragraph."""
    out, i = [], 0
    while i < len(rows):
        line = rows[i]["line"]
        kind = line[len("Início de ") : -1] if line.lower().startswith("início de ") and line.endswith(":") else None
        if kind not in REGIONS:
            out.append({"first": rows[i]["pos"], "last": rows[i]["pos"], "kind": "paragraph"})
            i += 1
            continue
        j = next((k for k in range(i + 1, len(rows)) if rows[k]["line"] == f"Fim de {kind}"), len(rows))
        out.append({"first": rows[i]["pos"], "last": rows[min(j, len(rows) - 1)]["pos"], "kind": kind})
        i = j + 1
    return out


BLOCK = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string())])


@query()
def marker_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13 over lines of which some open and some close regions."""
    k = F.col("pk") % 5
    line = F.when(k == 0, "Início de nota:").when(k == 1, "Fim de nota").when(k == 2, "Início de barra lateral:").when(k == 3, "Início de box:").otherwise("text")
    rows = lines(spark, sf_dir).select("doc_id", "pos", line.alias("line"))
    found = per_document(rows, "doc_id", ("pos", "line"), marker_blocks, "blocks", pa.list_(BLOCK), "array<struct<first:long,last:long,kind:string>>")
    return found.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def anchor_groups(rows: list[dict]) -> list[dict]:
    """From each known title forward: up to eight boxes, all starting right of the title, until one doesn't."""
    out, used = [], set()
    for i, r in enumerate(rows):
        if not r["known"] or i in used:
            continue
        members = [i]
        for j in range(i + 1, len(rows)):
            if j in used:
                continue
            if rows[j]["known"] or rows[j]["x0"] < r["x0"] + 8 or len(members) == 8:
                break
            members.append(j)
        if len(members) > 1:
            used.update(members)
            out.append({"first": r["pos"], "last": rows[members[-1]]["pos"], "kind": f"anchor-{len(members)}"})
    return out


@query()
def callout_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known titles (every eleventh part) take the indented boxes after them on their page."""
    rows = boxes(spark, sf_dir).select((F.col("doc_id") * 4 + F.col("page")).alias("doc_page"), "pos", "x0", (F.col("pk") % 11 == 0).alias("known"))
    found = per_document(rows, "doc_page", ("pos", "x0", "known"), anchor_groups, "groups", pa.list_(BLOCK), "array<struct<first:long,last:long,kind:string>>")
    return found.select(F.floor(F.col("doc_page") / 4).alias("doc_id"), (F.col("doc_page") % 4).alias("page"), F.explode("groups").alias("g")).select("doc_id", "page", "g.*")


def reflow(code: str) -> str:
    """A line a statement: breaks after braces, and after semicolons outside parentheses; strings are left as they are; four
    blanks a level."""
    out: list[str] = []
    line, depth, paren, quote, escaped = "", 0, 0, "", False

    def end(shift: int = 0) -> None:
        nonlocal line, depth
        if line.strip():
            out.append("    " * depth + line.strip())
        line, depth = "", max(0, depth + shift)

    for c in code:
        if c == "\n" and not quote:
            end()
            continue
        if c == "}" and not quote:
            end(-1)
        line += c
        if quote:
            quote, escaped = ("" if c == quote and not escaped else quote), c == "\\" and not escaped
        elif c in "\"'":
            quote = c
        elif c in "()":
            paren = max(0, paren + (1 if c == "(" else -1))
        elif c in "{}" or (c == ";" and not paren):
            end(c == "{")
    end()
    return re.sub(r"(?m)^(\s*)else\s*\{", r"\1else {", "\n".join(out))


# Words and marks by which a text is code that has lost its lines.
FLAT_WORDS = (" class ", "public ", "private ", " if ", " else ")
FLAT_MARKS = "{};("


def normal_code(text: str | None) -> str:
    """Code with its own lines: tabs as blanks, flattened code re-flowed, single blanks inside lines, no two empty lines."""
    text = re.sub(r"\t+", " ", (text or "").replace("\r\n", "\n").replace("\r", "\n"))
    longest = max((len(x) for x in text.split("\n")), default=0)
    if ("\n" not in text or longest > 140) and any(w in text for w in FLAT_WORDS) and any(m in text for m in FLAT_MARKS):
        text = reflow(text)
    lines_ = [re.match(r"\s*", x).group() + " ".join(x.split()) if x.strip() else "" for x in text.split("\n")]
    kept = [x for i, x in enumerate(lines_) if x or (i and lines_[i - 1])]
    return "\n".join(kept).strip("\n")


@query()
def code_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 on code written from part names."""
    code = F.concat(F.lit("public\tclass A{void "), F.translate("p_name", " ", "_"), F.lit("(int a;){ if (a){String s=\"{;}\";return;} else{x();}}}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal_code(x) for x in batch.column(1).to_pylist()])], names=["id", "code"])

    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.alias("code")).mapInArrow(run, "id long, code string")
