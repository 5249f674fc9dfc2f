"""Candidate stage of the two substring operators: which documents share a window, without shuffling every position.

Content-chosen anchors (:func:`sheafline.llm.units.anchors`) stand for the windows through them: two equal windows hold
an anchor with equal key at the same place. Members (one row an anchor) are grouped into classes of equal context by a
map-side aggregation, classes into buckets of equal key. A bucket of one document place holds no repeat and goes. What
is left, one context a class, goes to the operator's own suffix structure, a group at a time.

The key of a group is a prefix of variable length: the units that all its windows share. At first that is the anchor's
gram. A group with more than ``group`` different contexts is divided by longer prefixes: the starts of its windows are
cut into runs, and windows of one run share more units than all of them do, which become the key of a smaller group
(:func:`divided`). So groups of any size are divided until they fit, at last by the whole window, where all contexts are
equal; the suffix structure is the same at every size. Results are ranges around anchors; they are carried back to the
classes, joined to the members and folded by document.

A row is told by doc_id and a checksum of its text, so different texts of one doc_id stay apart. Rows without a doc_id
count as a document of their own per text, after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .units import BYTE_CODES, U64, Rolling, anchors, mix, text_blocks, word_codes, words

#: Contexts of one group that a task compares at once, about 10 kB each with the suffix structure.
GROUP = 2048
#: Runs of window starts that a larger group is divided into.
RUNS = 4


def keyed(docs: DataFrame) -> DataFrame:
    """``d``: the document's key inside the operator; ``r``: checksum of the text; ``doc_id`` and ``text`` as they are."""
    big = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), big).alias("d"), F.hash(text).alias("r"), F.col("doc_id"), text.alias("text"))


def unit_codes(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    if unit == "byte":
        return BYTE_CODES[data], offsets
    starts, ends, at = words(data, offsets)
    return word_codes(data, starts, ends), at


def members(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in text_blocks(batch.column(2)):
                codes, at = unit_codes(data, offsets, unit)
                a = anchors(codes, at, window, gram)
                if len(a["at"]):
                    yield pa.RecordBatch.from_arrays([pa.array(a["key"]), pa.array(a["context"]), pa.array(d[i:j][a["doc"]]), pa.array(r[i:j][a["doc"]]), pa.array((a["at"] - at[a["doc"]]).astype(np.int32))], names=["key", "context", "d", "r", "at"])

    return docs.select("d", "r", "text").mapInArrow(emit, "key long, context long, d long, r int, at int")


FIELDS = ("key", "context", "at", "n", "least", "kinds")


def contexts(docs: DataFrame, wanted: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """The codes around each wanted anchor (d, r and FIELDS), fetched from its document; a repeated row gives them twice."""
    per_doc = wanted.groupBy("d", "r").agg(F.collect_list(F.struct(*FIELDS)).alias("w"))
    schema = "key long, context long, left int, n long, least long, kinds long, codes binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, row_at = lists.flatten(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            f = {name: flat.field(k).to_numpy(zero_copy_only=False) for k, name in enumerate(FIELDS)}
            for i, j, data, offsets in text_blocks(batch.column(0)):
                codes, at = (data, offsets) if unit == "byte" else unit_codes(data, offsets, unit)
                rows, many = slice(row_at[i], row_at[j]), np.diff(row_at[i : j + 1])
                a = f["at"][rows] + np.repeat(at[:-1], many)
                lo = np.maximum(a - (window - gram), np.repeat(at[:-1], many))
                hi = np.minimum(a + window, np.repeat(at[1:], many))
                size = codes.dtype.itemsize
                raw, ends = codes.tobytes(), np.cumsum(hi - lo) * size
                body = b"".join([raw[x * size : y * size] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                cut = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(f["key"][rows]), pa.array(f["context"][rows]), pa.array((a - lo).astype(np.int32)), pa.array(f["n"][rows]), pa.array(f["least"][rows]), pa.array(f["kinds"][rows]), cut], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("d", "r", "text").join(per_doc, ["d", "r"]).select("text", "w").mapInArrow(emit, schema)


Solver = Callable[[dict[str, np.ndarray], pa.ChunkedArray], dict[str, np.ndarray]]


def by_group(rows: DataFrame, solve: Solver, schema: str, block: int = 4096) -> DataFrame:
    """Apply ``solve`` to runs of whole groups, about ``block`` contexts at a time; groups never straddle two calls."""
    names = [x.split()[0] for x in schema.split(",")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(t):
                cols = {c: t.column(c).to_numpy() for c in ("key", "context", "left", "n", "least", "lo", "hi")}
                order = np.lexsort((cols["context"], cols["key"]))
                again = np.zeros(len(order), bool)  # a document given twice
                again[1:] = (cols["key"][order[1:]] == cols["key"][order[:-1]]) & (cols["context"][order[1:]] == cols["context"][order[:-1]])
                if again.any():
                    first = np.sort(order[~again])
                    t, cols = t.take(first), {c: v[first] for c, v in cols.items()}
                out = solve(cols, t.column("codes"))
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= block:
                t = pa.concat_tables(held).combine_chunks()
                keys = t.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1], "left"))  # sorted by key
                yield from run(t.slice(0, whole))
                held, count = [t.slice(whole)], len(t) - whole
        if held:
            yield from run(pa.concat_tables(held).combine_chunks())

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(emit, schema)


def code_runs(codes: pa.Array | pa.ChunkedArray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all units end to end, first unit and number of units of each row) of a binary column."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64)
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    width = 1 if unit == "byte" else 8
    flat = raw if unit == "byte" else np.frombuffer(raw.tobytes(), U64)
    return flat, (offsets[:-1] - offsets[0]) // width, np.diff(offsets) // width


def runs_of(c: dict[str, np.ndarray], begin: np.ndarray, size: np.ndarray, roll: Rolling, window: int, runs: int) -> dict[str, np.ndarray]:
    """Contexts under longer prefixes.

    A context of a group stands for its windows that begin ``lo`` to ``hi`` units before the anchor. Those that begin a to
    b before it share the units from a before the anchor to window - b after, the piece's key, and reach at most from b
    before to window - a after, all that the piece keeps. Windows that the text is too short for make no piece.
    Returns of each piece the context's row, key, context, a, b and the kept units before the anchor, start and end.
    """
    left, lo, hi = (c[name].astype(np.int64) for name in ("left", "lo", "hi"))
    anchor, right = begin + left, size - left
    step = -(-(hi - lo + 1) // runs)
    a = lo[:, None] + step[:, None] * np.arange(runs)
    b = np.minimum(hi[:, None], a + step[:, None] - 1)
    row, k = np.nonzero((a <= b) & (left[:, None] >= a) & (right[:, None] >= window - b))
    a, b, at = a[row, k], b[row, k], anchor[row]
    key = mix(roll.at(at - a, at + window - b) ^ (a * 65536 + b).astype(U64))
    before, after = np.minimum(left[row], b), np.minimum(right[row], window - a)
    context = mix(roll.at(at - before, at + after) ^ (before * 65536 + after).astype(U64))
    return {"row": row, "key": key.view(np.int64), "context": context.view(np.int64), "lo": a, "hi": b, "left": before, "start": at - before, "end": at + after}


PIECE = "key long, context long, above_key long, above_context long, lo int, hi int, left int, n long, least long, codes binary"


def divided(rows: DataFrame, window: int, unit: str, runs: int) -> DataFrame:
    """Pieces (PIECE) of the contexts under longer prefixes, with the key and context that they come from."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in ("key", "context", "lo", "hi", "left", "n", "least")}
            flat, begin, size = code_runs(batch.column("codes"), unit)
            p = runs_of(c, begin, size, Rolling(BYTE_CODES[flat] if unit == "byte" else flat), window, runs)
            row, item, raw = p["row"], flat.dtype.itemsize, flat.tobytes()
            body = pa.array([raw[x * item : y * item] for x, y in zip(p["start"].tolist(), p["end"].tolist(), strict=True)], pa.binary())
            cut = [p["key"], p["context"], c["key"][row], c["context"][row], *(p[x].astype(np.int32) for x in ("lo", "hi", "left")), c["n"][row], c["least"][row]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cut), body], names=[x.split()[0] for x in PIECE.split(", ")])

    return rows.mapInArrow(emit, PIECE)


def candidates(docs: DataFrame, scratch: Scratch, unit: str, window: int, gram: int, distinct_docs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes that are alone in their group, contexts of the groups of several).

    distinct_docs: a repeat counts only between different documents.
    """
    every = scratch.put(members(docs, unit, window, gram), "all-members")
    live = every.groupBy("key").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b") if distinct_docs else every.groupBy("key").agg(F.count("*").alias("a")).where("a > 1")
    live = scratch.put(live.select("key"), "live")
    member = scratch.put(every.join(live, "key"), "members")
    scratch.drop("all-members")
    scratch.drop("live")
    # A hot key is one row of ``kinds`` against many classes; as both are tables, the join can split it.
    classes = scratch.put(member.groupBy("key", "context").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.min(F.struct("d", "r", "at")).alias("one")), "single-classes")
    kinds = scratch.put(classes.groupBy("key").agg(F.count("*").alias("kinds")), "kinds")
    classes = scratch.put(classes.join(kinds, "key").select("key", "context", "n", "least", "kinds", "one.d", "one.r", "one.at"), "classes")
    scratch.drop("single-classes")
    several = scratch.put(contexts(docs, classes.where("kinds > 1"), unit, window, gram), "contexts")
    span = several.withColumns({"lo": F.lit(0), "hi": F.lit(window - gram)})
    return member, classes.where("kinds = 1").select("key", "context", "n", "least", F.lit(0).alias("lo"), F.lit(window - gram).alias("hi")), span


def matched(rows: DataFrame, scratch: Scratch, solve: Solver, schema: str, alone: Callable[[DataFrame], DataFrame], unit: str, window: int, group: int, runs: int = RUNS) -> DataFrame:
    """Results of ``solve`` (columns of ``schema``, with key and context of the classes) over groups of any size.

    alone: results of the classes that are the only one of their group, all of whose windows are equal.
    """
    results, pieces = [], []
    while True:
        k = len(pieces)
        small = by_group(rows.where((F.col("kinds") > 1) & (F.col("kinds") <= group)), solve, schema)
        results.append(scratch.put(small.unionByName(alone(rows.where("kinds = 1"))) if k else small, f"found-{k}"))
        large = rows.where(F.col("kinds") > group)
        if large.isEmpty():
            break
        large = large if k else large.dropDuplicates(["key", "context"])
        pieces.append(scratch.put(divided(large, window, unit, runs), f"pieces-{k}"))
        classes = pieces[-1].groupBy("key", "context").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("left").alias("left"), F.first("codes").alias("codes"))
        classes = scratch.put(classes, f"classes-{k}")
        kinds = scratch.put(classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all"), f"kinds-{k}")
        rows = scratch.put(classes.join(kinds, "key"), f"level-{k}")
        scratch.drop(f"classes-{k}")
    out = results.pop()
    while pieces:
        up = pieces.pop().select("key", "context", "above_key", "above_context")
        rest = [c for c in out.columns if c not in ("key", "context")]
        out = results.pop().unionByName(up.join(out, ["key", "context"]).select(F.col("above_key").alias("key"), F.col("above_context").alias("context"), *rest))
    return out
