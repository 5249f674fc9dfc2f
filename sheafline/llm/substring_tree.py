"""Substring de-duplication by words: prefix-partitioned suffix trees.

Suffixes of the corpus are split by prefixes of variable length into groups that fit memory: first by the anchor gram that
ends their prefix, and a group with too many different continuations by longer prefixes, again and again until it fits
(:mod:`sheafline.llm.repeats`). A group of one context holds nothing to compare. In each other group the subtree is built level by level from string depth 1 to the window length: a node is a class of suffixes that agree on so many
words, and a level splits every node by the words that follow (the depth doubles, the last step overlaps). Nodes at the
window's depth with more than one leaf are the deep internal nodes; each gives its least document, and a leaf of a
later document marks its window for removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import GROUP, candidates, code_runs, keyed, matched
from .units import covered, text_blocks, words

WINDOW = 50
GRAM = 25


def refine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Node numbers of the pairs (left, right)."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    new = np.empty(len(order), bool)
    new[:1], new[1:] = True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def subtree_levels(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Node at string depth ``depth`` of each suffix in ``starts`` of the code sequence, which they don't run over.

    Level-wise construction: nodes at depth 2k come from the nodes at depth k of a suffix and of the suffix k later.
    """
    node = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    at = 1
    while at * 2 <= depth:
        node = refine(node[:-at], node[at:])
        at *= 2
    return refine(node[starts], node[starts + depth - at])


def tree_solver(window: int, gram: int):
    """For matched: runs of window shifts of each context with the least document that has the window."""

    def solve(cols: dict[str, np.ndarray], raw: pa.ChunkedArray) -> dict[str, np.ndarray]:
        codes, begin, sizes = code_runs(raw, "word")
        shifts = np.arange(window - gram + 1)
        start = cols["left"][:, None].astype(np.int64) - shifts[None, :]
        ok = (start >= 0) & (start + window <= sizes[:, None])
        who, shift = np.nonzero(ok)
        where = begin[who] + start[ok]
        node = subtree_levels(codes, where, window)
        group = np.unique(cols["key"], return_inverse=True)[1][who]
        node = refine(node, group * (window + 1) + shift)
        least = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, node, cols["least"][who])
        found = least[node]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1]) | (shift[1:] != shift[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(who)]])[: len(first)] - 1
        keep = (cols["n"][who[first]] > 1) | (found[first] < cols["least"][who[first]])
        first, last = first[keep], last[keep]
        return {"key": cols["key"][who[first]], "context": cols["context"][who[first]], "lo": shift[first].astype(np.int32), "hi": shift[last].astype(np.int32), "first_doc": found[first]}

    return solve


def repeated_ranges(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(d, r, ranges): word ranges of each document covered by windows that also start in an earlier document."""
    member, alone, several = candidates(docs, scratch, "word", window, gram, True)
    # A group with one context: every window through the anchor is the same in all its members. Ranges are clipped later.
    one = lambda rows: rows.select("key", "context", "lo", "hi", F.col("least").alias("first_doc"))
    tree = matched(several, scratch, tree_solver(window, gram), "key long, context long, lo int, hi int, first_doc long", one, "word", window, group)
    runs = one(alone).unionByName(tree).groupBy("key", "context").agg(F.collect_set(F.struct("lo", "hi", "first_doc")).alias("runs"))
    found = scratch.put(runs, "found")
    # All windows hold the anchor, so those to be removed from a member cover one range.
    hits = member.join(found, ["key", "context"]).withColumn("runs", F.expr("filter(runs, w -> w.first_doc < d)")).where("size(runs) > 0")
    one_range = F.struct(F.expr("at - array_max(transform(runs, w -> w.hi))").alias("s"), F.expr(f"at - array_min(transform(runs, w -> w.lo)) + {window}").alias("e"))
    return hits.select("d", "r", one_range.alias("x")).groupBy("d", "r").agg(F.collect_set("x").alias("ranges"))


def deduplicate(spark: SparkSession, documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document with a smaller doc_id.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; a null text has none. Returns one row per input row with
    doc_id, n_words, n_removed, kept_sha256 and kept_text. Rows of one doc_id are one document and don't count
    against each other, whether their texts are the same or not; rows without doc_id come after all others. Columns other than doc_id and text are ignored.
    """
    docs = keyed(documents)
    scratch = Scratch(spark, "substring-tree")
    ranges = scratch.put(repeated_ranges(docs, scratch, window, gram, group), "ranges")
    scratch.keep("ranges")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("ranges")
            out: list[list] = [[], [], [], []]
            for i, j, data, offsets in text_blocks(texts):
                starts, ends, at = words(data, offsets)
                for k in range(i, j):
                    lo, hi = at[k - i], at[k - i + 1]
                    found = lists[k].as_py()
                    keep = np.ones(hi - lo, bool)
                    if found:
                        keep = ~covered(np.maximum([x["s"] for x in found], 0), np.minimum([x["e"] for x in found], hi - lo), hi - lo)
                    raw = data.data
                    body = b" ".join(bytes(raw[s:e]) for s, e in zip(starts[lo:hi][keep].tolist(), ends[lo:hi][keep].tolist(), strict=True))
                    for column, v in zip(out, (int(hi - lo), int((~keep).sum()), hashlib.sha256(body).hexdigest(), body), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(ranges, ["d", "r"], "left").select("doc_id", "text", "ranges").mapInArrow(emit, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
