"""Substring de-duplication by bytes: suffix arrays by linear grouping.

The suffix array is built by grouping on Lyndon prefixes. Phase one takes groups of suffixes in descending order; for each
suffix a pointer to the nearest earlier suffix of a smaller group is found, and the suffixes pointed at are moved up inside
their groups by how often they are pointed at. Then groups are the classes of equal Lyndon prefix in lexicographic order.
Phase two walks the array upwards and emits each predecessor chain at the front of its group. No renaming recursion.

Here it runs over the contexts of a group: byte strings that share a prefix of variable length (their core) and stand
aligned on it. The strings are cut where two neighbours in order part from each other on either side, so equal segments are
single symbols and an array over a few symbols stands for hundreds of bytes; every longest match begins and ends at a cut. Longest common prefixes of
neighbours in the array then give the farthest match for each start, and matches of the window's length are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import GROUP, RUNS, candidates, code_runs, keyed, matched, runs_of
from .units import BYTE_CODES, U64, Rolling, mix, powers

WINDOW = 200
GRAM = 100


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Positions of the suffixes of ``symbols`` (non-negative integers) in lexicographic order; shorter first on ties."""
    n = len(symbols)
    if n == 0:
        return []
    s = np.asarray(symbols, np.int64)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    heads = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    sizes = np.diff(np.concatenate([heads, [n]]))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, sizes)
    place: list[int] = np.empty(n, np.int64).tolist()
    area: list[int] = order.tolist()  # suffixes, group after group
    for k, i in enumerate(area):
        place[i] = k
    group = group.tolist()
    size = [0] * n  # of the group that begins here
    for h, z in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[h] = z
    before = [-1] * n
    end = n
    while end > 0:
        start = group[area[end - 1]]
        members = area[start:end]
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            levels: dict[int, list[int]] = {}
            for j, c in count.items():
                levels.setdefault(c, []).append(j)
            for c in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for j in levels[c]:  # to the end of its group
                    g = group[j]
                    m = moved.get(g, 0)
                    to = g + size[g] - 1 - m
                    k, other = place[j], area[to]
                    area[k], area[to] = other, j
                    place[other], place[j] = k, to
                    moved[g] = m + 1
                for g, m in moved.items():
                    rest = size[g] - m
                    if rest:
                        size[g] = rest
                        new = g + rest
                        size[new] = m
                        for k in range(new, new + m):
                            group[area[k]] = new
        end = start
    # Phase two.
    out = [-1] * n
    front = list(range(n))
    done = [False] * n

    def chain(j: int) -> None:
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = before[j]

    chain(n - 1)  # the empty suffix comes first of all
    for k in range(n):
        if out[k] > 0:
            chain(out[k] - 1)
    return out


def common_prefixes(symbols: Sequence[int], array: list[int]) -> list[int]:
    """lcp[k]: symbols that the suffixes at places k - 1 and k of the array share; lcp[0] = 0."""
    n, h = len(array), 0
    rank, lcp = [0] * n, [0] * n
    for k, i in enumerate(array):
        rank[i] = k
    for i in range(n):
        if k := rank[i]:
            j = array[k - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            lcp[k] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return lcp


def _neighbours(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For neighbours in the order of the rows inside each group: both rows, and the lengths that they share, clipped to
    the rows' lengths and as padded (padding may look like text that holds zero bytes)."""
    n, width = rows.shape
    key = np.empty((n, width + 8), np.uint8)
    key[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    key[:, 8:] = rows
    order = np.argsort(key.reshape(-1).view(f"S{width + 8}"), kind="stable")
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    a, b = a[same], b[same]
    differ = rows[a] != rows[b]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    return a, b, np.minimum(shared, np.minimum(lengths[a], lengths[b])), shared


def _most(n: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest length that each row shares with a neighbour."""
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def array_solver(window: int, gram: int, runs: int = RUNS):
    """For matched: how far before and after the anchor repeated windows reach, for each context that has one.

    A group in memory is divided by longer prefixes too. What the pieces of a key share is one symbol, the core; a piece
    is the few bytes before it, the core and the few bytes after it. Equal pieces are one, and a key with one piece needs
    no comparison. The others go to the suffix array.
    """

    def solve(cols: dict[str, np.ndarray], raw: pa.ChunkedArray) -> dict[str, np.ndarray]:
        flat, begin, size = code_runs(raw, "byte")
        p = runs_of(cols, begin, size, Rolling(BYTE_CODES[flat]), window, runs)
        # Distinct pieces, ordered by key: ``one`` is a row of p for each, ``piece`` the piece of each row of p.
        order = np.lexsort((p["context"], p["key"]))
        key, context = p["key"][order], p["context"][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        n = np.bincount(piece, cols["n"][p["row"]], len(one))
        key = p["key"][one]
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(one) else np.zeros(0, np.int64)
        lo, hi = p["lo"][one], p["hi"][one]
        far_back, far_on = np.full(len(one), -1, np.int64), np.full(len(one), -1, np.int64)
        copies = n > 1  # the whole piece stands elsewhere too
        far_back[copies] = p["left"][one][copies]
        far_on[copies] = (p["end"] - p["start"] - p["left"])[one][copies]
        several = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        if len(several):
            pick = one[several]
            core = p["start"][pick] + p["left"][pick] - lo[several]  # where the shared bytes begin
            begun, ended = p["start"][pick], p["end"][pick]
            back, on = _reach(flat, begun, core, core + window - hi[several] + lo[several], ended, group[several], hi[several] - lo[several])
            hit = back >= 0
            at = several[hit]
            far_back[at] = np.maximum(far_back[at], lo[at] + back[hit])
            far_on[at] = np.maximum(far_on[at], window - hi[at] + on[hit])
        out_back, out_on = np.full(len(size), -1, np.int64), np.full(len(size), -1, np.int64)
        np.maximum.at(out_back, p["row"], far_back[piece])
        np.maximum.at(out_on, p["row"], far_on[piece])
        keep = out_back >= 0
        return {"key": cols["key"][keep], "context": cols["context"][keep], "back": out_back[keep].astype(np.int32), "reach": out_on[keep].astype(np.int32)}

    return solve


def _reach(flat: np.ndarray, begun: np.ndarray, core: np.ndarray, core_end: np.ndarray, ended: np.ndarray, group: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each string matches another of its group before and after the core, -1 and -1 if ``need`` bytes don't."""
    n, width = len(group), int(need.max()) + 1
    full_left, full_right = core - begun, ended - core_end
    body = np.zeros((n, 2 * width + 1), np.uint8)  # bytes before the core, the core's column, bytes after it

    def put(start: np.ndarray, many: np.ndarray, column: np.ndarray) -> None:
        row = np.repeat(np.arange(n), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        body[row, column[row] + k] = flat[start[row] + k]

    put(begun, full_left, width - full_left)
    put(core_end, full_right, np.full(n, width + 1))
    right_side = np.ascontiguousarray(body[:, width + 1 :])
    backward = np.ascontiguousarray(body[:, :width][:, ::-1])
    ra, rb, r, r_raw = _neighbours(right_side, full_right, group)
    la, lb, l, l_raw = _neighbours(backward, full_left, group)
    # Beyond what it shares with a neighbour in order a string shares nothing with any other of its group.
    right = np.minimum(_most(n, ra, rb, r_raw), full_right)
    left = np.minimum(_most(n, la, lb, l_raw), full_left)
    out_left, out_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    live = np.flatnonzero(left + right >= need)
    if len(live):
        after = width + 1
        marks = [(group[ra], after + r), (group[ra], after + r_raw), (group[la], width - l), (group[la], width - l_raw), (group, np.full(n, width)), (group, np.full(n, after))]
        out_left[live], out_right[live] = _by_array(body[live], group[live], left[live], right[live], need[live], marks, width)
    return out_left, out_right


def _by_array(body: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, need: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the suffix array of all strings; marks: (group, column) of cuts; the core's column is ``width``."""
    n, total = body.shape
    base, after = total + 1, width + 1
    cuts = np.unique(np.concatenate([*(g * base + c for g, c in marks), group * base + width - left, group * base + after + right]))
    cut = cuts % base
    lo = np.searchsorted(cuts, group * base + width - left)
    hi = np.searchsorted(cuts, group * base + after + right)
    many = hi - lo  # segments of each string
    who = np.repeat(np.arange(n), many)
    seg = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    up, down = powers(total + 1)
    sums = np.zeros((n, total + 1), U64)
    np.cumsum(BYTE_CODES[body] * up[:total], axis=1, dtype=U64, out=sums[:, 1:])
    content = mix((sums[who, cut[seg + 1]] - sums[who, cut[seg]]) * down[cut[seg]])
    symbol = np.unique(mix(content + seg.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True)[1].reshape(-1) + n + 1
    # One sequence: string after string, each ended by a symbol of its own.
    text = np.empty(len(who) + n, np.int64)
    at = np.arange(len(who)) + who
    text[at] = symbol
    text[np.cumsum(many + 1) - 1] = np.arange(n) + 1
    symbols = text.tolist()
    array = suffix_array(symbols)
    lcp = np.array([*common_prefixes(symbols, array), 0], np.int64)
    best = np.empty(len(symbols), np.int64)
    best[np.array(array, np.int64)] = np.maximum(lcp[:-1], lcp[1:])
    back = width - cut[seg]
    on = cut[seg + best[at]] - after
    ok = (back >= 0) & (on >= 0) & (back + on >= need[who]) & (best[at] > 0)
    far_back, far_on = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    np.maximum.at(far_back, who[ok], back[ok])
    np.maximum.at(far_on, who[ok], on[ok])
    return far_back, far_on


def repeated_ranges(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(d, r, ranges): byte ranges of each document covered by windows that also start elsewhere."""
    member, alone, several = candidates(docs, scratch, "byte", window, gram, False)
    # A group with one context: all windows through the anchor are repeated. Ranges are clipped at the text's ends later.
    one = lambda rows: rows.where("n > 1").select("key", "context", F.col("hi").alias("back"), (window - F.col("lo")).alias("reach"))
    array = matched(several, scratch, array_solver(window, gram), "key long, context long, back int, reach int", one, "byte", window, group)
    found = one(alone).unionByName(array).groupBy("key", "context").agg(F.max("back").alias("back"), F.max("reach").alias("reach"))
    found = scratch.put(found, "found")
    return (
        member.join(found, ["key", "context"])
        .select("d", "r", F.struct((F.col("at") - F.col("back")).alias("s"), (F.col("at") + F.col("reach")).alias("e")).alias("x"))
        .groupBy("d", "r")
        .agg(F.collect_set("x").alias("ranges"))
    )


def deduplicate(spark: SparkSession, documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts anywhere else in the documents.

    Texts are UTF-8 bytes, null is empty; overlaps count; matches don't cross documents. Returns one row per input row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept_bytes and spans (begin, end). Repeated
    rows are copies of each other, so their long texts go altogether. Columns other than doc_id and text are ignored.
    """
    docs = keyed(documents)
    scratch = Scratch(spark, "lyndon-suffix")
    ranges = scratch.put(repeated_ranges(docs, scratch, window, gram, group), "ranges")
    scratch.keep("ranges")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("ranges")
            out: list[list] = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                raw = texts[k].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                found = lists[k].as_py()
                spans: list[tuple[int, int]] = []
                for s, e in sorted((max(0, x["s"]), min(len(raw), x["e"])) for x in found or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                    else:
                        spans.append((s, e))
                kept, last = [], 0
                for s, e in spans:
                    kept.append(raw[last:s])
                    last = e
                body = b"".join([*kept, raw[last:]])
                for column, v in zip(out, (len(raw), len(raw) - len(body), len(spans), hashlib.sha256(body).hexdigest(), body, [{"begin": s, "end": e} for s, e in spans]), strict=True):
                    column.append(v)
            spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary()), pa.array(out[5], spans_type)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(ranges, ["d", "r"], "left").select("doc_id", "text", "ranges").mapInArrow(emit, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, spans array<struct<begin:int,end:int>>")
