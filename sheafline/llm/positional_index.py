"""Benchmark decontamination: a distributed positional inverted index, intersected from the rarest test terms.

One pass over the corpus stores the index: for each document the postings of its test terms, that is for every term the
sorted positions where it stands. The table is partitioned by document, so a phrase, which never crosses documents, is
intersected where its postings are, and a hot term's list is spread over all partitions. A phrase starts from its rarest
term (by the frequency of every test term in the index): that list, less the term's offset in the phrase, is intersected
with the next rarer term's list, less its offset, and so on, until it is empty or every term has matched.

Test phrases are taken in blocks of bounded size; every block reads the index, never the texts. What a task holds besides
are the codes of all test terms, eight bytes each.

:func:`decontaminate` returns exact phrase matches by document, :func:`proximity` those documents and places where all
terms of a phrase, as often as it has them, stand within a span, in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .units import covered, text_blocks, word_codes, words

WINDOW = 13
#: Terms of test phrases that one block holds: about 100 MB.
BLOCK_TERMS = 1_000_000
#: Different test terms that the index may have: 160 MB of codes. More are an error, not a cut.
MAX_TERMS = 20_000_000

#: Word bytes: digits, lower-case letters and every byte of a non-ASCII character; A-Z count as a-z.
SEPARATOR = np.ones(256, bool)
SEPARATOR[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the words, offsets of each text's words)."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, SEPARATOR)
    return word_codes(data, starts, ends), at


class Phrases:
    """Test phrases of one block: every ``window`` consecutive words of an item, or all words of a shorter item."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, vocabulary: np.ndarray) -> None:
        """vocabulary: the sorted codes of all test terms, of which the index has the places."""
        column = pa.array([t for _, t in items], pa.string())
        self.ids = [str(i) for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for i, _, data, offsets in text_blocks(column):
            codes, at = tokens(data, offsets)
            listed = codes.tolist()
            for k in range(len(at) - 1):
                w = listed[at[k] : at[k + 1]]
                for p in range(max(1, len(w) - window + 1) if w else 0):
                    found.setdefault(tuple(w[p : p + window]), set()).add(i + k)
        self.items = [sorted(x) for x in found.values()]
        self.terms = [np.searchsorted(vocabulary, np.array(w, np.uint64)).astype(np.int32) for w in found]

    def order_by(self, frequency: np.ndarray) -> None:
        """Offsets of each phrase's terms, rarest first; phrases grouped by their rarest term."""
        self.order = [np.argsort(frequency[t], kind="stable") for t in self.terms]
        first = np.array([t[o[0]] for t, o in zip(self.terms, self.order, strict=True)], np.int64)
        self.by_first: dict[int, list[int]] = {}
        for k, t in enumerate(first.tolist()):
            self.by_first.setdefault(t, []).append(k)
        width = max((len(t) for t in self.terms), default=1)
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.offset = np.full((len(self.terms), width), 0, np.int64)
        self.term = np.full((len(self.terms), width), -2, np.int32)
        for k, (t, o) in enumerate(zip(self.terms, self.order, strict=True)):
            self.offset[k, : len(o)], self.term[k, : len(o)] = o, t[o]

    def needs(self) -> None:
        """Distinct terms of each phrase with their counts, rarest first."""
        listed = [[*dict.fromkeys(t[o].tolist())] for t, o in zip(self.terms, self.order, strict=True)]
        self.need = [{x: int((t == x).sum()) for x in xs} for t, xs in zip(self.terms, listed, strict=True)]
        width = max((len(x) for x in listed), default=1)
        self.distinct = np.full((len(listed), width), -2, np.int64)
        self.times = np.zeros((len(listed), width), np.int64)
        for k, n in enumerate(self.need):
            self.distinct[k, : len(n)], self.times[k, : len(n)] = list(n), list(n.values())


class Postings:
    """Postings of a run of documents: keys of (term, position) in order, positions counted through all documents."""

    def __init__(self, n_words: np.ndarray, many: np.ndarray, term: np.ndarray, place: np.ndarray) -> None:
        """n_words and many: words and postings of each document; term and place: of each posting."""
        self.offsets = np.concatenate([[0], np.cumsum(n_words)])
        at = place + np.repeat(self.offsets[:-1], many)
        self.base = int(self.offsets[-1]) + 1
        key = term.astype(np.int64) * self.base + at
        order = np.argsort(key)
        self.key, self.term, self.position = key[order], term[order], at[order]

    def present(self) -> np.ndarray:
        return self.term[np.flatnonzero(np.diff(self.term, prepend=-1))]

    def of(self, term: int) -> np.ndarray:
        a, b = np.searchsorted(self.key, [term * self.base, (term + 1) * self.base])
        return self.position[a:b]

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list: one step of an intersection, by bisection of the list."""
        want = term.astype(np.int64) * self.base + at
        k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return self.key[k] == want

    def phrases(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence inside one document."""
        which, start = [], []
        for t in self.present().tolist():
            if ks := p.by_first.get(t):
                ks, at = np.array(ks), self.of(t)
                which.append(np.repeat(ks, len(at)))
                start.append((at[None, :] - p.offset[ks, 0][:, None]).reshape(-1))
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, s = np.concatenate(which), np.concatenate(start)
        doc = np.searchsorted(self.offsets, s + p.offset[w, 0], "right") - 1  # of the rarest term
        ok = (s >= self.offsets[doc]) & (s + p.size[w] <= self.offsets[doc + 1])
        w, s = w[ok], s[ok]
        for k in range(1, p.term.shape[1]):  # the next rarer list, shifted by its offset
            if not len(w):
                break
            t = p.term[w, k]
            ok = t == -2  # the phrase has no more terms
            ok[~ok] = self.holds(t[~ok], s[~ok] + p.offset[w[~ok], k])
            w, s = w[ok], s[ok]
        return w, s

    def near(self, p: Phrases, span: int) -> set[tuple[int, int, int]]:
        """(phrase, first, last) of every minimal interval of at most ``span`` words of one document that holds all terms.

        Each holds an occurrence of the phrase's rarest term; those with too few of another term within reach, rarest
        first, are dropped, and a window slides over the merged lists around the others.
        """
        which, middle = [], []
        for t in self.present().tolist():
            if ks := p.by_first.get(t):
                at = self.of(t)
                which.append(np.repeat(np.array(ks), len(at)))
                middle.append(np.tile(at, len(ks)))
        if not which:
            return set()
        w, m = np.concatenate(which), np.concatenate(middle)
        doc = np.searchsorted(self.offsets, m, "right") - 1
        lo, hi = np.maximum(m - span + 1, self.offsets[doc]), np.minimum(m + span, self.offsets[doc + 1])
        n, key = self.base, self.key
        for k in range(p.distinct.shape[1]):
            if not len(w):
                break
            t = p.distinct[w, k]
            many = np.searchsorted(key, t * n + hi) - np.searchsorted(key, t * n + lo)
            ok = (t == -2) | (many >= p.times[w, k])
            w, lo, hi = w[ok], lo[ok], hi[ok]
        term_of = np.full(self.base, -1, np.int64)  # the merged lists in the order of their positions
        term_of[self.position] = self.term
        out: set[tuple[int, int, int]] = set()
        for k, a, b in zip(w.tolist(), lo.tolist(), hi.tolist(), strict=True):
            need, have, missing, window, first = p.need[k], {}, len(p.need[k]), term_of[a:b].tolist(), 0
            for last, t in enumerate(window):
                if t not in need:
                    continue
                have[t] = have.get(t, 0) + 1
                missing -= have[t] == need[t]
                if missing:
                    continue
                while (x := window[first]) not in need or have[x] > need[x]:
                    if x in need:
                        have[x] -= 1
                    first += 1
                if have[t] == need[t] and last - first < span:  # else a shorter interval ends before
                    out.add((k, a + first, a + last))
        return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in runs of about ``limit`` words; read row by row, never all at once."""
    held, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((r.item_id, r.text))
        size += len((r.text or "").split()) * WINDOW
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def vocabulary_of(benchmark: DataFrame, limit: int = MAX_TERMS) -> np.ndarray:
    """Sorted codes of all test terms; aggregated where the items are, so the driver gets eight bytes a term."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(tokens(data, offsets)[0]).view(np.int64))], names=["code"])

    codes = benchmark.select(F.col("text").cast("string")).mapInArrow(emit, "code long").distinct()
    if codes.count() > limit:
        raise ValueError(f"the test items have more than {limit} different terms: split them")
    return np.sort(np.array([r.code for r in codes.toLocalIterator()], np.int64).view(np.uint64))


def index(docs: DataFrame, shared: Broadcast, carry: tuple[str, ...] = ()) -> DataFrame:
    """Postings of every document: doc_id, row, n_words, and (term, place) sorted by both as little-endian 32-bit pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                codes, at = tokens(data, offsets)
                if len(vocabulary):
                    k = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
                    found = np.flatnonzero(vocabulary[k] == codes)
                else:
                    found = k = np.zeros(0, np.int64)
                doc = np.searchsorted(at, found, "right") - 1
                pairs = np.stack([k[found], found - at[doc]], 1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], doc))].astype("<i4")
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]) * 8
                listed = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])
                same = [batch.column(k).slice(i, j - i) for k in (0, 1, *range(3, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(np.diff(at)), listed, *same[2:]], names=["doc_id", "row", "n_words", "postings", *batch.schema.names[3:]])

    return docs.select("doc_id", "row", F.col("text").cast("string").alias("text"), *carry).mapInArrow(emit, f"doc_id {kind}, row long, n_words long, postings binary{_kinds(docs, carry)}")


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Postings]]:
    """(first row, last row + 1, postings) of runs of the stored index's rows."""
    n_words = batch.column("n_words").to_numpy()
    for i, j, data, offsets in text_blocks(batch.column("postings")):
        pairs = np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2)
        yield i, j, Postings(n_words[i:j], np.diff(offsets) // 8, pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64))


def term_frequencies(stored: DataFrame, n: int) -> np.ndarray:
    """How often each test term stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, _, data, _ in text_blocks(batch.column(0)):
                total += np.bincount(np.frombuffer(data.tobytes(), "<i4")[::2], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(n, np.int64)
    for r in stored.select("postings").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


MATCH = "n_words long, ranges array<struct<s:int,e:int>>, items array<string>"


def _match(stored: DataFrame, shared: Broadcast, carry: tuple[str, ...]) -> DataFrame:
    """Each document of the index with its word count, the word ranges of phrases and the items found."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    ranges_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            ranges, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for i, _, postings in _runs(batch):
                w, s = postings.phrases(p)
                at = postings.offsets
                doc = np.searchsorted(at, s, "right") - 1
                for k, x, d in zip(w.tolist(), s.tolist(), doc.tolist(), strict=True):
                    ranges[i + d].append({"s": x - int(at[d]), "e": x - int(at[d]) + int(p.size[k])})
                    items[i + d].update(p.ids[y] for y in p.items[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_words"), pa.array(ranges, ranges_type), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *batch.columns[4:]], names=["doc_id", "row", "n_words", "ranges", "items", *batch.schema.names[4:]])

    return stored.mapInArrow(emit, f"doc_id {kind}, row long, {MATCH}{_kinds(stored, carry)}")


def _digest(matched: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    kind = matched.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, count, sha = [], [], []
            for n, ranges, items in zip(batch.column("n_words").to_pylist(), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hits.append(int(covered(np.array([x["s"] for x in ranges]), np.array([x["e"] for x in ranges]), n).sum()) if ranges else 0)
                count.append(len(items))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), *batch.columns[3:]], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", *batch.schema.names[3:]])

    out = matched.select("doc_id", "n_words", "ranges", "items", *carry).mapInArrow(emit, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>{_kinds(matched, carry)}")
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_terms: int = BLOCK_TERMS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Exact test phrases in every document.

    Returns one row per input row: doc_id, n_words, n_hit (words inside a test phrase), n_items and items (those with a
    phrase here, sorted as strings), items_sha256, contaminated (a twentieth of the words or more are hit). A null or
    empty text has no words and is never contaminated; null, empty and repeated items are harmless; an item of fewer than
    ``window`` words is one phrase. Other columns than those in ``carry`` are ignored. An empty benchmark gives rows without hits.
    """
    held = tuple(f"carry_{c}" for c in carry)
    documents = documents.select("doc_id", "text", *[F.col(c).alias(f"carry_{c}") for c in carry])
    stored, blocks = _stored(spark, documents, benchmark, window, block_terms, held)
    # A row's number joins the results of several blocks; one block, the usual case, needs no join.
    total, scratch = None, Scratch(spark, "phrase-matches")
    for k, shared in enumerate(blocks):
        found = _match(stored, shared, held)
        if total is not None:
            more = found.where("size(ranges) > 0").select("row", F.col("ranges").alias("r2"), F.col("items").alias("i2"))
            found = scratch.put(total.join(more, "row", "left").select("doc_id", "row", "n_words", F.expr("if(r2 IS NULL, ranges, concat(ranges, r2))").alias("ranges"), F.expr("if(i2 IS NULL, items, array_union(items, i2))").alias("items"), *held), f"{k}")
        total = found
    return _digest(total, held).withColumnsRenamed(dict(zip(held, carry, strict=True)))


def _stored(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int, block_terms: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Iterator[Broadcast]]:
    """The stored index, and the test phrases block by block, of bounded size each."""
    vocabulary = vocabulary_of(benchmark)
    docs = documents.select("doc_id", "text", *carry).withColumn("row", F.monotonically_increasing_id())
    stored = Scratch(spark, "positional-index").put(index(docs, spark.sparkContext.broadcast(vocabulary), carry), "postings")
    frequency = term_frequencies(stored, len(vocabulary))

    def blocks() -> Iterator[Broadcast]:
        some = False
        for items in _blocks(benchmark, block_terms):
            some = True
            yield ordered(items)
        if not some:
            yield ordered([])

    def ordered(items: list) -> Broadcast:
        p = Phrases(items, window, vocabulary)
        p.order_by(frequency)
        return spark.sparkContext.broadcast(p)

    return stored, blocks()


def proximity(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, span: int = 20, window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(doc_id, item_id as string, start, end): places where all terms of a test phrase stand within ``span`` words.

    Order is free; a term that the phrase has twice must stand there twice. Each place is a minimal covering interval: none
    inside it holds all terms. Null texts have none; repeated rows give equal rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    stored, blocks = _stored(spark, documents, benchmark, window, block_terms)
    out = None
    for shared in blocks:

        def emit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            p.needs()
            for batch in batches:
                ids = batch.column("doc_id")
                rows: list[tuple] = []
                for i, _, postings in _runs(batch):
                    at = postings.offsets
                    found: set[tuple[int, object, int, int]] = set()
                    for k, s, e in postings.near(p, span):
                        d = int(np.searchsorted(at, s, "right")) - 1
                        found |= {(i + d, p.ids[x], s - int(at[d]), e + 1 - int(at[d])) for x in p.items[k]}
                    rows += [(ids[x[0]].as_py(), *x[1:]) for x in sorted(found)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids.type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "start", "end"])

        part = stored.mapInArrow(emit, f"doc_id {kind}, item_id string, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out
