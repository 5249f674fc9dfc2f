"""Near-duplicate documents: ProbMinHash signatures over weighted word shingles, banding, exact verification.

A document's shingles are its runs of five words, weighted by 1 + ln(count). Every shingle is a Poisson process whose rate
is its weight: its arrivals, drawn from hashes of the shingle alone, fall into random registers, and a register keeps the
shingle of its first arrival. Two documents agree in a register with the probability Jaccard similarity of their weighted
sets. A process stops as soon as its next arrival is later than every register's first (early termination), so a document
costs little more than one arrival a shingle.

512 registers are taken as 64 bands of 8. Links are verified by the Jaccard similarity of the shingle sets, which weights can
hold far above that of the weighted sets; so every document is also banded by registers of unit weight, which agree with
the probability of just that similarity: at 0.8 a pair shares no band with probability 8e-6, and less above, whatever its
counts are. Where all shingles of a document are equally frequent both kinds of registers are the same and taken once.
Equal texts are one representative. Representatives that share a band of either kind are linked by a star, connected
classes of these links are the candidate groups. A group is verified by growing classes: a document's exact Jaccard
similarity to all that are in no class yet is counted over an inverted list, and those near enough join its class and are
grown from in turn. What has joined leaves the list, so copies of one text cost one comparison each, and still no pair
that could link two classes is skipped. Only the spanning forest of the links leaves the task.

A group with more words than ``group_words`` is dealt out in blocks. Each block holds the group's pivot too; documents that
a block links to it, directly or not, need no other block to be joined. Only the rest is compared with all other blocks.
So no group is bounded by a task's memory, no pair is written out, and a text is shipped once more for each block of rest
documents, of which a group of near copies has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_classes
from .units import U64, Rolling, mix, text_blocks, word_codes, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 8
GROUP_WORDS = 3_000_000


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word codes, offsets of each document's words)."""
    starts, ends, at = words(data, offsets)
    return word_codes(data, starts, ends), at


def shingles(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles, sorted by document.

    A text of one to k - 1 words is a single shingle of all its words.
    """
    n_words = np.diff(at)
    many = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n_words)), many)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + at[doc]
    h = Rolling(codes).at(first, np.minimum(first + k, at[doc + 1])) if len(doc) else np.zeros(0, U64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], h[begin], np.diff(np.append(begin, len(doc)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) registers: the element whose exponential arrival is first; documents without elements stay 0.

    The j-th arrival of an element is drawn from a hash of the element and j, so many can be drawn at once: all that
    should fall before a bound by which most documents have an arrival in every register. Documents that have not go on
    with a later bound, and no element draws beyond its document's.
    """
    best = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, U64)
    state = mix(element ^ U64(0x5851F42D4C957F2D))
    rate = weight.astype(float)
    clock = np.zeros(len(doc))  # the last arrival at unit rate
    drawn = np.zeros(len(doc), np.int64)
    with np.errstate(divide="ignore"):
        bound = m * (np.log(m) + 1.0) / np.bincount(doc, rate, minlength=n_docs)
    open_ = np.ones(n_docs, bool)
    while True:
        on = np.flatnonzero(open_[doc])
        while len(on):
            end = bound[doc[on]] * rate[on]
            many = np.minimum(end - clock[on], 1 << 12).astype(np.int64) + 1
            head = np.cumsum(many) - many
            who = np.repeat(np.arange(len(on)), many)
            s = mix(state[on][who] + (np.arange(len(who)) - (head - drawn[on])[who] + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
            gap = -np.log(((s >> U64(32)).astype(float) + 0.5) * 2.0**-32)
            run = np.cumsum(gap)
            t = run + (clock[on] - (run[head] - gap[head]))[who]
            ok = t <= end[who]
            took = np.add.reduceat(ok, head, dtype=np.int64)
            some = took > 0
            clock[on[some]] = t[(head + took - 1)[some]]
            drawn[on] += took
            s, who = s[ok], on[who[ok]]
            t = t[ok] / rate[who]
            slot = doc[who] * m + ((s & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            owner[slot[won]] = element[who[won]]
            on = on[took == many]  # their next arrival may be before the bound too
        open_ = np.isinf(best.reshape(n_docs, m).max(1)) & np.isfinite(bound)
        if not open_.any():
            return owner.reshape(n_docs, m)
        bound[open_] *= 1.5


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(d, print1, print2, n_words, band hashes) of every document; the prints identify the word sequence.

    The bands of unit weight come first; those of the weighted registers follow where they differ.
    """
    m = bands * rows

    def banded(reg: np.ndarray) -> np.ndarray:
        seed = mix(np.arange(1, m + 1, dtype=U64))
        return mix((mix(reg ^ seed[None, :]).reshape(len(reg), bands, rows) * (mix(np.arange(1, rows + 1, dtype=U64)) | U64(1))).sum(2, dtype=U64) + np.arange(bands, dtype=U64)[None, :])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1), 1 << 20, 256):
                codes, at = coded(data, offsets)
                n_words = np.diff(at)
                doc, h, count = shingles(codes, at, k)
                band = np.zeros((j - i, 2 * bands), U64)
                use = np.zeros((j - i, 2 * bands), bool)
                band[:, :bands], use[:, :bands] = banded(prob_minhash(doc, h, np.ones(len(doc)), j - i, m)), True
                # Equal counts only scale the arrival times: the registers are those of unit weight.
                uneven = np.bincount(doc[count != count[np.searchsorted(doc, doc)]], minlength=j - i) > 0
                if uneven.any():
                    on = uneven[doc]
                    band[uneven, bands:] = banded(prob_minhash((np.cumsum(uneven) - 1)[doc[on]], h[on], 1.0 + np.log(count[on]), int(uneven.sum()), m))
                    use[uneven, bands:] = band[uneven, bands:] != band[uneven, :bands]
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)), pa.array(band[use].view(np.int64)))
                p1 = Rolling(codes).at(at[:-1], at[1:])
                placed = mix(codes + (np.arange(len(codes)) - np.repeat(at[:-1], n_words)).astype(U64))
                p2 = np.add.reduceat(np.append(placed, U64(0)), at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), pa.array(n_words.astype(np.int64)), listed],
                    names=["d", "print1", "print2", "n_words", "bands"],
                )

    return docs.select("d", "text").mapInArrow(emit, "d long, print1 long, print2 long, n_words long, bands array<long>")


def verified_forest(rows: pd.DataFrame, k: int, least: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the pairs of documents with shingle Jaccard of ``least`` or more; a < b.

    rows: d and text, plus side (0 or 1) if ``cross``: then two documents of side 1 are not compared.
    """
    rows = rows.drop_duplicates("d")
    ids = rows["d"].to_numpy()
    n = len(ids)
    doc, h = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for i, _, data, offsets in text_blocks(pa.array(rows["text"], pa.string())):
        a, b, _ = shingles(*coded(data, offsets), k)
        doc.append(a + i)
        h.append(b)
    doc, h = np.concatenate(doc), np.concatenate(h)
    size = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size)])
    term = np.unique(h, return_inverse=True)[1].reshape(-1)
    side = rows["side"].to_numpy() if cross else None
    free = size > 0  # in no class yet

    def inverted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of the free documents by term, numbered anew: (documents, list ends by term, numbers)."""
        alive = np.flatnonzero(free)
        number = np.full(n, -1)
        number[alive] = np.arange(len(alive))
        on = free[doc]
        order = np.argsort(term[on], kind="stable")
        return number[doc[on]][order], np.concatenate([[0], np.cumsum(np.bincount(term[on], minlength=int(term.max()) + 1 if len(term) else 0))]), alive

    post, head, alive = inverted()
    listed, left = len(alive), int(free.sum())
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for seed in range(n):
        if not free[seed]:
            continue
        grow = [seed]
        free[seed] = False
        left -= 1
        while grow and left:
            if left * 2 < listed:
                post, head, alive = inverted()
                listed = left
            i = grow.pop()
            t = term[begin[i] : begin[i + 1]]
            lo, many = head[t], head[t + 1] - head[t]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            both = np.bincount(post[at], minlength=listed)
            near = alive[both >= np.maximum(1, least * (size[alive] + size[i] - both) - 1e-9)]
            near = near[free[near]]
            if cross:
                near = near[(side[near] == 0) | (side[i] == 0)]
            if len(near):
                free[near] = False
                left -= len(near)
                out.append((np.full(len(near), i), near))
                grow += near.tolist()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (ids[np.concatenate(x)] for x in zip(*out, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def joined_to(pivot: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``ids`` the links (a, b) join to the pivot."""
    seen, beside = {pivot}, {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        beside.setdefault(x, []).append(y)
        beside.setdefault(y, []).append(x)
    grow = [pivot]
    while grow:
        for y in beside.get(grow.pop(), ()):
            if y not in seen:
                seen.add(y)
                grow.append(y)
    return np.isin(ids, np.array(sorted(seen)))


def near_duplicates(spark: SparkSession, documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Classes of documents linked by a shingle similarity of ``similarity`` or more, directly or through others.

    Returns one row per input row: doc_id, class_id (the least doc_id of its class), class_size (rows), kept (true for one
    row of each class) and row_key (equal for repeated rows only). Null and blank texts have no shingles and are classes of
    their own; equal word sequences are one class; repeated rows too. Different texts of one doc_id are documents of their
    own, as are texts without a doc_id. Extra columns are ignored.
    """
    scratch = Scratch(spark, "near-dup")
    docs = row_keys(documents, scratch).select("d", "doc_id", "text")
    signed = scratch.put(signatures(docs, shingle, bands, rows), "signed")
    # Sides that are aggregates are written, so a join with a hot key reads two exchanges and can be split.
    prints = signed.where("n_words > 0").select("d", "print1", "print2", "n_words")
    reps = scratch.put(prints.groupBy("print1", "print2").agg(F.min("d").alias("rep")), "prints")
    of = scratch.put(prints.join(reps, ["print1", "print2"]).select("d", "rep", "n_words"), "representatives")
    banded = signed.join(of.where("d = rep").select("d").distinct(), "d", "left_semi").select("d", F.explode("bands").alias("band"))
    stars = scratch.put(banded.groupBy("band").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("band", "a"), "stars")
    linked = banded.join(stars, "band").where("d <> a").select("a", F.col("d").alias("b")).distinct()
    group = scratch.put(connected_classes(linked, scratch, "candidates"), "groups")
    sized = group.join(of.where("d = rep").select(F.col("d").alias("node"), "n_words").distinct(), "node")
    blocks = scratch.put(sized.groupBy("root").agg(F.ceil(F.sum("n_words") / group_words).cast("int").alias("blocks")), "blocks")
    member = sized.join(blocks, "root").select(F.col("node").alias("d"), "root", "blocks", "n_words", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    member = scratch.put(member.join(docs.select("d", "text"), "d").dropDuplicates(["d"]), "members")

    def whole(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        a, b = verified_forest(rows_, shingle, similarity, False)
        return pd.DataFrame({"a": a, "b": b})

    forest = member.where("blocks = 1").groupBy("root").applyInPandas(whole, "a long, b long")
    # A large group: each block with the pivot, the group's least document, which is a row of every block.
    large = member.where("blocks > 1")
    pivots = large.where("d = root").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))

    def one_block(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        a, b = verified_forest(rows_, shingle, similarity, False)
        ids = rows_["d"].unique()
        rest = ids[~joined_to(key[0], ids, a, b)]
        return pd.DataFrame({"a": [*a, *rest], "b": [*b, *rest]})  # a link to itself marks a document that isn't joined

    dealt = large.where("d <> root").unionByName(pivots)
    first = scratch.put(dealt.groupBy("root", "block").applyInPandas(one_block, "a long, b long"), "in-blocks")
    rest = first.where("a = b").select(F.col("a").alias("d"))
    rest = scratch.put(large.join(rest, "d", "left_semi"), "rest")
    parts = rest.groupBy("root").agg(F.ceil(F.sum("n_words") / group_words).cast("int").alias("parts"))
    rest = rest.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("d", F.lit(1)), F.col("parts")).cast("int"))
    here = rest.select("root", "d", "text", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"))
    there = large.join(parts, "root").select("root", F.col("d"), "text", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "block", F.lit(1).alias("side"))

    def across(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        # A rest document of this block stands on both sides: the first, that of the rest, stays.
        a, b = verified_forest(rows_.sort_values("side"), shingle, similarity, True)
        return pd.DataFrame({"a": a, "b": b})

    crossed = here.unionByName(there).groupBy("root", "part", "block").applyInPandas(across, "a long, b long")
    links = scratch.put(forest.unionByName(first.where("a <> b")).unionByName(crossed), "links")
    classes = scratch.put(connected_classes(links, scratch, "classes"), "classes")
    named = of.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d", F.coalesce("root", "rep").alias("class_key")).distinct()
    named = scratch.put(docs.select("d", "doc_id").join(named, "d", "left").withColumn("class_key", F.coalesce("class_key", "d")), "named")
    sizes = scratch.put(named.groupBy("class_key").agg(F.count("*").alias("class_size"), F.min("doc_id").alias("class_id")), "sizes")
    scratch.keep("named", "sizes")
    # Only rows of the class's own key compete for being kept: repeated rows of one document, never a whole class.
    number = F.row_number().over(Window.partitionBy("d").orderBy("d"))
    head = named.where("d = class_key").withColumn("kept", number == 1)
    tail = named.where("d <> class_key").withColumn("kept", F.lit(False))
    return head.unionByName(tail).join(sizes, "class_key").select("doc_id", "class_id", "class_size", "kept", F.col("d").alias("row_key"))


BIG = 1 << 62


def row_keys(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``d``, equal for repeated rows only: the doc_id, or, after all of those, a hash for rows without one and
    for all but one of the texts that share a doc_id."""
    text = F.col("text").cast("string")
    rest = F.lit(BIG) + F.xxhash64("doc_id", "t").bitwiseAND(F.lit(BIG // 2 - 1))
    rows = documents.withColumns({"text": text, "t": F.xxhash64(F.coalesce(text, F.lit("")))})
    shared = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 < t1")
    shared = scratch.put(shared.select(F.col("doc_id").alias("shared_id"), "t0"), "shared-ids")
    rows = rows.join(shared, F.col("doc_id") == F.col("shared_id"), "left")
    own = F.col("doc_id").isNotNull() & (F.col("t0").isNull() | (F.col("t0") == F.col("t")))
    return rows.withColumn("d", F.when(own, F.col("doc_id").cast("long")).otherwise(rest)).drop("shared_id", "t0", "t")
