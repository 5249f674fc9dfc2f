"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ranges divided.

Records are ordered by (hash of the text, doc_id, a number of the row), so equal texts are neighbours and no two records
are equal. A sample drawn with a probability in proportion to size gives boundaries of ``oversample`` ranges a shard. The
ranges' exact sizes are counted; a range over twice its share is sampled again and divided, until none is. Exact running
sizes then come from the ranges' totals plus a running sum inside each range, never from one sort of everything, and cut
the order into shards of equal bytes.

Equal texts stay together. Groups of a hundredth of a shard or more, of which there can't be more than a hundred a shard, are
first dealt to the shards with the most room, largest first; what room is left in each shard is filled in the order of the
ranges, with a small group counted by its middle. Only a group that no shard has room for is cut like other records.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 16
OVERSAMPLE = 16
#: Samples a range, each time that boundaries are drawn; the driver holds samples and boundaries only.
SAMPLES = 32
#: Groups of equal texts of so much of a shard or more are dealt one by one: 1 / LARGE of them a shard at most.
LARGE = 0.01

Key = tuple[int, int, int]
FIRST = -(1 << 63)


def range_number(bounds: list[Key]) -> Column:
    """Number of boundaries at or before (k, d, u), by bisection of a constant array."""
    if not bounds:
        return F.lit(0)
    constant = lambda part: F.split(F.lit(",".join(str(b[part]) for b in bounds)), ",").cast("array<bigint>")  # noqa: E731  folded once
    parts = [(constant(i), F.col(c)) for i, c in enumerate("kdu")]

    def halve(a: Column, _: Column) -> Column:
        m = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        (ks, k), (ds, d), (us, u) = ((F.get(xs, m), x) for xs, x in parts)
        before = (ks < k) | ((ks == k) & ((ds < d) | ((ds == d) & (us <= u))))
        return F.when(a["lo"] >= a["hi"], a).when(before, F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda a: a["lo"])


def _quantiles(samples: list[tuple[int, int, int, float]], pieces: int, inside: bool = False) -> list[Key]:
    """Boundaries of ``pieces`` runs of equal weight. A text hash that is cut once is cut before its first record, unless
    ``inside``: then cuts stay where they fall."""
    total, run, out = sum(w for *_, w in samples), 0.0, []
    for k, d, u, w in sorted(samples):
        if run >= total * (len(out) + 1) / pieces and len(out) + 1 < pieces:
            out.append((k, d, u))
        run += w
    if inside:
        return out
    times = Counter(k for k, *_ in out)
    return sorted({b if times[b[0]] > 1 else (b[0], FIRST, FIRST) for b in out} | {(k, FIRST, FIRST) for k, n in times.items() if n > 1})


def deal(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[float]]:
    """(shard of each group that one has room for, bytes left in each shard); groups: (text hash, bytes)."""
    room = [(-total / shards, s) for s in range(shards)]
    placed = {}
    for k, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        left, s = -room[0][0], room[0][1]
        if size <= left:
            heapq.heapreplace(room, (size - left, s))
            placed[k] = s
    return placed, [-r for r, _ in sorted(room, key=lambda x: x[1])]


def place(spark: SparkSession, documents: DataFrame, shards: int = SHARDS, oversample: int = OVERSAMPLE, samples: int = SAMPLES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard and the ``carry`` columns.

    law is ``bytes``: shard sizes differ by no more than the largest record plus a hundredth of a shard, or a small group of
    equal texts. Rows of equal texts are in one shard, but for a group that is larger than what a shard has room for. Size is
    the UTF-8 bytes of the text (null: none) plus 1; text_crc32 of a null text is that of an empty one. Slots count from 0
    without gaps in each shard. grown_shard is null: only the law ``key`` has it. Null doc_ids order last, extra columns are
    ignored, and an empty table gives no rows. Rows equal in both keys are ordered arbitrarily.
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    extra = [F.col(c).alias(f"carry_{c}") for c in carry]
    last = [F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"carry_{c}").alias(c) for c in carry]]
    rows = documents.select(F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), *extra)
    rows = scratch.put(rows.withColumn("u", F.monotonically_increasing_id()), "rows")  # written, so that u stays what it is
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *last)
    share = total / (shards * oversample)

    def draw(df: DataFrame, bytes_: float, count: int, seed: int) -> list[tuple[int, int, int, float]]:
        rate = count / max(1.0, bytes_)
        chance = F.pmod(F.xxhash64("k", "d", "u", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return [(r.k, r.d, r.u, max(r.size, 1 / rate)) for r in df.where(chance < F.col("size") * rate).select("k", "d", "u", "size").collect()]

    bounds = _quantiles(draw(rows, total, shards * oversample * samples, 0), shards * oversample)
    seed = still = 0
    while True:
        numbered = rows.withColumn("range", range_number(bounds))
        found = numbered.groupBy("range").agg(F.sum("size").alias("size"), F.max("size").alias("most")).collect()
        sizes = {r.range: r.size for r in found}
        full = [r.range for r in found if r.size > 2 * share + r.most]
        if not full or still == 3:  # three draws without a new boundary: what is left are a few large records
            break
        seed += 1
        excess = sum(sizes[r] for r in full)
        drawn: dict[int, list] = {}
        for k, d, u, w in draw(numbered.where(F.col("range").isin(full)), excess, samples * int(excess / share + 1), seed):
            drawn.setdefault(bisect.bisect_right(bounds, (k, d, u)), []).append((k, d, u, w))
        new: set[Key] = set()
        for r, x in drawn.items():
            pieces = int(sizes[r] / share) + 2
            # A range that begins with its only text can be cut between that text's records only.
            new |= set(_quantiles(x, pieces)).difference(bounds) or set(_quantiles(x, pieces, True)).difference(bounds)
        still = 0 if new else still + 1
        bounds = sorted(new.union(bounds))
    # Groups that are dealt whole, and the bytes of other records before each range.
    many = rows.groupBy("k").agg(F.sum("size").alias("size")).where(F.col("size") >= LARGE * total / shards)
    placed, room = deal([(r.k, r.size) for r in many.collect()], shards, total)
    home = spark.createDataFrame(list(placed.items()), "k long, home int")
    numbered = numbered.join(F.broadcast(home), "k", "left")  # shards / LARGE rows at most
    rest = {r.range: r.size for r in numbered.where("home IS NULL").groupBy("range").agg(F.sum("size").alias("size")).collect()}
    before = [0, *itertools.accumulate(rest.get(r, 0) for r in range(len(bounds)))]
    start = spark.createDataFrame(list(enumerate(before)), "range int, before long")
    numbered = numbered.join(F.broadcast(start), "range")
    by_range = Window.partitionBy("range").orderBy("k", "d", "u").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("free", F.when(F.col("home").isNull(), F.col("size")).otherwise(0)).withColumn("end", F.col("before") + F.sum("free").over(by_range))
    group = Window.partitionBy("range", "k")
    numbered = numbered.withColumn("g_size", F.sum("size").over(group)).withColumn("g_end", F.max("end").over(group))
    middle = F.when(F.col("g_size") < LARGE * total / shards, F.col("g_end") - F.col("g_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    ends = F.array(*[F.lit(float(e)) for e in itertools.accumulate(room[:-1])])
    numbered = numbered.withColumn("shard", F.coalesce("home", F.size(F.filter(ends, lambda e: e <= middle))))
    numbered = numbered.withColumn("at", F.row_number().over(Window.partitionBy("range", "shard").orderBy("k", "d", "u")))
    out = scratch.put(numbered.drop("before", "end", "g_size", "g_end", "free", "home"), "placed")
    scratch.keep("placed")
    counts = out.groupBy("shard", "range").count().collect()
    begin, run = [], {}
    for r in sorted(counts, key=lambda r: (r.shard, r.range)):
        begin.append((r.shard, r.range, run.get(r.shard, 0)))
        run[r.shard] = run.get(r.shard, 0) + r["count"]
    offsets = F.broadcast(spark.createDataFrame(begin, "shard int, range int, first long"))  # a row a range and shard
    return out.join(offsets, ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), *last)
