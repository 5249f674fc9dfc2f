"""Toxicity: a linear-chain conditional random field tags toxic spans; forward-backward marginals make document scores.

Token labels come from the document labels of a bounded training sample: in toxic documents the tokens with a word or
prefix that stands in toxic documents far more often than in others are toxic tokens, all other tokens are clean. The field
learns words, prefixes and their neighbours from three of the four training folds. Chains are lines of any length; their
marginals are exact. A document's score is a logistic function of the sum of its squared marginals, to which thousands of
clean words add nothing, and of the largest marginal, fitted on the fourth fold, whose documents the field hasn't seen.
Every word of every text is scored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import ChainCRF
from .units import BYTE_CODES, U64, Rolling, mix, text_blocks, words

TABLE = 1 << 17
PREFIXES = (4, 5, 6)
#: At most so many training documents of each label, of at most so many bytes each.
TRAIN_EACH, TRAIN_BYTES = 1500, 10_000
#: A word or prefix marks toxic tokens if it is so many times likelier in toxic documents and the likelihood ratio of the
#: counts is beyond chance for as many words and prefixes as there are (error rate e**-5).
MARK_RATIO = 10.0

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: ASCII bytes that aren't letters or digits separate words here, so punctuation does not hide a word.
BREAK = np.ones(256, bool)
BREAK[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False


@dataclass
class Tokens:
    """Tokens of a block: byte ranges, the documents' offsets, chain offsets and feature codes (tokens, kinds)."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    chains: np.ndarray
    codes: np.ndarray


def tokenise(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = LOWER[data]
    starts, ends, at = words(data, offsets, BREAK)
    roll = Rolling(BYTE_CODES[data])
    columns = [roll.at(starts, ends)]
    columns += [mix(roll.at(starts, np.minimum(starts + k, ends)) + U64(k)) for k in PREFIXES]
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10), "left")
    return Tokens(starts, ends, at, np.unique(np.concatenate([at, breaks, [0, len(starts)]])), np.stack(columns, 1))


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each token: itself and its prefixes, a bias, and the words on both sides."""
    n = len(t.starts)
    inside = np.ones(n + 1, bool)
    inside[t.chains] = False
    word = t.codes[:, 0]
    before = np.where(inside[:n], np.roll(word, 1), U64(1))
    after = np.where(inside[1:], np.roll(word, -1), U64(2))
    table = np.empty((n, t.codes.shape[1] + 3), np.int64)
    table[:, : t.codes.shape[1]] = (t.codes % U64(TABLE - 1)).astype(np.int64) + 1
    table[:, -3] = 0
    table[:, -2] = (mix(before + U64(77)) % U64(TABLE - 1)).astype(np.int64) + 1
    table[:, -1] = (mix(after + U64(78)) % U64(TABLE - 1)).astype(np.int64) + 1
    return table.reshape(-1), np.arange(n + 1) * table.shape[1]


@dataclass
class Model:
    field: ChainCRF
    logistic: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, emit=self.field.emit, move=self.field.move, start=self.field.start, stop=self.field.stop, logistic=self.logistic)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            field = ChainCRF(2, 1)
            field.emit, field.move, field.start, field.stop = z["emit"], z["move"], z["start"], z["stop"]
            return Model(field, z["logistic"])

    def marginals(self, t: Tokens) -> np.ndarray:
        if not len(t.starts):
            return np.zeros(0)
        f, begin = features(t)
        return self.field.marginals(self.field.scores(f, begin), t.chains)[:, 1]

    def score(self, t: Tokens, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(summary(t, p) @ self.logistic)))


def summary(t: Tokens, p: np.ndarray) -> np.ndarray:
    """Per document: 1, the log of one and the sum of squared marginals, the largest marginal."""
    n = len(t.at) - 1
    out = np.zeros((n, 3))
    out[:, 0] = 1
    doc = np.repeat(np.arange(n), np.diff(t.at))
    out[:, 1] = np.log1p(np.bincount(doc, p * p, minlength=n))
    np.maximum.at(out[:, 2], doc, p)
    return out


def distinct_rows(rows: list[tuple[int, str, int]], sketches: int = 6, shingle: int = 5) -> list[tuple[int, str, int]]:
    """One row of each group of copies and near-copies with the same label: copies would make their rare words look toxic.

    Rows that share the least hash of their shingles under any of some seeds are one group.
    """
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[tuple, int] = {}
    for i, j, data, offsets in text_blocks(pa.array([t or "" for _, t, _ in rows], pa.string())):
        t = tokenise(data, offsets)
        roll = Rolling(t.codes[:, 0])
        for k in range(i, j):
            lo, hi = int(t.at[k - i]), int(t.at[k - i + 1])
            start = np.arange(lo, max(lo + 1, hi - shingle + 1)) if hi > lo else np.zeros(0, np.int64)
            h = roll.at(start, np.minimum(start + shingle, hi))
            for s in range(sketches):
                key = (rows[k][2], s, int(mix(h + U64(s * 7919 + 1)).min()) if len(h) else 0)
                other = first.setdefault(key, k)
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    return [r for k, r in enumerate(rows) if find(k) == k]


def train(rows: list[tuple[int, str, int]], prior: float | None = None) -> Model:
    """Fit on (doc_id, text, toxic); prior: the share of toxic rows that scores are weighted to. Without rows of both labels every score is the share of toxic rows, halved towards 0."""
    rows = distinct_rows(sorted(rows, key=lambda r: (r[0], r[1] or "")))
    data = pa.array([t or "" for _, t, _ in rows], pa.string())
    toxic = np.array([y for *_, y in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(rows) + 1) / 2
        return Model(ChainCRF(2, TABLE), np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, *_ in rows])
    parts = [(i, tokenise(d, o)) for i, _, d, o in text_blocks(data)]
    # How many toxic and clean documents hold each word or prefix.
    pairs = []
    for i, t in parts:
        doc = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at)) + i
        for k in range(t.codes.shape[1]):
            code = t.codes[:, k]
            order = np.lexsort((doc, code))
            c, d = code[order], doc[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            pairs.append((c[new], d[new]))
    code, doc = (np.concatenate(x) for x in zip(*pairs, strict=True))
    seen, which = np.unique(code, return_inverse=True)
    fit = fold != 4
    bad = np.bincount(which, (toxic[doc] == 1) & fit[doc], minlength=len(seen))
    good = np.bincount(which, (toxic[doc] == 0) & fit[doc], minlength=len(seen))
    n_bad, n_good = max(1, (toxic[fit] == 1).sum()), max(1, (toxic[fit] == 0).sum())
    rate = n_bad / (n_bad + n_good)
    share = bad / np.maximum(1, bad + good)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(share / rate), 0) + np.where(good > 0, good * np.log((1 - share) / (1 - rate)), 0)
    marks = seen[(gain > np.log(len(seen)) + 5) & (bad / n_bad >= MARK_RATIO * (good + 0.5) / n_good)]
    field = ChainCRF(2, TABLE)
    xs, chains, labels, tokens = [], [], [], 0
    for i, t in parts:
        doc = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at)) + i
        label = (np.isin(t.codes, marks).any(1) & (toxic[doc] == 1)).astype(np.int64)
        f, _ = features(t)
        first = t.chains[:-1]
        some = first < t.chains[1:]
        marked = np.add.reduceat(np.append(label, 0), np.minimum(first, len(label))) > 0 if len(first) else some
        # Every chain with a toxic token, and every fourth other chain.
        use = some & fit[doc[np.minimum(first, len(doc) - 1)]] & (marked | (np.arange(len(first)) % 4 == 0)) if len(doc) else some
        keep = np.zeros(len(doc) + 1, np.int64)
        np.add.at(keep, first[use], 1)
        np.add.at(keep, t.chains[1:][use], -1)
        keep = np.cumsum(keep)[:-1] > 0
        width = f.size // max(1, len(doc))
        xs.append(f.reshape(-1, width)[keep].reshape(-1))
        labels.append(label[keep])
        size = (t.chains[1:] - first)[use]
        chains.append(np.cumsum(size) + tokens)
        tokens += int(size.sum())
    width = len(PREFIXES) + 4
    offsets = np.concatenate([[0], *chains])
    field.fit(np.concatenate(xs), np.arange(tokens + 1) * width, offsets, np.concatenate(labels), rounds=15, rate=1.0)
    model = Model(field, np.zeros(3))
    x = np.concatenate([summary(t, model.marginals(t)) for _, t in parts])
    held = ~fit if 0 < toxic[~fit].sum() < (~fit).sum() else np.ones(len(rows), bool)
    y = toxic[held]
    prior = y.mean() if prior is None else prior
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.logistic = _logistic(x[held], y, weight)
    field.emit = field.emit.astype(np.float32).astype(float)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(h, g), -4, 4)
    return w


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5: fold 0 is held out and never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def learn(spark: SparkSession, documents: DataFrame, labels: DataFrame, each: int = TRAIN_EACH, max_bytes: int = TRAIN_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows outside fold 0: up to ``each`` documents a label, in the order of a
    hash of the doc_id, with texts of at most ``max_bytes`` bytes. The sample's ids pass the driver; its texts meet in one
    task, which fits the model and returns it as two megabytes, so the driver's memory doesn't hold the training."""
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.where(fold_of() != 0).withColumn("h", F.xxhash64("doc_id"))
    share = y.agg(F.avg("toxic")).first()[0]
    prior = None if share in (None, 0.0, 1.0) else share
    ids = [r for v in (0, 1) for r in y.where(F.col("toxic") == v).orderBy("h", "doc_id").limit(each).collect()]
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int"))  # at most 2 * each rows
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= max_bytes).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text a doc_id, so the sample's bound holds

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        if sample:
            yield pa.RecordBatch.from_arrays([pa.array([train(sample, prior).pack()], pa.binary())], names=["model"])

    found = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(fit, "model binary").first()
    return Model.unpack(bytes(found.model)) if found else train([])


def tag(model_of, documents: DataFrame, spans: bool = True, spark: SparkSession | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score rows with a trained model: doc_id, held_out, score, predicted, spans (byte begin, end, marginal) and the
    ``carry`` columns.

    Spans are runs of tokens whose marginal is 0.5 or more. Null and empty texts have no spans and the score of a text
    without toxic words. Extra columns are ignored; repeated rows get equal scores.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    model = (spark or documents.sparkSession).sparkContext.broadcast(model_of)
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score, found = [], [[] for _ in range(batch.num_rows)]
            for i, _, data, offsets in text_blocks(batch.column(1), 1 << 20):
                t = tokenise(data, offsets)
                p = m.marginals(t)
                score.append(m.score(t, p))
                hot = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(t.at, hot, "right") - 1
                last = -2
                for k, d in zip(hot.tolist(), doc.tolist(), strict=True) if spans else ():
                    mine = found[i + d]
                    if k == last + 1 and mine:
                        mine[-1] = {"begin": mine[-1]["begin"], "end": int(t.ends[k] - offsets[d]), "marginal": max(mine[-1]["marginal"], float(p[k]))}
                    else:
                        mine.append({"begin": int(t.starts[k] - offsets[d]), "end": int(t.ends[k] - offsets[d]), "marginal": float(p[k])})
                    last = k
            s = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(found, spans_type), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", "spans", *batch.schema.names[3:]])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), (fold_of() == 0).alias("held_out"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    more = "".join(f", carry_{c} {documents.schema[c].dataType.simpleString()}" for c in carry)
    out = rows.mapInArrow(emit, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<begin:int,end:int,marginal:double>>{more}")
    return out.select("doc_id", "held_out", "score", "predicted", "spans", *[F.col(f"carry_{c}").alias(c) for c in carry])


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Train on the labelled rows of ``learn_from`` (by default the documents) and score every document."""
    return tag(learn(spark, learn_from if learn_from is not None else documents, labels), documents, spark=spark)
