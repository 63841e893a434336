"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .common import U, Words, inside, mix, text_slices

BITS = 32
BIAS, THRESHOLD, SCORED = -1, -2, -3
FOLDS = 5


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature (BITS of a hash) of every word, pair of neighbours, and pair with one or two words between."""
    h, of = w.hash, w.of
    shift = U(64 - BITS)
    texts, found = [of], [mix(h, 20) >> shift]
    for gap in (1, 2, 3):
        at = inside(w.row, len(h), gap + 1)
        if len(at):
            texts.append(of[at])
            found.append(mix(mix(h[at], 20 + gap) + h[at + gap], 30) >> shift)
    return np.concatenate(texts), np.concatenate(found).astype(np.uint32)


def distinct_features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    of, f = features(Words(texts))
    key = np.unique((of.astype(U) << U(32)) | f)
    return np.split((key & U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> U(32), np.arange(1, len(texts), dtype=U)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, n: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over the rows in turn.  Each coordinate has its own rate, alpha / (beta + sqrt(sum g^2));
    a weight stays 0 while its |z| is within l1."""
    z, q = np.zeros(n), np.zeros(n)
    zb = qb = 0.0

    def weights(zi: np.ndarray, qi: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(qi)) / alpha + l2))

    for _ in range(epochs):
        for ix, label in zip(rows, y):
            zi, qi = z[ix], q[ix]
            w, wb = weights(zi, qi), -zb / ((beta + qb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - label
            root = np.sqrt(qi + g * g)
            z[ix] = zi + g - (root - np.sqrt(qi)) / alpha * w
            q[ix] = qi + g * g
            zb += g - ((qb + g * g) ** 0.5 - qb**0.5) / alpha * wb
            qb += g * g
    return weights(z, q), -zb / ((beta + qb**0.5) / alpha + l2)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score that separates best by F1, midway in log odds to the next lower score; 0.5 where there is only one class."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # equal scores stay together
    k = int(np.argmax(f1))
    ends = np.clip(p[order][k : k + 2], 1e-9, 1 - 1e-9)
    return float(1 / (1 + np.exp(-np.log(ends / (1 - ends)).mean())))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8000, min_docs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, epochs: int = 8) -> DataFrame:
    """Non-zero weights: ``feature, weight``, with the bias as feature -1 and the threshold as -2.

    It is fitted on at most ``rows`` labelled documents, the first in order of the hash of doc_id.  Five more fits, each
    without a fifth of them, score those to choose the threshold; each fit is a task of its own.  Features of fewer than ``min_docs`` of them
    are not used.  Labels other than 0 and 1, and null ids, don't count; of several labels of a document the largest does.  Rows with a null text aren't used;
    texts may be of any length.  Without usable rows there are no weights, and every score is 0."""

    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ints(distinct_features(texts))], names=["doc_id", "y", "f"])

    sample = cut(texts.select("doc_id", "y", "text").mapInArrow(seen, "doc_id long, y int, f array<int>"))
    often = sample.select(F.explode("f").alias("f")).groupBy("f").count().filter(F.col("count") >= min_docs).select("f").toArrow()  # bounded by the sample
    used = np.sort(often.column("f").to_numpy().view(np.uint32))
    sent = spark.sparkContext.broadcast(used)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = sent.value
        for b in batches:
            found = [np.asarray(x, np.int32).view(np.uint32) for x in b.column(2).to_pylist()]
            at = [np.searchsorted(used, f) for f in found]
            kept = [i[used[np.minimum(i, len(used) - 1)] == f] if len(used) else i[:0] for i, f in zip(at, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _ints(kept)], names=["doc_id", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, y, folds = [], [], set()
        for b in batches:
            folds |= set(b.column(0).to_pylist())
            y += b.column(1).to_pylist()
            ix += [np.asarray(x, np.int64) for x in b.column(2).to_pylist()]
        if not ix:
            return
        (own,) = folds
        t = np.array(y, float)
        held = np.flatnonzero(np.arange(len(ix)) % FOLDS == own)  # none of them if own is FOLDS
        learnt = np.setdiff1d(np.arange(len(ix)), held)
        w, b = ftrl([ix[i] for i in learnt], t[learnt], len(used), alpha, beta, l1, l2, epochs)
        if own < FOLDS:
            p = np.array([1 / (1 + np.exp(-np.clip(w[ix[i]].sum() + b, -35, 35))) for i in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), SCORED)), pa.array(p, pa.float64()), pa.array(t[held])], names=["feature", "weight", "y"])
        else:
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((used[at].astype(np.int64), [BIAS]))), pa.array(np.concatenate((w[at], [b]))), pa.nulls(len(at) + 1, pa.float64())], names=["feature", "weight", "y"])

    # a key for each fit that Spark's hash puts in a partition of its own
    place = spark.range(1000).select("id", F.pmod(F.hash("id"), F.lit(FOLDS + 1)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).orderBy("p")
    keys = F.array(*(F.lit(r["id"]).cast("long") for r in place.collect()))
    each = sample.mapInArrow(pruned, "doc_id long, y int, f array<int>").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    each = each.withColumn("key", F.element_at(keys, F.col("fold") + 1)).repartition(FOLDS + 1, "key").sortWithinPartitions(order, "doc_id", "f")
    out = cut(each.select("fold", "y", "f").mapInArrow(fit, "feature long, weight double, y double"))
    scored = out.filter(F.col("feature") == SCORED).select("weight", "y").toArrow()  # a row for each of the sample's
    weights = out.filter(F.col("feature") >= BIAS).select("feature", "weight")
    if not scored.num_rows:
        return weights
    threshold = best_threshold(scored.column("weight").to_numpy(), scored.column("y").to_numpy())
    return weights.union(spark.createDataFrame([(THRESHOLD, threshold)], "feature long, weight double"))


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(a.astype(np.uint32).view(np.int32) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, score, toxic`` of each row of documents: the probability, and whether it is at least the threshold.

    Texts without words, also empty and null ones, and all texts if there are no weights, score 0 and aren't toxic.  Texts of any length are
    scored as a whole.  A null doc_id stays null; repeated rows give repeated rows, an empty table none; other columns are
    ignored, whatever their names."""
    table = {int(r[0]): float(r[1]) for r in weights.collect()}  # L1 leaves few
    bias, threshold = table.pop(BIAS, None), table.pop(THRESHOLD, 0.5)
    keys = np.array(sorted(table), np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast((keys, np.array([table[int(k)] for k in keys])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w = sent.value
        coarse = np.zeros(1 << 16, bool)
        coarse[keys >> np.uint32(16)] = True
        for batch, texts in text_slices(batches, "text"):
            words = Words(texts)
            total = np.zeros(len(texts))
            if len(keys):
                of, f = features(words)
                maybe = np.flatnonzero(coarse[f >> np.uint32(16)])
                of, f = of[maybe], f[maybe]
                at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                hit = keys[at] == f
                pair = np.unique(of[hit] * len(keys) + at[hit])
                np.add.at(total, pair // len(keys), w[pair % len(keys)])
            p = np.zeros(len(texts)) if bias is None else 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
            p[np.diff(words.row) == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold) & (p > 0))], names=["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that a model trained on the labels finds toxic: ``doc_id, score, toxic``, toxic always true.  Rows as in ``score``."""
    return score(docs, train(docs, labels, **options)).filter("toxic")
