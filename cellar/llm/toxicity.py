"""Toxicity scores: logistic regression by FTRL-proximal over hashed word features.

Features of a text are the hashed words, pairs of neighbouring words and pairs
with one word skipped that occur in it, each present or absent. Every
coordinate has its own learning rate, and the L1 term leaves only coordinates
with real evidence, so the weights are a short table that is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import Words, chunks, mix, words
from cellar.llm.support import documents

LOG2_DIM = 20
MAX_TRAIN = 16_000
SCREEN = {"epochs": 2, "alpha": 0.3, "l2": 0.3}
FIT = {"epochs": 30, "alpha": 1.0, "l2": 0.3}
BETA = 1.0
THRESHOLD = 0.7
_SKIP = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0x3C6EF372FE94F82A)}


def _features(w: Words, log2_dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text of every word, neighbour pair and skip pair of a chunk (with repeats)."""
    h, text, end = w.hash, w.text, w.text_end()
    n = len(h)
    idx, who = [h], [text]
    for gap in (1, 2):
        if n > gap:
            ok = np.arange(n - gap) + gap < end[: n - gap]
            idx.append(mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(5) + _SKIP[gap])[ok])
            who.append(text[:-gap][ok])
    shift = np.uint64(64 - log2_dim)
    return (np.concatenate(idx) >> shift).astype(np.int64), np.concatenate(who)


def l1_strength(n: int) -> float:
    """The gradients of a coordinate without effect add up to about sqrt(n): this leaves it at zero."""
    return max(3.0, n**0.5 / 8)


def ftrl(rows: list[np.ndarray], y: np.ndarray, dim: int, epochs: int, alpha: float, l1: float, l2: float, beta: float = BETA):
    """Weights and bias after ``epochs`` passes over feature-index rows in the given order."""
    z, n = np.zeros(dim), np.zeros(dim)
    zb = nb = 0.0
    for _ in range(epochs):
        for x, t in zip(rows, y):
            zi, ni = z[x], n[x]
            wx = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -zb * alpha / (beta + np.sqrt(nb))  # the bias has no L1
            p = 1 / (1 + np.exp(-np.clip(wx.sum() + b, -30, 30)))
            g = p - t
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wx
            n[x] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb * alpha / (beta + np.sqrt(nb))


def _feature_task(log2_dim: int):
    def task(batches):
        for batch in batches:
            for c in chunks(batch):
                idx, who = _features(words(c.column(c.schema.get_field_index("text"))), log2_dim)
                key = np.unique((who << log2_dim) | idx)
                cut = np.searchsorted(key, np.arange(c.num_rows + 1) << log2_dim).astype(np.int32)
                x = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & ((1 << log2_dim) - 1)).astype(np.int32)))
                keep = [c.column(k) for k, name in enumerate(c.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*keep, x], names=[n for n in c.schema.names if n != "text"] + ["x"])

    return task


def _rows(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and labels in the order of the documents' hashes: reruns agree."""
    table = table.take(pa.array(np.argsort(table.column("doc_hash").to_numpy(), kind="stable")))
    x = table.column("x").combine_chunks()
    off = x.offsets.to_numpy()
    flat = x.values.to_numpy()
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])], table.column("label").to_numpy()


def _fit_task(dim: int):
    """Screen the coordinates with few epochs, then fit those left on rows that hold nothing else."""

    def task(table):
        rows, y = _rows(table)
        l1 = l1_strength(len(y))
        live = ftrl(rows, y, dim, l1=l1, **SCREEN)[0] != 0
        w, b = ftrl([x[live[x]] for x in rows], y, dim, l1=l1, **FIT)
        at = np.flatnonzero(w)
        return pa.table({"idx": pa.array(np.append(at, -1)), "w": pa.array(np.append(w[at], b))})

    return task


def train(docs: DataFrame, labels: DataFrame, max_train=MAX_TRAIN, log2_dim=LOG2_DIM) -> dict[int, float]:
    """Weights by feature index (-1: the bias) from ``labels(doc_id, label 0/1)``.

    At most about ``max_train`` labelled documents take part, chosen by the
    hash of their id among all labelled rows, so one task holds their features
    and learns in the order of the hashes. A document with several labels
    counts with the largest; null ids and labels are ignored. No labels: an
    empty table, and every score is 0.5.
    """
    lab = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = lab.count()
    if not n:
        return {}
    h = F.xxhash64(F.col("doc_id"), F.lit(4))
    lab = lab.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, max_train / n))))
    # about max_train narrow rows: the texts are not shuffled to find them
    t = docs.join(F.broadcast(lab.withColumnRenamed("doc_id", "lab_id")), F.col("doc_id") == F.col("lab_id"))
    t = t.select("text", F.col("label").cast("double").alias("label"), F.xxhash64(F.col("doc_id"), F.lit(5)).alias("doc_hash"))
    t = t.mapInArrow(_feature_task(log2_dim), "label double, doc_hash long, x array<int>")
    w = t.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_task(1 << log2_dim), "idx long, w double").toPandas()  # the few weights that are not zero
    return dict(zip(w["idx"].astype(int), w["w"].astype(float)))


def _score_task(model, log2_dim: int):
    def task(batches):
        w = np.zeros(1 << log2_dim)
        b = model.value.get(-1, 0.0)
        for k, v in model.value.items():
            if k >= 0:
                w[k] = v
        some = w != 0
        for batch in batches:
            for c in chunks(batch):
                idx, who = _features(words(c.column(c.schema.get_field_index("text"))), log2_dim)
                hit = some[idx]
                key = np.unique((who[hit] << log2_dim) | idx[hit])
                s = np.bincount(key >> log2_dim, weights=w[key & ((1 << log2_dim) - 1)], minlength=c.num_rows)
                p = 1 / (1 + np.exp(-np.clip(s + b, -30, 30)))
                keep = [c.column(k) for k, name in enumerate(c.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(p)], names=[x for x in c.schema.names if x != "text"] + ["score"])

    return task


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col="doc_id", text_col="text", label_col="toxic", threshold=THRESHOLD, log2_dim=LOG2_DIM, **kw) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1), predicted (1: score >= threshold).

    Labels of ``held_out`` documents are not used. A null, empty or wordless
    text has no features and scores the bias alone.
    """
    flag = F.coalesce(held_out, F.lit(False))
    id_type = docs.schema[id_col].dataType.simpleString()
    d = documents(docs, id_col, text_col)
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"), flag.alias("held")).where("NOT held").drop("held")
    model = docs.sparkSession.sparkContext.broadcast(train(d, lab, log2_dim=log2_dim, **kw))
    rows = docs.select(F.col(id_col).alias("doc_id"), flag.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_score_task(model, log2_dim), f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
