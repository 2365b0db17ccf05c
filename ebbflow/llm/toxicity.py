"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their stems (the first ``STEM`` letters), of neighbouring
pairs and of pairs with one word between them; each counts once however often it occurs. Training is per-coordinate FTRL-proximal with L1 and L2 terms:
a coordinate's rate falls with the squared gradients it has seen, and weights whose accumulated gradient stays within
the L1 term are exactly zero. What is left is a short list of (hash, weight), which is broadcast.

The model is fitted on a bounded sample of labelled documents: about half of ``max_docs`` of each class (a hash of the id
decides), so a rare class is there as far as it has documents; each document weighs as many as it stands for, so scores keep the
classes' proportion. A document trains with ``max_terms`` of its features at most, those with the least hashes. Features
are made by the executors; the driver, which trains in a few passes, holds ``max_docs`` times ``max_terms`` numbers and no
more. Scoring reads every whole text; labels, language, source and id play no part in it.

Defined results: null and empty texts have no features and get the score of the intercept; repeated labels of a
document count as often as they occur; without any labelled row every score is 0.5; equal rows stay separate rows; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import support

WORD = re.compile(r"[^\W\d_]+")
BITS = 20
#: Distances of the pairs: neighbours, and a skip over one word.
GAPS = (1, 2)
STEM = 5
CACHE_WORDS = 200_000
THRESHOLD = 0.3


@dataclass
class Model:
    """Non-zero weights by feature, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.features] = self.weights
        return dense


class Hasher:
    """Features of texts; the hashes of seen words are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Feature numbers, with repeats."""
        words = WORD.findall(text.lower()) if text else []
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode()) | zlib.crc32(w[:STEM].encode(), 1) << 32
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        h, stems = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        parts = [h * np.uint64(0x9E3779B1), stems * np.uint64(0xB5297A4D)]
        for gap in GAPS:
            parts.append((h[:-gap] * np.uint64(0x85EBCA6B) + h[gap:] * np.uint64(0xC2B2AE35) + np.uint64(gap)) * np.uint64(0x9E3779B1))
        mixed = np.concatenate(parts)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(7) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def train(features: list[np.ndarray], labels: np.ndarray, stands_for: np.ndarray | None = None, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, passes: int = 4, seed: int = 7) -> Model:
    """FTRL-proximal over documents in a seeded order; the intercept is a coordinate without L1.

    ``stands_for`` weighs documents; weights are scaled to a mean of 1 so that the L1 term keeps its meaning.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        bound = np.where(at == size, 0.0, l1)
        own = z[at]
        return np.where(np.abs(own) <= bound, 0.0, (np.sign(own) * bound - own) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for i in order.permutation(len(features)).tolist():
            at = np.append(features[i], size)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - labels[i]) * (1.0 if stands_for is None else stands_for[i])
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    final = weights(np.arange(size + 1))
    kept = np.flatnonzero(final[:size])
    return Model(kept, final[kept], float(final[size]))


def sampled(labelled: DataFrame, id_col: str, label_col: str, max_docs: int) -> DataFrame:
    """About ``max_docs`` of the rows whose label is 0 or 1, half of them of each class; adds ``stands_for``, the rows that each stands for."""
    rows = labelled.withColumn(label_col, F.col(label_col).cast("int")).filter(F.col(label_col).isin(0, 1))
    sizes = {r[label_col]: r["n"] for r in rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    grain = 1 << 30
    # A class that needs less than its half leaves the rest to the other.
    room = {k: max(max_docs // 2, max_docs - sizes.get(1 - k, 0)) for k in sizes}
    limit = {k: min(grain, grain * room[k] // n) for k, n in sizes.items()}
    least = F.when(F.col(label_col) == 0, limit.get(0, 0)).otherwise(limit.get(1, 0))
    return rows.filter(F.pmod(F.xxhash64(F.lit(31), F.col(id_col)), F.lit(grain)) < least).withColumn("stands_for", F.lit(float(grain)) / F.greatest(least, F.lit(1)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 8000, max_terms: int = 16_384) -> Model:
    """Fits a model on a sample of about ``max_docs`` rows whose label is 0 or 1 (rows of ``with_labels`` are one already)."""
    if "stands_for" not in labelled.columns:
        labelled = sampled(labelled, id_col, label_col, max_docs)
    chosen = labelled.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), "stands_for")

    def work(batch: dict[str, list]) -> dict[str, list]:
        hasher = support.once("toxicity-hasher", Hasher)
        found = [np.unique(hasher(t)) for t in batch["text"]]
        return {"key": batch["key"], "label": batch["label"], "stands_for": batch["stands_for"], "features": [bounded(x, max_terms).astype(np.int32).tobytes() for x in found]}

    kind = chosen.schema["key"].dataType.simpleString()
    found = support.map_arrow(chosen, work, f"key {kind}, label int, stands_for double, features binary").toArrow()
    if not found.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rows_in_order = sorted(zip(*(found[c].to_pylist() for c in ("key", "label", "features", "stands_for"))), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    del found
    weights = np.array([w for *_, w in rows_in_order])
    return train([np.frombuffer(f, np.int32) for _, _, f, _ in rows_in_order], np.array([y for _, y, _, _ in rows_in_order], float), weights / weights.mean())


def bounded(features: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of distinct feature numbers, by a hash of the number, so that equal features meet across documents."""
    if len(features) <= most:
        return features
    order = features.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return features[np.sort(np.argpartition(order, most - 1)[:most])]


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The ``keep`` columns of every row, and the score and the decision under ``names``, which ``keep`` mustn't hold."""
    (read,) = support.free_names(docs, "read")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = support.fresh()

    def work(batch: dict[str, list]) -> dict[str, list]:
        hasher, table = support.once(number, lambda: (Hasher(), shared.value.table()))
        scores = []
        for text in batch[read]:
            at = hasher(text)
            at = np.unique(at[table[at] != 0])
            total = float(table[at].astype(float).sum()) + shared.value.intercept
            scores.append(round(float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))), 6))
        return {n: batch[n] for n in keep} | {names[0]: scores, names[1]: [int(s >= threshold) for s in scores]}

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return support.map_arrow(docs.select(*keep, F.col(text_col).alias(read)), work, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(support.unsigned_crc32(F.col(id_col)) % 4 == 2, F.lit(False))


def with_labels(docs: DataFrame, labels: DataFrame, max_docs: int = 8000) -> DataFrame:
    """A sample of labelled documents with the columns doc_id, text, toxic and stands_for.

    Labels are sampled before texts are joined, so texts stay where they are: about ``max_docs`` labels are broadcast.
    """
    known = docs.select("doc_id").join(labels.select("doc_id", "toxic").filter("toxic is not null"), "doc_id")
    # Documents of one id are counted each, but chosen once a label.
    chosen = sampled(known, "doc_id", "toxic", max_docs).groupBy("doc_id", "toxic").agg(F.max("stands_for").alias("stands_for"), F.count(F.lit(1)).alias("times"))
    copies = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "stands_for", "times").agg(F.count(F.lit(1)).alias("copies"))
    # A label given several times counts as often.
    again = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("times") / F.col("copies")).cast("int")))).alias("nth")
    return docs.select("doc_id", "text").join(F.broadcast(copies.select("doc_id", "toxic", "stands_for", again).drop("nth")), "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; rows whose crc32(doc_id) mod 4 is 2 are held out of the fit."""
    docs = support.table(spark, sf_dir, "documents")
    model = fit(with_labels(docs.filter(~is_held_out()), support.table(spark, sf_dir, "labels")))
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
