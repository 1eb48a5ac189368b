"""Quality: positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; everything else is unlabelled web text. A linear model over binned
dense statistics and chosen n-grams minimises prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]), with the
bounded sigmoid loss. The class prior is the least ratio of unlabelled to positive mass over upper score sets, where all
unlabelled documents count, each scored by a first model that is not fitted on its half of the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import as_bytes, chunks, cut, table
from khata.llm.text_features import DENSE, QUANTILES, Sparse, Vocabulary, bounded_ids, choose_grams, dense, descend, sigmoid
from khata.llm.toxicity import held_out, score_texts

#: Rows of either kind, trusted positive and unlabelled, that the model is fitted on, at most (about).
SAMPLE_ROWS = 15_000
LENGTHS = (3, 5)
BINS = len(QUANTILES) + 1
GRAMS = 512
RIDGE = 1e-4
THRESHOLD = 0.3
#: Smallest mass of positives that an upper score set needs to count in the prior's estimate.
LEAST_MASS = 0.5


@dataclass
class QualityModel:
    keys: np.ndarray
    edges: np.ndarray
    weights: np.ndarray

    def columns(self, texts: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
        """Feature columns of each text: one bin of every statistic, its n-grams, the constant."""
        text, gram = vocabulary.find(texts)
        bins = (dense(texts)[:, :, None] > self.edges[None]).sum(axis=2) + np.arange(DENSE) * BINS
        base, lists = DENSE * BINS, np.split(gram, np.searchsorted(text, np.arange(1, len(texts))))
        return [np.concatenate([b, base + g, [base + len(self.keys)]]) for b, g in zip(bins, lists)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        vocabulary = Vocabulary(self.keys, LENGTHS)
        out = np.empty(len(texts))
        for start, part in chunks(texts):
            out[start : start + len(part)] = Sparse(self.columns(part, vocabulary), len(self.weights)).times(self.weights)
        return sigmoid(out)


def _cuts(positive: np.ndarray) -> np.ndarray:
    """Ascending scores that LEAST_MASS of the positives or more reach."""
    return np.quantile(positive, np.linspace(0, 1 - LEAST_MASS, 60)) if len(positive) else np.zeros(0)


def _least_ratio(positive: np.ndarray, unlabelled: np.ndarray, n: int) -> float:
    """The prior by the shares of positives and of n unlabelled rows that reach each cut.

    Less two standard errors: a prior that is too high hides negatives, one that is a little low costs nothing.
    """
    some = positive >= LEAST_MASS
    least = min(1.0, float((unlabelled[some] / positive[some]).min())) if some.any() else 1.0
    least -= 2 * np.sqrt(least * (1 - least) / max(n, 1))
    return float(min(max(least, 0.05), 0.98))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of masses above a cut, over cuts with enough positives above."""
    reach = lambda x, c: (x >= c).mean() if len(x) else 0.0
    cuts = _cuts(positive)
    return _least_ratio(np.array([reach(positive, c) for c in cuts]), np.array([reach(unlabelled, c) for c in cuts]), len(unlabelled))


def _half(texts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(t) & 1 for t in texts], dtype=np.int32)


def corpus_prior(docs: DataFrame, known: DataFrame, models: list[QualityModel], positive: list[np.ndarray]) -> float:
    """The class prior of the documents (doc_id, text) that known (doc_id) doesn't list, all of them.

    models[h] scores the texts of half h, positive[h] are its scores of that half's positives. Texts are scored where
    they are read; ids with a level are grouped and joined, and one row a level reaches the driver.
    """
    cuts = [_cuts(p) for p in positive]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            half, level = _half(texts), np.zeros(len(texts), dtype=np.int32)
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                level[at] = np.searchsorted(cuts[h], models[h].score([texts[i] for i in at]), side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level)], names=["doc_id", "level"])

    # Rows of an id that repeats, or is null, are counted before the join.
    levels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, level int").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    counts = np.zeros(len(cuts[0]) + 1)
    for r in levels.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    reached = sum((p[:, None] >= c[None, :]).sum(axis=0) for p, c in zip(positive, cuts)) / sum(map(len, positive))
    total = counts.sum()
    return _least_ratio(reached, (total - np.cumsum(counts)[:-1]) / max(total, 1), int(total))


def fit(sample: DataFrame, prior: float | None = None, docs: DataFrame | None = None, known: DataFrame | None = None) -> QualityModel | None:
    """sample: text, label (1 trusted positive, 0 unlabelled), bounded. prior: where None, estimated over all docs
    (doc_id, text) but those that known (doc_id) lists, or without docs over the sample's unlabelled rows.

    Without rows of both kinds there is nothing to learn from: None.
    """
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return None
    keys = choose_grams(sample, LENGTHS, GRAMS)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            rows = np.concatenate([dense(part) for _, part in chunks(texts)]) if texts else np.zeros((0, DENSE))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], names=["x"])

    x = np.stack(sample.select("text").mapInArrow(stats, "x array<double>").toArrow()["x"].to_numpy(zero_copy_only=False))
    edges = np.quantile(x, QUANTILES, axis=0).T
    width = DENSE * BINS + len(keys) + 1
    model = QualityModel(keys, edges, np.zeros(width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(keys, LENGTHS)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            lists = [c for _, part in chunks(texts) for c in model.columns(part, vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(_half(texts)), pa.array([list(map(int, c)) for c in lists], pa.list_(pa.int32()))], names=["label", "half", "columns"])

    got = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(rows, "label int, half int, columns array<int>").toArrow()
    label, lists = got["label"].to_numpy(), got["columns"].to_pylist()
    pick = lambda at: Sparse([lists[i] for i in at], width)
    one, other = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    ridge = RIDGE * np.append(np.ones(width - 1), 0)
    if prior is None:
        # First models tell positives from unlabelled rows on one half of the texts; the other half gives the masses.
        half, models, scores = got["half"].to_numpy(), [], {1: [], 0: []}
        for h in (0, 1):
            p, u = (pick(rest if len(rest := at[half[at] != h]) else at) for at in (one, other))
            w = descend(lambda w, p=p, u=u: (p.back(sigmoid(p.times(w)) - 1) / p.n + u.back(sigmoid(u.times(w))) / u.n) / 2 + ridge * w, width, 150)
            models.append(QualityModel(keys, edges, w))
            for kind, at in ((1, one), (0, other)):
                own = at[half[at] == h]
                scores[kind].append(sigmoid(pick(own if len(own) else at).times(w)))
        prior = class_prior(*map(np.concatenate, (scores[1], scores[0]))) if docs is None else corpus_prior(docs, known, models, scores[1])
    p, u = pick(one), pick(other)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p.times(w)), sigmoid(u.times(w))
        dp, du = p.back(sp * (1 - sp)) / p.n, u.back(su * (1 - su)) / u.n
        g = -prior * dp + ridge * w
        # The non-negative risk: where the negatives' part would fall below 0 it is 0 and pulls no further.
        return g + du - prior * dp if su.mean() >= prior * sp.mean() else g

    model.weights = descend(gradient, width, 400, 0.2)
    return model


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def known_labels(labels: DataFrame, fold) -> DataFrame:
    """doc_id, label of the labelled rows outside the held-out fold."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~fold).groupBy("doc_id").agg(F.max("quality").alias("label"))


def training_rows(docs: DataFrame, known: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """text, label: trusted positives of known, and documents that it doesn't list."""
    positive = bounded_ids(known.where("label = 1").select("doc_id"), "doc_id", most, 9)
    web = bounded_ids(docs.where("doc_id is not null").select("doc_id"), "doc_id", most, 11).join(known, "doc_id", "left_anti").distinct()
    # At most about twice `most` rows of 12 bytes: a proven bound for the broadcast.
    chosen = positive.withColumn("label", F.lit(1)).unionByName(web.withColumn("label", F.lit(0)))
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts are scored as texts without words; repeated rows each a row."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    known = known_labels(table(spark, sf_dir, "labels"), out)
    model = fit(training_rows(docs, known), docs=docs, known=known) or Constant(0.5)
    return score_texts(docs, model, ["doc_id"], threshold=THRESHOLD).select("doc_id", out.alias("held_out"), "score", "predicted")
