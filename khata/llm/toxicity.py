"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the n-grams that tell toxic texts apart. For labelled sentences that name a group, the group's
term is swapped for another or for a neutral word, and the squared change of the score is added to the loss, so that
naming a group does not by itself raise a score. Groups themselves never are features beyond what this leaves them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import as_bytes, chunks, cut, table
from khata.llm.text_features import Sparse, Vocabulary, bounded_ids, choose_grams, descend, sigmoid

#: Labelled rows that the model is fitted on, at most (about); labels beyond are left unused.
SAMPLE_ROWS = 20_000
LENGTHS = (4, 5, 6)
#: Weight of the counterfactual penalty, ridge penalty, and the score that predicts toxic.
PENALTY = 5.0
RIDGE = 2e-5
THRESHOLD = 0.3

#: Identity terms that can stand for one another in a sentence, each list after its neutral word.
IDENTITY_TERMS = {
    "people": "women men muslims christians jews hindus sikhs buddhists atheists catholics immigrants refugees foreigners natives dalits brahmins",
    "person": "woman man",
    "children": "girls boys",
    "human": "muslim christian jewish hindu gay lesbian bisexual transgender queer straight black white asian african latino european indian elderly disabled blind deaf autistic poor rich",
    "Menschen": "Frauen Männer Muslime Christen Juden Hindus Buddhisten Katholiken Ausländer Flüchtlinge Einwanderer Schwule Lesben Behinderte",
    "Kinder": "Mädchen Jungen",
    "personnes": "femmes hommes musulmans chrétiens juifs hindous bouddhistes catholiques étrangers réfugiés immigrés homosexuels lesbiennes handicapés",
    "enfants": "filles garçons",
    "personas": "mujeres hombres musulmanes cristianos judíos hindúes budistas católicos extranjeros refugiados inmigrantes homosexuales lesbianas discapacitados",
    "niños": "niñas chicos",
}
_NEUTRAL = {t.lower(): neutral for neutral, terms in IDENTITY_TERMS.items() for t in terms.split()}
_OTHER = {a.lower(): b for terms in map(str.split, IDENTITY_TERMS.values()) for a, b in zip(terms, terms[1:] + terms[:1])}
_TERM = re.compile(rf"(?<!\w)({'|'.join(sorted(_NEUTRAL, key=len, reverse=True))})(?!\w)", re.I)
_SENTENCE = re.compile(r"[^.!?\n]+")


def counterfactuals(text: bytes) -> list[tuple[bytes, bytes]]:
    """(sentence, the sentence with its identity terms swapped), of every sentence that has any: once for the neutral
    words, once for other terms of the same list."""
    out = []
    for m in _SENTENCE.finditer(text.decode("utf-8", "replace")):
        if _TERM.search(m[0]):
            out += [(m[0].encode(), _TERM.sub(lambda t: word[t[0].lower()], m[0]).encode()) for word in (_NEUTRAL, _OTHER)]
    return out


@dataclass
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        vocabulary = Vocabulary(self.keys, LENGTHS)
        out = np.full(len(texts), self.bias)
        for start, part in chunks(texts):
            text, gram = vocabulary.find(part)
            out[start : start + len(part)] += np.bincount(text, weights=self.weights[gram], minlength=len(part))
        return sigmoid(out)


def fit(sample: DataFrame, penalty: float = PENALTY) -> ToxicityModel:
    """sample: text, label (0 or 1), a bounded number of rows. One class alone gives a constant score."""
    keys = choose_grams(sample, LENGTHS)
    if not len(keys):
        mean = sample.agg(F.avg("label")).first()[0]
        share = min(max(0.0 if mean is None else float(mean), 1e-3), 1 - 1e-3)
        return ToxicityModel(keys, np.zeros(0), float(np.log(share / (1 - share))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(keys, LENGTHS)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            kind, labels, here, there = [], [], [], []
            for start, part in chunks(texts):
                pairs = [p for t in part for p in counterfactuals(t)]
                text, gram = vocabulary.find([*part, *(x for p in pairs for x in p)])
                lists = np.split(gram, np.searchsorted(text, np.arange(1, len(part) + 2 * len(pairs))))
                for i in range(len(part)):
                    kind.append(0), labels.append(batch.column(1)[start + i].as_py()), here.append(lists[i]), there.append([])
                for i in range(len(pairs)):
                    a, b = lists[len(part) + 2 * i], lists[len(part) + 2 * i + 1]
                    if not np.array_equal(a, b):  # a swap that no feature sees changes no score
                        kind.append(1), labels.append(0), here.append(np.setdiff1d(a, b)), there.append(np.setdiff1d(b, a))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(labels, pa.int32()), pa.array([list(map(int, x)) for x in here], ints), pa.array([list(map(int, x)) for x in there], ints)], names=["kind", "label", "here", "there"])

    got = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(rows, "kind int, label int, here array<int>, there array<int>").toArrow()
    kind = got["kind"].to_numpy()
    here, there = got["here"].to_pylist(), got["there"].to_pylist()
    own, pairs = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    y = got["label"].to_numpy()[own]
    k = len(keys)
    x = Sparse([np.append(here[i], k) for i in own], k + 1)  # the last column is the constant
    less, more = Sparse([here[i] for i in pairs], k + 1), Sparse([there[i] for i in pairs], k + 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        g = x.back(sigmoid(x.times(w)) - y) / x.n + RIDGE * np.append(w[:-1], 0)
        if len(pairs):
            change = less.times(w) - more.times(w)
            g += 2 * penalty * (less.back(change) - more.back(change)) / len(pairs)
        return g

    w = descend(gradient, k + 1)
    return ToxicityModel(keys, w[:-1], float(w[-1]))


def score_texts(docs: DataFrame, model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score and predicted for every whole text; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(as_bytes(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    chosen = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("_text"))
    fields = [f for f in chosen.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    return chosen.mapInArrow(run, schema)


def reject(docs: DataFrame, model, threshold: float, text: str = "text") -> DataFrame:
    """docs less the rows that score at the threshold or above; narrow, all columns stay.

    Null and empty texts get the score of no evidence. Repeated rows go or stay together.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(as_bytes(batch.column(place))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_: str, parts: int, which: int):
    """crc32 of the id as text, mod parts, is `which`; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string")), F.lit(parts)) == which, F.lit(False))


def train_sample(docs: DataFrame, labels: DataFrame, label: str, fold, most: int = SAMPLE_ROWS) -> DataFrame:
    """text, label of a bounded number of labelled rows outside the held-out fold, written to the shared folder."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~fold).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = bounded_ids(known, "doc_id", most, 5)
    # At most about `most` rows of 12 bytes: a proven bound for the broadcast.
    return cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("label").cast("int").alias("label")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts get the score of no evidence; repeated rows each a row."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = fit(train_sample(docs, table(spark, sf_dir, "labels"), "toxic", out))
    return score_texts(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")
