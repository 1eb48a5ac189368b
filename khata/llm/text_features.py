"""Sparse byte n-grams and dense statistics of whole texts, for the linear classifiers.

An n-gram of up to six bytes is packed into a 64-bit key, so features are exact and never collide. Which n-grams
matter is learned in two counting passes over a bounded training sample, as Spark aggregates: coarse buckets first,
then the exact n-grams of the best buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Words, as_bytes, chunks

#: Bits of the coarse buckets, of which COARSE are looked into; n-grams kept at the end; texts that must hold one.
BUCKET_BITS = 22
COARSE = 8192
KEPT = 2048
LEAST_TEXTS = 5
#: Quantiles between the bins of a dense statistic; both tails are fine, as rare kinds of text are there.
QUANTILES = (0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.97, 0.99)

_ODD = np.uint64(0x9E3779B97F4A7C15)
# White space as one blank, A-Z in lower case: positions in the text keep their bytes.
_FOLD = bytes(32 if b in b"\x09\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Dense statistics: byte classes as shares of the text, then word statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"*", b"$%&#@", b"|<>{}[]\\/=_~^", b".,;:", b"\n\r", b"'\"()-"]
DENSE = len(_CLASSES) + 6


class Grams:
    """Positions of the n-grams of some texts: keys, and the text each belongs to."""

    def __init__(self, texts: list[bytes], lengths: tuple[int, ...]):
        data = np.frombuffer(b" " + b" ".join(texts).translate(_FOLD) + b" ", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.ends, self.lengths = np.cumsum(sizes), lengths
        self.data = data.astype(np.uint64)

    def each(self) -> Iterator[np.ndarray]:
        key = self.data
        for n in range(2, max(self.lengths) + 1):
            key = (key[:-1] << np.uint64(8)) | self.data[n - 1 :]
            if n in self.lengths:
                yield key | np.uint64(n << 56)

    def text_of(self, position: np.ndarray) -> np.ndarray:
        """An n-gram belongs to the text that its first byte is in or just before (the blank)."""
        return np.minimum(np.searchsorted(self.ends, position, side="right"), len(self.ends) - 1)


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys * _ODD) >> np.uint64(64 - BUCKET_BITS)


class Vocabulary:
    """Finds chosen n-grams: a bucket table rules out almost all positions, the exact key decides."""

    def __init__(self, keys: np.ndarray, lengths: tuple[int, ...]):
        self.keys, self.lengths = np.sort(keys.astype(np.uint64)), lengths
        self.table = np.zeros(1 << BUCKET_BITS, dtype=bool)
        self.table[bucket(self.keys)] = True

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, n-gram) index pairs, each once, sorted."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams, pairs = Grams(texts, self.lengths), []
        for keys in grams.each():
            at = np.flatnonzero(self.table[bucket(keys)])
            found = keys[at]
            index = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[index] == found
            pairs.append(grams.text_of(at[hit]) * len(self.keys) + index[hit])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.keys), pairs % len(self.keys)


def dense(texts: list[bytes]) -> np.ndarray:
    """DENSE statistics a text; all 0 for an empty one."""
    n = len(texts)
    out = np.zeros((n, DENSE))
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    kind = np.full(256, len(_CLASSES), dtype=np.int64)
    for i, members in enumerate(_CLASSES):
        kind[list(members)] = i
    kind[128:] = len(_CLASSES) + 1
    width = len(_CLASSES) + 2
    counts = np.bincount(np.repeat(np.arange(n) * width, sizes) + kind[data], minlength=n * width).reshape(n, width)
    some = np.maximum(sizes, 1)
    out[:, : len(_CLASSES)] = counts[:, : len(_CLASSES)] / some[:, None]
    out[:, len(_CLASSES)] = counts[:, -1] / some
    words = Words(texts)
    per = np.diff(words.bounds)
    have = np.maximum(per, 1)
    text_of = np.repeat(np.arange(n), per)
    order = np.lexsort((words.hash, text_of))
    h, t = words.hash[order], text_of[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] = (words.hash[1:] == words.hash[:-1]) & (text_of[1:] == text_of[:-1])
    out[:, -5] = np.log1p(per)
    out[:, -4] = np.bincount(t[fresh], minlength=n) / have
    out[:, -3] = np.bincount(text_of[twice], minlength=n) / have
    out[:, -2] = np.bincount(text_of, weights=words.end - words.start, minlength=n) / have
    out[:, -1] = np.bincount(text_of, weights=(words.end - words.start) == 1, minlength=n) / have
    return out


def choose_grams(sample: DataFrame, lengths: tuple[int, ...], kept: int = KEPT) -> np.ndarray:
    """The n-grams whose presence tells the classes apart best, by likelihood ratio: at most `kept` keys.

    sample: text, label (0 or 1). Two passes of per-partition counts, summed by key in Spark.
    """
    size = 1 << BUCKET_BITS

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            texts, labels = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for start, part in chunks(texts):
                grams = Grams(part, lengths)
                for keys in grams.each():
                    pairs = np.unique(grams.text_of(np.arange(len(keys))) * size + bucket(keys).astype(np.int64))
                    for y in (0, 1):
                        counts[y] += np.bincount(pairs[labels[start + pairs // size] == y] % size, minlength=size)
        yield from _counted(np.arange(size), counts)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=bool)
        table[best] = True
        seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for batch in batches:
            texts, labels = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for start, part in chunks(texts):
                grams = Grams(part, lengths)
                for keys in grams.each():
                    at = np.flatnonzero(table[bucket(keys)])
                    text, key = grams.text_of(at), keys[at]
                    order = np.lexsort((key, text))
                    text, key = text[order], key[order]
                    once = np.ones(len(key), dtype=bool)
                    once[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                    for y in (0, 1):
                        seen[y].append(key[once & (labels[start + text] == y)])
        both = [np.unique(np.concatenate(s) if s else np.zeros(0, np.uint64), return_counts=True) for s in (seen[0], seen[1])]
        keys = np.union1d(both[0][0], both[1][0])
        counts = np.zeros((2, len(keys)), dtype=np.int64)
        for y in (0, 1):
            counts[y, np.searchsorted(keys, both[y][0])] = both[y][1]
        yield from _counted(keys.view(np.int64), counts)

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.uint64)
    best = _best(sample, coarse, n0, n1, COARSE)
    return _best(sample, exact, n0, n1, kept).view(np.uint64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(counts.sum(axis=0))
    for i in range(0, len(some), 1 << 16):
        at = some[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int64()), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["key", "c0", "c1"])


def _best(sample: DataFrame, count, n0: int, n1: int, most: int) -> np.ndarray:
    """Keys with the highest likelihood-ratio statistic of presence against the label."""
    c = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(count, "key long, c0 long, c1 long").groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(F.col("c0") + F.col("c1") >= LEAST_TEXTS)

    def part(seen, of_row, of_column):
        return F.when(seen > 0, seen * F.log(seen * F.lit(float(n0 + n1)) / (of_row * of_column))).otherwise(0.0)

    held, rest = F.col("c0") + F.col("c1"), F.lit(n0 + n1) - F.col("c0") - F.col("c1")
    g = part(F.col("c0"), held, F.lit(n0)) + part(F.col("c1"), held, F.lit(n1)) + part(F.lit(n0) - F.col("c0"), rest, F.lit(n0)) + part(F.lit(n1) - F.col("c1"), rest, F.lit(n1))
    rows = c.select("key", g.alias("g")).where("g > 4").orderBy(F.desc("g"), "key").limit(most).collect()
    return np.array(sorted(r["key"] for r in rows), dtype=np.int64)


class Sparse:
    """Rows of 0/1 features: for each row a run of column numbers."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=self.n)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=errors[self.row], minlength=self.width)


def descend(gradient, width: int, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Adam from zero with a falling rate; gradient: weights -> gradient."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bounded_ids(rows: DataFrame, id_: str, most: int, seed: int) -> DataFrame:
    """All rows, or about `most` of them chosen by a hash of the id: the same rows on every run."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * most / n))
