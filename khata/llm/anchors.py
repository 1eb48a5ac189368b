"""Winnowed anchors: where the same windows of symbols can start in several places.

Every window of `window` symbols picks the seed (run of `seed` symbols) with the least hash in it; equal windows pick
equal seeds at equal offsets. Consecutive windows with one seed form a run, whose text spans from the first window's
start to the last one's end. Windows that are equal lie in runs with equal seeds; runs with an equal segment are equal
window by window, so that only runs that differ around a common seed need a closer look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Rolling, Words, as_bytes, byte_symbols, chunks, cut, drop_cut, mix64, window_min

#: A run's place and number of windows in one long: place << LENGTH_BITS | windows.
LENGTH_BITS = 12
#: Bits of a symbol's place in its batch: a text has under 2^31 symbols, and only a text alone makes a longer batch.
_PLACE_BITS = 32
#: Runs of a seed beyond which it is hot: LEAST_HOT, or a share of all that bounds the hot seeds to MOST_HOT.
LEAST_HOT, MOST_HOT = 5_000, 100_000
_SECOND = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Spec:
    window: int
    seed: int
    words: bool

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts end to end, each text's bounds)."""
        if self.words:
            words = Words(texts)
            return words.hash, words.bounds
        bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))])
        return byte_symbols(np.frombuffer(b"".join(texts), dtype=np.uint8)), bounds

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, place, windows, seed hash, segment hash, seed's offset from the place) of every run."""
        symbols, bounds = self.symbols(texts)
        n, w = len(symbols), self.window
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        if n < w:
            return none
        at = np.arange(n - self.seed + 1)
        seeds = Rolling(symbols).of(at, at + self.seed)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        picked = (window_min((seeds & ~low) | at.astype(np.uint64), w - self.seed + 1) & low).astype(np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        p = np.flatnonzero(np.arange(w, n + 1) <= bounds[1:][text_of[: n - w + 1]])
        if not len(p):
            return none
        chosen = picked[p]
        first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)]))
        last = np.append(first[1:], len(p)) - 1
        lo, hi, s = p[first], p[last], chosen[first]
        segments = mix64(Rolling(symbols, _SECOND).of(lo, hi + w) + (s - lo).astype(np.uint64))
        return text_of[lo], lo - bounds[text_of[lo]], hi - lo + 1, seeds[s], segments, s - lo


def runs(docs: DataFrame, spec: Spec) -> DataFrame:
    """uid, seed, seg, pos (see LENGTH_BITS) of every run of docs (uid, text); narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, part in chunks(as_bytes(batch.column(1))):
                text, place, windows, seed, segment, _ = spec.runs(part)
                pos = (place << LENGTH_BITS) | windows
                yield pa.RecordBatch.from_arrays([pa.array(uids[start + text], pa.int64()), pa.array(seed.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(pos)], names=["uid", "seed", "seg", "pos"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, seed long, seg long, pos long")


def repeated_runs(docs: DataFrame, spec: Spec) -> DataFrame:
    """uid, seed, seg, pos, open, first, copies of the runs whose seed occurs again, written to the shared folder.

    open: the seed has other segments too; first: no equal run starts earlier (by uid, then place); copies: equal runs.
    Counts per seed and per segment are aggregates with map-side combination. Runs of a hot seed are told by a
    broadcast of those seeds and dealt by their own place, so that no task has all runs of one.
    """
    every = runs(docs, spec)
    seeds = cut(every.groupBy("seed").agg(F.count("*").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("n > 1").select("seed", "n", (F.col("a") != F.col("b")).alias("open")))
    again = cut(_told(every, seeds, ["seed"]).where("n is not null").drop("n"))
    segments = cut(again.groupBy("seed", "seg").agg(F.min(F.struct("uid", "pos")).alias("best"), F.count("*").alias("n")).where("n > 1"))
    out = _told(again, segments, ["seed", "seg"]).withColumn("first", F.coalesce(F.struct("uid", "pos") == F.col("best"), F.lit(True)))
    out = cut(out.select("uid", "seed", "seg", "pos", "open", "first", F.coalesce("n", F.lit(1)).alias("copies")).where("open or copies > 1"))
    for done in (seeds, again, segments):
        drop_cut(done)
    return out


def _told(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows (uid, pos, ...) with the columns of facts (keys, n, ...), one row for each of the keys; null where there is none.

    The facts of hot keys are broadcast, MOST_HOT of them at most, and their rows dealt by their own place.
    """
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(LEAST_HOT, total // MOST_HOT)
    fact = F.struct(*(c for c in facts.columns if c not in keys))
    told = rows.join(F.broadcast(facts.where(hot).select(*keys, fact.alias("_hot"))), keys, "left")
    told = told.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64("uid", "pos")))
    told = told.join(facts.where(~hot).select(F.col(keys[0]).alias("_key"), *keys[1:], fact.alias("_cool")), ["_key", *keys[1:]], "left")
    return told.select(*rows.columns, F.coalesce("_hot", "_cool").alias("_fact")).select(*rows.columns, "_fact.*")


def per_text(rows: DataFrame) -> DataFrame:
    """uid, spans: the rows' pos values of each text, in order; as many as the text has places at most."""
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list("pos")).alias("spans"))
