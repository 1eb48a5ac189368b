"""Periodic runs of words: block matching on integer sequences.

A run of period q holds, within its first 2b words (b: the power of two with b <= q < 2b), an aligned block of b words
that recurs q words later. So for each scale b the aligned blocks of a text are searched across it by an Aho-Corasick
automaton over word numbers; an occurrence b to 2b - 1 words behind its block is a seed, and is extended exactly both
ways. Only blocks can recur so near all whose words recur within 2b - 1 words: the others are left out beforehand, which
leaves the automata small and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import WORD, as_bytes, table

#: A run is at least so many words long and so many times its period. The blocks find any run of three periods.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words compared in the first step of an extension; the steps double.
STEP = 64

Run = tuple[int, int, int]


def _distances(ids: np.ndarray) -> np.ndarray:
    """How many words later each word comes again; beyond any text where it does not."""
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), np.iinfo(np.int64).max)
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _extended(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """Bounds of the longest stretch around `at` in which words q apart are identical; at and at + q are."""
    n, end, step = len(ids), at, STEP
    while end + q < n:
        size = min(step, n - q - end)
        off = ids[end : end + size] != ids[end + q : end + q + size]
        if off.any():
            end += int(off.argmax())
            break
        end, step = end + size, 2 * step
    start, step = at, STEP
    while start > 0:
        size = min(step, start)
        off = ids[start - size : start] != ids[start - size + q : start + q]
        if off.any():
            start -= int(off[::-1].argmax())
            break
        start, step = start - size, 2 * step
    return start, end + q


def _primitive(word: np.ndarray) -> bool:
    """Whether a word is no repetition of a shorter one."""
    n = len(word)
    m, factor, factors = n, 2, []
    while factor * factor <= m:
        if m % factor == 0:
            factors.append(factor)
            while m % factor == 0:
                m //= factor
        factor += 1
    return not any((word[n // f :] == word[: n - n // f]).all() for f in [*factors, *([m] if m > 1 else [])])


class _Cover:
    """What the runs known so far, all of smaller periods than the blocks, hold."""

    def __init__(self, runs: list[Run]):
        rows = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
        self.start = rows[:, 0]
        longest = np.array([], dtype=np.int64) if not len(rows) else np.maximum.accumulate(rows[:, 1] * len(rows) + np.arange(len(rows))) % len(rows)
        self.end, self.period = rows[longest, 1], rows[longest, 2]

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, period) of the farthest run that begins at or before each place; 0, 0 for none."""
        i = np.searchsorted(self.start, at, side="right")
        some = np.append([0], self.end)[i]
        return some, np.append([0], self.period)[i]


def _seeds(ids: np.ndarray, at: np.ndarray, b: int, cover: _Cover) -> list[tuple[int, int]]:
    """(period, place) of each block `at` that recurs b to 2b - 1 words later, by one automaton over all the blocks.

    A block inside a run of a smaller period recurs in that run by multiples of it alone, which is the run again; and
    it overlaps the run's end by less than that period. So it is sought from there on, and only within 3b words.
    """
    end, period = cover.of(at)
    low, high = np.maximum(at + b, np.where(end >= at + b, end - period + 1, 0)), np.minimum(at + 3 * b, len(ids))
    some = high - low >= b
    at, low, high = at[some], low[some], high[some]
    if not len(at):
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    key_of, keys = {}, np.empty(len(at), dtype=np.int64)
    for i, place in enumerate(at.tolist()):
        block = tuple(ids[place : place + b].tolist())
        keys[i] = key_of.setdefault(block, len(key_of))
    for block, key in key_of.items():
        automaton.add_word(block, key)
    automaton.make_automaton()
    found = []
    # high rises with the places, so stretches that overlap are joined from left to right.
    low = np.minimum.accumulate(low[::-1])[::-1]
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    for left, right in zip(low[first].tolist(), high[np.append(first[1:], len(at)) - 1].tolist()):
        found += [(key, left + last - b + 1) for last, key in automaton.iter(tuple(ids[left:right].tolist()))]
    if not found:
        return []
    found = np.array(found, dtype=np.int64)
    # Occurrences in the order of (key, place): those of a block are a slice.
    line = np.sort(found[:, 0] * (len(ids) + 1) + found[:, 1])
    low = np.searchsorted(line, keys * (len(ids) + 1) + at + b)
    size = np.searchsorted(line, keys * (len(ids) + 1) + np.minimum(at + 2 * b, len(ids))) - low
    block = np.repeat(np.arange(len(at)), size)
    place = line[np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)] % (len(ids) + 1)
    fresh = cover.of(at[block])[0] < place + b
    return sorted(zip((place - at[block])[fresh].tolist(), at[block][fresh].tolist()))


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[Run]:
    """(start, length, period) of every run, by start and period. ids: the words as small numbers."""
    if times < 3:
        raise ValueError("blocks find only runs of three periods and more")
    n, b, known = len(ids), 1, set()
    if n < least:
        return []
    reach = _distances(ids)
    while times * b <= n:
        blocks = np.flatnonzero(reach < 2 * b) * b
        if len(blocks):
            last = (0, 0, 0)
            for q, at in _seeds(ids, blocks, b, _Cover(list(known))):
                if last[0] == q and last[1] <= at and at + q + b <= last[2]:
                    continue
                start, end = _extended(ids, at, q)
                last = (q, start, end)
                if end - start >= times * q and _primitive(ids[start : start + q]):
                    known.add((start, end, q))
        half = len(reach) // 2
        reach, b = np.maximum(reach[0 : 2 * half : 2], reach[1 : 2 * half : 2]), 2 * b
    return sorted((s, e - s, q) for s, e, q in known if e - s >= least)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that a run holds behind its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", id_: str = "doc_id", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed for every whole text.

    A run is a stretch of words of smallest period q, at least max(least, times * q) words long, that cannot be
    extended. collapsed: the words but those that some run holds behind its first q. A null or empty text, or one of
    white space, has no words, no runs and an empty collapsed text. Runs of equal place and other period are all given.
    Repeated rows each give a row, extra columns are not read, an empty table gives no row. Narrow: no shuffle, memory
    as the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in as_bytes(batch.column(1)):
                words, number = text.split(), {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                runs = find_runs(ids, least, times) if len(number) < len(words) else []
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _TYPE), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_, "n_words", "runs", "collapsed"])

    source = docs.select(docs[id_].cast("long").alias(id_), docs[text].cast("string").alias(text))
    return source.mapInArrow(run, f"{id_} long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """documents with the loops of the contract: of every tenth text, by a checksum of its id, the words from a on repeat
    the p words at a. Other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    loop = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), loop), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so of equal exponents the first one stays.
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
