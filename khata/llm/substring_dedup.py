"""Substring dedup by seed and extend, on words.

Documents are joined on winnowed seeds of SEED words. Runs of windows that are equal around a seed are settled at once:
all but the first are repeats. Where texts differ around a common seed, matches are extended both ways window by
window: a window is a repeat if an equal one starts earlier. Maximal repeats are the unions of such windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.anchors import LENGTH_BITS, Spec, per_text, repeated_runs
from khata.llm.common import Rolling, Words, as_bytes, chunks, cut, drop_cut, table, with_uid

WINDOW = 20
SEED = 8


def _windows(window: int):
    """uid, text, spans -> uid, h1, h2, pos of every window of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, spans = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for start, part in chunks(as_bytes(batch.column(1))):
                words = Words(part)
                pos = [np.asarray(spans[start + i].as_py(), dtype=np.int64) for i in range(len(part))]
                text = np.repeat(np.arange(len(part)), [len(p) for p in pos])
                flat = np.concatenate(pos)
                n = flat & ((1 << LENGTH_BITS) - 1)
                place = np.repeat(flat >> LENGTH_BITS, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text = np.repeat(text, n)
                at = words.bounds[text] + place
                h1, h2 = (Rolling(words.hash, base).of(at, at + window).view(np.int64) for base in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))
                yield pa.RecordBatch.from_arrays([pa.array(uids[start + text], pa.int64()), pa.array(h1), pa.array(h2), pa.array((place << LENGTH_BITS) | 1)], names=["uid", "h1", "h2", "pos"])

    return run


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """uid, spans of docs (uid, text): runs of windows that also start earlier, as pos values; texts without any are not listed."""
    found = repeated_runs(docs, Spec(window, seed, True))
    look = per_text(found.where("open and first"))
    windows = cut(docs.join(look.hint("shuffle_hash"), "uid").select("uid", "text", "spans").mapInArrow(_windows(window), "uid long, h1 long, h2 long, pos long"))
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("uid", "pos")).alias("best"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(earliest, ["h1", "h2"]).where(F.struct("uid", "pos") != F.col("best")).select("uid", "pos")
    out = cut(per_text(later.unionByName(found.where("not first").select("uid", "pos"))))
    drop_cut(windows)
    drop_cut(found)
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (text), kept_sha256 of every row.

    A word goes if a window over it also starts earlier: in a smaller id, or before in the same text. Null text has no
    words; a text under `window` words loses none. Rows with an equal id and text are one document and share its
    result; rows with one id and different texts are ordered by a hash of the text. Extra columns are not read.
    """
    docs = with_uid(docs, id_, text)
    spans = repeat_spans(docs, window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, digest = [], [], [], []
            for t, spans in zip(as_bytes(batch.column(1)), batch.column(2)):
                words = t.split()  # of bytes: at the six characters that WORD excludes
                if spans.is_valid:
                    pos = np.asarray(spans.as_py(), dtype=np.int64)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, pos >> LENGTH_BITS, 1)
                    np.add.at(edge, (pos >> LENGTH_BITS) + (pos & ((1 << LENGTH_BITS) - 1)) + window - 1, -1)
                    stay = list(compress(words, np.cumsum(edge)[:-1] == 0))
                else:
                    stay = words
                total.append(len(words)), removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], names=[id_, "n_words", "n_removed", "kept", "kept_sha256"])

    joined = docs.join(spans.hint("shuffle_hash"), "uid", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"{id_} long, n_words long, n_removed long, kept string, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")
