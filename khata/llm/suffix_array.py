"""Suffix-array dedup: exact repeats of `window` bytes by column-wise construction over many documents.

The whole collection's suffixes are never sorted at once. Winnowed anchors (see anchors) bring together the places
where equal windows can be, as groups of short segments aligned on a common seed; equal segments are settled by
counting. A group's suffix order is then built column by column from the right: each round inserts one symbol per
document before the suffixes sorted so far, which updates the column of the collection's Burrows-Wheeler transform (the
inserted symbols in the old order), the order (a stable sort by symbol) and the common prefixes (one more than the
least between neighbours of one symbol). A suffix whose common prefix with a neighbour reaches `window` is a repeat.
Segments reach the rounds as sorted sequential shuffle files, in collections of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.anchors import LENGTH_BITS, Spec, per_text, repeated_runs
from khata.llm.common import as_bytes, chunks, cut, drop_cut, table, with_uid

WINDOW = 400
SEED = 64
#: Segments in one collection at least, and in one group at most: a larger group is split by content first.
COLLECTION = 8_000
GROUP = 20_000
_LENGTH = (1 << LENGTH_BITS) - 1
_SEGMENT = "key long, uid long, pos long, off int, seg binary"


def column_repeats(segments: list[bytes], offsets: np.ndarray, groups: np.ndarray, window: int, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset in it) of every window that also occurs, equally aligned, in another segment of its group;
    later: in one before it.

    offsets: where the common seed starts in each segment; groups: ascending. One round per column.
    """
    m = len(segments)
    left = int(offsets.max())
    width = left + int((np.array([len(s) for s in segments]) - offsets).max())
    rows = np.zeros((m, width), dtype=np.int16)  # 0: no symbol, the text has ended or not begun
    for i, s in enumerate(segments):
        rows[i, left - offsets[i] : left - offsets[i] + len(s)] = np.frombuffer(s, dtype=np.uint8)
        rows[i, left - offsets[i] : left - offsets[i] + len(s)] += 1
    columns = np.ascontiguousarray(rows.T)
    order = np.arange(m)
    border = np.concatenate([[True], groups[1:] != groups[:-1]])
    rank = ((np.cumsum(border) - 1) * 257).astype(np.int32)
    # end[k]: the column before which the suffixes order[k - 1] and order[k] agree; none across groups.
    end = np.where(np.append(border, False), -1, width).astype(np.int32)
    found_segment, found_at = [], []
    for x in range(width - 1, -1, -1):
        transform = columns[x][order]  # this column of the transform
        fresh = np.full(m, x, dtype=np.int32)
        for symbol in np.flatnonzero(np.bincount(transform)):
            at = np.flatnonzero(transform == symbol)
            if symbol and len(at) > 1:
                fresh[at[1:]] = np.minimum.reduceat(end, at + 1)[:-1]
        new = np.argsort(rank + transform, kind="stable")  # keeps the order of the longer suffixes
        order, transform, fresh = order[new], transform[new], fresh[new]
        fresh[1:][transform[1:] != transform[:-1]] = x
        fresh[border] = -1
        end[:m] = fresh
        hit = fresh - x >= window
        if hit.any():
            begin = np.flatnonzero(~hit)  # equal windows are neighbours in the order
            hit[:-1] |= hit[1:]
            if later:
                hit &= order > np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, m)))
            who = order[hit]
            found_segment.append(who)
            found_at.append(x - left + offsets[who])
    if not found_segment:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_segment), np.concatenate(found_at)


def _runs_of(segment: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, first, how many) of consecutive places."""
    order = np.lexsort((at, segment))
    segment, at = segment[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, int)
    for i, j in zip(new, np.append(new[1:], len(at))):
        yield int(segment[i]), int(at[i]), int(j - i)


def _collections(window: int, later: bool):
    """Sorted segments (key, uid, pos, off, seg) -> uid, pos of their repeated windows; later: of all but the first of each."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows])
        groups = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        found = column_repeats([r[4] for r in rows], np.array([r[3] for r in rows]), groups, window, later)
        spans = [(rows[i][1], ((rows[i][2] >> LENGTH_BITS) + at << LENGTH_BITS) | n) for i, at, n in _runs_of(*found)]
        return pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], names=["uid", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _segments(spec: Spec):
    """uid, text, spans -> key, uid, pos, off, seg of the runs that spans lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, uids = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            for start, part in chunks(texts):
                out, wanted = [], [set(batch.column(2)[start + i].as_py()) for i in range(len(part))]
                text, place, n, seed, _, off = spec.runs(part)
                for t, p, k, key, o in zip(text.tolist(), place.tolist(), n.tolist(), seed.view(np.int64).tolist(), off.tolist()):
                    if (pos := (p << LENGTH_BITS) | k) in wanted[t]:
                        out.append((key, uids[start + t], pos, o, part[t][p : p + k - 1 + spec.window]))
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "uid", "pos", "off", "seg"])


def _halves(window: int, span: int):
    """Segments of groups that are too large -> two smaller ones each, keyed by what all their windows share.

    Windows that start d symbols before the seed, d in one of `span` wide intervals, all hold the text from the seed
    less the interval's low end to the seed less its high end plus `window`: equal windows are in equal such groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, uid, pos, off, seg in zip(*(c.to_pylist() for c in batch.columns)):
                place, n = pos >> LENGTH_BITS, pos & _LENGTH
                for part in range((off - n + 1) // span, off // span + 1):
                    high, low = min(off, part * span + span - 1), max(off - n + 1, part * span)
                    first, count = off - high, high - low + 1  # windows first .. first + count - 1 of the segment
                    core = seg[off - part * span : off - (part * span + span - 1) + window]
                    name = hashlib.blake2b(b"%d %d %d " % (key, span, part) + core, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), uid, (place + first << LENGTH_BITS) | count, off - first, seg[first : first + count - 1 + window]))
            yield _batch(out)

    return run


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP, later: bool = False) -> DataFrame:
    """uid, spans of docs (uid, text): runs of windows that also start elsewhere, as pos values, for texts that have any.

    later: only of those that also start before, in a smaller uid or earlier in the same text.
    """
    spec = Spec(window, seed, False)
    found = repeated_runs(docs, spec)
    looked = found.where("open and first")
    large = looked.groupBy("seed").count().where(F.col("count") > group).select(F.col("seed").alias("key"))
    segments = cut(docs.join(per_text(looked).hint("shuffle_hash"), "uid").select("uid", "text", "spans").mapInArrow(_segments(spec), _SEGMENT))
    parts = [found.where("not first" if later else "copies > 1").select("uid", "pos")]
    small, span = segments, window
    if not large.isEmpty():
        small, rest = segments.join(large, "key", "left_anti"), segments.join(large, "key", "left_semi")
        while span > 1:
            span = -(-span // 4)
            pieces = cut(rest.mapInArrow(_halves(window, span), _SEGMENT).withColumns({"h": F.xxhash64("seg", "off"), "g": F.xxhash64(F.lit(7), "seg", "off")}))
            same = pieces.groupBy("key", "h", "g").agg(F.count("*").alias("copies"), F.min(F.struct("uid", "pos")).alias("one"))
            told = cut(pieces.join(same, ["key", "h", "g"]))
            drop_cut(pieces)
            first = F.struct("uid", "pos") == F.col("one")
            parts.append(told.where(~first if later else F.col("copies") > 1).select("uid", "pos"))
            alone = told.where(first).select("key", "uid", "pos", "off", "seg")
            counts = alone.groupBy("key").count()
            small = small.unionByName(alone.join(counts.where(F.col("count").between(2, group)).select("key"), "key", "left_semi"))
            rest = alone.join(counts.where(F.col("count") > group).select("key"), "key", "left_semi")
            if rest.isEmpty():
                break
    parts.append(small.repartition("key").sortWithinPartitions("key", "uid", "pos").mapInArrow(_collections(window, later), "uid long, pos long"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = cut(per_text(every))
    drop_cut(segments)
    drop_cut(found)
    return out


def merged_spans(pos: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal (start, end) covered by windows that start in runs."""
    start = pos >> LENGTH_BITS
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + (pos & _LENGTH) + window - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, spans of every row of docs.

    A byte goes if a string of `window` bytes over it also starts anywhere else, in another text or in its own. Null
    text is empty. Repeated rows are different places: what they share goes from all of them. Extra columns are not read.
    """
    docs = with_uid(docs, id_, text)
    spans = repeat_spans(docs, window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cuts, kept = [], [], []
            for t, pos in zip(as_bytes(batch.column(1)), batch.column(2)):
                gone = merged_spans(np.asarray(pos.as_py(), dtype=np.int64), window) if pos.is_valid else []
                edges = [0, *(e for span in gone for e in span), len(t)]
                size.append(len(t)), cuts.append(gone)
                kept.append(b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2])) if gone else t)
            removed = [s - len(k) for s, k in zip(size, kept)]
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            flat = pa.array([[e for span in c for e in span] for c in cuts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string()), flat],
                names=[id_, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
            )

    joined = docs.join(spans.hint("shuffle_hash"), "uid", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"{id_} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<long>")


def _repeated(named: DataFrame) -> bool:
    return not named.groupBy("uid").count().where("count > 1").isEmpty()


def strip_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with repeated passages of `window` bytes or more cut out of their texts, but for their first occurrence (by
    id, then place), and the count of characters set anew; all rows and columns stay. A cut keeps to whole characters;
    null texts stay null. Rows with an equal id and text are one document, which its own copy does not cut.
    """
    named = with_uid(docs, id_, text)
    spans = repeat_spans(named.select("uid", "text").dropDuplicates(["uid"]) if _repeated(named) else named.select("uid", "text"), window, seed, later=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, pos in zip(as_bytes(batch.column(1)), batch.column(2)):
                edges = [0]
                for a, b in merged_spans(np.asarray(pos.as_py(), dtype=np.int64), window):
                    while a < b and t[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
                        b -= 1
                    edges += [a, b]
                edges.append(len(t))
                out.append(b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2])).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    joined = named.join(spans.hint("shuffle_hash"), "uid", "left")
    row = named.schema["row"].dataType.simpleString()
    changed = joined.where("spans is not null").select("row", "text", "spans").mapInArrow(run, f"row {row}, text string")
    result = joined.where("spans is null").select("row", "text").unionByName(changed)
    columns = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    result = result.select(*columns)
    return result.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType)) if chars in docs.columns else result


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")
