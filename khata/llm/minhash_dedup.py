"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has SYMBOLS minima of BITS bits each. Two texts at the similarity threshold differ in few symbols; up to
RADIUS of them, the pigeonhole principle leaves one of CHUNKS chunks with at most one error, so all pairs within RADIUS
meet under a key that is a chunk less one of its symbols. Equal shingle sets are one class and take part once. Buckets
first tie their members to their medoid, which settles groups of copies without their pairs. Then all members that are
still in different components meet. Where few pairs a row do, those pairs are confirmed; where most of a bucket does,
as in a group of half-similar texts, no pair becomes a row: the group's full sets are compared tile by tile, and a tile
returns no more links than it has rows. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import Rolling, Words, as_bytes, chunks, components, cut, drop_cut, mix64, small_side, table, united, with_uid

SYMBOLS, BITS, CHUNKS = 64, 16, 14
#: Differing symbols within which all pairs are found: fewer than two in each chunk. At a similarity of 0.8 12.8 of 64
#: symbols differ on average, and more than 27 in under one pair of 100,000.
RADIUS = 2 * CHUNKS - 1
SHINGLE = 2
#: Links: 100 * shared >= PERCENT * united.
PERCENT = 80
#: Members of a bucket that are compared with each other at once.
TILE = 1_000
#: Pairs a row within the radius beyond which a tile is dense: its rows are then compared as a group.
DENSE = 1
#: Bytes of a tile's side of full sets; a row weighs ROW_BYTES besides its set.
TILE_BYTES, ROW_BYTES = 8 << 20, 2_048
#: Places whose keys alone tie groups together at first; the later comparisons take all.
STAR_PLACES = (0, 20, 40, 60)
#: Pairs of one text that are confirmed in one group; more are salted over several.
STAR = 2_000

_CHUNK_OF = np.array([len(p) for p in np.array_split(np.arange(SYMBOLS), CHUNKS)])
_RNG = np.random.default_rng(20_240_229)
_XOR = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct k-word shingles, sorted; all its words as one where it has fewer."""
    words = Words(texts, lower=True)
    size = np.diff(words.bounds)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(texts)), count)
    at = words.bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(at + k, words.bounds[text + 1])
    h = Rolling(words.hash, 0xE7037ED1A0B428DB).of(at, end)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS symbols for every non-empty set."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(begin), SYMBOLS), dtype=np.uint16)
    for s in range(SYMBOLS if len(begin) else 0):
        least = np.minimum.reduceat((hashes ^ _XOR[s]) * _ODD[s], begin)
        out[:, s] = mix64(least) & np.uint64((1 << BITS) - 1)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """SYMBOLS keys a row: each chunk without each one of its symbols (one error allowed, wherever it is)."""
    place = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    term = mix64(signature.astype(np.uint64) + (place << np.uint64(20)))
    starts = np.cumsum(_CHUNK_OF) - _CHUNK_OF
    total = np.repeat(np.add.reduceat(term, starts, axis=1), _CHUNK_OF, axis=1)
    return mix64(total - term + place * np.uint64(0x9E3779B97F4A7C15))


def features(docs: DataFrame, k: int) -> DataFrame:
    """uid, n, s1, s2 (128 bits that name the set), sig of docs (uid, text); sig is null for an empty set. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(as_bytes(batch.column(1))):
                h, bounds = shingle_sets(part, k)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                names = np.zeros((2, len(part)), dtype=np.uint64)
                for i in (0, 1):
                    if len(some):
                        names[i, some] = np.add.reduceat(mix64(h + np.uint64(i)), bounds[some])
                sig: list = [None] * len(part)
                for i, row in zip(some.tolist(), signatures(h, bounds)):
                    sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(n, pa.int64()), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(sig, pa.binary())], names=["uid", "n", "s1", "s2", "sig"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, n long, s1 long, s2 long, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            uid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            place = np.tile(np.arange(SYMBOLS, dtype=np.int8), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).ravel().view(np.int64)), pa.array(place), pa.array(uid)], names=["key", "place", "uid"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of every row of a and row of b."""
    out = np.empty((len(a), len(b)), dtype=np.int16)
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] != b[None, :, :]).sum(axis=2)
    return out


def _first_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first place whose key the signatures of each row of x and y share; SYMBOLS where they share none."""
    out = np.empty(len(x), dtype=np.int64)
    starts = np.cumsum(_CHUNK_OF) - _CHUNK_OF
    for i in range(0, len(x), 1 << 16):
        wrong = x[i : i + (1 << 16)] != y[i : i + (1 << 16)]
        others = np.repeat(np.add.reduceat(wrong, starts, axis=1, dtype=np.int8), _CHUNK_OF, axis=1) - wrong
        out[i : i + (1 << 16)] = np.where((others == 0).any(axis=1), (others == 0).argmax(axis=1), SYMBOLS)
    return out


def _far(side: np.ndarray, c: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rows, distances) of a tile's two parts, or of its only part twice; SYMBOLS + 1 where no link can be."""
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    p, q = (p if len(p) else q), (q if len(q) else p)
    # The low byte of every symbol is enough to rule pairs out: it can only make them look nearer.
    low = sig.astype(np.uint8)
    d = _distances(low[p], low[q])
    small, large = np.minimum(n[p][:, None], n[q][None, :]), np.maximum(n[p][:, None], n[q][None, :])
    d[(c[p][:, None] == c[q][None, :]) | (100 * small < percent * large)] = SYMBOLS + 1
    return p, q, d


def _by_tile(solve, empty: pa.RecordBatch):
    """A mapInArrow function: the record batch of solve(rows) for each run of rows with one first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = [], [empty], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    out.append(solve(held))
                    size += out[-1].num_rows
                    held = []
                    if size > 200_000:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, size = [empty], 0
                held.append(row)
        if held:
            out.append(solve(held))
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _pairs(a: np.ndarray, b: np.ndarray, dense: bool) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(np.full(len(low), dense))], names=["a", "b", "dense"])


_NO_IDS = np.zeros(0, np.int64)


def _columns(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """side, place, uid, c, n, sig of a tile's rows."""
    side, place, uid, c, n = (np.array([r[i] for r in rows]) for i in range(1, 6))
    return side, place, uid, c, n, np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint16).reshape(-1, SYMBOLS)


def _stars(percent: int):
    """Tiles of (tile, side, place, uid, c, n, sig) -> every member within RADIUS of the tile's medoid, with it."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        side, _, uid, c, n, sig = _columns(rows)
        p, q, d = _far(side, c, n, sig, percent)
        medoid = np.minimum(d, RADIUS + 1).sum(axis=0).argmin()
        near = p[d[:, medoid] <= RADIUS]
        return _pairs(uid[near], np.full(len(near), uid[q[medoid]]), False)

    return _by_tile(solve, _pairs(_NO_IDS, _NO_IDS, False))


def _meetings(percent: int):
    """Tiles of (tile, side, place, uid, c, n, sig) -> a < b, dense: pairs within RADIUS of different c.

    A pair counts at the first key that its two signatures share and nowhere else. Of a tile with more than DENSE pairs
    a row only ties come out, dense: each row with the first one, by uid, that such pairs lead to.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        side, place, uid, c, n, sig = _columns(rows)
        p, q, d = _far(side, c, n, sig, percent)
        i, j = np.nonzero(d <= RADIUS)
        if len(p) == len(rows):
            i, j = i[i < j], j[i < j]
        dense = len(i) > DENSE * len(rows)
        here = _first_places(sig[p[i]], sig[q[j]]) == place[0]
        i, j = p[i[here]], q[j[here]]
        if not dense:
            return _pairs(uid[i], uid[j], False)
        first = united(len(rows), i, j)
        tied = np.flatnonzero(first != np.arange(len(rows)))
        return _pairs(uid[first[tied]], uid[tied], True)

    return _by_tile(solve, _pairs(_NO_IDS, _NO_IDS, False))


def tiled(rows: DataFrame, limit: int) -> DataFrame:
    """rows (key, uid, c, weight, ...) with tile and side, so that all pairs of different c of a key meet in a tile.

    Keys of one c are left out. The component with most of a key's weight is cut into parts that only meet the parts of
    the rest, so that a component of any size costs its own rows, and the rest's once for each of its parts.
    """
    hot = rows.groupBy("key", "c").agg(F.sum("weight").alias("w")).groupBy("key").agg(F.max_by("c", F.struct("w", "c")).alias("hot"), F.max("w").alias("most"), F.sum("w").alias("whole"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = rows.join(hot.drop("kinds"), "key").withColumn("parts", F.expr(f"struct(floor(most / {limit}) + 1 AS hot, floor((whole - most) / {limit}) + 1 AS rest)"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid", "key"), F.when(F.col("c") == F.col("hot"), F.col("parts.hot")).otherwise(F.col("parts.rest"))))
    place = "struct({kind} AS kind, {x} AS x, {y} AS y, {side} AS side)".format
    among = F.expr(f"transform(sequence(0, parts.rest - 1), i -> {place(kind=1, x='least(own, i)', y='greatest(own, i)', side='int(own > i)')})")
    of_rest = F.concat(F.expr(f"transform(sequence(0, parts.hot - 1), i -> {place(kind=2, x='i', y='own', side=1)})"), among)
    of_hot = F.expr(f"transform(sequence(0, parts.rest - 1), i -> {place(kind=2, x='own', y='i', side=0)})")
    one = F.expr(f"array({place(kind=0, x='0L', y='0L', side=0)})")
    rows = rows.withColumn("at", F.explode(F.when(F.col("whole") <= limit, one).when(F.col("c") == F.col("hot"), of_hot).otherwise(of_rest)))
    return rows.withColumn("tile", F.xxhash64("key", "at.kind", "at.x", "at.y")).withColumn("side", F.col("at.side"))


_PAIRS = "a long, b long, dense boolean"
_TILE = ("tile", "side", "place", "uid", "c", "n", "sig")


def star_pairs(buckets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """a < b, distinct: members of a bucket (key, place, uid, size) with the medoid of their tile. placed: uid, c, n, sig."""
    rows = buckets.where(F.col("place").isin(*STAR_PLACES)).join(placed, "uid").withColumn("side", F.lit(0))
    rows = rows.withColumn("tile", F.xxhash64("key", F.pmod(F.xxhash64("uid", "key"), F.floor(F.col("size") / TILE) + 1)))
    return rows.select(*_TILE).repartition("tile").sortWithinPartitions("tile").mapInArrow(_stars(percent), _PAIRS).select("a", "b").distinct()


def meetings(buckets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """a < b, dense: see _meetings. buckets: key, place, uid, size; placed: uid, c, n, sig."""
    rows = tiled(buckets.join(placed, "uid").withColumn("weight", F.lit(1)), TILE)
    return rows.select(*_TILE).repartition("tile").sortWithinPartitions("tile", "uid").mapInArrow(_meetings(percent), _PAIRS).distinct()


def _linked(k: int, percent: int):
    """Tiles of (tile, side, uid, c, n, sig, text) -> a, b: links that join components, no more than the tile has rows."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        side, uid, c, n = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        sig = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint16).reshape(-1, SYMBOLS)
        h, bounds = shingle_sets([(r[6] or "").encode() for r in rows], k)
        _, h = np.unique(h, return_inverse=True)
        p, q, d = _far(side, c, n, sig, percent)
        kind = np.unique(c, return_inverse=True)[1]
        mark, a, b = np.zeros(len(h) + 1, dtype=bool), [], []
        for i, row in enumerate(p):
            near = q[(d[i] <= RADIUS) & (kind[q] != kind[row])]
            if not len(near):
                continue
            mine, size = h[bounds[row] : bounds[row + 1]], n[near]
            mark[mine] = True
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(bounds[near] - (ends - size), size)
            shared = np.add.reduceat(mark[h[at]], ends - size, dtype=np.int64)
            mark[mine] = False
            for other in near[100 * shared >= percent * (len(mine) + size - shared)]:
                if kind[other] != kind[row]:
                    a.append(uid[row]), b.append(uid[other])
                    kind[kind == kind[other]] = kind[row]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return _by_tile(solve, pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"]))


def group_links(groups: DataFrame, placed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between different c that connect what links connect in each group (id, component), written."""
    member = cut(groups.select(F.col("id").alias("uid"), F.col("component").alias("key")).join(placed, "uid").withColumn("weight", 8 * F.col("n") + ROW_BYTES))
    texts = cut(docs.select("uid", "text").join(small_side(member.select("uid")), "uid", "left_semi").dropDuplicates(["uid"]))
    rows = tiled(member, TILE_BYTES).select("tile", "side", "uid", "c", "n", "sig").join(texts, "uid").select("tile", "side", "uid", "c", "n", "sig", "text")
    links = cut(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_linked(k, percent), "a long, b long"))
    drop_cut(texts)
    drop_cut(member)
    return links


def _confirm(k: int, percent: int):
    """Rows by (a, salt), that of a itself first -> the pairs that are links on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            others = batch.column(2).to_pylist()
            links = []
            for start, part in chunks(as_bytes(batch.column(3))):
                h, bounds = shingle_sets(part, k)
                for i in range(len(part)):
                    mine, at = h[bounds[i] : bounds[i + 1]], start + i
                    if others[at] is None:
                        group, own = groups[at], mine
                        continue
                    assert group == groups[at]
                    place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    shared = int((own[place] == mine).sum())
                    if 100 * shared >= percent * (len(own) + len(mine) - shared):
                        links.append((group[0], others[at]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are links on the full sets. A text goes once to each text it is paired with; stars are salted."""
    ids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    texts = cut(docs.select("uid", "text").join(small_side(cut(ids)), "uid", "left_semi"))
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("salts"))
    salted = pairs.join(count, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    own = count.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")).join(texts, F.col("a") == texts["uid"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    other = salted.join(texts, salted["b"] == texts["uid"]).select("a", "salt", "b", "text")
    rows = own.unionByName(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = cut(rows.mapInArrow(_confirm(k, percent), "a long, b long"))
    drop_cut(texts)
    return links


def grouped(named: DataFrame, shingle: int, percent: int) -> DataFrame:
    """uid, n_shingles, component (its smallest uid) of every uid of named (uid, text)."""
    docs = named.select("uid", "text")
    known = cut(features(docs, shingle).distinct())
    # Equal sets: one class, named and represented by its smallest uid.
    first = known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"))
    classes = cut(known.join(first, ["n", "s1", "s2"], "left").select("uid", "n", F.coalesce("rep", "uid").alias("rep"), F.when(F.col("uid") == F.col("rep"), F.col("sig")).alias("sig")))
    drop_cut(known)
    sigs = classes.where("sig is not null").select("uid", "n", "sig")
    keys = sigs.select("uid", "sig").mapInArrow(_keys, "key long, place byte, uid long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(keys.join(shared, "key").select("key", "place", "uid", "size"))
    pairs = cut(star_pairs(buckets, sigs.withColumn("c", F.col("uid")), percent))
    links = confirm(pairs, docs, shingle, percent)
    drop_cut(pairs)
    known = components(links)
    placed = sigs.join(known.withColumnRenamed("id", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("c"), "n", "sig")
    met = cut(meetings(buckets, placed, percent))
    links = links.unionByName(confirm(met.where("not dense").select("a", "b"), docs, shingle, percent))
    dense = met.where("dense").select("a", "b")
    if not dense.isEmpty():
        links = links.unionByName(group_links(components(dense), placed, docs, shingle, percent))
    found = components(links)
    drop_cut(met)
    drop_cut(buckets)
    return classes.join(found, classes["rep"] == found["id"], "left").select("uid", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs.

    Null, empty and wordless texts have an empty set and are their own components. Equal sets are linked. Repeated
    rows are equal documents: one component, each row its result. Extra columns are not read.
    """
    named = with_uid(docs, id_, text)
    whole = grouped(named, shingle, percent)
    names = named.select("uid", F.col("id")).distinct()
    out = whole.join(names, "uid").join(names.select(F.col("uid").alias("component"), F.col("id").alias("component_id")), "component")
    result = named.select("uid", F.col("id").alias(id_)).join(out.drop("id"), "uid")
    return result.select(id_, "n_shingles", "component_id", F.col(id_).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less all but the first document (by id, null ids first) of each component of near duplicates; all columns stay.

    Of rows with an equal id and text one stays. Rows that share an id with different texts are judged each by its own.
    """
    named = with_uid(docs, id_, text)
    rejected = cut(grouped(named, shingle, percent).where("uid <> component").select("uid"))
    kept = named.join(small_side(rejected), "uid", "left_anti")
    if not named.groupBy("uid").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["uid"])
    return kept.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
