"""Embedding near-dedup by sorted projection passes.

Every pass hashes vectors, less their mean, with its own random projections; the signs, concatenated, order the vectors
of a label lexicographically, so that near vectors tend to be neighbours. In each pass a vector is compared with its
block and at least its WINDOW next neighbours; verified pairs are united over the passes. How many passes there are is
measured on the data: PROBES vectors get a made partner each, just at the threshold, that is ordered with all the others,
and passes go on until all but MISSED of these partners have met a vector they are linked with. Links are then counted by
comparing every component with itself, tile by tile, so that no window cuts a dense group short. Equal vectors are one
class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import components, cut, drop_cut, numbered, table, united

#: Passes at least, and those of one batch, whose shuffles are gone before the next one's.
PASSES = 8
#: Share of the probes that all passes together may miss, and the number of probes: a fixed number of made vectors, so
#: that at 0.02 the share missed is known to about 0.003 (one standard error), however many rows there are.
MISSED = 0.02
PROBES = 2_000
PROJECTIONS = 48
WINDOW = 256
COSINE = 0.93
#: Positions in one block, compared with each other and the WINDOW before them.
BLOCK = 1024
#: Rows of a side of a component's tiles, about, and those of them whose cosines are held at once.
TILE, STRIP = 4096, 512
SEED = 11
#: A label has a mean of its own from this share of the rows on: so many means at most reach the driver.
OWN_MEAN = 0.01


def _usable(vector: str):
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _slots(classes: DataFrame, block: int) -> dict[tuple, int]:
    """(label or None for all, length) -> number of a mean; 2 / OWN_MEAN slots at most."""
    sizes = cut(classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(block, OWN_MEAN * total)
    lengths = sizes.groupBy("dim").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    own = sizes.where(F.col("n") >= least).collect()
    return {k: i for i, k in enumerate([*((None, r["dim"]) for r in lengths), *((r["label"], r["dim"]) for r in own)])}


def _means(classes: DataFrame, slots: dict[tuple, int]) -> dict[int, np.ndarray]:
    """The mean unit vector of each slot: sums of every task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            keys, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[int, list[int]] = {}
            for i, (key, v) in enumerate(zip(keys, vectors)):
                for k in ((None, len(v)), (key, len(v))):
                    if k in slots:
                        by.setdefault(slots[k], []).append(i)
            for slot, at in by.items():
                had = sums.setdefault(slot, [0, 0.0])
                had[0] += len(at)
                had[1] = had[1] + _unit([vectors[i] for i in at]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))], names=["slot", "n", "total"])

    if not slots:
        return {}
    parts = classes.select("label", "vector").mapInArrow(run, "slot int, n long, total array<double>").select("slot", "n", F.posexplode("total").alias("at", "x"))
    rows = parts.groupBy("slot", "at").agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("mean")).collect()
    return {r["slot"]: np.array(r["mean"]) for r in rows}


def _probes(classes: DataFrame, cosine: float) -> DataFrame:
    """cid, label, vector: the made partners of PROBES classes, chosen by a hash of their ids; written.

    A partner is the class's unit vector turned in a random direction until their cosine is just over the threshold.
    """
    near = min(cosine + 1e-6, 1.0)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, vector in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = _unit([vector])[0]
                side = np.random.default_rng([SEED, cid & (1 << 63) - 1]).standard_normal(len(x))
                side -= (side @ x) * x
                length = math.sqrt(side @ side)
                out.append((near * x + math.sqrt(1 - near * near) * side / length if length > 1e-9 else x).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["cid", "label", "vector"])

    some = classes.select("cid").distinct().orderBy(F.xxhash64("cid", F.lit(SEED)), "cid").limit(PROBES)
    label = dict(classes.dtypes)["label"]
    # PROBES ids of 8 bytes: a proven bound for the broadcast.
    return cut(classes.select("cid", "label", "vector").join(F.broadcast(some), "cid").mapInArrow(turn, f"cid long, label {label}, vector array<double>"))


def more_passes(done: int, met: int, probes: int, least: int) -> int:
    """Passes of the next batch, PASSES at most: 0 once all but MISSED of the probes have met in `least` passes or more."""
    missed = 1 - met / probes if probes else 0.0
    if missed <= MISSED:
        return max(0, min(PASSES, least - done))
    need = done * (math.log(MISSED) / math.log(missed) - 1) if 0 < missed < 1 else PASSES
    return max(1, min(PASSES, math.ceil(max(need, least - done))))


def _order_keys(first: int, passes: int, projections: int, slots: dict[tuple, int], means: dict[int, np.ndarray]):
    """cid, label, vector, probe -> cid, label, probe, pass, key: the signs of the passes' projections as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            cid = batch.column(0).to_numpy(zero_copy_only=False)
            labels, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = np.array([len(v) for v in vectors])
            key = np.zeros((len(vectors), passes), dtype=np.int64)
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.concatenate([np.random.default_rng([SEED, int(dim), first + p]).standard_normal((int(dim), projections)) for p in range(passes)], axis=1)
                at = np.flatnonzero(size == dim)
                x = _unit([vectors[i] for i in at])
                slot = np.array([slots.get((labels[i], int(dim)), slots.get((None, int(dim)), -1)) for i in at])
                for s in np.unique(slot[slot >= 0]):
                    x[slot == s] -= means[s]
                sign = (x @ planes[dim] > 0).reshape(len(at), passes, projections)
                key[at] = sign @ (1 << np.arange(projections - 1, -1, -1, dtype=np.int64))
            again = pa.array(np.repeat(np.arange(len(cid)), passes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), batch.column(3).take(again), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(cid))), pa.array(key.ravel())], names=["cid", "label", "probe", "pass", "key"])

    return run


def _positions(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, probe, pass, label, at; the written table that it reads), at: place in the order of (pass, label, key, cid)."""
    at, placed = numbered(keys, ["pass", "label", "key", "cid", "probe"])
    return at.drop("key"), placed


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y are linked. A pair whose product is next to the threshold is decided by its own sum, so
    that it is a link or none wherever the two meet."""
    product = x @ y.T
    near = product >= cosine
    i, j = np.nonzero(np.abs(product - cosine) < 1e-9)
    near[i, j] = (x[i] * y[j]).sum(axis=1) >= cosine
    return near


def _values(column: pa.Array) -> list:
    """The column's values; lists as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[1:-1] - ends[0]) if len(column) else []


def _grouped(solve):
    """A mapInArrow function that calls solve(rows) for each run of rows with one first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*map(_values, batch.columns)):
                if held and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _unite(cosine: float):
    """A block's rows (block, label, cid, probe, vector) -> a, b: every row tied to the first one it is linked with; and
    (a, null) for each probe of class a that is linked with a row. Probes tie no rows."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        label, cid = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        probe = np.array([r[3] for r in rows], dtype=bool)
        size = np.array([len(r[4]) for r in rows])
        first, met = np.arange(len(rows)), np.zeros(len(rows), dtype=bool)
        for dim in np.unique(size):
            some = np.flatnonzero(size == dim)
            x = _unit([rows[k][4] for k in some])
            near = _near(x, x, cosine) & (label[some][:, None] == label[some][None, :]) & ~probe[some][None, :]
            met[some] = probe[some] & near.any(axis=1)
            i, j = np.nonzero(np.triu(near & ~probe[some][:, None], 1))
            first = np.minimum(first, united(len(rows), some[i], some[j]))
        tied, known = np.flatnonzero(first != np.arange(len(rows))), cid[met]
        b = pa.array(np.concatenate([cid[tied], known]), mask=np.arange(len(tied) + len(known)) >= len(tied))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[first[tied]], known])), b], names=["a", "b"])

    return _grouped(solve)


def candidates(classes: DataFrame, cosine: float, passes: int, window: int, block: int) -> DataFrame:
    """a, b: pairs of classes (cid, label, vector) that verified links of the passes connect; written.

    passes: at least so many; more until the probes have met.
    """
    if block < 2 or window < 1:
        raise ValueError("a block holds two positions or more, a window one or more")
    slots = _slots(classes, block)
    means = _means(classes, slots)
    label = dict(classes.dtypes)["label"]
    probes = _probes(classes, cosine)
    rows = classes.select("cid", "label", "vector", F.lit(False).alias("probe")).unionByName(probes.withColumn("probe", F.lit(True)))
    asked = probes.select("cid").distinct().count()
    found, first, some = None, 0, max(1, min(PASSES, passes))
    while some:
        keys = rows.mapInArrow(_order_keys(first, some, PROJECTIONS, slots, means), f"cid long, label {label}, probe boolean, pass int, key long")
        at, placed = _positions(keys)
        # A row's own block, and the next one where that begins within the window.
        home = F.floor(F.col("at") / block)
        blocks = F.when(F.col("at") % block >= block - window, F.array(home, home + 1)).otherwise(F.array(home))
        sent = at.withColumn("block", F.explode(blocks)).select("cid", "probe", (F.col("block") * some + F.col("pass")).alias("block"), "label").join(rows.select("cid", "probe", "vector"), ["cid", "probe"])
        new = cut(sent.select("block", "label", "cid", "probe", "vector").repartition("block").sortWithinPartitions("block", "cid", "probe").mapInArrow(_unite(cosine), "a long, b long").distinct())
        drop_cut(placed)
        found = new if found is None else found.unionByName(new)
        first += some
        some = more_passes(first, found.where("b is null").select("a").distinct().count(), asked, passes)
    return found.where("b is not null")


def _count(cosine: float):
    """A tile's rows (tile, side, cid, copies, vector) -> cid, n: copies of the other side's classes that are linked."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        side = np.array([r[1] for r in rows])
        cid, copies = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        x = _unit([r[4] for r in rows])  # of one component, so of one length
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(rows), dtype=np.int64)
        if not (side < 2).all():  # a part of the component with itself
            p = q = np.arange(len(rows))
        for k in range(0, len(p), STRIP):
            strip = p[k : k + STRIP]
            near = _near(x[strip], x[q], cosine)
            if (side < 2).all():  # two different parts
                n[strip] += near @ copies[q]
                n[q] += near.T @ copies[strip]
            else:
                near[np.arange(len(strip)), strip] = False
                n[strip] += near @ copies[q]
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(n[some])], names=["cid", "n"])

    return _grouped(solve)


def count_links(classes: DataFrame, found: DataFrame, cosine: float, tile: int) -> DataFrame:
    """cid, n: linked rows of other classes, from all pairs of each component, in tiles of about `tile` by `tile`."""
    member = classes.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    tiles = found.groupBy("component").agg((F.floor(F.count("*") / tile) + 1).alias("tiles"))
    member = member.join(tiles, "component").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles"))).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    name = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    rows = member.select(F.struct("component", name).alias("t"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "cid", "copies", "vector")
    rows = rows.select(F.to_json("t").alias("tile"), "side", "cid", "copies", "vector").repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(_count(cosine), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_: str = "vec_id", vector: str = "embedding", label: str = "label", passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept for every row of vectors.

    Only vectors of one label, not null, are compared, in double precision. Vectors that are null, empty, zero or hold
    null or non-finite components, and those of null label, link with nothing; so do vectors of different lengths.
    Repeated rows (an equal id, label and vector) are one vector, each row its result. Extra columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable("vector")).distinct()
    # The digest names a vector in the joins; equal vectors of a label are linked without being compared.
    named = usable.withColumn("digest", F.sha2(F.to_json(F.struct("vector")), 256))
    groups = named.groupBy("label", "digest").agg(F.min("id").alias("cid"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = cut(groups)
    member = cut(named.select("id", "label", "digest").join(classes.select("label", "digest", "cid", "copies"), ["label", "digest"]).select("id", "cid", "copies"))
    tied = candidates(classes.select("cid", "label", "vector"), cosine, passes, window, block)
    found = components(tied)
    other = count_links(classes.select("cid", "copies", "vector"), found, cosine, tile)
    whole = member.join(other, "cid", "left").join(found.withColumnRenamed("id", "cid"), "cid", "left")
    whole = whole.select("id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    whole = whole.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(whole, "id", "left")
    return out.select(F.col("id").alias(id_), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
