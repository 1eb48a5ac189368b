"""Helpers shared by the training-data operators: tables, shared folder, numpy text kernels, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.sources.space import shared_dir

#: Text bytes that a numpy kernel works on at a time; a longer single text is taken alone.
CHUNK_BYTES = 1 << 20
#: The white space that separates words, `[^\x20\x09-\x0D]+`.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: a short lineage that outlives executors.

    All tables of an application lie in one folder, which can go when its results have been read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/khata-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of what led here go as soon as the driver's JVM finds them unused; without this they would pile up
    # until it happens to collect, which for a small driver heap can be after the whole job.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "at") -> tuple[DataFrame, DataFrame]:
    """(df with the place of each row in an order as a long column, the written table that it reads): a range shuffle,
    the place within each partition, and the partitions' sizes, of which there is one row a partition."""
    mono = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", mono).withColumns({"_part": F.shiftright("_mono", 33), "_in": F.col("_mono") % (1 << 33)}).drop("_mono"))
    base, offsets = 0, []
    for r in sorted(placed.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], base))
        base += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _base long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in"), placed


#: Ids (8 bytes each) up to which a list of them is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A written table of ids, hinted by its size."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table made by cut() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, True)


def with_uid(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """uid, id, text, row: uid is a long in the order of the ids, one for each distinct (id, text); row: a struct of
    all columns but the text, so that no name can clash.

    Where ids are unique and not null they are the uids. Otherwise equal rows share one uid, and rows that share an id
    with different texts are told apart by a hash of the text; null ids come first. One distributed sort of ids.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    docs = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), row.alias("row"))
    ids = docs.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("id").isNull().cast("int"))).first()
    if (ids[0] or 1) == 1 and not ids[1]:
        return docs.select(F.col("id").alias("uid"), "id", "text", "row")
    keyed = docs.withColumn("h", F.xxhash64("text"))
    uids, _ = numbered(keyed.select("id", "h").distinct(), [F.asc_nulls_first("id"), F.asc("h")], "uid")
    return keyed.join(uids, keyed["id"].eqNullSafe(uids["id"]) & (keyed["h"] == uids["h"])).select("uid", keyed["id"], "text", "row")


def chunks(texts: Iterable[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about `most` bytes, so that a kernel's arrays stay small."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null becomes empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base mod 2^64 and of its inverse, grown on demand: substring hashes from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 12)
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, base, dtype=np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up, self.down


_POWERS = {}


def powers(base: int) -> Powers:
    return _POWERS.setdefault(base, Powers(base))


class Rolling:
    """Hashes of any substring of a symbol array in constant time each: (sums[end] - sums[start]) / base^start."""

    def __init__(self, symbols: np.ndarray, base: int = _P):
        n = len(symbols)
        up, self.down = powers(base).upto(n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_Q))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


class Words:
    """The words of some texts laid end to end: 64-bit hashes, byte bounds, and each text's run of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b" ".join([*texts, b""]) if texts else b""
        data = np.frombuffer(self.buffer.lower() if lower else self.buffer, dtype=np.uint8)  # bytes.lower: A-Z alone
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = Rolling(byte_symbols(data)).of(self.start, self.end) if len(data) else np.zeros(0, np.uint64)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values (one per start), by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n places that each one is tied to by the pairs i, j."""
    first = np.arange(n)
    while True:
        low, new = np.minimum(first[i], first[j]), first.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (id, component) with the smallest reachable id, for every id in an edge.

    edges: columns a, b (long). Alternating large-star and small-star steps; each round is one grouping of the
    edges by node, written to the shared folder. The number of edges never grows and no node's whole neighbourhood
    is held in memory: the minima are aggregates with map-side combination, and AQE splits a hot node's join.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    old = cut(edges)
    for _ in range(rounds):
        if old.isEmpty():
            return old.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = old.unionByName(old.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node is tied to the node's minimum.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(low.select("a", F.col("m").alias("b")).unionByName(tied).where("a <> b").distinct())
        # Stars only: a node that has a smaller one is no other node's minimum.
        again = new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi")
        many = new.groupBy("a").count().where("count > 1").select("a")
        done = again.unionByName(many).isEmpty()
        drop_cut(old)
        old = new
        if done:
            return old.select(F.col("a").alias("id"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
