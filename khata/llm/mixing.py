"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are cut into blocks of about BLOCK_WORDS words by a hash of the document; a source's blocks are drawn in a
permuted order until its target is reached, the last block in part, so that the words taken are exact. How many of
each source's drawn blocks every output shard gets is decided by a binary tree over the shards: a node's exact block
quotas are split between its halves by one multivariate hypergeometric draw, seeded by the node. Each shard replays
its own path from the root, which also gives it a range of its own in every source's permuted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.llm.common import WORD, cut, table

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, and no source beyond it.
MOST_REPEATS = 3
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
#: Blocks in a run of the two-level prefix sums.
RUN = 1024
#: Sources up to which their table (a row each of about 100 bytes) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 200_000
#: Two primes: one of them has no factor in common with a number of blocks, which makes the affine map a permutation.
_PRIMES = (1_000_003, 1_000_033)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, words -> source_id (rank by code point, null last), target: weighted shares of all words, capped at
    `most` times a source's own, the excess reshared by weight until no source is above. One row per source."""
    everything = Window.partitionBy()
    ranked = sources.withColumn("source_id", F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last("source"))) - 1)
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("share", share).withColumn("cap", F.col("words") * float(most))
    # Sources in the order in which they reach their caps as the level rises; the level where the next one does not.
    by_ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("share"), "source_id")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("share").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("share"), F.struct(F.row_number().over(by_ratio).alias("k"), "level"))).over(everything)["level"])
    return ranked.withColumn("target", F.least("cap", F.coalesce(F.col("share") * F.col("level"), F.col("cap")))).select("source", "source_id", "words", "rows", "target")


def split(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each source's drawn blocks that go to one shard: its path down the splitting tree."""
    low, high, first, have = 0, shards, np.zeros_like(quotas), quotas
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        # Equal shards; the last blocks that do not divide go to the leftmost ones.
        left = -(-int(have.sum()) * (middle - low) // (high - low))
        part = rng.multivariate_hypergeometric(have, left, method="marginals")
        if shard < middle:
            high, have = middle, part
        else:
            low, first, have = middle, first + part, have - part
    return first, have


def mix(docs: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of docs.

    taken: words the mix takes, repeats counted; shards: the output shard of each repeat, the partial one last.
    Null text has size 0; null is a source of its own, the last. Equal rows count each. Reruns agree: every choice
    hangs on a hash of the id and the seed. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), words.alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    source_table = cut(
        targets(per, weights, most)
        .withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("words"))).cast("long"))
        .withColumn("blocks", F.ceil(F.greatest(F.col("words"), F.lit(1)) / block_words).cast("long"))
        .withColumn("step", F.when(F.col("blocks") % _PRIMES[0] != 0, _PRIMES[0]).otherwise(_PRIMES[1]))
        .withColumn("shift", F.pmod(F.xxhash64("source_id", F.lit(seed)), F.col("blocks")))
    )
    few = source_table.count() <= BROADCAST_SOURCES
    of_source = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    placed = sized.join(of_source(source_table.select("source", "source_id", "blocks", "step", "shift")), sized["source"].eqNullSafe(source_table["source"])).select(
        "doc_id", "size", "source_id", F.pmod(F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")) * F.col("step") + F.col("shift"), F.col("blocks")).alias("place")
    )
    # Prefix sums of the permuted blocks: within runs, and over runs.
    blocks = placed.groupBy("source_id", "place").agg(F.sum("size").alias("words")).withColumn("run", F.floor(F.col("place") / RUN))
    in_run = Window.partitionBy("source_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("source_id", "run").agg(F.sum("words").alias("words")).select("source_id", "run", F.coalesce(F.sum("words").over(over_runs), F.lit(0)).alias("base"))
    blocks = blocks.withColumn("inner", F.coalesce(F.sum("words").over(in_run), F.lit(0))).join(runs, ["source_id", "run"])
    blocks = blocks.join(of_source(source_table.select("source_id", "whole", "rest", "blocks")), "source_id")
    blocks = cut(blocks.select("source_id", "place", "whole", "blocks", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("base") - F.col("inner"))).alias("part"), "words"))

    # Draws of a source: all its blocks `whole` times, then the first ones of the permuted order.
    drawn = blocks.groupBy("source_id").agg(F.max(F.when(F.col("part") > 0, F.col("place") + 1).otherwise(0)).alias("last"))
    per_source = source_table.join(drawn, "source_id", "left").select("source_id", (F.col("whole") * F.col("blocks") + F.coalesce("last", F.lit(0))).alias("n"), "words").orderBy("source_id").collect()
    quotas = np.array([r["n"] for r in per_source], dtype=np.int64)
    shards = max(1, -(-sum(r["words"] for r in per_source) // shard_words))

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                first, count = split(quotas, shards, int(shard), seed)
                some = np.flatnonzero(count)
                yield pd.DataFrame({"shard": np.full(len(some), shard, np.int32), "source_id": some.astype(np.int32), "first": first[some], "count": count[some]})

    slots = spark.range(shards).mapInPandas(ranges, "shard int, source_id int, first long, count long").select("shard", "source_id", F.explode(F.expr("sequence(first, first + count - 1)")).alias("slot"))
    repeats = blocks.withColumn("repeat", F.explode(F.expr("sequence(0, whole)"))).where("repeat < whole or part > 0")
    repeats = repeats.select("source_id", "place", "repeat", (F.col("repeat") * F.col("blocks") + F.col("place")).alias("slot"))
    homes = repeats.join(slots, ["source_id", "slot"]).groupBy("source_id", "place").agg(F.array_sort(F.collect_list(F.struct("repeat", "shard"))).alias("homes"))
    blocks = blocks.join(homes, ["source_id", "place"], "left")

    # The block that the target cuts: its documents in a hashed order, the last one in part.
    whole = placed.join(blocks.drop("blocks"), ["source_id", "place"])
    order = Window.partitionBy("source_id", "place").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.when(F.col("part") == F.col("words"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least("size", F.col("part") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    taken = whole.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    shown = F.filter("homes", lambda h: (h["repeat"] < F.col("whole")) | (F.col("extra") > 0))
    back = of_source(source_table.select("source_id", F.col("words").alias("source_size"), "target"))
    return taken.join(back, "source_id").select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.transform(shown, lambda h: h["shard"]), F.array().cast("array<int>")).alias("shards"))


def shard_rows(mixed: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document and repeat: shard, order, doc_id, words; shuffled within each shard by a seeded hash."""
    copies = mixed.select("doc_id", "size", "taken", F.posexplode("shards").alias("repeat", "shard"))
    words = F.least(F.col("size"), F.col("taken") - F.col("repeat") * F.col("size"))
    return copies.select("shard", F.xxhash64("doc_id", "repeat", F.lit(seed + 2)).alias("order"), "doc_id", words.alias("words")).repartition("shard").sortWithinPartitions("shard", "order")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
