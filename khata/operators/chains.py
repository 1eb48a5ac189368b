"""Chains of references: where a row's parent's parent ... ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.sources.space import written


def roots(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """child, root, hops of every link (child, parent; one parent a child): the end of its chain and how many links lead
    there; root and hops are null where the chain runs into a circle.

    Pointer doubling: each round a link that has not ended is replaced by two, and only such links are joined and written
    anew. A chain of which n links are left has one of every smaller number of links, so a round in which none ends
    leaves nothing but links that lead into circles.
    """
    going = links.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("at"), F.lit(1).cast("long").alias("hops"))
    known = going.select(F.col("child").alias("at"), F.lit(False).alias("ended")).distinct()
    now = written(going.join(known, "at", "left").select("child", "at", "hops", F.coalesce("ended", F.lit(True)).alias("ended")))
    done, going = now.where("ended"), now.where("not ended")
    while not going.isEmpty():
        further = done.unionByName(going).select(F.col("child").alias("at"), F.col("at").alias("_to"), F.col("hops").alias("_more"), "ended")
        now = written(going.drop("ended").join(further, "at").select("child", F.col("_to").alias("at"), (F.col("hops") + F.col("_more")).alias("hops"), "ended"))
        going = now.where("not ended")
        if now.where("ended").isEmpty():
            break
        done = done.unionByName(now.where("ended"))
    out = done.unionByName(going)
    return out.select(F.col("child").alias(child), F.when(F.col("ended"), F.col("at")).alias("root"), F.when(F.col("ended"), F.col("hops")).alias("hops"))


def merge_roots(merges: DataFrame) -> DataFrame:
    """gone, keep: each merged line with the line that finally holds it. merges: gone, keep, maybe seq.

    Of several keepers of one line the first confirmed counts (by seq, else the smallest): afterwards nothing was left on
    it to move. Merges that run in a circle leave every line of it where it was, and with them those that lead there.
    """
    order = ["seq", "keep"] if "seq" in merges.columns else ["keep"]
    first = merges.where("gone <> keep").groupBy("gone").agg(F.min_by("keep", F.struct(*order)).alias("keep"))
    return roots(first, "gone", "keep").where("root is not null").select("gone", F.col("root").alias("keep"))


def merge_lines(lines: DataFrame, instruments: DataFrame, entries: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after confirmed merges, chains of merges followed to their end: see operators.ledger.merge_lines."""
    from khata.operators import ledger

    return ledger.merge_lines(lines, instruments, entries, written(merge_roots(merges)))


def reversal_roots(entries: DataFrame) -> DataFrame:
    """id, root, hops: the entry that a reversal, or a reversal of reversals, is about in the end, known or not. An odd
    number of hops undoes it, an even one restores it; in a circle both are null."""
    return roots(entries.select("id", "reverses_entry_id"), "id", "reverses_entry_id")


def pool_groups(lines: DataFrame) -> DataFrame:
    """id, first, n: each credit pool that shows the same available credit as others of its user and issuer, with the
    smallest id among them and how many they are; operators.ledger.shared_pools without its pairs, so a line is one row.

    Unknown issuers are equal. Groups are counted before they meet their lines, so none has to fit in a task.
    """
    pools = lines.where("kind = 'credit_pool' and available_credit_paise is not null").withColumn("_issuer", F.struct("issuer"))
    keys = ["user_id", "_issuer", "available_credit_paise"]
    groups = pools.groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return pools.join(groups, keys).select("id", "first", "n")
