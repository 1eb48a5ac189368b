"""Headlines kept up to date from the outbox: what a batch of changes adds to each user's sums and takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from khata.operators.aggregation import REALISED
from khata.sources.space import written
from khata.streaming.keyed import KeyedTable

_ENTRY = ("user_id", "direction", "amount_effective_paise", "is_counted", "net_status")
_TABLES = {
    "settlements": ("id", "id string, seq long, base_entry_id string, settle_entry_id string, paise long"),
    # realised_paise and legs are what settlements say of an entry, which may come before it.
    "entries": ("id", "id string, seq long, user_id string, direction string, amount_effective_paise long, is_counted boolean, net_status string, realised_paise long, legs long"),
    "sums": ("user_id", "user_id string, income_paise long, expense_paise long, bases long"),
}


def _table(spark: SparkSession, at: str, name: str) -> KeyedTable:
    key, ddl = _TABLES[name]
    return KeyedTable(spark, f"{at}/{name}", key, StructType.fromDDL(ddl))


def read_headlines(spark: SparkSession, at: str) -> DataFrame:
    """user_id, income_paise, expense_paise, savings_paise of every user with a counted base, as the last batch left them."""
    sums = _table(spark, at, "sums").read().where("bases > 0")
    return sums.select("user_id", "income_paise", "expense_paise", (F.col("income_paise") - F.col("expense_paise")).alias("savings_paise"))


def _last(rows: DataFrame) -> DataFrame:
    """The write of each id with the highest seq."""
    values = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*values), "seq").alias("v")).select("id", "v.*")


def _share(sign: int) -> list[Column]:
    """What an entry's row adds to its user: see operators.aggregation.contributions."""
    base = F.coalesce(F.col("is_counted") & (F.coalesce("net_status", F.lit("active")) != "is_reversal") & (F.col("legs") == 0), F.lit(False))
    left = F.col("amount_effective_paise") - F.col("realised_paise")
    of = lambda d: F.when(base & (F.col("direction") == d), sign * left).otherwise(0).alias(f"{d.lower()}_paise")
    return [of("INCOME"), of("EXPENSE"), F.when(base, sign).otherwise(0).alias("bases")]


def keep_headlines(changes: DataFrame, at: str, checkpoint: str) -> StreamingQuery:
    """A stream of changes into the sums in a folder; all that waits, then stops.

    changes: kind (entry, settlement), id, seq, the columns of entries (user_id, direction, amount_effective_paise,
    is_counted, net_status) and of settlements (base_entry_id, settle_entry_id, status, settled_amount_paise). The write
    of an id with the highest seq holds, so corrections and write-offs are writes like others. Work and shuffle are those
    of the batch and of the parts of the tables that its keys fall in; no batch reads the ledger.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        settlements, entries, sums = (_table(spark, at, n) for n in _TABLES)
        batch = written(batch)
        paise = F.when(F.col("status").isin(*REALISED), F.coalesce("settled_amount_paise", F.lit(0))).otherwise(0).cast("long")
        came = batch.where("kind = 'settlement'").select("id", F.col("seq").cast("long").alias("seq"), "base_entry_id", "settle_entry_id", paise.alias("paise"))
        had = written(settlements.lookup(came, number))
        now = written(_last(had.unionByName(came)))
        # What settlements said of their entries goes, what they say now comes.
        each = now.withColumn("sign", F.lit(1)).unionByName(had.withColumn("sign", F.lit(-1)))
        said = each.select(F.explode(F.array(F.struct(F.col("base_entry_id").alias("id"), (F.col("sign") * F.col("paise")).alias("paise"), F.lit(0).alias("leg")), F.struct(F.col("settle_entry_id").alias("id"), F.lit(0).cast("long").alias("paise"), F.col("sign").alias("leg")))).alias("x")).select("x.*").where("id is not null")
        said = written(said.groupBy("id").agg(F.sum("paise").alias("d_paise"), F.sum("leg").alias("d_legs")))
        wrote = batch.where("kind = 'entry'").select("id", F.col("seq").cast("long").alias("seq"), *_ENTRY)
        keys = wrote.select("id").unionByName(said.select("id")).distinct()
        before = written(entries.lookup(keys, number))
        # Entries that are not there yet have no user and count for nobody.
        values = _last(before.select("id", "seq", *_ENTRY).unionByName(wrote))
        after = keys.join(values, "id", "left").join(before.select("id", "realised_paise", "legs"), "id", "left").join(said, "id", "left")
        plus = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
        after = written(after.select("id", "seq", *_ENTRY, plus("realised_paise", "d_paise"), plus("legs", "d_legs")))
        moved = before.select("user_id", *_share(-1)).unionByName(after.select("user_id", *_share(1))).where("user_id is not null")
        names = ["income_paise", "expense_paise", "bases"]
        moved = written(moved.groupBy("user_id").agg(*(F.sum(n).cast("long").alias(n) for n in names)).where("income_paise <> 0 or expense_paise <> 0 or bases <> 0"))
        total = sums.lookup(moved, number).unionByName(moved).groupBy("user_id").agg(*(F.sum(n).cast("long").alias(n) for n in names))
        for table, rows in ((settlements, now), (entries, after), (sums, written(total))):
            table.put(rows, number)

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
