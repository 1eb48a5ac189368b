"""Messages and entries as streams: the batch expressions on streaming frames, and what needs state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from khata.functions.gating import gate
from khata.functions.interest import TOLERANCE
from khata.sources.space import written
from khata.streaming.keyed import KeyedTable

#: How long a retry or a late part may come after the first.
RETRY = "7 days"


def admitted(messages: DataFrame, denylist: DataFrame | None = None) -> DataFrame:
    """Messages that pass the gate; stateless, the same in batch."""
    return gate(messages, denylist).where("gate.admit")


def buffered(messages: DataFrame) -> DataFrame:
    """One-time codes, to be kept for a short while and dropped."""
    return gate(messages).where("gate.buffered")


def once(entries: DataFrame, key: str = "entry_id", time: str = "received_at") -> DataFrame:
    """The first of each id within RETRY: pure retries. Where values change, drain() keeps the last instead."""
    return entries.withWatermark(time, RETRY).dropDuplicatesWithinWatermark([key])


def near_duplicates(entries: DataFrame, seconds: int = 120) -> DataFrame:
    """Pairs as operators.ledger.near_duplicates, by a stream-stream join within watermarks."""
    e = entries.select("id", "line_id", "amount_captured_paise", F.coalesce("merchant_text", F.lit("")).alias("m"), "txn_time", "ordinal").withWatermark("txn_time", "1 hour")
    a, b = (e.select(*(F.col(c).alias(f"{s}_{c}") for c in e.columns)) for s in "ab")
    near = f"b_txn_time between a_txn_time - interval {seconds} seconds and a_txn_time + interval {seconds} seconds"
    return a.join(b, F.expr(f"a_line_id = b_line_id and a_amount_captured_paise = b_amount_captured_paise and a_m = b_m and a_ordinal < b_ordinal and {near}")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def assemble(parts: DataFrame, late: str | None = None) -> DataFrame:
    """ref_id, complete, body as parts come in any order; update mode. The total is the least arrived ordinal's.

    late: how long after its first part a message may still be completed, by the parts' received_at; then it is
    forgotten and the state with it. Without it references are kept for ever.
    """
    keys = ["ref_id"]
    if late is not None:
        parts, keys = parts.withWatermark("received_at", late), ["ref_id", F.window("received_at", late)]
    state = parts.groupBy(*keys).agg(F.min_by("total_parts", "ordinal").alias("total"), F.array_sort(F.collect_list(F.struct("part_index", "ordinal", "text"))).alias("p"))
    last = F.transform(F.sequence(F.lit(1), F.greatest("total", F.lit(1))), lambda i: F.element_at(F.transform(F.filter("p", lambda x: x["part_index"] == i), lambda x: x["text"]), -1))
    with_parts = state.withColumn("t", F.when(F.size(F.array_distinct(F.transform(F.filter("p", lambda x: x["part_index"].between(1, F.col("total"))), lambda x: x["part_index"]))) >= F.col("total"), last))
    return with_parts.select("ref_id", F.col("t").isNotNull().alias("complete"), F.array_join("t", "").alias("body"))


def chain_gaps(entries: DataFrame) -> DataFrame:
    """line_id, entry_id, gap_paise as entries come in order; the last balance of each line is the state.

    entries: line_id string, id string, delta_paise bigint (signed), balance_after_paise bigint, is_hold boolean,
    ordinal bigint. Late rows are left to the batch operator.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("ordinal")
        anchored = state.exists
        # A hold does not move the balance, unless it is the anchor.
        keep = ~rows["is_hold"].astype(bool)
        if not anchored:
            keep.iloc[0] = True
        rows = rows[keep]
        if len(rows):
            before = rows["balance_after_paise"].shift(1, fill_value=state.get[0] if anchored else 0)
            gap = rows["balance_after_paise"] - before - rows["delta_paise"]
            if not anchored:
                gap.iloc[0] = 0
            state.update((int(rows["balance_after_paise"].iloc[-1]),))
            found = rows.assign(gap_paise=gap)[gap != 0]
            yield pd.DataFrame({"line_id": key[0], "entry_id": found["id"], "gap_paise": found["gap_paise"]})

    return entries.groupBy("line_id").applyInPandasWithState(step, "line_id string, entry_id string, gap_paise bigint", "previous bigint", "append", "NoTimeout")


def interest_verdicts(events: DataFrame) -> DataFrame:
    """line_id, id, verdict of unexplained credits as they come: ask until the user confirms one, which teaches the
    line's daily rate, its state; then absorb or flag by it.

    events: line_id string, id string, balance_before_paise bigint, credit_paise bigint, confirms boolean, ordinal bigint.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("ordinal")
        balance, credit = rows["balance_before_paise"].to_numpy(float), rows["credit_paise"].to_numpy(float)
        rate, known = (state.get[0], np.ones(len(rows), dtype=bool)) if state.exists else (None, np.zeros(len(rows), dtype=bool))
        if rate is None and rows["confirms"].any():
            at = int(rows["confirms"].to_numpy(bool).argmax())
            rate = credit[at] / balance[at] if balance[at] > 0 else 0.0
            known[at + 1 :] = True
            state.update((float(rate),))
        expected = np.floor(balance * (rate or 0.0) + 0.5)
        near = (expected > 0) & (np.abs(credit - expected) <= TOLERANCE * expected)
        yield pd.DataFrame({"line_id": key[0], "id": rows["id"], "verdict": np.where(~known, "ask", np.where(near, "absorb", "flag"))})

    return events.groupBy("line_id").applyInPandasWithState(step, "line_id string, id string, verdict string", "rate double", "append", "NoTimeout")


def match_refunds(credits: DataFrame, pending: DataFrame) -> DataFrame:
    """Streamed credits against the pending refunds: every pair that may match, once for refunds that share an id.

    Of the refunds of one id, user and amount the earliest lets in what any of them does; one of any time lets in all.
    """
    early = F.when(F.count("*") == F.count("expected_at"), F.min("expected_at")).alias("expected_at")
    p = pending.groupBy(F.col("id").alias("settlement_id"), F.col("user_id").alias("p_user"), "expected_amount_paise").agg(early)
    on = (F.col("user_id") == F.col("p_user")) & (F.col("amount_paise") == F.col("expected_amount_paise")) & (F.col("expected_at").isNull() | (F.col("txn_time") >= F.col("expected_at") - F.expr("INTERVAL 1 DAY")))
    return credits.join(p, on).select("settlement_id", F.col("id").alias("credit_id"))


def _ledger(spark: SparkSession, at: str, schema: StructType) -> KeyedTable:
    """The ledger's rows with the seq of the write that each one's values are from."""
    return KeyedTable(spark, at, "id", StructType([*schema.fields, StructField("last_seq", LongType())]))


def read_ledger(spark: SparkSession, ledger: str, schema: StructType) -> DataFrame:
    """The ledger as its last batch left it."""
    return _ledger(spark, ledger, schema).read().drop("last_seq")


def drain(outbox: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """All that waits in an outbox stream (id, seq, ...) into a ledger in Parquet; then stops. The write
    of an id with the highest seq wins, whichever batch brings it; the lowest seq is the entry's place.

    A batch rewrites the parts of the ledger that its ids fall in (see KeyedTable); a repeated batch writes the same
    again. Offline is simply no call.
    """
    schema = outbox.schema

    def merge(batch: DataFrame, number: int) -> None:
        table = _ledger(batch.sparkSession, ledger, schema)
        rows = written(batch.withColumn("last_seq", F.col("seq").cast("bigint")))
        values = [c for c in schema.names if c not in ("id", "seq")]
        both = table.lookup(rows, number).unionByName(rows)
        merged = both.groupBy("id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*values), "last_seq").alias("v"), F.max("last_seq").alias("last_seq"))
        table.put(written(merged.select(*(c if c in ("id", "seq") else F.col(f"v.{c}") for c in schema.names), "last_seq")), number)

    return outbox.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
