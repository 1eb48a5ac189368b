"""Balance chains: what the balances of a line imply against what its entries say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.classify import signed_delta


def _chain(entries: DataFrame, implied_order: bool):
    order = [F.col("balance_after_paise").desc()] if implied_order else []
    by_line = Window.partitionBy("line_id").orderBy(*order, "txn_time", "ordinal")
    sms = entries.where("coalesce(source, 'sms') = 'sms'")
    ranked = sms.withColumns({"rn": F.row_number().over(by_line), "chain_length": F.count("*").over(Window.partitionBy("line_id"))})
    # A hold does not move the balance, unless it is the anchor.
    kept = ranked.where("rn = 1 or not coalesce(is_hold, false)")
    return kept.withColumn("previous_paise", F.lag("balance_after_paise").over(Window.partitionBy("line_id").orderBy("rn")))


def discrepancies(entries: DataFrame, implied_order: bool = False) -> DataFrame:
    """line_id, entry_id, type, gap_paise: where the balance moved by more or less than the entry's amount.

    entries: line_id, id, amount_paise, balance_after_paise, direction (debit, credit, none), txn_time, is_hold,
    source, ordinal. implied_order: balances, highest first, order the chain before times do.
    """
    gap = F.col("balance_after_paise") - F.col("previous_paise") - signed_delta(F.col("direction"), F.col("amount_paise"))
    out = _chain(entries, implied_order).where("rn > 1").withColumn("gap", gap).where("gap <> 0")
    kind = F.when(F.col("gap") < 0, "missing_outflow").otherwise("missing_inflow")
    return out.select("line_id", F.col("id").alias("entry_id"), kind.alias("type"), F.abs("gap").alias("gap_paise"))


def chain_confidence(entries: DataFrame, implied_order: bool = False) -> DataFrame:
    """line_id, anchor_id, breaks, confidence: 1 less the share of breaks among the chain's steps, holds included."""
    gap = F.col("balance_after_paise") - F.col("previous_paise") - signed_delta(F.col("direction"), F.col("amount_paise"))
    chain = _chain(entries, implied_order).withColumn("broken", (F.col("rn") > 1) & (gap != 0))
    out = chain.groupBy("line_id").agg(F.min_by("id", "rn").alias("anchor_id"), F.count_if("broken").alias("breaks"), F.max("chain_length").alias("n"))
    confidence = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("breaks") / F.greatest(F.lit(1), F.col("n") - 1))
    return out.select("line_id", "anchor_id", "breaks", confidence.alias("confidence"))


def latest_balances(entries: DataFrame) -> DataFrame:
    """line_id, balance_paise: the last known balance of each line."""
    known = entries.where("balance_after_paise is not null")
    return known.groupBy("line_id").agg(F.max_by("balance_after_paise", F.struct("txn_time", "ordinal")).alias("balance_paise"))


def anchor_balances(entries: DataFrame) -> DataFrame:
    known = entries.where("balance_after_paise is not null")
    return known.groupBy("line_id").agg(F.min_by("balance_after_paise", F.struct("txn_time", "ordinal")).alias("anchor_balance_paise"))


def accrued(entries: DataFrame, amount: str = "interest_paise") -> DataFrame:
    """Running sum of a line's expected interest."""
    window = Window.partitionBy("line_id").orderBy("txn_time", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("accrued_paise", F.sum(amount).over(window))
