"""Composite reports over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.amounts import sum_paise
from khata.operators.aggregation import contributions, headline
from khata.operators.reconciliation import latest_balances


def dashboard(entries: DataFrame, settlements: DataFrame) -> DataFrame:
    """user_id, income_paise, expense_paise, savings_paise, top_category_id, top_payee_id, net_position_paise.

    The top category and payee are those of the highest expense, the smaller key of equals; the net position is the
    sum of the user's lines' last balances.
    """
    spent = contributions(entries, settlements).where("direction = 'EXPENSE'")

    def top(key: str, name: str) -> DataFrame:
        sums = spent.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(sum_paise(F.col("contribution_paise")).alias("s"))
        return sums.groupBy("user_id").agg(F.min_by(key, F.struct(-F.col("s"), F.col(key))).alias(name))

    owner = entries.groupBy("line_id").agg(F.min("user_id").alias("user_id"))
    net = latest_balances(entries).join(owner, "line_id").groupBy("user_id").agg(sum_paise(F.col("balance_paise")).alias("net_position_paise"))
    out = headline(entries, settlements, by=("user_id",))
    return out.join(top("category_id", "top_category_id"), "user_id", "left").join(top("payee_id", "top_payee_id"), "user_id", "left").join(net, "user_id", "left")


def open_discrepancies(discrepancies: DataFrame) -> DataFrame:
    """type, n, gap_paise of unresolved discrepancies."""
    return discrepancies.where("coalesce(status, 'open') = 'open'").groupBy("type").agg(F.count("*").alias("n"), sum_paise(F.col("gap_paise")).alias("gap_paise"))


def backfill(messages: DataFrame, now, days: int = 14, before_last: int | None = None) -> DataFrame:
    """The messages of the last `days`; if `before_last` is given, also those of that many days before the last message."""
    since = now - F.make_interval(days=F.lit(days))
    if before_last is not None:
        last = messages.agg(F.max("received_at")).scalar()
        since = F.least(since, last - F.make_interval(days=F.lit(before_last)))
    return messages.where(F.col("received_at") >= since)
