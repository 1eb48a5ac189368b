"""Settlements: refunds to their purchases, own nodes, debts and liabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.amounts import sum_paise
from khata.functions.interest import verdict
from khata.functions.rules import load_rules

#: A refund may come this much before it is expected.
EARLY = "INTERVAL 1 DAY"


def match_refunds(credits: DataFrame, pending: DataFrame) -> DataFrame:
    """settlement_id, credit_id: each pending refund with the first credit of its amount that is not too early.

    credits: id, user_id, amount_paise, txn_time, ordinal; pending: id, user_id, expected_amount_paise, expected_at
    (null: any time). A credit of another line may match. Of several credits the earliest is taken; an id that several
    pending refunds share has one row, with the earliest credit of them all.
    """
    asked = pending.select("user_id", F.col("expected_amount_paise").alias("amount"), (F.col("expected_at") - F.expr(EARLY)).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("o"), F.col("id").alias("settlement_id"), F.lit(None).cast("struct<id: string, t: timestamp, o: long>").alias("credit"))
    came = credits.select("user_id", F.col("amount_paise").alias("amount"), F.col("txn_time").alias("t"), F.lit(1).alias("kind"), F.col("ordinal").cast("long").alias("o"), F.lit(None).cast("string").alias("settlement_id"), F.struct(F.col("id").cast("string").alias("id"), F.col("txn_time").cast("timestamp").alias("t"), F.col("ordinal").cast("long").alias("o")).alias("credit"))
    # In the order of times, a refund of any time first, the credit that follows a refund next is its own. The order is
    # gone through from its end, as a frame of the following rows is read anew for each row.
    behind = Window.partitionBy("user_id", "amount").orderBy(F.desc_nulls_last("t"), F.desc("kind"), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    out = asked.unionByName(came).withColumn("credit", F.last("credit", ignorenulls=True).over(behind)).where("settlement_id is not null and credit is not null")
    return out.groupBy("settlement_id").agg(F.min_by("credit.id", F.struct("credit.t", "credit.o", "credit.id")).alias("credit_id"))


def settle_refunds(credits: DataFrame, pending: DataFrame) -> DataFrame:
    """settlement_id, credit_id: refunds and credits one to one. Each credit, in the order of times, settles the refund
    of its user and amount that has waited longest; so the most refunds are settled, and no credit twice.

    credits: id, user_id, amount_paise, txn_time, ordinal; pending: id, user_id, expected_amount_paise, expected_at (null:
    any time; those come first). Whether a credit finds a refund waiting follows from counts alone: refunds less credits
    so far; each time they fall to a new low, a credit goes unused. One sorted pass a user and amount, no pairs.
    """
    asked = pending.select("user_id", F.col("expected_amount_paise").alias("amount"), (F.col("expected_at") - F.expr(EARLY)).cast("timestamp").alias("t"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("o"), F.col("id").cast("string").alias("id"))
    came = credits.select("user_id", F.col("amount_paise").alias("amount"), F.col("txn_time").cast("timestamp").alias("t"), F.lit(-1).alias("step"), F.col("ordinal").cast("long").alias("o"), F.col("id").cast("string").alias("id"))
    order = Window.partitionBy("user_id", "amount").orderBy(F.asc_nulls_first("t"), F.desc("step"), "o", "id")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    walk = asked.unionByName(came).where("amount is not null and (step = 1 or t is not null)").withColumn("level", F.sum("step").over(so_far))
    # least() and min() pass over null: before the first event the low is 0.
    walk = walk.withColumns({"low": F.least(F.lit(0), F.min("level").over(before)), "refunds": F.count_if(F.col("step") == 1).over(so_far), "credits": F.count_if(F.col("step") == -1).over(so_far)})
    served = walk.where("step = 1 or level >= low").withColumn("number", F.when(F.col("step") == 1, F.col("refunds")).otherwise(F.col("credits") + F.col("low")))
    pairs = served.groupBy("user_id", "amount", "number").agg(F.max(F.when(F.col("step") == 1, F.col("id"))).alias("settlement_id"), F.max(F.when(F.col("step") == -1, F.col("id"))).alias("credit_id"))
    return pairs.where("settlement_id is not null and credit_id is not null").select("settlement_id", "credit_id")


def write_off(settlements: DataFrame, ids: DataFrame) -> DataFrame:
    """Settlements with the listed ones (id) written off: they no longer reduce anything."""
    gone = ids.select("id", F.lit(True).alias("_off")).distinct()
    return settlements.join(gone, "id", "left").withColumn("status", F.when(F.col("_off"), "written_off").otherwise(F.col("status"))).drop("_off")


def refund_aging(pending: DataFrame, now) -> DataFrame:
    """bucket, n, expected_paise of open refunds by days since they were expected."""
    days = F.datediff(now, F.col("expected_at"))
    bucket = F.when(days < 5, "fresh").when(days <= 30, "aging").otherwise("overdue")
    return pending.where("status = 'pending'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), sum_paise(F.col("expected_amount_paise")).alias("expected_paise"))


def own_nodes(settlements: DataFrame, entries: DataFrame, rules=None) -> DataFrame:
    """node: seeded wallets and the issuers of confirmed self transfers' second legs, in upper case."""
    spark = entries.sparkSession
    seeded = spark.createDataFrame([(n.upper(),) for n in (rules or load_rules()).own_nodes], "node string")
    legs = settlements.where("kind = 'self_transfer'").select(F.col("settle_entry_id").alias("id"))
    learned = entries.join(legs, "id", "left_semi").where("issuer is not null").select(F.upper("issuer").alias("node"))
    return seeded.unionByName(learned).distinct()


def debts(personal_debt: DataFrame, settlements: DataFrame) -> DataFrame:
    """id, principal_paise, paid_paise, remaining_paise, status of every debt; a forgiven one stays so."""
    paid = settlements.where("status in ('settled', 'partial') and personal_debt_id is not null").groupBy(F.col("personal_debt_id").alias("id")).agg(sum_paise(F.coalesce("settled_amount_paise", F.lit(0))).alias("paid_paise"))
    out = personal_debt.join(paid, "id", "left").withColumn("paid_paise", F.coalesce("paid_paise", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("principal_paise") - F.col("paid_paise"))
    status = F.when(F.col("status") == "forgiven", "forgiven").when(left == 0, "closed").when(F.col("paid_paise") > 0, "partial").otherwise("open")
    return out.select("id", "principal_paise", "paid_paise", left.alias("remaining_paise"), status.alias("status"))


def liability_payments(liabilities: DataFrame, entries: DataFrame) -> DataFrame:
    """id, paid_installments, remaining_installments: counted expenses of a liability's line and installment."""
    paid = entries.where("is_counted and direction = 'EXPENSE'").groupBy("line_id", F.col("amount_effective_paise").alias("installment_paise")).agg(F.count("*").alias("n"))
    out = liabilities.join(paid, ["line_id", "installment_paise"], "left")
    n = F.least(F.coalesce("n", F.lit(0)), F.col("tenure_months"))
    return out.select("id", n.alias("paid_installments"), (F.col("tenure_months") - n).alias("remaining_installments"))


def suspected_refunds(entries: DataFrame, days: int = 30) -> DataFrame:
    """credit_id, debit_id: a credit of a merchant and amount that follows a debit within `days`; the nearest debit."""
    e = entries.where("direction in ('EXPENSE', 'INCOME') and merchant_text is not null").withColumn("debit", (F.col("direction") == "EXPENSE").cast("int"))
    # A debit of the credit's own moment does not come before it.
    before = Window.partitionBy("user_id", "merchant_text", "amount_captured_paise").orderBy("txn_time", "debit", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("debit") == 1, F.struct("id", "txn_time")), ignorenulls=True).over(before)
    out = e.withColumn("d", last).where((F.col("debit") == 0) & (F.col("txn_time") <= F.col("d.txn_time") + F.expr(f"INTERVAL {days} DAYS")))
    return out.select(F.col("id").alias("credit_id"), F.col("d.id").alias("debit_id"))


def recurring(entries: DataFrame, least: int = 3) -> DataFrame:
    """user_id, merchant_text, amount_paise, n, gap_days: expenses that come back about monthly."""
    by = Window.partitionBy("user_id", "merchant_text", "amount_captured_paise").orderBy("txn_time", "ordinal")
    gaps = entries.where("direction = 'EXPENSE' and merchant_text is not null").withColumn("gap", F.datediff("txn_time", F.lag("txn_time").over(by)))
    out = gaps.groupBy("user_id", "merchant_text", F.col("amount_captured_paise").alias("amount_paise")).agg(F.count("*").alias("n"), F.avg("gap").alias("gap_days"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    return out.where((F.col("n") >= least) & (F.col("low") >= 25) & (F.col("high") <= 35)).drop("low", "high")


def suspected_emi(chain: DataFrame, months: int = 1) -> DataFrame:
    """line_id, entry_id, drop_paise: available credit that falls and is restored by the same amount about a month
    later. A heuristic."""
    by = Window.partitionBy("line_id").orderBy("txn_time", "ordinal")
    moves = chain.withColumn("move", F.col("balance_after_paise") - F.lag("balance_after_paise").over(by)).select("line_id", "id", "txn_time", "move")
    # A fall looks for the first rise of its size from its own earliest day of restoring on.
    low, high = 30 * months - 5, 30 * months + 5
    day, down = F.to_date("txn_time"), F.col("move") < 0
    keyed = moves.where("move <> 0").select("line_id", "id", F.abs("move").alias("drop_paise"), down.alias("down"), F.when(down, F.date_add(day, low)).otherwise(day).alias("day"))
    # From the last day backwards, so that a fall comes after the rises of its day and each row is read once.
    behind = Window.partitionBy("line_id", "drop_paise").orderBy(F.desc("day"), "down").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("restored", F.last(F.when(~F.col("down"), F.col("day")), ignorenulls=True).over(behind))
    return out.where(F.col("down") & (F.datediff("restored", "day") <= high - low)).select("line_id", F.col("id").alias("entry_id"), "drop_paise").distinct()


def code_links(codes: DataFrame, entries: DataFrame, seconds: int = 600) -> DataFrame:
    """code_id, entry_id: each one-time code that names an amount, with the user's next expense of that amount within
    `seconds`. codes: id, user_id, amount_paise, received_at; the code itself never counts."""
    asked = codes.where("amount_paise is not null").select("user_id", "amount_paise", F.col("received_at").alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("o"), F.col("id").alias("code_id"), F.lit(None).cast("struct<id: string, t: timestamp>").alias("spent"))
    came = entries.where("direction = 'EXPENSE'").select("user_id", "amount_paise", F.col("received_at").alias("t"), F.lit(1).alias("kind"), F.col("seq").alias("o"), F.lit(None).alias("code_id"), F.struct(F.col("id"), F.col("received_at").alias("t")).alias("spent"))
    # From the end backwards, so that each row is read once.
    behind = Window.partitionBy("user_id", "amount_paise").orderBy(F.desc("t"), F.desc("kind"), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    out = asked.unionByName(came).withColumn("next", F.last("spent", ignorenulls=True).over(behind)).where("code_id is not null")
    return out.where(F.unix_seconds("next.t") - F.unix_seconds("t") <= seconds).select("code_id", F.col("next.id").alias("entry_id"))


def interest_income(events: DataFrame) -> DataFrame:
    """line_id, credits, income_paise: what absorbed drips add up to. events: line_id, balance_before_paise,
    credit_paise, confirmed, rate_daily."""
    seen = events.withColumn("verdict", verdict(F.col("balance_before_paise"), F.col("credit_paise"), F.col("confirmed"), F.col("rate_daily")))
    return seen.where("verdict = 'absorb'").groupBy("line_id").agg(F.count("*").alias("credits"), sum_paise(F.col("credit_paise")).alias("income_paise"))


def resolve_discrepancies(found: DataFrame, resolutions: DataFrame) -> DataFrame:
    """found (line_id, entry_id, ...) with status and resolution; resolutions: line_id, entry_id, resolution, one each.
    "ignored" ignores, any other resolves; without one a discrepancy is open."""
    out = found.join(resolutions.select("line_id", "entry_id", "resolution"), ["line_id", "entry_id"], "left")
    return out.withColumn("status", F.when(F.col("resolution").isNull(), "open").when(F.col("resolution") == "ignored", "ignored").otherwise("resolved"))
