"""What a message says happened: modality, direction, money type; and whether an entry counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.rules import Rules, load_rules
from khata.functions.text import AFTER, ANY, BEFORE, has_text


def modality(body: Column, rules: Rules | None = None) -> Column:
    """By phrases anywhere in the text, in this order: mandate, future, conditional, failed, hold, else actual."""
    r = rules or load_rules()
    return F.when(has_text(body, r.mandate), "mandate").when(has_text(body, r.future), "future").when(has_text(body, r.conditional), "conditional").when(has_text(body, (*r.failed, "failed")), "failed").when(has_text(body, r.hold), "hold").otherwise("actual")


def verb_direction(body: Column) -> Column:
    """out, in or null, by the verbs; money added to a wallet comes in."""
    low = F.lower(body)
    out = low.rlike(f"{BEFORE}(?:debited|spent|withdrawn|paid|deducted|debit|sent|blocked|added){AFTER}")
    into = low.rlike(f"{BEFORE}(?:credited|received|refund|reversed|returned|load|loaded){AFTER}")
    return F.when(out, F.when(low.rlike(f"added to {ANY}*wallet"), "in").otherwise("out")).when(into, "in")


def money_type(direction: Column, own_node: Column, topup: Column) -> Column:
    return F.when(F.coalesce(topup, F.lit(False)), "TOPUP").when(F.coalesce(own_node, F.lit(False)), "TRANSFER").when(direction == "out", "EXPENSE").otherwise("INCOME")


def is_own_node(issuer: Column, rules: Rules | None = None) -> Column:
    """A seeded wallet, without case; learned ones are joined (see operators.settlement.own_nodes)."""
    return F.coalesce(F.upper(issuer).isin(*(rules or load_rules()).own_nodes), F.lit(False))


def is_topup(body: Column) -> Column:
    return body.rlike(f"(?i)gift card|gift voucher|voucher|added to {ANY}*(?:amazon pay|wallet) balance")


def is_reversal_notice(body: Column) -> Column:
    return body.rlike(f"(?i){BEFORE}reversed{AFTER}|reversal of|credited back")


def is_counted(direction: Column, modality_: Column, net_status: Column) -> Column:
    """Income or expense that really happened and is no reversal."""
    return F.coalesce(direction.isin("EXPENSE", "INCOME") & (modality_ == "actual") & (F.coalesce(net_status, F.lit("active")) != "is_reversal"), F.lit(False))


def signed_delta(direction: Column, amount: Column) -> Column:
    return F.when(direction == "credit", amount).when(direction == "debit", -amount).otherwise(F.lit(0)).cast("bigint")


def period_label(installed: Column, now: Column) -> Column:
    """struct(label, is_thin, days): under 28 days a period is thin."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(installed)) / F.lit(86_400_000_000)))
    return F.struct(F.when(days < 28, "since you installed").otherwise("this month").alias("label"), (days < 28).alias("is_thin"), days.cast("bigint").alias("days"))
