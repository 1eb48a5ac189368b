"""The gate: which messages are about money, by ordered cheap rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.amounts import has_amount
from khata.functions.rules import Rules, load_rules
from khata.functions.senders import is_personal, normalise_sender
from khata.functions.text import AFTER, BEFORE, W, has_word, trimmed


def is_otp(body: Column) -> Column:
    return body.rlike(f"(?i){BEFORE}otp{AFTER}|one time password|do not share|code is")


def is_promo(body: Column) -> Column:
    return body.rlike(f"(?i){BEFORE}(?:(?:offer|sale|win|won|discount|expires|cl(?:ick|aim)|shop now|[0-9]+% off|cashback){AFTER}|flat [0-9]+%(?={W}))")


def _reason(sender: Column, body: Column, denied: Column | None, rules: Rules) -> Column:
    words = rules.transaction_verbs + rules.future + rules.conditional + rules.hold + rules.mandate + rules.refund + rules.failed
    return (
        F.when(body.isNull() | (trimmed(body) == ""), "empty")
        .when(is_personal(trimmed(F.coalesce(sender, F.lit("")))), "personal")
        .when(F.coalesce(denied, F.lit(False)) if denied is not None else F.lit(False), "denylist")
        .when(is_otp(body), "otp")
        .when(is_promo(body), "promo")
        .when(has_amount(body) & has_word(body, words), "admit")
        .otherwise("balance_only")
    )


def _verdict(reason: Column, entity: Column) -> Column:
    return F.struct((reason == "admit").alias("admit"), reason.alias("reason"), entity.alias("entity"), (reason == "otp").alias("buffered"))


def gate_reason(sender: Column, body: Column, denied: Column | None = None, rules: Rules | None = None) -> Column:
    """struct(admit, reason, entity, buffered). denied: whether the sender's entity is on the user's denylist."""
    rules = rules or load_rules()
    return _verdict(_reason(sender, body, denied, rules), normalise_sender(sender, rules)["entity"])


def gate(messages: DataFrame, denylist: DataFrame | None = None, rules: Rules | None = None) -> DataFrame:
    """messages (user_id, sender, body, ...) with a column gate. denylist: user_id, entity; joined on both.

    In steps, so that the reason is found once for all that the gate says."""
    rules = rules or load_rules()
    sender, body = F.col("sender"), F.col("body")
    if denylist is None:
        return messages.withColumn("_reason", _reason(sender, body, None, rules)).withColumn("gate", _verdict(F.col("_reason"), normalise_sender(sender, rules)["entity"])).drop("_reason")
    known = denylist.select(F.col("user_id"), F.col("entity").alias("_entity"), F.lit(True).alias("_denied")).distinct()
    named = messages.withColumn("_entity", normalise_sender(sender, rules)["entity"])
    judged = named.join(known, ["user_id", "_entity"], "left").withColumn("_reason", _reason(sender, body, F.col("_denied"), rules))
    return judged.withColumn("gate", _verdict(F.col("_reason"), F.col("_entity"))).drop("_entity", "_denied", "_reason")
