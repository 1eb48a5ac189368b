"""From messages to ledger entries, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.amounts import extract_amounts
from khata.functions.classify import is_counted, is_own_node, is_topup, modality, money_type, verb_direction
from khata.functions.dates import parse_sms_date
from khata.functions.gating import gate
from khata.functions.ids import entry_id, extract_reference
from khata.functions.payees import category_hint, vpa_key
from khata.functions.text import AFTER, BEFORE, found
from khata.operators.ledger import line_key, upsert
from khata.operators.templates import apply_templates


def build_entries(messages: DataFrame, templates: DataFrame | None = None, denylist: DataFrame | None = None) -> DataFrame:
    """Ledger entries of messages (user_id, sender, body, received_at, seq, maybe gate), the last write of each id.

    Amount and balance come from a trusted template where one fits, else from the first amount and from one after
    "bal". Narrow but for the joins with templates and denylist and the final grouping by id.
    """
    kept = messages if "gate" in messages.columns else gate(messages, denylist)
    kept = kept.where("gate.admit").withColumn("issuer", F.col("gate.entity")).drop("gate")
    if templates is not None:
        kept = apply_templates(kept, templates, trusted_only=True).withColumnRenamed("amount_paise", "t_amount").withColumnRenamed("balance_paise", "t_balance").withColumnRenamed("merchant", "t_merchant").drop("template_found", "fingerprint", "skeleton")
    else:
        kept = kept.withColumns({"t_amount": F.lit(None).cast("bigint"), "t_balance": F.lit(None).cast("bigint"), "t_merchant": F.lit(None).cast("string")})
    body, date = F.col("body"), rf"(?i){BEFORE}([0-9]{{1,2}}[-/][0-9]{{1,2}}(?:[-/][0-9]{{2,4}})?){AFTER}"
    amount = F.coalesce("t_amount", F.try_element_at(extract_amounts(body), F.lit(1)))
    balance = F.coalesce("t_balance", F.try_element_at(extract_amounts(found(body, r"(?i)bal.*")), F.lit(1)))
    merchant = F.coalesce("t_merchant", found(body, rf"(?i){BEFORE}at ([A-Za-z][A-Za-z ]*?)(?= via| on|[.,]|\z)", 1))
    tail = found(body, r"(?i)(?:xx|\*\*)([0-9]{4})", 1)
    vpa = found(body, r"[A-Za-z0-9_.-]+@[A-Za-z]+")
    verb = verb_direction(body)
    out = kept.withColumns({"amount_paise": amount, "balance_after_paise": balance, "merchant_text": merchant, "tail": tail, "verb": verb, "modality": modality(body), "reference": extract_reference(body)})
    wallet = is_own_node(F.col("issuer"))
    own = is_own_node(F.upper(F.regexp_replace(F.coalesce("merchant_text", F.lit("")), " ", "")))
    kind = F.when(wallet, "wallet").when(F.col("tail").isNotNull(), "bank").otherwise("unattributed")
    stated = parse_sms_date(found(body, date, 1), F.col("received_at"))["date"].cast("timestamp")
    out = out.withColumns({"line_key": line_key(kind, F.col("issuer"), F.col("tail")), "direction": money_type(F.coalesce("verb", F.lit("out")), own | (wallet & (F.col("verb") == "in")), is_topup(body)), "txn_time": F.coalesce(stated, F.col("received_at"))})
    out = out.withColumns({"id": entry_id(F.col("user_id").cast("string"), F.col("line_key"), F.col("direction"), F.col("amount_paise"), F.unix_seconds("received_at"), F.col("reference")), "category": category_hint(F.col("merchant_text")), "payee_key": F.coalesce(vpa_key(vpa), F.lower("merchant_text")), "is_counted": is_counted(F.col("direction"), F.col("modality"), F.lit("active"))})
    return upsert(out.select("id", "seq", "user_id", "issuer", "line_key", "direction", "modality", "amount_paise", "balance_after_paise", "merchant_text", "category", "payee_key", "reference", "txn_time", "is_counted"))
