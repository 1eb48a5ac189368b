"""Ledger inputs derived from the driver's tables, in SQL that Spark and DuckDB read alike.

A message is built from one of SHAPES, whose facts (skeleton, gate, modality, amounts, ...) are stated beside its wording,
so that expected values follow from how a body was built and not from reading it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """body and skeleton: text with {slots}; paise: the parsed amount; amounts: all amounts, in order (SQL).

    reason: what the gate says; trusted: whether an induced template is. merchant and balance: what that reads (SQL).
    """

    body: str
    skeleton: str
    reason: str = "admit"
    modality: str = "actual"
    verb: str | None = None
    topup: bool = False
    reversal: bool = False
    paise: str = "paise"
    amounts: tuple[str, ...] = ("paise",)
    read: str = "paise"
    balance: str = "NULL"
    merchant: str = "NULL"
    trusted: str = "true"
    reference: bool = False
    tail: bool = False
    day: bool = False


_NOT_K = "x_form <> 3"

SHAPES = (
    Shape("{amt} paid at {merchant} using UPI from a/c XX{tail} dated {day}. Avl bal {bal}", "{amt}paid at §MERCHANT§ using upi from a/c §ACCT§ dated §DATE§. avl bal §AMT§", verb="out", amounts=("paise", "x_bal"), balance="x_bal", merchant="x_merchant", tail=True, day=True),
    Shape("NEFT of {amt} received in your account ending {tail} on {day} by payroll. Bal {bal}", "neft of {amt}received in your account §ACCT§ on §DATE§ by payroll. bal §AMT§", verb="in", amounts=("paise", "x_bal"), balance="x_bal", day=True),
    Shape("{amt} spent on Kotak Credit Card XX{tail} at {merchant} on {day}.", "{amt}spent on kotak credit §ACCT§ at §MERCHANT§ on §DATE§.", verb="out", merchant="x_merchant", tail=True, day=True),
    Shape("{otp} is the OTP for your login. Never share it.", "§NUM§ is the otp for §MERCHANT§. never share it.", reason="otp", paise="NULL", amounts=(), read="NULL", merchant="'your login'", trusted="false"),
    Shape("Code for paying {amt} at {merchant}: {otp}. Do not share.", "code for §MERCHANT§ {amt}at §MERCHANT§. do not share.", reason="otp", merchant="'paying'"),
    Shape("Weekend sale! Up to 40% off above {amt} this week only", "weekend sale! up to §MERCHANT§ {amt}this week only", reason="promo", merchant="'40% off above'"),
    Shape("Your a/c XX{tail} has {amt} as of {day}", "your a/c §ACCT§ has {amt}as of §DATE§", reason="balance_only", tail=True, day=True),
    Shape("{amt} will be debited on {day} towards your insurance premium by NACH", "{amt}will be debited on §DATE§ towards §MERCHANT§", modality="future", verb="out", merchant="'your insurance premium by NACH'", day=True),
    Shape("Payment of {amt} to {merchant} was declined by the bank", "payment of {amt}to §MERCHANT§", modality="failed", merchant="x_merchant || ' was declined by the bank'"),
    Shape("{amt} blocked on card XX{tail} for fuel pre-auth", "{amt}blocked on §ACCT§ for §MERCHANT§", modality="hold", verb="out", merchant="'fuel pre-auth'", tail=True),
    Shape("Priya sent you a collect request of {amt} on UPI", "priya sent you a collect request of {amt}on upi", modality="conditional", verb="out"),
    Shape("Refund of {amt} received from {merchant}. Ref no {ref}", "refund of {amt}received from {merchant}. ref no §NUM§", verb="in", reference=True),
    Shape("   ", "", reason="empty", paise="NULL", amounts=(), read="NULL", trusted="false"),
    Shape("{amt} added to your Mobikwik wallet balance from a/c XX{tail}", "{amt}added to §MERCHANT§ from a/c §ACCT§", verb="in", topup=True, merchant="'your Mobikwik wallet balance'", tail=True),
    Shape("Gift card worth {amt} purchase done at {merchant} on {day}", "gift card worth {amt}purchase done at §MERCHANT§ on §DATE§", topup=True, merchant="x_merchant", day=True),
    Shape("Txn {ref} of {amt} was reversed to a/c XX{tail} on {day}", "txn §NUM§ of {amt}was reversed to §MERCHANT§ §ACCT§ on §DATE§", modality="failed", verb="in", reversal=True, merchant="'a/c'", tail=True, day=True),
    # The amount after "for" is taken for a merchant's beginning: no template of this shape reads its messages.
    Shape("Autopay set up for {amt} every month by {merchant}", "autopay set up for §MERCHANT§§{gap}every month by {merchant}", modality="mandate", read="NULL", trusted="false"),
    # "credited" begins with a multiplier's letters: crores are read, but for an amount with a multiplier of its own.
    Shape("{amt} credited to your account", "§AMT§{credited} to §MERCHANT§", verb="in", paise=f"CASE WHEN {_NOT_K} THEN paise * 10000000 END", amounts=(f"CASE WHEN {_NOT_K} THEN paise * 10000000 ELSE paise END",), read=f"CASE WHEN {_NOT_K} THEN paise * 10000000 ELSE paise END", merchant="'your account'", trusted=_NOT_K),
    Shape("Loan of {lakhs}.5 lakh sanctioned, EMI due on {day}", "loan of §AMT§ sanctioned, emi due on §DATE§", reason="balance_only", modality="future", paise="x_lakhs * 10000000 + 5000000", amounts=(), read="x_lakhs * 10000000 + 5000000", day=True),
    # A letter O in the number: the parse refuses it, while the digits before it look like an amount.
    Shape("Rs 9,1O.00 paid to {merchant}", "§AMT§o.00 paid to §MERCHANT§", verb="out", paise="NULL", amounts=("9100",), read="9100", merchant="x_merchant", trusted="false"),
    Shape("{amt} sent by UPI, payee {vpa}, ref no {ref}", "{amt}sent by upi, payee §VPA§, ref no §NUM§", verb="out", reference=True),
    Shape("Enjoy cashback of {amt} on recharge", "enjoy cashback of {amt}on recharge", reason="promo"),
    Shape("Dear customer, {amt} withdrawn at ATM on {day}", "dear customer, {amt}withdrawn at §MERCHANT§ on §DATE§", verb="out", merchant="'ATM'", day=True),
    Shape("Rs {whole}/- deducted as annual fee", "§AMT§ deducted as annual fee", verb="out", paise="x_whole * 100", amounts=("x_whole * 100",), read="x_whole * 100"),
)
#: Merchants of the messages, with their category.
MERCHANTS = (("Nykaa", "Shopping"), ("Redbus", "Travel"), ("Corner Bakery", None), ("Upstox", "Investments"), ("Metro Tailors", None), ("Pharmeasy", "Healthcare"), ("Hotstar Annual", "Entertainment"), ("Zepto Cafe", "Food"))
SENDERS = ("VM-YESBNK", "JD-CANBNK-S", "BZ-IDFCFB-T", "+919812345670", "vm-paytm", "INDUSB", "QQ-KOTAKB-X", "VM-S", " IX-YESBNK ", "AD-FEDBNK-P")

_BODY = {"amt": "x_amt", "bal": "'Rs.' || CAST(x_bal // 100 AS STRING) || '.00'", "tail": "x_tail", "day": "x_day", "merchant": "x_merchant", "ref": "x_ref", "otp": "lpad(CAST(seq % 1000000 AS STRING), 6, '0')", "vpa": "x_vpa", "lakhs": "CAST(x_lakhs AS STRING)", "whole": "CAST(x_whole AS STRING)"}
# White space after an amount belongs to it, but where a multiplier ends it.
_MASK = {"amt": "CASE WHEN x_form = 3 THEN '§AMT§ ' ELSE '§AMT§' END", "gap": "CASE WHEN x_form = 3 THEN ' ' ELSE '' END", "credited": "CASE WHEN x_form = 3 THEN ' credited' ELSE 'edited' END", "merchant": "lower(x_merchant)"}


def _text(template: str, values: dict[str, str]) -> str:
    """SQL of a text with slots."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({values[p]})" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p or len(parts) == 1)


def by_shape(fact) -> str:
    """SQL: a CASE over the shapes; fact: Shape -> SQL."""
    return "CASE shape " + " ".join(f"WHEN {k} THEN {fact(s)}" for k, s in enumerate(SHAPES)) + " END"


def quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


#: SQL of a message's skeleton.
SKELETON = by_shape(lambda s: f"rtrim({_text(s.skeleton, _MASK)})")

def _pick(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


MESSAGES = f"""
SELECT *, {_pick(f"x_turn % {len(SENDERS)}", SENDERS)} AS sender, {by_shape(lambda s: _text(s.body, _BODY))} AS body FROM (
  SELECT *, CASE x_form WHEN 2 THEN x_whole * 100 WHEN 3 THEN x_whole * 100000 ELSE x_whole * 100 + seq % 100 END AS paise,
    CASE x_form WHEN 0 THEN 'Rs.' || CAST(x_whole AS STRING) || x_cents WHEN 1 THEN 'INR ' || CAST(x_whole AS STRING) || x_cents WHEN 2 THEN '₹' || CAST(x_whole AS STRING) WHEN 3 THEN 'Rs ' || CAST(x_whole AS STRING) || 'k'
      ELSE 'rs.' || CASE WHEN x_whole >= 1000 THEN CAST(x_whole // 1000 AS STRING) || ',' || lpad(CAST(x_whole % 1000 AS STRING), 3, '0') ELSE CAST(x_whole AS STRING) END || x_cents END AS x_amt FROM (
    SELECT event_id AS seq, user_id, event_id * 7 % 900000 AS t_sec, event_id % {len(SHAPES)} AS shape, event_id // {len(SHAPES)} AS x_turn, (event_id // {3 * len(SHAPES)} + event_id) % 5 AS x_form,
      CAST(floor(abs(value)) AS BIGINT) * (1 + event_id % 50) + event_id % 7 + 1 AS x_whole, '.' || lpad(CAST(event_id % 100 AS STRING), 2, '0') AS x_cents, (event_id % 9000 + 1000) * 100 AS x_bal, lpad(CAST(event_id % 10000 AS STRING), 4, '0') AS x_tail,
      lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0') || '-0' || CAST(event_id % 9 + 1 AS STRING) || '-25' AS x_day, {_pick(f"(event_id // {len(SHAPES)} + event_id) % {len(MERCHANTS)}", [m for m, _ in MERCHANTS])} AS x_merchant,
      '55' || lpad(CAST(event_id AS STRING), 10, '0') AS x_ref, '98765' || lpad(CAST(user_id % 100000 AS STRING), 5, '0') || '@okaxis' AS x_vpa, event_id % 9 + 1 AS x_lakhs
    FROM events))"""

ENTRIES = """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 100 AS STRING) AS user_id, CAST(o_custkey % 100 AS STRING) || '-' || CAST(o_orderkey % 3 AS STRING) AS line_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'INCOME' WHEN 1 THEN 'TRANSFER' WHEN 2 THEN 'TOPUP' ELSE 'EXPENSE' END AS direction,
  CASE o_orderkey % 11 WHEN 0 THEN 'future' WHEN 1 THEN 'failed' ELSE 'actual' END AS modality,
  CASE o_orderkey % 17 WHEN 0 THEN 'is_reversal' WHEN 1 THEN 'reversed' WHEN 2 THEN NULL ELSE 'active' END AS net_status,
  CAST(floor(o_totalprice) AS BIGINT) % 500 AS amount_captured_paise,
  CAST(floor(o_totalprice) AS BIGINT) % 500 - CASE WHEN o_orderkey % 13 = 0 THEN 100 ELSE 0 END AS amount_effective_paise,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 2) AS BIGINT) END AS balance_after_paise,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 12 + 1 END AS INT) AS category_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 't' || CAST(o_custkey % 4 AS STRING) END AS tag_id,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'm' || CAST(o_custkey % 3 AS STRING) END AS merchant_text,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'p' || CAST(o_custkey % 50 AS STRING) END AS payee_id,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_orderkey - 1 AS STRING) ELSE NULL END AS reverses_entry_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'HDFCBK' WHEN 1 THEN 'Paytm' ELSE 'bank' || CAST(o_orderkey % 5 AS STRING) END AS issuer,
  o_orderkey * 37 % 90000 AS t_sec, o_orderkey AS ordinal,
  o_orderkey % 7 NOT IN (1, 2) AND o_orderkey % 11 > 1 AND o_orderkey % 17 <> 0 AS is_counted
FROM orders"""

SETTLEMENTS = """
SELECT 's' || CAST(l_orderkey AS STRING) AS id, CAST(l_orderkey AS STRING) AS base_entry_id,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey + 7 AS STRING) ELSE NULL END AS settle_entry_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'settled' WHEN 1 THEN 'partial' WHEN 2 THEN 'written_off' ELSE 'pending' END AS status,
  CASE WHEN l_orderkey % 6 = 0 THEN 'self_transfer' ELSE 'refund' END AS kind,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) % 300 END AS settled_amount_paise,
  CAST(floor(l_extendedprice) AS BIGINT) % 500 AS expected_amount_paise,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_orderkey * 31 % 90000 END AS expected_sec,
  CASE WHEN l_orderkey % 3 = 0 THEN 'd' || CAST(l_orderkey % 40 AS STRING) ELSE NULL END AS personal_debt_id,
  CAST(l_suppkey % 100 AS STRING) AS user_id
FROM lineitem WHERE l_linenumber = 1"""

_MOVE = "CASE l_returnflag WHEN 'R' THEN -CAST(floor(l_extendedprice) AS BIGINT) WHEN 'A' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END"

CHAIN = f"""
SELECT CAST(l_suppkey AS STRING) AS line_id, CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) AS id,
  CAST(floor(l_extendedprice) AS BIGINT) AS amount_paise, CASE l_returnflag WHEN 'R' THEN 'debit' WHEN 'A' THEN 'credit' ELSE 'none' END AS direction,
  l_orderkey % 23 = 0 AS is_hold, CASE WHEN l_orderkey % 19 = 0 THEN 'statement' WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'sms' END AS source,
  l_orderkey // 10 AS t_sec, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey AS ordinal,
  CAST(sum({_MOVE}) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey // 10, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) + CASE WHEN l_orderkey % 10 = 0 THEN 5 ELSE 0 END AS balance_after_paise
FROM lineitem"""

TABLES = {"messages": (MESSAGES, "events"), "entries": (ENTRIES, "orders"), "settlements": (SETTLEMENTS, "lineitem"), "chain": (CHAIN, "lineitem")}


#: Messages that one task reads, about.
MESSAGES_A_TASK = 100_000


def load(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    """A derived input over its whole table. Times, seconds in both engines, are timestamps besides.

    deal: False for a query that does not read messages' bodies.
    """
    sql, base = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if name == "messages" and deal:
        # Reading messages is costlier than moving them: they are dealt to all cores, and to more tasks as they grow.
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // MESSAGES_A_TASK))
        rows = rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
    df = spark.sql(sql.replace(f"FROM {base}", "FROM {base}").replace("//", " DIV "), base=rows)
    for seconds, time in (("t_sec", "txn_time"), ("expected_sec", "expected_at")):
        if seconds in df.columns:
            df = df.withColumn(time, F.timestamp_seconds(seconds))
    return df


def with_inputs(sql: str, *names: str) -> str:
    """DuckDB SQL with the named inputs before it; "RECURSIVE" among them lets what follows refer to itself."""
    ctes = ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names if n in TABLES)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in names else ''}{ctes} {sql}"
