"""Vectors of our own for the message functions, read and written as vector files, and the traps of their semantics."""

import datetime as dt
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from khata.functions import amounts, classify, gating, ids, interest, masking, payees, senders
from khata.functions.dates import parse_sms_date
from khata.functions.rules import load_rules
from khata.operators import aggregation, ledger, multipart, reconciliation, templates
from khata.sources.vectors import read_vectors, write_vectors

AT = Path(__file__).parent / "vectors"


def test_amount_vectors(spark):
    v = read_vectors(spark, str(AT / "amounts.json"), "input: string, paise: bigint, confidence: string")
    wrong = v.withColumn("got", amounts.parse_amount(F.col("input"))).where(~F.col("got.paise").eqNullSafe(F.col("paise")) | (F.col("got.confidence") != F.col("confidence")))
    assert v.count() == 25 and wrong.collect() == []
    staged = amounts.with_paise(v, read=F.col("input")).where(~F.col("read").eqNullSafe(F.col("paise")))
    assert staged.collect() == [] and staged.columns == [*v.columns, "read"]


def test_skeleton_vectors(spark, tmp_path):
    v = read_vectors(spark, str(AT / "skeletons.json"), "input: string, skeleton: string")
    got = v.select("input", masking.mask(F.col("input")).alias("skeleton"))
    assert got.exceptAll(v).collect() == [] and v.where(masking.leak(F.col("skeleton")).isNotNull()).count() == 0
    shaped = templates.shape(v.select(F.col("input").alias("body"))).collect()
    assert all(r["fingerprint"] == hashlib.sha256(r["skeleton"].encode()).hexdigest() for r in shaped)
    write_vectors(got, str(tmp_path / "again"))
    assert read_vectors(spark, str(tmp_path / "again"), "input: string, skeleton: string").exceptAll(v).count() == 0


def test_gate_vectors(spark):
    v = read_vectors(spark, str(AT / "gate.json"), "sender: string, body: string, admit: boolean, reason: string")
    got = gating.gate(v).select("sender", "body", "gate.admit", "gate.reason")
    assert got.exceptAll(v).collect() == []


def values(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(*columns).collect()]


def test_strict_boundary_and_extraction(spark):
    rows = [("Rs 72,000 credited",), ("Rs 5 and INR 6.50, then ₹1,000 k",)]
    strict = amounts.parse_amount(F.col("b"), strict_boundary=True)["paise"]
    assert values(spark, "b string", rows, strict)[0] == (7_200_000,)
    assert values(spark, "b string", rows, amounts.extract_amounts(F.col("b")))[1] == ([500, 650, 100_000_000],)


def test_redaction_fails_on_a_leak(spark):
    df = spark.createDataFrame([("x",)], "b string")
    assert df.select(masking.redact(F.col("b"))).count() == 1
    assert values(spark, "s string", [("rs 5",), ("abc123",), ("§AMT§ 12",)], masking.leak(F.col("s"))) == [("rs 5",), ("123",), (None,)]


def test_senders_and_rules(spark, tmp_path):
    rows = [("VM-S",), ("ZZ-ACME",), ("VM",), ("VM-ACME-G",), ("9123456789",), ("+91 98123-45670",), (None,), ("",)]
    assert values(spark, "s string", rows, senders.normalise_sender(F.col("s"))["entity"]) == [("S",), ("ACME",), ("VM",), ("ACME",), ("9123456789",), (None,), (None,), (None,)]
    at = tmp_path / "rules.json"
    at.write_text('{"hold": ["frozen"], "merchants": [["kiosk", "Food"]]}')
    own = load_rules(str(at))
    assert values(spark, "b string", [("Rs 5 frozen",), ("Rs 5 blocked",)], classify.modality(F.col("b"), own)) == [("hold",), ("actual",)]
    assert values(spark, "b string", [("The Kiosk",), ("Zomato",)], payees.category_hint(F.col("b"), own)) == [("Food",), (None,)]
    at.write_text('{"holds": []}')
    load_rules.cache_clear()
    with pytest.raises(ValueError, match="holds"):
        load_rules(str(at))


def test_classification_traps(spark):
    b = F.col("b")
    rows = [("Rs 5 reversed to you",), ("unscheduled stop",), ("Mandate created, autopay set up",), ("Rs 5 added to your wallet",), ("added to Amazon Pay balance",), ("credited back",), ("Txn failed",)]
    got = values(spark, "b string", rows, classify.modality(b), classify.verb_direction(b), classify.is_topup(b), classify.is_reversal_notice(b))
    assert got == [("failed", "in", False, True), ("future", None, False, False), ("mandate", None, False, False), ("actual", "in", False, False), ("actual", "out", True, False), ("actual", "in", False, True), ("failed", None, False, False)]
    assert values(spark, "b string", [("Chocolate House",), ("Dinner",)], payees.category_hint(b)) == [("Travel",), (None,)]


def test_dates_roll(spark):
    now = dt.datetime(2026, 6, 15)
    rows = [("31-02-26",), ("0-05-26",), ("05-0-26",), ("5/7",), ("05-06-126",), ("45 Jan 2026",), ("32-01-26",), ("05-13-26",), ("5 Foo 26",), (None,)]
    got = values(spark, "r string", rows, parse_sms_date(F.col("r"), F.lit(now))["date"])
    d = dt.date
    assert [g[0] for g in got] == [d(2026, 3, 3), d(2026, 4, 30), d(2025, 12, 5), d(2026, 7, 5), d(126, 6, 5), d(2026, 2, 14), None, None, None, None]


def test_entry_ids_share_references_and_buckets(spark):
    rows = [("debit", 500, 19, "REF123456"), ("credit", 900, 88, "REF123456"), ("debit", 500, 19, None), ("debit", 500, 21, None), ("debit", 500, 28, None), ("debit", 500, 28, "")]
    got = [r[0] for r in values(spark, "d string, p long, t long, r string", rows, ids.entry_id(F.lit("u"), F.lit("l"), F.col("d"), F.col("p"), F.col("t"), F.col("r")))]
    assert got[0] == got[1] and got[2] != got[3] and got[3] == got[4] == got[5]


def test_money(spark):
    assert values(spark, "p long", [(-123456789,), (5,), (0,)], amounts.paise_to_rupees(F.col("p")).cast("double"), amounts.format_paise(F.col("p"))) == [(-1234567.89, "-₹12,34,567.89"), (0.05, "₹0.05"), (0.0, "₹0.00")]
    assert values(spark, "b long, r double", [(5, 0.1), (-5, 0.1), (15, 0.1)], interest.expected_interest(F.col("b"), F.col("r"))) == [(1,), (0,), (2,)]


def test_parts(spark):
    rows = [("a", 1, 2, "x", 1), ("a", 2, 2, "y", 2), ("a", 2, 2, "z", 3), ("a", 5, 2, "!", 4), ("b", 2, 2, "y", 1)]
    got = multipart.reassemble(spark.createDataFrame(rows, "ref_id string, part_index int, total_parts int, text string, ordinal long"))
    assert sorted((r["ref_id"], r["complete"], r["body"], r["missing"]) for r in got.collect()) == [("a", True, "xz", []), ("b", False, None, [1])]


def test_pending_legs_leave_income(spark):
    """A pending link takes a credit out of income without lowering the expense; over-settlement goes below zero."""
    entry = "id string, user_id string, direction string, amount_effective_paise long, is_counted boolean, net_status string, category_id int, tag_id string, line_id string"
    e = spark.createDataFrame([("x", "u", "EXPENSE", 100, True, "active", 1, None, "l"), ("c", "u", "INCOME", 40, True, None, 1, None, "l"), ("d", "u", "INCOME", 7, True, None, 1, None, "l")], entry)
    s = "base_entry_id string, settle_entry_id string, status string, settled_amount_paise long"
    pending = aggregation.headline(e, spark.createDataFrame([("x", "c", "pending", 40), ("x", None, "pending", 1)], s)).first()
    assert (pending["income_paise"], pending["expense_paise"]) == (7, 100)
    over = aggregation.headline(e, spark.createDataFrame([("x", "c", "settled", 140)], s)).first()
    assert (over["income_paise"], over["expense_paise"]) == (7, -40)


def test_a_hold_first_is_the_anchor(spark):
    rows = [("l", "a", 0, "none", True, "sms", 1, 1, 500), ("l", "b", 50, "debit", True, "sms", 2, 2, 1), ("l", "c", 100, "debit", False, "sms", 2, 3, 380)]
    chain = spark.createDataFrame(rows, "line_id string, id string, amount_paise long, direction string, is_hold boolean, source string, t long, ordinal long, balance_after_paise long").withColumn("txn_time", F.timestamp_seconds("t"))
    assert [(r["entry_id"], r["type"], r["gap_paise"]) for r in reconciliation.discrepancies(chain).collect()] == [("c", "missing_outflow", 20)]


def test_first_place_last_values(spark):
    got = ledger.upsert(spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], "id string, seq long, v long")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("a", 1, 30), ("b", 2, 20)]


def test_templates(spark):
    """Each shape is learned once and read without a new one; a template whose check fails is flagged, and still found."""
    bodies = [f"Rs.{i}.00 paid at Kiosk {'AB'[i % 2]} on 0{i}-01-26. Bal Rs.9{i}.50" for i in range(1, 8)] + ["Rs 9,1O.00 paid to Kiosk", "Rs 3 only", "line\nbreak Rs 3 only"]
    m = spark.createDataFrame([(i, None if i > 7 else "ACME", b) for i, b in enumerate(bodies)], "seq long, issuer string, body string")
    asked = templates.PositionAuthor().roles("§AMT§ x §DATE§ bal §AMT§ §AMT§ §VPA§ §NUM§ §ACCT§ §MERCHANT§")
    assert asked == ["amount", "date", "balance", "balance", "none", "ref", "account_tail", "merchant"]
    t = templates.induce(m)
    assert sorted((r["issuer"], r["trust_state"], r["validation_runs"]) for r in t.collect()) == [("", "trusted", 5), ("", "trusted", 5), ("ACME", "flagged", 0), ("ACME", "trusted", 5)]
    got = {r["seq"]: (r["amount_paise"], r["balance_paise"], r["merchant"]) for r in templates.apply_templates(m, t).collect()}
    assert got[1] == (200, 9250, "Kiosk A") or got[1] == (200, 9250, "Kiosk B")
    assert got[7] == (9100, None, "Kiosk") and got[8] == (300, None, None)
    only = {r["seq"]: r["template_found"] for r in templates.apply_templates(m, t, trusted_only=True).collect()}
    assert not only[7] and only[8]
    odd = templates.apply_templates(spark.createDataFrame([(1, "ACME", "never seen"), (2, "OTHER", bodies[0]), (3, None, None)], "seq long, issuer string, body string"), t)
    assert [r["template_found"] for r in odd.orderBy("seq").collect()] == [False, False, False]
    pattern, groups = templates.template_pattern("a (b) §AMT§ §AMT§.", ["amount", "amount"])
    assert groups == {"amount": 1} and r"\(b\)" in pattern
