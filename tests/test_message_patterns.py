"""Patterns at word boundaries, and how messages are dealt to tasks."""

import itertools
import re

from pyspark.sql import functions as F

from khata.functions import masking
from khata.functions.rules import load_rules
from khata.functions.senders import normalise_sender
from khata.functions.text import ANY, EDGE, SPACES, WS, W, has_word, literal, trimmed
from khata.plans import inputs

#: The rewrites as they were first written, with a boundary of either side at both ends.
M, STOPS = masking._MULTIPLIER, masking._STOPS
FIRST = {
    1: rf"{EDGE}[0-9][0-9,]*(?:\.[0-9]+)?{WS}*{M}{EDGE}",
    2: rf"{EDGE}[0-9]{{1,2}}[-/ ](?:[0-9]{{1,2}}|{masking.MONTHS})[-/ ]?[0-9]{{2,4}}{EDGE}",
    3: rf"{EDGE}(?:x{{2,}}|\*{{2,}}|a\/c{WS}*[*.]*{WS}*|ending{WS}+|acct\.?{WS}*|account{WS}+|card{WS}+x*){WS}*[0-9]{{2,6}}{EDGE}",
    4: rf"{EDGE}(?:{W}|[.-])+@[a-z]+{EDGE}",
    5: rf"{EDGE}(at|to|for|towards){WS}+({ANY}+?)(?={WS}+(?:{STOPS}){EDGE}|{WS}*§|[.,]|\z)",
}
BODIES = ["a**1234 **1234 x**99 xx12 axx12 xx1234567 a/c *. 12 ending 12a", "5k 5k, a5k 5kx 1,2.5 lakh_ 1.5cr. é5k", "1-2-25 01 jan 2025 a1-2-25 1/2/2025b 1-2-255555", "a.b@c .a@b a..@x-@y -.-@z a@b1 a@b_ é@b", "paid at X on 5, bat y. to for z towards a/c at upi_", "", "at", None, "spent; unspent spentx _spent é-spent due on, xdue on"]


def test_patterns_find_what_both_sided_boundaries_find(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "i int, b string")
    for k, pattern in FIRST.items():
        assert pattern != masking.REWRITES[k][0]
        got = rows.select(*(F.regexp_replace(trimmed(F.lower("b")), p, masking.REWRITES[k][1]) for p in (pattern, masking.REWRITES[k][0]))).collect()
        assert [r[0] for r in got] == [r[1] for r in got], k
    r = load_rules()
    words = r.transaction_verbs + r.future + r.conditional + r.hold + r.mandate + r.refund + r.failed
    assert all(re.fullmatch("[a-z].*[a-z]", w) for w in words)
    got = rows.select(F.explode(F.split("b", " ")).alias("w")).select(F.col("w").rlike(f"(?i){EDGE}(?:{'|'.join(map(literal, words))}){EDGE}"), has_word(F.col("w"), words)).collect()
    assert [x[0] for x in got] == [x[1] for x in got] and any(x[0] for x in got)


def test_messages_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(inputs, "MESSAGES_A_TASK", 50, raising=False)
    m = inputs.load(spark, "/root/testdata/sf0.001", "messages")
    assert m.rdd.getNumPartitions() >= m.count() / 50


def test_white_space_is_the_same_in_patterns_and_trims(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(1 << 16) if not 0xD800 <= i < 0xE000], "c string")
    told = rows.select("c", F.col("c").rlike(WS).alias("ws"), (trimmed(F.concat("c", F.lit("x"), "c")) == "x").alias("cut"), F.col("c").rlike(masking._INSIDE).alias("inside"))
    assert told.where("ws <> cut").isEmpty() and told.where("ws").count() == len(SPACES) == 25
    assert told.where(F.col("inside") == (F.col("ws") | F.col("c").isin("§", ".", ","))).isEmpty()


def test_senders_are_read_as_by_their_parts(spark):
    """The entity as it was first written: the list of parts, cut at both ends."""
    tokens = ["VM", "S", "", "91", "YES", "-", " ", "+91", "9812345670", "AB"]
    given = ["-".join(t) for n in (1, 2, 3, 4) for t in itertools.product(tokens, repeat=n)] + ["+", "+91+9812345670", "919198123456", "91 98123-45670", "9123456789", " VM-YESBNK-S\n"]
    first = normalise_sender(F.col("s"))
    got = spark.createDataFrame([(g,) for g in given], "s string").select("s", first["kind"], first["entity"]).collect()
    for s, kind, entity in got:
        raw = s.strip("".join(SPACES))
        digits = re.sub(r"^\+", "", re.sub(r"^\+?91", "", "".join(c for c in raw if c not in SPACES + "-"), count=1))
        parts = [p for p in raw.upper().split("-") if p]
        rest = parts[1:] if len(parts) > 1 and re.fullmatch("[A-Z]{2}", parts[0]) else parts
        rest = rest[:-1] if len(rest) > 1 and rest[-1] in ("S", "T", "P", "G") else rest
        person = re.fullmatch("[0-9]{10}", digits) is not None
        assert (kind, entity) == ("personal" if person else "dlt", None if person else "-".join(rest) or None), s
