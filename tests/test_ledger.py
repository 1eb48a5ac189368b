"""Every registered ledger query against its SQL, and vectors of our own for the message functions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from khata.functions import amounts, masking, senders
from khata.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_backfill_takes_five_days(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") * 120)
    events.write.parquet(str(tmp_path / "events.parquet"))
    want = [r[0] for r in events.select("event_id").collect() if r[0] * 7 % 900_000 >= 900_000 - 5 * 86_400]
    assert sorted(r[0] for r in QUERIES["backfill"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("apart", [1, 50, 70])
def test_backfill_takes_two_days_before_the_last_message(spark, tmp_path, apart):
    """Messages end at 6,993, 349,650 and 489,510 s; the five days begin at 468,000 s."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") * apart)
    events.write.parquet(str(tmp_path / "events.parquet"))
    times = {r[0]: r[0] * 7 % 900_000 for r in events.select("event_id").collect()}
    since = min(900_000 - 5 * 86_400, max(times.values()) - 2 * 86_400)
    want = sorted(k for k, t in times.items() if t >= since)
    assert sorted(r[0] for r in QUERIES["backfill"](spark, str(tmp_path)).collect()) == want and len(want) > 300


def test_backfill_of_no_messages(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["backfill"](spark, str(tmp_path)).count() == 0


def test_registry(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_amounts(spark):
    got = one(spark, lambda c: amounts.parse_amount(c)["paise"], "Rs.1,23,456.78", "INR 500", "₹ 2.5 lakh", "Rs 3 cr", "no money", None, "")
    assert got == [12_345_678, 50_000, 25_000_000, 3_000_000_000, None, None, None]


def test_masks_share_a_shape_and_leak_nothing(spark):
    bodies = ("Rs.500 spent at Zomato via UPI from a/c **1234 on 02-06-26.", "Rs 12,345.60 spent at Uber via UPI from a/c **9876 on 12-11-25.")
    a, b = one(spark, masking.fingerprint, *bodies)
    assert a == b
    assert one(spark, lambda c: masking.leak(masking.mask(c)), *bodies, None, "") == [None] * 4


def test_senders(spark):
    got = one(spark, lambda c: senders.normalise_sender(c)["entity"], "VM-HDFCBK", "JD-SBIINB-S", " ix-hdfcbk ")
    assert got == ["HDFCBK", "SBIINB", "HDFCBK"]
