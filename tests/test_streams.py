"""Streams over several batches: state, late and repeated ones."""

import datetime as dt

from pyspark.sql import functions as F

from khata.functions import interest
from khata.operators import multipart
from khata.streaming import ingest


def batches(spark, tmp_path, ddl, *rows):
    """A stream with one file, so one batch, for each list of rows."""
    for i, some in enumerate(rows):
        spark.createDataFrame(some, ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, stream, mode="append", name="out"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_chain_keeps_the_last_balance(spark, tmp_path):
    ddl = "line_id string, id string, delta_paise long, balance_after_paise long, is_hold boolean, ordinal long"
    stream = batches(spark, tmp_path, ddl, [("l", "a", 0, 500, True, 1), ("l", "b", -10, 490, False, 2), ("m", "x", 5, 5, False, 1)], [("l", "d", -20, 460, False, 4), ("l", "c", -7, 1, True, 3)], [("l", "e", 1, 461, False, 5), ("l", "f", 3, 460, False, 6)])
    got = sorted(tuple(r) for r in run(spark, ingest.chain_gaps(stream), name="chain").collect())
    assert got == [("l", "d", -10), ("l", "f", -4)]


def test_interest_is_asked_learned_and_absorbed(spark, tmp_path):
    ddl = "line_id string, id string, balance_before_paise long, credit_paise long, confirms boolean, ordinal long"
    stream = batches(spark, tmp_path, ddl, [("l", "a", 10_000, 10, False, 1)], [("l", "b", 10_000, 10, True, 2), ("l", "c", 20_000, 25, False, 3)], [("l", "d", 20_000, 90, False, 4), ("m", "e", 10_000, 10, False, 1)])
    got = {r["id"]: r["verdict"] for r in run(spark, ingest.interest_verdicts(stream), name="interest").collect()}
    assert got == {"a": "ask", "b": "ask", "c": "absorb", "d": "flag", "e": "ask"}
    rows = spark.createDataFrame([(10_000, 10, False), (20_000, 25, True), (20_000, 90, True)], "b long, c long, k boolean")
    assert [r[0] for r in rows.select(interest.verdict(F.col("b"), F.col("c"), F.col("k"), F.lit(0.001))).collect()] == ["ask", "absorb", "flag"]


def test_parts_in_any_order_and_forgotten_when_late(spark, tmp_path):
    ddl = "ref_id string, part_index int, total_parts int, text string, ordinal long, received_at timestamp"
    at = lambda minute: dt.datetime(2026, 1, 1, 12, minute)
    first = [("a", 2, 2, "y", 1, at(0)), ("b", 1, 2, "p", 2, at(0))]
    stream = batches(spark, tmp_path, ddl, first, [("a", 1, 2, "x", 3, at(1))], [("c", 1, 1, "z", 4, at(50))], [("d", 1, 1, "w", 6, at(51))], [("b", 2, 2, "q", 5, at(1))])
    got = {(r["ref_id"], r["complete"], r["body"]) for r in run(spark, ingest.assemble(stream, "10 minutes"), "update", "parts").collect()}
    assert {("a", True, "xy"), ("c", True, "z")} <= got and not any(c for r, c, _ in got if r == "b")
    whole = multipart.reassemble(spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    assert {r["ref_id"]: r["body"] for r in whole.collect()} == {"a": "xy", "b": "pq", "c": "z", "d": "w"}


def test_near_duplicates_meet_across_batches(spark, tmp_path):
    ddl = "id string, line_id string, amount_captured_paise long, merchant_text string, txn_time timestamp, ordinal long"
    at = lambda second: dt.datetime(2026, 1, 1, 12, 0, second)
    stream = batches(spark, tmp_path, ddl, [("a", "l", 5, "m", at(0), 1)], [("b", "l", 5, "m", at(50), 2), ("c", "l", 6, "m", at(50), 3)], [("d", "l", 5, None, at(55), 4)])
    assert [tuple(r) for r in run(spark, ingest.near_duplicates(stream, 60), name="near").collect()] == [("a", "b")]


def test_the_ledger_takes_the_last_write_whatever_batch_brings_it(spark, tmp_path):
    ddl = "id string, seq long, v long"
    stream = batches(spark, tmp_path, ddl, [("a", 5, 50), ("b", 2, 20)], [("a", 1, 10), ("c", 3, 30)], [("b", 9, 90), ("a", 4, 40)])
    at, checkpoint = str(tmp_path / "ledger"), str(tmp_path / "checkpoint")
    ingest.drain(stream, at, checkpoint).awaitTermination()
    rows = lambda: sorted(tuple(r) for r in ingest.read_ledger(spark, at, stream.schema).collect())
    assert rows() == [("a", 1, 50), ("b", 2, 90), ("c", 3, 30)]
    # Offline is no call; what waits then comes as one more batch. A batch whose commit is lost is taken again.
    spark.createDataFrame([("a", 6, 60)], ddl).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    ingest.drain(stream, at, checkpoint).awaitTermination()
    assert rows() == [("a", 1, 60), ("b", 2, 90), ("c", 3, 30)]
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink()
    ingest.drain(stream, at, checkpoint).awaitTermination()
    assert rows() == [("a", 1, 60), ("b", 2, 90), ("c", 3, 30)]
