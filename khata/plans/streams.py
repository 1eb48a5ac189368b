"""The registered queries of streams that hold state, over files that come one a batch in the order of their rows' times.

A last row far ahead moves the watermark past all others, as the next day's messages would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions import amounts, classify, gating
from khata.operators import settlement
from khata.plans.inputs import by_shape, load
from khata.plans.queries import _FOUND, ORACLE_SQL, _ledger, _on_chain, _ran, query
from khata.sources.space import new_folder, written
from khata.streaming import stateful

#: Batches of a stream.
BATCHES = 4
#: Seconds by which the closing row is ahead; seconds of the first day, as a stream takes times until 1970 for late.
AHEAD, FROM = 10_000_000, 1_000_000_000


def timed_stream(rows: DataFrame, at: str, order: Column, time: str) -> DataFrame:
    """rows as a stream of BATCHES files by the order of their arrival, then one of a closing row: nulls but its time.

    Files are told apart by their times of change, which are set here, as the stream takes the oldest first.
    """
    spark = rows.sparkSession
    arrived = rows.withColumn("_order", order)
    arrived.repartitionByRange(BATCHES, "_order").drop("_order").write.parquet(at)
    last = rows.agg((F.max(time) + F.make_dt_interval(secs=F.lit(AHEAD))).alias(time))
    closing = last.select(*(F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    closing.coalesce(1).write.parquet(f"{at}-end")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for k, folder in enumerate((at, f"{at}-end")):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        for i, file in enumerate(sorted(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))):
            fs.setTimes(jvm.org.apache.hadoop.fs.Path(file), 1_000_000_000_000 + 1000 * (k * 100 + i), -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}*")


def _seconds(column: str) -> Column:
    return F.timestamp_seconds(F.col(column) + FROM)


# Parts -----------------------------------------------------------------------------------------------------------------------

_PART_SEC = "l_orderkey * 100 + l_linenumber * 60 + CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 3600 ELSE 0 END"
_ALL_PARTS = " || ".join(f"ref_id || '.{i}|'" for i in (1, 2, 3, 4))


@query(
    f"""SELECT ref_id, n = 4 AS complete, CASE WHEN n = 4 THEN {_ALL_PARTS} END AS body, CAST(4 - n AS INT) AS n_missing FROM (SELECT ref_id, count(DISTINCT i) FILTER (WHERE i <= 4 AND t <= first + 600) AS n FROM
    (SELECT *, min(t) OVER (PARTITION BY ref_id) AS first FROM (SELECT CAST(l_orderkey AS STRING) AS ref_id, l_linenumber AS i, {_PART_SEC} AS t FROM lineitem)) GROUP BY ref_id)"""
)
def stream_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of four parts, of which every eleventh comes an hour late, when its message has been given up."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = li.select(
        F.col("l_orderkey").cast("string").alias("ref_id"), F.col("l_linenumber").cast("int").alias("part_index"), F.lit(4).alias("total_parts"), F.concat_ws("", F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("|")).alias("text"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.timestamp_seconds(F.expr(_PART_SEC) + FROM).alias("received_at"),
    )
    at = new_folder(spark)
    stream = timed_stream(parts, f"{at}/in", F.unix_seconds("received_at"), "received_at").withColumns({"ref_id": F.coalesce("ref_id", F.lit("")), "total_parts": F.coalesce("total_parts", F.lit(0))})
    out = _ran(stateful.assemble(stream, "1 minute", 600, 7200), at)
    return out.where("ref_id <> ''").select("ref_id", "complete", "body", F.size("missing").alias("n_missing"))


# Chains ----------------------------------------------------------------------------------------------------------------------


@query(_on_chain(_FOUND))
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains' entries up to 50 seconds out of order; gaps that were taken back are gone from the sum."""
    c = load(spark, sf_dir, "chain").where("coalesce(source, 'sms') = 'sms'")
    delta = classify.signed_delta(F.col("direction"), F.col("amount_paise"))
    rows = c.select("line_id", "id", delta.cast("long").alias("delta_paise"), "balance_after_paise", "is_hold", _seconds("t_sec").alias("txn_time"), F.col("ordinal").cast("long").alias("ordinal"))
    at = new_folder(spark)
    stream = timed_stream(rows, f"{at}/in", F.unix_seconds("txn_time") + F.pmod(F.xxhash64("id"), F.lit(51)), "txn_time").withColumns({"line_id": F.coalesce("line_id", F.lit("")), "delta_paise": F.coalesce("delta_paise", F.lit(0)), "ordinal": F.coalesce("ordinal", F.lit(0))})
    changes = _ran(stateful.chain_gaps(stream, "60 seconds"), at).where("line_id <> ''")
    left = changes.groupBy("line_id", "entry_id", "gap_paise").agg(F.sum("change").alias("n")).where("n > 0")
    return left.select("line_id", "entry_id", F.when(F.col("gap_paise") < 0, "missing_outflow").otherwise("missing_inflow").alias("type"), F.abs("gap_paise").alias("gap_paise"))


# Codes -----------------------------------------------------------------------------------------------------------------------


def _codes_and_spends(spark: SparkSession, sf_dir: str, at: str) -> tuple[DataFrame, DataFrame]:
    """One-time codes that name an amount, and expenses, of fewer users and amounts than there are, so that they meet."""
    gated = gating.gate(load(spark, sf_dir, "messages").withColumn("sender", F.lit("VM-YESBNK")))
    # Written without bodies, as each stream's rows are read for their bounds, their files and their last time.
    rows = gated.select(
        F.col("seq").cast("string").alias("id"), (F.col("user_id") % 50).alias("user_id"), (F.col("paise") % 300).alias("amount_paise"), _seconds("t_sec").alias("received_at"), F.col("seq").cast("long").alias("seq"),
        (F.col("gate.buffered") & amounts.has_amount(F.col("body"))).alias("code"), (F.col("gate.admit") & F.coalesce(classify.verb_direction(F.col("body")) == "out", F.lit(False))).alias("spend"),
    )
    rows = written(rows)
    streams = (timed_stream(rows.where(kind).drop("code", "spend"), f"{at}/{kind}", F.unix_seconds("received_at"), "received_at") for kind in ("code", "spend"))
    # The closing rows belong to a user of their own.
    return tuple(s.withColumns({"user_id": F.coalesce("user_id", F.lit(-1)), "amount_paise": F.coalesce("amount_paise", F.lit(-1)), "seq": F.coalesce("seq", F.lit(-1))}) for s in streams)


@query(ORACLE_SQL["code_links"])
def stream_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    codes, spends = _codes_and_spends(spark, sf_dir, at)
    return _ran(stateful.code_links(codes, spends, "200000 seconds", 86_400), at).where("code_id is not null")


@query(
    f"""SELECT CAST(o.seq AS STRING) AS code_id, CAST(e.seq AS STRING) AS entry_id FROM (SELECT * FROM messages WHERE shape = 4) o
    LEFT JOIN (SELECT * FROM messages WHERE {by_shape(lambda s: str(s.verb == 'out' and s.reason == 'admit'))}) e ON o.user_id % 50 = e.user_id % 50 AND o.paise % 300 = e.paise % 300 AND e.t_sec BETWEEN o.t_sec AND o.t_sec + 86400""",
    "messages",
)
def stream_code_spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    codes, spends = _codes_and_spends(spark, sf_dir, at)
    return _ran(stateful.code_spends(codes, spends, "10 seconds", 86_400), at).where("code_id is not null").select("code_id", "entry_id")


# Refunds one to one ------------------------------------------------------------------------------------------------------------

# The same rule by its own definition in SQL: credits and refunds are numbered along the walk of waiting refunds.
_SETTLED = """, ev AS (SELECT CAST(user_id AS INT) % 20 AS user_id, expected_amount_paise % 10 AS amount, coalesce(expected_sec - 86400, -1000000000) AS t, 0 AS kind, 0 AS o, id FROM settlements WHERE status = 'pending'
    UNION ALL SELECT CAST(user_id AS INT) % 20, amount_captured_paise % 10, t_sec, 1, ordinal, id FROM entries WHERE direction = 'INCOME'),
    w AS (SELECT *, sum(1 - 2 * kind) OVER p AS level, count(*) FILTER (WHERE kind = 0) OVER p AS r, count(*) FILTER (WHERE kind = 1) OVER p AS c FROM ev WINDOW p AS (PARTITION BY user_id, amount ORDER BY t, kind, o, id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, least(0, min(level) OVER (PARTITION BY user_id, amount ORDER BY t, kind, o, id ROWS UNBOUNDED PRECEDING)) AS low, lag(level, 1, 0) OVER (PARTITION BY user_id, amount ORDER BY t, kind, o, id) AS was FROM w)
    SELECT s.id AS settlement_id, c.id AS credit_id FROM l s JOIN l c ON s.user_id = c.user_id AND s.amount = c.amount AND s.kind = 0 AND c.kind = 1 AND s.r = c.c + c.low
    AND NOT (c.level = c.low AND c.level < c.was AND c.low < (SELECT least(0, coalesce(min(x.level), 0)) FROM w x WHERE x.user_id = c.user_id AND x.amount = c.amount AND (x.t, x.kind, x.o, x.id) < (c.t, c.kind, c.o, c.id)))"""


def _credits_and_pending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Credits and pending refunds of fewer users and amounts than there are, so that many contend for one."""
    e, s = _ledger(spark, sf_dir)
    user = F.col("user_id").cast("int") % 20
    credits = e.where("direction = 'INCOME'").select("id", user.alias("user_id"), (F.col("amount_captured_paise") % 10).alias("amount_paise"), _seconds("t_sec").alias("txn_time"), F.col("ordinal").cast("long").alias("ordinal"))
    return credits, s.where("status = 'pending'").select("id", user.alias("user_id"), (F.col("expected_amount_paise") % 10).alias("expected_amount_paise"), _seconds("expected_sec").alias("expected_at"))


@query(_SETTLED, "settlements", "entries")
def settle_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement.settle_refunds(*_credits_and_pending(spark, sf_dir))


@query(_SETTLED, "settlements", "entries")
def stream_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credits up to 5000 seconds out of order."""
    at = new_folder(spark)
    credits, pending = _credits_and_pending(spark, sf_dir)
    stream = timed_stream(credits, f"{at}/in", F.unix_seconds("txn_time") + F.pmod(F.xxhash64("id"), F.lit(5001)), "txn_time").withColumns({"user_id": F.coalesce("user_id", F.lit(-1)), "amount_paise": F.coalesce("amount_paise", F.lit(-1)), "ordinal": F.coalesce("ordinal", F.lit(0))})
    return _ran(stateful.settle_refunds(stream, pending, "6000 seconds"), at)
