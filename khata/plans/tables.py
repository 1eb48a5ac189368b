"""The registered queries of whole tables and sources, and of streams without a closing row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.operators import integrity
from khata.plans.inputs import by_shape, load, quoted
from khata.plans.queries import _ran, query
from khata.plans.streams import timed_stream
from khata.sources import schemas, vectors
from khata.sources.space import new_folder
from khata.streaming import ingest

# Every kind of reference is broken for some rows: users 97 to 99, lines that end in 2, a tag, two categories, later entries.
_SQL = {
    "users": "SELECT DISTINCT CAST(c_custkey % 97 AS STRING) AS id FROM customer",
    "lines": "SELECT DISTINCT line_id AS id, user_id FROM entries WHERE line_id NOT LIKE '%-2'",
    "tags": "SELECT tag_id AS id, min(user_id) AS user_id, CAST(max(category_id) + 1 AS INT) AS category_id FROM entries WHERE tag_id <> 't3' GROUP BY tag_id",
    "payees": "SELECT 'p' || CAST(s_suppkey AS STRING) AS id, CAST(s_suppkey * 7 % 101 AS STRING) AS user_id, CAST(s_suppkey % 14 + 1 AS INT) AS default_category_id, 't' || CAST(s_suppkey % 5 AS STRING) AS default_tag_id FROM supplier",
    "personal_debt": "SELECT 'd' || CAST(s_suppkey AS STRING) AS id, CAST(s_suppkey * 3 AS STRING) AS user_id FROM supplier WHERE s_suppkey < 30",
    "ledger_entries": "SELECT id, user_id, line_id, payee_id, category_id, tag_id, reverses_entry_id FROM entries",
    "settlements": "SELECT id, user_id, base_entry_id, settle_entry_id, personal_debt_id FROM settlements",
}
_REFS = [r for r in integrity.REFERENCES if r[0] in _SQL and (r[2] in _SQL or r[2] == "categories")]
_CHECKS = " UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS \"column\", '{p}' AS parent, '{a}' AS action, count(*) AS n, min(CAST({k} AS STRING)) AS example FROM t_{c} WHERE {k} IS NOT NULL AND CAST({k} AS STRING) NOT IN (SELECT CAST(id AS STRING) FROM t_{p})" for c, k, p, a in _REFS)


@query(
    ", " + ", ".join(f"t_{n} AS ({q})" for n, q in _SQL.items()) + f", t_categories AS (SELECT unnest(range(1, 13)) AS id) SELECT * FROM ({_CHECKS}) WHERE n > 0",
    "entries", "settlements",
)
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier")} | {n: load(spark, sf_dir, n) for n in ("entries", "settlements")}
    tables = {}
    for name, sql in _SQL.items():
        source = sql.split(" FROM ")[1].split(" ")[0]
        tables[name] = spark.sql(sql.replace(f" FROM {source}", " FROM {source}"), source=base[source])
    return integrity.violations(tables | {"categories": schemas.categories(spark)})


@query(f"SELECT shape, sender, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars, {by_shape(lambda s: quoted(s.reason))} AS expected FROM messages GROUP BY shape, sender", "messages")
def scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled messages from JSON lines, as a corpus is kept."""
    at = new_folder(spark)
    m = load(spark, sf_dir, "messages").select("shape", "sender", "body", F.struct(F.expr(by_shape(lambda s: quoted(s.reason))).alias("gate")).alias("expect"))
    m.write.json(at)
    read = vectors.read_messages(spark, at, "shape long, sender string, body string, expect struct<gate: string>")
    return read.groupBy("shape", "sender").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.min("expect.gate").alias("expected"))


@query(
    """SELECT a.id AS a, b.id AS b FROM entries a JOIN entries b ON a.line_id = b.line_id AND a.amount_captured_paise = b.amount_captured_paise
    AND coalesce(a.merchant_text, '') = coalesce(b.merchant_text, '') AND a.ordinal < b.ordinal AND abs(a.t_sec - b.t_sec) <= 3000""",
    "entries",
)
def stream_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").select("id", "line_id", "amount_captured_paise", "merchant_text", F.timestamp_seconds(F.col("t_sec") + 1_000_000_000).alias("txn_time"), F.col("ordinal").cast("long").alias("ordinal"))
    at = new_folder(spark)
    return _ran(ingest.near_duplicates(timed_stream(e, f"{at}/in", F.unix_seconds("txn_time"), "txn_time").where("id is not null"), 3000), at)


@query(
    """, v AS (SELECT line_id, id, ordinal, balance_after_paise AS b, amount_captured_paise % 100 AS c, ordinal % 5 = 3 AS confirms FROM entries WHERE balance_after_paise IS NOT NULL),
    f AS (SELECT line_id, arg_min(CASE WHEN b > 0 THEN c::DOUBLE / b ELSE 0.0 END, ordinal) AS rate, min(ordinal) AS since FROM v WHERE confirms GROUP BY line_id)
    SELECT line_id, id, CASE WHEN since IS NULL OR ordinal <= since THEN 'ask' WHEN e > 0 AND abs(c - e) <= 0.5 * e THEN 'absorb' ELSE 'flag' END AS verdict FROM (SELECT *, floor(b * rate + 0.5) AS e FROM v LEFT JOIN f USING (line_id))""",
    "entries",
)
def stream_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits in their order; every fifth is confirmed by the user, of whom the first on a line teaches its rate."""
    e = load(spark, sf_dir, "entries").where("balance_after_paise is not null")
    rows = e.select("line_id", "id", F.col("balance_after_paise").alias("balance_before_paise"), (F.col("amount_captured_paise") % 100).alias("credit_paise"), (F.col("ordinal") % 5 == 3).alias("confirms"), F.col("ordinal").cast("long").alias("ordinal"), F.timestamp_seconds("ordinal").alias("t"))
    at = new_folder(spark)
    stream = timed_stream(rows, f"{at}/in", F.col("ordinal"), "t").where("id is not null").drop("t")
    return _ran(ingest.interest_verdicts(stream), at)
