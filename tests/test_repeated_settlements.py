"""Settlements that share an id, as those of an order with several first lines do, against the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from khata.plans import links, streams  # noqa: F401  (register their queries)
from khata.plans.queries import ORACLE_SQL, QUERIES
from khata.streaming import ingest, stateful
from tests.test_stateful import CREDITS, PENDING, at, kept
from tests.test_streams import batches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The tables with many orders' first line three times, once at another price; few prices, so that amounts meet."""
    folder = tmp_path_factory.mktemp("sf")
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_totalprice", F.col("o_totalprice") % 5).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") % 5)
    first = lines.where("l_linenumber = 1 and l_orderkey % 5 in (0, 3, 4)")
    lines.unionByName(first).unionByName(first.withColumn("l_extendedprice", F.col("l_extendedprice") + 1)).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["match_refunds", "stream_refunds", "settle_refunds", "stream_headline"])
def test_query_matches_sql_over_repeated_ids(spark, repeated, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, repeated)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


def test_a_streams_first_state_may_fill_several_frames(spark, tmp_path):
    pending = [(f"r{i:03}", "7", 5, at(86_400 + i)) for i in range(50)]
    credits = [(f"c{i:03}", "7", 5, at(1000 + i), i) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        stream = batches(spark, tmp_path, CREDITS, credits, [("end", "-", 0, at(9_000_000), 0)])
        rows, _ = kept(spark, stateful.settle_refunds(stream, spark.createDataFrame(pending, PENDING), "60 seconds"), tmp_path)
        assert sorted(map(tuple, rows.collect())) == [(f"r{i:03}", f"c{i:03}") for i in range(50)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_refunds_of_one_id_let_in_what_any_of_them_does(spark, tmp_path):
    pending = [("a", "1", 5, at(200_000)), ("a", "1", 5, at(100_000)), ("b", "1", 5, at(500_000)), ("b", "1", 5, None)]
    stream = batches(spark, tmp_path, CREDITS, [("early", "1", 5, at(0), 1), ("late", "1", 5, at(50_000), 2), ("last", "1", 5, at(600_000), 3)])
    rows, _ = kept(spark, ingest.match_refunds(stream, spark.createDataFrame(pending, PENDING)), tmp_path)
    assert sorted(map(tuple, rows.collect())) == [("a", "last"), ("a", "late"), ("b", "early"), ("b", "last"), ("b", "late")]
