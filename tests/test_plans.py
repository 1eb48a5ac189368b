"""Plans of the ledger's queries: no stage that the JVM cannot compile."""

import pytest
from pyspark.sql import functions as F

from khata.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["message_gate", "apply_templates", "induce_templates", "ledger_pipeline", "code_links", "stream_admitted"])
def test_every_stage_is_compiled(spark, name):
    """Where code outgrows 64 KB Spark falls back silently, unless told not to."""
    assert spark.conf.get("spark.sql.codegen.fallback") == "true"
    # Plans of the same code, compiled earlier, would hide a failure.
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, SF).agg(F.count("*")).first()[0] > 0
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")
