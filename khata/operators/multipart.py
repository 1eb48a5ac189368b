"""Messages in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reassemble(parts: DataFrame) -> DataFrame:
    """ref_id, complete, body, missing of every reference. parts: ref_id, part_index, total_parts, text, ordinal.

    The first part to arrive says how many there are; of a repeated index the last one counts; indexes beyond the
    total are ignored; an incomplete message has no body.
    """
    total = parts.groupBy("ref_id").agg(F.min_by("total_parts", "ordinal").alias("total"))
    last = parts.groupBy("ref_id", "part_index").agg(F.max_by("text", "ordinal").alias("text"))
    whole = last.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("part_index", "text"))).alias("p")).join(total, "ref_id")
    expected = F.when(F.col("total") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("total")))).otherwise(F.array().cast("array<int>"))
    missing = F.array_except(expected, F.transform("p", lambda x: x["part_index"].cast("int")))
    body = F.array_join(F.transform(F.filter("p", lambda x: x["part_index"].between(1, F.col("total"))), lambda x: x["text"]), "")
    return whole.withColumn("missing", missing).select("ref_id", (F.size("missing") == 0).alias("complete"), F.when(F.size("missing") == 0, body).alias("body"), "missing")
