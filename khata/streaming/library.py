"""A template library that learns from a stream: only shapes that it cannot read yet are induced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from khata.operators.templates import Author, induce, shape
from khata.sources.space import finished, remove, written

SCHEMA = "issuer string, fingerprint string, pattern string, groups map<string,int>, reading string, trust_state string, validation_runs int, batch long"
#: Versions after which the library is written whole.
WHOLE = 16


def read_library(spark: SparkSession, at: str, before: int | None = None) -> DataFrame:
    """Each shape's last template: issuer, fingerprint, pattern, groups, reading, trust_state, validation_runs, batch.

    before: as it was when that batch began. A version that was not written to its end does not count.
    """
    number = lambda folder: [n for n in finished(spark, f"{at}/{folder}") if before is None or n < before]
    whole = max(number("whole"), default=-1)
    paths = [f"{at}/whole/{whole}"] if whole >= 0 else []
    paths += [f"{at}/versions/{n}" for n in number("versions") if n > whole]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*paths)
    values = [c for c in rows.columns if c not in ("issuer", "fingerprint")]
    return rows.groupBy("issuer", "fingerprint").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("issuer", "fingerprint", "v.*")


def learn(messages: DataFrame, at: str, checkpoint: str, author: Author | None = None) -> StreamingQuery:
    """Messages (issuer, body, seq, ...) of a stream into the library at a folder; all that waits, then stops.

    A batch's messages whose shape has a trusted template cost no author's call and no validation. The others, those of
    flagged templates among them, are induced from the batch, once a shape; the batch's templates are a version of the
    library. A repeated batch starts from the version before it and writes its own anew. Now and then the library is
    written whole, so that few versions are read.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shaped = shape(batch.withColumn("issuer", F.coalesce("issuer", F.lit(""))))
        known = read_library(spark, at, number)
        missed = written(shaped.join(known.where("trust_state = 'trusted'").select("issuer", "fingerprint"), ["issuer", "fingerprint"], "left_anti"))
        if missed.isEmpty():
            remove(spark, f"{at}/versions/{number}")
        else:
            induce(missed, author).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/versions/{number}")
        if number % WHOLE == WHOLE - 1:
            read_library(spark, at, number + 1).write.mode("overwrite").parquet(f"{at}/whole/{number}")

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
