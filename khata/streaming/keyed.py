"""Tables of one row a key in Parquet, changed by batches: only the parts that a batch's keys fall in are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from khata.sources.space import finished, remove

#: Parts at first, and the rows a part, on average, beyond which their number doubles.
PARTS, ROWS = 8, 1_000_000


class KeyedTable:
    """A folder of data/<batch>/part=<p> and manifest/<batch>: which batch wrote each part last, and its rows.

    A batch writes beside what was there and then its manifest, so that a batch that is repeated starts from the manifest
    before it and writes the same again. Manifests and data that only manifests before the last but one name are removed.
    """

    def __init__(self, spark: SparkSession, at: str, key: str, schema: StructType, parts: int = PARTS, rows: int = ROWS):
        self.spark, self.at, self.key, self.schema, self.first, self.rows = spark, at, key, schema, parts, rows

    def manifest(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """part -> (batch, rows), all parts; as it was when batch `before` began. One row a part."""
        numbers = [n for n in finished(self.spark, f"{self.at}/manifest") if before is None or n < before]
        if not numbers:
            return dict.fromkeys(range(self.first), (-1, 0))
        rows = self.spark.read.schema("part int, batch long, n long").parquet(f"{self.at}/manifest/{max(numbers)}").collect()
        return {r["part"]: (r["batch"], r["n"]) for r in rows}

    def _read(self, manifest: dict[int, tuple[int, int]]) -> DataFrame:
        paths = [f"{self.at}/data/{batch}/part={part}" for part, (batch, n) in sorted(manifest.items()) if n]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        return self._read(self.manifest(before))

    def _part(self, n: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def _touched(self, keys: DataFrame, manifest: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """The parts of some keys: a number each, as many as there are parts at most."""
        parts = {r[0] for r in keys.select(self._part(len(manifest)).alias("p")).distinct().collect()}
        return {p: v for p, v in manifest.items() if p in parts}

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """The rows of some keys, from their parts alone."""
        return self._read(self._touched(keys, self.manifest(before))).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def put(self, rows: DataFrame, number: int) -> None:
        """Rows (one a key) in place of those of their keys."""
        had = self.manifest(number)
        n = len(had)
        touched = self._touched(rows, had)
        if not touched:
            return
        while sum(v[1] for v in had.values()) > self.rows * n:
            n *= 2
        # A table that has outgrown its parts is dealt anew as a whole, which each row meets a bounded number of times.
        touched = touched if n == len(had) else had
        merged = self._read(touched).join(rows.select(self.key), self.key, "left_anti").unionByName(rows.select(self.schema.names))
        # A part has one task; its rows are bounded, as parts grow in number.
        merged.withColumn("part", self._part(n)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.at}/data/{number}")
        counts = {r["part"]: r["count"] for r in self.spark.read.parquet(f"{self.at}/data/{number}").groupBy("part").count().collect()}
        now = (had if n == len(had) else {}) | {p: (number, counts.get(p, 0)) for p in (touched if n == len(had) else range(n))}
        self.spark.createDataFrame([(p, b, c) for p, (b, c) in sorted(now.items())], "part int, batch long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/{number}")
        self._clean(number, now, had)

    def _clean(self, number: int, now: dict, had: dict) -> None:
        keep = {(b, p) for m in (now, had) for p, (b, _) in m.items()}
        for old in sorted(n for n in finished(self.spark, f"{self.at}/manifest") if n < number)[:-1]:
            gone = self.spark.read.schema("part int, batch long, n long").parquet(f"{self.at}/manifest/{old}").collect()
            for r in gone:
                if (r["batch"], r["part"]) not in keep and r["batch"] >= 0:
                    remove(self.spark, f"{self.at}/data/{r['batch']}/part={r['part']}")
            remove(self.spark, f"{self.at}/manifest/{old}")
