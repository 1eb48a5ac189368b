"""Leaks of skeletons as a metric of the run that makes them: no second pass, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from khata.functions.masking import leak

NAME = "redaction"


class LeakError(RuntimeError):
    """More skeletons leak than a run may have."""


def _metrics(column: str) -> list:
    residue = leak(F.col(column))
    return [F.count(F.lit(1)).alias("rows"), F.count_if(residue.isNotNull()).alias("leaks"), F.min(residue).alias("residue")]


def observed(skeletons: DataFrame, observation: Observation, column: str = "skeleton") -> DataFrame:
    """The same rows; once an action has run over them, observation.get has rows, leaks and one residue."""
    return skeletons.observe(observation, *_metrics(column))


def check(metrics: dict, most: int = 0) -> dict:
    """The metrics, or LeakError if more than `most` skeletons leak."""
    if (metrics.get("leaks") or 0) > most:
        raise LeakError(f"{metrics['leaks']} of {metrics['rows']} skeletons leak, such as {metrics['residue']!r}")
    return metrics


def observed_stream(skeletons: DataFrame, column: str = "skeleton") -> DataFrame:
    """The same for a stream, whose batches each report to a LeakListener."""
    return skeletons.observe(NAME, *_metrics(column))


class LeakListener(StreamingQueryListener):
    """Adds up what the batches of all streams made by observed_stream report. Register it before a stream starts."""

    def __init__(self, most: int = 0):
        self.most, self.rows, self.leaks, self.residue = most, 0, 0, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.rows += row["rows"]
            self.leaks += row["leaks"]
            self.residue = self.residue or row["residue"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def finish(self, query: StreamingQuery) -> dict:
        """Waits for a query's end, then gives the metrics or raises; the last batch's report may come a moment later."""
        query.awaitTermination()
        spark = query._jsq.sparkSession()
        spark.sparkContext().listenerBus().waitUntilEmpty()
        return check({"rows": self.rows, "leaks": self.leaks, "residue": self.residue}, self.most)
