"""Similar tags without meeting all of a user's: candidates that share what the threshold makes them share, then verified."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.payees import similarity

THRESHOLD = 0.6
#: Room for the rounding of scores in the bounds, which only widens them.
_ROOM = 1e-9


def _grams(x: Column, longest: int) -> Column:
    """(text, place) of every run of 1 to `longest` characters."""
    each = lambda n: F.transform(F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - n + 1)), lambda i: F.struct(F.substr(x, i, F.lit(n)).alias("text"), i.alias("place")))
    none = F.array().cast("array<struct<text: string, place: int>>")
    return F.flatten(F.array(*(F.coalesce(each(n), none) for n in range(1, longest + 1))))


def _keys(names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(few, many): what a name shows as the side that must have one of few keys, and as the one that has them all.

    names: user_id, low. kind p: of a common prefix, the shorter shows its beginning of threshold * length characters,
    the longer all its beginnings; c: of a name within another, the shorter shows its first three characters, the longer
    all its runs of up to three; e: of at most k = (1 - threshold) * length edits, the longer shows k + 1 pieces, of which
    one is untouched and at most k places away, the shorter all its runs as long as a piece.
    """
    x, n = F.col("low"), F.length("low")
    piece = math.ceil(1 / (1 - threshold))
    row = lambda kind, text, place: F.struct(F.lit(kind).alias("kind"), text.alias("text"), place.cast("int").alias("place"))
    start = F.ceil(n * F.lit(threshold) - F.lit(_ROOM)).cast("int")
    k = F.floor(n * F.lit(1 - threshold) + F.lit(_ROOM)).cast("int")
    # Pieces as even as may be: piece i begins after floor(i * n / (k + 1)) characters.
    cut = lambda i: F.floor(i * n / (k + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), k), lambda i: row("e", F.substr(x, cut(i) + 1, cut(i + 1) - cut(i)), cut(i) + 1))
    few = F.concat(F.array(row("p", F.substr(x, F.lit(1), start), F.lit(1)), row("c", F.substr(x, F.lit(1), F.least(n, F.lit(3))), F.lit(1))), pieces)
    beginnings = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: row("p", F.substr(x, F.lit(1), i), F.lit(1)))
    runs = F.concat(F.array(row("c", F.lit(""), F.lit(1))), F.transform(_grams(x, 3), lambda g: row("c", g["text"], g["place"])))
    many = F.concat(beginnings, F.array_distinct(F.transform(runs, lambda g: row("c", g["text"], F.lit(1)))), F.transform(_grams(x, piece), lambda g: row("e", g["text"], g["place"])))
    shown = lambda keys: names.select("user_id", "low", n.alias("n"), k.alias("k"), F.explode(keys).alias("key")).select("user_id", "low", "n", "k", "key.*")
    return shown(few), shown(many)


def candidates(new: DataFrame, existing: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """user_id, a, b: distinct pairs of a new and an existing name (user_id, low) of a user, in lower case, that may
    reach the threshold; none that does is missing."""
    (new_few, new_many), (old_few, old_many) = _keys(new, threshold), _keys(existing, threshold)

    def met(few: DataFrame, many: DataFrame, a: str, b: str) -> DataFrame:
        other = many.select("user_id", "kind", "text", F.col("low").alias("_low"), F.col("n").alias("_n"), F.col("place").alias("_place"))
        edits = (F.col("_n") <= F.col("n")) & (F.col("_n") >= F.col("n") - F.col("k")) & (F.abs(F.col("place") - F.col("_place")) <= F.col("k"))
        near = F.when(F.col("kind") == "e", edits).otherwise(F.col("n") <= F.col("_n"))
        return few.join(other, ["user_id", "kind", "text"]).where(near).select("user_id", F.col("low").alias(a), F.col("_low").alias(b))

    return met(new_few, old_many, "a", "b").unionByName(met(old_few, new_many, "b", "a")).distinct()


def suggest_tags(new: DataFrame, existing: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """user_id, name, suggestion as operators.ledger.suggest_tags: the most similar existing tag of the user, the later
    one of equals; null below the threshold, which must be above 0 and at most 0.9.

    new: user_id, name; existing: user_id, name, pos. Null names are like nothing, an empty one is in every other.
    """
    low = lambda df: df.where("name is not null").select("user_id", F.lower("name").alias("low")).distinct()
    scored = candidates(low(new), low(existing), threshold).withColumn("score", similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
    tags = existing.select("user_id", F.lower("name").alias("b"), F.col("name").alias("tag"), "pos")
    best = scored.join(tags, ["user_id", "b"]).groupBy("user_id", "a").agg(F.max_by("tag", F.struct("score", "pos")).alias("suggestion"))
    return new.select("user_id", "name", F.lower("name").alias("a")).distinct().join(best, ["user_id", "a"], "left").select("user_id", "name", "suggestion")
