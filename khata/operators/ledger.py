"""The ledger's tables: discovery, upserts, corrections, merges, duplicates, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.ids import uuid5

#: Seconds within which equal entries of a line may be one.
NEAR_SECONDS = 120


def line_key(kind: Column, issuer: Column, detail: Column) -> Column:
    """bank by account tail (? if unknown), credit by pool, wallet and unattributed by issuer alone."""
    return F.when(kind == "bank", F.concat_ws("|", F.lit("bank"), issuer, F.coalesce(detail, F.lit("?")))).when(kind == "credit_pool", F.concat_ws("|", F.lit("credit"), issuer, detail)).when(kind == "wallet", F.concat_ws("|", F.lit("wallet"), issuer)).otherwise(F.concat_ws("|", F.lit("unattributed"), issuer))


def discover_lines(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New lines, one for each (user, key) at its first sighting: id, user_id, key, kind, issuer, display_name,
    balance_is_soft, is_own_node.

    sightings: user_id, kind (bank, credit_pool, wallet, unattributed), issuer, detail, seq. Ids are names' hashes, so
    a rerun finds the same ones. known: lines already there (id).
    """
    keyed = sightings.withColumn("key", line_key(F.col("kind"), F.col("issuer"), F.col("detail")))
    first = keyed.groupBy("user_id", "key").agg(F.min_by(F.struct("kind", "issuer"), "seq").alias("s"))
    new = first.select(
        uuid5(F.concat_ws("|", F.col("user_id").cast("string"), "key")).alias("id"), "user_id", "key", F.when(F.col("s.kind") == "unattributed", "bank").otherwise(F.col("s.kind")).alias("kind"), F.col("s.issuer").alias("issuer"),
        F.when(F.col("s.kind") == "unattributed", F.concat(F.lit("Unattributed at "), F.col("s.issuer"))).alias("display_name"), F.col("s.kind").isin("wallet", "unattributed").alias("balance_is_soft"), F.lit(True).alias("is_own_node"),
    )
    return new if known is None else new.join(known.select("id"), "id", "left_anti")


def discover_instruments(sightings: DataFrame) -> DataFrame:
    """id, user_id, kind, issuer, last4, vpa, holder, line_id: an instrument is its VPA, or its issuer and last digits;
    the first line and holder stay. Unknown digits are one instrument of an issuer, an empty VPA is none."""
    vpa = F.nullif(F.col("vpa"), F.lit(""))
    identity = F.when(vpa.isNotNull(), F.concat_ws("|", F.lit("vpa"), vpa)).otherwise(F.concat_ws("|", F.lit("card"), F.coalesce("issuer", F.lit("")), F.coalesce("last4", F.lit(""))))
    first = sightings.withColumn("identity", identity).groupBy("user_id", "kind", "identity").agg(F.min_by(F.struct("issuer", "last4", vpa.alias("vpa"), "holder", "line_id"), "seq").alias("s"))
    return first.select(uuid5(F.concat_ws("|", F.col("user_id").cast("string"), "kind", "identity")).alias("id"), "user_id", "kind", "s.*")


def upsert(writes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last write of each id; seq is that of the first, which keeps an entry its place in the list."""
    values = [c for c in writes.columns if c not in (key, seq)]
    out = writes.groupBy(key).agg(F.min(seq).alias(seq), F.max_by(F.struct(*values), seq).alias("v"))
    return out.select(key, seq, "v.*")


def patch(writes: DataFrame, fields: tuple[str, ...], key: str = "id", seq: str = "seq") -> DataFrame:
    """Field-wise upsert. A field f is overwritten by the writes whose column set_f is true, also with null."""
    last = [F.max_by(f, F.when(F.col(f"set_{f}"), F.col(seq))).alias(f) for f in fields]
    return writes.groupBy(key).agg(F.min(seq).alias(seq), *last)


def correct(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Entries with corrected effective amounts; captured amounts never change. corrections: id, paise, seq."""
    last = corrections.groupBy("id").agg(F.max_by("paise", "seq").alias("_new"))
    return entries.join(last, "id", "left").withColumn("amount_effective_paise", F.coalesce("_new", "amount_effective_paise")).drop("_new")


def unknown_corrections(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.select("id").distinct().join(entries.select("id"), "id", "left_anti")


def shared_pools(lines: DataFrame) -> DataFrame:
    """a < b: credit pools of one user and issuer that show the same available credit. A suggestion."""
    pools = lines.where("kind = 'credit_pool' and available_credit_paise is not null")
    a, b = pools.alias("a"), pools.alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & F.col("a.issuer").eqNullSafe(F.col("b.issuer")) & (F.col("a.available_credit_paise") == F.col("b.available_credit_paise")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def merge_lines(lines: DataFrame, instruments: DataFrame, entries: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after confirmed merges (keep, gone): what was on a merged line moves, the line goes, and only
    moved instruments become confirmed."""
    m = merges.select(F.col("gone").alias("line_id"), F.col("keep")).distinct()
    moved = lambda df: df.join(m, "line_id", "left")
    to = F.coalesce("keep", "line_id")
    kept = lines.join(merges.select(F.col("gone").alias("id")), "id", "left_anti")
    new_instruments = moved(instruments).withColumn("is_confirmed", F.col("keep").isNotNull() | F.col("is_confirmed")).withColumn("line_id", to).drop("keep")
    return kept, new_instruments, moved(entries).withColumn("line_id", to).drop("keep")


def near_duplicates(entries: DataFrame, seconds: int = NEAR_SECONDS) -> DataFrame:
    """a, b (a first in order): entries of one line, captured amount and merchant at most `seconds` apart.

    Merchants null and empty are equal; entries without a time pair with nothing. The band is cut into buckets of its
    own width, joined with their neighbours, so that a busy key's entries meet only near ones.
    """
    e = entries.where("txn_time is not null").select("id", "line_id", "amount_captured_paise", F.coalesce("merchant_text", F.lit("")).alias("m"), F.unix_micros(F.col("txn_time").cast("timestamp")).alias("us"), "ordinal")
    width = seconds * 1_000_000
    e = e.withColumn("bucket", F.floor(F.col("us") / width))
    a = e.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).alias("a")
    b = e.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("line_id", "amount_captured_paise", "m", "bucket")])
    on = on & (F.col("a.ordinal") < F.col("b.ordinal")) & (F.abs(F.col("a.us") - F.col("b.us")) <= width)
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def suggest_tags(new_tags: DataFrame, existing: DataFrame, threshold: float = 0.6) -> DataFrame:
    """user_id, name, suggestion: the most similar existing tag of the user, the later one of equals; null below the
    threshold. Tags are a user's own few: each new one meets all of them."""
    from khata.functions.payees import similarity

    pairs = new_tags.join(existing.select("user_id", F.col("name").alias("tag"), "pos"), "user_id", "left").withColumn("score", similarity(F.col("name"), F.col("tag")))
    best = F.max_by(F.when(F.col("score") >= threshold, F.col("tag")), F.when(F.col("score") >= threshold, F.struct("score", "pos")))
    return pairs.groupBy("user_id", "name").agg(best.alias("suggestion"))


def retag(entries: DataFrame, deleted: DataFrame) -> DataFrame:
    """Entries after tags are deleted (tag_id, to): each takes the replacement, or none."""
    d = deleted.select("tag_id", F.col("to"), F.lit(True).alias("_gone"))
    return entries.join(d, "tag_id", "left").withColumn("tag_id", F.when(F.col("_gone"), F.col("to")).otherwise(F.col("tag_id"))).drop("to", "_gone")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference is not null and not there: what a foreign key would have refused."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def with_reversed(entries: DataFrame) -> DataFrame:
    """Entries with the amount of the entry that they reverse, if any."""
    r = entries.select(F.col("id").alias("reverses_entry_id"), F.col("amount_effective_paise").alias("reversed_paise"))
    return entries.join(r, "reverses_entry_id", "left")


def unlabelled_payees(entries: DataFrame, most: int = 20) -> DataFrame:
    """The payees with the most entries that have no label: a report of `most` rows."""
    return entries.where("category_id is null and tag_id is null and payee_id is not null").groupBy("payee_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "payee_id").limit(most)


def first_of(rows: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
