"""Headlines and breakdowns of counted entries, net of what settlements gave back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.amounts import sum_paise

NO_CATEGORY = -1
NO_TAG = "__untagged__"
REALISED = ("settled", "partial")


def counted_bases(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    """Counted entries that are no reversal and no settlement's second leg, whatever that settlement's status.

    Legs without an id are left out before the anti join, so that they exclude nothing.
    """
    bases = entries.where("is_counted and coalesce(net_status, 'active') <> 'is_reversal'")
    if settlements is None:
        return bases
    legs = settlements.where("settle_entry_id is not null").select(F.col("settle_entry_id").alias("id")).distinct()
    return bases.join(legs, "id", "left_anti")


def realised(settlements: DataFrame) -> DataFrame:
    """base_entry_id, realised_paise: what settled and partial settlements returned, aggregated before any join."""
    return settlements.where(F.col("status").isin(*REALISED)).groupBy("base_entry_id").agg(sum_paise(F.coalesce("settled_amount_paise", F.lit(0))).alias("realised_paise"))


def contributions(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    """Counted bases with contribution_paise = effective amount less realised; it may fall below 0."""
    bases = counted_bases(entries, settlements)
    if settlements is None:
        return bases.withColumn("contribution_paise", F.col("amount_effective_paise"))
    back = realised(settlements).withColumnRenamed("base_entry_id", "id")
    return bases.join(back, "id", "left").withColumn("contribution_paise", F.col("amount_effective_paise") - F.coalesce("realised_paise", F.lit(0))).drop("realised_paise")


def headline(entries: DataFrame, settlements: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., income_paise, expense_paise, savings_paise; one row of zeros for no entries where by is empty."""
    rows = contributions(entries, settlements)
    of = lambda d: sum_paise(F.when(F.col("direction") == d, F.col("contribution_paise")))
    out = rows.groupBy(*by).agg(of("INCOME").alias("income_paise"), of("EXPENSE").alias("expense_paise"))
    return out.withColumn("savings_paise", F.col("income_paise") - F.col("expense_paise"))


def _breakdown(entries: DataFrame, settlements: DataFrame | None, key: Column, name: str) -> DataFrame:
    rows = contributions(entries, settlements).where("direction = 'EXPENSE'")
    return rows.groupBy(key.alias(name)).agg(sum_paise(F.col("contribution_paise")).alias("amount_paise"))


def by_category(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    return _breakdown(entries, settlements, F.coalesce("category_id", F.lit(NO_CATEGORY)), "category_id")


def by_tag(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    return _breakdown(entries, settlements, F.coalesce("tag_id", F.lit(NO_TAG)), "tag_id")


def by_line(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    return _breakdown(entries, settlements, F.col("line_id"), "line_id")


def breakdowns(entries: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    """kind (category, tag, line, total), key, amount_paise: all breakdowns in one pass over the bases, so that they
    add up to one total by construction."""
    rows = contributions(entries, settlements).where("direction = 'EXPENSE'")
    keyed = rows.select(F.coalesce(F.col("category_id"), F.lit(NO_CATEGORY)).cast("string").alias("category"), F.coalesce("tag_id", F.lit(NO_TAG)).alias("tag"), F.col("line_id").cast("string").alias("line"), "contribution_paise")
    sets = keyed.groupingSets([["category"], ["tag"], ["line"], []], "category", "tag", "line").agg(F.grouping_id().alias("g"), sum_paise(F.col("contribution_paise")).alias("amount_paise"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "tag").when(F.col("g") == 6, "line").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("category", "tag", "line").alias("key"), "amount_paise")


def sum_of(breakdown: DataFrame) -> DataFrame:
    return breakdown.agg(sum_paise(F.col("amount_paise")).alias("amount_paise"))


def resolve_labels(entries: DataFrame, payees: DataFrame) -> DataFrame:
    """effective_category_id and effective_tag_id: the entry's own label, else its payee's default, else null."""
    known = payees.select(F.col("id").alias("payee_id"), "default_category_id", "default_tag_id")
    out = entries.join(known, "payee_id", "left")
    return out.withColumns({"effective_category_id": F.coalesce("category_id", "default_category_id"), "effective_tag_id": F.coalesce("tag_id", "default_tag_id")}).drop("default_category_id", "default_tag_id")


def in_period(entries: DataFrame, start: Column | None = None, end: Column | None = None, **equal) -> DataFrame:
    """The ledger view: from start to before end, with given columns equal; chronological."""
    out = entries
    if start is not None:
        out = out.where(F.col("txn_time") >= start)
    if end is not None:
        out = out.where(F.col("txn_time") < end)
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out.orderBy("txn_time", "ordinal")
