"""Declared schemas of the ledger's tables; money is BIGINT paise in compute, DECIMAL(14,2) rupees at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions.amounts import paise_to_rupees, rupees_to_paise

DDL = {
    "messages": "msg_id string, user_id bigint, sender string, body string, received_at timestamp, seq bigint",
    "sms_parts": "ref_id string, part_index int, total_parts int, text string, ordinal bigint",
    "lines": "id string, user_id string, kind string, issuer string, display_name string, current_balance_paise bigint, credit_limit_paise bigint, available_credit_paise bigint, is_own_node boolean, balance_is_soft boolean, accrues_daily_interest boolean, interest_rate_daily double, anchor_balance_paise bigint",
    "instruments": "id string, user_id string, line_id string, kind string, issuer string, last4 string, vpa string, holder string, display_name string, is_confirmed boolean",
    "categories": "id int, name string",
    "tags": "id string, user_id string, name string, category_id int",
    "payees": "id string, user_id string, normalized_key string, raw_vpas array<string>, display_name string, default_category_id int, default_tag_id string, counterparty_type string, is_user_confirmed boolean",
    "ledger_entries": "id string, user_id string, line_id string, instrument_id string, payee_id string, message_id string, direction string, modality string, amount_captured_paise bigint, amount_effective_paise bigint, balance_after_paise bigint, category_id int, tag_id string, merchant_text string, txn_time timestamp, received_at timestamp, source string, net_status string, reverses_entry_id string, is_counted boolean, template_id string, ordinal bigint",
    "settlements": "id string, user_id string, base_entry_id string, settle_entry_id string, kind string, expected_amount_paise bigint, settled_amount_paise bigint, status string, expected_at timestamp, personal_debt_id string, note string",
    "liabilities": "id string, user_id string, line_id string, installment_paise bigint, tenure_months int",
    "personal_debt": "id string, user_id string, principal_paise bigint, status string",
    "discrepancies": "line_id string, entry_id string, type string, gap_paise bigint, status string",
    "templates": "issuer string, fingerprint string, pattern string, groups map<string,int>, trust_state string, validation_runs int",
    "denylist_senders": "user_id string, entity string",
}

#: The system's categories, in order of id.
CATEGORIES = "Food,Shopping,Rent,Utilities,Travel,Healthcare,Entertainment,Investments,Education,Loans,Insurance,Miscellaneous".split(",")

ACCEPTED = {
    "direction": ("EXPENSE", "INCOME", "TRANSFER", "TOPUP"),
    "modality": ("actual", "future", "conditional", "failed", "hold", "mandate"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def money_columns(table: str) -> list[str]:
    return [f.name for f in schema(table) if f.name.endswith("_paise")]


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table at rest, with rupees turned into paise."""
    at_rest = T.StructType([T.StructField(f.name.removesuffix("_paise"), T.DecimalType(14, 2)) if f.name.endswith("_paise") else f for f in schema(table)])
    df = spark.read.schema(at_rest).parquet(path)
    return df.select(*(rupees_to_paise(F.col(f.name.removesuffix("_paise"))).alias(f.name) if f.name.endswith("_paise") else F.col(f.name) for f in schema(table)))


def write(df: DataFrame, path: str, table: str, mode: str = "errorifexists", month_of: str | None = None) -> None:
    """A table to rest as Parquet, paise as rupees; partitioned by the month of a timestamp column where given."""
    out = df.select(*(paise_to_rupees(F.col(f.name)).alias(f.name.removesuffix("_paise")) if f.name.endswith("_paise") else F.col(f.name).cast(f.dataType) for f in schema(table)))
    if month_of is None:
        out.write.mode(mode).parquet(path)
    else:
        out.withColumn("month", F.date_format(month_of, "yyyy-MM")).write.mode(mode).partitionBy("month").parquet(path)


def unaccepted(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not one of the column's."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*ACCEPTED[column]))


def categories(spark: SparkSession, more: list[str] = ()) -> DataFrame:
    """The seeded categories, each name once however often it is seeded."""
    rows = [(i + 1, n) for i, n in enumerate(dict.fromkeys([*CATEGORIES, *more]))]
    return spark.createDataFrame(rows, schema("categories"))
