"""Dates in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.masking import MONTHS
from khata.functions.text import WS, found, trimmed


def parse_sms_date(raw: Column, received_at: Column) -> Column:
    """struct(date, confidence). Day first; a missing year is the receipt's; days beyond a month's end roll on."""
    s = F.lower(trimmed(raw))
    numeric = r"^([0-9]{1,2})[-/]([0-9]{1,2})(?:[-/]([0-9]{2,4}))?\z"
    named = rf"^([0-9]{{1,2}})(?:{WS}|-)([a-z]{{3,}})(?:{WS}|-)([0-9]{{2,4}})\z"
    is_numeric = s.rlike(numeric)
    day = F.coalesce(found(s, numeric, 1), found(s, named, 1)).cast("int")
    by_name = F.floor((F.instr(F.lit("|" + MONTHS), F.concat(F.lit("|"), F.substr(found(s, named, 2), F.lit(1), F.lit(3)))) + 3) / 4).cast("int")
    month = F.when(is_numeric, found(s, numeric, 2).cast("int")).otherwise(F.nullif(by_name, F.lit(0)))
    year = F.coalesce(F.when(is_numeric, found(s, numeric, 3)).otherwise(found(s, named, 3)).cast("int"), F.year(received_at))
    year = F.when(year < 100, year + 2000).otherwise(year)
    valid = (~is_numeric | ((day <= 31) & (month <= 12))) & month.isNotNull()
    date = F.when(valid, F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1))
    return F.struct(date.alias("date"), F.when(date.isNotNull(), "high").otherwise("low").alias("confidence"))
