"""Payees: keys, kinds, category hints, tag similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.rules import Rules, load_rules


def vpa_key(vpa: Column) -> Column:
    return F.lower(F.substring_index(vpa, "@", 1))


def is_phone_vpa(vpa: Column) -> Column:
    return F.coalesce(F.substring_index(vpa, "@", 1).rlike(r"^[0-9]{10}\z"), F.lit(False))


def category_hint(text: Column, rules: Rules | None = None) -> Column:
    """The category of the first listed merchant whose name is in the text, even inside a word; null if none."""
    low = F.lower(text)
    merchants = (rules or load_rules()).merchants
    return reduce(lambda c, m: c.when(low.contains(m[0]), m[1]), merchants[1:], F.when(low.contains(merchants[0][0]), merchants[0][1]))


def counterparty(vpa: Column, merchant: Column, rules: Rules | None = None) -> Column:
    return F.when(category_hint(merchant, rules).isNotNull(), "merchant").when(is_phone_vpa(vpa), "person").otherwise("unknown")


def person_reason(reason: Column) -> Column:
    """Where a payment to a person belongs."""
    return F.when(reason.isin("my_share", "rent"), "expense").when(reason == "lending", "receivable").when(reason == "repaying", "debt_repayment").when(reason == "transfer", "transfer")


def similarity(a: Column, b: Column) -> Column:
    """1 if equal without case, 0.9 if one holds the other, else the better of common prefix and edit distance."""
    a, b = F.lower(a), F.lower(b)
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    prefix = F.when(F.length(short) > 0, F.coalesce(F.array_max(same), F.lit(0)) / F.length(short)).otherwise(F.lit(0.0))
    edit = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(long), F.lit(1))
    return F.when(a == b, F.lit(1.0)).when(long.contains(short), F.lit(0.9)).otherwise(F.greatest(prefix, edit))
