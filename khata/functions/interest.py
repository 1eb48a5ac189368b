"""Daily interest: learned rate, expectation, verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the expectation within which a credit is absorbed.
TOLERANCE = 0.5


def learn_rate(credit: Column, balance: Column) -> Column:
    return F.when(balance <= 0, F.lit(0.0)).otherwise(credit.cast("double") / balance.cast("double"))


def expected_interest(balance: Column, rate: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(balance.cast("double") * rate + 0.5).cast("bigint")


def verdict(balance_before: Column, credit: Column, confirmed: Column, rate: Column) -> Column:
    """ask while unconfirmed; absorb a credit near the expectation; flag any other."""
    expected = expected_interest(balance_before, rate)
    off = F.abs(credit - expected).cast("double") / expected
    return F.when(~F.coalesce(confirmed, F.lit(False)), "ask").when(F.coalesce(expected, F.lit(0)) <= 0, "flag").when(off <= TOLERANCE, "absorb").otherwise("flag")
