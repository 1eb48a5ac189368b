"""Referential integrity of the ledger's tables: all references in one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The references of the ledger's tables (child.column -> parent.id) and what becomes of the child's row when
# its parent goes.
_TEXT = """
lines.user_id users cascade
instruments.user_id users cascade
instruments.line_id lines cascade
tags.user_id users cascade
tags.category_id categories restrict
payees.user_id users cascade
payees.default_category_id categories set-null
payees.default_tag_id tags set-null
ledger_entries.user_id users cascade
ledger_entries.line_id lines restrict
ledger_entries.instrument_id instruments set-null
ledger_entries.payee_id payees set-null
ledger_entries.category_id categories set-null
ledger_entries.tag_id tags set-null
ledger_entries.template_id templates set-null
ledger_entries.reverses_entry_id ledger_entries set-null
settlements.user_id users cascade
settlements.base_entry_id ledger_entries restrict
settlements.settle_entry_id ledger_entries set-null
settlements.personal_debt_id personal_debt set-null
liabilities.user_id users cascade
liabilities.repaid_via_line_id lines restrict
liabilities.origin_entry_id ledger_entries set-null
personal_debt.user_id users cascade
discrepancies.user_id users cascade
discrepancies.line_id lines cascade
denylist_senders.user_id users cascade
"""
#: (child, column, parent, action)
REFERENCES = tuple((*name.split("."), parent, action) for name, parent, action in (line.split() for line in _TEXT.split("\n") if line))


def checkable(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """The references both of whose ends are among the tables."""
    return [r for r in REFERENCES if r[0] in tables and r[2] in tables and r[1] in tables[r[0]].columns]


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """child, column, parent, action, n, example: for each reference that is broken, how many rows name a parent that is
    not there, and the least such name. tables: by the names above, with an id where they are parents.

    Each child is read once, whatever it refers to. Names are counted before they meet their parents, so that one that
    millions of rows share is one row of the join, and all references share that join. Null refers to nothing.
    """
    refs = checkable(tables)
    if not refs:
        raise ValueError("no two tables refer to each other")
    named = []
    for child in dict.fromkeys(r[0] for r in refs):
        own = [F.struct(F.lit(i).alias("ref"), F.lit(r[2]).alias("parent"), F.col(r[1]).cast("string").alias("id")) for i, r in enumerate(refs) if r[0] == child]
        named.append(tables[child].select(F.explode(F.array(*own)).alias("x")).select("x.*").where("id is not null"))
    known = [tables[p].select(F.lit(p).alias("parent"), F.col("id").cast("string").alias("id")) for p in dict.fromkeys(r[2] for r in refs)]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    names = union(named).groupBy("ref", "parent", "id").agg(F.count("*").alias("n"))
    broken = names.join(union(known).distinct(), ["parent", "id"], "left_anti").groupBy("ref").agg(F.sum("n").alias("n"), F.min("id").alias("example"))
    of = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in refs)), F.col("ref") + 1)
    return broken.select(of(0).alias("child"), of(1).alias("column"), of(2).alias("parent"), of(3).alias("action"), "n", "example")
