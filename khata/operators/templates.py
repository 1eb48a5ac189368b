"""Templates: message shapes learned once per cluster and applied as column patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.amounts import with_paise
from khata.functions.masking import MONTHS, SLOTS, leak, mask
from khata.functions.text import WS, literal, trimmed
from khata.sources.space import written

TRUST_RUNS = 5
_SLOT = re.compile(f"§({'|'.join(SLOTS)})§")
# What stands for a slot in a pattern, and the characters before an amount in which "bal" makes it a balance.
_FAMILY = {
    "AMT": rf"(?:rs\.?|inr|₹|rupees)?{WS}*[0-9][0-9,]*(?:\.[0-9]+)?{WS}*(?:k|lakhs?|lac|l|crores?|cr)?(?:{WS}*\/-)?",
    "DATE": rf"[0-9]{{1,2}}[-/ ](?:[0-9]{{1,2}}|{MONTHS})[-/ ]?[0-9]{{0,4}}",
    "ACCT": rf"(?:card{WS}+)?(?:x{{2,}}|\*{{2,}}|a\/c{WS}*[*.]*{WS}*|ending{WS}+|account{WS}+)?{WS}*[0-9]{{2,6}}",
    "NUM": "[0-9]{3,}",
    "VPA": r"[A-Za-z0-9_.-]+@[a-z]+",
    "MERCHANT": r"[^\n\r]+?",
}
_LOOK_BACK = 16
_PLAIN_ROLES = {"DATE": "date", "ACCT": "account_tail", "NUM": "ref", "MERCHANT": "merchant"}
#: What a template reads, in this order, each behind a mark that no body begins with.
READ, _MARK = ("amount", "balance", "merchant"), "\x01"


class Author(Protocol):
    """Names the roles of a skeleton's slots; asked once per cluster, and shown nothing but the redacted skeleton.

    It is sent to the executors, so it must be picklable."""

    def roles(self, skeleton: str) -> list[str]: ...


class PositionAuthor:
    """Roles by place: an amount soon after "bal" is the balance, the first other one the amount, further ones balances."""

    def roles(self, skeleton: str) -> list[str]:
        slots = list(_SLOT.finditer(skeleton))
        plain = [m.start() for m in slots if m[1] == "AMT" and "bal" not in skeleton[max(0, m.start() - _LOOK_BACK) : m.start()]]
        return [("amount" if m.start() in plain[:1] else "balance") if m[1] == "AMT" else _PLAIN_ROLES.get(m[1], "none") for m in slots]


def template_pattern(skeleton: str, roles: list[str]) -> tuple[str, dict[str, int]]:
    """(pattern, group of each role): literals as they stand, white space as any run of it, slots as their families.

    Groups are numbered; of a role that occurs twice the first group counts. Slots beyond the roles have none."""
    texts, families = _SLOT.split(skeleton)[0::2], _SLOT.split(skeleton)[1::2]
    named = [role for role, _ in zip(chain(roles, repeat("none")), families)]
    fixed = [f"{WS}+".join(map(literal, re.split(r"\s+", t))) for t in texts]
    slots = [f"({'?:' if role == 'none' else ''}{_FAMILY[family]})" for role, family in zip(named, families)]
    captured = [role for role in named if role != "none"]
    return "(?i)^" + "".join(chain.from_iterable(zip(fixed, [*slots, r"\z"]))), {role: captured.index(role) + 1 for role in captured}


def shape(messages: DataFrame) -> DataFrame:
    """messages (body, ...) with skeleton and fingerprint, unless they have them: two steps, so that one masking serves both."""
    if "fingerprint" in messages.columns and "skeleton" in messages.columns:
        return messages
    return messages.withColumn("skeleton", mask(F.col("body"))).withColumn("fingerprint", F.sha2(F.encode("skeleton", "UTF-8"), 256))


def clusters(messages: DataFrame) -> DataFrame:
    """issuer, fingerprint, skeleton, representative, n: messages (issuer, body, seq) by shape; the first one stands
    for it. issuer '' is none. A skeleton that leaks fails the query."""
    shaped = shape(messages).withColumn("issuer", F.coalesce("issuer", F.lit("")))
    out = shaped.groupBy("issuer", "fingerprint").agg(F.min("skeleton").alias("skeleton"), F.min_by("body", "seq").alias("representative"), F.count("*").alias("n"))
    leaks = leak(F.col("skeleton"))
    return out.withColumn("skeleton", F.when(leaks.isNull(), F.col("skeleton")).otherwise(F.raise_error(F.concat(F.lit("skeleton leaks: "), leaks))))


def write_patterns(found: DataFrame, author: Author | None = None) -> DataFrame:
    """found (skeleton, ...) with pattern, groups, reading: the author is asked where the clusters are, row by row of
    one batch; nothing passes the driver. reading is the replacement that leaves what a template reads."""
    author = author or PositionAuthor()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            written = [template_pattern(s, author.roles(s)) for s in frame["skeleton"]]
            reading = ["".join(_MARK + (f"${groups[r]}" if r in groups else "") for r in READ) for _, groups in written]
            yield frame.assign(pattern=[p for p, _ in written], groups=[g for _, g in written], reading=reading)

    types = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return found.mapInPandas(run, f"{types}, pattern string, groups map<string,int>, reading string")


def induce(messages: DataFrame, author: Author | None = None, runs: int = TRUST_RUNS) -> DataFrame:
    """issuer, fingerprint, pattern, groups, reading, trust_state, validation_runs: one template for each cluster.

    A template that does not read an amount from every body of its cluster, or whose amounts differ from an independent
    parse in any of `runs` round-robin checks, is flagged; else it is trusted. Where messages carry skeleton and
    fingerprint (see shape), they are not masked again.
    """
    key = ["issuer", "fingerprint"]
    columns = [c for c in ("body", "seq", "skeleton", "fingerprint") if c in messages.columns]
    shaped = shape(messages.select(F.coalesce("issuer", F.lit("")).alias("issuer"), *columns))
    # Written, so that the author is asked once a cluster and not once a use of what it says.
    templates = written(write_patterns(clusters(shaped).drop("representative", "n"), author).drop("skeleton"))
    read = apply_templates(shaped, templates).select(*key, F.col("amount_paise").isNotNull().alias("ok"))
    every = read.groupBy(*key).agg(F.bool_and("ok").alias("round_trip"))
    # The first bodies of a cluster are the ones that the round-robin checks read; each is read again by later runs.
    heads = shaped.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("seq", "body"))).where(F.col("k") <= runs)
    heads = with_paise(apply_templates(heads, templates), own=F.col("body"))
    checked = heads.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.col("amount_paise") == F.col("own"), F.lit(False)).alias("agree"))))["agree"].alias("agree"))
    agreed = F.size(F.filter(F.sequence(F.lit(0), F.lit(runs - 1)), lambda i: F.element_at("agree", (i % F.size("agree") + 1).cast("int"))))
    done = every.join(checked, key).withColumn("validation_runs", F.when(F.col("round_trip"), agreed).otherwise(0))
    state = F.when(F.col("validation_runs") >= runs, "trusted").otherwise("flagged")
    return templates.join(done, key).select(*key, "pattern", "groups", "reading", state.alias("trust_state"), "validation_runs")


def apply_templates(messages: DataFrame, templates: DataFrame, trusted_only: bool = False) -> DataFrame:
    """messages (issuer, body, maybe skeleton and fingerprint, ...) with amount_paise, balance_paise, merchant, template_found.

    Templates are found by issuer and fingerprint; no match leaves nulls. Within a partition messages are read in the
    order of their fingerprints, so that a pattern is compiled once for all that share it, and by one replacement that
    leaves all its roles.
    """
    known = templates.where("trust_state = 'trusted'") if trusted_only else templates
    known = known.select(F.col("issuer").alias("_issuer"), F.col("fingerprint").alias("_fp"), F.col("pattern").alias("_pattern"), F.col("reading").alias("_reading"))
    shaped = shape(messages)
    joined = shaped.join(known, (F.coalesce("issuer", F.lit("")) == F.col("_issuer")) & (F.col("fingerprint") == F.col("_fp")), "left")
    joined = joined.withColumn("_body", trimmed(F.col("body"))).sortWithinPartitions("_fp", "_issuer")
    joined = joined.withColumn("_read", F.regexp_replace(F.col("_body"), F.col("_pattern"), F.col("_reading")))
    joined = joined.withColumn("_roles", F.when(F.startswith("_read", F.lit(_MARK)) & ~F.startswith("_body", F.lit(_MARK)), F.split("_read", _MARK, len(READ) + 1)))
    role = {r: F.nullif(F.col("_roles")[i + 1], F.lit("")) for i, r in enumerate(READ)}
    read = with_paise(joined, amount_paise=role["amount"], balance_paise=role["balance"])
    read = read.withColumns({"merchant": F.nullif(trimmed(role["merchant"]), F.lit("")), "template_found": F.col("_pattern").isNotNull()})
    return read.drop("_issuer", "_fp", "_pattern", "_reading", "_body", "_read", "_roles")
