"""Deterministic ids: references in messages, name-based UUIDs, logical entry ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.text import WS, found

#: Fixed value: the namespace of entry ids.
NAMESPACE = "b9f8a4e2-1c3d-4f5a-9b6e-7d8c9a0b1c2d"
#: Seconds in which equal entries without a reference are one.
BUCKET_SECONDS = 10


def reference_pattern() -> str:
    # Fixed value: the keywords before a reference.
    keyword = rf"(?:upi(?:{WS}*ref(?:erence)?(?:{WS}*no\.?)?)?|ref(?:erence)?(?:{WS}*(?:no|id|num)\.?)?|rrn|utr|txn{WS}*id|transaction{WS}*id)"
    return rf"(?i){keyword}(?:[:#.-]|{WS})*((?=[a-z0-9]*[0-9])[a-z0-9]{{6,}})"


def extract_reference(body: Column) -> Column:
    """The bank's own reference, in upper case: at least six letters and digits, a digit among them, after its keyword."""
    return F.upper(found(body, reference_pattern(), 1))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def entry_id(user: Column, line_key: Column, direction: Column, paise: Column, epoch_seconds: Column, reference: Column) -> Column:
    """Of a reference, user and line alone; else of direction, amount and an aligned bucket of seconds too."""
    named = F.concat_ws("|", user, line_key, F.concat(F.lit("ref:"), reference))
    bucket = F.floor(epoch_seconds / BUCKET_SECONDS).cast("bigint").cast("string")
    timed = F.concat_ws("|", user, line_key, direction, paise.cast("string"), bucket)
    return uuid5(F.when(F.coalesce(reference, F.lit("")) != "", named).otherwise(timed))
