"""The message functions for SQL: CREATE TEMPORARY FUNCTION ... RETURN, which Catalyst inlines into the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from khata.functions import amounts, ids
from khata.functions.masking import REWRITES
from khata.functions.text import WS


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


def _replaced(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_raw(pattern)}, {_raw(by)})"


def _trimmed(text: str) -> str:
    return _replaced(_replaced(text, f"^{WS}+"), rf"{WS}+\z")


def _found(text: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({text}, {_raw(pattern)}, {group}), '')"


_LED = amounts._led(False)
_TIMES = "CASE WHEN coalesce(word, '') = '' THEN 100 WHEN lower(word) = 'k' THEN 100000 WHEN lower(word) LIKE 'l%' THEN 10000000 WHEN lower(word) LIKE 'c%' THEN 1000000000 END"
_REF = ids.reference_pattern()

#: name(parameters) -> (type, body), each after those that it uses.
FUNCTIONS = {
    "mask_body(body STRING)": ("STRING", _trimmed(reduce(lambda t, step: _replaced(t, *step), REWRITES, _trimmed("lower(coalesce(body, ''))")))),
    "fingerprint(body STRING)": ("STRING", "sha2(encode(mask_body(body), 'UTF-8'), 256)"),
    "amount_led(body STRING)": ("STRING", _found("body", _LED)),
    "amount_bare(body STRING)": ("STRING", _found("body", amounts._BARE)),
    "amount_core(led STRING, bare STRING)": ("STRING", f"coalesce({_found('led', _LED, 1)}, {_found('bare', amounts._BARE, 1)})"),
    "amount_word(led STRING, bare STRING)": ("STRING", f"coalesce({_found('led', _LED, 2)}, CASE WHEN led IS NULL THEN {_found('bare', amounts._BARE, 2)} END)"),
    "amount_scaled(core STRING, word STRING)": ("BIGINT", rf"CASE WHEN core RLIKE r'^[0-9][0-9,]*(?:\.[0-9]+)?\z' THEN try_cast(round(try_cast(replace(core, ',', '') AS DECIMAL(24,8)) * CAST({_TIMES} AS DECIMAL(12,0)), 0) AS BIGINT) END"),
    "amount_unglued(core STRING, word STRING)": ("BIGINT", f"CASE WHEN word IS NULL AND core RLIKE {_raw(amounts._GLUED)} THEN amount_scaled(regexp_extract(core, {_raw(amounts._GLUED)}, 1), regexp_extract(core, {_raw(amounts._GLUED)}, 2)) ELSE amount_scaled(core, word) END"),
    "amount_parsed(led STRING, bare STRING)": ("BIGINT", "amount_unglued(amount_core(led, bare), amount_word(led, bare))"),
    "parse_amount(body STRING)": ("BIGINT", "amount_parsed(amount_led(body), amount_bare(body))"),
    "extract_reference(body STRING)": ("STRING", f"upper({_found('body', _REF, 1)})"),
    "uuid_of_sha1(h STRING)": ("STRING", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', CAST(conv(substr(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12))"),
    "uuid5(name STRING)": ("STRING", f"uuid_of_sha1(sha1(concat(unhex('{ids.NAMESPACE.replace('-', '')}'), encode(name, 'UTF-8'))))"),
    "entry_id(user STRING, line_key STRING, direction STRING, paise BIGINT, epoch_seconds BIGINT, reference STRING)": (
        "STRING",
        f"uuid5(CASE WHEN coalesce(reference, '') <> '' THEN concat_ws('|', user, line_key, concat('ref:', reference)) ELSE concat_ws('|', user, line_key, direction, CAST(paise AS STRING), CAST(floor(epoch_seconds / {ids.BUCKET_SECONDS}) AS STRING)) END)",
    ),
}


def register(spark: SparkSession) -> None:
    """Defines mask_body, fingerprint, parse_amount (paise), extract_reference, uuid5, entry_id and their parts for the session."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
