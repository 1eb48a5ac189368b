"""Structural masks and fingerprints: what stays of a message when its values become slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.text import AFTER, ANY, WS, W, found, let, trimmed

# Slots, stop words and rewrites decide the fingerprints.
SLOTS = ("AMT", "DATE", "ACCT", "NUM", "VPA", "MERCHANT")
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MULTIPLIER = "(?:k|lakhs?|lac|l|crores?|cr)"
_STOPS = r"via|on|from|using|thru|through|ref|avl|bal|upi|info|txn|dated|at|to|for|towards|a\/c|acct"

# What cannot end a merchant's name, so that only its ends are looked behind.
_INSIDE = rf"[^§.,{WS}]"
# A character that begins a word, before what stands around it is looked at: most places fail at the character.
_FIRST = lambda c: f"{c}(?<!{W}{c})"
_DIGIT = _FIRST("[0-9]")

#: (pattern, replacement) in order; the text is in lower case and trimmed.
REWRITES = (
    (rf"(?:r(?:s\.?|upees)|inr|₹){WS}*[0-9][0-9,]*(?:\.[0-9]+)?{WS}*{_MULTIPLIER}?(?:{WS}*\/-)?", "§AMT§"),
    (rf"{_DIGIT}[0-9,]*(?:\.[0-9]+)?{WS}*{_MULTIPLIER}{AFTER}", "§AMT§"),
    (rf"{_DIGIT}[0-9]?[-/ ](?:[0-9]{{1,2}}|{MONTHS})[-/ ]?[0-9]{{2,4}}{AFTER}", "§DATE§"),
    (rf"(?:{_FIRST('x')}x+|{_FIRST('a')}(?:\/c{WS}*[*.]*{WS}*|cct\.?{WS}*|ccount{WS}+)|{_FIRST('e')}nding{WS}+|{_FIRST('c')}ard{WS}+x*|\*(?<={W}\*)\*+){WS}*[0-9]{{2,6}}{AFTER}", "§ACCT§"),
    (rf"(?:{_FIRST(W)}|[.-](?<={W}[.-]))[A-Za-z0-9_.-]*+@[a-z]+{AFTER}", "§VPA§"),
    (rf"({_FIRST('a')}t|{_FIRST('t')}o(?:wards)?|{_FIRST('f')}or){WS}+({ANY}{_INSIDE}*+(?:{ANY}{_INSIDE}*+)*?)(?={WS}+(?:{_STOPS}){AFTER}|{WS}*§|[.,]|\z)", "$1 §MERCHANT§"),
    (r"[0-9]{3,}", "§NUM§"),
    (rf"{WS}+", " "),
)


def mask(body: Column) -> Column:
    """The skeleton of a message: every amount, date, account tail, VPA, merchant and long number a slot."""
    start = trimmed(F.lower(F.coalesce(body, F.lit(""))))
    return trimmed(reduce(lambda c, step: F.regexp_replace(c, *step), REWRITES, start))


def fingerprint(body: Column) -> Column:
    """SHA-256 of the skeleton: messages of one shape share it."""
    return F.sha2(F.encode(mask(body), "UTF-8"), 256)


def leak(skeleton: Column) -> Column:
    """What a skeleton still gives away: a currency marker before a digit, or three digits in a row; null if nothing."""
    return F.coalesce(found(skeleton, rf"(?i)(?:rs\.?|inr|₹|rupees){WS}*[0-9]"), found(skeleton, r"[0-9]{3,}"))


def redact(body: Column, strict: bool = True) -> Column:
    """The skeleton; strict: the query fails on a row whose skeleton leaks."""
    if not strict:
        return mask(body)
    sound = lambda s: let(leak(s), lambda x: F.when(x.isNotNull(), F.raise_error(F.concat(F.lit("skeleton leaks: "), x))).otherwise(s))
    return let(mask(body), sound)
