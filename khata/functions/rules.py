"""Rule data of the message functions: word lists and lookups, overridable as a JSON file."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, fields, replace

# The rule lists.
_VERBS = ("debited", "credited", "spent", "withdrawn", "transferred", "transfer", "paid", "received", "sent", "purchase", "deducted", "debit", "credit", "added", "loaded", "load")
_FAILED = ("declined", "could not", "unsuccessful", "reversed")
_FUTURE = ("will be debited", "scheduled", "due on", "autopay", "e-mandate", "standing instruction", "emi due")
_CONDITIONAL = ("has requested", "requesting", "collect request", "payment request")
_HOLD = ("blocked", "on hold", "hold of", "pre-auth", "authorization")
_MANDATE = ("mandate created", "mandate registered", "autopay set up")
_REFUND = ("refund", "refunded", "reversal of", "credited back", "returned")
_OPERATOR_PREFIXES = ("VM", "VX", "IX", "JD", "AX", "BP", "CP", "JM", "TX", "AD", "TD", "BZ", "BT")
_CATEGORY_SUFFIXES = ("S", "T", "P", "G")
_OWN_NODES = ("PAYTM", "AMZNPE", "AMAZONPAY", "PHONEPE", "MOBIKWIK", "FREECHARGE", "SLICE", "JUPITER", "FI", "OLAMONEY", "AIRTELMONEY", "JIOMONEY", "AMAZONPAYLATER", "LAZYPAY", "SIMPL")
_MERCHANTS = (
    ("zomato", "Food"),
    ("swiggy", "Food"),
    ("dominos", "Food"),
    ("mcdonalds", "Food"),
    ("blinkit", "Food"),
    ("zepto", "Food"),
    ("bigbasket", "Food"),
    ("uber", "Travel"),
    ("ola", "Travel"),
    ("rapido", "Travel"),
    ("irctc", "Travel"),
    ("makemytrip", "Travel"),
    ("redbus", "Travel"),
    ("amazon", "Shopping"),
    ("flipkart", "Shopping"),
    ("myntra", "Shopping"),
    ("ajio", "Shopping"),
    ("nykaa", "Shopping"),
    ("netflix", "Entertainment"),
    ("hotstar", "Entertainment"),
    ("spotify", "Entertainment"),
    ("bookmyshow", "Entertainment"),
    ("pharmeasy", "Healthcare"),
    ("1mg", "Healthcare"),
    ("apollo", "Healthcare"),
    ("groww", "Investments"),
    ("zerodha", "Investments"),
    ("upstox", "Investments"),
)
_CATEGORIES = ("Food", "Travel", "Shopping", "Entertainment", "Healthcare", "Investments")


@dataclass(frozen=True)
class Rules:
    transaction_verbs: tuple[str, ...] = _VERBS
    failed: tuple[str, ...] = _FAILED
    future: tuple[str, ...] = _FUTURE
    conditional: tuple[str, ...] = _CONDITIONAL
    hold: tuple[str, ...] = _HOLD
    mandate: tuple[str, ...] = _MANDATE
    refund: tuple[str, ...] = _REFUND
    operator_prefixes: tuple[str, ...] = _OPERATOR_PREFIXES
    category_suffixes: tuple[str, ...] = _CATEGORY_SUFFIXES
    own_nodes: tuple[str, ...] = _OWN_NODES
    merchants: tuple[tuple[str, str], ...] = _MERCHANTS
    categories: tuple[str, ...] = _CATEGORIES


@functools.cache
def load_rules(path: str | None = None) -> Rules:
    """The built-in rules, or those with the lists of a JSON object laid over them; read once per path."""
    rules = Rules()
    if path is None:
        return rules
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    unknown = set(given) - {f.name for f in fields(Rules)}
    if unknown:
        raise ValueError(f"unknown rule lists: {sorted(unknown)}")
    return replace(rules, **{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in given.items()})
