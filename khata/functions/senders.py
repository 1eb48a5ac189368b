"""Senders: personal numbers and registered headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.rules import Rules, load_rules
from khata.functions.text import SPACES, literal, trimmed


def is_personal(sender: Column) -> Column:
    """Ten digits are left without white space, hyphens and a country code. A number that itself begins with 91 loses
    those digits and is not personal."""
    return F.translate(F.coalesce(sender, F.lit("")), f"{SPACES}-", "").rlike(r"^(?:\+?91|(?!\+?91))\+?[0-9]{10}\z")


def normalise_sender(sender: Column, rules: Rules | None = None) -> Column:
    """struct(kind, entity): the registered entity without operator prefix and category suffix; null for a person."""
    rules = rules or load_rules()
    raw = trimmed(F.coalesce(sender, F.lit("")))
    # One hyphen between parts and none at the ends; then a part before a hyphen goes, and one behind a hyphen.
    parts = F.regexp_replace(F.upper(raw), "^-+|-+\\z|(?<=-)-+", "")
    prefixes, suffixes = (["[A-Z]{2}", *map(literal, rules.operator_prefixes)], list(map(literal, rules.category_suffixes)))
    named = F.regexp_replace(parts, "|".join([f"^(?:{'|'.join(prefixes)})-", *([f"-(?:{'|'.join(suffixes)})\\z"] if suffixes else [])]), "")
    person = is_personal(raw)
    return F.struct(F.when(person, "personal").otherwise("dlt").alias("kind"), F.when((named != "") & ~person, named).alias("entity"))
