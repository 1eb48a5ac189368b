"""Money in messages: parsing, extraction, formatting. Paise are BIGINT throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import AFTER, BEFORE, WS, found, let

# The grammar of amounts.
CURRENCY = r"(?:rs\.?|inr|₹)"
MULTIPLIER = "(k|lakhs?|lac|l|crores?|cr)"
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"


def scale_to_paise(core: Column, multiplier: Column) -> Column:
    """A clean number, commas as grouping, times its multiplier word and 100, half up. Null where it is no number."""
    m = F.lower(F.coalesce(multiplier, F.lit("")))
    times = F.when(m == "", 100).when(m == "k", 100_000).when(m.startswith("l"), 10_000_000).when(m.startswith("c"), 1_000_000_000)
    value = F.regexp_replace(core, ",", "").try_cast("decimal(24,8)") * times.cast("decimal(12,0)")
    return F.round(value, 0).try_cast("bigint")


def _led(strict_boundary: bool) -> str:
    return f"(?i){CURRENCY}{WS}*([0-9a-z.,]+)(?:{WS}+{MULTIPLIER}{AFTER if strict_boundary else ''})?"


_BARE = f"(?i){BEFORE}{NUMBER}{WS}*{MULTIPLIER}{AFTER}"
_GLUED = r"(?i)^([0-9.,]+)(k|lakhs|lakh|lac|l|crores|crore|cr)\z"


def _matched(body: Column, led: str) -> tuple[Column, Column]:
    """The first amount with a currency marker, and the first bare one."""
    return found(body, led), found(body, _BARE)


def _parts(led: Column, bare: Column, pattern: str) -> tuple[Column, Column]:
    """(what stands for the number, its multiplier) of the match that counts."""
    return F.coalesce(found(led, pattern, 1), found(bare, _BARE, 1)), F.coalesce(found(led, pattern, 2), F.when(led.isNull(), found(bare, _BARE, 2)))


def _unglued(core: Column, word: Column) -> tuple[Column, Column]:
    """The same, with a multiplier that is glued to the number taken off it."""
    glued = word.isNull() & core.rlike(_GLUED)
    return F.when(glued, F.regexp_extract(core, _GLUED, 1)).otherwise(core), F.when(glued, F.regexp_extract(core, _GLUED, 2)).otherwise(word)


def _value(core: Column, word: Column) -> Column:
    return F.when(core.rlike(r"^[0-9][0-9,]*(?:\.[0-9]+)?\z"), scale_to_paise(core, word))


def parse_amount(body: Column, strict_boundary: bool = False) -> Column:
    """struct(paise, confidence, matched) of the first amount of a text.

    A currency marker decides: what follows is a number with an optional multiplier, or the parse is of low confidence
    and null, however plausible a part of it is. Without one, a bare number with a multiplier counts. By default a
    multiplier needs no right boundary ("Rs 65,000 credited" is read with "cr"); strict_boundary asks for one.
    """
    pattern = _led(strict_boundary)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def read(m: Column) -> Column:
        value = let(let(pair(*_parts(m["a"], m["b"], pattern)), lambda p: pair(*_unglued(p["a"], p["b"]))), lambda p: _value(p["a"], p["b"]))
        return let(value, lambda paise: F.struct(paise.alias("paise"), F.when(paise.isNotNull(), "high").otherwise("low").alias("confidence"), F.coalesce(m["a"], m["b"]).alias("matched")))

    return let(pair(*_matched(body, pattern)), read)


def with_paise(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with the paise that parse_amount reads from each text, by name, in steps: each step's columns are
    calculated once, where one expression would repeat them and outgrow what the JVM compiles."""
    led = _led(False)
    steps = [{f"_{n}_{i}": c for n, t in texts.items() for i, c in enumerate(_matched(t, led))}]
    for step in (lambda a, b: _parts(a, b, led), _unglued):
        steps.append({f"_{n}_{i}": c for n in texts for i, c in enumerate(step(F.col(f"_{n}_0"), F.col(f"_{n}_1")))})
    for columns in [*steps, {n: _value(F.col(f"_{n}_0"), F.col(f"_{n}_1")) for n in texts}]:
        rows = rows.withColumns(columns)
    return rows.drop(*steps[0])


def extract_amounts(body: Column) -> Column:
    """All currency amounts of a text, left to right, as ARRAY<BIGINT>."""
    one = f"(?i){CURRENCY}{WS}*{NUMBER}{WS}*{MULTIPLIER}?"
    each = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(one), F.lit(0))
    return F.transform(each, lambda x: scale_to_paise(F.regexp_extract(x, one, 1), F.regexp_extract(x, one, 2)))


def has_amount(body: Column) -> Column:
    """A currency amount anywhere; a bare multiplier is none."""
    return F.coalesce(body.rlike(f"(?i){CURRENCY}{WS}*[0-9]"), F.lit(False))


def rupees_to_paise(rupees: Column) -> Column:
    return F.round(rupees.cast("decimal(28,10)") * 100, 0).cast("bigint")


def paise_to_rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,0)") / 100).cast("decimal(14,2)")


def format_paise(paise: Column) -> Column:
    """Indian grouping: the last three digits, then twos."""
    whole = F.floor(F.abs(paise) / F.lit(100).cast("decimal(3,0)")).cast("string")
    rest, last = F.regexp_extract(whole, r"^(\d*?)(\d{1,3})$", 1), F.regexp_extract(whole, r"^(\d*?)(\d{1,3})$", 2)
    grouped = F.when(rest == "", last).otherwise(F.concat(F.regexp_replace(rest, r"\B(?=(\d{2})+(?!\d))", ","), F.lit(","), last))
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0"))


def sum_paise(paise: Column) -> Column:
    """An exact integer sum; 0 of nothing."""
    return F.coalesce(F.sum(paise.cast("bigint")), F.lit(0)).cast("bigint")
