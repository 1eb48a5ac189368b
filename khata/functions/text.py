"""Regular-expression pieces with the semantics that the message functions need, whatever the JVM's flags.

Word boundaries and digits are ASCII, white space is Unicode's, and the end is the very end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, character by character. In the pattern one look rules out what is neither Latin nor a late one.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = r"[\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
ANY = r"[^\n\r\u2028\u2029]"
W = "[A-Za-z0-9_]"
#: Either side of a word boundary.
EDGE = f"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"
#: What EDGE comes to before a character of a word, and after one: one look instead of four at every place of a text.
BEFORE, AFTER = f"(?<!{W})", f"(?!{W})"


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def literal(words: str) -> str:
    """A phrase as a pattern."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", words)


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    """Any phrase, each of which begins and ends with a letter, at word boundaries, without case."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0].lower(), []).append(literal(w[1:]))
    return c.rlike(f"(?i){BEFORE}(?:{'|'.join(f'{k}(?:{chr(124).join(rest)})' for k, rest in by_letter.items())}){AFTER}")


def has_text(c: Column, words: tuple[str, ...]) -> Column:
    """Any phrase anywhere, without case."""
    return F.lower(c).rlike("|".join(literal(w.lower()) for w in words))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null where nothing, or nothing in the group, matches. The match is sought once, where
    nullif would repeat it."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda x: x != ""), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value calculated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
