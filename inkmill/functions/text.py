"""Cleaning of raw text, as chains of built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in source texts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
#: One white-space character in a pattern with the (?U) flag.
WS = r"[\s\x1c-\x1f]"

# Garbled sequences and their replacements, in the order they apply. An earlier entry can hide a later one.
MOJIBAKE = [
    ("â€œ", '"'),
    ("â€", '"'),
    ("â", "—"),
    ("\x80\x94", ""),
    ("\x80\x9c", ""),
    ("\x80\x9d", ""),
    ("\x80\x99", ""),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã ", "à"),
    ("Ã¢", "â"),
    ("Ã®", "î"),
    ("Ã´", "ô"),
    ("Ã»", "û"),
    ("Ã§", "ç"),
    ("Ã", "í"),
]

# Patterns and replacements for what is left of garbled quotes, then stray quotes and dashes, in the order they apply.
QUOTE_RULES = [
    (rf'â{WS}*"', '"'),
    (rf'"{WS}*â', '"'),
    (rf"â{WS}*'", "'"),
    (rf"'{WS}*â", "'"),
    (r"\bâ(\w)", '"$1'),
    (r"(\w)â\b", '$1"'),
    (rf"{WS}â{WS}", " — "),
]
DASHES = ["—", "–"]
STRAY_RULES = [
    (r' " ', " "),
    (rf' "{WS}*\z', ""),
    (rf'\A{WS}*" ', ""),
    (r" - ", " "),
    (rf"-([^-\s\x1c-\x1f]{{1,200}}?)-", "$1"),
    (rf"{WS}-([A-Z])", " $1"),
    (rf"([a-z])-{WS}", "$1 "),
    (rf"([.!?])-{WS}", "$1 "),
    (r"([a-z])-([A-Z])", "$1 $2"),
    (r"([a-z])-([a-z]{2,})\b", "$1 $2"),
    (rf"{WS}-([a-zA-Z])", " $1"),
    (rf"([a-zA-Z])-{WS}", "$1 "),
    (r"\(-", "("),
    (r"-\)", ")"),
    (r"\.-\)", ".)"),
    (r"-([;:,.!?])", "$1"),
    (r"'s-;", "'s;"),
]

# Quotes and dashes that the strict profile straightens before anything else.
STRICT = [("â€˜", "'"), ("â€™", "'"), ("â€¦", "..."), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")]


def _literal(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _pattern(c: Column, pairs) -> Column:
    for pattern, new in pairs:
        c = F.regexp_replace(c, "(?U)" + pattern, new)
    return c


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` knows the space alone)."""
    return F.btrim(c, F.lit(WHITESPACE))


def fix_encoding(c: Column, strict: bool = False) -> Column:
    """Repairs garbled characters, quotes and dashes, and puts the text on one line.

    The default reproduces the stored results, in which curly quotes survive; ``strict``
    straightens them. Null and empty texts are returned as they are.
    """
    if strict:
        c = _literal(c, STRICT)
    c = _literal(c, MOJIBAKE)
    c = _pattern(c, QUOTE_RULES)
    c = _literal(c, [(d, "-") for d in DASHES])
    c = _pattern(c, STRAY_RULES)
    c = _literal(c, [("\r\n", " "), ("\r", " "), ("\n", " "), ('\\"', '"'), ("\\'", "'"), ("\\", "")])
    return F.regexp_replace(c, "  +", " ")


def normalize_field(c: Column) -> Column:
    """One space between words and none at the ends."""
    return strip(F.regexp_replace(c, f"(?U){WS}+", " "))


def or_else(c: Column, *others: Column) -> Column:
    """The first value that is neither null nor empty; else the last one as it is."""
    *some, last = [c, *others]
    return F.coalesce(*[F.when(x != "", x) for x in some], last)
