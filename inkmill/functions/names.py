"""Author names in ``First Last`` form, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, normalize_field, strip

# Parts of a name that stand before and after it, in the order they are looked for.
TITLES = ["Baron", "Lord", "Sir", "Dame", "Duke", "Earl"]
SUFFIXES = ["Jr.", "Jr", "Sr.", "Sr", "III", "II", "IV", "Ph.D.", "M.D."]
# Parts that are neither a last nor a first name in a list of authors, and the form of a first name.
NOT_A_NAME = ["Jr.", "Jr", "Sr.", "Sr", "III", "II", "IV", "Baron", "Lord", "Sir"]
FIRST_NAME = rf"\A[A-Z][a-z]*\.?({WS}+[A-Z]\.?)?\n?\z"
PARENTHESES = rf"(?U){WS}*\([^)]+\){WS}*"
YEARS = r"(?U)\d{4}-\d{4}"


def _pull(name: Column, parts: list[str]) -> Column:
    """struct<name, found>: the name without ``, part`` for each part, and the parts it had."""
    start = F.struct(name.alias("name"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        mark = F.concat(F.lit(", "), part)
        return F.struct(
            F.replace(acc["name"], mark, F.lit("")).alias("name"),
            F.when(F.contains(acc["name"], mark), F.array_append(acc["found"], part)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.array(*map(F.lit, parts)), start, step)


def normalize_single_name(c: Column) -> Column:
    """``Last, First`` turned round, with titles before and suffixes after; parentheses and years go.

    Titles and suffixes are dropped where no comma is left to turn the name round at.
    """
    name = strip(F.regexp_replace(strip(c), PARENTHESES, " "))
    name = strip(F.regexp_replace(name, rf"(?U),?{WS}*\d{{4}}-\d{{4}}", ""))
    titled = _pull(name, TITLES)
    bare = _pull(titled["name"], SUFFIXES)
    halves = F.transform(F.split(bare["name"], ",", 2), strip)
    last, first = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    turned = F.array_join(F.flatten(F.array(titled["found"], F.array(first, last), bare["found"])), " ")
    return F.when((F.size(halves) == 2) & (first != "") & (last != ""), turned).otherwise(bare["name"])


def normalize_name(c: Column) -> Column:
    """One or several authors. A list of at least four parts is read as last and first names in turn;
    anything else is one name. Null and empty names are returned as they are."""
    name = normalize_field(c)
    clean = lambda p: strip(F.regexp_replace(strip(F.regexp_replace(strip(p), PARENTHESES, "")), YEARS, ""))
    parts = F.filter(F.transform(F.split(name, ",", -1), clean), lambda p: (p != "") & ~F.rlike(p, F.lit(r"\A\p{Nd}+\z")))

    # the walk stands at ``i``; steps at other positions change nothing
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("authors"), F.lit(False).alias("odd"))

    def step(acc: Column, at: Column) -> Column:
        here, then = F.get(parts, at), F.get(parts, at + 1)
        skip = here.isin(*NOT_A_NAME)
        pair = F.rlike(then, F.lit(FIRST_NAME))
        walking = (acc["i"] == at) & ~acc["odd"]
        return F.struct(
            F.when(walking & skip, at + 1).when(walking & pair, at + 2).otherwise(acc["i"]).alias("i"),
            F.when(walking & ~skip & pair, F.array_append(acc["authors"], F.concat_ws(" ", then, here))).otherwise(acc["authors"]).alias("authors"),
            (acc["odd"] | (walking & ~skip & ~pair)).alias("odd"),
        )

    steps = F.when(F.size(parts) >= 4, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
    walk = F.aggregate(steps, start, step)
    listed = F.when(~walk["odd"] & (F.size(walk["authors"]) > 0), F.array_join(walk["authors"], ", "))
    return F.when(c == "", c).otherwise(F.coalesce(listed, normalize_single_name(name)))
