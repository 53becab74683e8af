"""Column functions on names, lists kept as lines, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company names that were restyled, and houses that only port.
ALIASES = {
    "warner bros. interactive entertainment": "Warner Bros. Games",
    "wb games": "Warner Bros. Games",
    "ubisoft entertainment": "Ubisoft",
    "bandai namco entertainment": "Bandai Namco Entertainment",
    "koei tecmo games": "KOEI TECMO GAMES",
    "square enix": "Square Enix",
}
PORTING_HOUSES = ("feral interactive", "aspyr", "aspyr media", "virtual programming", "nixxes software")
# Fixed value: corporate suffixes.
SUFFIX = r"(?i),?\s*(?:inc\.?|incorporated|co\.,?\s*ltd\.?|ltd\.?|llc|l\.l\.c\.|gmbh|s\.a\.?|s\.r\.o\.?|ab|oyj?|a/s|pty|plc)\.?$"


def stripped(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", "")


def _canonical(names: Column) -> Column:
    """Canonical names of a list, null where dropped; each step is worked out once per name."""
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    bare = F.transform(names, lambda n: stripped(F.regexp_replace(stripped(n), r"(?U)(?:\s*\([^)]*\)\s*)+$", "")))
    short = F.transform(bare, lambda n: stripped(F.rtrim(stripped(F.regexp_replace(n, SUFFIX, "")), F.lit(","))))
    keyed = F.transform(short, lambda n: F.struct(n.alias("name"), F.lower(n).alias("key")))
    return F.transform(keyed, lambda x: F.when((x["key"] != "") & ~x["key"].isin(*PORTING_HOUSES), F.coalesce(F.try_element_at(known, x["key"]), x["name"])))


def company(name: Column) -> Column:
    """A company's canonical name; null for blanks and porting houses."""
    return F.element_at(_canonical(F.array(name)), 1)


def lines(c: Column) -> Column:
    """The non-empty lines of a list kept as text; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != "")


def joined(c: Column) -> Column:
    """A list as lines of text; null when empty."""
    return F.when(F.size(c) > 0, F.array_join(c, "\n"))


def companies(c: Column) -> Column:
    """The canonical names on the lines of ``c``, in order, each once."""
    return F.array_distinct(F.array_compact(_canonical(lines(c))))


def raw_names(developer: Column, publisher: Column) -> Column:
    """The names on both columns' lines, as they stand."""
    part = lambda c: F.filter(F.transform(lines(c), stripped), lambda x: x != "")
    return F.array_union(part(developer), part(publisher))


def title_key(name: Column) -> Column:
    """Letters and digits of a title in lower case: equal for the same title."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def whole(value: Column) -> Column:
    """Rounded half to even, as digits."""
    return F.bround(value, 0).cast("int").cast("string")


def tenth(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1).cast("double"))


def ordinal(value: Column, floor: float | None = None) -> Column:
    """22nd, 13th; with one decimal where it would round onto the floor it is under."""
    n = F.bround(value, 0).cast("int")
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    out = F.concat(n.cast("string"), suffix)
    return out if floor is None else F.when(n == round(floor), F.concat(tenth(value), F.lit("th"))).otherwise(out)


def percent(value: Column, bar: float | None = None) -> Column:
    """Whole percent; with one decimal where it would round onto the bar."""
    return whole(value) if bar is None else F.when(F.bround(value, 0) == round(bar), tenth(value)).otherwise(whole(value))


def dollars(cents: Column) -> Column:
    return F.concat(F.lit("$"), whole(cents / 100.0))


def out_of_scope(genres: Column, excluded: tuple[str, ...]) -> Column:
    """Whether any genre line is an excluded one; a null list is in scope."""
    return F.exists(lines(genres), lambda g: stripped(g).isin(*excluded))
