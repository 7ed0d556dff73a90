"""Search predicates. Each returns a two-valued Column: a null input counts as no match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.values import as_text, is_list


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def two_valued(mask: Column) -> Column:
    return F.coalesce(mask, F.lit(False))


def any_of(masks: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, masks)


def all_of(masks: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, masks)


def smart_lower(phrase: str) -> bool:
    """An all-lower-case phrase ignores case; one with a capital does not."""
    return phrase == phrase.lower()


def regex_mask(phrase: str, c: Column | str, regex: bool = False) -> Column:
    """Smart-case search. Without ``regex`` the phrase must start at a word border.

    The phrase is a pattern in both forms, and the border binds to its first alternative only.
    """
    text = F.lower(_col(c)) if smart_lower(phrase) else _col(c)
    return two_valued(text.rlike("(?U)" + (phrase if regex else rf"\b{phrase}")))


def element_mask(phrase: str, c: Column | str) -> Column:
    """Some list element matches the pattern from its start, with smart case."""
    lower = smart_lower(phrase)
    return two_valued(
        F.exists(_col(c), lambda x: (F.lower(x) if lower else x).rlike(f"(?U)^(?:{phrase})"))
    )


def keyword_pattern(keywords: list[str]) -> str:
    return "|".join(rf"\b{k}" for k in keywords)


def keyword_mask(df: DataFrame, keywords: str | list[str], name: str, case: bool | None = False) -> Column:
    """Any keyword as a word prefix in a text column or in the joined elements of a list column.

    ``case=None`` decides by smart case.
    """
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    pattern = keyword_pattern(words)
    if case is None:
        case = not smart_lower(pattern)
    return two_valued(as_text(df, name).rlike(("(?U)" if case else "(?iU)") + pattern))


def keyword_equals_mask(df: DataFrame, keywords: str | list[str], name: str, case: bool = False) -> Column:
    """Some element (or the text itself) equals a keyword; both sides are lowered unless ``case``."""
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    items = F.col(name) if is_list(df, name) else F.array(name)
    if not case:
        words = [w.lower() for w in words]
        items = F.transform(items, F.lower)
    return two_valued(F.arrays_overlap(items, F.array(*[F.lit(w) for w in words])))


def keyword_mask_any(
    df: DataFrame, keywords: str | list[str], names: list[str], contains: bool = True, case: bool | None = False
) -> Column:
    """OR of the keyword test over several columns, one fused predicate in one scan."""
    if contains:
        return any_of([keyword_mask(df, keywords, n, case) for n in names])
    return any_of([keyword_equals_mask(df, keywords, n, bool(case)) for n in names])


def overlaps(c: Column | str, values: list) -> Column:
    """The list shares an element with ``values``; an empty list of values matches nothing."""
    if not values:
        return F.lit(False)
    return two_valued(F.arrays_overlap(_col(c), F.array(*[F.lit(v) for v in values])))


def in_box(lat: Column | str, lon: Column | str, box: tuple[float, float, float, float]) -> Column:
    """Some (lat, lon) pair of two parallel lists lies in (lat from, lat to, lon from, lon to)."""
    south, north, west, east = box
    pairs = F.zip_with(_col(lat), _col(lon), lambda a, b: a.between(south, north) & b.between(west, east))
    return two_valued(F.exists(pairs, lambda hit: two_valued(hit)))


# The home region, as a text pattern and as degrees.
HOME_BOX = (37, 39, -123, -121)
HOME_TEXT = "San Francisco|San Jose"


def home_region(lat: Column | str, lon: Column | str, location: Column | str, box=HOME_BOX, text: str = HOME_TEXT) -> Column:
    return in_box(lat, lon, box) | two_valued(_col(location).rlike(f"(?iU){text}"))


# Title patterns.
DATA_ROLE = (
    r"(?:data|\bml\b|machine learning|\bai\b|artificial intelligence|\bnlp\b|statistical|\bbi\b|"
    r"business intelligence|devops|mlops).+(?:engineer|scientist|science|programmer)"
)
SOFTWARE_ROLE = r"software.+engineer"
TOPICS = {
    "ds": r"data.+scien",
    "ml": r"\bml\b|machine.+learning",
    "ai": r"\bai\b|artificial.+intelligence",
    "nlp": r"\bnlp\b|natural.+lang.+process",
    "eng": r"engineer",
}


def title_class(title: Column | str, include: str = DATA_ROLE, exclude: str = SOFTWARE_ROLE) -> Column:
    """The title fits ``include`` and not ``exclude``, ignoring case; a missing title does not fit."""
    text = F.coalesce(_col(title), F.lit(""))
    return text.rlike(f"(?iU){include}") & ~text.rlike(f"(?iU){exclude}")


def topic_flags(title: Column | str, topics: dict[str, str] = TOPICS) -> dict[str, Column]:
    text = F.coalesce(_col(title), F.lit(""))
    return {name: text.rlike(f"(?iU){pattern}") for name, pattern in topics.items()}


def term_groups(c: Column | str, any_groups: list[list[str]], none_of: list[str]) -> Column:
    """One whole word of each group must occur and none of ``none_of``, ignoring case."""

    def words(terms: list[str]) -> str:
        quoted = [rf"\Q{t}\E" for t in terms]
        return rf"(?iU)\b(?:{'|'.join(quoted)})\b"

    tests = [two_valued(_col(c).rlike(words(g))) for g in any_groups]
    if none_of:
        tests.append(~two_valued(_col(c).rlike(words(none_of))))
    return all_of(tests)


EARTH_MILES = 3958.7613  # mean radius
MILES_PER_DEGREE = 69.0  # slightly short, so the box below is slightly wide


def within_miles(lat: Column | str, lon: Column | str, centre: tuple[float | Column, float | Column], miles: float | Column) -> Column:
    """Great-circle distance test behind a plain latitude range, which a Parquet scan can skip on."""
    lat, lon = _col(lat), _col(lon)
    clat, clon, miles = (x if isinstance(x, Column) else F.lit(x) for x in (*centre, miles))
    reach = miles / F.lit(MILES_PER_DEGREE)
    half = F.pow(F.sin(F.radians(lat - clat) / 2), 2) + F.cos(F.radians(clat)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - clon) / 2), 2)
    near = lat.between(clat - reach, clat + reach)
    return two_valued(near & (F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(half)) <= miles))


def address_parts(c: Column | str) -> Column:
    """The parts of a comma-separated address, in lower case."""
    return F.transform(F.split(_col(c), ","), lambda x: F.lower(F.trim(x)))


def at_address(location: Column | str, names: Column) -> Column:
    """Every name is a part of the address, ignoring case; no names match any address."""
    return two_valued(F.size(F.array_except(F.transform(names, F.lower), F.coalesce(address_parts(location), F.array().cast("array<string>")))) == 0)
