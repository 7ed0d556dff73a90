"""String features. Regular expressions use ``(?U)`` so that word and space classes are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APOSTROPHE = "\u2019"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(c: Column | str) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(_col(c), r"(?U)\s+", " ")


# The Unicode white-space characters.
SPACES = (
    " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Drop white space at both ends, no-break space included."""
    return F.trim(_col(c), F.lit(SPACES))


def normalise_chars(c: Column | str) -> Column:
    """No-break, zero-width and narrow spaces to a blank, the curly apostrophe to a straight one."""
    return F.translate(_col(c), "\u00a0\u200b\u202f" + APOSTROPHE, "   '")


def clean_company(c: Column | str) -> Column:
    """Drop one closing colon; double quotes and curly apostrophes become straight apostrophes."""
    return F.translate(F.regexp_replace(_col(c), ":$", ""), '"' + APOSTROPHE, "''")


def position_name(company: Column | str, title: Column | str) -> Column:
    """``company - title`` made safe as a file name; null when the title is null."""
    joined = F.concat(F.coalesce(_col(company), F.lit("")), F.lit(" - "), _col(title))
    safe = F.translate(joined, '/|:\\*?"' + APOSTROPHE, "______''")
    return strip(F.regexp_replace(safe, " +", " "))


def shorten_location(c: Column | str) -> Column:
    """Leave out the home state and country."""
    return F.replace(F.replace(_col(c), F.lit(", California"), F.lit("")), F.lit(", United States"), F.lit(""))


def lower_key(c: Column | str) -> Column:
    return F.lower(_col(c))


def literal_pattern(terms: list[str]) -> str:
    """One capture group that matches any of the literal ``terms``, the earlier one first."""
    special = set("\\^$.|?*+()[]{}-#&~ ")
    return "(" + "|".join("".join("\\" + ch if ch in special else ch for ch in t) for t in terms) + ")"


def dictionary_hits(c: Column | str, terms: list[str]) -> Column:
    """Every hit of a short literal term list, left to right; null when there is none."""
    hits = F.regexp_extract_all(_col(c), F.lit(literal_pattern(terms)), 1)
    return F.when(F.size(hits) > 0, hits)


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), group)


def url_of_key(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), _col(key))


def identifier(position: Column | str, key: Column | str) -> Column:
    """``position.key``, the name under which a posting is stored; null when either is null."""
    return F.concat(_col(position), F.lit("."), _col(key))


def before_last(c: Column | str, mark: str) -> Column:
    """Text before the last ``mark``; the whole text when there is none."""
    c = _col(c)
    last = F.substring_index(c, mark, -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(last) - F.lit(len(mark)))
    return F.when(F.contains(c, F.lit(mark)), head).otherwise(c)


def after_last(c: Column | str, mark: str) -> Column:
    """Text after the last ``mark``; null when there is none."""
    c = _col(c)
    return F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, -1))


def before_first(c: Column | str, mark: str) -> Column:
    return F.substring_index(_col(c), mark, 1)


def remove_suffix(c: Column | str, suffix: str) -> Column:
    c = _col(c)
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - F.lit(len(suffix)))).otherwise(c)


def key_from_log(c: Column | str) -> Column:
    """Key of a ``name.key.ext.ext`` log entry: the second piece after at most three cuts from the right.

    With fewer than three dots the pieces count from the left, so it is simply the second piece.
    """
    pieces = F.split(_col(c), r"\.")
    return F.when(F.size(pieces) >= 4, F.try_element_at(pieces, F.lit(-3))).otherwise(
        F.try_element_at(pieces, F.lit(2))
    )


def plus_to_space(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("+"), F.lit(" "))


def share_text(hits: Column, total: Column) -> Column:
    """``12 of 1,000 (1.2%)``."""
    return F.concat(
        F.format_number(hits, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" ("),
        F.format_number(F.lit(100) * hits / total, 1), F.lit("%)"),
    )


def dated_label(day: Column, days_back: int = 0, with_time: bool = False, for_file: bool = True) -> Column:
    """Snapshot label of a day or time, some days back. Pass the day in, so that a job can be repeated."""
    moment = day.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days_back))
    if with_time:
        if for_file:
            return F.date_format(moment, "yyyy-MM-dd_HHmmss")
        return F.lower(F.date_format(moment, "h:mma"))
    return F.date_format(moment, "yyyy-MM-dd" if for_file else "M/d/yy (EEEE)")
