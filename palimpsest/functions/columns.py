"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space when texts are matched (those of the ECMAScript class).
WHITE_SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Fixed value: a text must have this many UTF-16 units without white space to count as moved.
MOVED_LEAST = 20


def u16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch; a timestamp without zone counts as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up, also below zero: floor(x + 1/2) at the digit."""
    unit = 10**digits
    return F.floor(x * unit + 0.5) / unit


def clamped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def scaled(x: Column, lo: float, hi: float) -> Column:
    """0 at lo and below, 100 at hi and above; a step at hi if the range is empty."""
    if hi <= lo:
        return F.when(x >= hi, 100.0).otherwise(0.0)
    return clamped((x - lo) / (hi - lo) * 100, 0, 100)


def gap_label(hours: Column) -> Column:
    """Hours with one digit, or days from 48 hours on."""
    number = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    return F.when(hours >= 48, F.concat(number(hours / 24), F.lit(" d"))).otherwise(F.concat(number(hours), F.lit(" h")))


def key(*parts: Column, sep: str = "|") -> Column:
    """Parts joined to one key; null counts as empty."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def base_name(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def safe_href(url: Column) -> Column:
    """The link if it is http or https, else null."""
    return F.when(F.trim(url).rlike(r"(?i)^https?://[^\s/]"), F.trim(url))


def excerpt(text: Column, most: int = 40) -> Column:
    """At most so many characters, with an ellipsis if there were more."""
    flat = F.trim(F.regexp_replace(text, WHITE_SPACE, " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
