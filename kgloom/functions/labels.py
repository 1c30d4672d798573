"""Unevenly spelled labels brought to one form, filler recognised, time stamps read from several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a field holds when somebody had no value, after folding.
FILLERS = ("", "na", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "notavailable", "novalue", "tbd")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(col: Column | str) -> Column:
    """Lower case without spaces, separators and other punctuation; two spellings of one label fold alike."""
    return F.lower(F.regexp_replace(_col(col), r"[^\p{L}\p{M}\p{N}]+", ""))


def usable(col: Column | str) -> Column:
    """True where the value is neither NULL nor filler."""
    return F.coalesce(~folded(col).isin(*FILLERS), F.lit(False))


def folded_path(col: Column | str) -> Column:
    """A path in one form: forward slashes, no doubled or leading ``./``, lower case; NULL for filler."""
    c = F.regexp_replace(F.trim(_col(col)), r"[\\/]+", "/")
    return F.when(usable(col), F.lower(F.regexp_replace(c, r"^(\./)+", "")))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch from ISO text with or without offset (UTC without) or from epoch seconds; else NULL."""
    c = F.trim(_col(col))
    number = c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")
    offset = c.rlike(r"([zZ]|[+-][0-9]{2}:?[0-9]{2})$") & c.rlike(r"[0-9]:[0-9]")
    stamp = F.when(offset, c).when(c.rlike(r"[0-9]:[0-9]"), F.concat(c, F.lit("Z"))).otherwise(F.concat(c, F.lit("T00:00:00Z")))
    stamp = F.regexp_replace(F.regexp_replace(stamp, "z$", "Z"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    dated = c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")  # a bare time of day would be read as today's
    return F.when(number, F.round(c.try_cast("double") * 1_000_000).try_cast("long")).when(dated, F.unix_micros(stamp.try_cast("timestamp")))
