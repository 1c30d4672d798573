"""Plain identifiers out of mixed notation.

``P17``, `` p17``, ``wdt:P17``, ``Property:P17``, ``<http://kg.example/entity/P17>``, a wiki address, full-width letters and digits and
stray invisible characters all name the same relation; the same holds for ``Q`` entities. Anything else names nothing and becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "："
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz:"
#: Characters that are not seen: soft hyphen, zero-width marks and joiners, byte-order mark.
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _named(letter: str) -> str:
    return rf"(?i)(?:^|[:/#])[\s ]*{letter}0*([1-9][0-9]*)[\s ]*>?[\s ]*$"


def id_number(col: Column | str, letter: str) -> Column:
    """The digits of a ``P`` or ``Q`` identifier as a string without leading zeros, NULL where the value names none."""
    c = F.col(col) if isinstance(col, str) else col
    slow = F.regexp_extract(F.translate(c, _WIDE + INVISIBLE, _PLAIN), _named(letter), 1)
    plain = c.rlike(rf"^{letter}[1-9][0-9]*$")
    return F.when(plain, F.substring(c, 2, 1_000_000)).otherwise(F.nullif(slow, F.lit("")))


def plain_id(col: Column | str, letter: str) -> Column:
    """``P…`` or ``Q…`` in its plain form, NULL where the value names none."""
    c = F.col(col) if isinstance(col, str) else col
    slow = F.regexp_extract(F.translate(c, _WIDE + INVISIBLE, _PLAIN), _named(letter), 1)
    return F.when(c.rlike(rf"^{letter}[1-9][0-9]*$"), c).when(slow != "", F.concat(F.lit(letter), slow))


def id_long(col: Column | str, letter: str) -> Column:
    """The number as a bigint; NULL beyond 18 digits as well, so nothing wraps around."""
    n = id_number(col, letter)
    return F.when(F.length(n) <= 18, n.cast("long"))


def plain_id_sql(col: str, letter: str) -> str:
    """The same as DuckDB SQL, for the check queries."""
    return (
        f"CASE WHEN regexp_matches({col}, '^{letter}[1-9][0-9]*$') THEN {col} ELSE '{letter}' || nullif(regexp_extract(regexp_replace("
        f"translate({col}, '{_WIDE}', '{_PLAIN}'), '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), "
        f"'(?i)(?:^|[:/#])[\\s\\x{{00A0}}]*{letter}0*([1-9][0-9]*)[\\s\\x{{00A0}}]*>?[\\s\\x{{00A0}}]*$', 1), '') END"
    )
