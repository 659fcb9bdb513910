"""Text normalization against obfuscation, as columns.

NFKC has no built-in and needs Python; each other step is also there as a JVM expression.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillsift.sources import fixed

#: Blanks as Python's ``\s`` has them, for Java and RE2 alike.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode form NFKC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def strip_invisible(text: Column) -> Column:
    """Without zero-width and bidirectional control characters."""
    return F.translate(text, fixed.ZERO_WIDTH + fixed.BIDI, "")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, BLANK + "+", " "))


def map_confusables(text: Column, table: dict[str, str]) -> Column:
    """Single characters replaced by a table; an explicit extension that is off by default."""
    return F.translate(text, "".join(table), "".join(table.values())) if table else text


@F.pandas_udf(StringType())
def _normalized(text: pd.Series) -> pd.Series:
    gone = str.maketrans("", "", fixed.ZERO_WIDTH + fixed.BIDI)

    def one(t):
        if t is None:
            return None
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t).translate(gone)
        return " ".join(t.split()).lower()

    return text.map(one)


def normalize(text: Column, compatibility: bool = True, confusables: dict[str, str] | None = None) -> Column:
    """NFKC, no invisible characters, confusables, single spaces, lower case, in this order. Null stays null.

    All steps are one vectorized function, as NFKC needs Python anyway and a column that comes out of
    it is computed once. ``compatibility=False`` leaves NFKC out and stays wholly on the JVM.
    """
    if compatibility and not confusables:
        return _normalized(text)
    if compatibility:
        text = nfkc(text)
    return F.lower(collapse_blanks(map_confusables(strip_invisible(text), confusables or {})))
