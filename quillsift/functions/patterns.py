"""Statistics and matches of the pattern bank, as columns.

Counting runs on the JVM. Each expression is guarded by the literal that every match of it must
contain, so an expression runs only over the few texts that hold its literal. Positions of
matches have no built-in and come from one vectorized function for the whole bank.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser  # type: ignore[attr-defined]

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.binding import let, once
from quillsift.functions.normalize import BLANK
from quillsift.sources.config import Bank

SPAN = "array<struct<start:int,end:int>>"
CATEGORIZED = "array<struct<start:int,end:int,category:string>>"
#: Order of the pattern features.
STATISTICS = ("text_length", "special_char_ratio", "caps_ratio", "newline_density", "avg_word_length")


def required_literals(pattern: str) -> list[str]:
    """Literals, in lower case, one of which every match of ``pattern`` contains; [] if none are certain."""
    return _required(_parser.parse(pattern, re.IGNORECASE))


def _required(parsed) -> list[str]:
    choices, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg).lower()
            continue
        if run:
            choices.append([run])
        run = ""
        if str(op) == "SUBPATTERN":
            choices.append(_required(arg[3]))
        elif str(op) == "BRANCH":
            parts = [_required(x) for x in arg[1]]
            choices.append([x for part in parts for x in part] if all(parts) else [])
        elif str(op) == "MAX_REPEAT" and arg[0] >= 1:
            choices.append(_required(arg[2]))
    # the longer the shortest literal, the fewer texts are let through
    return max((c for c in choices if c), key=lambda c: (min(map(len, c)), -len(c)), default=[])


def folded(text: Column) -> Column:
    """Lower case, with the long s as s: the form in which literals are looked for."""
    return F.translate(F.lower(text), "\u017f", "s")


def java(pattern: str) -> str:
    """The expression for Java, without regard to case."""
    return "(?iu)" + pattern


def count(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Number of matches. ``low`` is the folded text, for callers that have it."""
    found = F.regexp_count(text, F.lit(java(pattern)))
    low = folded(text) if low is None else low
    literals = required_literals(pattern)
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in literals]), found).otherwise(F.when(text.isNotNull(), 0)) if literals else found


def text_length(text: Column) -> Column:
    return F.greatest(F.length(text), F.lit(1))


def density(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """Matches of all patterns for each 1000 characters, 1 at most."""
    total = reduce(lambda a, b: a + b, [count(text, p, low) for p in patterns], F.lit(0))
    return F.least(total * 1000.0 / text_length(text), F.lit(1.0))


def densities(text: Column, bank: Bank, low: Column | None = None) -> dict[str, Column]:
    """Density by category. A normalized text serves as its own ``low``."""
    return {category: density(text, patterns, low) for category, patterns in bank.patterns.items()}


def _kept(text: Column, other: str) -> Column:
    return F.length(F.regexp_replace(text, other, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Length, share of special characters, of capitals among letters, of line breaks, and mean word length, scaled."""
    n = text_length(text)
    letters = _kept(text, r"\P{L}+")
    words = F.size(F.regexp_extract_all(text, F.lit(f"[^{BLANK[1:]}+"), F.lit(0)))
    solid = _kept(text, BLANK + "+")
    return {
        "text_length": F.least(n / 10000.0, F.lit(1.0)),
        "special_char_ratio": _kept(text, rf"(?:[\p{{L}}\p{{N}}]|{BLANK})+") / n.cast("double"),
        "caps_ratio": F.when(letters > 0, _kept(text, r"\P{Lu}+") / letters.cast("double")).otherwise(F.when(text.isNotNull(), 0.0)),
        "newline_density": _kept(text, r"[^\n]+") / n.cast("double"),
        "avg_word_length": F.when(words > 0, F.least(solid / words.cast("double") / 20, F.lit(1.0))).otherwise(F.when(text.isNotNull(), 0.0)),
    }


def feature_array(text: Column, bank: Bank) -> Column:
    """Densities in the order of the bank, then the statistics."""
    return F.array(*densities(text, bank).values(), *statistics(text).values())


def any_match(text: Column, bank: Bank) -> Column:
    """Whether any pattern matches; one alternation, which is exact for existence, for texts with a literal that a match needs."""
    every = [p for patterns in bank.patterns.values() for p in patterns]
    found = text.rlike(java("|".join(f"(?:{p})" for p in every)))
    needed = [required_literals(p) for p in every]
    if not every or not all(needed):
        return found
    literals = F.array(*[F.lit(x) for x in sorted({x for own in needed for x in own})])
    there = let(folded(text), lambda low: F.exists(literals, lambda x: F.contains(low, x)))
    return F.when(there, found).otherwise(F.when(text.isNotNull(), F.lit(False)))


def matches(text: Column, bank: Bank) -> Column:
    """Category to the matched strings, for categories with a match."""
    parts = []
    for category, patterns in bank.patterns.items():
        found = F.concat(*[F.regexp_extract_all(text, F.lit(java(p)), F.lit(0)) for p in patterns])
        parts.append(F.struct(F.lit(category).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: F.size(e["value"]) > 0))


def categorized_spans(bank: Bank):
    """A function of a text column: all matches (start, end, category) by start, then in the order of the bank."""
    compiled = [(c, re.compile(p, re.IGNORECASE), required_literals(p) or [""]) for c, patterns in bank.patterns.items() for p in patterns]

    @F.pandas_udf(CATEGORIZED)
    def spans(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            low = t.lower().replace("\u017f", "s")
            found = [(m.start(), m.end(), c) for c, p, literals in compiled if any(x in low for x in literals) for m in p.finditer(t)]
            return [dict(zip(("start", "end", "category"), s)) for s in sorted(found, key=lambda s: s[0])]

        return text.map(one)

    return once(spans)
