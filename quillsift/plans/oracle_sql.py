"""SQL fragments for what DuckDB has no function for: Unicode form NFKC, places of matches, chains of spans."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

#: Between the entries of a table that is written into SQL as two strings.
_SEPARATOR = "\x1f"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def character_table(name: str, form: Callable[[str], str]) -> str:
    """A common table ``name`` (c, f) of the characters beyond ASCII that ``form`` changes, also after composition."""
    rows = []
    for point in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)):
        c = chr(point)
        f = form(c)
        if f != c and unicodedata.normalize("NFC", f) != c:
            rows.append((c, f))
    left, right = (quoted(_SEPARATOR.join(x)) for x in zip(*rows))
    return f"{name} AS MATERIALIZED (SELECT unnest(string_split({left}, chr(31))) AS c, unnest(string_split({right}, chr(31))) AS f)"


def replaced(out: str, source: str, forms: str) -> str:
    """A common table ``out`` (id, t): the texts of ``source`` (id, t), their characters replaced by ``forms``, in form NFC."""
    return f"""{out} AS (SELECT id, t FROM {source} WHERE t IS NULL OR regexp_full_match(t, '[\\x00-\\x7f]*')
        UNION ALL SELECT id, nfc_normalize(string_agg(coalesce(f, c), '' ORDER BY k)) AS t FROM (
            SELECT id, unnest(p) AS c, generate_subscripts(p, 1) AS k FROM (SELECT id, regexp_extract_all(t, '(?s).') AS p FROM {source} WHERE NOT regexp_full_match(t, '[\\x00-\\x7f]*'))
        ) LEFT JOIN {forms} USING (c) GROUP BY id)"""


@functools.cache
def compatibility_forms() -> str:
    """The table ``forms``: compatibility decompositions of single characters, from which NFC makes the form NFKC."""
    return character_table("forms", lambda c: unicodedata.normalize("NFKD", c))


def nfkc(out: str, source: str) -> str:
    """Common tables up to ``out`` (id, t): the texts of ``source`` (id, t) in form NFKC; ids must be unique."""
    return f"{compatibility_forms()}, {replaced(out, source, 'forms')}"


def match_places(t: str, pattern: str) -> str:
    """A list of structs (s, m): where the matches of an expression begin in ``t``, from 0 on, and the matched strings."""
    found = f"regexp_extract_all({t}, {quoted(pattern)}, 0, 'i')"
    parts = f"string_split_regex({t}, {quoted('(?i)' + pattern)})"
    return f"""list_transform(range(1, len({found}) + 1), lambda k: {{'s': (list_sum(list_transform(({parts})[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(({found})[1:(k - 1)], lambda x: length(x))), 0))::INT, 'm': ({found})[k]}})"""


def merged(source: str, out: str) -> str:
    """Common tables up to ``out`` (id, s, e): overlapping or touching spans of ``source`` (id, s, e) merged."""
    return f"""{out}_r AS (SELECT id, s, e, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT id, s, e FROM {source})),
    {out}_i AS (SELECT id, s, e, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {out}_r),
    {out} AS (SELECT id, min(s)::INT AS s, max(e)::INT AS e FROM {out}_i GROUP BY id, island)"""
