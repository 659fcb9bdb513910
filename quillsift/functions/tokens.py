"""Token features and weak labels of the token model, as array columns (no shuffle)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quillsift.functions.binding import let, once
from quillsift.sources import fixed
from quillsift.sources.config import Bank

#: Characters around a motif that count as near it.
NEAR = 200
TOKENS = ArrayType(StructType().add("word", StringType()).add("start", IntegerType()).add("end", IntegerType()))
SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))


def tokenize(text: Column, most: int | None = None) -> Column:
    """Runs of other than blanks, with offsets; the first ``most`` if given. Null stays null."""

    @F.pandas_udf(TOKENS)
    def cut(texts: pd.Series) -> pd.Series:
        from itertools import islice

        one = lambda t: [{"word": m.group(), "start": m.start(), "end": m.end()} for m in islice(re.finditer(r"\S+", t), most)]
        return texts.map(lambda t: None if t is None else one(t))

    return once(cut)(text)


@F.pandas_udf(SPANS)
def injection_spans(text: pd.Series) -> pd.Series:
    """Matches of the expression for weak labels."""
    compiled = re.compile(fixed.INJECTION, re.IGNORECASE)
    return text.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for m in compiled.finditer(t)])


def _in_lexicons(w: Column) -> dict[str, Column]:
    return {name: w.isin(words) for name, words in fixed.LEXICONS.items()}


def _feature(key: Column | str, value: Column | str, when: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    entry = F.struct(lit(key).alias("key"), lit(value).alias("value"))
    return entry if when is None else F.when(when, entry)


def features(tokens: Column) -> Column:
    """Array of the feature maps of the tokens: the word, its ends, shape and lexicons, position, and its neighbours."""
    known = F.transform(tokens, lambda t: let(F.lower(t["word"]), lambda w: F.struct(t["word"].alias("word"), w.alias("w"), *[hit.alias(name) for name, hit in _in_lexicons(w).items()])))
    return let(known, lambda k: F.transform(k, lambda t, i: _token_features(k, t, i)))


def _token_features(known: Column, t: Column, i: Column) -> Column:
    def one(n: Column) -> Column:
        word, w = t["word"], t["w"]
        cased = r"\p{Lu}\p{Ll}\p{Lt}"
        entries = [
            _feature("bias", "1"), _feature("w", w), _feature("w[-3:]", F.right(w, F.lit(3))), _feature("w[-2:]", F.right(w, F.lit(2))), _feature("w[:3]", F.left(w, F.lit(3))),
            _feature("len", F.least(F.length(word), F.lit(20)).cast("string")),
            _feature("ALLCAP", "1", (F.length(word) > 1) & (word == F.upper(word)) & (word != w)),
            _feature("Title", "1", word.rlike(rf"^[^{cased}]*(?:[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:[^{cased}]+|$))+$")),
            _feature("Digit", "1", word.rlike(r"^\p{Nd}+$")), _feature("HasSpecial", "1", word.rlike(r"[^a-zA-Z0-9\s]")),
            *[_feature(f"kw:{name}", "1", t[name]) for name in fixed.LEXICONS],
            _feature("pos", F.least(F.floor(i * 10 / n), F.lit(9)).cast("string")), _feature("BOS", "1", i == 0), _feature("EOS", "1", i == n - 1),
        ]
        for offset in (-3, -2, -1, 1, 2, 3):
            other = F.get(known, i + offset)
            if abs(offset) == 1:
                entries.append(_feature(f"{offset:+d}:w", other["w"], other.isNotNull()))
            entries += [_feature(f"{offset:+d}:kw:{name}", "1", other[name]) for name in fixed.LEXICONS]
        return F.map_from_entries(F.array_compact(F.array(*entries)))

    return one(F.size(known))


def document_flags(densities: dict[str, Column]) -> Column:
    """The features doc:category of the categories with a density."""
    entries = [_feature(f"doc:{c}", "1", d > 0) for c, d in densities.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _overlap(tokens_part: Column, spans: Column, margin: int = 0) -> Column:
    return F.filter(spans, lambda s: (s["end"] > tokens_part["start"] - margin) & (s["start"] < tokens_part["end"] + margin))


def overlay(tokens: Column, pattern_spans: Column, motif_spans: Column) -> Column:
    """Array of the maps in_pat, pat:c, in_motif, near_motif (within 200 characters), motif:c of the tokens.

    Spans are structs (start, end, category).
    """

    def one(t: Column) -> Column:
        inside, motif, near = _overlap(t, pattern_spans), _overlap(t, motif_spans), _overlap(t, motif_spans, NEAR)
        named = lambda spans, prefix: F.transform(F.array_distinct(F.transform(spans, lambda s: s["category"])), lambda c: F.struct(F.concat(F.lit(prefix), c).alias("key"), F.lit("1").alias("value")))
        flags = F.array_compact(F.array(_feature("in_pat", "1", F.size(inside) > 0), _feature("in_motif", "1", F.size(motif) > 0), _feature("near_motif", "1", F.size(near) > F.size(motif))))
        return F.map_from_entries(F.concat(flags, named(inside, "pat:"), named(near, "motif:")))

    return F.transform(tokens, one)


def weak_labels(tokens: Column, injection: Column, found: Column, pattern_spans: Column | None = None, motif_spans: Column | None = None) -> Column:
    """Labels I and O of the tokens from the label of the document; null where a document should be skipped.

    Tiers, the first that marks a token holds: pattern spans and 30 characters around, motif spans and
    50, ``found`` spans of the expression and 60, words of the lexicons and three tokens around; with
    pattern and motif spans given, else all tokens; without them, else null.
    """
    near = lambda spans, margin: F.transform(tokens, lambda t: F.exists(spans, lambda s: (t["end"] >= s["start"] - margin) & (t["start"] <= s["end"] + margin)))
    words = sorted({w for lexicon in fixed.LEXICONS.values() for w in lexicon})
    suspect = F.transform(tokens, lambda t: F.lower(t["word"]).isin(words))
    around = let(suspect, lambda s: F.transform(s, lambda x, i: F.exists(F.slice(s, F.greatest(i - 2, F.lit(1)), F.lit(7) - F.greatest(3 - i, F.lit(0))), lambda y: y)))
    tiers = [*([near(pattern_spans, 30), near(motif_spans, 50)] if pattern_spans is not None and motif_spans is not None else []), near(found, 60), around]
    named = lambda marks: F.transform(marks, lambda x: F.when(x, "I").otherwise("O"))
    out = F.when(~injection, F.transform(tokens, lambda t: F.lit("O")))
    for marks in tiers:
        out = out.when(let(marks, lambda m: F.exists(m, lambda x: x)), named(marks))
    if len(tiers) == 4:
        out = out.otherwise(F.transform(tokens, lambda t: F.lit("I")))
    return F.when(F.size(tokens) > 0, out)


def sandwich(text: Column, key: Column, seed: int = 42) -> Column:
    """Struct (text, start, end): a text between a benign prefix and suffix that a hash of the key chooses, and where it lies."""
    digest = lambda salt: F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(f":{seed + salt}"))), F.lit(8)), 16, 10).cast("bigint")
    pick = lambda of, salt: F.element_at(F.array(*[F.lit(x) for x in of]), (digest(salt) % len(of) + 1).cast("int"))
    prefix = pick(fixed.PREFIXES, 0)
    return F.struct(F.concat(prefix, text, pick(fixed.SUFFIXES, 1)).alias("text"), F.length(prefix).alias("start"), (F.length(prefix) + F.length(text)).alias("end"))


def region_labels(tokens: Column, start: Column, end: Column) -> Column:
    """I for tokens that overlap [start, end), else O."""
    return F.transform(tokens, lambda t: F.when((t["start"] < end) & (t["end"] > start), "I").otherwise("O"))


def noisy_or(probabilities: Column, certain: bool = False) -> Column:
    """1 - product of (1 - p); tokens with p = 1 are left out unless ``certain``. An empty array scores 0."""
    total = F.aggregate(F.filter(probabilities, lambda p: p < 1.0), F.lit(0.0), lambda a, p: a + F.log1p(-p))
    score = 1.0 - F.exp(total)
    return F.when(F.exists(probabilities, lambda p: p >= 1.0), 1.0).otherwise(score) if certain else score


def spans_of(bank: Bank, found: Column) -> Column:
    """(start, end, category) of motif matches."""
    return F.transform(found, lambda m: F.struct(m["position"].alias("start"), (m["position"] + m["length"]).alias("end"), m["category"].alias("category")))
