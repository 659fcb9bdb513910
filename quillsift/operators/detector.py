"""Detection methods, their registry, and the detector that runs one over a table of texts."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import motifs, patterns
from quillsift.functions.binding import settle
from quillsift.functions.normalize import normalize
from quillsift.operators import spans
from quillsift.sources import fixed
from quillsift.sources.config import Bank

#: Threshold of methods that name none.
DEFAULT_THRESHOLD = 0.3
_SPANS = "array<struct<start:int,end:int>>"
_METHODS: dict[str, Callable[..., DetectionMethod]] = {}


class DetectionMethod(ABC):
    """Adds (score, pattern_features, matched_patterns, matched_spans) to a table with raw and normalized text."""

    default_threshold: float | None = None
    mode = "native"

    #: Whether the method can be used as it is; methods that are trained first are not without their model.
    is_loaded = True

    @abstractmethod
    def transform(self, df: DataFrame, text: str, normalized: str, include_matches: bool = False, least: float = 0.0) -> DataFrame:
        """``df`` with the four result columns; texts that score under ``least`` need no spans."""


def register_method(name: str):
    """Class decorator: makes a method known by name."""

    def add(cls):
        _METHODS[name] = cls
        cls.method_name = name
        return cls

    return add


def list_methods() -> list[str]:
    return sorted(_METHODS)


def get_method(name: str, **options) -> DetectionMethod:
    """An instance of the method; ValueError with the known names for an unknown one."""
    if name not in _METHODS:
        raise ValueError(f"Unknown method {name!r}; known: {', '.join(list_methods())}")
    return _METHODS[name](**options)


def weighted_score(density: dict[str, Column]) -> Column:
    """Weighted sum of the densities over the sum of the weights, 1 at most; categories without a weight do not count."""
    total = sum((density[c] * w for c, w in fixed.WEIGHTS.items() if c in density), F.lit(0.0))
    return F.least(total / sum(fixed.WEIGHTS.values()), F.lit(1.0))


@register_method("pattern-only")
class PatternOnly(DetectionMethod):
    """The weighted pattern score alone."""

    mode = "pattern-only"

    def __init__(self, languages: list[str] | None = None, directories: list[str] | None = None) -> None:
        self.bank = Bank.load(languages, directories)

    def transform(self, df: DataFrame, text: str, normalized: str, include_matches: bool = False, least: float = 0.0) -> DataFrame:
        by = {c: d for c, d in patterns.densities(F.col(normalized), self.bank, F.col(normalized)).items() if c in fixed.WEIGHTS}
        own = df.columns
        df = settle(df, {f"__{c}": d for c, d in by.items()})
        df = df.withColumn("__found", patterns.categorized_spans(self.bank)(F.when(weighted_score({c: F.col(f"__{c}") for c in by}) >= least, F.col(text))))
        found = patterns.matches(F.col(normalized), self.bank) if include_matches else F.create_map().cast("map<string,array<string>>")
        return df.select(
            *own,
            weighted_score({c: F.col(f"__{c}") for c in by}).alias("score"),
            F.create_map(*[x for c in by for x in (F.lit(c), F.col(f"__{c}"))]).alias("pattern_features"),
            found.alias("matched_patterns"),
            F.when(F.col(text).isNotNull(), F.coalesce(spans.merge(F.col("__found")), F.array().cast(_SPANS))).alias("matched_spans"),
        )


@register_method("heuristic")
class Heuristic(DetectionMethod):
    """Patterns and motifs without embeddings; texts without a find leave before matching for spans.

    A text without suspicious category and motif and with a score under 0.1 has no spans. Spans
    lie in the raw text while the score is of the normalized one, so disguised texts may have none.
    """

    mode = "pattern-only"

    def __init__(self, languages: list[str] | None = None, directories: list[str] | None = None, motif_mode: str = "exact") -> None:
        self.bank = Bank.load(languages, directories)
        if languages is None:
            self.bank.motifs = Bank.default().motifs
        if motif_mode not in ("exact", "fuzzy", "automaton"):
            raise ValueError(f"Unknown motif mode {motif_mode!r}; known: automaton, exact, fuzzy")
        self.fuzzy = motif_mode != "exact"
        self.find = {"exact": motifs.matches, "fuzzy": motifs.fuzzy_matches, "automaton": motifs.all_occurrences}[motif_mode]

    def transform(self, df: DataFrame, text: str, normalized: str, include_matches: bool = False, least: float = 0.0) -> DataFrame:
        own = df.columns
        by = {c: d for c, d in patterns.densities(F.col(normalized), self.bank, F.col(normalized)).items() if c in fixed.WEIGHTS}
        if self.fuzzy:  # a Python function: its results are settled already
            df = settle(df.withColumn("__motifs", self.find(F.col(normalized), self.bank)), {f"__{c}": d for c, d in by.items()})
        else:
            df = settle(df, {f"__{c}": d for c, d in by.items()} | {"__motifs": self.find(F.col(normalized), self.bank)})
        base = weighted_score({c: F.col(f"__{c}") for c in by})
        density = motifs.signal_density(F.col(normalized), F.col("__motifs"))
        suspicious = (density > 0) | sum((F.col(f"__{c}") for c in by), F.lit(0.0)).__gt__(0)
        df = settle(df, {"__base": base, "__density": density, "__go_on": suspicious | (base >= 0.1)})
        score = F.when(F.col("__go_on"), F.least(F.col("__base") + F.least(F.col("__density") / 10, F.lit(0.3)), F.lit(1.0))).otherwise(F.col("__base"))
        df = settle(df, {"__score": score})
        # positions cost most, and only the texts that can be flagged need them
        df = settle(df, {"__spanned": F.when(F.col("__go_on") & (F.col("__score") >= least), F.col(text))})
        df = df.withColumn("__found", patterns.categorized_spans(self.bank)(F.col("__spanned")))
        if self.fuzzy:
            df = df.withColumn("__raw", self.find(F.col("__spanned"), self.bank))
        raw = F.col("__raw") if self.fuzzy else self.find(F.col("__spanned"), self.bank)
        motif_spans = spans.clamp(motifs.spans(raw), F.length(text))
        pattern_spans = F.transform(F.col("__found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        found = F.when(F.col("__go_on"), patterns.matches(F.col(normalized), self.bank)) if include_matches else F.lit(None)
        none = F.create_map().cast("map<string,array<string>>")
        return df.select(
            *own,
            F.col("__score").alias("score"),
            F.create_map(*[x for c in by for x in (F.lit(c), F.col(f"__{c}"))]).alias("pattern_features"),
            F.when(F.col(text).isNotNull(), F.coalesce(found.cast("map<string,array<string>>"), none)).alias("matched_patterns"),
            F.when(F.col(text).isNotNull(), F.coalesce(spans.merge(F.concat(pattern_spans, motif_spans)), F.array().cast(_SPANS))).alias("matched_spans"),
        )


class Detector:
    """Normalizes, scores and flags texts.

    ``analyze`` adds (score, threshold, flagged, pattern_features, matched_patterns, matched_spans) to a
    table; spans are kept only for flagged texts, and for none without ``with_spans``. A null text has null results; an empty one scores 0.
    Columns of those names in the table are replaced.
    """

    RESULTS = ("score", "threshold", "flagged", "pattern_features", "matched_patterns", "matched_spans")

    def __init__(self, method: str | DetectionMethod | None = None, threshold: float | None = None, **options) -> None:
        """Without a ``method`` the token model if a ``model`` is given, else the heuristic."""
        method = method or ("token-model" if "model" in options else "heuristic")
        self.method = method if isinstance(method, DetectionMethod) else get_method(method, **options)
        own = self.method.default_threshold
        self.threshold = threshold if threshold is not None else own if own is not None else DEFAULT_THRESHOLD

    def analyze(self, df: DataFrame, text: str = "text", include_matches: bool = False, compatibility: bool = True, with_spans: bool = True) -> DataFrame:
        df = df.drop(*[c for c in self.RESULTS if c != text]).withColumn("__normalized", normalize(F.col(text), compatibility))
        scored = settle(self.method.transform(df, text, "__normalized", include_matches, self.threshold if with_spans else float("inf")).drop("__normalized").withColumnsRenamed({c: f"__r_{c}" for c in ("score", "pattern_features", "matched_patterns", "matched_spans")}), {c: F.col(f"__r_{c}") for c in ("score", "pattern_features", "matched_patterns", "matched_spans")})
        scored = scored.drop(*[f"__r_{c}" for c in ("score", "pattern_features", "matched_patterns", "matched_spans")])
        known = F.col(text).isNotNull()
        flagged = F.when(known, F.col("score") >= self.threshold)
        return scored.withColumns(
            {
                "score": F.when(known, F.col("score")), "threshold": F.when(known, F.lit(float(self.threshold))), "flagged": flagged,
                "pattern_features": F.when(known, F.col("pattern_features")), "matched_spans": F.when(flagged, F.col("matched_spans")).when(known, F.array().cast(_SPANS)),
            }
        )
