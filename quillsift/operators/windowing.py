"""Two-phase window analysis of long texts: coarse windows, hotspots, fine windows, batches.

Windows become rows, each of which is matched on its own text; hotspots are islands of
suspicious windows. Only texts that need it should be sent here. ``hot_regions`` is the coarse phase
inside a row, by which the forest with an embedder chooses what to embed of texts of more than 4096 characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import motifs
from quillsift.functions.binding import let, settle
from quillsift.operators import spans
from quillsift.sources.config import Bank

HOTSPOT = "array<struct<start:int,end:int,peak_score:double>>"
REGIONS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Sizes:
    """Window sizes and steps, in characters, and limits."""

    coarse_window: int = 4096
    coarse_step: int = 2048
    fine_window: int = 512
    fine_step: int = 256
    hotspot_threshold: float = 0.3
    batch_max_size: int = 1024
    batch_gap_tolerance: int = 256


def fixed_sizes(sizes: Sizes) -> dict[str, Column]:
    """The same sizes for every text."""
    return {c: F.lit(getattr(sizes, c)) for c in ("coarse_window", "coarse_step", "fine_window", "fine_step")}


def adaptive_sizes(length: Column, sizes: Sizes = Sizes()) -> dict[str, Column]:
    """Sizes by the length of the text: one window for up to 1024, wider coarse windows beyond 16384."""
    short, long, n = length <= 1024, length > 16384, F.greatest(length, F.lit(1))
    wide = F.least(F.lit(8192), F.floor(length / 4).cast("int"))
    half = F.floor(n / 2).cast("int")
    return {
        "coarse_window": F.when(short, n).when(long, wide).otherwise(sizes.coarse_window),
        "coarse_step": F.when(short, n).when(long, F.greatest(F.lit(1), F.floor(wide / 2).cast("int"))).otherwise(sizes.coarse_step),
        "fine_window": F.when(short, F.least(F.lit(512), n)).otherwise(sizes.fine_window),
        "fine_step": F.when(short, F.greatest(F.lit(1), F.least(F.lit(256), half))).otherwise(sizes.fine_step),
    }


def window_score(density: Column, scores: Column) -> Column:
    """0.4 density (full at 5) + 0.3 coverage (full at 3 categories) + 0.3 mean category score."""
    n = F.size(scores)
    mean = F.when(n > 0, motifs.total_score(scores) / (n * 100.0)).otherwise(0.0)
    return F.least(density / 5, F.lit(1.0)) * 0.4 + F.least(n / 3.0, F.lit(1.0)) * 0.3 + mean * 0.3


def _window_starts(length: Column, size: Column, step: Column) -> Column:
    """Starts of the windows: one for texts of up to 50 characters, none for empty ones; tails under 20 are skipped."""
    every = F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), step), lambda s: F.least(s + size, length) - s >= 20)
    return F.when(length <= 0, F.array().cast("array<int>")).when(length <= 50, F.array(F.lit(0))).otherwise(every)


def _scored(df: DataFrame, keys: list[str], bank: Bank) -> DataFrame:
    """Rows of (keys, base, start, end, window) with the motif signal of each window."""
    found = settle(df, {"__m": motifs.matches(F.col("window"), bank)})
    found = settle(found, {"density": motifs.signal_density(F.col("window"), F.col("__m")), "__scores": motifs.category_scores(F.col("__m"), list(bank.motifs))})
    return found.select(*keys, "start", "end", F.size("__m").alias("matches"), "density", window_score(F.col("density"), F.col("__scores")).alias("score"))


def windows(df: DataFrame, key: str, text: str, size: Column, step: Column, bank: Bank) -> DataFrame:
    """(key, start, end, matches, density, score) of the windows of each text. Null texts have none."""
    length = F.length(text)
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__t"), size.cast("int").alias("__size"), length.alias("__n"), F.explode(_window_starts(length, size.cast("int"), step.cast("int"))).alias("start"))
    rows = rows.withColumn("end", F.when(F.col("__n") <= 50, F.col("__n")).otherwise(F.least(F.col("start") + F.col("__size"), F.col("__n"))))
    return _scored(rows.withColumn("window", F.expr("substring(__t, start + 1, end - start)")), [key], bank)


def hotspots(scored: DataFrame, key: str, gap: Column, threshold: float = 0.3) -> DataFrame:
    """(key, start, end, peak_score): windows over the threshold, joined while the gap to the last one is small enough."""
    w = Window.partitionBy(key).orderBy("start")
    hot = scored.filter(F.col("score") >= threshold).withColumn("__gap", gap)
    marked = hot.withColumn("__new", F.coalesce((F.col("start") - F.lag("end").over(w) > F.col("__gap")).cast("int"), F.lit(1)))
    islands = marked.withColumn("__island", F.sum("__new").over(w))
    return islands.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.max("score").alias("peak_score")).drop("__island")


def fine_windows(df: DataFrame, spots: DataFrame, key: str, text: str, size: Column, step: Column, bank: Bank) -> DataFrame:
    """(key, hotspot, start, end, matches, density, score): windows of each hotspot with half a window on either side."""
    texts = df.select(F.col(key), F.col(text).alias("__t"), size.cast("int").alias("__size"), step.cast("int").alias("__step"))
    return _fine_of(texts.join(spots.select(key, F.col("start").alias("__s"), F.col("end").alias("__e")), key), key, bank)


def fine_rows(df: DataFrame, key: str, text: str, bank: Bank, sizes: Sizes = Sizes()) -> DataFrame:
    """The same for the hotspots of the texts themselves, found in the row, so that no text is shuffled."""
    found = settle(df.select(F.col(key), F.col(text).alias("__t")), {"__h": hot_spots(F.col("__t"), bank, fixed_sizes(sizes), sizes.hotspot_threshold)})
    rows = found.select(key, "__t", F.lit(sizes.fine_window).alias("__size"), F.lit(sizes.fine_step).alias("__step"), F.explode("__h").alias("__h"))
    return _fine_of(rows.withColumns({"__s": F.col("__h.start"), "__e": F.col("__h.end")}), key, bank)


def _fine_of(joined: DataFrame, key: str, bank: Bank) -> DataFrame:
    half = F.floor(F.col("__size") / 2).cast("int")
    region = joined.withColumn("__from", F.greatest(F.lit(0), F.col("__s") - half)).withColumn("__to", F.least(F.length("__t"), F.col("__e") + half))
    region = region.withColumn("__n", F.col("__to") - F.col("__from"))
    rows = region.withColumn("__at", F.explode(_window_starts(F.col("__n"), F.col("__size"), F.col("__step"))))
    rows = rows.withColumn("start", F.col("__from") + F.col("__at"))
    rows = rows.withColumn("end", F.when(F.col("__n") <= 50, F.col("__to")).otherwise(F.least(F.col("start") + F.col("__size"), F.col("__to"))))
    return _scored(rows.withColumn("window", F.expr("substring(__t, start + 1, end - start)")).withColumnRenamed("__s", "hotspot"), [key, "hotspot"], bank)


def batch(spots: Column, max_size: int = 1024, gap_tolerance: int = 256) -> Column:
    """Regions of an array of hotspots by start: joined if close and together no larger than the limit."""
    ordered = F.array_sort(F.transform(spots, lambda h: F.struct(h["start"].cast("int").alias("start"), h["end"].cast("int").alias("end"))))

    fits = lambda last, h: (h["start"] - last["end"] <= gap_tolerance) & (h["end"] - last["start"] <= max_size)
    return spans.joined(ordered, fits, _up_to, REGIONS[len("array<") : -1])


def _up_to(last: Column, h: Column) -> Column:
    return F.struct(last["start"].alias("start"), h["end"].alias("end"))


def analyze(df: DataFrame, key: str, text: str, bank: Bank, sizes: Sizes = Sizes(), adaptive: bool = False, min_score: float = 0.0) -> DataFrame:
    """(key, hotspots, regions, region_texts) of each text with a hotspot of at least ``min_score``."""
    by = adaptive_sizes(F.length("__t"), sizes) if adaptive else fixed_sizes(sizes)
    found = settle(df.select(F.col(key), F.col(text).alias("__t")), {"hotspots": hot_spots(F.col("__t"), bank, by, sizes.hotspot_threshold)})
    regions = batch(F.col("hotspots"), sizes.batch_max_size, sizes.batch_gap_tolerance)
    peak = lambda r: F.array_max(F.transform(F.filter("hotspots", lambda h: (h["start"] >= r["start"]) & (h["end"] <= r["end"])), lambda h: h["peak_score"]))
    found = settle(found, {"regions": F.filter(regions, lambda r: F.coalesce(peak(r), F.lit(0.0)) >= min_score) if min_score > 0 else regions})
    texts = F.transform("regions", lambda r: F.substring(F.col("__t"), r["start"] + 1, r["end"] - r["start"]))
    return found.filter(F.size("regions") > 0).select(key, "hotspots", "regions", texts.alias("region_texts"))


SPOTS = "struct<start:int,end:int,peak_score:double>"


def hot_spots(text: Column, bank: Bank, by: dict[str, Column], threshold: float) -> Column:
    """The hotspots (start, end, peak_score) of one text as an array, without a shuffle. Null stays null."""
    n, size, step = F.length(text), by["coarse_window"].cast("int"), by["coarse_step"].cast("int")

    def scored(start: Column) -> Column:
        end = F.when(n <= 50, n).otherwise(F.least(start + size, n))
        window = F.substring(text, start + 1, end - start)
        score = let(motifs.matches(window, bank), lambda m: window_score(motifs.signal_density(window, m), motifs.category_scores(m, list(bank.motifs))))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("peak_score"))

    hot = F.filter(F.transform(_window_starts(n, size, step), scored), lambda w: w["peak_score"] >= threshold)
    together = lambda last, h: F.struct(last["start"].alias("start"), h["end"].alias("end"), F.greatest(last["peak_score"], h["peak_score"]).alias("peak_score"))
    return F.when(text.isNotNull(), spans.joined(hot, lambda last, h: h["start"] - last["end"] <= step, together, SPOTS))


def hot_regions(text: Column, bank: Bank, sizes: Sizes = Sizes()) -> Column:
    """The regions of ``analyze`` as an array column of one text; empty where there is no hotspot."""
    return batch(hot_spots(text, bank, fixed_sizes(sizes), sizes.hotspot_threshold), sizes.batch_max_size, sizes.batch_gap_tolerance)
