"""Interval algebra over spans: per document as arrays (no shuffle), or over rows of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.binding import let
from quillsift.sources import fixed

HEAT = "array<struct<start:int,end:int,heat:double,category:string,sources:array<string>>>"


_SPAN = "struct<start:int,end:int>"


def joined(items: Column, near: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], shape: str) -> Column:
    """Neighbours of an array of structs ``shape`` joined where ``near`` holds between the joined ones so far and the next.

    One struct is open at a time; the array of results is copied only when one is closed.
    """
    state = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
    closed = lambda acc: F.concat(acc["out"], F.array(acc["held"]))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["held"].isNull(), state(x, acc["out"])).when(near(acc["held"], x), state(join(acc["held"], x), acc["out"])).otherwise(state(x, closed(acc)))

    start = state(F.lit(None).cast(shape), F.array().cast(f"array<{shape}>"))
    return F.aggregate(items, start, step, lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(closed(acc)))


def _plain(spans: Column, start: str = "start", end: str = "end") -> Column:
    """(start, end) structs of integers, in order."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s[start].cast("int").alias("start"), s[end].cast("int").alias("end"))))


def _together(last: Column, s: Column) -> Column:
    return F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))


def merge(spans: Column) -> Column:
    """Overlapping or touching (start, end) structs of an array merged, by start; null stays null."""
    return joined(_plain(spans), lambda last, s: s["start"] <= last["end"], _together, _SPAN)


def merge_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the same over rows, by gaps and islands; for spans too many for one array."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*keys, start, end).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def clamp(spans: Column, length: Column) -> Column:
    """Spans cut to [0, length]."""
    return F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], length).alias("end")))


def _weight(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.HEAT_WEIGHTS.items() for x in pair])
    return F.coalesce(table[category], F.lit(1.0))


def heat(pattern_spans: Column, motif_matches: Column) -> Column:
    """Merged spans with heat, dominant category and sources.

    A pattern has the weight of its category, a motif that times its score; unknown categories weigh
    1. A merged span has the highest heat, of equal ones the category that comes first.
    """
    a = F.transform(pattern_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("o"), _weight(s["category"]).alias("heat"), s["category"].alias("category"), F.array(F.lit("pattern")).alias("sources")))
    b = F.transform(
        motif_matches,
        lambda m: F.struct(
            m["position"].alias("start"), (m["position"] + m["length"]).alias("end"), F.lit(1).alias("o"), (_weight(m["category"]) * m["score"] / 100.0).alias("heat"), m["category"].alias("category"), F.array(F.lit("motif")).alias("sources")
        ),
    )
    # a stable sort by (start, end): patterns before motifs, each in their own order
    indexed = F.transform(F.concat(a, b), lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("k"), s["heat"].alias("heat"), s["category"].alias("category"), s["sources"].alias("sources")))
    out = lambda start, end, h, c, src: F.struct(start.alias("start"), end.alias("end"), h.alias("heat"), c.alias("category"), src.alias("sources"))

    def together(last: Column, s: Column) -> Column:
        return out(
            last["start"], F.greatest(last["end"], s["end"]), F.greatest(last["heat"], s["heat"]),
            F.when(last["heat"] >= s["heat"], last["category"]).otherwise(s["category"]), F.array_sort(F.array_union(last["sources"], s["sources"])),
        )

    ordered = F.transform(F.array_sort(indexed), lambda s: out(s["start"], s["end"], s["heat"], s["category"], s["sources"]))
    return joined(ordered, lambda last, s: s["start"] <= last["end"], together, HEAT[len("array<") : -1])


def hot(heat_spans: Column, threshold: float = 1.5) -> Column:
    """Spans of at least the threshold."""
    return F.filter(heat_spans, lambda s: s["heat"] >= threshold)


def token_spans_above(tokens: Column, probabilities: Column, threshold: float = 0.5) -> Column:
    """(start, end) of each run of tokens with a probability above the threshold (strictly)."""
    zipped = F.slice(F.arrays_zip(tokens.alias("t"), probabilities.alias("p")), F.lit(1), F.least(F.size(tokens), F.size(probabilities)))
    placed = F.transform(zipped, lambda x, k: F.struct(x["t"]["start"].cast("int").alias("start"), x["t"]["end"].cast("int").alias("end"), k.alias("k"), x["p"].alias("p")))
    hits = F.transform(F.filter(placed, lambda x: x["p"] > threshold), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k")))
    runs = joined(hits, lambda last, x: x["k"] == last["k"] + 1, lambda last, x: F.struct(last["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k")), "struct<start:int,end:int,k:int>")
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def virtual_text(texts: Column) -> Column:
    """Entry texts joined by line breaks."""
    return F.array_join(texts, "\n")


def virtual_offsets(texts: Column) -> Column:
    """Where each entry begins in the virtual text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(texts, start, lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def map_span(entries: Column, offsets: Column, start: Column, end: Column) -> Column:
    """Byte spans (byte_start, byte_end, entry_index, path) of the entries that a virtual span touches; separators drop out."""
    indexed = F.transform(F.arrays_zip(entries.alias("e"), offsets.alias("v")), lambda x, k: F.struct(x["e"].alias("e"), x["v"].alias("v"), k.alias("k")))
    touched = F.filter(indexed, lambda x: (F.greatest(start, x["v"]) < F.least(end, x["v"] + F.length(x["e"]["text"]))))

    def octets(text: Column, upto: Column) -> Column:
        return F.octet_length(F.substring(text, F.lit(1), upto))

    return F.transform(
        touched,
        lambda x: F.struct(
            (x["e"]["byte_offset"] + octets(x["e"]["text"], F.greatest(start, x["v"]) - x["v"])).cast("int").alias("byte_start"),
            (x["e"]["byte_offset"] + octets(x["e"]["text"], F.least(end - x["v"], F.length(x["e"]["text"])))).cast("int").alias("byte_end"),
            x["k"].alias("entry_index"), x["e"]["path"].alias("path"),
        ),
    )


def redact(raw: Column, byte_spans: Column) -> Column:
    """``raw`` (binary) with the bytes of the spans (byte_start, byte_end) replaced by as many stars.

    Spans are merged first; what lies between them is cut out once and put together in one go.
    """
    merged = joined(_plain(byte_spans, "byte_start", "byte_end"), lambda last, s: s["start"] <= last["end"], _together, _SPAN)

    def written(m: Column) -> Column:
        end_before = lambda k: F.when(k > 0, F.get(m, k - 1)["end"]).otherwise(0)
        piece = lambda s, k: F.concat(F.hex(F.substring(raw, end_before(k) + 1, s["start"] - end_before(k))), F.repeat(F.lit("2A"), s["end"] - s["start"]))
        return F.unhex(F.concat(F.array_join(F.transform(m, piece), ""), F.hex(F.substring(raw, end_before(F.size(m)) + 1, F.octet_length(raw)))))

    return let(merged, written)
