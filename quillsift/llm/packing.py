"""Problem 6: fill containers of fixed capacity by minimum bin slack.

Only lengths matter for the filling, so the driver gets a histogram of at most ``capacity``
rows. Each step of the solver fills one container as closely as possible (a bitset
subset-sum over the remaining multiset of lengths, with backtracked counts) and repeats that
pattern as often as the counts allow, so the number of patterns depends on the capacity and
not on the number of items. Items then find their container by their rank among the items
of equal length, through a range lookup in the small pattern table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed pattern: a run of letters, digits and underscores, or a run of other non-blank characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def token_count(column):
    """Number of word-punct tokens of a string column; null stays null."""
    return F.regexp_count(column, F.lit(TOKEN)).cast("bigint")


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (repetitions, {length: items}) that use up ``histogram``.

    Each pattern holds the longest remaining length and, of all multisets of the remaining
    lengths, one whose sum is closest to the capacity; ties take longer lengths first.
    """
    left = {size: n for size, n in histogram.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        room = capacity - longest
        taken = {longest: 1}
        if room > 0:
            taken |= _closest({s: n - (s == longest) for s, n in left.items() if s <= room}, room, longest)
        times = min(left[s] // n for s, n in taken.items())
        patterns.append((times, taken))
        for s, n in taken.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return patterns


def _closest(counts: dict[int, int], room: int, longest: int) -> dict[int, int]:
    """Counts of lengths with the largest sum within ``room`` (with the one ``longest`` already in)."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted(counts, reverse=True):
        n, part = min(counts[size], room // size), 1
        while n > 0:
            take = min(part, n)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            n -= take
            part *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            total -= size * take
            taken[size] = taken.get(size, 0) + take
    if longest in taken:
        taken[longest] += 1
    return taken


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "size", rows_per_bucket: int = 2_000_000) -> DataFrame:
    """(id, piece, tokens, container): every item in a container, sums within ``capacity``.

    An item above the capacity is cut into full pieces and one remainder; no other item is
    split. Null and zero sizes need no room and get container null. Repeated (id, size) rows are
    items of their own only if their ids differ: ids must be unique. ``rows_per_bucket`` bounds a
    rank window, also for a length that a third of all items share.
    """
    spark: SparkSession = df.sparkSession
    sized = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))
    pieces = sized.select(
        "id",
        F.posexplode(
            F.when(F.col("size") > 0, F.concat(
                F.array_repeat(F.lit(capacity).cast("bigint"), (F.col("size") / capacity).cast("int")),
                F.when(F.col("size") % capacity > 0, F.array(F.col("size") % capacity)).otherwise(F.array().cast("array<bigint>")),
            )).otherwise(F.array(F.lit(0).cast("bigint")))
        ).alias("piece", "tokens"),
    )
    total = pieces.filter("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n"))
    histogram = {r.tokens: r.n for r in total.collect()}  # at most ``capacity`` rows
    rows, first, used = [], 0, dict.fromkeys(histogram, 0)
    for times, taken in fill(histogram, capacity):
        for size, n in taken.items():
            rows.append((size, used[size], used[size] + n * times, n, first))
            used[size] += n * times
        first += times
    patterns = spark.createDataFrame(rows, "tokens bigint, low bigint, high bigint, each bigint, first bigint")
    buckets = max(8, sum(histogram.values()) // rows_per_bucket + 1)
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    offsets = (
        salted.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
        .select("tokens", "bucket", (F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "piece")) - 1)
    placed = ranked.join(offsets, ["tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    p = F.broadcast(patterns.withColumnRenamed("tokens", "t"))  # a few rows for each length up to the capacity
    return placed.join(p, (F.col("tokens") == F.col("t")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select(
        "id", "piece", "tokens", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("bigint").alias("container")
    )
