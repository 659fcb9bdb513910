"""Quality of detection: ROC, operating points, confusion tables, worst cases.

A ROC curve is built from counts by distinct score, so what is sorted is the distinct scores
and not the rows. Scores are sorted within ``CELLS`` cells of the unit interval, and sums over the cells
above are added, so no task gets the scores of a whole table or of one large key. Every function takes rows of (label 1 or 0, score); null labels are left
out, a null score (a failed call) counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: False positive rates at which the true positive rate is reported.
TARGETS = (0.01, 0.005, 0.001, 0.0005)
#: Cells of scores; scores outside [0, 1] lie in the two outer ones.
CELLS = 256


def prepared(df: DataFrame, label: str = "label", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).select(*keys, F.col(label).cast("int").alias("label"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))


def roc_curve(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, tp, fp, positives, negatives) for each distinct score, counting rows with at least it."""
    by = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    cell = F.when(F.isnan("score"), CELLS + 1).otherwise(F.greatest(F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS)), F.lit(-1))).cast("int")
    by = by.withColumn("cell", cell)
    above = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    cells = by.groupBy(*keys, "cell").agg(F.sum("p").alias("cp"), F.sum("n").alias("cn")).select(  # at most CELLS + 3 rows for each key
        *keys, "cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("above_p"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("above_n"),
        F.sum("cp").over(whole).alias("positives"), F.sum("cn").over(whole).alias("negatives"),
    )
    down = Window.partitionBy(*keys, "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.select(*keys, "cell", "score", "p", "n", F.sum("p").over(down).alias("down_p"), F.sum("n").over(down).alias("down_n"))
    return ranked.join(cells, [*keys, "cell"]).select(
        *keys, "score", "p", "n", (F.col("down_p") + F.col("above_p")).alias("tp"), (F.col("down_n") + F.col("above_n")).alias("fp"), "positives", "negatives"
    )


def auc(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auc): the chance that a positive scores above a negative, ties half; NaN if a class is missing."""
    area = F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)), F.max("positives") * F.max("negatives").cast("double"))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return roc_curve(rows, keys).groupBy(*keys).agg(F.when(both, area).otherwise(F.lit(float("nan"))).alias("auc"))


def tpr_at_fpr(rows: DataFrame, targets: tuple[float, ...] = TARGETS, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fpr_target, tpr): the true positive rate at each false positive rate, interpolated linearly."""
    curve = roc_curve(rows, keys).withColumns({"f": F.try_divide("fp", "negatives"), "t": F.try_divide("tp", "positives")})
    # the point before is without the rows of this score
    curve = curve.withColumns({"f0": F.coalesce(F.try_divide(F.col("fp") - F.col("n"), "negatives"), F.lit(0.0)), "t0": F.coalesce(F.try_divide(F.col("tp") - F.col("p"), "positives"), F.lit(0.0))})
    points = curve.withColumn("fpr_target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    # of several points with the same rate, interpolation from the right takes the last, the highest one
    at = F.when(F.col("f") == F.col("fpr_target"), F.col("t")).when(
        (F.col("f0") < F.col("fpr_target")) & (F.col("fpr_target") < F.col("f")), F.col("t0") + (F.col("t") - F.col("t0")) * (F.col("fpr_target") - F.col("f0")) / (F.col("f") - F.col("f0"))
    )
    found = points.groupBy(*keys, "fpr_target").agg(F.max(at).alias("tpr"), F.max("positives").alias("p"), F.max("negatives").alias("n"))
    return found.select(*keys, "fpr_target", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("tpr")).otherwise(F.lit(float("nan"))).alias("tpr"))


def outcome(label: Column, score: Column, threshold: float) -> Column:
    """TP, FP, FN or TN of a row."""
    hit = score >= threshold
    return F.when((label == 1) & hit, "TP").when((label != 1) & hit, "FP").when(label == 1, "FN").otherwise("TN")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, count, tp, fp, tn, fn, precision, recall, f1); a ratio without denominator is 0."""
    kind = outcome(F.col("label"), F.col("score"), threshold)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("count"), *[F.count_if(kind == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def benchmark(df: DataFrame, threshold: float, label: str = "label", score: str = "score", targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """One row: auc, tpr_at_fpr, precision, recall, f1, threshold_used, num_samples, num_positive, num_negative."""
    rows = prepared(df, label, score)
    points = tpr_at_fpr(rows, targets).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.regexp_replace(F.format_string("%.6f", F.col("fpr_target") * 100), r"\.?0+$", ""), F.lit("%")).alias("key"), F.col("tpr").alias("value"))))).alias("tpr_at_fpr"))
    counts = confusion(rows, threshold).select("precision", "recall", "f1", F.lit(float(threshold)).alias("threshold_used"), F.col("count").alias("num_samples"), (F.col("tp") + F.col("fn")).alias("num_positive"), (F.col("fp") + F.col("tn")).alias("num_negative"))
    # three one-row tables side by side
    return auc(rows).withColumn("k", F.lit(1)).join(points.withColumn("k", F.lit(1)), "k").join(counts.withColumn("k", F.lit(1)), "k").drop("k")


def length_bucket(length: Column) -> Column:
    return F.when(length < 100, "short (<100)").when(length < 500, "medium (100-500)").when(length < 2000, "long (500-2000)").otherwise("very long (>2000)")


def coverage_bucket(has_patterns: Column, has_motifs: Column) -> Column:
    return F.when(has_patterns & has_motifs, "has_both").when(has_patterns, "has_patterns").when(has_motifs, "has_motifs").otherwise("has_neither")


def score_histogram(rows: DataFrame, threshold: float) -> DataFrame:
    """(bucket, count, mean_score, max_score, min_score) of the missed positives, in ten buckets."""
    missed = rows.filter((F.col("label") == 1) & (F.col("score") < threshold))
    return missed.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def worst(df: DataFrame, kind: str, threshold: float, key: str, n: int = 20) -> DataFrame:
    """The ``n`` missed positives with the highest scores ("FN"), or false alarms with the lowest ("FP"); ties by key."""
    found = df.filter(outcome(F.col("label"), F.col("score"), threshold) == kind)
    return found.orderBy(F.desc("score") if kind == "FN" else F.asc("score"), key).limit(n)
