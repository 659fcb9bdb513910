"""Benchmark of detection methods over a labelled table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.operators import metrics
from quillsift.operators.detector import Detector
from quillsift.sources import sinks


def run_method(df: DataFrame, name: str, threshold: float | None = None, text: str = "text", label: str = "label", **options) -> dict:
    """Scores all rows and computes the metrics in one job; a null text counts as a failed call with score 0."""
    began = time.perf_counter()
    try:
        detector = Detector(name, threshold, **options)
        scored = detector.analyze(df, text)
        row = metrics.benchmark(scored, detector.threshold, label).join(scored.agg(F.count_if(F.col("score").isNull()).alias("errors")).hint("broadcast")).head()
    except Exception as x:  # a method that fails is a row of the report and does not end the run
        return {"method": name, "mode": "", "metrics": None, "runtime_seconds": time.perf_counter() - began, "num_samples": 0, "num_errors": 0, "error": f"{type(x).__name__}: {x}"}
    found = row.asDict(recursive=True)
    errors = found.pop("errors")
    return {"method": name, "mode": detector.method.mode, "threshold": detector.threshold, "metrics": found, "runtime_seconds": round(time.perf_counter() - began, 3), "num_samples": found["num_samples"], "num_errors": errors, "error": None}


def run_benchmark(df: DataFrame, methods: list[str], threshold: float | None = None, directory: str | None = None, **options) -> list[dict]:
    """Results of all methods; written below ``directory`` if one is given."""
    results = [run_method(df, m, threshold, **options) for m in methods]
    if directory:
        sinks.save_results(df.sparkSession, results, directory)
    return results
