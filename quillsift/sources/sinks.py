"""Results of benchmark runs, as files and as a table in text."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

COLUMNS = (("TPR@1%", "1%"), ("TPR@0.5%", "0.5%"), ("TPR@0.1%", "0.1%"), ("TPR@0.05%", "0.05%"))


RESULT = "run timestamp, split string, mode string, threshold double, samples bigint, errors bigint, seconds double, metrics string, error string, method string"


def save_results(spark: SparkSession, results: list[dict], directory: str) -> None:
    """Adds a row for each result to the JSON table ``directory``, with a folder for each method."""
    now, rows = datetime.now(UTC), []
    for r in results:
        measured = json.dumps(r["metrics"]) if r.get("metrics") else None
        rows.append((now, r.get("split"), r.get("mode"), r.get("threshold"), r.get("num_samples"), r.get("num_errors"), r.get("runtime_seconds"), measured, r.get("error"), r["method"]))
    spark.createDataFrame(rows, RESULT).repartition("method").write.mode("append").partitionBy("method").json(directory)


def format_table(results: list[dict]) -> str:
    """One line for each run; a failed run shows dashes and its error."""
    head = ["Method", "Mode", "AUC", *(name for name, _ in COLUMNS), "P", "R", "F1", "Time"]
    rows = [head]
    for r in results:
        m = r.get("metrics")
        if m is None:
            rows.append([r["method"], "(error)", *["—"] * 8, f"{r.get('runtime_seconds', 0):.1f}s  {r.get('error', '')}"])
            continue
        shares = [f"{m['tpr_at_fpr'].get(key, 0):.3f}" for _, key in COLUMNS]
        rows.append([r["method"], r["mode"], f"{m['auc']:.3f}", *shares, *(f"{m[k]:.2f}" for k in ("precision", "recall", "f1")), f"{r['runtime_seconds']:.1f}s"])
    widths = [max(len(row[k]) for row in rows) for k in range(len(head))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in rows]
    return "\n".join([lines[0], "-" * sum(widths, 2 * len(widths) - 2), *lines[1:]])


def write_analysis(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes analyzed documents as Parquet or JSON files."""
    df.write.mode("overwrite").format(kind).save(path)
