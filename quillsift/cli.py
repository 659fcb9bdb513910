"""Command line: python -m quillsift.cli --data TABLE --method heuristic --split test."""

from __future__ import annotations

import argparse

from quillsift.functions.embed import onnx_embedder
from quillsift.operators.detector import list_methods
from quillsift.plans.benchmark import run_benchmark
from quillsift.runtime import session
from quillsift.sources import sinks
from quillsift.sources.datasets import labelled_texts


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Benchmark of detection methods over a labelled Parquet table")
    p.add_argument("--data", required=True, help="table with row_id, split, text, label, language")
    p.add_argument("--method", action="append", choices=list_methods(), help="may be repeated; heuristic by default")
    p.add_argument("--split", default="test")
    p.add_argument("--limit", type=int)
    p.add_argument("--threshold", type=float)
    p.add_argument("--output-dir", default="benchmarks")
    p.add_argument("--no-save", action="store_true")
    p.add_argument("--embedder", help="folder with model.onnx and tokenizer.json, for the methods that embed regions")
    p.add_argument("--no-embeddings", action="store_true", help="patterns and motifs alone, also where an embedder is named")
    a = p.parse_args(arguments)
    rows = labelled_texts(session(), a.data, a.split, a.limit)
    embedder = onnx_embedder(f"{a.embedder}/model.onnx", f"{a.embedder}/tokenizer.json") if a.embedder and not a.no_embeddings else None
    results = [r for m in a.method or ["heuristic"] for r in run_benchmark(rows, [m], a.threshold, None if a.no_save else a.output_dir, **({"embedder": embedder} if embedder and m == "forest" else {}))]
    print(sinks.format_table(results))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
