"""Embeddings of texts: a stable hash-based stand-in, and ONNX sentence models where files are given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384
Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(dimension: int = DIMENSION) -> Embedder:
    """Unit vectors that depend on the text alone, the same in every process."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.stack([np.random.default_rng(xxhash.xxh3_64_intdigest(t)).standard_normal(dimension) for t in texts]).astype(np.float32)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def onnx_embedder(model_path: str, tokenizer_path: str, max_tokens: int = 256) -> Embedder:
    """Masked mean of the token vectors of a sentence model, scaled to length 1. One session for each worker."""
    state: list = []

    def embed(texts: list[str]) -> np.ndarray:
        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.enable_truncation(max_tokens)
            tokenizer.enable_padding()
            state.extend([tokenizer, onnxruntime.InferenceSession(model_path)])
        encoded = state[0].encode_batch(texts)
        ids, mask = (np.array([getattr(e, a) for e in encoded], np.int64) for a in ("ids", "attention_mask"))
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        vectors = state[1].run(None, {i.name: known[i.name] for i in state[1].get_inputs()})[0]
        mean = (vectors * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)

    return embed


def embed_parts(parts: Column, embedder: Embedder, renormalize: bool = False) -> Column:
    """Element-wise maximum of the embeddings of an array of texts; null for none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            flat = [t for p in batch if p is not None for t in p]
            vectors, at, out = embedder(flat) if flat else None, 0, []
            for p in batch:
                n = 0 if p is None else len(p)
                pooled = vectors[at : at + n].max(0) if n else None
                if n and renormalize:
                    pooled = pooled / max(float(np.linalg.norm(pooled)), 1e-12)
                out.append(pooled)
                at += n
            yield pd.Series(out, dtype=object)

    return run(parts)


def embed(text: Column, embedder: Embedder) -> Column:
    """The embedding of each text; null stays null."""
    return embed_parts(F.when(text.isNotNull(), F.array(text)), embedder)


def chunks(text: Column, size: int = 200, overlap: int = 30) -> Column:
    """Texts of ``size`` words that overlap by ``overlap``; a short text is one chunk, as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap)), lambda k: F.array_join(F.slice(words, k, F.lit(size)), " "))
    return F.when(text.isNotNull(), F.when(n <= size, F.array(text)).otherwise(parts))
