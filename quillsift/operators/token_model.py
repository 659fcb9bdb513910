"""Linear-chain token model (labels O and I): training on a bounded sample, inference over tables.

Features are made on the JVM and hashed there, so Python gets arrays of integers only; forward and
backward passes run over whole Arrow batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import motifs, patterns, tokens
from quillsift.functions.binding import settle
from quillsift.operators import spans
from quillsift.operators.detector import DetectionMethod, register_method
from quillsift.runtime import hash_sample
from quillsift.sources.config import Bank

#: Hashed features, and documents that the model is trained on at most (chosen by a hash of the text).
FEATURES, SAMPLE = 1 << 18, 4000
#: Injections that are put between benign texts at most.
SANDWICHES = 2000


def hashed(feature_maps: Column, flags: Column) -> Column:
    """Array of the feature numbers of each token; the flags of the document go to every token."""
    number = lambda k, v: F.pmod(F.xxhash64(k, v), F.lit(FEATURES)).cast("int")
    common = F.transform(F.map_entries(flags), lambda e: number(e["key"], e["value"]))
    return F.transform(feature_maps, lambda m: F.concat(F.transform(F.map_entries(m), lambda e: number(e["key"], e["value"])), common))


@dataclass
class TokenModel:
    """Weights of the features for label I against O, and of the transitions [from, to]."""

    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, documents: list[list[np.ndarray]]) -> list[np.ndarray]:
        """P(I) of every token of every document."""
        emission = [np.array([self.weights[f].sum() for f in d], np.float64) for d in documents]
        return _forward_backward(emission, self.transitions)[0]

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table of non-zero weights and the transitions."""
        used = np.flatnonzero(self.weights)
        rows = [("w", int(k), float(self.weights[k])) for k in used] + [("t", k, float(x)) for k, x in enumerate(self.transitions.ravel())]
        spark.createDataFrame(rows, "kind string, number int, value double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TokenModel:
        weights, transitions = np.zeros(FEATURES), np.zeros(4)
        for r in spark.read.parquet(path).collect():
            (weights if r.kind == "w" else transitions)[r.number] = r.value
        return cls(weights, transitions.reshape(2, 2))


def _forward_backward(emission: list[np.ndarray], transitions: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(P(I) of each token, expected transitions of each document, log partition of all), padded to one block."""
    if not emission:
        return [], [], 0.0
    lengths = np.array([len(e) for e in emission])
    size, longest = len(emission), int(lengths.max(initial=0))
    e = np.zeros((longest, size, 2))
    for k, x in enumerate(emission):
        e[: len(x), k, 1] = x
    live = np.arange(longest)[:, None] < lengths
    forward, backward = np.zeros((longest, size, 2)), np.zeros((longest, size, 2))
    for t in range(longest):
        if t == 0:
            forward[t] = e[t]
        else:
            step = np.logaddexp(forward[t - 1, :, :1] + transitions[0], forward[t - 1, :, 1:] + transitions[1]) + e[t]
            forward[t] = np.where(live[t][:, None], step, forward[t - 1])
    z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1]) if longest else np.zeros(size)
    for t in range(longest - 2, -1, -1):
        after = e[t + 1] + backward[t + 1]
        step = np.logaddexp(after[:, :1] + transitions[:, 0], after[:, 1:] + transitions[:, 1])
        backward[t] = np.where(live[t + 1][:, None], step, 0.0)
    p = np.exp(forward[..., 1] + backward[..., 1] - z)
    pairs = np.zeros((size, 2, 2))
    if longest > 1:
        joint = forward[:-1, :, :, None] + transitions + (e[1:] + backward[1:])[:, :, None, :] - z[:, None, None]
        pairs = (np.exp(joint) * live[1:, :, None, None]).sum(0)
    return [p[: lengths[k], k] for k in range(size)], list(pairs), float(z.sum())


class _Likelihood:
    """Negative log likelihood of labelled documents with its gradient, over the features that occur, and the transitions last."""

    def __init__(self, documents: list[tuple[list[np.ndarray], np.ndarray]], l2: float) -> None:
        documents = sorted((d for d in documents if d[0]), key=lambda d: len(d[0]))  # of like length in one block
        self.labels = [y for _, y in documents]
        self.ends = np.cumsum([len(d) for d, _ in documents])
        per_token = np.array([len(f) for d, _ in documents for f in d], np.int64)
        number = np.concatenate([f for d, _ in documents for f in d]) if len(per_token) else np.zeros(0, np.int64)
        self.used, self.number = np.unique(number, return_inverse=True)
        self.token, self.l2 = np.repeat(np.arange(len(per_token)), per_token), l2
        self.seen = sum((np.histogram2d(y[:-1], y[1:], bins=[[-0.5, 0.5, 1.5]] * 2)[0] for y in self.labels), np.zeros((2, 2)))

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, transitions = x[:-4], x[-4:].reshape(2, 2)
        emission = np.bincount(self.token, weights[self.number], int(self.ends[-1]) if len(self.ends) else 0)
        parts = np.split(emission, self.ends[:-1]) if len(self.ends) else []
        loss, error, pairs = 0.0, [], np.zeros((2, 2))
        for at in range(0, len(parts), 64):
            p, expected, z = _forward_backward(parts[at : at + 64], transitions)
            pairs += sum(expected, np.zeros((2, 2)))
            loss += z
            error += [q - y for q, y in zip(p, self.labels[at : at + 64])]
        loss -= sum(float(e @ y) for e, y in zip(parts, self.labels)) + float((self.seen * transitions).sum())
        gradient = np.bincount(self.number, np.concatenate(error)[self.token], len(self.used)) if error else np.zeros(len(self.used))
        whole = np.concatenate([gradient, (pairs - self.seen).ravel()]) + 2 * self.l2 * x
        return loss + self.l2 * float(x @ x), whole


def _minimized(f, x: np.ndarray, l1: float, iterations: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Minimum of ``f`` + ``l1`` |x| by limited-memory quasi-Newton steps inside orthants (Andrew and Gao 2007)."""

    def slope(x, g):
        at_zero = np.sign(g) * np.maximum(np.abs(g) - l1, 0)
        return np.where(x != 0, g + l1 * np.sign(x), at_zero)

    value, g = f(x)
    total, pairs = value + l1 * np.abs(x).sum(), []
    for _ in range(iterations):
        d = slope(x, g)
        if np.abs(d).max(initial=0) < tolerance:
            break
        q, kept = d.copy(), []
        for s, y, r in reversed(pairs):
            kept.append(r * (s @ q))
            q -= kept[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), k in zip(pairs, reversed(kept)):
            q += (k - r * (y @ q)) * s
        step = np.where(q * d > 0, -q, 0.0)
        orthant, size = np.where(x != 0, np.sign(x), -np.sign(d)), 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(d))
        for _ in range(25):
            moved = x + size * step
            moved[moved * orthant < 0] = 0.0
            after, h = f(moved)
            now = after + l1 * np.abs(moved).sum()
            if now <= total + 1e-4 * float(d @ (moved - x)):
                break
            size /= 2
        else:
            break
        s, y = moved - x, h - g
        if s @ y > 1e-10:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        small = total - now < tolerance * 1e-2 * max(1.0, abs(total))
        x, g, total = moved, h, now
        if small:
            break
    return x


def fit(documents: list[tuple[list[np.ndarray], np.ndarray]], l1: float = 0.1, l2: float = 0.1, iterations: int = 60) -> TokenModel:
    """A model from (features of each token, 1 for I or 0) by limited-memory quasi-Newton steps with both penalties."""
    likelihood = _Likelihood(documents, l2)
    x = _minimized(likelihood, np.zeros(len(likelihood.used) + 4), l1, iterations)
    weights = np.zeros(FEATURES)
    weights[likelihood.used] = x[:-4]
    return TokenModel(weights, x[-4:].reshape(2, 2))


def fit_online(documents: list[tuple[list[np.ndarray], np.ndarray]], l1: float = 0.1, l2: float = 0.1, epochs: int = 12, rate: float = 0.3, seed: int = 42) -> TokenModel:
    """The same by ``epochs`` of adaptive gradient steps with shrinkage, which stop short of the optimum."""
    weights, transitions = np.zeros(FEATURES), np.zeros((2, 2))
    seen_w, seen_t, rng = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8), np.random.default_rng(seed)
    n = max(1, len(documents))
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), 32):
            part = [documents[k] for k in order[at : at + 32]]
            p, pairs, _ = _forward_backward([np.array([weights[f].sum() for f in d]) for d, _ in part], transitions)
            number = np.concatenate([f for d, _ in part for f in d])
            error = np.concatenate([np.repeat(q - y, [len(f) for f in d]) for (d, y), q in zip(part, p)])
            used, inverse = np.unique(number, return_inverse=True)
            gradient = np.bincount(inverse, error, len(used)) + l2 * weights[used] * len(part) / n
            seen_w[used] += gradient**2
            step = rate / np.sqrt(seen_w[used])
            moved = weights[used] - step * gradient
            weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 * len(part) / n, 0)
            counted = sum((np.histogram2d(y[:-1], y[1:], bins=[[-0.5, 0.5, 1.5]] * 2)[0] for _, y in part), np.zeros((2, 2)))
            gradient_t = sum(pairs) - counted + l2 * transitions * len(part) / n
            seen_t += gradient_t**2
            transitions = transitions - rate / np.sqrt(seen_t) * gradient_t
    return TokenModel(weights, transitions)


def featured(df: DataFrame, text: str, bank: Bank) -> DataFrame:
    """``df`` with __tokens and __features (hashed) of the text."""
    flags = patterns.densities(F.col(text), bank, F.col("__low"))
    df = settle(df.withColumn("__tokens", tokens.tokenize(F.col(text))), {"__low": patterns.folded(F.col(text))})
    df = settle(df, {f"__d_{c}": d for c, d in flags.items()})
    df = settle(df, {"__features": hashed(tokens.features(F.col("__tokens")), tokens.document_flags({c: F.col(f"__d_{c}") for c in flags}))})
    return df.drop("__low", *[f"__d_{c}" for c in flags])


def train(df: DataFrame, text: str, label: str, bank: Bank, sample: int = SAMPLE, augment: bool = True, **options) -> TokenModel:
    """A model from documents with a label (1 injection, 0 benign), with weak labels for their tokens.

    Trained on at most ``sample`` documents; with ``augment`` injections are used again between benign
    texts. Null texts and labels are left out. ``options`` go to ``fit``, or to ``fit_online`` where they name ``epochs``.
    """
    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), (F.col(label) == 1).alias("y"))
    rows = hash_sample(rows, "t", sample, distinct=True)
    found = patterns.categorized_spans(bank)
    own = featured(rows, "t", bank).withColumns({"__p": found(F.col("t")), "__x": tokens.injection_spans(F.col("t"))})
    own = settle(own, {"__m": tokens.spans_of(bank, motifs.matches(F.col("t"), bank))})
    labelled = own.select("__features", tokens.weak_labels(F.col("__tokens"), F.col("y"), F.col("__x"), F.col("__p"), F.col("__m")).alias("labels"))
    if augment:
        put = rows.filter(F.col("y") & (F.length(F.trim("t")) > 10)).limit(SANDWICHES).select(tokens.sandwich(F.col("t"), F.col("t")).alias("s")).select("s.*")
        more = featured(put, "text", bank)
        labelled = labelled.unionByName(more.select("__features", tokens.region_labels(F.col("__tokens"), F.col("start"), F.col("end")).alias("labels")))
    documents = [([np.array(f) for f in r[0]], np.array([x == "I" for x in r[1]], float)) for r in labelled.filter("labels is not null").collect()]
    return (fit_online if "epochs" in options else fit)(documents, **options)


def marginals(features: Column, model: TokenModel) -> Column:
    """Array of P(I) of the tokens. Null stays null."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(batches: pd.Series) -> pd.Series:
        out: list = [None] * len(batches)
        there = [k for k, d in enumerate(batches) if d is not None]
        order = sorted(there, key=lambda k: len(batches.iloc[k]))
        for at in range(0, len(order), 64):  # documents of like length are padded together
            part = order[at : at + 64]
            for k, p in zip(part, sent.value.marginals([list(batches.iloc[k]) for k in part])):
                out[k] = p
        return pd.Series(out, dtype=object)

    return score(features)


@register_method("token-model")
class TokenModelMethod(DetectionMethod):
    """Score by noisy-or over the tokens; spans are the runs of tokens above the span threshold.

    Probabilities are of the normalized tokens but lie on those of the raw text.
    """

    default_threshold = 0.89
    mode = "token-model"

    def __init__(self, model: TokenModel | None = None, languages: list[str] | None = None, directories: list[str] | None = None, span_threshold: float = 0.5, certain: bool = False) -> None:
        if model is None:
            raise ValueError("The token model needs a trained model; see quillsift.operators.token_model.train")
        self.model, self.bank, self.span_threshold, self.certain = model, Bank.load(languages, directories), span_threshold, certain

    def transform(self, df: DataFrame, text: str, normalized: str, include_matches: bool = False, least: float = 0.0) -> DataFrame:
        own = df.columns
        df = featured(df, normalized, self.bank).withColumn("__p", marginals(F.col("__features"), self.model)).withColumn("__raw", tokens.tokenize(F.col(text)))
        some = F.size("__p") > 0
        mean = F.aggregate("__p", F.lit(0.0), lambda a, p: a + p) / F.size("__p")
        return df.select(
            *own,
            F.when(some, tokens.noisy_or(F.col("__p"), self.certain)).otherwise(0.0).alias("score"),
            F.create_map(F.lit("crf_max_marginal"), F.coalesce(F.array_max("__p"), F.lit(0.0)), F.lit("crf_mean_marginal"), F.when(some, mean).otherwise(0.0)).alias("pattern_features"),
            F.create_map().cast("map<string,array<string>>").alias("matched_patterns"),
            spans.token_spans_above(F.col("__raw"), F.col("__p"), self.span_threshold).alias("matched_spans"),
        )
