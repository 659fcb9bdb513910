"""Motif matching in sliding windows, as columns.

Exact matching stays on the JVM: motifs that a text does not contain are dropped first, so
windows are looked at only for the few that it does. Fuzzy matching is one vectorized
function that aligns a motif with all positions of a text at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.binding import let, once
from quillsift.sources.config import Bank

WINDOW, STEP, LEAST = 50, 25, 10
#: Characters that are aligned with a motif at once.
ALIGNED = 200_000
MATCH = "array<struct<position:int,motif:string,category:string,length:int,score:double>>"


def matches(text: Column, bank: Bank) -> Column:
    """Exact matches (position, motif, category, length, score) by position, then motif.

    A window of 50 characters moves by 25; a motif counts at its first place in each window. So
    texts under 10 characters match nothing, and a motif longer than 26 may be missed. Null stays null.
    """
    return F.when(text.isNotNull(), let(F.lower(text), lambda low: F.array_sort(let(_found(low, bank), _first_of_equal))))


def _found(low: Column, bank: Bank) -> Column:
    motifs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("c")) for m, c in bank.motif_list()])
    there = F.filter(motifs, lambda x: F.contains(low, x["m"]))
    starts = F.sequence(F.lit(0), F.greatest(F.length(low) - 1, F.lit(0)), F.lit(STEP))

    def place(start: Column, motif: Column) -> Column:
        window = F.substring(low, start + 1, F.lit(WINDOW))
        return let(window, lambda w: F.when((F.length(w) >= LEAST) & F.contains(w, motif), F.instr(w, motif) + start - 1))

    def places(motif: Column) -> Column:
        return F.filter(F.array_distinct(F.transform(starts, lambda s: place(s, motif))), lambda p: p.isNotNull())

    each = lambda x: F.transform(
        places(x["m"]), lambda p: F.struct(p.cast("int").alias("position"), x["m"].alias("motif"), x["c"].alias("category"), F.length(x["m"]).alias("length"), F.lit(100.0).alias("score"))
    )
    return F.flatten(F.transform(there, each))


def _first_of_equal(found: Column) -> Column:
    """A motif listed in two categories counts once at a position, for the first category."""
    keep = lambda x, k: ~F.exists(F.slice(found, F.lit(1), k), lambda y: (y["position"] == x["position"]) & (y["motif"] == x["motif"]))
    return F.filter(found, keep)


def all_occurrences(text: Column, bank: Bank) -> Column:
    """The matches that a multi-pattern automaton finds: leftmost ones that do not overlap, anywhere in the text."""
    motifs = bank.motif_list()

    @F.pandas_udf(MATCH)
    def scan(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for m, c in motifs:
            if m not in automaton:
                automaton.add_word(m, (m, c))
        automaton.make_automaton()

        def one(t):
            if t is None:
                return None
            low, out, end = t.lower(), [], 0
            for last, (m, c) in automaton.iter(low):
                begin = last + 1 - len(m)
                if begin >= end:  # standard semantics: the match that ends first wins
                    out.append({"position": begin, "motif": m, "category": c, "length": len(m), "score": 100.0})
                    end = last + 1
            return out

        return texts.map(one)

    return once(scan)(text)


def _reaching(codes: np.ndarray, motif: str, threshold: float) -> np.ndarray:
    """At which positions a stretch begins, of any length up to the motif's, that reaches the threshold."""
    m, n = len(motif), len(codes)
    table = np.zeros(n, np.uint64 if m > 31 else np.uint32)
    for c in set(motif):
        table[codes == ord(c)] = sum(1 << k for k, x in enumerate(motif) if x == c)
    full = table.dtype.type((1 << m) - 1)
    row, out = np.full(n, full, table.dtype), np.zeros(n, bool)
    for k in range(min(m, n)):
        row = row[: n - k]
        u = row & table[k:]
        row = (row + u) | (row - u)
        needed = int(np.ceil(threshold * (k + 1 + m) / 200 - 1e-9))
        if needed <= k + 1:
            out[: n - k] |= np.bitwise_count(row & full) <= m - needed
    return out


def _tails(lows: list[str], longest: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((text, window) of the windows shorter than ``longest``, their lengths, their code points by column)."""
    at = [(k, w) for k, low in enumerate(lows) for w in range(0 if longest > WINDOW else max(0, (len(low) - longest) // STEP), -(-len(low) // STEP)) if LEAST <= min(WINDOW, len(low) - w * STEP) < longest]
    n = np.array([min(WINDOW, len(lows[k]) - w * STEP) for k, w in at], dtype=np.int64)
    codes = np.full((int(n.max(initial=0)), len(at)), 0xFFFFFFFF, np.uint32)
    for j, (k, w) in enumerate(at):
        codes[: n[j], j] = np.frombuffer(lows[k][w * STEP : w * STEP + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    return at, n, codes


def _tails_reaching(n: np.ndarray, codes: np.ndarray, motif: str, threshold: float) -> np.ndarray:
    """Which windows shorter than the motif may reach the threshold where they slide inside it.

    With ``c`` common with the whole motif a stretch of it has ``c`` at most, and so the similarity is
    200c / (c + n) at most.
    """
    use = np.flatnonzero(n < len(motif))
    if not len(use):
        return use
    part = codes[: int(n[use].max()), use]
    table = np.zeros(part.shape, np.uint64)
    for c in set(motif):
        table[part == ord(c)] = sum(1 << k for k, x in enumerate(motif) if x == c)
    full = np.uint64((1 << len(motif)) - 1)
    row = np.full(len(use), full, np.uint64)
    for hit in table:
        u = row & hit
        row = (row + u) | (row - u)
    common = len(motif) - np.bitwise_count(row & full).astype(np.int64)
    return use[200 * common >= threshold * (common + n[use]) - 1e-6]


def alignments(codes: np.ndarray, motif: str) -> list[np.ndarray]:
    """For each length up to that of ``motif``: the longest common subsequence with the stretch from each position."""
    m, n = len(motif), len(codes)
    masks = {}
    for k, c in enumerate(motif):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << k
    table = np.zeros(n, np.uint64)
    for c, mask in masks.items():
        table[codes == c] = mask
    full = np.uint64((1 << m) - 1)
    row, out = np.full(n, full, np.uint64), []
    for k in range(m):
        if n - k <= 0:
            break
        v, hit = row[: n - k], table[k:]
        u = v & hit
        row = ((v + u) | (v - u)) & full
        out.append(m - np.bitwise_count(row).astype(np.int32))
    return out


def partial_ratio(window: str, motif: str) -> tuple[float, int, int]:
    """(best similarity, start, end) of ``motif`` with a stretch of ``window`` as long as it, or shorter at either end.

    The similarity is 200 x common subsequence / both lengths. The shorter string is the one that moves.
    """
    if len(window) < len(motif):
        score, _, _ = partial_ratio(motif, window) if window else (0.0, 0, 0)
        return score, 0, len(window)
    n, m, best = len(window), len(motif), (0.0, 0, 0)
    for k, common in enumerate(alignments(np.frombuffer(window.encode("utf-32-le"), np.uint32), motif)):
        length = k + 1
        places = range(n - length + 1) if length == m else {0, n - length}
        for p in places:
            score = 200.0 * common[p] / (length + m)
            if score > best[0]:
                best = (score, p, p + length)
    return best


def fuzzy_matches(text: Column, bank: Bank, threshold: float = 75) -> Column:
    """Matches whose similarity in a window reaches the threshold, at the exact place or else the best aligned one."""
    motifs = bank.motif_list()

    @F.pandas_udf(MATCH)
    def scan(texts: pd.Series) -> pd.Series:
        out, part, held = [None] * len(texts), [], 0
        for k, t in enumerate([*texts, ""]):
            if part and (held > ALIGNED or k == len(texts)):
                for j, found in zip([j for j, _ in part], fuzzy_scan([low for _, low in part], motifs, threshold)):
                    out[j] = found
                part, held = [], 0
            if k < len(texts) and t is not None:
                part.append((k, t.lower()))
                held += len(t)
        return pd.Series(out, dtype=object)

    return once(scan)(text)


def fuzzy_scan(lows: list[str], motifs: list[tuple[str, str]], threshold: float) -> list[list[dict]]:
    """Matches of texts in lower case, which are aligned with a motif all at once.

    What the best stretch from a position can reach is an upper bound for the windows with that
    position that are no shorter than the motif; shorter ones, which slide inside it, have their own bound.
    Only windows where it reaches the threshold are looked at one by one.
    """
    codes = np.frombuffer("\0".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0] + [len(low) + 1 for low in lows])
    found: list[list] = [[] for _ in lows]
    tails, tail_sizes, tail_codes = _tails(lows, max((len(m) for m, _ in motifs), default=0))
    for order, (motif, category) in enumerate(motifs):
        m = len(motif)
        hot = np.flatnonzero(_reaching(codes, motif, threshold))
        owner = np.searchsorted(begins, hot, side="right") - 1
        window = (hot - begins[owner]) // STEP
        seen = set()
        short = {tails[j] for j in _tails_reaching(tail_sizes, tail_codes, motif, threshold).tolist()}
        for k, w in sorted({(o, x) for o, v in zip(owner.tolist(), window.tolist()) for x in (v, v - 1) if x >= 0} | short):
            start = w * STEP
            text = lows[k][start : start + WINDOW]
            if len(text) < LEAST:
                continue
            exact = text.find(motif)
            score, s, e = (100.0, exact, exact + m) if exact >= 0 else partial_ratio(text, motif)
            if score >= threshold and (k, start + s) not in seen:
                seen.add((k, start + s))
                found[k].append((start + s, w, order, {"position": start + s, "motif": motif, "category": category, "length": e - s, "score": float(score)}))
    return [[x[3] for x in sorted(f, key=lambda x: x[:3])] for f in found]


def signal_density(text: Column, found: Column) -> Column:
    """Matches for each 1000 characters."""
    return F.size(found) * 1000.0 / F.greatest(F.length(text), F.lit(1))


def _best(found: Column, category: str) -> Column:
    return F.array_max(F.transform(F.filter(found, lambda m: m["category"] == category), lambda m: m["score"]))


def category_scores(found: Column, categories: list[str]) -> Column:
    """Category to its highest score, for categories with a match."""
    entries = [F.struct(F.lit(c).alias("key"), _best(found, c).alias("value")) for c in categories]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def total_score(scores: Column) -> Column:
    """Sum of the highest scores."""
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, b: a + b)


def features(text: Column, found: Column, categories: tuple[str, ...]) -> Column:
    """Density, highest score of each of six categories, highest of all, share of categories met; all scaled to 1."""
    best = [F.coalesce(_best(found, c), F.lit(0.0)) / 100.0 for c in categories]
    met = sum((F.when(b > 0, 1).otherwise(0) for b in best), F.lit(0))
    return F.array(F.least(signal_density(text, found) / 10, F.lit(1.0)), *best, F.greatest(*best), met / float(len(categories)))


def spans(found: Column) -> Column:
    """(start, end) of the matches, not merged."""
    return F.transform(found, lambda m: F.struct(m["position"].alias("start"), (m["position"] + m["length"]).alias("end")))
