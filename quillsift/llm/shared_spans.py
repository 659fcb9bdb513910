"""Problem 8: long verbatim stretches shared between documents.

A paragraph is any stretch of ``min_chars`` code points, at whatever offset it lies. Its MinHash
is the smallest hash of its ``gram``-character shingles; equal paragraphs have equal ones, so
documents with a common stretch always collide (recall 1), while neighbouring paragraphs share
theirs, which leaves about one signature for every hundred characters. Each signature
gives two bands: the smallest shingle with what precedes it, and with what follows it. A
common stretch reaches half its remaining length to one side at least, so one band agrees.

Colliding paragraphs are verified: for colliding places only, 128 bits made of all code points of
each of their paragraphs are compared. Paragraphs with the same set of documents are represented
by one of them before pairs are formed, so a long shared passage costs no more than a short
one. Removals are clustered by connected components over star edges (no pairs needed).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.hashing import Rolling, code_points, sliding_min
from quillsift.runtime import materialize

MIN_CHARS, GRAM = 300, 50
#: Code points handled at once; longer documents are handled in overlapping segments.
SEGMENT = 1 << 19
#: Sets code points apart for the second 64 bits of a paragraph.
_OTHER = np.uint64(1 << 40)


def _segments(texts: list[str | None], least: int, size: int):
    """(numbers of the texts, offsets in them, one array of code points, where each begins): bounded groups."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text or "") - least + 1), size - least + 1) if text and len(text) >= least else ():
            part = text if len(text) <= size else text[at : at + size]
            if held and held + len(part) > size:
                yield group
                group, held = [], 0
            group.append((k, at, part))
            held += len(part)
    if group:
        yield group


def _bands(min_chars: int, gram: int, size: int):
    reach = (min_chars - gram + 1) // 2  # one side of the smallest shingle has at least so much of the stretch

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out_id, out_at, out_key = [], [], []
            for group in _segments(batch.column(1).to_pylist(), min_chars, size):
                lengths = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                points = code_points("".join(p for _, _, p in group))
                rolling = Rolling(points)
                owner = np.repeat(np.arange(len(group)), lengths)
                shingles = rolling.of(gram)
                order = (shingles >> np.uint64(20) << np.uint64(20)) | np.arange(len(shingles), dtype=np.uint64)
                least = sliding_min(order, min_chars - gram + 1)
                inside = np.arange(len(least)) + min_chars <= ends[owner[: len(least)]]
                place = np.unique(least[inside] & np.uint64((1 << 20) - 1)).astype(np.int64)
                whole = rolling.of(gram + reach)
                part = owner[place]
                for shift, bit in ((reach, 0), (0, 1)):
                    begin = place - shift
                    ok = (begin >= starts[part]) & (begin + gram + reach <= ends[part])
                    numbers = np.array([k for k, _, _ in group])[part[ok]]
                    offsets = np.array([a for _, a, _ in group])[part[ok]]
                    out_id.append(ids[numbers])
                    out_at.append(place[ok] - starts[part[ok]] + offsets)
                    out_key.append((whole[begin[ok]] & ~np.uint64(1) | np.uint64(bit)).view(np.int64))
            if out_id:
                one, key, at = np.concatenate(out_id), np.concatenate(out_key), np.concatenate(out_at)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(key), pa.array(at.astype(np.int32))], names=["doc", "key", "at"])

    return run


def _paragraphs(min_chars: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, texts, places = (batch.column(k).to_pylist() for k in range(3))
            for doc, text, at in zip(ids, texts, places):
                points, at = code_points(text), np.unique(np.array(at, dtype=np.int64))
                low = np.maximum(at - (min_chars - gram), 0)
                high = np.minimum(at, len(points) - min_chars)
                # neighbouring places overlap: one pass over each connected stretch
                new = np.ones(len(at), bool)
                new[1:] = low[1:] > np.maximum.accumulate(high)[:-1] + 1
                first = np.flatnonzero(new)
                keys, checks, starts = [], [], []
                for s, e in zip(low[first], np.maximum.reduceat(high, first)):
                    if e >= s:
                        part = points[s : e + min_chars].astype(np.uint64)
                        keys.append(Rolling(part).of(min_chars).view(np.int64))
                        checks.append(Rolling(part | _OTHER).of(min_chars).view(np.int64))
                        starts.append(np.arange(s, e + 1, dtype=np.int32))
                if keys:
                    key, check, start = np.concatenate(keys), np.concatenate(checks), np.concatenate(starts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), doc, np.int64)), pa.array(key), pa.array(check), pa.array(start)], names=["doc", "key", "check", "start"])

    return run


def shared_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """(doc, key, check, start, docs, same): the paragraphs, of 128 bits key and check, that two or more documents share.

    ``docs`` is the number of documents with the paragraph and ``same`` a signature of their set,
    of 128 bits.
    Null texts and texts shorter than ``min_chars`` share nothing; a repeated row (same id) counts
    once. The result is a written table.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).filter(F.length("text") >= min_chars)
    bands = materialize(docs.mapInArrow(_bands(min_chars, gram, min(segment, 1 << 20)), "doc bigint, key bigint, at int"), "bands")
    colliding = bands.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("key")
    places = bands.join(colliding, "key", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("places"))
    near = docs.join(places, "doc").select("doc", "text", "places")
    paragraphs = near.mapInArrow(_paragraphs(min_chars, gram), "doc bigint, key bigint, check bigint, start int")
    paragraphs = materialize(paragraphs, "paragraphs")
    each = paragraphs.select("key", "check", "doc").distinct()
    shared = each.groupBy("key", "check").agg(F.count("*").alias("docs"), F.struct(F.bit_xor(F.xxhash64("doc")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("b")).alias("same")).filter("docs > 1")
    return materialize(paragraphs.join(shared, ["key", "check"]), "shared")


def _representatives(shared: DataFrame) -> DataFrame:
    """(key, doc) of one paragraph for each set of documents."""
    one = shared.groupBy("docs", "same").agg(F.min(F.struct("key", "check")).alias("one")).select("one.*")
    return shared.join(one, ["key", "check"], "left_semi").select(F.struct("key", "check").alias("key"), "doc").distinct()


def sharing_pairs(shared: DataFrame) -> DataFrame:
    """(doc_a, doc_b): distinct pairs of documents with a common paragraph, the smaller id first."""
    members = _representatives(shared)
    return (
        members.select("key", F.col("doc").alias("doc_a")).join(members.select("key", F.col("doc").alias("doc_b")), "key")
        .filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()
    )


def coverage(df: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, n_chars, shared_chars, stretches): how much of each document occurs in another one.

    Documents that share nothing, and those with a null text, come out with zero.
    """
    w = Window.partitionBy("doc").orderBy("start")
    gaps = shared.select("doc", "start").distinct().withColumn("before", F.lag("start").over(w))
    gained = F.when(F.col("before").isNull(), F.lit(min_chars)).otherwise(F.least(F.col("start") - F.col("before"), F.lit(min_chars)))
    opens = F.when(F.col("before").isNull() | (F.col("start") - F.col("before") > min_chars), 1).otherwise(0)
    found = gaps.groupBy("doc").agg(F.sum(gained).alias("shared_chars"), F.sum(opens).alias("stretches"))
    docs = df.select(F.col(id_col).alias("doc"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars")).groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
    return docs.join(found, "doc", "left").fillna(0, ["shared_chars", "stretches"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): components of the undirected edges (a, b), each named by its smallest id.

    Large-star and small-star rounds (Kiveris et al. 2014): every round is a map-side combined
    aggregate and a join; the edges are cut off their lineage by a written table each round.
    """
    now = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("v < u").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v - u in either direction
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("m").alias("v"), "u").filter("v < u").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        after = materialize(joined.select(F.col("m").alias("v"), "u").union(joined.filter("v > m").select(F.col("m").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
        changed = after.join(now, ["v", "u"], "left_anti").limit(1).count() + now.join(after, ["v", "u"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def removals(shared: DataFrame) -> DataFrame:
    """(doc, cluster, keep): documents that share paragraphs, clustered; the smallest id of a cluster is kept."""
    members = _representatives(shared)
    stars = members.join(members.groupBy("key").agg(F.min("doc").alias("a")), "key").select("a", F.col("doc").alias("b"))
    return components(stars).select(F.col("id").alias("doc"), F.col("component").alias("cluster"), (F.col("id") == F.col("component")).alias("keep"))
