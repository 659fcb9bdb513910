import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillsift.llm.shared_spans import components, coverage, removals, shared_paragraphs, sharing_pairs


def _docs():
    rnd = random.Random(11)
    letters = "abcdefgh \n日😀é"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    common, exact, short, run = text(700), text(300), text(299), "=" * 400
    docs = [text(rnd.randint(0, 900)) for _ in range(20)]
    docs += [text(50) + common[k * 40 :] + text(90) for k in range(5)]
    docs += [text(123) + exact, exact + text(5), text(1) + exact + text(400)]
    docs += [text(123) + short, short + text(9)]
    docs += [text(8) + run + text(3), run[:300], "=" * 299, text(2000) + common[:310]]
    docs += ["", None, docs[20], "tiny"]
    return dict(enumerate(docs))


def _shared_windows(docs, n):
    seen = defaultdict(set)
    for d, t in docs.items():
        for k in range(len(t or "") - n + 1):
            seen[t[k : k + n]].add(d)
    return {w: s for w, s in seen.items() if len(s) > 1}


@pytest.mark.parametrize("segment", [1 << 19, 1000])
def test_against_brute_force(spark, segment):
    docs = _docs()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("key", F.lit(0))
    df = df.union(df.filter("doc_id = 21"))
    shared = shared_paragraphs(df, segment=segment)
    windows = _shared_windows(docs, 300)
    want = {(a, b) for s in windows.values() for a in s for b in s if a < b}
    got = [tuple(r) for r in sharing_pairs(shared).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    cover = {r.doc: r for r in coverage(df, shared).collect()}
    assert set(cover) == set(docs)
    for d, t in docs.items():
        covered = set()
        for k in range(len(t or "") - 299):
            if t[k : k + 300] in windows:
                covered |= set(range(k, k + 300))
        assert cover[d].shared_chars == len(covered) and cover[d].n_chars == len(t or "")
        assert cover[d].stretches == sum(k - 1 not in covered for k in covered)
    rows = {r.doc: r for r in removals(shared).collect()}
    assert set(rows) == {d for p in want for d in p}
    for a, b in want:
        assert rows[a].cluster == rows[b].cluster
    assert all(r.keep == (r.doc == r.cluster) for r in rows.values())


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5), (7, 6), (6, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    shared = shared_paragraphs(df)
    assert sharing_pairs(shared).count() == 0 and coverage(df, shared).count() == 0 and removals(shared).count() == 0


def test_sets_of_documents_with_equal_sums_of_short_hashes(spark):
    ids = (325, 5924, 3904, 4104)
    short = [r.h for r in spark.createDataFrame([(k,) for k in ids], "id bigint").select(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)).alias("h")).collect()]
    assert short[0] + short[1] == short[2] + short[3]
    rnd = random.Random(2)
    one, two = ("".join(rnd.choice("abcdefgh ") for _ in range(320)) for _ in range(2))
    shared = shared_paragraphs(spark.createDataFrame(list(zip(ids, (one, one, two, two))), "doc_id bigint, text string"))
    assert {tuple(r) for r in sharing_pairs(shared).collect()} == {(325, 5924), (3904, 4104)}
    assert {r.doc for r in removals(shared).collect()} == set(ids)
