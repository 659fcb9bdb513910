import random
from collections import Counter, defaultdict

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.llm.packing import fill, pack, token_count


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 12), max_size=8))
def test_fill_uses_every_item_and_fills_the_first_window_best(histogram):
    patterns = fill(histogram, 20)
    used = Counter()
    for times, taken in patterns:
        assert sum(s * n for s, n in taken.items()) <= 20
        for s, n in taken.items():
            used[s] += n * times
    assert used == Counter(histogram)
    if histogram:
        longest = max(histogram)
        items = [s for s, n in histogram.items() for _ in range(n)]
        items.remove(longest)
        sums = {0}
        for s in items:
            sums |= {x + s for x in sums if x + s <= 20 - longest}
        assert sum(s * n for s, n in patterns[0][1].items()) == longest + max(sums)


def test_pack(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([100, 100, 100, rnd.randint(1, 99), 250]) for _ in range(600)] + [0, None, 10_000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size int").withColumn("container", F.lit("x"))
    rows = pack(df, 100, rows_per_bucket=50).collect()
    held, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        parts[r.id].append(r.tokens)
        if r.tokens:
            held[r.container] += r.tokens
        else:
            assert r.container is None
    for k, size in enumerate(sizes):
        assert sum(parts[k]) == (size or 0)
        assert len(parts[k]) == max(1, -(-(size or 0) // 100))
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held)))
    assert len(held) <= 1.01 * sum(s or 0 for s in sizes) / 100 + 1
    assert pack(df.limit(0), 100).count() == 0


def test_token_count(spark):
    texts = ["", "a_b c-d!! e", "x  y", "नमस्ते 12½", None, "日本 ++=="]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()
    rule = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")
    assert [r.n for r in got] == [None if t is None else len(rule.findall(t)) for t in texts]
