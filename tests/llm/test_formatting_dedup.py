import json
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from quillsift.llm.formatting_dedup import collapse_formatting, formatting_copies

ROWS = [
    (1, "Hello,  World!", 1), (2, "hello world", 1), (3, "HELLO\u00a0WORLD…", 1), (4, "hello world", 0), (5, "hello world", None), (6, "Hello world", None),
    (7, '{"a": "x y", "b": {"c": 1, "d": [1, 2]}}', 0), (8, '{"b":{"d":[1,2],"c":1},"a":"X, y"}', 0), (9, '{"b":{"d":[2,1],"c":1},"a":"X y"}', 0),
    (10, '{"a": "y", "b": "x"}', 0), (11, '{"b": "y", "a": "x"}', 0), (12, "", 0), (13, None, 0), (14, "?!", 0), (15, "...", 0), (16, "", 0),
    (17, "hello w0rld", 1), (18, '{"a": broken', 1), (19, '{"A" broken', 1), (20, "é", 1), (21, "e", 1), (22, "hello+world", 1), (23, "Er vergaß", 1), (24, "ER VERGASS!", 1), (2, "hello world", 1),
]


def _brute(rows):
    def strip(t):
        return "".join(c for c in t.lower() if not c.isspace() and unicodedata.category(c)[0] != "P")

    def key(x):
        if isinstance(x, dict):
            return ("o", tuple(sorted((strip(k), key(v)) for k, v in x.items())))
        if isinstance(x, list):
            return ("a", tuple(map(key, x)))
        return ("v", strip(x if isinstance(x, str) else json.dumps(x)))

    groups = defaultdict(set)
    for i, t, label in rows:
        if t and any(c.isalnum() for c in t):
            try:
                x = json.loads(t)
            except ValueError:
                x = None
            groups[label, key(x) if isinstance(x, dict) else ("v", strip(t))].add(i)
    return groups


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, text string, label int").withColumn("fields", F.lit(1)).withColumn("id", F.lit("z"))
    groups = _brute(ROWS)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    got = [tuple(r) for r in formatting_copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    copies = {r.id: r.copies for r in collapse_formatting(df).collect()}
    assert copies == {min(g): len(g) for g in groups.values()}


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, text string, label int")
    assert formatting_copies(df).count() == 0 and collapse_formatting(df).count() == 0
