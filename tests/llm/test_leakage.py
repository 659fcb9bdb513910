import random

from pyspark.sql import functions as F

from quillsift.llm import leakage
from quillsift.llm.leakage import reparameterised, verbatim_leaks, words_of


def test_words():
    assert words_of("It's a_B c-3!") == ["it", "s", "a", "b", "c", "3"]
    assert words_of("Maß") == words_of("MASS")


def _tables():
    rnd = random.Random(4)
    vocabulary = ["the", "of", "red", "Boat", "é", "日本", "x9", "17", "km", "Zed"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = {k: text(n) for k, n in enumerate([30, 12, 11, 40, 0])} | {9: None}
    docs = {}
    for k in range(60):
        item = (items[rnd.choice([0, 1, 2, 3])]).split()
        n = rnd.randint(5, 14)
        s = rnd.randrange(max(1, len(item) - n + 1))
        docs[k] = text(rnd.randint(0, 30)) + rnd.choice([" ", "\n", "-_- "]) + "; ".join(item[s : s + n]).upper() + " " + text(5)
    return docs | {100: None, 101: ""}, items


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 20)
    docs, items = _tables()
    stretches = lambda t: {tuple(w[k : k + 12]) for w in [words_of(t or "")] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs.items() for i, u in items.items() if stretches(t) & stretches(u)}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("template", F.lit("x"))
    i = spark.createDataFrame(list(items.items()), "item_id bigint, text string").withColumn("doc", F.lit("x"))
    got = [tuple(r) for r in verbatim_leaks(d.union(d.limit(3)), i).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert verbatim_leaks(d.limit(0), i).count() == 0 and verbatim_leaks(d, i.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    items = [(1, "if Ann has 12 apples and Bob gives Ann 30 more apples"), (2, "how many apples and more has Carl if Dora gives 5 apples and")]
    docs = [
        (10, "if Eve has 7 apples and Joe gives Eve 99 more apples"),
        (11, "if Eve has 7 apples and Joe gives Ida 99 more apples"),
        (12, "completely other words " * 5),
    ]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc, r.item) for r in reparameterised(d, i).collect()} == {(10, 1)}


def test_recall_and_precision_of_other_slots(spark):
    rnd = random.Random(12)
    common = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)]
    names = [f"Name{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    items, docs, want = [], [], set()
    for k in range(120):
        words = [rnd.choice(common) for _ in range(24)]
        slots = rnd.sample(range(24), 7)
        for s in slots:
            words[s] = rnd.choice(["NAME", str(rnd.randint(2, 99))])
        own, other = iter(rnd.sample(names, 8)), iter(rnd.sample(names, 8))
        one, two = ([next(x) if w == "NAME" else w for w in words] for x in (own, other))
        numbers = rnd.sample(range(100, 999), 100)
        two = [str(numbers[int(w)]) if w.isdigit() else w for w in two]
        items.append((k, " ".join(one)))
        docs.append((k, "before it " + " ".join(two) + " and after it"))
        want.add((k, k))
        docs.append((1000 + k, " ".join(rnd.choice(common) for _ in range(60))))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc, r.item) for r in reparameterised(d, i).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
