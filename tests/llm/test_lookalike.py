import unicodedata

import pytest
from pyspark.sql import functions as F

from quillsift.llm.lookalike import Spellings, consistent_texts, disguised_pairs, own_script, spellings, table_form

SAME = [
    ("apple", "аррle"), ("apple", "ａｐｐｌｅ"), ("apple", "ap​ple"), ("apple", "﻿apple­"), ("café", "café"), ("café", "саfе́"), ("file", "ﬁle"),
    ("a b", "a b"), ("a b", "a　b"), ("ガ", "ｶﾞ"), ("ガ", "ガ"), ("한", "한"), ("река", "рeкa"), ("ё", "ë"), ("Το", "To"), ("x\n", "х\n"), ("...", "…"),
]
OTHER = [("apple", "Apple"), ("e", "é"), ("a b", "a  b"), ("a b", "a\tb"), ("a1", "a2"), ("a.", "a,"), ("a", ""), ("река", "peka"), ("и", "u"), ("l", "1"), ("a\nb", "a b"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert table_form(a) == table_form(b)
    for vocabulary in ([], [(a, 3)], [(b, 3)], [(a, 2), (b, 5)]):
        trie = Spellings(vocabulary)
        assert trie.text(a) == trie.text(b)
        assert table_form(trie.text(a)) == table_form(a) and trie.text(trie.text(a)) == trie.text(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    for vocabulary in ([], [(a, 3), (b, 2)]):
        trie = Spellings(vocabulary)
        assert trie.text(a) != trie.text(b)


def test_spelling_comes_from_the_trie_and_the_script():
    assert Spellings([("река", 4), ("peкa", 2)]).token("pекa") == "река"
    assert own_script(table_form("сорока")) == "сорока"
    assert Spellings([]).token("tоmоrrоw") == "tomorrow"


def test_budget_allows_edits():
    trie = Spellings([("überall", 4), ("übrig", 2)], budget=1)
    assert trie.match("uberall") == "überall" and trie.match("überal") == "überall" and trie.match("überalll") == "überall"
    assert trie.match("über") is None and Spellings([("überall", 4)]).match("uberall") is None


def _frames(spark):
    rows = [(k, t) for k, pair in enumerate(SAME + OTHER) for t in pair]
    rows = [(2 * k, a) for k, a in enumerate(t for _, t in rows)] + [(1001, None), (1002, ""), (1003, "​"), (0, "apple"), (1005, "apple"), (1007, "x" * 50_000 + "е"), (1009, "x" * 50_000 + "e")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("form", F.lit(1))
    return rows, df


def test_pairs_against_brute_force(spark):
    rows, df = _frames(spark)
    other = df.withColumn("row_id", F.col("row_id") + 1).withColumnRenamed("row_id", "string_id")
    got = [tuple(r) for r in disguised_pairs([("a", df, "row_id", "text"), ("b", other, "string_id", "text")]).collect()]
    want = {(i, j) for i, s in rows for j, t in rows if i < j and s is not None and t is not None and s != t and table_form(s) == table_form(t)}
    assert len(got) == len(set(got)) and set(got) == {("a", i, j) for i, j in want} | {("b", i + 1, j + 1) for i, j in want} and len(want) > 20
    assert disguised_pairs([("a", df.limit(0), "row_id", "text")]).count() == 0


def test_consistent_texts(spark):
    rows, df = _frames(spark)
    got = {(r.id, r.text) for r in consistent_texts([("a", df, "row_id", "text")]).collect()}
    forms = {i: t for i, t in got}
    assert forms[1001] is None and forms[1002] == "" and forms[1003] == "" and forms[0] == "apple"
    texts = dict(rows)
    assert all(unicodedata.is_normalized("NFC", t) for _, t in got if t)
    assert all((forms[i] == forms[j]) == (table_form(texts[i]) == table_form(texts[j])) for i in forms for j in forms if forms[i] is not None and forms[j] is not None)


def test_frequent_spellings(spark):
    df = spark.createDataFrame([("né né été",), ("né x",), (None,), ("",)], "text string")
    assert dict(spellings(df, most=1)) == {"né": 3}
    assert spellings(df.limit(0)) == []
