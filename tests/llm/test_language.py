import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm.language import codewords, document_languages, fit, fit_on, json_strings, language_segments, sentences, stated_language, unstated_languages, words_of

LANGUAGES = [("de", "deu", "German"), ("en", "eng", "English"), ("es", "spa", "Spanish"), ("ja", "jpn", "Japanese")]
WORDS = {
    "en": "the small bakery and that old printer have been counting their weekly budget because of heavy rain over this quiet town".split(),
    "de": "der kleine Bäcker und die alte Druckerei haben wegen des schweren Regens über dieser ruhigen Stadt ihren Bericht nicht gelesen".split(),
    "es": "la pequeña panadería y el viejo taller han perdido sus cuentas por culpa de una lluvia fuerte sobre esta ciudad tranquila".split(),
    "ja": "小さな パン屋 は 雨 の ため に この 町 で 古い 切符 を 数え て い ます".split(),
}


def _sentence(rnd, language, n=10):
    words = [rnd.choice(WORDS[language]) for _ in range(n)] + ["".join(rnd.choice(["ko", "ra", "vi", "me"]) for _ in range(3)).title()]
    rnd.shuffle(words)
    return "。" .join(["".join(words), ""]) if language == "ja" else " ".join(words) + ". "


def _rows():
    rnd = random.Random(1)
    rows, truth = [], {}
    for k in range(500):
        own = rnd.choice(list(WORDS))
        text, languages = "".join(_sentence(rnd, own) for _ in range(3)), {own}
        if k % 10 == 0:
            other = rnd.choice(list(WORDS))
            text, languages = text + _sentence(rnd, other), languages | {other}
        label = own if rnd.random() < 0.85 else rnd.choice(["", None, "xx", rnd.choice(list(WORDS))])
        rows.append((k, text, label))
        truth[k] = languages
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "?!", None), (1003, "4711-A3", None), (1004, json.dumps({"a": {"b": "the old printer and that bakery"}}), "es")]
    return rows, truth | {1004: {"en"}}


def test_codewords_are_apart():
    code = codewords(13)
    assert code.shape == (13, 31) and min((code[a] != code[b]).sum() for a in range(13) for b in range(a)) >= 10


def test_words_and_sentences():
    assert words_of("The c0de 12-X3 Ａｐple, аррle") == ["the", "apple", "apple"]
    assert words_of("古い切符") == ["古い", "い切", "切符"]
    assert [(s, e) for s, e, _ in sentences("One two. Three!\n?! 12.")] == [(0, 8), (8, 15)]
    assert json_strings('{"a": ["x", {"b": "y"}], "c": 1}') and json_strings("[1]") is None and json_strings("{x") is None


def test_stated(spark):
    labels = ["EN", " de ", "en-US", "es_MX", "eng", "German", "japanese", "", None, "und", "xx", "en-"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(stated_language(F.col("l"), LANGUAGES).alias("s"))
    assert [r.s for r in df.collect()] == ["en", "de", "en", "es", "en", "de", "ja", None, None, None, None, None]


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = _rows()
    df = spark.createDataFrame(rows, "row_id bigint, text string, language string").withColumn("words", F.lit("x"))
    model = fit_on(df, LANGUAGES, "row_id", "text", "language")
    return rows, truth, df, language_segments(df, model).cache(), model


def test_held_out_accuracy(found):
    rows, _, _, _, _ = found
    rnd = random.Random(99)
    model = fit([(t, label) for _, t, label in rows if t and label in WORDS], [code for code, _, _ in LANGUAGES])
    tests = [(_sentence(rnd, language), language) for language in WORDS for _ in range(100)]
    margins = np.stack([model.word_margins(words_of(t)).sum(0) for t, _ in tests])
    best, confidence, _ = model.decode(margins)
    assert np.mean([model.languages[b] == language for b, (_, language) in zip(best, tests)]) > 0.99
    assert ((confidence > 0) & (confidence <= 1)).all()


def test_rows_and_segments(found):
    rows, truth, df, segments, model = found
    labels = {i: (label if label in WORDS else None) for i, _, label in rows}
    got = [(r.id, r.language) for r in unstated_languages(df.union(df.limit(50)), model, LANGUAGES).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    want = {(i, x) for i, languages in truth.items() for x in languages if x != labels[i]}
    assert len(got ^ want) <= 0.02 * len(want)
    texts = {i: t for i, t, _ in rows}
    for r in segments.collect():
        assert 0 <= r.start < r.end <= len(texts[r.id]) and 0 < r.confidence <= 1 and r.words > 0
    one = {r.id: r for r in document_languages(segments).collect()}
    assert set(one) == {i for i, t, _ in rows if t and words_of(t)}
    assert sum(one[i].language in truth[i] for i in truth) > 0.99 * len(truth)


def test_mixture_without_sentence_ends(spark, found):
    rows, _, df, _, _ = found
    rnd = random.Random(5)
    model = fit_on(df, LANGUAGES, "row_id", "text", "language")
    text = (_sentence(rnd, "en", 20) + _sentence(rnd, "es", 20)).replace(".", "")
    segments = language_segments(spark.createDataFrame([(1, text)], "row_id bigint, text string"), model).collect()
    assert {r.language for r in segments} == {"en", "es"} and all(r.start < r.end for r in segments)


def test_change_inside_a_short_sentence(spark, found):
    rows, _, df, _, _ = found
    rnd = random.Random(6)
    model = fit_on(df, LANGUAGES, "row_id", "text", "language")
    texts, edges = [], []
    for _ in range(40):
        one, two = (" ".join(rnd.sample(WORDS[x], 8)) for x in rnd.sample(["en", "de", "es"], 2))
        texts.append(f"{one} {two}.")
        edges.append(len(one))
    segments = language_segments(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string"), model).collect()
    by = {k: sorted((r.start, r.end) for r in segments if r.id == k) for k in range(40)}
    assert all(own[0][0] == 0 and own[-1][1] == len(texts[k]) and all(a[1] == b[0] for a, b in zip(own, own[1:])) for k, own in by.items())
    assert sum(len(own) == 2 and own[0][1] == edges[k] for k, own in by.items()) >= 32


def test_parts_end_with_words(spark, found):
    rows, _, df, _, model = found
    rnd = random.Random(7)
    one, two = " ".join(rnd.sample(WORDS["en"], 12)), "小さなパン屋は雨のためにこの町で古い切符を数えています"
    texts = [f"{one} {two}。", f"{one}，{two}。", f"{one}\u200b，{two}。", f"{one} ﬁ\u0301 {two}。"]
    values = [f"{one} {' '.join(rnd.sample(WORDS['es'], 12))}"]
    texts += [json.dumps({"title": values[0], "the old printer": 1}), json.dumps({"1": 2}), json.dumps({"la pequeña panadería y el viejo taller": 1})]
    out = language_segments(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string"), model).collect()
    for k in range(4):
        own = sorted((r.start, r.end, r.language) for r in out if r.id == k)
        assert [x[2] for x in own] == ["en", "ja"] and own[0][0] == 0 and own[0][1] == own[1][0] and own[1][1] == len(texts[k])
        assert own[0][1] == len(one) or k == 3 and len(one) <= own[0][1] <= len(one) + 3
    own = [r for r in out if r.id == 4]
    assert {(r.start, r.end) for r in own} == {(0, len(texts[4]))} and {"en", "es"} == {r.language for r in own}
    keys = {r.id: r.confidence for r in out if r.id in (4, 6) and r.words == 1 and r.language == "en"}
    assert keys[4] > 0.9 and keys[6] < 0.1
    assert not [r for r in out if r.id == 5]


def test_decoding_is_that_of_logistic_losses(found):
    _, _, _, _, model = found
    sums = np.stack([model.word_margins(words_of(_sentence(random.Random(k), x))).sum(0) for k in range(50) for x in WORDS])
    margins = np.clip(4 * sums[:, :-1] / sums[:, -1:], -30, 30).astype(float)
    loss = (np.log1p(np.exp(-margins[:, None] * model.code)) * model.bit_weight).sum(2)
    order = np.sort(loss, 1)
    best, confidence, gap = model.decode(sums)
    assert (best == loss.argmin(1)).all() and np.allclose(gap, order[:, 1] - order[:, 0], atol=1e-4)
    assert np.allclose(confidence, 1 / np.exp(-20 * (loss - order[:, :1])).sum(1), atol=1e-3)


def test_empty(spark, found):
    _, _, df, _, _ = found
    model = fit_on(df.limit(0), LANGUAGES, "row_id", "text", "language")
    segments = language_segments(df, model)
    assert segments.count() > 0 and language_segments(df.limit(0), model).count() == 0
    assert unstated_languages(df.limit(0), model, LANGUAGES).count() == 0 and document_languages(segments.limit(0)).count() == 0
