import random

import pytest
from pyspark.sql import functions as F

from quillsift.llm.splitting import split_files, split_texts


def _pieces(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r.start, r.end, r.text))
    return {k: sorted(v) for k, v in out.items()}


def _check(pieces, text, size, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for s, e, t in pieces:
        assert 0 < e - s <= size and t == text[s:e]
    for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]):
        assert s == e - overlap


def _texts():
    rnd = random.Random(5)
    words = ["alpha", "béta", "日本語。", "x" * 70, "\n\n", "end.", "😀", "नमस्ते", "a\u0301"]
    return [" ".join(rnd.choice(words) for _ in range(n)) for n in (3, 40, 200, 1500)] + ["y" * 333, "", "e\u0301" * 200]


def _split(spark, texts, size, overlap, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("length", F.lit(1))
    return _pieces(split_texts(df, "id", "text", F.lit(size), F.lit(overlap), **more))


def test_sizes_overlaps_and_offsets(spark):
    texts = _texts()
    got = _split(spark, texts, 100, 12)
    assert set(got) == {k for k, t in enumerate(texts) if len(t) > 100}
    for k, pieces in got.items():
        _check(pieces, texts[k], 100, 12)


def test_ranges_do_not_change_the_pieces(spark):
    texts = _texts()
    assert _split(spark, texts, 100, 12, giant=200) == _split(spark, texts, 100, 12)


def test_natural_boundaries_win(spark):
    text = "One sentence here. Another sentence there.\n\nA new paragraph starts and goes on for long enough to be cut."
    first, *rest = _split(spark, [text], 60, 5)[0]
    assert first[2].endswith("\n\n")
    assert all(p[2][-1] in " \n." for p in rest)


def test_marks_stay_with_their_letter(spark):
    for s, e, t in _split(spark, ["e\u0301" * 200], 51, 3)[0][:-1]:
        assert t[-1] == "\u0301"


def test_nulls_repeats_and_missing_limits(spark):
    rows = [(1, None, 10), (2, "", 10), (3, "word " * 9, None), (4, "word " * 9, 10), (4, "word " * 9, 10), (5, "word " * 9, 0)]
    df = spark.createDataFrame(rows, "id bigint, text string, m int")
    got = _pieces(split_texts(df, "id", "text", F.col("m"), F.lit(None)))
    assert set(got) == {4}
    _check(got[4], "word " * 9, 10, 0)
    assert split_texts(df.limit(0), "id", "text", F.col("m"), F.lit(1)).count() == 0


@pytest.mark.parametrize("range_bytes", [800, 1 << 20])
def test_files_by_byte_ranges(spark, tmp_path, range_bytes):
    texts = [t * 3 for t in _texts()]
    paths = []
    for k, t in enumerate(texts):
        paths.append(str(tmp_path / f"{k}.txt"))
        (tmp_path / f"{k}.txt").write_bytes(t.encode())
    got = _pieces(split_files(spark, paths, 100, 12, range_bytes=range_bytes))
    assert set(got) == {k for k, t in enumerate(texts) if t}
    for k, pieces in got.items():
        _check(pieces, texts[k], 100, 12)
    assert split_files(spark, [], 100, 12).count() == 0


def test_files_are_split_as_rows_are(spark, tmp_path):
    text = "".join(_texts()) * 6
    (tmp_path / "a b.txt").write_text(text, encoding="utf-8", newline="")
    got = _pieces(split_files(spark, [(tmp_path / "a b.txt").as_uri()], 100, 12, range_bytes=800))[0]
    assert got == _split(spark, [text], 100, 12)[0]


def test_torn_bytes(spark, tmp_path):
    data = ("é日本 " * 300).encode()
    (tmp_path / "t").write_bytes(data[1:-2])
    pieces = _pieces(split_files(spark, [str(tmp_path / "t")], 50, 6, range_bytes=400))[0]
    _check(pieces, data[1:-2].decode("utf-8", "replace"), 50, 6)


def test_registered_query_covers_every_file(spark):
    import os

    import pytest

    from quillsift.llm.queries import queries

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    want = sorted(t + "\n" for t, in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").select("text").collect())
    pieces = _pieces(queries()["p2_files"](spark, "/root/testdata/sf0.001"))
    whole = []
    for own in pieces.values():
        text = own[0][2] + "".join(t[256:] for _, _, t in own[1:])
        _check(own, text, 4096, 256)
        whole.append(text)
    assert sum(map(len, whole)) == sum(map(len, want)) and all(any(t in w for w in whole) for t in want)
