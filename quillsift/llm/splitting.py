"""Problem 2: cut oversized items into overlapping pieces at natural boundaries.

An item is read as ranges. A worker finds the boundaries of its range (with a halo on each
side) and tabulates, for every place at which a cut can enter the range, the cut at which it leaves;
paths from different entries soon run together, so the table is kept as a few runs of entries with
one exit. Stitching reads these small tables in range order, sums up the lengths of the ranges and
gives the one cut at which each range is entered. Then all ranges emit their pieces independently.

For files the ranges are byte ranges, which are read once for the tables and once for the pieces;
what is shuffled are tables and descriptors, never text. The text of a row is at hand as a whole, so
its ranges are handled by one worker, unless it is longer than ``GIANT``.

The cut after a cut ``c`` lies within ``max_size`` of the start of its piece, which is ``c - overlap``.
In the farther half of the reachable stretch the strongest kind of boundary wins (blank line,
line, sentence, word) and the last of that kind; else the last boundary before; else, where
the text has no boundary at all, the limit itself, moved off combining marks and joiners.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

import numpy as np
import pandas as pd
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of a row's text beyond which its ranges, of so many code points, go to several workers.
GIANT = 1 << 24
#: Code points before a range that are looked at beside the overlap, for boundaries that begin there.
LEFT = 64

#: A cut is possible after a match: blank line, line end, sentence end, blank or separator.
_BOUNDARY = regex.compile(
    r"(?P<para>\n[ \t]*\n+)|(?P<line>\r\n|[\n\r\u2028\u2029\x85])|(?P<sent>[.!?\u0964\u061f]['\")\]]*\s|[\u3002\uff01\uff1f]['\")\]\u300d\u300f]*)|(?P<word>\s|[,;\u3001\uff0c\uff1b])"
)
_RANK = {"para": 4, "line": 3, "sent": 2, "word": 1}
_CLINGS = regex.compile(r"[\p{M}\u200d\u200c\ufe0e\ufe0f]")


class _Range:
    """One range of an item with its halos; positions count from the start of the range.

    ``text`` begins ``head`` code points before it, ``own`` is its length, and ``end`` is where the item
    ends, None if that is beyond the halo.
    """

    def __init__(self, text: str, head: int, own: int, end: int | None, max_size: int, overlap: int) -> None:
        self.text, self.head, self.own, self.end, self.max_size, self.overlap = text, head, own, end, max_size, overlap
        kinds: list[list[int]] = [[] for _ in range(5)]
        for m in _BOUNDARY.finditer(text):
            for rank in range(1, _RANK[m.lastgroup] + 1):
                kinds[rank].append(m.end() - head)
        self.kinds = [np.array(k, dtype=np.int64) for k in kinds]
        self.lists = kinds

    def begin(self, cut: int) -> int:
        """Where the piece after ``cut`` begins."""
        return max(-self.head, cut - self.overlap)

    def _last(self, rank: int, above: int, upto: int) -> int | None:
        cuts = self.lists[rank]
        k = bisect_right(cuts, upto) - 1
        return cuts[k] if k >= 0 and cuts[k] > above else None

    def next_cut(self, cut: int) -> int:
        limit = self.begin(cut) + self.max_size
        if self.end is not None and limit >= self.end:
            return self.end
        half = (cut + limit) // 2
        for rank in (4, 3, 2, 1):
            if (found := self._last(rank, half, limit)) is not None:
                return found
        if (found := self._last(1, cut, half)) is not None:
            return found
        hard, text = limit, self.text
        while hard > half and (_CLINGS.match(text, hard + self.head) or text[hard + self.head - 1] == "\u200d"):
            hard -= 1
        return hard if hard > half else limit

    def next_cuts(self, cuts: np.ndarray) -> np.ndarray:
        """``next_cut`` of many cuts."""
        limit = np.maximum(-self.head, cuts - self.overlap) + self.max_size
        half = (cuts + limit) // 2
        out = np.full(len(cuts), self.end) if self.end is not None else np.zeros(len(cuts), np.int64)
        todo = limit < self.end if self.end is not None else np.ones(len(cuts), bool)
        for rank, above, upto in ((4, half, limit), (3, half, limit), (2, half, limit), (1, half, limit), (1, cuts, half)):
            ends = self.kinds[rank]
            if len(ends) and todo.any():
                k = np.searchsorted(ends, upto, side="right") - 1
                found = todo & (k >= 0) & (ends[k] > above)
                out[found] = ends[k[found]]
                todo &= ~found
        for k in np.flatnonzero(todo):
            out[k] = self.next_cut(int(cuts[k]))
        return out

    def table(self, first: bool) -> tuple[list[int], list[int]]:
        """(first entry of each run, its exit): by entry the first cut at or after the end of the range."""
        entries = np.arange(1 if first else min(self.max_size, self.own))
        cut = entries.copy()
        while (inside := cut < self.own).any():
            distinct, which = np.unique(cut[inside], return_inverse=True)
            cut[inside] = self.next_cuts(distinct)[which]
        new = np.flatnonzero(np.diff(cut, prepend=-1))
        return entries[new].tolist(), cut[new].tolist()

    def pieces(self, entry: int):
        """(start, end, text) of the pieces that begin after a cut in the range."""
        cut = entry
        while cut < self.own:
            end, start = self.next_cut(cut), self.begin(cut)
            yield start, end, self.text[start + self.head : end + self.head]
            cut = end


class _Stitch:
    """Reads the tables of an item in range order: where each range starts and at which cut it is entered."""

    def __init__(self) -> None:
        self.start, self.cut = 0, 0

    def enter(self, own: int, entries: list[int], exits: list[int]) -> tuple[int, int | None]:
        """(start of the next range in the item, entry into it); entry None if no piece begins in it."""
        start, at = self.start, self.cut - self.start
        self.start += own
        if at >= own:
            return start, None
        self.cut = start + exits[bisect_right(entries, at) - 1]
        return start, at


def _split_rows(frames):
    """Pieces of the texts of rows, range by range of one limit each: tables, stitching, emission."""
    for pdf in frames:
        out = []
        for i, text, most, overlap in zip(pdf.id, pdf.whole, pdf.max_size, pdf.overlap):
            ranges = []
            for start in range(0, len(text), most):
                head, stop = min(start, overlap + LEFT), start + 3 * most
                ranges.append(_Range(text[start - head : stop], head, min(most, len(text) - start), len(text) - start if stop >= len(text) else None, int(most), int(overlap)))
            tables, stitch = [r.table(k == 0) for k, r in enumerate(ranges)], _Stitch()
            for r, (entries, exits) in zip(ranges, tables):
                start, entry = stitch.enter(r.own, entries, exits)
                if entry is not None:
                    out += [(i, start + s, start + e, t) for s, e, t in r.pieces(entry)]
        yield pd.DataFrame(out, columns=["id", "start", "end", "text"])


def _tables(load):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                own = load(r)
                entries, exits = own.table(r.range_no == 0)
                yield pd.DataFrame({"id": [r.id], "range_no": [r.range_no], "own": [own.own], "entries": [entries], "exits": [exits]})

    return run


def _stitched(frames):
    """Reads rows sorted by item and range; what is kept of an item is one cut and one sum."""
    now, stitch = None, _Stitch()
    for pdf in frames:
        out = []
        for r in pdf.itertuples():
            if r.id != now:
                now, stitch = r.id, _Stitch()
            out.append((r.id, r.range_no, *stitch.enter(int(r.own), list(r.entries), list(r.exits))))
        made = pd.DataFrame(out, columns=["id", "range_no", "start", "entry"])
        yield made.assign(entry=made.entry.astype("Int64"))


def _emitted(load):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                at = int(r.start)
                found = [(r.id, at + s, at + e, t) for s, e, t in load(r).pieces(int(r.entry))]
                yield pd.DataFrame(found, columns=["id", "start", "end", "text"])

    return run


def _pieces_of(ranges: DataFrame, load) -> DataFrame:
    """(id, start, end, text) of the pieces of items given as rows (id, range_no, what ``load`` needs)."""
    tables = ranges.mapInPandas(_tables(load), "id bigint, range_no int, own bigint, entries array<bigint>, exits array<bigint>")
    stitched = tables.repartition("id").sortWithinPartitions("id", "range_no").mapInPandas(_stitched, "id bigint, range_no int, start bigint, entry bigint")
    entered = ranges.join(stitched.filter("entry IS NOT NULL"), ["id", "range_no"])
    return entered.mapInPandas(_emitted(load), "id bigint, start bigint, end bigint, text string")


def _loaded(r) -> _Range:
    return _Range(r.text, int(r.head), int(r.own), None if pd.isna(r.end) else int(r.end), int(r.max_size), int(r.overlap))


def _checked(max_size, overlap):
    return F.when((overlap >= 0) & (max_size > 2 * overlap), overlap).otherwise(F.floor(max_size / 4).cast("int"))


def split_texts(df: DataFrame, id_col: str, text_col: str, max_size, overlap, giant: int = GIANT) -> DataFrame:
    """Pieces (id, start, end, text) of the rows whose text has more than ``max_size`` code points.

    ``max_size`` and ``overlap`` are columns. Null or empty texts, texts within the limit and rows
    without a limit give no piece; a repeated row (same id) counts once; an overlap of half the
    limit or more is taken as a quarter of it, so that pieces always advance. Offsets are code
    points of the text, end exclusive; a null overlap counts as 0.
    """
    items = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("whole"), max_size.cast("int").alias("max_size"), overlap.cast("int").alias("overlap"))
        .withColumn("length", F.length("whole").cast("bigint"))
        .filter("max_size > 0 and length > max_size")
        .withColumn("overlap", _checked(F.col("max_size"), F.coalesce("overlap", F.lit(0))))
    )
    items = items.groupBy("id").agg(*(F.first(c).alias(c) for c in ("whole", "max_size", "overlap", "length")))
    rows = items.filter(F.col("length") <= giant).select("id", "whole", "max_size", "overlap")
    size = F.greatest(F.lit(giant), 2 * F.col("max_size"))
    ranges = (
        items.filter(F.col("length") > giant)
        .withColumn("range_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))))
        .withColumn("start", (F.col("range_no") * size).cast("bigint"))
        .withColumn("head", F.least("start", F.col("overlap") + LEFT))
        .withColumn("own", F.least(size.cast("bigint"), F.col("length") - F.col("start")))
        .withColumn("stop", F.col("start") + F.col("own") + 2 * F.col("max_size"))
        .withColumn("end", F.when(F.col("stop") >= F.col("length"), F.col("length") - F.col("start")))
        .withColumn("text", F.expr("substring(whole, int(start - head + 1), int(stop - start + head))"))
    )
    shape = "id bigint, start bigint, end bigint, text string"
    return rows.mapInPandas(_split_rows, shape).unionByName(_pieces_of(ranges.select("id", "range_no", "text", "head", "own", "end", "max_size", "overlap"), _loaded))


@functools.lru_cache(16)
def _file(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a path or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _read(path: str, start: int, stop: int) -> bytes:
    system, name = _file(path)
    with system.open_input_file(name) as f:
        return f.read_at(max(0, min(stop, f.size()) - start), start)


def _whole_characters(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _read_range(r) -> _Range:
    """A byte range with its halos; a character belongs to the range that holds its first byte."""
    most, overlap = int(r.max_size), int(r.overlap)
    back = min(r.byte_start, 4 * (overlap + LEFT) + 4)
    stop = r.byte_stop + 8 * most + 8
    data = _read(r.path, r.byte_start - back, stop)
    begin = _whole_characters(data, back)
    end = _whole_characters(data, back + r.byte_stop - r.byte_start)
    head = data[:begin].decode("utf-8", "ignore")[-(overlap + LEFT) :]
    own = data[begin:end].decode("utf-8", "replace")
    after = data[end:].decode("utf-8", "replace" if stop >= r.size else "ignore")
    return _Range(head + own + after, len(head), len(own), len(own) + len(after) if stop >= r.size else None, most, overlap)


def split_files(spark: SparkSession, paths: list[str], max_size: int, overlap: int, range_bytes: int = 64 << 20) -> DataFrame:
    """Pieces (id, start, end, text) of UTF-8 files on storage that every executor reaches; ``id`` is the index in ``paths``.

    Only byte ranges are read, never a whole file. A file within the limit gives one piece; an
    empty file gives none.
    """
    rows = []
    for k, path in enumerate(paths):
        system, name = _file(path)
        size = system.get_file_info(name).size
        step = max(range_bytes, 8 * max_size)
        rows += [(k, n, path, at, min(size, at + step), size, max_size, overlap) for n, at in enumerate(range(0, size, step))]
    shape = "id bigint, range_no int, path string, byte_start bigint, byte_stop bigint, size bigint, max_size int, overlap int"
    if not rows:
        return spark.createDataFrame([], "id bigint, start bigint, end bigint, text string")
    return _pieces_of(spark.createDataFrame(rows, shape).repartition(min(len(rows), 10_000), "id", "range_no"), _read_range)
