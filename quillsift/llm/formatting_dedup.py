"""Problem 5: collapse records that differ only in formatting.

Both columns are dictionary-encoded. The dictionary of a task holds each distinct value, of
texts, of JSON field names and of JSON values, with its identifier: a 128-bit integer made from
the canonical form, for which the value is canonicalised once. Identifiers follow from the
values, so the dictionaries of all tasks agree and no text is shuffled to make them agree.
A record becomes a sorted tuple of (field, value) identifiers; only these compact tuples are
written, shuffled and grouped, with map-side combination.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.runtime import materialize

#: Characters of values that the dictionary of a task holds at most, counting 100 more for each.
MOST = 1 << 24

_DROPPED = regex.compile(r"[\s\p{P}]+")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")


def canonical_value(text: str) -> str:
    """``text`` without whitespace and punctuation (category P), in lower case.

    Letter case is a matter of single characters: the sharp s and SS, which are one and two letters, differ.
    """
    return _DROPPED.sub("", text.lower())


class _Encoder:
    """The dictionary of a task: identifiers of distinct values, each canonicalised once.

    Beyond ``MOST`` characters of values it starts anew, which costs time and changes no identifier.
    """

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.records: dict[str, list[int] | None] = {}
        self.held = 0

    def _hold(self, text: str) -> None:
        self.held += len(text) + 100
        if self.held > MOST:
            self.known, self.records, self.held = {}, {}, len(text) + 100

    def value(self, text: str) -> tuple[int, int]:
        found = self.known.get(text)
        if found is None:
            self._hold(text)
            found = self.known[text] = self.digest(b"v", canonical_value(text).encode("utf-8", "surrogatepass"))
        return found

    def column(self, text: str) -> list[int] | None:
        """The tuple of a value of the text column; None without a letter or digit."""
        if text not in self.records:
            self._hold(text)
            self.records[text] = self.record(text) if _WORDLIKE.search(text) else None
        return self.records[text]

    @staticmethod
    def digest(kind: bytes, data: bytes) -> tuple[int, int]:
        raw = xxhash.xxh3_128_digest(kind + data)
        return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)

    def node(self, x: object) -> tuple[int, int]:
        if isinstance(x, _Fields):
            return self.digest(b"o", repr(self.fields(x)).encode())
        if isinstance(x, list):
            return self.digest(b"a", repr([self.node(y) for y in x]).encode())
        return self.value(x if isinstance(x, str) else json.dumps(x))

    def fields(self, x: _Fields) -> list[tuple[int, int, int, int]]:
        return sorted((*self.value(k), *self.node(v)) for k, v in x)

    def record(self, text: str) -> list[int]:
        if text.lstrip()[:1] == "{":
            try:
                parsed = json.loads(text, object_pairs_hook=_Fields, parse_float=str, parse_int=str)
            except (ValueError, RecursionError):
                parsed = None
            if isinstance(parsed, _Fields):
                return [n for pair in self.fields(parsed) for n in pair]
        return list(self.digest(b"v", canonical_value(text).encode("utf-8", "surrogatepass")))


class _Fields(list):
    """The fields of a JSON object, in order."""


def _encode(batches):
    encoder = _Encoder()
    for batch in batches:
        ids, label, texts = batch.column(0), batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
        keys = [None if t is None else encoder.column(t) for t in texts.dictionary.to_pylist()]
        tuples = pa.array(keys, pa.list_(pa.int64())).take(texts.indices)
        labels = pa.array([None if x is None else encoder.digest(b"l", x.encode("utf-8", "surrogatepass"))[0] for x in label.dictionary.to_pylist()], pa.int64()).take(label.indices)
        yield pa.RecordBatch.from_arrays([ids, batch.column(1), labels, tuples], names=["id", "label", "label_id", "fields"])


def encoded_records(df: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(id, label, label_id, fields) of every record whose text has a letter or digit.

    Null, empty and punctuation-only texts have no key and are left out; a null label is a value
    of its own; a text that is a JSON object is keyed by its fields in sorted order at any depth.
    Other columns of ``df`` are ignored.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_encode, "id bigint, label string, label_id bigint, fields array<bigint>").filter("fields is not null")


def collapse_formatting(df: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """One row for each group: (id of the kept record = smallest, label, copies).

    Repeated ids count once. An empty table gives an empty result.
    """
    records = encoded_records(df, id_col, text_col, label_col)
    return (
        records.groupBy("label_id", "fields", "id").agg(F.first("label").alias("label"))
        .groupBy("label_id", "fields").agg(F.min("id").alias("id"), F.first("label").alias("label"), F.count("*").alias("copies"))
        .select("id", "label", "copies")
    )


def formatting_copies(df: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(id_a, id_b): the smallest id of each group of two or more with each other id.

    The texts are encoded once, into a written table of tuples. Groups are found by a combined
    aggregate; the tuples of the members meet only the one row of their group, so a hot group is a
    skewed join side that AQE can split, never one task's window.
    """
    records = encoded_records(df, id_col, text_col, label_col).select(
        "id", F.xxhash64("label_id", "fields").alias("h"), F.struct(F.coalesce("label_id", F.lit(0)).alias("label"), F.col("label_id").isNull().alias("none"), "fields").alias("key")
    )
    records = materialize(records, "tuples")
    firsts = records.groupBy("h", "key").agg(F.min("id").alias("id_a"), F.max("id").alias("last")).filter("last > id_a").drop("last")
    return (
        records.join(firsts, ["h", "key"]).filter("id > id_a")
        .select("id_a", F.col("id").alias("id_b")).distinct()
    )
