"""Problem 7: evaluation passages inside the corpus, verbatim or with other parameters.

Words of both sides are canonicalised to templates: numbers, codes, units and names become
typed placeholders, and only the common words of the evaluation items stay. Windows of
``words`` template words are hash-joined; then the slots decide. Equal slots are a verbatim
leak; slots that differ but map one to one throughout the window are a re-parameterised item.
Equal words have equal templates, so no verbatim leak is lost by the canonicalisation.

The corpus side is one map over the documents. A bitmap of fixed size of the items' template
windows keeps most windows of the corpus from being shuffled at all.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.hashing import Rolling
from quillsift.runtime import broadcast_if_small, materialize

WORDS = 12
#: Most common words of the items that stay literal in templates; all others are names.
VOCABULARY = 50_000
#: Bits of the window filter; more items make it less selective, never wrong.
FILTER_BITS = 23
#: Windows handled at once.
CHUNK_WORDS = 1 << 18

_WORD = re.compile(r"[^\W_]+")

# Units of measure that become one placeholder; those that are also ordinary words or letters, such as "in" and "a", stay words.
UNITS = frozenset(
    "mm cm km ft mg kg ml sec secs second seconds mins minute minutes hr hrs hour hours day days week weeks month months year years"
    " hz khz mhz ghz kb mb gb tb kw usd eur gbp dollars euros percent degrees celsius".split()
)
_NUMBER, _CODE, _UNIT, _NAME = (-1, -2, -3, -4)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case; the sharp s, whose capital is SS, as ss."""
    return _WORD.findall(text.lower().replace("\u00df", "ss"))


def _slot_type(word: str, literal: set[str]) -> int:
    if word.isdigit():
        return _NUMBER
    if any(c.isdigit() for c in word):
        return _CODE
    if word in UNITS:
        return _UNIT
    return 0 if word in literal else _NAME


class _Coder:
    """Integer codes of words and of their template words, made once for each distinct word of a chunk."""

    def __init__(self, literal: set[str]) -> None:
        self.literal = literal

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, distinct = pd.factorize(np.array(words, dtype=object))
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)
        kinds = np.array([_slot_type(w, self.literal) for w in distinct], dtype=np.int64)
        template = np.where(kinds == 0, hashed, kinds.view(np.uint64))
        return hashed[number], template[number]


def _chunks(ids: list, texts: list[str | None], size: int, width: int):
    """(ids, numbers of words, all words): groups of whole texts; a longer text comes in overlapping parts."""
    held, numbers, words = [], [], []
    for i, text in zip(ids, texts):
        own = words_of(text) if text else []
        if len(own) < width:
            continue
        for at in range(0, len(own) - width + 1, size):
            part = own[at : at + size + width - 1]
            held.append(i)
            numbers.append(len(part))
            words += part
            if len(words) >= size:
                yield held, numbers, words
                held, numbers, words = [], [], []
    if held:
        yield held, numbers, words


def _windows(literal: set[str], width: int, bits: np.ndarray | None, with_slots: bool):
    def run(batches):
        coder = _Coder(literal)
        for batch in batches:
            for held, numbers, words in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHUNK_WORDS, width):
                exact, template = coder.codes(words)
                keys = Rolling(template).of(width)
                owner = np.repeat(np.arange(len(held)), numbers)
                ok = owner[: len(keys)] == owner[width - 1 :]
                if bits is not None:
                    ok &= bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                at = np.flatnonzero(ok)
                columns = [pa.array(np.array(held, dtype=np.int64)[owner[at]]), pa.array(keys[at].view(np.int64)), pa.array(Rolling(exact).of(width)[at].view(np.int64))]
                names = ["id", "template", "exact"]
                if with_slots:
                    columns.append(pa.array([words[a : a + width] for a in at.tolist()], pa.list_(pa.string())))
                    names.append("words")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _literals(items: DataFrame, most: int = VOCABULARY) -> set[str]:
    """Words that two or more items have in small letters, the ``most`` common ones; a bounded list whose choice only shapes templates.

    A word that the items always capitalise is a name, however often it occurs; scripts without case know only rare words as names.
    """

    def distinct(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted({w for raw in _WORD.findall(text or "") if raw == raw.lower() for w in words_of(raw)}), pa.string())], names=["word"])

    counts = items.select("text").mapInArrow(distinct, "word string").groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    return {r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the template hashes."""
    places = keys.select(F.shiftrightunsigned("template", 64 - FILTER_BITS).alias("b")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[places] = True
    return bits


def template_matches(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", words: int = WORDS, with_slots: bool = False) -> DataFrame:
    """(doc, item, verbatim[, doc_words, item_words]): windows of documents and items with equal templates.

    Null texts and texts of fewer than ``words`` words match nothing. Repeated rows are harmless.
    """
    docs = docs.select(F.col(doc_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    literal = _literals(items)
    columns = "id bigint, template bigint, exact bigint" + (", words array<string>" if with_slots else "")
    item_windows = materialize(items.mapInArrow(_windows(literal, words, None, with_slots), columns).distinct(), "item-windows")
    doc_windows = docs.mapInArrow(_windows(literal, words, _filter_bits(item_windows), with_slots), columns).distinct()
    few = item_windows.select("template", F.col("id").alias("item"), F.col("exact").alias("item_exact"), *([F.col("words").alias("item_words")] if with_slots else []))
    joined = doc_windows.join(broadcast_if_small(few, item_windows.count()), "template")
    kept = [F.col("id").alias("doc"), "item", (F.col("exact") == F.col("item_exact")).alias("verbatim")]
    return joined.select(*kept, *([F.col("words").alias("doc_words"), "item_words"] if with_slots else []))


def verbatim_leaks(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """(doc, item): documents that hold ``words`` consecutive words of an item."""
    return template_matches(docs, items, **columns).filter("verbatim").select("doc", "item").distinct()


def reparameterised(docs: DataFrame, items: DataFrame, least_literals: int = 4, **columns) -> DataFrame:
    """(doc, item, windows): documents that hold a window of an item with other numbers, codes, units or names.

    A slot counts as filled anew only consistently: equal words of the item stand against equal
    words of the document and different ones against different ones. At least
    ``least_literals`` words of the window must be literally equal.
    """
    found = template_matches(docs, items, with_slots=True, **columns).filter("not verbatim")
    pairs = F.arrays_zip("doc_words", "item_words")
    checked = found.filter(
        (F.size(F.array_distinct(pairs)) == F.size(F.array_distinct("doc_words")))
        & (F.size(F.array_distinct(pairs)) == F.size(F.array_distinct("item_words")))
        & (F.size(F.filter(pairs, lambda p: p["doc_words"] == p["item_words"])) >= least_literals)
    )
    return checked.groupBy("doc", "item").agg(F.count("*").alias("windows"))
