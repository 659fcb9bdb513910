"""Problem 1: one consistent form for text that looks the same.

Tokens are read by a weighted edit automaton over a trie of canonical spellings. Reading a
look-alike, a width or compatibility form or a combining sequence as the character it looks
like costs nothing, and so does skipping an ignorable; every other edit costs its weight. With
the budget of 0 only spellings that look the same are reached; with a larger one what is reached is
compared in the table form, so what comes out equal always looked equal. The trie holds the most
frequent spellings of the corpus, in any script, by exact counts over all texts; a token that no
path matches is normalised by the same table, character by character.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.runtime import materialize

#: Spellings of the trie: the most frequent ones, of equal ones the first in order. It bounds what is broadcast.
SPELLINGS = 1 << 15

# Code points of letters of other scripts, and the Latin letters that they look like.
CYRILLIC = """
0430 a  0435 e  043e o  0440 p  0441 c  0443 y  0445 x  0455 s  0456 i  0458 j  04bb h  04cf l  0475 v  0501 d  051b q  051d w
0410 A  0412 B  0415 E  041a K  041c M  041d H  041e O  0420 P  0421 C  0422 T  0425 X  0405 S  0406 I  0408 J  04ae Y  04c0 I  0474 V  050c G  051a Q  051c W
"""
GREEK = """
03bf o  03bd v  03f2 c  03f3 j
0391 A  0392 B  0395 E  0396 Z  0397 H  0399 I  039a K  039c M  039d N  039f O  03a1 P  03a4 T  03a5 Y  03a7 X  03f9 C  037f J
"""
ARMENIAN = "0585 o  057d u  0578 n  0570 h  0581 g  0555 O  054d U  053c L"
CHEROKEE = "13aa A  13b3 W  13ac E  13a0 D  13a1 R  13a2 T  13c0 G  13bb H  13ab J  13e6 K  13de L  13b7 M  13e2 P  13da S  13d9 V  13c3 Z"


def _pairs(table: str) -> dict[int, str]:
    cells = table.split()
    return {int(point, 16): letter for point, letter in zip(cells[::2], cells[1::2])}


LATIN = _pairs(CYRILLIC) | _pairs(GREEK) | _pairs(ARMENIAN) | _pairs(CHEROKEE)
#: From Latin back to Cyrillic, for words that have letters only Cyrillic has.
_BACK = {letter: chr(point) for point, letter in sorted(_pairs(CYRILLIC).items(), reverse=True)}

_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\ufff9-\ufffb]+")
#: Text without any of these, in form NFKC, is its own canonical form.
_SUSPECT = regex.compile(r"[\p{Default_Ignorable_Code_Point}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\ufff9-\ufffb\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]")
_BLANKS = regex.compile(r"(\s+)")
_CYRILLIC_ONLY = regex.compile(r"\p{Cyrillic}")


def table_form(text: str) -> str:
    """``text`` with every character replaced by the ordinary one that it looks like."""
    plain = unicodedata.normalize("NFKC", _IGNORED.sub("", text))
    plain = unicodedata.normalize("NFD", _IGNORED.sub("", plain)).translate(LATIN)
    return unicodedata.normalize("NFC", plain)


def plain_form(text: str) -> str:
    """``table_form`` of a text, at once where nothing in it can look like anything else."""
    return text if text.isascii() or (not _SUSPECT.search(text) and unicodedata.is_normalized("NFKC", text)) else table_form(text)


def own_script(plain: str) -> str:
    """A table form with Cyrillic letters and no unmatched Latin one, spelled in Cyrillic throughout."""
    if _CYRILLIC_ONLY.search(plain):
        letters = unicodedata.normalize("NFD", plain)
        if not any("a" <= c.lower() <= "z" and c not in _BACK for c in letters):
            return unicodedata.normalize("NFC", "".join(_BACK.get(c, c) for c in letters))
    return plain


class Spellings:
    """Trie of canonical spellings and the automaton that reads tokens over it."""

    def __init__(self, spellings: list[tuple[str, int]], budget: float = 0.0, weight: float = 1.0) -> None:
        best: dict[str, tuple[int, str]] = {}
        for spelling, n in spellings:
            plain = table_form(spelling)
            if not plain or _BLANKS.search(plain) or _IGNORED.search(spelling) or not unicodedata.is_normalized("NFC", spelling):
                continue
            if spelling == plain or _SUSPECT.search(plain):
                best[plain] = max(best.get(plain, (0, "")), (n, spelling))
        self.root: dict = {}
        for plain, (n, spelling) in best.items():
            node = self.root
            for c in unicodedata.normalize("NFD", plain):
                node = node.setdefault(c, {})
            node[""] = (n, spelling)
        self.budget, self.weight = budget, weight
        self.reads: dict[str, str] = {}
        self.known: dict[str, str] = {}

    def read(self, token: str) -> str:
        """The characters that ``token`` is read as; ignorables read as nothing."""
        out = []
        for c in token:
            r = self.reads.get(c)
            if r is None:
                r = self.reads[c] = unicodedata.normalize("NFD", table_form(c))
            out.append(r)
        return unicodedata.normalize("NFD", "".join(out))

    def match(self, token: str) -> str | None:
        """The spelling of least cost within the budget; the more frequent one of equals."""
        frontier = self._skips([(0.0, self.root)])
        for c in self.read(token):
            after = []
            for cost, node in frontier:
                if c in node:
                    after.append((cost, node[c]))
                if cost + self.weight <= self.budget:
                    after.append((cost + self.weight, node))
                    after += [(cost + self.weight, child) for d, child in node.items() if d and d != c]
            if not after:
                return None
            frontier = self._skips(after)
        ends = [(cost, -node[""][0], node[""][1]) for cost, node in frontier if "" in node]
        return min(ends)[2] if ends else None

    def _skips(self, frontier: list) -> list:
        """The frontier with spelling characters left out at their cost, each node once at its least cost."""
        if self.budget <= 0:
            return frontier
        least: dict[int, tuple[float, dict]] = {}
        todo = list(frontier)
        while todo:
            cost, node = todo.pop()
            if cost <= self.budget and cost < least.get(id(node), (self.budget + 1, node))[0]:
                least[id(node)] = (cost, node)
                todo += [(cost + self.weight, child) for d, child in node.items() if d]
        return list(least.values())

    def token(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            plain, found = table_form(token), self.match(token)
            if found is None or (self.budget > 0 and table_form(found) != plain):
                found = own_script(plain)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = found
        return found

    def text(self, text: str) -> str:
        """The consistent form of ``text``: special spaces become spaces, all other blanks stay as they are."""
        if not _SUSPECT.search(text) and (text.isascii() or unicodedata.is_normalized("NFKC", text)):
            return text
        parts = _BLANKS.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                parts[k] = unicodedata.normalize("NFKC", part)
            elif part:
                parts[k] = self.token(part)
        return "".join(parts)


def _count(batches):
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(text.split())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])


def spellings(texts: DataFrame, most: int = SPELLINGS) -> list[tuple[str, int]]:
    """(spelling, count) of the ``most`` frequent tokens of a one-column frame that occur twice or more."""
    counts = texts.mapInArrow(_count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = texts.mapInArrow(_count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    # the partitions' candidates meet in one task and not on the driver
    first = materialize(counts.orderBy(F.desc("n"), "token").limit(most), "spellings")
    return [(r.token, r.n) for r in first.collect()]


#: The trie of the last vocabulary that this worker process has read.
_READ: dict[str, Spellings] = {}


def _trie(name: str, frequent) -> Spellings:
    if name not in _READ:
        _READ.clear()
        _READ[name] = Spellings(frequent.value)
    return _READ[name]


def _form(frequent, keyed: bool):
    name = uuid.uuid4().hex

    def run(batches):
        trie = _trie(name, frequent)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            forms = [None if t is None else trie.text(t) for t in texts]
            columns = list(batch.columns[:-1])
            if keyed:
                data = [f.encode("utf-8", "surrogatepass") for f in forms]
                columns += [pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary())]
                columns += [pa.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "id", "form", "variant"])
            else:
                columns += [pa.array(forms, pa.string()), pa.array([None if t is None else t != f for t, f in zip(texts, forms)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "id", "text", "changed"])

    return run


def _sources(frames: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("source"), F.col(i).cast("bigint").alias("id"), F.col(t).alias("text")) for name, df, i, t in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _frequent(rows: DataFrame):
    return rows.sparkSession.sparkContext.broadcast(spellings(rows.select("text")))


def consistent_texts(frames: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(source, id, text, changed) of every row of the frames, given as (name, frame, id column, text column).

    One vocabulary serves all frames. A null text stays null, an empty one empty; a text of
    ignorables alone becomes empty. Blanks keep their number and kind.
    """
    rows = _sources(frames)
    return rows.mapInArrow(_form(_frequent(rows), False), "source string, id bigint, text string, changed boolean")


def disguised_pairs(frames: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(source, id_a, id_b): rows of one frame with different texts of the same consistent form.

    Variants of a form are paired first and rows joined to them afterwards, so equal texts, which
    may be a third of all rows, are never compared with each other. Null texts are no case; repeated
    rows (same id) count once.
    """
    rows = _sources(frames).filter("text is not null")
    forms = rows.mapInArrow(_form(_frequent(rows), True), "source string, id bigint, form binary, variant bigint")
    forms = materialize(forms.distinct(), "forms")
    several = forms.groupBy("source", "form").agg(F.min("variant").alias("v"), F.max("variant").alias("w")).filter("v != w").select("source", "form")
    members = materialize(forms.join(several, ["source", "form"], "left_semi"), "disguised")
    variants = members.select("source", "form", "variant").distinct()
    pairs = (
        variants.withColumnRenamed("variant", "v").join(variants.withColumnRenamed("variant", "w"), ["source", "form"]).filter("v < w")
        .join(members.select("source", "form", F.col("variant").alias("v"), F.col("id").alias("x")), ["source", "form", "v"])
        .join(members.select("source", "form", F.col("variant").alias("w"), F.col("id").alias("y")), ["source", "form", "w"])
    )
    return pairs.filter("x != y").select("source", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
