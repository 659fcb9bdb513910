"""Problem 3: the languages of documents and of the segments of mixed ones.

Each language has a binary codeword. For each bit a classifier over hashed character n-grams
of words (a log-odds model of the languages with and without the bit) gives a margin; the
margins of a segment are decoded to the codeword of least loss, bits weighted by how well they
separated the training sample. The distances to the other codewords give the confidence, that to
the runner-up flags ambiguous segments. Labels are not trusted: after a first fit, sentences whose decoding
contradicts their label are relabelled and the classifiers fitted again.
"""

from __future__ import annotations

import bisect
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.hashing import mixed
from quillsift.llm.lookalike import plain_form
from quillsift.runtime import hash_sample

#: Labelled rows that the classifiers are fitted on at most; the choice goes by a hash of the id.
SAMPLE = 12_000
#: Hashed n-gram features, as a power of two, and bits of a codeword.
FEATURES, BITS = 16, 31
#: Words of a block in which a change of language inside one sentence is looked for, and least words of a part.
BLOCK, PART = 5, 4
#: A segment is ambiguous if the losses of its two nearest codewords differ by less than this.
AMBIGUOUS = 0.02
#: A word is known if the sample has it in so many places; other words, often names, weigh UNKNOWN.
KNOWN, UNKNOWN = 8, 0.1
#: Gap between the codewords times weight of the words from which on a segment is evidence of a language.
EVIDENCE = 0.5
#: Parts of a JSON text.
VALUE, KEYS = 1, 2
#: Words of a line from which on a line break without punctuation ends a segment.
LINE_WORDS = 5

_SENTENCE = regex.compile(r"[^.!?\u0964\u061f\u3002\uff01\uff1f]+(?:[.!?\u0964\u061f\u3002\uff01\uff1f]+|$)")
_LINE = regex.compile(r"[^\n\r\u2028\u2029]+")
_HAN_KANA = r"\p{Han}\p{Hiragana}\p{Katakana}\u30fc"
_LETTERS = re.compile(r"(?<![0-9a-z])[a-z]+(?![0-9a-z])")
_WORD = regex.compile(rf"(?V1)[{_HAN_KANA}]+|(?<![\p{{L}}\p{{N}}])[[\p{{L}}\p{{M}}]--[{_HAN_KANA}]]++(?!\p{{N}})")
_RUN = regex.compile(rf"[{_HAN_KANA}]")


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 and -1 with distances as even and as large as a seeded search finds."""
    best, least = None, -1.0
    rng = np.random.default_rng(seed)
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, 1, -1)
        for column in code.T:
            if abs(column.sum()) > n - 4:
                column[rng.choice(n, n // 2, replace=False)] *= -1
        agree = code @ code.T - 2 * bits * np.eye(n)
        distance = (bits - agree.max()) / 2 if n > 1 else bits
        if distance > least:
            best, least = code, distance
    return best.astype(np.float32)


def words_of(text: str) -> list[str]:
    """Words in lower case and plain characters, without codes; Han and Kana runs as pairs of characters."""
    if text.isascii():
        return _LETTERS.findall(text.lower())
    found = _WORD.findall(plain_form(text).lower())
    if not _RUN.search(text):
        return found
    return [p for w in found for p in ([w[k : k + 2] for k in range(max(1, len(w) - 1))] if _RUN.match(w) else [w])]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of ``text``; a line break ends one only between lines of some words."""
    out = []
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        lines = list(_LINE.finditer(text, start, end)) if "\n" in m.group() or "\r" in m.group() else []
        if len(lines) < 2:
            out.append((start, end, words_of(m.group())))
            continue
        held, begin = [], start
        for line in lines:
            own = words_of(line.group())
            if len(held) >= LINE_WORDS and len(own) >= LINE_WORDS:
                out.append((begin, line.start(), held))
                held, begin = [], line.start()
            held = held + own
        out.append((begin, end, held))
    return [x for x in out if x[2]]


def json_strings(text: str) -> list[str] | None:
    """The string values of a text that is a JSON object, at any depth; None for another text."""
    found = _json_parts(text)
    return found and found[1]


def _json_parts(text: str) -> tuple[list[str], list[str]] | None:
    """The keys and the string values of a text that is a JSON object, at any depth; None for another text."""
    if text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    keys, out, todo = [], [], [found]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, (dict, list)):
            keys += x if isinstance(x, dict) else []
            todo += list(x.values()) if isinstance(x, dict) else x
    return keys, out


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, where those of each word begin): n-grams of 1 to 4 with word ends, and the word itself."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    features, owners = [], []
    rolling = mixed(points)
    for n in range(1, 5):
        m = len(points) - n + 1
        if m <= 0:
            break
        if n > 1:
            rolling = mixed(rolling[:m] * np.uint64(31) + points[n - 1 :])
        ok = owner[:m] == owner[n - 1 :]
        if n == 1:
            ok = points != 32
        features.append(rolling[:m][ok])
        owners.append(owner[:m][ok])
    whole = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    features.append(whole)
    owners.append(np.arange(len(words)))
    feature, own = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (feature[order] >> np.uint64(64 - FEATURES)).astype(np.int64), np.searchsorted(own[order], np.arange(len(words)))


class Model:
    """Fitted classifiers: per n-gram the margins of all bits, and the weights of the bits."""

    def __init__(self, languages: list[str], weights: np.ndarray, code: np.ndarray, known: set[str]) -> None:
        self.languages, self.weights, self.code, self.known = languages, weights, code, known
        self.bit_weight = np.full(code.shape[1], 1 / code.shape[1], np.float32)

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Mean margin of the n-grams of each word, by bit, times the weight of the word, which is the last column."""
        out = np.zeros((len(words), self.code.shape[1] + 1), np.float32)
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            feature, begin = _ngrams(part)
            sums = np.add.reduceat(self.weights[feature], begin, axis=0)
            weight = np.array([1 if w in self.known else UNKNOWN for w in part], np.float32)
            out[k : k + 4096, :-1] = sums * (weight / np.diff(np.append(begin, len(feature))))[:, None]
            out[k : k + 4096, -1] = weight
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword for each row of mean margins, less what is the same for all codewords.

        The loss of a bit read as -1 is that of the bit read as +1 and its margin, so only margins are left.
        """
        return (np.clip(margins * 4, -30, 30) * self.bit_weight) @ (self.code.T < 0).astype(np.float32)

    def shares(self, sums: np.ndarray) -> np.ndarray:
        """The confidence that each language would have for each row of summed margins and weights."""
        loss = self.losses(sums[:, :-1] / sums[:, -1:])
        share = np.exp(-(loss - loss.min(1)[:, None]) * 20)
        return share / share.sum(1)[:, None]

    def decode(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, confidence, gap to the runner-up) of each row of summed margins and weights."""
        loss = self.losses(sums[:, :-1] / sums[:, -1:])
        best = loss.argmin(1)
        low = loss[np.arange(len(loss)), best]
        share = np.exp(-(loss - low[:, None]) * 20)
        confidence = 1 / share.sum(1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else low + 1
        return best, confidence, second - low


def fit(rows: list[tuple[str, str]], languages: list[str], rounds: int = 3) -> Model:
    """A model from (text, language) rows; ``languages`` fixes the order of the codewords."""
    code = codewords(len(languages))
    index = {language: k for k, language in enumerate(languages)}
    held, labels, starts = [], [], []
    for text, language in rows:
        for part in json_strings(text) or [text]:
            for _, _, words in sentences(part):
                if len(words) > 2:
                    starts.append(len(held))
                    held += words
                    labels.append(index[language])
    size = 1 << FEATURES
    if not held:
        return Model(languages, np.zeros((size, code.shape[1]), np.float32), code, set())
    number, distinct = pd.factorize(np.array(held, dtype=object))
    feature, begin = _ngrams(list(distinct))
    ends = np.append(begin[1:], len(feature))
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(held))))
    labels = np.array(labels)
    known = {distinct[k] for k in np.flatnonzero(np.bincount(number) >= KNOWN)}
    model = None
    for _ in range(rounds):
        # n-gram counts by language: words by language first, then their n-grams
        by_word = np.zeros((len(distinct), len(languages)), np.float32)
        np.add.at(by_word, (number, labels[sentence]), 1)
        counts = np.zeros((size, len(languages)), np.float32)
        np.add.at(counts, feature, np.repeat(by_word, ends - begin, axis=0))
        rates = (counts + 0.5) / (counts.sum(0) + 0.5 * size)
        positive = code.T > 0
        with np.errstate(divide="ignore"):
            weights = np.stack([np.log(rates[:, p].mean(1)) - np.log(rates[:, ~p].mean(1)) for p in positive], axis=1).astype(np.float32)
        model = Model(languages, weights, code, known)
        sums = np.add.reduceat(model.word_margins(list(distinct))[number], starts, axis=0)
        decoded, _, gap = model.decode(sums)
        labels = np.where(gap > AMBIGUOUS, decoded, labels)
        right = (np.sign(sums[:, :-1]) == code[labels]).mean(0)
        model.bit_weight = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0, 6).astype(np.float32)
        model.bit_weight /= max(model.bit_weight.sum(), 1e-6)
    return model


def stated_language(label: Column, languages: list[tuple[str, str, str]]) -> Column:
    """The code that ``label`` states, by code, code with region, iso3 or English name in any case; else null."""
    plain = F.lower(F.trim(label))
    names = {x.lower(): code for code, iso3, name in languages for x in (code, iso3, name)}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    codes = F.create_map(*[F.lit(x) for code, _, _ in languages for x in (code.lower(), code)])
    region = F.when(plain.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,8}$"), codes[F.regexp_extract(plain, r"^([a-z]+)", 1)])
    return F.coalesce(known[plain], region)


def _blocks(words: int) -> list[int]:
    """Where the blocks of a sentence begin: at least two where it has room for two parts."""
    number = max(1 if words < 2 * PART else 2, words // BLOCK)
    return [k * words // number for k in range(number)]


def _word_ends(text: str) -> list[int]:
    """Where in ``text`` each of its words ends; a pair of Han or Kana characters ends with the second."""
    out = []
    for line in _LINE.finditer(text):
        own, begin = line.group(), line.start()
        if own.isascii():
            out += [begin + m.end() for m in _LETTERS.finditer(own.lower())]
            continue
        plain, pairs = plain_form(own).lower(), _RUN.search(own)
        ends = [p for m in _WORD.finditer(plain) for p in (range(min(m.start() + 2, m.end()), m.end() + 1) if pairs and _RUN.match(m.group()) else [m.end()])]
        if len(plain) != len(own):  # the least stretch of the line that has as many plain characters
            ends = [bisect.bisect_left(range(len(own)), p, key=lambda i: len(plain_form(own[:i]).lower())) for p in ends]
        out += [begin + p for p in ends]
    return out


def _segments_of(text: str) -> list[tuple[int, int, list[str], int]]:
    """(start, end, words, 0 or ``VALUE`` or ``KEYS`` of a JSON text) of the sentences with words."""
    found = _json_parts(text)
    if found is not None:
        keys = [w for key in found[0] for w in words_of(key)]
        return [(0, len(text), words, VALUE) for v in found[1] for _, _, words in sentences(v)] + [(0, len(text), keys, KEYS)]
    return [(s, e, words, 0) for s, e, words in sentences(text)]


def _runs(model: Model, rows: np.ndarray, blocks: np.ndarray, decoded: np.ndarray, gap: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(first word, last + 1, language, confidence, evidence) of the parts of one sentence; none if it is of one language.

    ``rows`` are the margins of its words, ``blocks`` where its blocks begin. Blocks sure of a language
    give the parts, unsure ones join their neighbours. The change between two parts is then put
    where the words before it speak most for the one language and those after it for the other.
    A part counts only if it has ``PART`` words, all but one of the weight of known ones, and evidence of its own.
    """
    language, sure = decoded.copy(), gap > 2 * AMBIGUOUS
    if len(set(language[sure].tolist())) < 2:
        return []
    place = np.flatnonzero(sure)
    language = language[place[np.clip(np.searchsorted(place, np.arange(len(language)), side="right") - 1, 0, None)]]
    bounds = [0, *blocks[np.flatnonzero(np.diff(language)) + 1].tolist(), len(rows)]
    own = [int(language[0]), *(int(x) for x in language[np.flatnonzero(np.diff(language)) + 1])]
    for k in range(1, len(own)):
        low, high = max(bounds[k] - BLOCK - 1, bounds[k - 1] + 1), min(bounds[k] + BLOCK + 1, bounds[k + 1] - 1)
        speaks = rows[low:high, :-1] @ (model.bit_weight * (model.code[own[k - 1]] - model.code[own[k]]))
        bounds[k] = low + int(np.argmax(np.concatenate([[0], np.cumsum(speaks)])))
    while len(own) > 1:
        sums = np.add.reduceat(rows, bounds[:-1], axis=0)
        found, confidence, apart = model.decode(sums)
        evidence = apart * sums[:, -1]
        good = (found == own) & (apart > 2 * AMBIGUOUS) & (evidence >= EVIDENCE) & (sums[:, -1] >= PART - 1) & (np.diff(bounds) >= PART)
        if good.all():
            return [(*x, float(c), float(e)) for *x, c, e in zip(bounds, bounds[1:], own, confidence, evidence)]
        weak = int(np.argmin(np.where(good, np.inf, evidence)))  # joins the part beside it that has more evidence
        into = weak - 1 if weak == len(own) - 1 or (weak and evidence[weak - 1] >= evidence[weak + 1]) else weak + 1
        del own[weak], bounds[max(weak, into)]
        for k in range(len(own) - 1, 0, -1):
            if own[k] == own[k - 1]:
                del own[k], bounds[k]
    return []


def _unstated(out: list[tuple], stated: dict[int, str | None], languages: list[str]) -> list[tuple[int, str]]:
    """(id, language) that the segments of the documents show and their labels do not state."""
    found: dict[int, set[int]] = {}
    best: dict[int, tuple[float, int]] = {}
    for i, _, _, language, _, ambiguous, _, evidence, _ in out:
        if evidence >= EVIDENCE and not ambiguous:
            found.setdefault(i, set()).add(language)
        best[i] = max(best.get(i, (0.0, 0)), (evidence, language))
    for i, (evidence, language) in best.items():
        if i not in found and evidence >= EVIDENCE / 4:
            found[i] = {language}
    return [(i, languages[k]) for i, own in found.items() for k in sorted(own) if languages[k] != stated[i]]


def _label(sent, unstated: bool = False):
    def run(batches):
        model: Model = sent.value
        cache: dict[str, int] = {}
        table = np.zeros((0, model.code.shape[1] + 1), np.float32)
        english = model.languages.index("en") if "en" in model.languages else None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            owner, spans, inside, starts, words, sentence, whose = [], [], [], [], [], [], []
            for number, (i, text) in enumerate(zip(ids, texts)):
                for s, e, own, in_json in _segments_of(text) if text else []:
                    if not own or in_json == KEYS and english is None:
                        continue
                    for at in _blocks(len(own)) if in_json != KEYS else [0]:
                        starts.append(len(words) + at)
                        sentence.append(len(owner))
                    words += own
                    owner.append(i)
                    spans.append((s, e))
                    inside.append(in_json)
                    whose.append(number)
            out: list[tuple] = []
            if words:
                if len(cache) > 300_000:
                    cache, table = {}, table[:0]
                number, distinct = pd.factorize(np.array(words, dtype=object))
                new = [w for w in distinct if w not in cache]
                if new:
                    cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                    table = np.concatenate([table, model.word_margins(new)])
                rows = table[np.array([cache[w] for w in distinct])][number]
                length = np.diff(np.append(starts, len(words)))
                sums = np.add.reduceat(rows, starts, axis=0)
                first = np.searchsorted(sentence, np.arange(len(owner)))
                total = np.add.reduceat(length, first)
                whole = np.add.reduceat(sums, first, axis=0)
                best, confidence, gap = model.decode(whole)
                block_best, _, block_gap = model.decode(sums)
                last, starts = np.append(first[1:], len(starts)), np.array(starts)
                for k, i in enumerate(owner):
                    part, at = slice(first[k], last[k]), starts[first[k]]
                    runs = _runs(model, rows[at : at + total[k]], starts[part] - at, block_best[part], block_gap[part]) if last[k] - first[k] > 1 else []
                    if inside[k] == KEYS:  # they count as English, as surely as they are decoded so
                        out.append((i, *spans[k], english, float(model.shares(whole[k : k + 1])[0, english]), False, 1, EVIDENCE, True))
                    elif runs:
                        s, e = spans[k]
                        ends = [] if inside[k] else _word_ends(texts[whose[k]][s:e])
                        cut = [s + ends[b - 1] for _, b, *_ in runs[:-1] if ends]
                        places = zip([s, *cut], [*cut, e]) if cut else [(s, e)] * len(runs)
                        for (a, b, language, sure, evidence), (low, high) in zip(runs, places):
                            out.append((i, low, high, language, sure, False, b - a, evidence, bool(inside[k])))
                    else:
                        out.append((i, *spans[k], int(best[k]), float(confidence[k]), bool(gap[k] <= AMBIGUOUS), int(total[k]), float(gap[k] * whole[k, -1]), bool(inside[k])))
            if unstated:
                pairs = _unstated(out, dict(zip(ids, batch.column(2).to_pylist())), model.languages)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.string())], names=["id", "language"])
                continue
            columns = list(zip(*out)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array([model.languages[k] for k in columns[3]], pa.string()),
                 pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.int32()), pa.array(columns[7], pa.float64()), pa.array(columns[8], pa.bool_())],
                names=["id", "start", "end", "language", "confidence", "ambiguous", "words", "evidence", "in_json"],
            )

    return run


def fit_on(df: DataFrame, languages: list[tuple[str, str, str]], id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` rows with a stated language, chosen by a hash of the id."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), stated_language(F.col(label_col), languages).alias("label")).filter("text is not null and label is not null")
    rows = hash_sample(labelled, "id", sample).select("text", "label").collect()
    return fit([(r.text, r.label) for r in rows], [code for code, _, _ in languages])


def language_segments(df: DataFrame, model: Model, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, language, confidence, ambiguous, words, evidence, in_json): every sentence or part with words.

    A null, empty or punctuation-only text, and one of codes alone, has no segment. The segments
    of a JSON text span the whole text, for its strings are read unescaped; its keys are one English segment,
    whose confidence is that of English for their words. Parts of one sentence meet at the end of a word.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sent = df.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(_label(sent), "id bigint, start int, end int, language string, confidence double, ambiguous boolean, words int, evidence double, in_json boolean")


def document_languages(segments: DataFrame) -> DataFrame:
    """(id, language, share, confidence, languages): the language of most words of each document, the smaller code of equals."""
    by = segments.groupBy("id", "language").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    top = F.max_by(F.struct("language", "words", "confidence"), F.struct("words", (-F.ascii("language")).alias("a"), F.col("language")))
    found = by.groupBy("id").agg(top.alias("top"), F.sum("words").alias("all"), F.count("*").alias("languages"))
    return found.select("id", "top.language", (F.col("top.words") / F.col("all")).alias("share"), "top.confidence", "languages")


def unstated_languages(df: DataFrame, model: Model, languages: list[tuple[str, str, str]], id_col: str = "row_id", text_col: str = "text", label_col: str = "language") -> DataFrame:
    """(id, language): languages of a sentence of the document that its label does not state.

    Segments without evidence, such as lone names, count for no language; in a document that has no
    other segment the one with most evidence counts from a quarter of it on. One pass over the texts;
    only the pairs found are shuffled, to give distinct rows where ids repeat.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), stated_language(F.col(label_col), languages).alias("stated")).filter(F.col("text").isNotNull())
    sent = df.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(_label(sent, True), "id bigint, language string").distinct()
