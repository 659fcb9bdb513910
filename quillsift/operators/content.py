"""Content-aware scanning: strings of JSON, CSV, XML and YAML documents, detection on them, and redaction.

One row is one document. Extractors run over Arrow batches; everything between extraction and
annotation is columns on the JVM and needs no shuffle, for the entries of a document stay
in an array of its row.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from quillsift.functions import motifs, patterns
from quillsift.functions.binding import once, settle
from quillsift.operators import spans
from quillsift.operators.detector import Detector
from quillsift.sources.config import Bank

ENTRY = StructType().add("text", StringType()).add("byte_offset", IntegerType()).add("byte_length", IntegerType()).add("path", StringType()).add("virtual_offset", IntegerType())
EXTRACTED = StructType().add("entries", ArrayType(ENTRY)).add("error", StringType())
Extractor = Callable[[str], Iterator[tuple[str, int, int, str]]]
_EXTRACTORS: dict[str, tuple[str, Extractor]] = {}


def register_extractor(name: str, *content_types: str):
    """Decorator: a function from decoded text to (text, start, end, path), offsets in characters of the document."""

    def add(function: Extractor) -> Extractor:
        _EXTRACTORS.update(dict.fromkeys(content_types, (name, function)))
        return function

    return add


def base_type(content_type: str | None) -> str:
    """The content type without parameters, in lower case."""
    return (content_type or "").split(";")[0].strip().lower()


def get_extractor(content_type: str | None) -> Extractor | None:
    found = _EXTRACTORS.get(base_type(content_type))
    return found[1] if found else None


@register_extractor("json", "application/json", "text/json")
def json_strings(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Keys (path~key) and string values in document order, each found from where the last one ended.

    Of equal keys of one object the last value counts, at the place of the first.
    """
    todo: list[tuple[object, str]] = [(json.loads(text), "")]
    at = 0
    while todo:
        node, path = todo.pop()
        if isinstance(node, dict):
            for key, value in reversed(node.items()):
                todo += [(value, f"{path}/{key}"), (_Key(key), f"{path}/{key}~key")]
        elif isinstance(node, list):
            todo += [(value, f"{path}/{k}") for k, value in reversed([*enumerate(node)])]
        elif isinstance(node, str):
            for ascii_only in (False, True):
                literal = json.dumps(str(node), ensure_ascii=ascii_only)
                place = text.find(literal, at)
                if place >= 0:
                    at = place + len(literal)
                    yield str(node), place + 1, at - 1, path
                    break


class _Key(str):
    """A key, told apart from a value."""


_CELL = re.compile(r'"([^"]*(?:""[^"]*)*)("?)[^,\r\n]*|[^,\r\n]*')
_DELIMITER = re.compile(r",|\r\n|\r|\n")


@register_extractor("csv", "text/csv")
def csv_cells(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Non-empty cells with path row:column; doubled quotes are undone in the text, not in the offsets."""
    at = row = column = 0
    while at < len(text):
        cell = _CELL.match(text, at)
        quoted = cell.group(1) is not None
        start, end = cell.span(1) if quoted else cell.span()
        value = text[start:end].replace('""', '"') if quoted else text[start:end]
        if value:
            yield value, start, end, f"{row}:{column}"
        delimiter = _DELIMITER.match(text, cell.end())
        if not delimiter:
            return
        row, column = (row, column + 1) if delimiter.group() == "," else (row + 1, 0)
        at = delimiter.end()


@register_extractor("xml", "text/xml", "application/xml", "text/html")
def xml_strings(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Attribute values, texts and tails (under the parent's path); what the file writes with entities is not found.

    A document that is not well-formed has no strings.
    """
    local = lambda name: name.rpartition("}")[2]
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    at = 0
    todo: list[tuple] = [("element", root, "")]
    while todo:
        kind, node, path = todo.pop()
        if kind == "element":
            own = f"{path}/{local(node.tag)}"
            steps = [("attribute", value, f"{own}/@{local(name)}") for name, value in node.attrib.items()]
            steps += [("text", node.text, f"{own}/text()"), *(("element", child, own) for child in node), ("text", node.tail, f"{path}/text()")]
            todo += reversed(steps)
        elif node and node.strip():
            value = node if kind == "attribute" else node.strip()
            for quote in ('"', "'") if kind == "attribute" else ("",):
                place = text.find(f"{quote}{value}{quote}", at)
                if place >= 0:
                    start = place + len(quote)
                    at = start + len(value) + len(quote)
                    yield value, start, start + len(value), path
                    break


@register_extractor("yaml", "text/yaml", "application/yaml", "application/x-yaml", "text/x-yaml")
def yaml_scalars(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Non-blank scalar keys (path~key) and values; the length is that of the decoded value.

    A document that is not valid YAML has no strings.
    """
    import yaml

    try:
        root = yaml.compose(text)
    except yaml.YAMLError:
        return
    todo: list[tuple] = [(root, "")]
    while todo:
        node, path = todo.pop()
        if isinstance(node, yaml.MappingNode):
            for key, value in reversed(node.value):
                own = key.value if isinstance(key, yaml.ScalarNode) else str(key)
                own = f"{path}.{own}" if path else own
                todo.append((value, own))
                if isinstance(key, yaml.ScalarNode):
                    todo.append((key, f"{own}~key"))
        elif isinstance(node, yaml.SequenceNode):
            todo += [(value, f"{path}[{k}]") for k, value in reversed([*enumerate(node.value)])]
        elif isinstance(node, yaml.ScalarNode) and node.value.strip():
            start = node.start_mark.index + (node.style in ("'", '"'))
            yield node.value, start, start + len(node.value.encode()), path


def extract_one(raw: bytes | None, content_type: str | None) -> dict | None:
    """Entries of a document with byte offsets; ``error`` says why a document was not parsed."""
    if raw is None:
        return None
    name, extractor = _EXTRACTORS.get(base_type(content_type), ("", None))
    if extractor is None:
        return {"entries": None, "error": "unknown content type"}
    try:
        text = raw.decode("utf-8")
        found = [*extractor(text)]
    except (ValueError, RecursionError) as x:
        return {"entries": None, "error": f"{name}: {type(x).__name__}"}
    entries, at, octets, virtual = [], 0, 0, 0
    plain = text.isascii()
    for value, start, end, path in found:
        if plain:
            first, length = start, end - start
        else:
            octets = octets + len(text[at:start].encode()) if start >= at else len(text[:start].encode())
            at, first = start, octets
            length = end - start if name == "yaml" else len(text[start:end].encode())
        entries.append({"text": value, "byte_offset": first, "byte_length": length, "path": path, "virtual_offset": virtual})
        virtual += len(value) + 1
    return {"entries": entries, "error": None}


@F.pandas_udf(EXTRACTED)
def extract(raw: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """Struct (entries, error) of each document. Null documents have null entries."""
    out = [extract_one(None if r is None else bytes(r), c) or {"entries": None, "error": "null"} for r, c in zip(raw, content_type)]
    return pd.DataFrame(out, columns=["entries", "error"])


extract = once(extract)


def extracted_strings(df: DataFrame, key: str, raw: str = "raw", content_type: str = "content_type") -> DataFrame:
    """(key, entry_index, text, byte_offset, byte_length, path): one row for each string."""
    found = df.select(key, extract(F.col(raw), F.col(content_type)).alias("__x"))
    return found.select(key, F.posexplode("__x.entries").alias("entry_index", "__e")).select(key, "entry_index", "__e.text", "__e.byte_offset", "__e.byte_length", "__e.path")


DETECTION = "array<struct<category:string,heat:double,spans:array<struct<byte_start:int,byte_end:int,entry_index:int,path:string>>,snippet:string>>"


def detections(entries: Column, offsets: Column, text: Column, hot_spans: Column) -> Column:
    """Hot spans mapped to the document; spans that touch no entry drop out."""
    mapped = F.transform(
        hot_spans,
        lambda h: F.struct(h["category"].alias("category"), h["heat"].alias("heat"), spans.map_span(entries, offsets, h["start"], h["end"]).alias("spans"), F.substring(text, h["start"] + 1, h["end"] - h["start"]).alias("snippet")),
    )
    return F.filter(mapped, lambda d: F.size(d["spans"]) > 0)


def _summary(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda d: F.format_string("%s(%.1f)@%s", d["category"], d["heat"], d["spans"][0]["path"])), "; ")


@F.pandas_udf(BinaryType())
def _json_annotated(redacted: pd.Series, found: pd.Series, score: pd.Series) -> pd.Series:
    def one(raw, detected, points):
        if raw is None:
            return None
        try:
            parsed = json.loads(bytes(raw))
        except ValueError:
            return bytes(raw)
        about = {"_data_integrity": "untrusted", "_detections": [_told(d) for d in detected], "_score": round(points, 4)}
        whole = parsed | about if isinstance(parsed, dict) else {"_data_integrity": "untrusted", "data": parsed} | about
        return json.dumps(whole, indent=2, ensure_ascii=False).encode()

    return pd.Series([one(*x) for x in zip(redacted, found, score)], dtype=object)


def _told(d: dict) -> dict:
    return {"category": d["category"], "heat": round(float(d["heat"]), 2), "paths": sorted({s["path"] for s in d["spans"]}), "snippet": d["snippet"][:120]}


@F.pandas_udf(StringType())
def _sidecar(found: pd.Series, score: pd.Series, content_type: pd.Series) -> pd.Series:
    out = [None if d is None else json.dumps({"data_integrity": "untrusted", "score": round(s, 4), "content_type": c, "detections": [_told(x) for x in d]}, ensure_ascii=False) for d, s, c in zip(found, score, content_type)]
    return pd.Series(out, dtype=object)


def _tagged(redacted: Column, found: Column) -> Column:
    """``redacted`` with a tag around every span, put in from the last one to the first."""
    flat = F.flatten(F.transform(found, lambda d: F.transform(d["spans"], lambda s: F.struct((-s["byte_start"]).alias("o"), s["byte_start"].alias("s"), s["byte_end"].alias("e"), d["category"].alias("c"), d["heat"].alias("h")))))
    wrap = lambda acc, t: F.concat(
        F.substring(acc, F.lit(1), t["s"]), F.encode(F.format_string('<injection category="%s" score="%.1f">', t["c"], t["h"]), "utf-8"), F.substring(acc, t["s"] + 1, t["e"] - t["s"]),
        F.encode(F.lit("</injection>"), "utf-8"), F.substring(acc, t["e"] + 1, F.octet_length(acc)),
    )
    return F.aggregate(F.array_sort(flat), redacted, wrap)


def scan(
    df: DataFrame, raw: str = "raw", content_type: str = "content_type", mode: Column | str = "structured", detector: Detector | None = None, heat_threshold: float = 1.5, bank: Bank | None = None, on_parse_error: str = "empty"
) -> DataFrame:
    """``df`` with (status, flagged, score, detections, annotated, metadata).

    ``mode`` is structured, cli or plain, for all rows or as a column. ``status`` is plain_text (unknown
    type), parse_fallback (torn JSON or bytes that are not UTF-8, scanned as text), no_strings,
    unflagged, no_hot_spans or annotated. Torn XML and YAML have no strings and come out unflagged, unless
    ``on_parse_error`` is "plain". Null documents have null results; columns of ``df`` with the names of results are replaced.
    """
    detector = detector or Detector("heuristic", 0.3)
    bank = bank or getattr(detector.method, "bank", None) or Bank.default()
    mode = F.lit(mode) if isinstance(mode, str) else mode
    df = df.drop("status", "flagged", "score", "detections", "annotated", "metadata")
    own = df.columns
    keep = {c: f"__own_{c}" for c in own if c in Detector.RESULTS}
    d = df.withColumn("__x", extract(F.col(raw), F.col(content_type))).withColumnsRenamed(keep)
    structured = F.col("__x.entries").isNotNull() & (F.size("__x.entries") > 0 if on_parse_error == "plain" else F.lit(True))
    kind_of = F.lower(F.trim(F.split(F.coalesce(F.col(content_type), F.lit("")), ";")[0]))
    d = settle(d, {"__mode": mode, "__type": kind_of, "__entries": F.when(structured, F.col("__x.entries"))})
    d = settle(d, {"__texts": F.transform("__entries", lambda e: e["text"])})
    plain = F.when(F.is_valid_utf8(F.col(raw).cast("string")), F.col(raw).cast("string")).otherwise(F.make_valid_utf8(F.col(raw).cast("string")))
    whole = F.when(F.col(raw).isNull(), None).otherwise(F.coalesce(spans.virtual_text(F.col("__texts")), plain))
    d = settle(d, {"__offsets": F.transform("__entries", lambda e: e["virtual_offset"]), "__text": whole})
    d = detector.analyze(d, "__text", with_spans=False)
    flagged = F.col("flagged") & F.col("__entries").isNotNull()
    # spans are looked for once, and only in flagged documents
    d = settle(d, {"__sought": F.when(flagged, F.col("__text"))})
    d = d.withColumn("__p", patterns.categorized_spans(bank)(F.col("__sought")))
    d = settle(d, {"__m": motifs.matches(F.col("__sought"), bank)})
    d = settle(d, {"__hot": F.when(flagged, spans.hot(spans.heat(F.col("__p"), F.col("__m")), heat_threshold))})
    d = settle(d, {"detections": F.coalesce(detections(F.col("__entries"), F.col("__offsets"), F.col("__text"), F.col("__hot")), F.array().cast(DETECTION))})
    some = F.size("detections") > 0
    d = settle(d, {"__redacted": F.when(some, spans.redact(F.col(raw), F.flatten(F.transform("detections", lambda x: x["spans"]))))})
    kinds = {c: n for c, (n, _) in _EXTRACTORS.items()}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("__type")]
    meta = F.struct(F.format_string("%.4f", F.col("score")).alias("score"), _summary(F.col("detections")).alias("told"))
    d = settle(d, {"__meta": meta})
    note = lambda form: F.encode(F.format_string(form, F.col("__meta.score"), F.col("__meta.told")), "utf-8")
    redacted = F.col("__redacted")
    as_json = _json_annotated(F.when((F.col("__mode") == "structured") & (kind == "json"), redacted), F.col("detections"), F.col("score"))
    sidecar = _sidecar(F.when(some & (F.col("__mode") == "plain"), F.col("detections")), F.col("score"), F.col(content_type))
    d = d.withColumns({"__json": as_json, "__sidecar": sidecar})
    annotated = (
        F.when(~some, F.col(raw)).when(F.col("__mode") == "cli", _tagged(redacted, F.col("detections"))).when(F.col("__mode") == "plain", redacted)
        .when(kind == "json", F.col("__json"))
        .when(kind == "csv", F.concat(redacted, note('\n# _data_integrity=untrusted score=%s detections="%s"')))
        .when(kind == "xml", F.concat(note('<?data-integrity untrusted score="%s" detections="%s"?>\n'), redacted))
        .when(kind == "yaml", F.concat(note('# _data_integrity: untrusted  score: %s  detections: "%s"\n'), redacted))
        .otherwise(redacted)
    )
    status = (
        F.when(F.col(raw).isNull(), None).when(F.col("__entries").isNull(), F.when(kind.isNull(), "plain_text").otherwise("parse_fallback"))
        .when(F.size("__entries") == 0, "no_strings").when(~F.col("flagged"), "unflagged").when(some, "annotated").otherwise("no_hot_spans")
    )
    d = settle(d, {"status": status})
    metadata = (
        F.when(F.col("status") == "plain_text", F.lit('{"mode": "plain_text_fallback"}'))
        .when(F.col("status") == "parse_fallback", F.concat(F.lit('{"mode": "structured_parse_fallback", "note": "'), F.coalesce("__x.error", F.lit("no strings")), F.lit('"}')))
        .when(F.col("status") == "no_hot_spans", F.lit('{"note": "flagged but no spans exceeded heat threshold"}')).when(some & (F.col("__mode") == "plain"), F.col("__sidecar"))
    )
    empty = F.col("status") == "no_strings"
    results = {
        "status": F.col("status"), "flagged": F.when(empty, F.lit(False)).otherwise(F.col("flagged")), "score": F.when(empty, F.lit(0.0)).otherwise(F.col("score")),
        "detections": F.col("detections"), "annotated": annotated, "metadata": metadata,
    }
    names = [F.col(keep.get(c, c)).alias(c) for c in own if c not in results]
    return d.select(*names, *[c.alias(n) for n, c in results.items()])
