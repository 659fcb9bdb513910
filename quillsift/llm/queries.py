"""Queries pN_... over the tables of a directory, and SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import formatting_dedup, language, leakage, lookalike, packing, shared_spans, split_overlap, splitting
from quillsift.plans import oracle_sql as sql
from quillsift.runtime import materialize, scratch_path, table


def _text_tables(spark: SparkSession, root: str) -> list:
    return [("dataset", table(spark, root, "dataset"), "row_id", "text"), ("extracted_strings", table(spark, root, "extracted_strings"), "string_id", "text")]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, id_a, id_b): rows whose different texts look the same."""
    return lookalike.disguised_pairs(_text_tables(spark, root)).withColumnRenamed("source", "table_name")


def p1_consistent(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, id, text, changed): every text in its consistent form."""
    return lookalike.consistent_texts(_text_tables(spark, root)).withColumnRenamed("source", "table_name")


def _windows_with_limits(spark: SparkSession, root: str) -> DataFrame:
    windows = table(spark, root, "windows").select("window_id", "text", F.lower(F.trim("profile")).alias("name"))
    profiles = table(spark, root, "size_profiles").filter("unit = 'chars'").select(F.lower(F.trim("profile")).alias("name"), "max_size", "overlap")
    return windows.join(profiles, "name")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """(window_id, start, end, text): pieces of all oversized windows."""
    pieces = splitting.split_texts(_windows_with_limits(spark, root), "window_id", "text", F.col("max_size"), F.col("overlap"))
    return pieces.withColumnRenamed("id", "window_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(window_id) of the windows that had to be split."""
    return p2_pieces(spark, root).select("window_id").distinct()


def p2_files(spark: SparkSession, root: str) -> DataFrame:
    """(id, start, end, text): pieces of the texts of all documents, written as plain files and read by ranges of 64 KB."""
    folder = scratch_path(spark, "texts")
    table(spark, root, "documents").filter("text IS NOT NULL").select("text").write.text(folder)
    paths = sorted(spark.read.text(folder).inputFiles())
    coarse = table(spark, root, "size_profiles").filter("lower(trim(profile)) = 'coarse'").head()
    return splitting.split_files(spark, paths, coarse["max_size"], coarse["overlap"], range_bytes=1 << 16)


def _languages(spark: SparkSession, root: str) -> tuple[list[tuple[str, str, str]], language.Model]:
    """The rows of the languages table (a fixed, small one) and a model fitted on a bounded sample."""
    known = [(r.lang_code, r.iso3, r.english_name) for r in table(spark, root, "languages").orderBy("lang_code").collect()]
    return known, language.fit_on(table(spark, root, "dataset"), known, "row_id", "text", "language")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, language): languages of a row that its label does not state."""
    known, model = _languages(spark, root)
    return language.unstated_languages(table(spark, root, "dataset"), model, known).withColumnRenamed("id", "row_id")


def p3_segments(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, start, end, language, confidence, ambiguous, words, evidence, in_json) of every segment."""
    return language.language_segments(table(spark, root, "dataset"), _languages(spark, root)[1]).withColumnRenamed("id", "row_id")


def p3_rows(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, language, share, confidence, languages): one language for each row with words."""
    segments = language.language_segments(table(spark, root, "dataset"), _languages(spark, root)[1])
    return language.document_languages(segments).withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(row_id_a, row_id_b): records of the training split and of another one within the edit limit."""
    pairs = split_overlap.overlapping_pairs(*split_overlap.cross_split_classes(table(spark, root, "dataset")))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Per held-out split and source: records, leaked ones, exact ones, and the largest reported num_samples."""
    data = table(spark, root, "dataset")
    leaked = split_overlap.leaked_records(*split_overlap.cross_split_classes(data)).withColumnRenamed("eval_id", "row_id")
    rows = data.filter("split in ('validation', 'test')").select("row_id", "split", "source").join(leaked, "row_id", "left")
    counts = rows.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("distance").alias("leaked"), F.count_if(F.col("distance") == 0).alias("exact"), F.coalesce(F.sum("near_texts"), F.lit(0)).alias("near_texts")
    )
    reported = table(spark, root, "bench_metrics").groupBy("split", "source").agg(F.max("num_samples").alias("num_samples"))
    return counts.join(reported, ["split", "source"], "left")


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, train, class_id, links): the word sequence of every record, by its smallest row_id, and how many others of the other side are near."""
    found = split_overlap.linked_records(*split_overlap.cross_split_classes(table(spark, root, "dataset")))
    return found.withColumnsRenamed({"id": "row_id", "class": "class_id"})


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(row_id_a, row_id_b): copies by formatting, each with the first of its group."""
    pairs = formatting_dedup.formatting_copies(table(spark, root, "dataset"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, label, copies): one record for each group."""
    return formatting_dedup.collapse_formatting(table(spark, root, "dataset")).withColumnRenamed("id", "row_id")


def _packed(spark: SparkSession, root: str) -> DataFrame:
    capacity = table(spark, root, "size_profiles").filter("lower(trim(profile)) = 'pack'").head()["max_size"]
    docs = table(spark, root, "documents").select("doc_id", packing.token_count(F.col("text")).alias("size"))
    # the tokens are counted once: histogram, ranks and offsets all read the written sizes
    return packing.pack(materialize(docs, "sizes"), capacity)


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, piece, tokens, container): all documents in containers of the pack capacity."""
    return _packed(spark, root).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id) of the documents that lie in several of the filled containers."""
    held = _packed(spark, root).groupBy(F.col("id").alias("doc_id")).agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return held.filter("first < last").select("doc_id")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, item_id): documents that hold 12 consecutive words of an evaluation item."""
    leaks = leakage.verbatim_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_reparameterised(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, item_id, windows): documents that hold an evaluation item with other slots."""
    leaks = leakage.reparameterised(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return leaks.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents with a common stretch of 300 code points."""
    pairs = shared_spans.sharing_pairs(shared_spans.shared_paragraphs(table(spark, root, "documents")))
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p8_coverage(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, stretches) of every document."""
    docs = table(spark, root, "documents")
    return shared_spans.coverage(docs, shared_spans.shared_paragraphs(docs)).withColumnRenamed("doc", "doc_id")


def p8_removals(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, cluster, keep): clusters of documents that share stretches."""
    return shared_spans.removals(shared_spans.shared_paragraphs(table(spark, root, "documents"))).withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query p1_ to p8_ of this module, by name."""
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()}


def _look() -> str:
    """Tables ``look`` (t, form): the texts of both tables, each once, with every character as the ordinary one that it looks like."""

    def ordinary(c: str) -> str:
        kept = lookalike._IGNORED.sub("", unicodedata.normalize("NFKD", c))
        return "".join(lookalike.LATIN.get(ord(x), x) for x in kept)

    return f"""d AS (SELECT row_number() OVER () AS id, t FROM (SELECT text AS t FROM dataset UNION SELECT text FROM extracted_strings) WHERE t IS NOT NULL),
        {sql.character_table("alike", ordinary)}, {sql.replaced("k", "d", "alike")},
        look AS (SELECT d.t, regexp_replace(k.t, '[\\x00-\\x08\\x0e-\\x1b\\x7f]+', '', 'g') AS form FROM d JOIN k USING (id))"""


_PLAIN = r"""regexp_replace(lower({}), '[\s\x1c-\x1f\x{{85}}\p{{Z}}\p{{P}}]+', '', 'g')"""
_FORMS = f"""d AS (SELECT DISTINCT row_id, label, text, text LIKE '{{%' AND json_valid(text) AS j FROM dataset WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
    v AS (SELECT row_id, list_sort(list(({_PLAIN.format('fullkey')}) || '=' || ({_PLAIN.format("coalesce(atom ->> '$', 'null')")}))) AS fields FROM (SELECT * FROM d WHERE j) d, json_tree(d.text) WHERE type NOT IN ('OBJECT', 'ARRAY') GROUP BY row_id),
    g AS (SELECT row_id, label, CASE WHEN j THEN fields ELSE [{_PLAIN.format('text')}] END AS form FROM d LEFT JOIN v USING (row_id))"""
_SHARED = """s AS (SELECT doc_id, k, hash(substring(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300)),
    m AS (SELECT h FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1), c AS (SELECT s.* FROM s SEMI JOIN m USING (h))"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express over whole tables."""
    return {
        "p1_found": f"""WITH {_look()}, several AS (SELECT form FROM look GROUP BY form HAVING count(*) > 1), o AS (SELECT look.* FROM look SEMI JOIN several USING (form)),
            rows AS (SELECT DISTINCT 'dataset' AS source, row_id AS id, t, form FROM dataset JOIN o ON text = t UNION ALL SELECT DISTINCT 'extracted_strings', string_id, t, form FROM extracted_strings JOIN o ON text = t)
            SELECT DISTINCT a.source AS table_name, a.id AS id_a, b.id AS id_b FROM rows a JOIN rows b ON a.source = b.source AND a.form = b.form AND a.id < b.id AND a.t <> b.t""",
        "p5_found": f"""WITH {_FORMS}, f AS (SELECT label, form, min(row_id) AS row_id_a FROM g GROUP BY label, form)
            SELECT DISTINCT row_id_a, row_id AS row_id_b FROM g JOIN f ON g.form = f.form AND g.label IS NOT DISTINCT FROM f.label WHERE row_id > row_id_a""",
        "p5_groups": f"WITH {_FORMS} SELECT min(row_id) AS row_id, label::VARCHAR AS label, count(DISTINCT row_id) AS copies FROM g GROUP BY label, form",
        "p8_coverage": f"""WITH {_SHARED}, l AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c),
            x AS (SELECT doc_id, sum(coalesce(least(k - before, 300), 300))::BIGINT AS shared_chars, sum((before IS NULL OR k - before > 300)::INT)::BIGINT AS stretches FROM l GROUP BY doc_id)
            SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(stretches, 0) AS stretches FROM documents LEFT JOIN x USING (doc_id)""",
        "p8_removals": f"""WITH RECURSIVE {_SHARED}, e AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT DISTINCT doc_id, h FROM c) a JOIN (SELECT DISTINCT doc_id, h FROM c) b ON a.h = b.h),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS doc_id, min(b) AS cluster, a = min(b) AS keep FROM r GROUP BY a""",
        "p2_found": """
            SELECT DISTINCT w.window_id FROM windows w
            JOIN size_profiles p ON lower(trim(w.profile)) = lower(trim(p.profile)) AND p.unit = 'chars'
            WHERE length(w.text) > p.max_size""",
        "p6_found": r"""
            SELECT doc_id FROM documents
            WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+'))
                  > (SELECT max_size FROM size_profiles WHERE lower(trim(profile)) = 'pack')""",
        "p7_found": r"""
            WITH w AS (SELECT doc_id AS id, 'd' AS side, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS words FROM documents
                       UNION ALL SELECT item_id, 'i', regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') FROM eval_items),
                 s AS (SELECT DISTINCT id, side, array_to_string(words[k : k + 11], ' ') AS stretch
                       FROM (SELECT id, side, words, unnest(range(1, len(words) - 10)) AS k FROM w WHERE len(words) >= 12))
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM s d JOIN s i USING (stretch) WHERE d.side = 'd' AND i.side = 'i'""",
        "p8_found": """
            WITH s AS (SELECT DISTINCT doc_id, hash(substring(text, k, 300)) AS h
                       FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300)),
                 m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
                 c AS (SELECT doc_id, h FROM s SEMI JOIN m USING (h))
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.h = b.h AND a.doc_id < b.doc_id""",
    }
