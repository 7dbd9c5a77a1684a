"""The pN_ queries of the problems in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import canonical, containers, hidden_duplicates, leaks, natural_split, scan_repair, similar, text_quality

Query = Callable[[SparkSession, str], DataFrame]
PAPER_FIELDS = {"doi": "doi", "title": "text", "citekey": "runs"}


def _scan_rows(spark: SparkSession, folder: str) -> DataFrame:
    tei = table(spark, folder, "tei_paragraph").select(F.lit("tei_paragraph").alias("src"), F.col("para_id").alias("row_id"), "text")
    chunk = table(spark, folder, "chunk").select(F.lit("chunk").alias("src"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    return tei.unionByName(chunk)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    repaired = scan_repair.repair_scans(_scan_rows(spark, folder), ["src", "row_id"], "text")
    # the cases of one text are made distinct beside it: row ids are unique within a source
    return repaired.select("src", "row_id", F.explode(F.array_distinct("found")).alias("f")).select("src", "row_id", "f.kind", "f.fixed")


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    repaired = scan_repair.repair_scans(_scan_rows(spark, folder), ["src", "row_id"], "text")
    return repaired.select("src", "row_id", F.posexplode("paragraphs").alias("para_pos", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = natural_split.natural_boundaries(table(spark, folder, "chunk").select("id", "content"), "id", "content", 1800)
    return found.select(F.col("id").alias("chunk_id"), "boundary", F.col("kind").alias("break_kind"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    cut = natural_split.split_oversized(table(spark, folder, "chunk").select("id", "paper_id", "ordinal", "section", "content"), "content", 1800, 150)
    return cut.withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar.similar_pairs(table(spark, folder, "chunk"), "id", "embedding", k=10)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extraction").select(F.col("id").alias("extraction_id"), "theoretical_lens", "method", "constructs")
    single = [F.struct(F.lit(c).alias("field"), F.lit(0).alias("pos"), F.col(c).alias("value")) for c in ("theoretical_lens", "method")]
    several = F.transform(F.coalesce("constructs", F.array().cast("array<string>")), lambda v, i: F.struct(F.lit("constructs").alias("field"), i.cast("int").alias("pos"), v.alias("value")))
    return e.select("extraction_id", F.explode(F.concat(F.array(*single), several)).alias("v")).select("extraction_id", "v.*")


def p4_mapped(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "vocab_term")
    return canonical.map_values(_values(spark, folder), terms, "value", "field", "term_id", "kind", ["label", "alt_label"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    # a value that is neither null nor blank has a term id, 0 if none fits
    return p4_mapped(spark, folder).where("term_id is not null").select("extraction_id", "field", "pos", "term_id")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return p4_mapped(spark, folder).where("term_id = 0").groupBy("field", "value").agg(F.count("*").alias("uses"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_duplicates.copies_of(table(spark, folder, "paper"), "id", PAPER_FIELDS)


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_duplicates.collapse(table(spark, folder, "paper"), "id", PAPER_FIELDS)


def p7_filled(spark: SparkSession, folder: str) -> DataFrame:
    placed = containers.fill_containers(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 2048)
    return placed.withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_item").select("item_id", "text")
    return leaks.leaked_passages(docs, items, "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "doc_id").distinct()


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return leaks.without_leaks(docs, _leaks(spark, folder), "doc_id")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.quality(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts among the statistics, which SQL can express as well."""
    return p9_statistics(spark, folder).select("doc_id", "words", "lines", "punctuated_lines")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_statistics(spark, folder).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_repaired, p2_found, p2_pieces, p3_found, p4_found, p4_mapped, p4_unmatched,
        p6_found, p6_collapsed, p7_filled, p8_found, p8_clean, p9_found, p9_counts, p9_statistics,
    )
}

_FORMS = r"""WITH f AS (SELECT id,
   'v' || regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(doi)), '\s+', '', 'g'), '^(?:(?:https?:/{0,2})?(?:www\.)?(?:dx\.)?doi\.org/*|(?:info:)?doi[:/.]*)+', ''), '[^\p{L}\p{N}\p{M}]', '', 'g') AS d,
   'v' || regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}\p{M}]', '', 'g') AS t,
   'v' || array_to_string(list_sort(regexp_extract_all(lower(nfc_normalize(citekey)), '\p{N}+|[\p{L}\p{M}]+')), ' ') AS c FROM paper),
 g AS (SELECT id, min(id) OVER w AS first_id FROM f WINDOW w AS (PARTITION BY coalesce(d, 'n'), coalesce(t, 'n'), coalesce(c, 'n')))"""

_BLANK = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 n AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[{_BLANK}]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS words,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS lines FROM d)
 SELECT doc_id, len(words) AS words, len(lines) AS lines,
   CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;]["''”’)\]»]*\p{{Nd}}{{0,3}}[{_BLANK}]*$')))::DOUBLE / len(lines) END AS punctuated_lines FROM n"""

SQL: dict[str, str] = {
    "p9_counts": _COUNTS,
    "p6_found": f"{_FORMS} SELECT first_id, id AS copy_id FROM g WHERE id <> first_id",
    "p6_collapsed": f"{_FORMS} SELECT first_id, count(*) AS copies FROM g GROUP BY first_id",
}
