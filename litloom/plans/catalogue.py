"""All queries of the library by name, and the SQL that expresses them over the same tables.

Every query reads its whole tables. Where a relation of the pipeline has no table of its own (findings, the call log),
it is built from the given ones in the same way on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import similarity, text
from ..operators import chunking, coverage, evidence, library, retrieval, store, synthesis
from ..operators.packed_fields import unpack_fields
from ..runtime import checkpoint_dir, table
from ..sources.clients import embedded
from .packed_sql import PACKED_FIELDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY_TEXT = "route memory"
SECTIONS = ["METHOD", "RESULTS"]
LABELS = ["kerb access equity", "driver autonomy"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- retrieval ------------------------------------------------------------------------------------------------------

_VECTOR_ARM = """
 q AS (SELECT embedding::DOUBLE[] AS v FROM chunk WHERE id = (SELECT min(id) FROM chunk WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)),
 scored AS (SELECT c.id, 1 - list_dot_product(c.embedding::DOUBLE[], q.v) / nullif(sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)), 0) AS distance
            FROM chunk c, q WHERE c.embedding IS NOT NULL {where}),
 vector_arm AS (SELECT id, distance, row_number() OVER (ORDER BY round(distance, 12) ASC NULLS LAST, id) AS rank FROM scored QUALIFY rank <= 60)"""
_TEXT_ARM = """
 toks AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM chunk WHERE TRUE {where}),
 tf AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x IN ('memory', 'memories', 'memorial'))) AS a, len(list_filter(t, lambda x: x IN ('route', 'routes', 'routed', 'routing', 'routings', 'rout', 'routs'))) AS b FROM toks),
 st AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
 bm AS (SELECT id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m)) AS score
        FROM tf, st WHERE a > 0 AND b > 0),
 text_arm AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 60)"""
_FUSED = """
 fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM vector_arm UNION ALL SELECT id, rank FROM text_arm) GROUP BY id),
 hits AS (SELECT id, score FROM fused ORDER BY round(score, 12) DESC, id LIMIT 12)"""


def _query_vector(chunks: DataFrame) -> list[float]:
    usable = chunks.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    row = usable.agg(F.min_by("embedding", "id").alias("v")).first()
    return row.v or [1.0]


def _hits(spark: SparkSession, folder: str, sections: list[str] | None = None) -> DataFrame:
    chunks = table(spark, folder, "chunk")
    return retrieval.hybrid_search(chunks, QUERY_TEXT, _query_vector(chunks), sections=sections)


@query(f"WITH {_VECTOR_ARM.format(where='')}, {_TEXT_ARM.format(where='')}, {_FUSED} SELECT id, round(score, 6) AS score FROM hits")
def hybrid_rrf_topk(spark, folder):
    return _hits(spark, folder).select("id", F.round("score", 6).alias("score"))


_IN = "AND canonical_section IN ('METHOD', 'RESULTS')"


@query(f"WITH {_VECTOR_ARM.format(where=_IN)}, {_TEXT_ARM.format(where=_IN)}, {_FUSED} SELECT id, round(score, 6) AS score FROM hits")
def hybrid_filtered(spark, folder):
    return _hits(spark, folder, SECTIONS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTOR_ARM.format(where='')} SELECT id, rank, round(distance, 6) AS distance FROM vector_arm")
def vector_topk(spark, folder):
    chunks = table(spark, folder, "chunk")
    return retrieval.vector_arm(chunks, _query_vector(chunks), 60).select("id", *_long("rank"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_TEXT_ARM.format(where='')} SELECT id, rank FROM text_arm")
def text_topk_bm25(spark, folder):
    return retrieval.text_arm(table(spark, folder, "chunk"), QUERY_TEXT, 60).select("id", *_long("rank"))


@query(f"WITH {_TEXT_ARM.format(where='')} SELECT id, round(score, 6) AS score FROM bm")
def text_scores(spark, folder):
    return retrieval.bm25(table(spark, folder, "chunk"), QUERY_TEXT).select("id", F.round("score", 6).alias("score"))


# the words of a stem stand in the SQL as a pattern; "or" splits, "-" excludes, "the" is a stop word and "of" any word
WEBSEARCH = 'the routing -tariff OR "frictions of the handover" or "handover frictions" depots'


@query(
    r"SELECT id FROM (SELECT id, lower(content) AS low FROM chunk) WHERE (regexp_matches(low, '(^|[^a-z0-9])(route|routes|routed|routing|routings|rout|routs)([^a-z0-9]|$)') AND NOT regexp_matches(low, '(^|[^a-z0-9])tariff(s|ed)?([^a-z0-9]|$)')) "
    r"OR regexp_matches(low, '(^|[^a-z0-9])friction(s|al)?[^a-z0-9]+[a-z0-9]+[^a-z0-9]+[a-z0-9]+[^a-z0-9]+handovers?([^a-z0-9]|$)') "
    r"OR (regexp_matches(low, '(^|[^a-z0-9])handovers?[^a-z0-9]+frictions?([^a-z0-9]|$)') AND regexp_matches(low, '(^|[^a-z0-9])depots?([^a-z0-9]|$)'))"
)
def text_websearch(spark, folder):
    return retrieval.bm25(table(spark, folder, "chunk"), WEBSEARCH).select("id")


@query(
    f"WITH {_VECTOR_ARM.format(where='')}, {_TEXT_ARM.format(where='')}, {_FUSED} SELECT c.id, p.citekey, p.title, c.section, c.page, md5(c.content) AS content_md5, round(h.score, 6) AS score, "
    "'[' || p.citekey || CASE WHEN c.page IS NULL THEN ']' ELSE ' p.' || c.page || ']' END AS marker FROM hits h JOIN chunk c ON c.id = h.id JOIN paper p ON p.id = c.paper_id"
)
def hydrate_hits(spark, folder):
    full = retrieval.hydrate(_hits(spark, folder), table(spark, folder, "chunk"), table(spark, folder, "paper"))
    return full.select("id", "citekey", "title", "section", "page", F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"), "marker")


@query(
    f"WITH {_VECTOR_ARM.format(where='')}, {_TEXT_ARM.format(where='')}, {_FUSED} SELECT string_agg('[' || p.citekey || CASE WHEN c.page IS NULL THEN ']' ELSE ' p.' || c.page || ']' END || ' ' || c.content, chr(10) || chr(10) "
    r"ORDER BY round(h.score, 12) DESC, c.id) AS evidence FROM hits h JOIN chunk c ON c.id = h.id JOIN paper p ON p.id = c.paper_id WHERE regexp_matches(c.content, '\S')"
)
def search_evidence_block(spark, folder):
    return retrieval.evidence_block(retrieval.hydrate(_hits(spark, folder), table(spark, folder, "chunk"), table(spark, folder, "paper")))


# ---- coverage -------------------------------------------------------------------------------------------------------

_COVERAGE = """
 constructs AS (SELECT DISTINCT unnest(constructs) AS construct FROM extraction),
 named AS (SELECT construct FROM constructs WHERE construct IS NOT NULL),
 cells AS (SELECT construct, canonical_section, count(DISTINCT paper_id) AS paper_count, string_agg(DISTINCT citekey, '|' ORDER BY citekey) AS citekeys
           FROM chunk c JOIN paper p ON p.id = c.paper_id JOIN named n ON contains(lower(c.content), lower(n.construct)) WHERE canonical_section IS NOT NULL GROUP BY ALL)"""
_GRID = ", ".join(f"({i}, '{s}')" for i, s in enumerate(schema.GRID_SECTIONS))
_GRID_SQL = f"{_COVERAGE}, grid AS (SELECT n.construct, s.section_pos, s.section, coalesce(c.paper_count, 0) AS coverage_count, coalesce(c.citekeys, '') AS citekeys FROM named n CROSS JOIN (VALUES {_GRID}) s(section_pos, section) LEFT JOIN cells c ON c.construct = n.construct AND c.canonical_section = s.section)"


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    constructs = coverage.distinct_constructs(table(spark, folder, "extraction"))
    return coverage.gap_grid(table(spark, folder, "chunk"), table(spark, folder, "paper"), constructs)


@query("SELECT DISTINCT construct FROM (SELECT unnest(constructs) AS construct FROM extraction) WHERE construct IS NOT NULL")
def distinct_constructs(spark, folder):
    return coverage.distinct_constructs(table(spark, folder, "extraction"))


@query(f"WITH {_COVERAGE} SELECT construct, canonical_section, paper_count, citekeys FROM cells")
def construct_coverage(spark, folder):
    constructs = coverage.distinct_constructs(table(spark, folder, "extraction"))
    cells = coverage.coverage(table(spark, folder, "chunk"), table(spark, folder, "paper"), constructs)
    return cells.select("construct", "canonical_section", "paper_count", F.array_join("citekeys", "|").alias("citekeys"))


@query(f"WITH {_GRID_SQL} SELECT construct, section, coverage_count, citekeys FROM grid")
def gap_grid(spark, folder):
    return _grid(spark, folder).select("construct", "section", *_long("coverage_count"), F.array_join("citekeys", "|").alias("citekeys"))


@query(f"WITH {_GRID_SQL} SELECT construct, section FROM grid WHERE coverage_count = 0")
def gap_uncovered(spark, folder):
    return coverage.uncovered(_grid(spark, folder)).select("construct", "section")


@query(f"WITH {_GRID_SQL} SELECT DISTINCT construct FROM grid WHERE coverage_count = 0 AND section IN ('RESULTS', 'DISCUSSION')")
def asserted_untested(spark, folder):
    return coverage.asserted_but_untested(_grid(spark, folder))


# ---- text rules -----------------------------------------------------------------------------------------------------

_CASES = " ".join(
    "WHEN "
    + " OR ".join((f"contains(h, 'future') AND contains(h, '{w}')" if how == "future" else f"starts_with(h, '{w}')" if how == "starts" else f"contains(h, '{w}')") for w in words)
    + f" THEN '{slot}'"
    for slot, how, words in text.SLOT_RULES
)
_MARKED = r"regexp_replace(lower(heading), '^\s*(?:\d+(?:\.\d+)*|[ivxlc]+)\s*[.):\-–]\s*', '')"


@query(
    f"WITH hs AS (SELECT DISTINCT heading FROM (SELECT heading FROM tei_paragraph UNION ALL SELECT section FROM chunk)), "
    rf"s AS (SELECT heading, trim(CASE WHEN {_MARKED} = lower(heading) THEN regexp_replace(lower(heading), '^\s*\d+(?:\.\d+)*\s+', '') ELSE {_MARKED} END) AS h FROM hs) "
    f"SELECT heading, CASE WHEN heading IS NULL OR trim(heading) = '' THEN 'OTHER' {_CASES} ELSE 'OTHER' END AS slot FROM s"
)
def canonical_heading(spark, folder):
    headings = table(spark, folder, "tei_paragraph").select("heading").unionByName(table(spark, folder, "chunk").select(F.col("section").alias("heading")))
    return headings.distinct().select("heading", text.heading_slot("heading").alias("slot"))


@query(
    r"SELECT para_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]', '', 'g'), "
    r"'\([^()]*?(?:et al\.|,\s*\d{4})[^()]*?\)', '', 'g'), '(\p{L})-\s+(\p{L})', '\1\2', 'g'), '\s+([,.;:)])', '\1', 'g'), '\s+', ' ', 'g')) AS cleaned FROM tei_paragraph"
)
def clean_text(spark, folder):
    return table(spark, folder, "tei_paragraph").select("para_id", text.clean_text("text").alias("cleaned"))


@query(r"SELECT para_id, pos - 1 AS pos, unnest(s) AS sentence FROM (SELECT para_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM tei_paragraph WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS pos) WHERE FALSE UNION ALL SELECT para_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT para_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM tei_paragraph WHERE text IS NOT NULL)")
def sentence_split(spark, folder):
    return table(spark, folder, "tei_paragraph").select("para_id", F.posexplode(text.sentences("text")).alias("pos", "sentence")).select("para_id", *_long("pos"), "sentence")


_FILE = r"regexp_replace(regexp_replace(CASE WHEN contains(v, ':') AND contains(lower(v), 'application/pdf') THEN string_split(v, ':')[-2] ELSE v END, '^internal-pdf://\d+/', ''), '^.*[/\\]', '')"


@query(
    r"SELECT meta_id, nullif(trim(regexp_replace(trim(doi), '^(?:https?://)?(?:dx\.)?doi\.org/', '', 'i')), '') AS doi, "
    r"nullif(array_to_string((SELECT list(n ORDER BY k) FROM (SELECT n, min(k) AS k FROM (SELECT unnest(ns) AS n, generate_subscripts(ns, 1) AS k FROM (SELECT list_transform(regexp_split_to_array(authors, '(?i)\s+and\s+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))) AS ns)) WHERE n <> '' GROUP BY n)), '; '), '') AS authors_all, "
    rf"list_filter(list_transform(string_split(declared_file, ';'), lambda x: trim({_FILE.replace('v', 'trim(x)') if False else _FILE.replace('(v,', '(trim(x),').replace('(v)', '(trim(x))').replace('ELSE v END', 'ELSE trim(x) END')})), lambda n: lower(n) LIKE '%.pdf')[1] AS file FROM paper_meta"
)
def normalised_library(spark, folder):
    return table(spark, folder, "paper_meta").select(
        "meta_id", text.normalise_doi("doi").alias("doi"), text.normalise_authors("authors").alias("authors_all"), text.declared_filename("declared_file").alias("file")
    )


@query(r"SELECT meta_id, nullif(regexp_extract(imported_at::DATE::VARCHAR || ' ' || coalesce(title, ''), '((?:18|19|20|21)\d{2})', 1), '')::BIGINT AS year FROM paper_meta")
def parsed_years(spark, folder):
    raw = F.concat(F.date_format("imported_at", "yyyy-MM-dd"), F.lit(" "), F.coalesce("title", F.lit("")))
    return table(spark, folder, "paper_meta").select("meta_id", text.parse_year(raw).cast("long").alias("year"))


@query("SELECT id, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]', '', 'g') AS norm FROM paper")
def norm_keys(spark, folder):
    return table(spark, folder, "paper").select("id", similarity.norm_key("title").alias("norm"))


@query(
    "WITH x AS (SELECT m.meta_id, p.id, regexp_replace(lower(strip_accents(m.title)), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(strip_accents(p.title)), '[^a-z0-9]', '', 'g') AS b FROM paper_meta m JOIN paper p ON p.citekey = m.citekey) "
    "SELECT meta_id, id, jaro_winkler_similarity(a, b) >= 0.88 AS alike FROM x"
)
def title_similarity(spark, folder):
    m = table(spark, folder, "paper_meta").select("meta_id", "citekey", similarity.norm_key("title").alias("a"))
    p = table(spark, folder, "paper").select("id", "citekey", similarity.norm_key("title").alias("b"))
    return m.join(p, "citekey").select("meta_id", "id", (similarity.jaro_winkler_score("a", "b") >= 0.88).alias("alike"))


@query(
    "SELECT p.id, CASE WHEN trim(coalesce(authors, '')) = '' THEN 'Anon' ELSE trim(string_split(string_split(authors, ';')[1], ',')[1]) || CASE WHEN contains(authors, ';') THEN ' et al.' ELSE '' END END || ' (' || coalesce(year::VARCHAR, 'n.d.') || ')' AS citation FROM paper p"
)
def short_citations(spark, folder):
    return table(spark, folder, "paper").select("id", text.short_citation("authors", "year").alias("citation"))


@query("SELECT id, md5('[' || coalesce(section, 'null') || '] ' || content) AS embedding_text_md5 FROM chunk")
def embedding_texts(spark, folder):
    return table(spark, folder, "chunk").select("id", F.md5(text.embedding_text("section", "content")).alias("embedding_text_md5"))


@query(r"SELECT DISTINCT construct, replace(replace(replace(construct, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM (SELECT unnest(constructs) AS construct FROM extraction) WHERE construct IS NOT NULL")
def escaped_constructs(spark, folder):
    return coverage.distinct_constructs(table(spark, folder, "extraction")).select("construct", text.escape_like("construct").alias("escaped"))


_SKIPPED = " OR ".join(f"starts_with(lower(trim(heading)), '{s}')" for s in ("references", "bibliography", "acknowledgement", "acknowledgements", "appendix", "author contributions", "conflicts of interest", "funding"))


@query(f"SELECT para_id, coalesce({_SKIPPED}, FALSE) AS skipped FROM tei_paragraph")
def skip_sections(spark, folder):
    return table(spark, folder, "tei_paragraph").select("para_id", text.skippable_heading("heading").alias("skipped"))


# ---- library --------------------------------------------------------------------------------------------------------

_DUPES = """
 k AS (SELECT *, lower(doi) AS d, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]', '', 'g') AS t FROM {source}),
 d1 AS (SELECT *, CASE WHEN d IS NOT NULL AND row_number() OVER (PARTITION BY d ORDER BY {pos}) > 1 THEN first_value(citekey) OVER (PARTITION BY d ORDER BY {pos}) END AS by_doi FROM k),
 d2 AS (SELECT {pos} AS pos2, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY {pos}) > 1 THEN first_value(citekey) OVER (PARTITION BY t ORDER BY {pos}) END AS by_title FROM d1 WHERE by_doi IS NULL AND t IS NOT NULL),
 dup AS (SELECT d1.*, coalesce(by_doi, by_title) AS duplicate_of FROM d1 LEFT JOIN d2 ON d2.pos2 = d1.{pos})"""


@query(f"WITH {_DUPES.format(source='paper', pos='id')} SELECT id, citekey, duplicate_of FROM dup")
def dedupe_first_wins(spark, folder):
    return library.first_wins_duplicates(table(spark, folder, "paper"), "id").select("id", "citekey", "duplicate_of")


_REPORT = f"""WITH {_DUPES.format(source='paper_meta', pos='meta_id')},
 r AS (SELECT *, trim(regexp_replace(coalesce(declared_file, ''), '\\s+', ' ', 'g')) = '' AS nofile FROM dup),
 pr AS (SELECT *, list_filter([CASE WHEN trim(coalesce(citekey, '')) = '' THEN 'missing citekey' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing title' END, CASE WHEN nofile THEN 'no attachment declared' END,
    CASE WHEN NOT nofile AND pdf_path IS NULL THEN 'attachment not found: ' || declared_file END, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate of ' || duplicate_of END], lambda x: x IS NOT NULL) AS problems,
    list_filter([CASE WHEN trim(coalesce(authors, '')) = '' THEN 'missing author' END, CASE WHEN year IS NULL THEN 'missing year' WHEN NOT year BETWEEN 1900 AND 2100 THEN 'implausible year: ' || year END,
    CASE WHEN trim(coalesce(venue, '')) = '' THEN 'missing venue' END, CASE WHEN trim(coalesce(doi, '')) = '' THEN 'missing DOI' END], lambda x: x IS NOT NULL) AS warnings FROM r)"""


@query(f"{_REPORT} SELECT meta_id, citekey, array_to_string(problems, '; ') AS problems, CASE WHEN len(problems) = 0 THEN array_to_string(warnings, '; ') ELSE '' END AS warnings, duplicate_of, len(problems) = 0 AS valid FROM pr")
def validation_report(spark, folder):
    r = library.report(table(spark, folder, "paper_meta"), "meta_id")
    return r.select("meta_id", "citekey", F.array_join("problems", "; ").alias("problems"), F.array_join("warnings", "; ").alias("warnings"), "duplicate_of", "valid")


@query(f"{_REPORT} SELECT count(*) AS total, count(*) FILTER (len(problems) = 0) AS valid, count(*) FILTER (len(problems) > 0) AS invalid, count(duplicate_of) AS duplicates, count(*) FILTER (len(problems) = 0 AND len(warnings) > 0) AS with_warnings FROM pr")
def library_summary(spark, folder):
    return library.summary(library.report(table(spark, folder, "paper_meta"), "meta_id"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Stored paths, files under their whole titles, and short declared names."""
    p = table(spark, folder, "paper")
    stored = p.where("pdf_path is not null").select(F.col("pdf_path").alias("path"))
    titled = p.select(F.concat(F.lit("full/"), F.replace("title", F.lit("/"), F.lit(" ")), F.lit(".pdf")).alias("path"))
    named = _declared(spark, folder).where(F.length("declared_file") < 46).select(F.concat(F.lit("named/"), "declared_file").alias("path"))
    return stored.unionByName(titled).unionByName(named).distinct()


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "paper_meta").groupBy("citekey").agg(F.min_by(F.struct("title", "declared_file"), "meta_id").alias("m"))
    return rows.select("citekey", "m.title", text.declared_filename("m.declared_file").alias("declared_file"))


_FILES = rf"""
 m AS (SELECT citekey, arg_min(declared_file, meta_id) AS raw FROM paper_meta WHERE declared_file IS NOT NULL AND meta_id IN (SELECT min(meta_id) FROM paper_meta GROUP BY citekey) GROUP BY citekey),
 dec AS (SELECT citekey, list_filter(list_transform(string_split(raw, ';'), lambda x: trim({_FILE.replace('(v,', '(trim(x),').replace('(v)', '(trim(x))').replace('ELSE v END', 'ELSE trim(x) END')})), lambda n: lower(n) LIKE '%.pdf')[1] AS file FROM m),
 files AS (SELECT DISTINCT path FROM (SELECT pdf_path AS path FROM paper WHERE pdf_path IS NOT NULL UNION ALL SELECT 'full/' || replace(title, '/', ' ') || '.pdf' FROM paper UNION ALL SELECT 'named/' || file FROM dec WHERE length(file) < 46)),
 disk AS (SELECT path, length(regexp_replace(path, '^.*[/\\]', '')) AS len, regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(path, '^.*[/\\]', ''), '(?s)^(.+)\.[^.]*$', '\1'))), '[^a-z0-9]', '', 'g') AS disk FROM files),
 stems AS (SELECT citekey, regexp_replace(lower(strip_accents(regexp_replace(file, '(?s)^(.+)\.[^.]*$', '\1'))), '[^a-z0-9]', '', 'g') AS stem FROM dec WHERE file IS NOT NULL)"""


@query(f"WITH {_FILES} SELECT citekey, min(path) AS path FROM stems JOIN disk ON stem = disk GROUP BY citekey")
def exact_file_match(spark, folder):
    return library.exact_matches(_declared(spark, folder), _files(spark, folder))


@query(f"WITH {_FILES} SELECT citekey, arg_min(path, (len, path)) AS path FROM stems JOIN disk ON starts_with(disk, stem) WHERE length(stem) >= 12 GROUP BY citekey")
def prefix_file_match(spark, folder):
    return library.prefix_matches(_declared(spark, folder), _files(spark, folder))


@query(f"WITH {_FILES} SELECT path FROM files WHERE path NOT IN (SELECT path FROM (SELECT citekey, min(path) AS path FROM stems JOIN disk ON stem = disk GROUP BY citekey))")
def unclaimed_files(spark, folder):
    files = _files(spark, folder)
    return library.unclaimed(files, library.exact_matches(_declared(spark, folder), files).withColumnRenamed("path", "pdf_path"))


_NORM = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
_CLAIMS = rf"""WITH RECURSIVE {_FILES},
 declared AS (SELECT citekey, arg_min(meta_id, meta_id) AS mid FROM paper_meta GROUP BY citekey),
 named AS (SELECT d.citekey, row_number() OVER (ORDER BY stem IS NULL, d.citekey) AS k, {_NORM.format("pm.title")} AS head, stem
   FROM declared d JOIN paper_meta pm ON pm.meta_id = d.mid LEFT JOIN stems ON stems.citekey = d.citekey),
 wishes AS (SELECT k, min(path) AS path, 'exact' AS how, 0 AS step, 0.0 AS unlike, 0 AS size FROM named JOIN disk ON stem = disk GROUP BY k
   UNION ALL SELECT k, path, 'prefix', 1, 0.0, len FROM named JOIN disk ON starts_with(disk, stem) WHERE length(stem) >= 12
   UNION ALL SELECT k, path, 'title', 2, 0.0, len FROM named JOIN disk ON starts_with(disk, head) OR starts_with(head, disk) WHERE length(head) >= 12
   UNION ALL SELECT k, path, 'fuzzy', 3, -s, 0 FROM (SELECT k, path, jaro_winkler_similarity(coalesce(stem, head), substring(disk, 1, length(coalesce(stem, head)))) AS s FROM named, disk WHERE coalesce(stem, head) IS NOT NULL) WHERE s >= 0.88),
 prefs AS MATERIALIZED (SELECT n.k, n.citekey, coalesce(list(struct_pack(p := path, h := how) ORDER BY step, unlike, size, path) FILTER (path IS NOT NULL), []) AS l FROM named n LEFT JOIN wishes w ON w.k = n.k GROUP BY ALL),
 fold AS (SELECT 0 AS k, NULL::VARCHAR AS citekey, NULL::STRUCT(p VARCHAR, h VARCHAR) AS got, []::VARCHAR[] AS claimed
   UNION ALL SELECT k, citekey, got, CASE WHEN got IS NULL THEN claimed ELSE list_append(claimed, got.p) END
     FROM (SELECT n.k, n.citekey, f.claimed, list_filter(n.l, lambda x: NOT list_contains(f.claimed, x.p))[1] AS got FROM fold f JOIN prefs n ON n.k = f.k + 1))"""


@query(f"{_CLAIMS} SELECT citekey, got.p AS pdf_path, got.h AS how FROM fold WHERE k > 0")
def claimed_files(spark, folder):
    return library.claim_files(_declared(spark, folder), _files(spark, folder))


@query(PACKED_FIELDS)
def p5_found(spark, folder):
    fields = {"authors": "authors", "declared_file": "files"}
    return unpack_fields(table(spark, folder, "paper_meta"), "meta_id", fields).withColumnRenamed("id", "meta_id")


# ---- chunks and evidence --------------------------------------------------------------------------------------------


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SLOT_OF = f"SELECT heading, CASE WHEN heading IS NULL OR trim(heading) = '' THEN 'OTHER' {_CASES} ELSE 'OTHER' END AS slot FROM (SELECT heading, trim(CASE WHEN {_MARKED} = lower(heading) THEN regexp_replace(lower(heading), '^\\s*\\d+(?:\\.\\d+)*\\s+', '') ELSE {_MARKED} END) AS h FROM secs)"
# paragraphs over the limit are filled with sentences one by one, sections with paragraphs one by one
_CHUNKS = rf"""WITH RECURSIVE para AS (SELECT paper_id, section_pos, para_pos, para_id, text, page FROM tei_paragraph WHERE regexp_matches(text, '\S')),
 secs AS (SELECT paper_id, section_pos, min(heading) AS heading, min(number) AS number FROM tei_paragraph GROUP BY ALL HAVING NOT coalesce(bool_or({_SKIPPED}) FILTER (heading IS NOT NULL), FALSE)),
 slots AS ({_SLOT_OF}),
 cut AS (SELECT para_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s, 1 AS k, '' AS held, []::VARCHAR[] AS done FROM para WHERE length(text) > 1800
   UNION ALL SELECT para_id, s, CASE WHEN length(held) > 1800 THEN k ELSE k + 1 END,
     CASE WHEN length(held) > 1800 THEN substring(held, 1651) WHEN held = '' THEN s[k] WHEN length(held) + length(s[k]) + 1 > 1800 THEN right(held, 150) || ' ' || s[k] ELSE held || ' ' || s[k] END,
     CASE WHEN length(held) > 1800 THEN list_append(done, {_STRIP.format("substring(held, 1, 1800)")}) WHEN held <> '' AND length(held) + length(s[k]) + 1 > 1800 THEN list_append(done, {_STRIP.format("held")}) ELSE done END
   FROM cut WHERE k <= len(s) OR length(held) > 1800),
 whole AS (SELECT para_id, CASE WHEN held <> '' THEN list_append(done, {_STRIP.format("held")}) ELSE done END AS parts FROM cut WHERE k > len(s) AND length(held) <= 1800),
 listed AS (SELECT p.*, w.parts, row_number() OVER (PARTITION BY paper_id, section_pos ORDER BY para_pos, p.para_id) AS i FROM para p LEFT JOIN whole w ON w.para_id = p.para_id),
 pack AS (SELECT paper_id, section_pos, 1::BIGINT AS i, []::VARCHAR[] AS held, 0::BIGINT AS size, NULL::INT AS page, []::STRUCT(t VARCHAR, p INT)[] AS done FROM secs
   UNION ALL SELECT paper_id, section_pos, i + 1, CASE WHEN parts IS NOT NULL THEN [] ELSE list_append(kept, text) END, CASE WHEN parts IS NOT NULL THEN 0 WHEN len(kept) = 0 THEN length(text) ELSE size + length(text) + 2 END,
     CASE WHEN len(kept) = 0 THEN pg ELSE page END, CASE WHEN parts IS NOT NULL THEN list_concat(flushed, list_transform(parts, lambda x: struct_pack(t := x, p := pg))) ELSE flushed END
   FROM (SELECT *, CASE WHEN full_ THEN [] ELSE held END AS kept, CASE WHEN full_ AND len(held) > 0 THEN list_append(done, struct_pack(t := {_STRIP.format("array_to_string(held, chr(10) || chr(10))")}, p := page)) ELSE done END AS flushed
     FROM (SELECT k.*, l.text, l.page AS pg, l.parts, l.parts IS NOT NULL OR (len(k.held) > 0 AND (k.size + length(l.text) + 2 > 1800 OR k.size >= 1200)) AS full_ FROM pack k JOIN listed l USING (paper_id, section_pos, i)))),
 ended AS (SELECT paper_id, section_pos, CASE WHEN len(held) > 0 THEN list_append(done, struct_pack(t := {_STRIP.format("array_to_string(held, chr(10) || chr(10))")}, p := page)) ELSE done END AS done FROM pack QUALIFY row_number() OVER (PARTITION BY paper_id, section_pos ORDER BY i DESC) = 1),
 body AS (SELECT e.paper_id, e.section_pos, generate_subscripts(done, 1) AS piece, unnest(done) AS c FROM ended e),
 first AS (SELECT p.id AS paper_id, m.abstract FROM paper_meta m JOIN paper p ON p.citekey = m.citekey QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY m.meta_id) = 1),
 rows AS (SELECT paper_id, -1 AS section_pos, 0 AS piece, 'Abstract' AS section, 'ABSTRACT' AS canonical_section, NULL::INT AS page, trim(abstract) AS content FROM first WHERE regexp_matches(abstract, '\S')
   UNION ALL SELECT b.paper_id, b.section_pos, b.piece, NUMBERED, (SELECT min(slot) FROM slots WHERE slots.heading IS NOT DISTINCT FROM s.heading), b.c.p, b.c.t FROM body b JOIN secs s USING (paper_id, section_pos))"""
_NUMBERED = "CASE WHEN trim(coalesce(s.number, '')) = '' THEN s.heading ELSE concat_ws(' ', s.number, s.heading) END"


@query(f"{_CHUNKS.replace('NUMBERED', _NUMBERED)} SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY section_pos, piece) - 1 AS ordinal, section, canonical_section, page, content FROM rows")
def chunk_documents(spark, folder):
    abstracts = table(spark, folder, "paper_meta").join(table(spark, folder, "paper").select("citekey", F.col("id").alias("paper_id")), "citekey")
    first = abstracts.groupBy("paper_id").agg(F.min_by("abstract", "meta_id").alias("abstract"))
    chunks = chunking.chunk_documents(chunking.sections_of(table(spark, folder, "tei_paragraph")), first)
    return chunks.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT paper_id, count(DISTINCT section_pos) AS sections, coalesce(sum(length(text)), 0)::BIGINT AS chars, count(DISTINCT section_pos) = 0 OR coalesce(sum(length(text)), 0) < 500 AS empty FROM tei_paragraph GROUP BY paper_id")
def looks_empty(spark, folder):
    return chunking.looks_empty(table(spark, folder, "tei_paragraph")).select("paper_id", *_long("sections", "chars"), "empty")


@query(
    "WITH s AS (SELECT paper_id, section_pos, min(heading) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY para_pos, para_id) AS body FROM tei_paragraph GROUP BY ALL) "
    "SELECT paper_id, md5(trim(string_agg(concat_ws(chr(10), heading, body), chr(10) || chr(10) ORDER BY section_pos))) AS text_md5 FROM s GROUP BY paper_id"
)
def full_texts(spark, folder):
    return chunking.full_text(chunking.sections_of(table(spark, folder, "tei_paragraph"))).select("paper_id", F.md5("text").alias("text_md5"))


_BODIES = "bodies AS (SELECT paper_id, canonical_section AS slot, string_agg(content, chr(10) || chr(10) ORDER BY ordinal, id) AS body FROM chunk WHERE canonical_section IS NOT NULL GROUP BY ALL)"
_EVIDENCE = f"""{_BODIES},
 pr AS (SELECT paper_id, slot, body, list_position([{", ".join(f"'{s}'" for s in schema.EVIDENCE_ORDER)}], slot) - 1 AS priority FROM bodies),
 us AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY paper_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM pr),
 cut AS (SELECT paper_id, priority, slot, substring(body, 1, 60000 - used) AS body FROM us WHERE used < 60000)"""


@query(f"WITH {_EVIDENCE} SELECT paper_id, priority::BIGINT AS priority, slot, length(body) AS chars, md5(body) AS body_md5 FROM cut")
def evidence_budget(spark, folder):
    cut = evidence.budgeted_sections(evidence.section_bodies(table(spark, folder, "chunk")))
    return cut.select("paper_id", *_long("priority"), "slot", F.length("body").cast("long").alias("chars"), F.md5("body").alias("body_md5"))


@query(f"WITH {_EVIDENCE} SELECT paper_id, md5(trim(string_agg('### ' || slot || chr(10) || body, chr(10) || chr(10) ORDER BY priority))) AS evidence_md5 FROM cut GROUP BY paper_id")
def evidence_texts(spark, folder):
    return evidence.evidence(evidence.section_bodies(table(spark, folder, "chunk"))).select("paper_id", F.md5("evidence").alias("evidence_md5"))


@query("SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY id) - 1 AS running FROM chunk")
def chunk_ordinals(spark, folder):
    numbered = chunking.with_ordinals(table(spark, folder, "chunk").drop("ordinal"), [F.col("id")])
    return numbered.select("paper_id", "id", F.col("ordinal").cast("long").alias("running"))


@query(
    "WITH v AS (SELECT paper_id, id, embedding AS a, lead(embedding) OVER (PARTITION BY paper_id ORDER BY ordinal, id) AS b FROM chunk WHERE embedding IS NOT NULL), "
    "n AS (SELECT id, list_sum(list_transform(list_zip(a, b), lambda x: (x[1] * x[2])::DOUBLE)) AS ab, list_sum(list_transform(a, lambda x: (x * x)::DOUBLE)) AS aa, list_sum(list_transform(b, lambda x: (x * x)::DOUBLE)) AS bb FROM v WHERE b IS NOT NULL) "
    "SELECT id, round(CASE WHEN aa = 0 OR bb = 0 THEN 0 ELSE ab / (sqrt(aa) * sqrt(bb)) END, 5) AS cosine FROM n"
)
def neighbour_cosines(spark, folder):
    w = Window.partitionBy("paper_id").orderBy("ordinal", "id")
    v = table(spark, folder, "chunk").where("embedding is not null").select("id", F.col("embedding").alias("a"), F.lead("embedding").over(w).alias("b"))
    return v.where("b is not null").select("id", F.round(similarity.float_cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


# ---- synthesis ------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS call_type, user_id AS paper_id, count(*) AS calls FROM events WHERE event_type = 'click' AND user_id = (SELECT min(user_id) FROM events WHERE event_type = 'click') GROUP BY ALL")
def calls_of_paper(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_type").alias("call_type"), F.col("user_id").alias("paper_id"))
    first = log.where("call_type = 'click'").agg(F.min("paper_id")).first()[0]
    return store.calls(log, "click", first).groupBy("call_type", "paper_id").agg(F.count("*").alias("calls"))


@query("SELECT id, paper_id FROM extraction WHERE list_has_any(constructs, ['kerb access equity', 'driver autonomy'])")
def construct_overlap(spark, folder):
    return synthesis.naming(table(spark, folder, "extraction"), LABELS).select("id", "paper_id")


_GROUPS = r"""
 nm AS (SELECT paper_id, key_finding, unnest(list_distinct(constructs)) AS construct FROM extraction),
 ok AS (SELECT construct FROM nm WHERE construct IS NOT NULL GROUP BY construct HAVING count(*) >= 2 AND count(*) FILTER (regexp_matches(key_finding, '\S')) >= 2),
 grp AS (SELECT construct, paper_id, key_finding FROM nm WHERE regexp_matches(key_finding, '\S') AND construct IN (SELECT construct FROM ok))"""


@query(f"WITH {_GROUPS} SELECT construct, paper_id, md5(key_finding) AS finding_md5 FROM grp")
def construct_groups_min2(spark, folder):
    return synthesis.construct_groups(table(spark, folder, "extraction")).select("construct", "paper_id", F.md5("key_finding").alias("finding_md5"))


_REPORTED = f"""{_GROUPS},
 nx AS (SELECT construct, paper_id, key_finding, lead(paper_id) OVER w AS next_id, lead(key_finding) OVER w AS next_finding, row_number() OVER w AS k FROM grp WINDOW w AS (PARTITION BY construct ORDER BY paper_id)),
 pairs AS (SELECT construct, paper_id, key_finding, next_id, next_finding, k FROM nx WHERE next_id IS NOT NULL),
 reported AS (SELECT construct || '/' || k || '/a' AS pos, construct, paper_id AS paper_a_id, key_finding AS claim_a, next_id AS paper_b_id, next_finding AS claim_b FROM pairs
   UNION ALL SELECT construct || '/' || k || '/b', construct, next_id, next_finding, paper_id, key_finding FROM pairs
   UNION ALL SELECT construct || '/' || k || '/c', construct, -paper_id, key_finding, next_id, next_finding FROM pairs
   UNION ALL SELECT construct || '/' || k || '/d', construct, paper_id, key_finding, paper_id, key_finding FROM pairs),
 existing AS (SELECT construct, paper_id AS paper_a_id, next_id AS paper_b_id FROM pairs WHERE k = 1)"""


def _reported(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings as a careless client might report them: both directions, unknown papers, a paper against itself; and those recorded before."""
    w = Window.partitionBy("construct").orderBy("paper_id")
    p = groups.withColumns({"next_id": F.lead("paper_id").over(w), "next_finding": F.lead("key_finding").over(w), "k": F.row_number().over(w)}).where("next_id is not null")

    def variant(mark: str, a: str, ca: str, b: str, cb: str) -> DataFrame:
        pos = F.concat_ws("/", "construct", "k", F.lit(mark))
        return p.select(pos.alias("pos"), "construct", F.expr(a).alias("paper_a_id"), F.col(ca).alias("claim_a"), F.expr(b).alias("paper_b_id"), F.col(cb).alias("claim_b"))

    reported = variant("a", "paper_id", "key_finding", "next_id", "next_finding").unionByName(variant("b", "next_id", "next_finding", "paper_id", "key_finding"))
    reported = reported.unionByName(variant("c", "-paper_id", "key_finding", "next_id", "next_finding")).unionByName(variant("d", "paper_id", "key_finding", "paper_id", "key_finding"))
    return reported, p.where("k = 1").select("construct", F.col("paper_id").alias("paper_a_id"), F.col("next_id").alias("paper_b_id"))


_KEY = "lower(construct) || '|' || least(paper_a_id, paper_b_id) || '|' || greatest(paper_a_id, paper_b_id)"
_GUARDED = f"""{_REPORTED},
 sound AS (SELECT *, {_KEY} AS pair_key FROM reported r WHERE claim_a IS NOT NULL AND claim_b IS NOT NULL AND paper_a_id <> paper_b_id
   AND EXISTS (SELECT 1 FROM grp g WHERE g.construct = r.construct AND g.paper_id = r.paper_a_id) AND EXISTS (SELECT 1 FROM grp g WHERE g.construct = r.construct AND g.paper_id = r.paper_b_id)),
 guarded AS (SELECT * FROM sound WHERE pair_key NOT IN (SELECT {_KEY} FROM existing) QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY pos) = 1)"""


@query(f"WITH {_GUARDED} SELECT pos, construct, paper_a_id, paper_b_id, pair_key FROM guarded")
def guarded_findings(spark, folder):
    groups = synthesis.construct_groups(table(spark, folder, "extraction"))
    reported, existing = _reported(groups)
    return synthesis.guarded_findings(reported, groups, existing).select("pos", "construct", "paper_a_id", "paper_b_id", "pair_key")


def _contradictions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extraction")
    groups = synthesis.construct_groups(e)
    reported, existing = _reported(groups)
    found = synthesis.guarded_findings(reported, groups, existing)
    moderator = e.select(F.col("paper_id").alias("paper_a_id"), F.col("context_sector").alias("possible_moderator"))
    return found.join(moderator, "paper_a_id", "left").select(
        F.col("pos").alias("id"), "construct", "paper_a_id", "claim_a", "paper_b_id", "claim_b", "possible_moderator", F.col("possible_moderator").isNotNull().alias("reviewed"), F.lit(None).cast("string").alias("verdict")
    )


@query(
    f"WITH {_GUARDED} SELECT g.pos AS id, g.construct, a.citekey AS citekey_a, b.citekey AS citekey_b, e.context_sector IS NOT NULL AS reviewed FROM guarded g JOIN paper a ON a.id = g.paper_a_id JOIN paper b ON b.id = g.paper_b_id "
    "LEFT JOIN extraction e ON e.paper_id = g.paper_a_id WHERE e.context_sector IS NULL"
)
def unreviewed(spark, folder):
    rows = synthesis.contradiction_rows(_contradictions(spark, folder).where("not reviewed"), table(spark, folder, "paper"))
    return rows.select("id", "construct", "citekey_a", "citekey_b", "reviewed")


@query(
    f"WITH {_GUARDED} SELECT pos AS id FROM guarded WHERE lower(construct) = lower('KERB ACCESS EQUITY')"
)
def findings_on_construct(spark, folder):
    return synthesis.on_construct(_contradictions(spark, folder), "KERB Access Equity").select("id")


@query(f"WITH {_GROUPS} SELECT construct, md5('Findings on ' || construct || ':' || chr(10) || string_agg('[' || citekey || '] ' || key_finding, chr(10) ORDER BY '[' || citekey || '] ' || key_finding)) AS prompt_md5 FROM grp JOIN paper ON paper.id = grp.paper_id GROUP BY construct")
def findings_prompts(spark, folder):
    prompts = synthesis.findings_prompt(synthesis.construct_groups(table(spark, folder, "extraction")), table(spark, folder, "paper"))
    return prompts.select("construct", F.md5("prompt").alias("prompt_md5"))


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements with the stored vector of their papers' first chunk that has one."""
    c = table(spark, folder, "chunk").where("embedding is not null").groupBy("paper_id").agg(F.min_by("embedding", "id").alias("vector"))
    return table(spark, folder, "extraction").join(c, "paper_id").select(F.col("id").alias("pos"), "paper_id", F.col("future_work_suggested").alias("statement"), "vector")


_ALIKE = 0.3
_FLOAT_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] * z[2])::DOUBLE))"
_CLUSTERS = rf"""WITH RECURSIVE told AS (SELECT e.paper_id, e.future_work_suggested AS statement, c.v, row_number() OVER (ORDER BY e.id) AS k, sqrt({_FLOAT_DOT.format("c.v", "c.v")}) AS size
   FROM extraction e JOIN (SELECT paper_id, arg_min(embedding, id) AS v FROM chunk WHERE embedding IS NOT NULL GROUP BY paper_id) c ON c.paper_id = e.paper_id WHERE regexp_matches(e.future_work_suggested, '\S')),
 fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS seed, []::STRUCT(k BIGINT, v FLOAT[], n DOUBLE)[] AS seeds
   UNION ALL SELECT t.k, CASE WHEN best.s >= {_ALIKE} THEN best.k ELSE t.k END, CASE WHEN best.s >= {_ALIKE} THEN f.seeds ELSE list_append(f.seeds, struct_pack(k := t.k, v := t.v, n := t.size)) END
     FROM (SELECT f.*, list_max(list_transform(f.seeds, lambda x: struct_pack(s := CASE WHEN x.n * u.size > 0 THEN {_FLOAT_DOT.format("x.v", "u.v")} / (x.n * u.size) ELSE 0 END, k := x.k))) AS best FROM fold f JOIN told u ON u.k = f.k + 1) f JOIN told t ON t.k = f.k + 1),
 members AS (SELECT f.seed, t.* FROM fold f JOIN told t ON t.k = f.k),
 papers AS (SELECT seed, paper_id, min(k) AS k FROM members GROUP BY ALL),
 groups AS (SELECT m.seed, count(*) AS n, arg_min(statement, (length(statement), k)) AS theme FROM members m GROUP BY seed)"""


@query(
    f"{_CLUSTERS} SELECT theme, (SELECT count(*) FROM papers p WHERE p.seed = g.seed)::INT AS paper_count, (SELECT string_agg(paper_id::VARCHAR, '|' ORDER BY k) FROM papers p WHERE p.seed = g.seed) AS paper_ids, "
    "(SELECT string_agg(citekey, '|' ORDER BY citekey) FROM papers p JOIN paper ON paper.id = p.paper_id WHERE p.seed = g.seed) AS citekeys FROM groups g WHERE n >= 2 AND (SELECT count(*) FROM papers p WHERE p.seed = g.seed) >= 2"
)
def future_work_clusters(spark, folder):
    found = synthesis.cluster_citekeys(synthesis.future_work_clusters(_statements(spark, folder), _ALIKE), table(spark, folder, "paper"))
    return found.select("theme", "paper_count", F.array_join(F.col("paper_ids").cast("array<string>"), "|").alias("paper_ids"), F.array_join("citekeys", "|").alias("citekeys"))


@query(
    "WITH g AS (SELECT context_sector AS theme, list(DISTINCT paper_id) AS paper_ids FROM extraction WHERE context_sector IS NOT NULL GROUP BY 1), x AS (SELECT theme, unnest(paper_ids) AS pid FROM g) "
    "SELECT theme, count(*) AS paper_count, string_agg(citekey, '|' ORDER BY citekey) AS citekeys FROM x JOIN paper ON paper.id = pid GROUP BY theme"
)
def cluster_citekeys(spark, folder):
    e = table(spark, folder, "extraction").where("context_sector is not null")
    clusters = e.groupBy(F.col("context_sector").alias("cluster")).agg(F.collect_set("paper_id").alias("paper_ids"), F.count_distinct("paper_id").alias("paper_count"))
    named = synthesis.cluster_citekeys(clusters, table(spark, folder, "paper"))
    return named.select(F.col("cluster").alias("theme"), "paper_count", F.array_join("citekeys", "|").alias("citekeys"))


# ---- store ----------------------------------------------------------------------------------------------------------


@query("SELECT s AS status, count(p.id) AS papers FROM (SELECT unnest(['PENDING', 'METADATA_OK', 'GROBID_OK', 'CHUNKED', 'EMBEDDED', 'EXTRACTED', 'FAILED']) AS s) LEFT JOIN paper p ON p.status = s GROUP BY s")
def status_histogram(spark, folder):
    return store.status_histogram(table(spark, folder, "paper")).select("status", "papers")


@query("SELECT citekey, title, failure_reason AS reason FROM paper WHERE status = 'FAILED'")
def failures(spark, folder):
    return store.failures(table(spark, folder, "paper"))


@query("SELECT id, citekey, status FROM paper WHERE status NOT IN ('EMBEDDED', 'EXTRACTED')")
def pending_papers(spark, folder):
    return store.pending(table(spark, folder, "paper")).select("id", "citekey", "status")


@query("SELECT status = 'FAILED' AS failed, count(*) AS papers, string_agg(CASE WHEN status = 'FAILED' THEN citekey END, '|' ORDER BY id) AS failed_citekeys FROM paper GROUP BY 1")
def ingest_summary(spark, folder):
    out = store.outcome_summary(table(spark, folder, "paper").select("id", "citekey", (F.col("status") == "FAILED").alias("failed")))
    return out.select("failed", "papers", F.when(F.size("citekeys") > 0, F.array_join("citekeys", "|")).alias("failed_citekeys"))


@query(
    "WITH old AS (SELECT * FROM paper WHERE status <> 'PENDING'), m AS (SELECT citekey, title AS t, coalesce(authors, '') AS a, year AS y, venue AS v, doi AS d, pdf_path AS p FROM paper_meta QUALIFY row_number() OVER (PARTITION BY citekey ORDER BY title NULLS FIRST, authors NULLS FIRST, year NULLS FIRST, venue NULLS FIRST, doi NULLS FIRST, pdf_path NULLS FIRST) = 1), "
    "fresh AS (SELECT citekey, row_number() OVER (ORDER BY citekey) + (SELECT max(id) FROM old) AS nid FROM m WHERE citekey NOT IN (SELECT citekey FROM old)) "
    "SELECT coalesce(o.id, f.nid) AS id, coalesce(o.citekey, m.citekey) AS citekey, CASE WHEN m.citekey IS NULL THEN o.title ELSE m.t END AS title, CASE WHEN m.citekey IS NULL THEN o.authors ELSE m.a END AS authors, "
    "CASE WHEN m.citekey IS NULL THEN o.doi ELSE m.d END AS doi, CASE WHEN m.citekey IS NOT NULL AND (o.id IS NULL OR o.status = 'FAILED') THEN 'METADATA_OK' ELSE o.status END AS status, "
    "CASE WHEN m.citekey IS NOT NULL AND (o.id IS NULL OR o.status = 'FAILED') THEN NULL ELSE o.failure_reason END AS failure_reason FROM old o FULL JOIN m ON m.citekey = o.citekey LEFT JOIN fresh f ON f.citekey = m.citekey"
)
def upsert_papers(spark, folder):
    old, metas = table(spark, folder, "paper").where("status <> 'PENDING'"), table(spark, folder, "paper_meta")
    merged = store.upsert_papers(old, metas, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return merged.select("id", "citekey", "title", "authors", "doi", "status", "failure_reason")


@query(
    "WITH fresh AS (SELECT paper_id, 'unstated' AS theoretical_lens FROM extraction WHERE theoretical_lens IS NULL) "
    "SELECT e.id, e.paper_id, coalesce(f.theoretical_lens, e.theoretical_lens) AS theoretical_lens, CASE WHEN f.paper_id IS NULL THEN coalesce(array_to_string(e.constructs, '|'), 'none') ELSE '' END AS constructs, CASE WHEN f.paper_id IS NULL THEN e.method END AS method FROM extraction e LEFT JOIN fresh f ON f.paper_id = e.paper_id"
)
def upsert_extractions(spark, folder):
    e = table(spark, folder, "extraction")
    again = e.where("theoretical_lens is null").withColumns({"theoretical_lens": F.lit("unstated"), "constructs": F.lit(None).cast("array<string>"), "method": F.lit(None).cast("string")})
    merged = store.upsert_extractions(e, again)
    return merged.select("id", "paper_id", "theoretical_lens", F.coalesce(F.array_join("constructs", "|"), F.lit("none")).alias("constructs"), "method")


@query("SELECT DISTINCT sha256(pdf_path) AS sha FROM paper WHERE pdf_path IS NOT NULL AND sha256(pdf_path) NOT IN (SELECT sha256(pdf_path) FROM paper WHERE pdf_path IS NOT NULL AND status IN ('EMBEDDED', 'EXTRACTED'))")
def sha_cache_miss(spark, folder):
    from ..sources.files import cached

    p = table(spark, folder, "paper").where("pdf_path is not null").withColumn("sha", F.sha2("pdf_path", 256))
    done = p.where(F.col("status").isin("EMBEDDED", "EXTRACTED")).select("sha", F.col("title").alias("tei"))
    return cached(p, done)[1].select("sha").distinct()


@query(
    "SELECT event_type AS call_type, event_type <> 'error' AS success, count(*) AS calls, count(DISTINCT user_id) AS papers FROM events GROUP BY ALL"
)
def audit_by_type(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_type").alias("call_type"), F.col("user_id").alias("paper_id"), (F.col("event_type") != "error").alias("success"))
    path = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    if not (store.append(log.where("success"), path) and store.append(log.where("not success"), path)):
        raise OSError(f"the log can't be written: {path}")
    return store.calls_by_type(spark.read.parquet(path))


@query("SELECT 'chunk' AS child, id FROM chunk WHERE paper_id NOT IN (SELECT id FROM paper) UNION ALL SELECT 'extraction', id FROM extraction WHERE paper_id NOT IN (SELECT id FROM paper) UNION ALL SELECT 'document', doc_id FROM documents WHERE paper_id IS NOT NULL AND paper_id NOT IN (SELECT id FROM paper)")
def orphaned_rows(spark, folder):
    paper = table(spark, folder, "paper")
    rows = [("chunk", "chunk", "id"), ("extraction", "extraction", "id"), ("document", "documents", "doc_id")]
    parts = [schema.orphans(table(spark, folder, t), "paper_id", paper).select(F.lit(n).alias("child"), F.col(k).alias("id")) for n, t, k in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT rule, n AS rows FROM (SELECT 'status not allowed' AS rule, count(*) FILTER (status NOT IN ('PENDING', 'METADATA_OK', 'GROBID_OK', 'CHUNKED', 'EMBEDDED', 'EXTRACTED', 'FAILED')) AS n FROM paper UNION ALL SELECT 'title is null', count(*) FILTER (title IS NULL) FROM paper UNION ALL SELECT 'authors is null', count(*) FILTER (authors IS NULL) FROM paper) WHERE n > 0")
def schema_violations(spark, folder):
    return schema.violations(table(spark, folder, "paper"), schema.PAPER, {"status": schema.STATUSES})


@query("SELECT id, citekey, year FROM paper WHERE year IS NOT NULL")
def papers_with_year(spark, folder):
    return store.with_year(table(spark, folder, "paper")).select("id", "citekey", "year")


@query("SELECT e.id, p.citekey, e.model_used FROM extraction e JOIN paper p ON p.id = e.paper_id")
def extraction_rows(spark, folder):
    return synthesis.with_citekeys(table(spark, folder, "extraction"), table(spark, folder, "paper")).select("id", "citekey", "model_used")


from . import catalogue_changes  # noqa: E402, F401 - registers its queries with those above
