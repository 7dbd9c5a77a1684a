"""Queries of sources, services and changes of tables: what they read is made from the given tables on the way."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..operators import evidence, library, retrieval, search_index, store
from ..runtime import checkpoint_dir, table
from ..sources import bibtex, clients, tei
from . import catalogue as c
from .catalogue import query


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources --------------------------------------------------------------------------------------------------------


def _escaped(x: Column) -> Column:
    """Text for XML; characters that XML doesn't know become blanks."""
    plain = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\uFFFE\uFFFF]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


_PLAIN = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
_CLEANED = (
    r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]', '', 'g'), "
    r"'\([^()]*?(?:et al\.|,\s*\d{{4}})[^()]*?\)', '', 'g'), '(\p{{L}})-\s+(\p{{L}})', '\1\2', 'g'), '\s+([,.;:)])', '\1', 'g'), '\s+', ' ', 'g')), '')"
)


def _clean_sql(x: str) -> str:
    return _CLEANED.format(_PLAIN.format(x))


@query(
    f"SELECT p.id, {_clean_sql('p.title')} AS title, CASE WHEN p.year BETWEEN 1900 AND 2100 THEN p.year END AS year, {_clean_sql('p.doi')} AS doi, {_clean_sql('m.abstract')} AS abstract, "
    "CASE WHEN trim(p.authors) = '' THEN 0 ELSE len(string_split(p.authors, ';')) END AS authors, trim(string_split(string_split(p.authors, ';')[1], ',')[1]) || ', ' || upper(left(trim(string_split(string_split(p.authors, ';')[1], ',')[2]), 1)) || '.' AS first_author "
    "FROM paper p LEFT JOIN (SELECT citekey, arg_min(struct_pack(a := abstract), meta_id).a AS abstract FROM paper_meta GROUP BY citekey) m ON m.citekey = p.citekey"
)
def tei_headers(spark, folder):
    abstracts = table(spark, folder, "paper_meta").groupBy("citekey").agg(F.min_by(F.struct("abstract"), "meta_id").alias("m"))
    rows = table(spark, folder, "paper").join(abstracts, "citekey", "left")
    person = lambda a: F.concat(F.lit("<author><persName><forename>"), _escaped(F.trim(F.get(F.split(a, ","), F.lit(1)))), F.lit("</forename><surname>"), _escaped(F.get(F.split(a, ","), F.lit(0))), F.lit("</surname></persName></author>"))
    named = F.filter(F.split("authors", ";"), lambda a: F.trim(a) != "")
    tag = lambda before, x, after: F.coalesce(F.concat(F.lit(before), _escaped(x), F.lit(after)), F.lit(""))
    xml = F.concat(
        F.lit("<TEI><teiHeader><fileDesc>"), tag("<titleStmt><title>", F.col("title"), "</title></titleStmt>"), F.lit("<sourceDesc><analytic>"), F.coalesce(F.array_join(F.transform(named, person), ""), F.lit("")), F.lit("</analytic>"),
        tag('<date when="', F.col("year").cast("string"), '-01"/>'), tag('<idno type="DOI">', F.col("doi"), "</idno>"), F.lit("</sourceDesc></fileDesc>"), tag("<profileDesc><abstract><p>", F.col("m.abstract"), "</p></abstract></profileDesc>"), F.lit("</teiHeader></TEI>"),
    )
    d = rows.select("id", tei.parsed(xml).alias("d"))
    return d.select("id", "d.title", F.col("d.year").cast("int").alias("year"), "d.doi", "d.abstract", F.size("d.authors").cast("long").alias("authors"), F.get("d.authors", F.lit(0)).alias("first_author"))


_TEI_ROWS = f"""WITH t AS (SELECT paper_id, section_pos, para_pos, para_id, page, {_clean_sql('text')} AS text FROM tei_paragraph),
 h AS (SELECT paper_id, section_pos, coalesce({_clean_sql('min(heading)')}, 'Body') AS heading, min(number) AS number FROM tei_paragraph GROUP BY ALL),
 kept AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section_pos ORDER BY para_pos, para_id) - 1 AS nth FROM t WHERE text IS NOT NULL),
 secs AS (SELECT paper_id, section_pos, row_number() OVER (PARTITION BY paper_id ORDER BY section_pos) - 1 AS pos FROM (SELECT DISTINCT paper_id, section_pos FROM kept))"""


@query(f"{_TEI_ROWS} SELECT paper_id, pos AS section_pos, nth AS para_pos, heading, number, text, page FROM kept JOIN secs USING (paper_id, section_pos) JOIN h USING (paper_id, section_pos)")
def tei_paragraphs(spark, folder):
    p = table(spark, folder, "tei_paragraph")
    coords = F.coalesce(F.concat(F.lit(' coords="x;'), F.col("page"), F.lit(',72.0,90.1"')), F.lit(""))
    each = F.concat(F.lit("<p"), coords, F.lit(">"), F.coalesce(_escaped(F.col("text")), F.lit("")), F.lit("</p>"))
    s = p.groupBy("paper_id", "section_pos").agg(F.array_sort(F.collect_list(F.struct("para_pos", "para_id", each.alias("p")))).alias("ps"), F.min("heading").alias("h"), F.min("number").alias("n"))
    head = F.concat(F.lit("<head"), F.coalesce(F.concat(F.lit(' n="'), _escaped(F.col("n")), F.lit('"')), F.lit("")), F.lit(">"), F.coalesce(_escaped(F.col("h")), F.lit("")), F.lit("</head>"))
    div = F.concat(F.lit("<div>"), head, F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</div>"))
    docs = s.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("section_pos", div.alias("d")))).alias("ds"))
    xml = F.concat(F.lit("<TEI><teiHeader/><text><body>"), F.array_join(F.transform("ds", lambda x: x["d"]), ""), F.lit("</body></text></TEI>"))
    rows = tei.paragraph_rows(docs.select("paper_id", tei.parsed(xml).alias("d")).select("paper_id", "d.*"), "paper_id")
    return rows.select("paper_id", *c._long("section_pos", "para_pos"), "heading", "number", "text", "page")


@query(
    r"SELECT 'k' || id AS citekey, 'article' AS entry_type, 'Über ' || trim(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g')) AS title, 'Doe, A.; Roe, B.' AS authors, year, 'Venue & Co' AS venue, 'f' || id || '.pdf' AS declared_file FROM paper"
)
def bibtex_entries(spark, folder):
    p = table(spark, folder, "paper")
    title = F.trim(F.regexp_replace("title", "[^A-Za-z0-9]+", " "))
    year = F.coalesce(F.concat(F.lit(", year={"), F.col("year"), F.lit("}")), F.lit(""))
    entry = F.concat(F.lit("@Article{k"), "id", F.lit(', title={{\\"U}ber '), title, F.lit("}"), year, F.lit(', author={Doe, A. and  Roe, B. and Doe, A.}, journal = "Venue \\& Co", file={:dir/f'), "id", F.lit(".pdf:application/pdf}}"))
    path = _scratch(spark, "bib")
    p.select(entry.alias("value")).write.text(path)
    return library.entries_to_meta(bibtex.read_bibtex(spark, path)).select("citekey", "entry_type", "title", "authors", "year", "venue", "declared_file")


@query("SELECT id, length('[' || coalesce(section, 'null') || '] ' || content)::DOUBLE AS chars, 2 AS width FROM chunk")
def embedded_texts(spark, folder):
    vector = clients.embedded(text.embedding_text("section", "content"), lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    v = table(spark, folder, "chunk").select("id", vector.alias("v"))
    return v.select("id", F.col("v")[0].cast("double").alias("chars"), F.size("v").alias("width"))


@query(
    f"WITH {c._EVIDENCE} SELECT paper_id, string_split('Title: ' || coalesce(nullif(trim(title), ''), 'unknown'), chr(10))[1] AS key_finding, 'stub' AS model_used, 0 AS constructs, NULL::VARCHAR AS error "
    "FROM (SELECT DISTINCT paper_id FROM cut) x JOIN paper ON paper.id = x.paper_id"
)
def extracted_concepts(spark, folder):
    prompts = evidence.extraction_prompts(evidence.evidence(evidence.section_bodies(table(spark, folder, "chunk"))), table(spark, folder, "paper"))
    told = clients.extract_concepts(prompts, lambda p: json.dumps({"key_finding": str(p).split("\n")[1], "model_used": "another"}), "stub")
    return told.select("paper_id", "key_finding", "model_used", F.size("constructs").alias("constructs"), "error")


# ---- text rules -----------------------------------------------------------------------------------------------------


@query("SELECT id, '[' || ordinal || '.0,' || length(content) || '.0]' AS vector FROM chunk")
def vector_literals(spark, folder):
    v = F.array(F.col("ordinal").cast("float"), F.length("content").cast("float"))
    return table(spark, folder, "chunk").select("id", text.vector_literal(v).alias("vector"))


@query("SELECT para_id, page FROM tei_paragraph")
def pages_from_coords(spark, folder):
    coords = F.coalesce(F.concat(F.lit("p;"), F.col("page"), F.lit(",72.0;q;9,1")), F.lit("p,72.0"))
    return table(spark, folder, "tei_paragraph").select("para_id", text.page_from_coords(coords).alias("page"))


@query(r"SELECT id, array_to_string(list_transform(list_filter(string_split(venue, ' '), lambda w: w <> ''), lambda w: upper(left(w, 1)) || '.'), ' ') AS marks FROM (SELECT id, trim(regexp_replace(venue, '\s+', ' ', 'g')) AS venue FROM paper)")
def initials(spark, folder):
    return table(spark, folder, "paper").select("id", text.initials("venue").alias("marks"))


@query(r"SELECT meta_id, CASE WHEN regexp_matches(doi, '\S') THEN doi WHEN regexp_matches(venue, '\S') THEN venue WHEN regexp_matches(citekey, '\S') THEN citekey END AS first_told, CASE WHEN regexp_matches(authors, '\S') THEN trim(authors) END AS authors FROM paper_meta")
def first_values(spark, folder):
    return table(spark, folder, "paper_meta").select("meta_id", text.first_non_blank("doi", "venue", "citekey").alias("first_told"), text.blank_to_null("authors").alias("authors"))


# ---- retrieval ------------------------------------------------------------------------------------------------------

_OF = "AND paper_id IN (1, 2, 3)"


@query(f"WITH {c._VECTOR_ARM.format(where=_OF)}, {c._TEXT_ARM.format(where=_OF)}, {c._FUSED} SELECT id, round(score, 6) AS score FROM hits")
def hybrid_of_papers(spark, folder):
    chunks = table(spark, folder, "chunk")
    return retrieval.hybrid_search(chunks, c.QUERY_TEXT, c._query_vector(chunks), paper_ids=[1, 2, 3, None]).select("id", F.round("score", 6).alias("score"))


@query("SELECT id FROM chunk WHERE FALSE")
def blank_search(spark, folder):
    return retrieval.hybrid_search(table(spark, folder, "chunk"), " \t", [1.0]).select("id")


def _text_index(spark: SparkSession, folder: str) -> str:
    path = _scratch(spark, "text-index")
    search_index.write_text_index(table(spark, folder, "chunk"), path)
    return path


@query(f"WITH {c._TEXT_ARM.format(where='')} SELECT id, round(score, 6) AS score FROM bm")
def indexed_text_scores(spark, folder):
    return search_index.indexed_bm25(spark, _text_index(spark, folder), table(spark, folder, "chunk"), c.QUERY_TEXT).select("id", F.round("score", 6).alias("score"))


@query(c.SQL["text_websearch"])
def indexed_websearch(spark, folder):
    return search_index.indexed_bm25(spark, _text_index(spark, folder), table(spark, folder, "chunk"), c.WEBSEARCH).select("id")


@query(f"WITH {c._VECTOR_ARM.format(where='')} SELECT id, rank, round(distance, 6) AS distance FROM vector_arm")
def indexed_vector_topk(spark, folder):
    chunks, path = table(spark, folder, "chunk"), _scratch(spark, "vector-index")
    search_index.write_vector_index(chunks, path)
    every = spark.read.parquet(f"{path}/cells").count()  # all cells probed: the exact result
    arm = search_index.indexed_vector_arm(spark, path, c._query_vector(chunks), 60, every)
    return arm.select("id", *c._long("rank"), F.round("distance", 6).alias("distance"))


# ---- changes --------------------------------------------------------------------------------------------------------


@query(
    "SELECT c.id, c.paper_id, md5(CASE WHEN p.status = 'EXTRACTED' THEN upper(content) ELSE content END) AS content_md5 FROM chunk c LEFT JOIN paper p ON p.id = c.paper_id WHERE c.paper_id <> (SELECT min(paper_id) FROM chunk)"
)
def replaced_chunks(spark, folder):
    chunks = table(spark, folder, "chunk").select("id", "paper_id", "ordinal", "content", F.lit(None).cast("array<float>").alias("embedding"))
    again = chunks.join(table(spark, folder, "paper").where("status = 'EXTRACTED'").select(F.col("id").alias("paper_id")), "paper_id", "left_semi").withColumn("content", F.upper("content"))
    path = _scratch(spark, "chunks")
    store.replace_chunks(chunks, path)
    gone = chunks.agg(F.min("paper_id")).first()[0]
    store.replace_chunks(again.where(F.col("paper_id") != gone), path, emptied=[gone])
    return spark.read.parquet(path).select("id", "paper_id", F.md5("content").alias("content_md5"))


@query(
    "SELECT id, CASE WHEN status <> 'PENDING' THEN status WHEN doi IS NULL THEN 'FAILED' ELSE 'GROBID_OK' END AS status, CASE WHEN status <> 'PENDING' THEN failure_reason WHEN doi IS NULL THEN 'no doi' END AS failure_reason, "
    "CASE WHEN status = 'PENDING' THEN TIMESTAMP '2024-01-01' ELSE updated_at END AS updated_at FROM paper"
)
def status_moves(spark, folder):
    papers = table(spark, folder, "paper")
    outcomes = papers.where("status = 'PENDING'").select("id", F.lit("GROBID_OK").alias("status"), F.when(F.col("doi").isNull(), "no doi").alias("error"))
    moved = store.set_status(papers, outcomes, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return moved.select("id", "status", "failure_reason", "updated_at")


@query(f"WITH {c._GUARDED}, f AS (SELECT min(pos) AS pos FROM guarded) SELECT g.pos AS id, e.context_sector IS NOT NULL OR g.pos = f.pos AS reviewed, CASE WHEN g.pos = f.pos THEN 'sound' END AS verdict FROM guarded g, f LEFT JOIN extraction e ON e.paper_id = g.paper_a_id")
def reviewed_findings(spark, folder):
    found = c._contradictions(spark, folder)
    first = found.agg(F.min("id")).first()[0]
    return (found if first is None else store.review(found, first, "sound")).select("id", "reviewed", "verdict")


@query(
    "WITH gone AS (SELECT id FROM paper WHERE status = 'FAILED') SELECT 'paper' AS name, count(*) AS rows FROM paper WHERE id NOT IN (FROM gone) UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE paper_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'extraction', count(*) FROM extraction WHERE paper_id NOT IN (FROM gone)"
)
def deleted_papers(spark, folder):
    tables = {n: table(spark, folder, n) for n in ("paper", "chunk", "extraction")}
    left = schema.delete_cascade(tables, tables["paper"].where("status = 'FAILED'").select("id"))
    counts = [left[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    f"{c._REPORT} SELECT line FROM (SELECT 'BibTeX library: ' || count(*) FILTER (len(problems) = 0) || ' ingestable / ' || count(*) || ' total' AS line FROM pr "
    "UNION ALL SELECT '  rejected (' || count(*) || '):' FROM pr WHERE len(problems) > 0 HAVING count(*) > 0 UNION ALL SELECT '    - ' || citekey || ': ' || array_to_string(problems, ', ') FROM pr WHERE len(problems) > 0 "
    "UNION ALL SELECT '  accepted with warnings (' || count(*) || '):' FROM pr WHERE len(problems) = 0 AND len(warnings) > 0 HAVING count(*) > 0 UNION ALL SELECT '    ~ ' || citekey || ': ' || array_to_string(warnings, ', ') FROM pr WHERE len(problems) = 0 AND len(warnings) > 0 "
    "UNION ALL SELECT '  duplicates (' || count(*) || '):' FROM pr WHERE duplicate_of IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT '    - ' || citekey || ' duplicates ' || duplicate_of FROM pr WHERE duplicate_of IS NOT NULL "
    r"UNION ALL SELECT '  PDFs on disk with no bib entry (' || count(*) || '):' FROM paper WHERE pdf_path IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT '    - ' || regexp_replace(pdf_path, '^.*[/\\]', '') FROM paper WHERE pdf_path IS NOT NULL)"
)
def library_lines(spark, folder):
    report = library.report(table(spark, folder, "paper_meta"), "meta_id")
    return library.report_lines(report, "meta_id", table(spark, folder, "paper").where("pdf_path is not null").select(F.col("pdf_path").alias("path"))).select("line")
