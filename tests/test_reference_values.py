"""Values the operators must reproduce: fusion, escaping, literals, cosine, clusters, headings, normalisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litloom import schema
from litloom.functions import similarity, text
from litloom.operators import chunking, coverage, library, retrieval, synthesis


def one(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {t}" for n, t in ((n, _type(v)) for n, v in row.items()))).select(column.alias("x")).first().x if names else None


def _type(v):
    return {int: "int", list: "array<float>", float: "double"}.get(type(v), "string")


def texts(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", column_of(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "vector,words,expected",
    [
        ([10], [], [(10, 1 / 61)]), ([], [7, 20], [(7, 1 / 61), (20, 1 / 62)]), ([10, 20], [10, 20], [(10, 2 / 61), (20, 2 / 62)]),
        ([5, 9], [5], [(5, 2 / 61), (9, 1 / 62)]), ([200, 100], [100], None), ([1, 2, 3], [3, 2], None), ([10, 20], [20, 10], None), ([], [], []),
    ],
)
def test_fusion(spark, vector, words, expected):
    arms = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id long, rank int") for ids in (vector, words)]
    got = [(r.id, r.score) for r in retrieval.top(retrieval.fuse(arms, 60), 10).collect()]
    orders = {(200, 100): [100, 200], (1, 2, 3): [3, 2, 1], (10, 20): [10, 20]}
    if expected is None:
        assert [i for i, _ in got] == orders[tuple(vector)]
    else:
        assert [i for i, _ in got] == [i for i, _ in expected] and np.allclose([s for _, s in got], [s for _, s in expected])


def test_like_escaping(spark):
    assert texts(spark, text.escape_like, ["100% visibility", "last_mile", "back\\slash", "plain text", None]) == ["100\\% visibility", "last\\_mile", "back\\\\slash", "plain text", None]


def test_vector_literal(spark):
    df = spark.createDataFrame([([1.0, 2.5, -0.25],), ([1.0e-7, 2.0],)], "v array<float>")
    assert [r.x for r in df.select(text.vector_literal("v").alias("x")).collect()] == ["[1.0,2.5,-0.25]", "[1.0E-7,2.0]"]
    for bad in ([], None):
        with pytest.raises(Exception, match="empty vector"):
            spark.createDataFrame([(bad,)], "v array<float>").select(text.vector_literal("v")).collect()


@pytest.mark.parametrize("a,b,cos", [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 1.0], [100.0, 100.0], 1), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, cos):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    got = df.select(similarity.float_cosine(F.col("a"), F.col("b")).alias("f")).first()
    far = df.select(similarity.distance_to(F.col("a"), b)).first()[0]
    assert got.f == pytest.approx(cos) and (far is None if not any(a) else far == pytest.approx(1 - cos))


@pytest.mark.parametrize(
    "vectors,expected",
    [
        ([(1, 0.1), (1, 0.2), (1, 0.15)], [[0, 1, 2]]), ([(1, 0), (0, 1)], [[0], [1]]), ([(1, 0), (1, 2)], [[0], [1]]), ([(1, 0), (0.8, 0.6), (0, 1)], [[0, 1], [2]]), ([], []),
    ],
)
def test_greedy_clusters(vectors, expected):
    assert synthesis.cluster_vectors([np.array(v) for v in vectors], 0.62) == expected


def test_greedy_clusters_partition():
    vectors = [np.array(v) for v in [(1, 0), (0.9, 0.1), (0, 1), (0.1, 0.9), (1, 1)]]
    got = synthesis.cluster_vectors(vectors, 0.62)
    assert sorted(i for g in got for i in g) == [0, 1, 2, 3, 4] and got == synthesis.cluster_vectors(vectors, 0.62)


def test_clusters_of_statements(spark):
    rows = [(1, 10, "long statement", [1.0, 0.1]), (2, 11, "short", [1.0, 0.2]), (3, 12, "alone", [0.0, 1.0]), (4, 13, "  ", [1.0, 0.1]), (5, 14, None, None), (6, 10, "again", [1.0, 0.1])]
    df = spark.createDataFrame(rows, "pos long, paper_id long, statement string, vector array<float>")
    got = synthesis.future_work_clusters(df).collect()
    assert [(r.theme, r.paper_ids, r.paper_count) for r in got] == [("short", [10, 11], 2)]
    papers = spark.createDataFrame([(10, "b"), (11, "a")], "id long, citekey string")
    assert synthesis.cluster_citekeys(synthesis.future_work_clusters(df), papers).first().citekeys == ["a", "b"]
    assert synthesis.future_work_clusters(df.limit(0)).count() == 0


HEADINGS = {
    "3.1. Method": "METHOD", "IV. Results": "RESULTS", "2) Discussion": "DISCUSSION", "Introduction": "INTRODUCTION", "Methodology": "METHOD", "Findings": "RESULTS", "Discussion": "DISCUSSION",
    "Conclusion": "CONCLUSION", "Limitations and future research": "FUTURE_WORK", "Future work": "FUTURE_WORK", "Directions for future research": "FUTURE_WORK", "Limitations of this study": "LIMITATIONS",
    "Results and Discussion": "RESULTS", "Literature review": "RELATED_WORK", "Theoretical background": "THEORY", "Conceptual framework": "THEORY", "Data and variables": "OTHER", "": "OTHER", None: "OTHER",
    "priority": "RELATED_WORK", "Summary of results": "RESULTS", "4 Method": "METHOD", "7. References": "OTHER",
}


def test_headings(spark):
    assert texts(spark, text.heading_slot, list(HEADINGS)) == list(HEADINGS.values())


def test_skipped_headings(spark):
    assert texts(spark, text.skippable_heading, ["References", "Funding mechanisms in towns", "7. References", None, " ", "Method"]) == [True, True, False, False, False, False]


def test_library_normalisation(spark):
    assert texts(spark, text.normalise_authors, ["Smith, J. and Jones, K. and Smith, J.", " ", None]) == ["Smith, J.; Jones, K.", None, None]
    assert texts(spark, text.normalise_doi, ["https://doi.org/10.1016/j.urbmob.2022.100020", "DX.DOI.ORG/10.1/x", " ", None]) == ["10.1016/j.urbmob.2022.100020", "10.1/x", None, None]
    assert texts(spark, text.parse_year, ["c2008", "in press", "1799", "2150a", None]) == [2008, None, None, 2150, None]
    files = ["internal-pdf://0572211779/City logistics Challenges.pdf", "Smith - Title:files/12/Smith.pdf:application/pdf", "", None, "a.docx; b\\c\\d.PDF", "x.html"]
    assert texts(spark, text.declared_filename, files) == ["City logistics Challenges.pdf", "Smith.pdf", None, None, "d.PDF", None]


def test_cleaning(spark):
    values = ["as in [1, 2-3] and (Smith et al., 2020) trans- port .\u00a0End", None, ""]
    assert texts(spark, text.clean_text, values) == ["as in and transport. End", None, ""]


def test_small_text_rules(spark):
    assert texts(spark, text.page_from_coords, ["p;3,72.0", "3,72.0", None]) == [3, None, None]
    assert texts(spark, text.strip_extension, ["a.b.pdf", ".pdf", "none"]) == ["a.b", ".pdf", "none"]
    assert texts(spark, text.initials, ["anna maria", "x"]) == ["A. M.", "X."]
    df = spark.createDataFrame([("Doe, J.; Roe, K.", 2020, 3, "K"), ("", None, None, "k")], "a string, y int, p int, c string")
    got = df.select(text.short_citation("a", "y").alias("s"), text.citation_marker("c", "p").alias("m"), text.pair_key("c", F.lit(9), F.lit(4)).alias("k")).collect()
    assert [(r.s, r.m, r.k) for r in got] == [("Doe et al. (2020)", "[K p.3]", "k|4|9"), ("Anon (n.d.)", "[k]", "k|4|9")]


def test_jaro_winkler():
    assert similarity.jaro("", "") == 1 and similarity.jaro("a", "") == 0
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.jaro_winkler("abcd", "abxy") == pytest.approx(0.733333, abs=1e-6)
    assert similarity.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)


def test_coverage_grid(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "RESULTS", "Transport links"), (2, 2, "RESULTS", "port"), (3, 1, None, "port"), (4, 1, "METHOD", "100% a_b"), (5, 1, "METHOD", None)], "id long, paper_id long, canonical_section string, content string"
    )
    papers = spark.createDataFrame([(1, "B"), (2, "A")], "id long, citekey string")
    named = spark.createDataFrame([(["port", "0%", "_", "absent", None],), (None,)], "constructs array<string>")
    grid = coverage.gap_grid(chunks, papers, coverage.distinct_constructs(named))
    rows = {(r.construct, r.section): (r.coverage_count, r.citekeys) for r in grid.collect()}
    assert len(rows) == 4 * len(schema.GRID_SECTIONS)
    assert rows["port", "RESULTS"] == (2, ["A", "B"]) and rows["0%", "METHOD"] == (1, ["B"]) and rows["_", "METHOD"] == (1, ["B"]) and rows["absent", "RESULTS"] == (0, [])
    assert {r.construct for r in coverage.asserted_but_untested(grid).collect()} == {"port", "0%", "_", "absent"}
    assert coverage.gap_grid(chunks, papers, coverage.distinct_constructs(named.limit(0))).count() == 0


def test_search_rules(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "METHOD", "alpha beta gamma", [1.0, 0.0]), (2, 1, None, "beta alpha", [0.0, 0.0]), (3, 2, "RESULTS", "alpha", None), (4, 2, "RESULTS", "delta", [1.0, 0.0])],
        "id long, paper_id long, canonical_section string, content string, embedding array<float>",
    )
    ids = lambda q: sorted(r.id for r in retrieval.bm25(chunks, q).collect())
    assert ids("alpha beta") == [1, 2] and ids('"alpha beta"') == [1] and ids("delta OR gamma") == [1, 4] and ids("") == [] and ids("?!") == []
    assert [r.id for r in retrieval.vector_arm(chunks, [1.0, 0.0], 10).orderBy("rank").collect()] == [1, 4, 2]
    assert retrieval.hybrid_search(chunks, "  ", [1.0, 0.0]).count() == 0 and retrieval.hybrid_search(chunks, "alpha", [1.0, 0.0], top_k=0).count() == 0
    got = [r.id for r in retrieval.hybrid_search(chunks, "alpha", [1.0, 0.0], sections=["METHOD", None], paper_ids=[]).collect()]
    assert got == [1]
    with pytest.raises(ValueError):
        retrieval.hybrid_search(chunks, "alpha", [1.0, 0.0], top_k=-1)


def test_first_wins_duplicates(spark):
    rows = [(1, "a", "10.1/X", "One"), (2, "b", "10.1/x", "Two"), (3, "c", None, "two"), (4, "d", "10.2/y", "ONE!"), (5, "e", None, "中文"), (6, "f", None, "日本"), (7, "g", None, None)]
    df = spark.createDataFrame(rows, "pos long, citekey string, doi string, title string")
    got = {r.citekey: r.duplicate_of for r in library.first_wins_duplicates(df, "pos").collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "a", "e": None, "f": "e", "g": None}


def test_file_cascade(spark):
    rows = [
        ("k1", "Some long title of a paper", "City logistics challenges in the ol.pdf"), ("k2", None, "exact name.pdf"), ("k3", "A title that is on disk as it stands", None),
        ("k4", None, "exact name.pdf"), ("k5", None, "smal tpyo in the nmae.pdf"), ("k6", None, None),
    ]
    df = spark.createDataFrame(rows, "citekey string, title string, declared_file string")
    files = ["d/City logistics challenges in the old town - 2020.pdf", "d/City logistics challenges in the old town.pdf", "d/Exact-Name.pdf", "d/A title that is on disk as it stands.pdf", "d/small typo in the name.pdf", "d/left.pdf"]
    disk = spark.createDataFrame([(f,) for f in files], "path string")
    got = {r.citekey: (r.pdf_path, r.how) for r in library.claim_files(df, disk).collect()}
    assert got["k1"] == (files[1], "prefix") and got["k2"] == (files[2], "exact") and got["k3"] == (files[3], "title") and got["k4"] == (None, None) and got["k5"] == (files[4], "fuzzy") and got["k6"] == (None, None)
    left = library.unclaimed(disk, library.claim_files(df, disk)).collect()
    assert {r.path for r in left} == {files[0], files[5]}
    assert library.claim_files(df, disk.limit(0)).where("pdf_path is not null").count() == 0


def test_validation(spark):
    rows = [(1, "k", "T", "A", 2020, "V", "10.1/a", "f.pdf", "p/f.pdf"), (2, " ", None, None, 1500, " ", None, None, None), (3, "m", "U", "A", None, "V", "d", "g.pdf", None)]
    df = spark.createDataFrame(rows, "pos long, citekey string, title string, authors string, year int, venue string, doi string, declared_file string, pdf_path string")
    got = {r.pos: r for r in library.report(df, "pos").collect()}
    assert got[1].valid and got[1].warnings == [] and not got[2].valid and got[2].problems == ["missing citekey", "missing title", "no attachment declared"]
    assert got[3].problems == ["attachment not found: g.pdf"]
    assert library.summary(library.report(df, "pos")).first().asDict() == {"total": 3, "valid": 1, "invalid": 2, "duplicates": 0, "with_warnings": 0}


def brute_pack(paragraphs, target=1200, limit=1800):
    out, buf, page = [], "", None
    for t, p in paragraphs:
        if buf and (len(buf) + len(t) + 2 > limit or len(buf) >= target):
            out.append((buf.strip(), page))
            buf = ""
        page = p if not buf else page
        buf = buf + "\n\n" + t if buf else t
    return out + ([(buf.strip(), page)] if buf else [])


@pytest.mark.parametrize("sizes", [[1199, 10], [1200, 10], [1798, 1], [1796, 2], [1800], [500, 500, 500, 500], [], [1000, 798, 5]])
def test_packing(sizes):
    paragraphs = [("x" * n, i) for i, n in enumerate(sizes)]
    assert chunking.pack_paragraphs(paragraphs) == brute_pack(paragraphs)


def test_long_paragraphs():
    sentence = "A sentence of some forty characters, yes. "
    pieces = chunking.split_long((sentence * 100).strip(), 1800, 150)
    assert all(len(p) <= 1800 for p in pieces) and all(b[:100] in a + " " + b for a, b in zip(pieces, pieces[1:])) and pieces[-1].endswith("yes.")
    hard = chunking.split_long("y" * 4000, 1800, 150)
    assert [len(p) for p in hard] == [1800, 1800, 700]


def test_chunk_documents(spark):
    rows = [(1, 0, 0, 1, "Introduction", "1", "first", 3), (1, 0, 1, 2, "Introduction", "1", "second", 4), (1, 1, 0, 3, "References", None, "skip me", 5), (1, 2, 0, 4, None, None, "tail", None), (2, 0, 0, 5, "Method", None, None, 1)]
    df = spark.createDataFrame(rows, "paper_id long, section_pos int, para_pos int, para_id long, heading string, number string, text string, page int")
    abstracts = spark.createDataFrame([(1, " about "), (2, " ")], "paper_id long, abstract string")
    got = [tuple(r) for r in chunking.chunk_documents(chunking.sections_of(df), abstracts).orderBy("paper_id", "ordinal").collect()]
    assert got == [(1, 0, "Abstract", "ABSTRACT", None, "about"), (1, 1, "1 Introduction", "INTRODUCTION", 3, "first\n\nsecond"), (1, 2, None, "OTHER", None, "tail")]
