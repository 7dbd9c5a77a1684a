"""Readers, outside services, changes of stored relations, incremental ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from litloom import schema
from litloom.operators import evidence, library, store, synthesis
from litloom.sources import bibtex, clients, files, tei
from litloom.streaming import ingest

BIB = r"""
@comment{not an entry}
@string{jul = "Journal of Loads"}
@article{k1, title = {{The} {\"U}ber Title}, author = "Doe, J. and Roe, K. and Doe, J.", journal = jul, year = {c2008}, doi = {https://doi.org/10.1/ABC}, file = {T:files/1/T.pdf:application/pdf}}
@book{broken, title = {never closed
@inproceedings{k2, title = {Caf\'e d{\'e}j\`a \ss{} \& more}, booktitle = unknown, year = 2020 # {a}}
"""

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title> A  title </title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Anna Maria</forename><surname>Doe</surname></persName></author><author><persName><forename>X</forename></persName></author></analytic>
<monogr><imprint><date when="0999"/><date when="2019-02"/></imprint></monogr><idno type="doi">10.1/x</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>One.</p><p>Two.</p></abstract></profileDesc></teiHeader><text><body>
<div><head n="1">Intro</head><p coords="p;3,7.0,1">See <ref>[1]</ref> the trans- port <formula>x</formula> .</p><div><p><s>In.</s><s>Out.</s></p></div></div><div><head>Empty</head></div></body></text></TEI>"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    rows = bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))
    got = {r.citekey: r for r in library.entries_to_meta(rows).collect()}
    assert set(got) == {"k1", "k2"}
    assert got["k1"].title == "The Über Title" and got["k1"].authors == "Doe, J.; Roe, K." and got["k1"].venue == "Journal of Loads" and got["k1"].year == 2008
    assert got["k1"].doi == "10.1/ABC" and got["k1"].declared_file == "T.pdf" and got["k2"].title == "Café déjà ß & more" and got["k2"].venue == "unknown" and got["k2"].year == 2020
    with pytest.raises(ValueError):
        bibtex.parse_bibtex("@article{x, title = {open")
    assert bibtex.parse_bibtex("") == []


def test_tei(spark, tmp_path):
    (tmp_path / "7.tei.xml").write_text(TEI, encoding="utf-8")
    (tmp_path / "8.tei.xml").write_text("<!DOCTYPE x [<!ENTITY e 'boom'>]><TEI>&e;</TEI>")
    (tmp_path / "9.tei.xml").write_text("<TEI><text><body><p>Loose one.</p></body></text></TEI>")
    got = {r.path.rsplit("/", 1)[-1]: r for r in tei.read_tei(spark, str(tmp_path)).collect()}
    d = got["7.tei.xml"]
    assert (d.title, d.authors, d.year, d.doi, d.abstract, d.error) == ("A title", ["Doe, A. M."], 2019, "10.1/x", "One.\n\nTwo.", None)
    assert [(s.heading, s.number, [(p.text, p.page) for p in s.paragraphs]) for s in d.sections] == [("Intro", "1", [("See the transport.", 3)]), ("Body", None, [("In. Out.", None)])]
    assert "DOCTYPE" in got["8.tei.xml"].error and got["9.tei.xml"].sections[0].heading == "Body"
    assert tei.parse_tei(None)["error"] and "well-formed" in tei.parse_tei("<a>")["error"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PDF").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"y")
    (tmp_path / "c.txt").write_bytes(b"z")
    assert [p.path.rsplit("/", 1)[-1] for p in files.list_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF"]
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.resolve("file:/no/such/file")
    found = files.read_bytes(spark, str(tmp_path))
    cache = found.where("path like '%a.pdf'").select("sha", F.lit("<TEI/>").alias("tei")).unionByName(found.where("path like '%b.PDF'").select("sha", F.lit(None).cast("string").alias("tei")))
    hits, misses = files.cached(found, cache)
    assert hits.count() == 1 and [r.path[-5:] for r in misses.collect()] == ["b.PDF"]


def test_clients(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "id long, t string")
    v = [r.v for r in df.select("id", clients.embedded(F.col("t")).alias("v")).orderBy("id").collect()]
    assert v[0] == v[1] and len(v[2]) == 384 and set(v[3]) == {0.0}
    for bad in (lambda xs: [], lambda xs: [[1.0]] * len(xs)):
        with pytest.raises(Exception):
            df.select(clients.embedded(F.col("t"), bad)).collect()
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError("down")
        return "ok"

    assert clients.with_retries(flaky, pause=0)("x") == "ok" and len(calls) == 3
    with pytest.raises(ValueError, match="empty"):
        clients.with_retries(lambda x: "", pause=0)("x")
    answer = '{"research_question": "why", "model_used": "liar"}'
    got = clients.extract_concepts(spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd")], "paper_id long, evidence string"), lambda e: answer if e == "good" else "nope" if e == "odd" else 1 / 0, "model-x")
    rows = {r.paper_id: r for r in got.collect()}
    assert rows[1].research_question == "why" and rows[1].model_used == "model-x" and rows[1].constructs == [] and rows[1].error is None
    assert "zero" in rows[2].error and rows[3].error == "unreadable answer"
    assert clients.steelman("", "gap", None)["gap_survives"] is False
    assert clients.steelman("text", "gap", lambda p: '{"gap_survives": true, "counter_argument": "x"}')["gap_survives"] is True
    with pytest.raises(ValueError):
        clients.steelman("text", " ", None)


NOW = dt.datetime(2024, 1, 1)


def papers(spark, rows):
    return spark.createDataFrame([(i, k, None, t, "", None, None, None, s, r, NOW, NOW) for i, k, t, s, r in rows], schema.PAPER)


def test_upserts_and_states(spark):
    old = papers(spark, [(1, "a", "A", "FAILED", "why"), (2, "b", "B", "EXTRACTED", None), (3, "c", "C", "CHUNKED", None)])
    metas = spark.createDataFrame([("a", "A2", None, 2001, "V", "d", None), ("b", "B2", "X", None, None, None, None), ("z", "Z", "Y", None, None, None, None), ("m", None, None, None, None, None, None)],
                                  "citekey string, title string, authors string, year int, venue string, doi string, pdf_path string")
    got = {r.citekey: r for r in store.upsert_papers(old, metas).collect()}
    assert (got["a"].status, got["a"].failure_reason, got["a"].title, got["a"].authors) == ("METADATA_OK", None, "A2", "")
    assert got["b"].status == "EXTRACTED" and got["c"].title == "C" and (got["m"].id, got["z"].id) == (4, 5) and got["z"].status == "METADATA_OK"
    assert store.upsert_papers(old.limit(0), metas).count() == 4
    moved = store.set_status(old, spark.createDataFrame([(1, "GROBID_OK", None), (3, "EMBEDDED", "boom")], "id long, status string, error string"))
    got = {r.id: (r.status, r.failure_reason) for r in moved.collect()}
    assert got == {1: ("GROBID_OK", None), 2: ("EXTRACTED", None), 3: ("FAILED", "boom")}
    with pytest.raises(Exception, match="unknown state"):
        store.set_status(old, spark.createDataFrame([(1, "NOPE", None)], "id long, status string, error string")).collect()
    assert store.pending(old).count() == 2 and store.pending(old, force=True).count() == 3
    assert {r.status: r.papers for r in store.status_histogram(old).collect()} == dict.fromkeys(schema.STATUSES, 0) | {"FAILED": 1, "EXTRACTED": 1, "CHUNKED": 1}
    assert [tuple(r) for r in store.failures(old).collect()] == [("a", "A", "why")]


def test_chunk_partitions(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda p, n: spark.createDataFrame([(i, p, i, "t", [1.0]) for i in range(n)], "id long, paper_id long, ordinal int, content string, embedding array<float>")
    store.replace_chunks(rows(1, 3).unionByName(rows(2, 2)), path)
    store.replace_chunks(rows(1, 1), path)
    assert {r.paper_id: r["count"] for r in spark.read.parquet(path).groupBy("paper_id").count().collect()} == {1: 1, 2: 2}
    store.replace_chunks(rows(1, 1), path, emptied=[2])
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == 1
    root = str(tmp_path / "snap")
    store.write_snapshot(rows(1, 2), root)
    store.write_snapshot(store.read_snapshot(spark, root).limit(1), root)
    assert store.read_snapshot(spark, root).count() == 1
    assert store.append(rows(1, 1), str(tmp_path / "log")) and store.append(rows(1, 1), str(tmp_path / "log")) and spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert store.append(rows(1, 1), "nosuchscheme://x") is False


def test_findings(spark):
    groups = spark.createDataFrame([("c", 1, "f"), ("c", 2, "g"), ("d", 3, "h")], "construct string, paper_id long, key_finding string")
    rows = [(1, "c", 1, "x", 2, "y"), (2, "c", 2, "y", 1, "x"), (3, "c", 1, "x", 9, "y"), (4, "c", 1, "x", 1, "x"), (5, "c", 1, None, 2, "y"), (6, "d", 3, "x", 1, "y")]
    reported = spark.createDataFrame(rows, "pos int, construct string, paper_a_id long, claim_a string, paper_b_id long, claim_b string")
    none = spark.createDataFrame([], "construct string, paper_a_id long, paper_b_id long")
    assert [r.pos for r in synthesis.guarded_findings(reported, groups, none).collect()] == [1]
    assert synthesis.guarded_findings(reported, groups, spark.createDataFrame([("C", 2, 1)], none.schema)).count() == 0
    c = spark.createDataFrame([(1, "c", 1, "x", 2, "y", None, False, None, NOW)], schema.CONTRADICTION)
    assert store.review(c, 1, "sound").select("reviewed", "verdict").first() == (True, "sound")
    with pytest.raises(KeyError):
        store.review(c, 2, "x")


def test_integrity(spark):
    p = papers(spark, [(1, "a", "A", "ODD", None), (2, "b", "B", "PENDING", None)])
    assert [tuple(r) for r in schema.violations(p, schema.PAPER, {"status": schema.STATUSES}).collect()] == [("status not allowed", 1)]
    chunk = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "id long, paper_id long")
    log = spark.createDataFrame([(1, 1), (2, None)], "id long, paper_id long")
    assert [r.id for r in schema.orphans(chunk, "paper_id", p).collect()] == [2]
    gone = spark.createDataFrame([(1,)], "id long")
    out = schema.delete_cascade({"paper": p, "chunk": chunk, "api_call_log": log}, gone)
    assert out["paper"].count() == 1 and sorted(r.id for r in out["chunk"].collect()) == [2, 3] and out["api_call_log"].where("paper_id is not null").count() == 0
    c = spark.createDataFrame([(1, "c", 1, "x", 2, "y", None, False, None, NOW)], schema.CONTRADICTION)
    with pytest.raises(ValueError):
        schema.delete_cascade({"paper": p, "contradiction": c}, gone)


def test_evidence_budget(spark):
    rows = [(1, "INTRODUCTION", "i" * 50), (1, "METHOD", "m" * 30), (1, "RESULTS", "r" * 30), (1, "NOPE", "n"), (2, "METHOD", None), (3, "METHOD", "m" * 100), (3, "RESULTS", "r")]
    df = spark.createDataFrame(rows, "paper_id long, slot string, body string")
    got = [(r.paper_id, r.slot, len(r.body)) for r in evidence.budgeted_sections(df, 100).orderBy("paper_id", "priority").collect()]
    assert got == [(1, "METHOD", 30), (1, "RESULTS", 30), (1, "INTRODUCTION", 40), (3, "METHOD", 100)]
    assert evidence.evidence(df, 100).where("paper_id = 3").first().evidence == "### METHOD\n" + "m" * 100


def test_incremental_ingest(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    for n in (1, 2):
        (inbox / f"{n}.tei.xml").write_text(TEI, encoding="utf-8")
        ingest.ingest_available(spark, str(inbox), out, mark).awaitTermination()
        spark.catalog.refreshByPath(out)
        rows = spark.read.parquet(out)
        assert rows.count() == 3 * n and rows.where("ordinal = 0 and canonical_section = 'ABSTRACT'").count() == n
    assert rows.where("size(embedding) = 384").count() == 6
