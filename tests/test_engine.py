"""The pipeline from files to findings, with stand-ins for the outside services."""

import json

import pytest
from pyspark.sql import functions as F

from litloom.config import Config
from litloom.engine import Engine
from litloom.sources import clients

BIB = """
@article{doe, title={Loads of the harbour town}, author={Doe, J.}, year={2001}, file={loads of the harbour town.pdf}}
@article{roe, title={Rules of the quiet night}, author={Roe, K.}, year={2002}, file={rules of the quiet night.pdf}}
@article{bad, title={Broken document of nothing}, author={Bad, B.}, year={2003}, file={broken document of nothing.pdf}}
@article{twin, title={Loads of the Harbour Town}, author={Doe, J.}, year={2001}, file={twin.pdf}}
"""


def xml(word):
    body = f"The {word} carriers share the harbour kerb access with trucks. " * 20
    return f"<TEI><teiHeader/><text><body><div><head>Results</head><p>{body}</p></div><div><head>Future work</head><p>{body}</p></div></body></text></TEI>"


def parse(content: bytes) -> str:
    if b"bad" in content:
        raise ValueError("cannot parse")
    return xml(content.decode())


def chat(prompt, policy):
    prompt = str(prompt)
    if prompt.startswith("Findings on"):
        one = {"paper_a": "doe", "claim_a": "up", "paper_b": "roe", "claim_b": "down", "possible_moderator": "town"}
        return json.dumps([one, {**one, "paper_a": "roe", "paper_b": "doe"}, {**one, "paper_b": "ghost"}])
    if prompt.startswith("Claimed gap"):
        return json.dumps({"gap_survives": True, "counter_argument": "none stands"})
    assert prompt.startswith("Paper: ") and "Venue: unknown" in prompt and "### RESULTS" in prompt and policy.temperature == 0.0
    told = json.dumps({"constructs": ["kerb access"], "key_finding": "it rises", "future_work_suggested": "study the kerb at night", "model_used": "someone else"})
    return clients.Answer(told, 7, 2)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    (base / "pdf").mkdir()
    for name, text in (("Loads of the harbour town.pdf", "alpha"), ("Rules of the quiet night.pdf", "beta"), ("Broken document of nothing.pdf", "bad"), ("twin.pdf", "alpha")):
        (base / "pdf" / name).write_bytes(text.encode())
    (base / "lib.bib").write_text(BIB)
    return Engine(spark, str(base / "store"), chat=chat, model="stub"), str(base / "lib.bib"), str(base / "pdf")


def test_pipeline(engine):
    e, bib, pdf = engine
    assert e.search("kerb").count() == 0 and e.ingest_status()["total"] == 0
    ran = e.ingest_run(bib, pdf, parse)
    assert {**ran, "failed_citekeys": [r.citekey for r in ran["failed_citekeys"].collect()]} == {"ingested": 2, "failed": 1, "failed_citekeys": ["bad"], "invalid": 1}
    assert e.describe(ran) == "Ingest: 2 ingested, 1 failed (bad), 1 rejected"
    lines = [r.line for r in e.library_report(bib, pdf).collect()]
    assert lines[0] == "BibTeX library: 3 ingestable / 4 total" and "    - twin: duplicate of doe" in lines and "    - twin duplicates doe" in lines
    assert e.ingest_status()["by_status"]["EMBEDDED"] == 2 and [tuple(r) for r in e.failures().collect()] == [("bad", "Broken document of nothing", "cannot parse")]
    chunks = e.table("chunk").count()
    assert chunks >= 4
    assert e.reingest("doe", bib, pdf, lambda b: 1 / 0)["ingested"] == 1 and e.table("chunk").count() == chunks  # from the cache
    with pytest.raises(KeyError):
        e.reingest("nobody", bib, pdf, parse)

    hits = e.search("kerb access", top_k=3).collect()
    assert len(hits) == 3 and all(h.content and h.citekey for h in hits) and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    e.build_indexes()
    assert [tuple(h) for h in e.search_indexed("kerb access", top_k=3).collect()] == [tuple(h) for h in hits] and e.search_indexed("").count() == 0
    assert e.search(" ").count() == 0 and {h.canonical_section for h in e.search("kerb", sections=["RESULTS"]).collect()} == {"RESULTS"}

    assert e.extract_pending() == 2 and e.extract_pending() == 0 and e.extract_pending("doe") == 1
    assert e.table("extraction").count() == 2 and e.extraction("doe").first().model_used == "stub" and e.extractions("kerb access").count() == 2 and e.extractions("Kerb access").count() == 0
    assert e.call_log("extraction").where("success and tokens_in = 7 and tokens_out = 2").count() == 3 and e.call_log(paper_id=e.extraction("doe").first().paper_id).count() == 2

    assert e.find_contradictions().count() == 1 and e.find_contradictions().count() == 0 and e.contradictions(unreviewed=True).count() == 1
    assert e.contradictions(construct="KERB access").count() == 1 and e.contradictions(construct="kerb").count() == 0
    e.review(e.contradictions().first().id, "sound")
    assert e.contradictions(unreviewed=True).count() == 0 and e.contradictions().first().verdict == "sound"

    clusters = e.mine_future_work().collect()
    assert len(clusters) == 1 and clusters[0].citekeys == ["doe", "roe"]
    grid = e.gap_grid()
    assert grid.count() == 9 and grid.where("section = 'RESULTS'").first().citekeys == ["doe", "roe"] and e.uncovered().count() == 7
    assert [r.construct for r in e.asserted_but_untested().collect()] == ["kerb access"]
    answer = e.steelman("nobody studied the kerb")
    assert answer["gap_survives"] and answer["citekeys"] == ["doe", "roe"] and e.call_log("steelman").where("success").count() == 1
    assert e.table("paper").where(F.col("status") == "EXTRACTED").count() == 2


def test_states_and_failures_on_the_way(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "Loads of the harbour town.pdf").write_bytes(b"alpha")
    (tmp_path / "lib.bib").write_text(BIB)
    calls = tmp_path / "calls"

    def flaky(content):
        calls.write_text(calls.read_text() + "x" if calls.exists() else "x")
        if len(calls.read_text()) < 3:
            raise ConnectionError("gone")
        return xml("alpha")

    def no_vectors(texts):
        raise ValueError("no model")

    e = Engine(spark, str(tmp_path / "store"), embed=no_vectors, config=Config(retry_pause=0.0))
    seen = []
    save = e.save
    e.save = lambda name, rows: (save(name, rows), seen.append([r.status for r in rows.where("citekey = 'doe'").collect()]))
    ran = e.ingest_run(str(tmp_path / "lib.bib"), str(tmp_path / "pdf"), flaky)
    assert calls.read_text() == "xxx" and seen == [["GROBID_OK"], ["CHUNKED"], ["FAILED"]] and ran["failed"] == 1 and ran["ingested"] == 0
    assert e.failures().first().reason.startswith("embedding failed")
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "none")).steelman(" ")
