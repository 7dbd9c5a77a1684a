"""Search as users type it: stems, stop words, alternatives, exclusions, phrases."""

import numpy as np
import pytest

from litloom.functions.stemming import stem
from litloom.operators import retrieval, search_index

# Stems that the published algorithm gives.
STEMS = {
    "consign": "consign", "consigned": "consign", "consolation": "consol", "conspicuously": "conspicu", "knightly": "knight", "knots": "knot", "hopping": "hop", "hoping": "hope", "generously": "generous",
    "communication": "communic", "relational": "relat", "happy": "happi", "by": "by", "say": "say", "cries": "cri", "ties": "tie", "dying": "die", "gas": "gas", "this": "this", "kiwis": "kiwi", "national": "nation",
    "rationalize": "ration", "adoption": "adopt", "controlling": "control", "roll": "roll", "disabled": "disabl", "bed": "bed", "shred": "shred", "skies": "sky", "exceeding": "exceed", "theory": "theori", "apology": "apolog",
    "toys": "toy", "agreed": "agre", "caring": "care", "added": "ad", "routing": "rout", "memories": "memori", "logistics": "logist", "scheduling": "schedul",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_queries():
    p = retrieval.Phrase
    assert retrieval.parse_query('Routes -"the memory" or "state of the art" THE') == [[p(("rout",), True), p(("memori",), False)], [p(("state", None, None, "art"), True)]]
    assert retrieval.parse_query("micro-hub OR or") == [[p(("micro", "hub"), True)]]
    assert retrieval.parse_query("the of") == retrieval.parse_query("") == retrieval.parse_query(None) == retrieval.parse_query(' "" - ') == []


TEXTS = {1: "The routes were planned. Memories fade.", 2: "Routing the vans; a memory of routes.", 3: "State of the art in towns", 4: "the state, the art", 5: None, 6: "", 7: "MICRO hub near the route", 8: "He is dying; skies fall"}


@pytest.mark.parametrize(
    "query,ids",
    [
        ("route", {1, 2, 7}), ("route memory", {1, 2}), ("routed -memory", {7}), ("route or art", {1, 2, 3, 4, 7}), ("route OR art", {1, 2, 3, 4, 7}), ('"state of the art"', {3}), ('"state the art"', {4}), ('"memory of routes"', {2}),
        ("micro-hub", {7}), ('"hub micro"', set()), ("the", set()), ("unknownword", set()), ("unknownword or memory", {1, 2}), ("die", {8}), ("sky", {8}), ("-route", {3, 4, 5, 6, 8}), ('route -"micro hub" -plan', {2}), ("rout.*", {1, 2, 7}), ("(route", {1, 2, 7}),
    ],
)
def test_matches(spark, query, ids):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in TEXTS.items()], "id long, content string, score double")
    assert {r.id for r in retrieval.bm25(df, query).collect()} == ids


def test_scores_count_all_forms(spark):
    df = spark.createDataFrame([(1, "route routes routing x x x"), (2, "route x x x x x"), (3, "y y y y y y")], "id long, content string")
    got = {r.id: r.score for r in retrieval.bm25(df, "routes").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    assert retrieval.bm25(df.limit(0), "routes").count() == 0


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in TEXTS.items()], "id long, content string, score double")
    path = str(tmp_path / "text")
    search_index.write_text_index(df, path)
    for query in ("route", "route memory", "routed -memory", "route or art", '"state of the art"', '"memory of routes" or die', "unknownword or memory", "the", "-route", 'route -"micro hub"'):
        scan, stored = ({r.id: round(r.score, 9) for r in x.collect()} for x in (retrieval.bm25(df, query), search_index.indexed_bm25(spark, path, df, query)))
        assert scan == stored, query
    search_index.write_text_index(df.limit(0), str(tmp_path / "none"))
    assert search_index.indexed_bm25(spark, str(tmp_path / "none"), df.limit(0), "route").count() == 0


def test_vector_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = np.float32(centres[rng.integers(0, 20, 600)] + 0.3 * rng.normal(size=(600, 16)))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    path = str(tmp_path / "vector")
    search_index.write_vector_index(df, path)
    hits = total = 0
    for q in range(0, 60, 6):
        query = [float(v) for v in x[q] + 0.05]
        want = [r.id for r in retrieval.vector_arm(df, query, 10).orderBy("rank").collect()]
        assert [r.id for r in search_index.indexed_vector_arm(spark, path, query, 10, 1000).orderBy("rank").collect()] == want
        hits += len(set(want) & {r.id for r in search_index.indexed_vector_arm(spark, path, query, 10, 4).collect()})
        total += 10
    assert hits / total >= 0.9
    assert search_index.indexed_vector_arm(spark, path, query, 650, 1).count() == 602
    search_index.write_vector_index(df.limit(0), str(tmp_path / "none"))
    assert search_index.indexed_vector_arm(spark, str(tmp_path / "none"), [1.0], 5).count() == 0
