"""Free-entered values and the entries they mean."""

import random

import pytest

from litloom.llm import canonical

TERMS = [
    (1, "lens", "kerbside commitment theory", "pavement pledge account"), (2, "lens", "anchored routines view", None), (3, "lens", "moral routing theory", None), (4, "lens", "network weathering theory", None),
    (5, "method", "semi-structured interviews", None), (6, "method", "multi-site case study", None), (7, "method", "diary study", None),
]
VALUES = [
    ("lens", "Kerbside commitment theory", 1), ("lens", "curbside commitment theory", 1), ("lens", "PAVEMENT PLEDGE ACCOUNT", 1), ("lens", "K.C.T.", 1), ("lens", " anchord routines view;", 2), ("lens", "view, anchored routines", 2),
    ("lens", "mainly anchored routines", 2), ("lens", "ancho. routines view (N = 12)", 2), ("lens", "open ledger doctrine", 0), ("lens", "kerbside paradox", 0), ("lens", "n/a", 0), ("lens", "?", 0), ("lens", "moral_routing theory, see p. 9", 3),
    ("method", "multi site case", 6), ("method", "semistructured interviews approach", 5), ("method", "anchored routines view", 0), ("lens", None, None), ("lens", " \t", None), ("other", "diary study", 0), ("method", "DIARY  STUDY", 7), ("method", "DIARY  STUDY", 7),
]


@pytest.mark.parametrize("block", [canonical.BLOCK, 2])
def test_mapping(spark, monkeypatch, block):
    monkeypatch.setattr(canonical, "BLOCK", block)
    terms = spark.createDataFrame(TERMS, "term_id long, kind string, label string, alt_label string")
    rows = spark.createDataFrame([(i, k, v, 1.5) for i, (k, v, _) in enumerate(VALUES)], "i long, field string, value string, score double")
    got = {r.i: r.term_id for r in canonical.map_values(rows, terms, "value", "field", "term_id", "kind", ["label", "alt_label"]).collect()}
    assert [got[i] for i in range(len(VALUES))] == [t for _, _, t in VALUES]
    assert len(got) == len(VALUES) and all((got[i] is None) == (t is None) for i, (_, _, t) in enumerate(VALUES)) and got[0] == 1


def test_empty_tables_and_long_values(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, kind string, label string, alt_label string")
    schema = "field string, value string"
    run = lambda rows, t: canonical.map_values(spark.createDataFrame(rows, schema), t, "value", "field", "term_id", "kind", ["label", "alt_label"]).collect()
    assert run([], terms) == [] and [r.term_id for r in run([("lens", "x")], terms.limit(0))] == [0]
    assert [r.term_id for r in run([("lens", "word " * 20_000)], terms)] == [0]


def test_scores_and_leads_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(2)
    syllables = "ba ke li mo nu ra so ti".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    names = [f"{word()} {word()} theory" for _ in range(40)] + ["ba ke theory", "ba li theory"]
    terms = spark.createDataFrame([(i + 1, "k", n, None) for i, n in enumerate(names)] + [(99, "k", names[3], "other name"), (None, "k", "lost", None), (98, None, "lost", None), (97, "k", None, None)], "id long, kind string, label string, alt string")
    values = [n.upper() for n in names] + [n[:-2] for n in names[:10]] + [f"{n.split()[0][:4]}. {n.split()[1]}" for n in names[:10]] + ["theory", names[3], "lost", "b.k.t."]
    rows = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)] + [(900, None, "x"), (901, "k", None)], "i long, kind string, value string")
    got = []
    for block, group in ((10_000, 2000), (7, 3), (1, 1)):
        monkeypatch.setattr(canonical, "BLOCK", block)
        monkeypatch.setattr(canonical, "VALUES", group)
        out = canonical.map_values(rows, terms, "value", "kind", "id", "kind", ["label", "alt"]).collect()
        got.append({r.i: (r.term_id, None if r.score is None else round(r.score, 9), None if r.lead is None else round(r.lead, 9)) for r in out})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(values) + 2
    assert got[0][0][0] == 1 and got[0][3][0] == 0 and got[0][901] == (None, None, None) and got[0][900][0] == 0  # two entries have the fourth name
    assert got[0][len(values) - 4][0] == got[0][len(values) - 2][0] == 0
