"""Kinds of text and their statistics."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litloom.llm import text_quality as tq
from litloom.llm.text_quality import document_kind, jensen_shannon, quality, statistics

PROSE = "The carrier that we met in the harbour was not aware of the new rule, and it took two weeks until the town told them about it. "
TEXTS = {
    "prose": PROSE * 3, "prose ": (PROSE * 4).upper(), "prose  ": "Wir haben die Lieferung in der Nacht mit dem Tarif verglichen, und die Ergebnisse zeigen, dass sich die Zeiten kaum ändern.",
    "prose   ": "Les résultats indiquent que le réseau et la demande sont peu liés dans la périphérie, et il reste à savoir si le permis y change.",
    "prose    ": "En este trabajo estudiamos cómo la tarifa en las afueras cambia con el permiso, y los resultados muestran que apenas se relacionan.",
    "prose     ": "\n".join(PROSE[i : i + 60] for i in range(0, 120, 60)), "prose      ": PROSE * 3 + "\n- one item\n- another item\n- third item",
    "prose       ": PROSE.replace(" ", "  ") * 2,
    "list": "\n".join(f"- item number {w}" for w in ("one", "two", "three", "four")), "list ": "1.1 Introduction ........ 3\n1.2 Method ........ 9\n2 Results ........ 21",
    "list  ": "dwell time; stop density; route memory, shift length; yard crowding; price opacity; kerb access", "list   ": "Doe, J.\nRoe, K.L. (Town)\nvon Poe, M.\nLow, A.\nHay, B.",
    "list    ": "[1] Doe, J. (2001). The loads of the town and the harbour. Review of Loads, 3(2), 1-9.\n[2] Roe, K. (2005). On the rules of the night. Letters on Loads, 4(1), 10-19.",
    "list     ": "Depot: a small warehouse\nKerb: edge of a street\nSlot: time at a dock\nTour: planned journey",
    "table": "| a | b | c |\n| load | 0.31 | 12 |\n| time | 0.2* | n.s. |", "table ": "load\t0.31\t12\ntime\t0.22\t13\nrate\t0.5\t1", "table  ": "Variable,N,b\nload,12,0.4\ntime,,0.1\nrate,9,",
    "table   ": "Variable N SD b\nload 0.12 0.5 2001\ntime n.s. 0.1* 7\nrate 1 2 3", "table    ": "load & 0.3 & 12 \\\\\ntime & 0.2 & 13 \\\\", "table     ": "Variable      N      SD\nload          12     0.4\ntime                 0.1",
    "junk": "=====\n-----\nxxxxxxxx\n########", "junk ": "Home\nNext\nLogin\nNext\nShare\nHome\nLogin\nDownload PDF", "junk  ": "Access denied\n" * 8,
    "junk   ": "WS7cxiyvNSmLs/5CA4G21SyCZsV66Z2NJMsJRArtlpu3Dcd3XXRXymeMle7MwVELJx1y8xcSimWY", "junk    ": "*]{l;]o#]t[{]*rt1us,.^}1}]tl i[i¤a¦ lanu[le/al;o¦ ;},a¦{|}¤}l^u;*.}o]r~1¤o",
    "junk     ": "nordovis contested council temporal clearance endowment pipeline heterogeneous deadline obstacle significant routine discrete eager formal vertical",
}


@pytest.mark.parametrize("want,text", TEXTS.items(), ids=[f"{k.strip()}-{i}" for i, k in enumerate(TEXTS)])
def test_kinds(want, text):
    assert document_kind(text)[0] == want.strip()


def test_statistics():
    s = dict(zip("kind non_prose words lines mean symbol digit punctuated common language far".split(), statistics(["The harbour is near.\nIt has 2 docks"])[0]))
    assert s["words"] == 8 and s["lines"] == 2 and s["punctuated"] == 0.5 and s["language"] == "en" and s["common"] == 5 / 8 and s["digit"] == pytest.approx(1 / 35)
    assert jensen_shannon([[1, 0], [0.5, 0.5]], [[0, 1], [0.5, 0.5]]).round(4).tolist() == [[1, 0.3113], [0.3113, 0]]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, PROSE * 2000, "x"), (4, "a", "x")], "doc_id long, text string, kind string")
    got = quality(df, "doc_id", "text").collect()
    assert len(got) == 5 and [r.kind for r in got[:3]] == ["blank"] * 3 and got[0].words == 0 and got[0].common_words is None and got[3].kind == "prose"
    assert quality(df.limit(0), "doc_id", "text").count() == 0


def test_blanks_after_a_line_end():
    padded = "The harbour is near." + " " * 12 + "\nIt has 2 docks" + "\t" * 20 + "\nIs it far?" + " \t" * 30
    assert statistics([padded])[0][7] == 2 / 3


@pytest.mark.parametrize("kind", ["prose", "list", "table", "junk"])
def test_every_kind_comes_from_the_nearest_profile(monkeypatch, kind):
    compared = []

    def answer(words, chars, forms):
        compared.append(len(words))
        return np.full(len(words), list(tq.KINDS).index(kind))

    monkeypatch.setattr(tq, "nearest_profiles", answer)
    texts = list(TEXTS.values())
    assert {k for k, _ in tq.document_kinds(texts)} == {kind}
    assert sum(compared) == sum(len(tq.blocks_of(t, tq._Doc(t))) for t in texts) >= len(texts)


def test_words_outweigh_a_form():
    # prose words in rows of cells or numbers are no table; repeated lines of prose are junk
    words, chars, forms = [[0.33, 0.06, 0.55, 0.05, 0.01]], [[0.8, 0.02, 0.15, 0.015, 0.015, 0.0]], np.zeros((1, len(tq.FORMS)))
    for form, kind in (("running", "prose"), ("again", "junk"), ("row", "prose"), ("numbers", "prose")):
        forms[:] = 0
        forms[0, tq.FORMS.index(form)] = 1
        assert tq.KINDS[tq.nearest_profiles(words, chars, forms)[0]] == kind


@settings(max_examples=150, deadline=None)
@given(st.text("ab1 .\n|;-A\t", max_size=300))
def test_blocks_hold_every_line(text):
    blocks = tq.blocks_of(text, tq._Doc(text))
    assert sum(n for n, *_ in blocks) == sum(len(x) for x in tq.LINE_END.split(text) if x.strip())
    for _, w, c, f in blocks:
        assert all(abs(sum(x) - 1) < 1e-9 for x in (w, c, f))


def test_long_batches_are_compared_in_parts(monkeypatch):
    texts = list(TEXTS.values())
    whole = tq.document_kinds(texts)
    monkeypatch.setattr(tq, "TOGETHER", 2)
    assert tq.document_kinds(texts) == whole and tq.document_kinds([]) == [] and statistics([]) == []
