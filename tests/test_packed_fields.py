"""Several values in one field: styles, edge cases and round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litloom.operators.packed_fields import unpack_fields

AUTHORS = {
    "Doe, J.; Roe, K.L.;": ["Doe, J.", "Roe, K.L."],
    "Doe, J. and Roe, K. and others": ["Doe, J.", "Roe, K."],
    "J. Doe, K. Roe, and L. Poe": ["J. Doe", "K. Roe", "L. Poe"],
    "Doe, J., Roe, K., & Poe, L.M.": ["Doe, J.", "Roe, K.", "Poe, L.M."],
    "Doe J, van der Roe KL et al.": ["Doe J", "van der Roe KL"],
    '"Doe, J.", "Roe, K."': ["Doe, J.", "Roe, K."],
    '"Doe, J.";"Roe, K."': ["Doe, J.", "Roe, K."],
    "{Board of Ships, Ports and Piers} and Doe, J.": ["Board of Ships, Ports and Piers", "Doe, J."],
    '"Group; Section B"; Doe, J.; et al.': ["Group; Section B", "Doe, J."],
    "Doe, J., Jr.; Roe, K.": ["Doe, J., Jr.", "Roe, K."],
    "Doe, J.\nRoe, K.\n": ["Doe, J.", "Roe, K."],
    "Doe, J.\tRoe, K.|Poe, L.": ["Doe, J.", "Roe, K.", "Poe, L."],
    "Doe, J. / Roe, K. // Poe, L.": ["Doe, J.", "Roe, K.", "Poe, L."],
    "Doe, U.A. & Roe, K.; Doe, U.A.": ["Doe, U.A.", "Roe, K.", "Doe, U.A."],
    "Doe, Jane": ["Doe, Jane"], "O'Doe, J.; D'Roe, K.": ["O'Doe, J.", "D'Roe, K."], "  Doe,  J.\u00a0 ": ["Doe, J."],
    "Anderson, A. and Sandler, B.": ["Anderson, A.", "Sandler, B."], " ; ; ": [], "": [], "  ": [], None: [],
}
FILES = {
    "a b.pdf": ["a b.pdf"], "a, revised.pdf,b.docx": ["a, revised.pdf", "b.docx"], '"a; final.pdf" ; b.pdf': ["a; final.pdf", "b.pdf"], "'a; final.pdf';b.csv;": ["a; final.pdf", "b.csv"],
    "a\\; final:files/1/a\\; final.pdf:application/pdf ; b:files/2/b.csv:text/plain": ["a; final:files/1/a; final.pdf:application/pdf", "b:files/2/b.csv:text/plain"],
    "internal-pdf://012/x, revised.pdf; internal-pdf://013/y.pdf": ["internal-pdf://012/x, revised.pdf", "internal-pdf://013/y.pdf"],
    "C:\\refs\\a.pdf|C:\\refs\\a.pdf": ["C:\\refs\\a.pdf", "C:\\refs\\a.pdf"], '"a, revised.pdf",b.PDF': ["a, revised.pdf", "b.PDF"], None: [], " ": [], "a.pdf\nb.pdf": ["a.pdf", "b.pdf"],
}


@pytest.mark.parametrize("kind,cases", [("authors", AUTHORS), ("files", FILES)])
def test_styles(spark, kind, cases):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(cases)], "id long, v string, item string")
    got = {i: [] for i in range(len(cases))}
    for r in unpack_fields(df, "id", {"v": kind}).orderBy("id", "pos").collect():
        assert r.field == "v" and r.pos == len(got[r.id])
        got[r.id].append(r.item)
    assert list(got.values()) == list(cases.values())


def test_empty_long_and_repeated(spark):
    schema = "id long, v string"
    assert unpack_fields(spark.createDataFrame([], schema), "id", {"v": "authors"}).count() == 0
    long = "; ".join(f"Doe{i}, J." for i in range(5000))
    rows = unpack_fields(spark.createDataFrame([(1, long), (1, long)], schema), "id", {"v": "authors"})
    assert rows.count() == 10_000 and rows.where("pos = 4999").first().item == "Doe4999, J."


names = st.builds(lambda s, i: f"{s}, {i}.", st.text("abcdefgh", min_size=3, max_size=8).map(str.title), st.sampled_from("ABCDEFG"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(names, min_size=1, max_size=5), min_size=1, max_size=8), st.integers(0, 9))
def test_round_trip(spark, authors, seed):
    rng = random.Random(seed)
    styles = [lambda x: "; ".join(x), lambda x: " and ".join(x), lambda x: "|".join(x), lambda x: ", ".join(f'"{a}"' for a in x), lambda x: "\n".join(x), lambda x: ", ".join(x)]
    df = spark.createDataFrame([(i, rng.choice(styles)(a)) for i, a in enumerate(authors)], "id long, v string")
    got: dict = {}
    for r in unpack_fields(df, "id", {"v": "authors"}).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.item)
    assert [got[i] for i in range(len(authors))] == authors
