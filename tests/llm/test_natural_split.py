"""Natural boundaries and pieces."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litloom.llm.natural_split import boundaries, natural_boundaries, pieces, split_oversized


@pytest.mark.parametrize(
    "text,expected",
    [
        ("One. Two.", [(5, "sentence")]), ("One.\n \nTwo", [(7, "paragraph")]), ("See Fig. 3 and p. 4 ff. by Doe et al. (2001), e.g. here. Then", [(57, "sentence")]),
        ("It differs.29 Why? “Because.” Good", [(14, "sentence"), (19, "sentence"), (30, "sentence")]), ("By T. Doe and R. Roe. Of 0.53.12 Next", [(22, "sentence"), (33, "sentence")]),
        ("(No. 1 and No. 4).  eTour logs. 4 per cent", [(20, "sentence"), (32, "sentence")]), ("a; b, c: d. e", []), ("approx. 48 per cent vs. Mine", []), ("End of 2010. Next", [(13, "sentence")]),
        ("x=0.11 Y=0.2 Z", []), ("no mark\n\nnext", [(9, "paragraph")]), ("", []), ("\n\nstart", []), ("She asked... Then 𝛽 left. He", [(13, "sentence"), (26, "sentence")]),
    ],
)
def test_boundaries(text, expected):
    assert boundaries(text) == expected


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \nX", min_size=0, max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    at = [b for b, _ in boundaries(text)]
    got = pieces(text, at, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for start, stop, _ in got:
        assert 0 < stop - start <= limit or not text
    for (s1, e1, _), (s2, e2, _) in zip(got, got[1:]):
        assert s1 < s2 <= e1 <= s2 + overlap and e2 > e1


def test_split_rows(spark):
    words = "word " * 100
    rows = [(1, "short", "S", 7), (2, "Sentence one is here. " * 30, None, 8), (3, None, "S", 9), (4, "", "S", 1), (5, "z" * 450, "S", 1), (6, words, "S", 1), (2, "Sentence one is here. " * 30, None, 8)]
    df = spark.createDataFrame(rows, "id long, content string, section string, piece_start int")
    got = split_oversized(df, "content", 200, 30).collect()
    assert [r.content for r in got if r.id in (1, 3, 4)] == ["short", None, ""] and all(len(r.content or "") <= 200 for r in got)
    two = [r for r in got if r.id == 2 and r.piece_pos == 1]
    assert len(two) == 2 and two[0].content.startswith("Sentence one") and two[0].cut_reason == "boundary"
    assert {r.cut_reason for r in got if r.id == 5} == {"hard", "end"} and {r.cut_reason for r in got if r.id == 6} == {"word", "end"}
    for r in got:
        whole = dict((x[0], x[1]) for x in rows)[r.id]
        if whole:
            assert whole[r.piece_start : r.piece_start + len(r.content)] == r.content
    assert split_oversized(df.limit(0), "content", 200, 20).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "content", 10, 10)


def test_boundary_rows(spark):
    df = spark.createDataFrame([(1, "x" * 30), (2, "One two three. Four five six."), (3, "short"), (4, None)], "id long, content string")
    got = sorted(tuple(r) for r in natural_boundaries(df, "id", "content", 20).collect())
    assert got == [(1, -1, "none"), (2, 15, "sentence")]
