"""Records that differ in form only, against a plain comparison."""

import random

from litloom.llm.hidden_duplicates import collapse, copies_of, plain_doi, plain_runs, plain_text

FIELDS = {"doi": "doi", "title": "text", "citekey": "runs"}
SCHEMA = "id long, doi string, title string, citekey string, n int, first_id long"


def brute(rows):
    first, out = {}, set()
    for r in sorted(rows):
        key = (None if r[1] is None else plain_doi(r[1]), None if r[2] is None else plain_text(r[2]), None if r[3] is None else plain_runs(r[3]))
        if key in first:
            out.add((first[key], r[0]))
        else:
            first[key] = r[0]
    return out


def test_forms():
    assert plain_doi(" https://dx.doi.org/10.1/AbC-2.") == plain_doi("DOI: 10.1 / abc–2") == plain_doi("doi 10.1/abc2") == "101abc2"
    assert plain_text("{Straße: ÉTUDE?!}") == plain_text("STRASSE étude") and plain_text("Linlimin") != plain_text("Linlimín")
    assert plain_runs("Doe2001loads") == plain_runs("{2001/LOADS/doe},") and plain_runs("RN12") == plain_runs("12-rn") != plain_runs("RN21")


def test_groups(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        k = rng.randrange(60)
        title = rng.choice([f"A Study, {k}", f"a  study {k}!", f'"A STUDY {k}"'])
        doi = rng.choice([None, f"10.1/x{k}", f"https://doi.org/10.1/X{k}", f"doi:10.1 / x{k}"])
        rows.append((i * 2 + 1, doi, title, rng.choice([f"Doe{k}abc", f"{k}.abc.doe", f"DOE_{k}_ABC"]), 1, 9))
    rows += [(1001, None, None, None, 1, 9), (1003, None, None, None, 1, 9), (1005, "", "", "", 1, 9), (1007, " ", "?", "-", 1, 9), (None, None, None, None, 1, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [r for r in rows if r[0] is not None]
    assert {tuple(r) for r in copies_of(df, "id", FIELDS).collect()} == brute(kept)
    groups = collapse(df, "id", FIELDS).collect()
    assert sum(r.copies for r in groups) == len(kept) and len(groups) == len(kept) - len(brute(kept))


def test_hot_group_empty_and_long(spark):
    df = spark.range(3000).selectExpr("id", "cast(null as string) doi", "if(id % 3 = 0, 'Same Title', concat('t', id)) title", "'k1' citekey")
    assert copies_of(df, "id", FIELDS).count() == 999
    assert copies_of(df.limit(0), "id", FIELDS).count() == 0
    long = spark.createDataFrame([(1, None, "x y " * 50_000, "k", 1, 1), (2, None, "XY" * 50_000, "k", 1, 1)], SCHEMA)
    assert [tuple(r) for r in copies_of(long, "id", FIELDS).collect()] == [(1, 2)]
