"""Claiming of files and clusters of statements against the plain one-after-the-other algorithms."""

import random

import numpy as np
import pandas as pd
import pytest

from litloom.config import Config
from litloom.functions.similarity import jaro_winkler, norm_text
from litloom.operators import library, synthesis


def stem_of(name):
    return norm_text(name[: name.rindex(".")] if name.rfind(".") > 0 else name)


def one_after_the_other(rows, paths, fuzzy=0.88, shortest=12):
    paths = sorted(set(paths))
    base = {p: p.rsplit("/", 1)[-1] for p in paths}
    norm = {p: stem_of(b) for p, b in base.items()}
    exact = {}
    for p in paths:
        exact.setdefault(norm[p], p)
    claimed, out = set(), set()
    for key, title, declared in sorted(set(rows), key=lambda r: (r[2] is None, r[0], r[2] or "", r[1] is not None, r[1] or "")):
        stem, head = None if declared is None else stem_of(declared), None if title is None else norm_text(title)
        free = [p for p in paths if p not in claimed]
        got = how = None
        if stem is not None and exact.get(stem) in free:
            got, how = exact[stem], "exact"
        if got is None and stem is not None and len(stem) >= shortest and (fits := [p for p in free if norm[p].startswith(stem)]):
            got, how = min(fits, key=lambda p: (len(base[p]), p)), "prefix"
        if got is None and head is not None and len(head) >= shortest and (fits := [p for p in free if norm[p].startswith(head) or head.startswith(norm[p])]):
            got, how = min(fits, key=lambda p: (len(base[p]), p)), "title"
        probe = stem if stem is not None else head
        if got is None and probe is not None and free:
            best = max(free, key=lambda p: (jaro_winkler(probe, norm[p][: len(probe)]), [-ord(c) for c in p]))
            if jaro_winkler(probe, norm[best][: len(probe)]) >= fuzzy:
                got, how = best, "fuzzy"
        if got is not None:
            claimed.add(got)
        out.add((key, got, how))
    return out


def claims(spark, rows, paths, **kw):
    r = spark.createDataFrame([(*x, "p") for x in rows], "citekey string, title string, declared_file string, path string")
    return {tuple(x) for x in library.claim_files(r, spark.createDataFrame([(p, 1) for p in paths], "path string, citekey int"), Config(**kw)).collect()}


@pytest.mark.parametrize("seed,block", [(1, 5_000), (2, 7), (3, 7)])
def test_claims_equal_the_sequential_choice(spark, monkeypatch, seed, block):
    monkeypatch.setattr(library, "FUZZY_FILES", block)
    monkeypatch.setattr(library, "FUZZY_ROWS", block)
    monkeypatch.setattr(library, "AT_ONCE", 100_000 if seed == 2 else 0)  # at once, or by rounds
    rng = random.Random(seed)
    words = "harbour freight loads kerb access review town night slot depot".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(12)]
    paths = [f"d/{rng.choice('ab')}{i % 3}/{t.title()}{rng.choice(['', ' - copy', ' (2)', ' Sep 2020'])}.pdf" for i, t in enumerate(titles * 2)] + ["d/.pdf", "d/x.pdf"]
    rows = []
    for i in range(26):
        t = rng.choice(titles)
        noisy = t[: rng.randint(4, len(t))] if rng.random() < 0.4 else t.replace("r", "n", rng.randint(0, 2))
        rows.append((f"K{rng.randrange(40)}", rng.choice([t, noisy, None]), rng.choice([None, t + ".pdf", noisy + ".PDF", noisy, "zz.pdf"])))
    assert claims(spark, rows, paths) == one_after_the_other(rows, paths)


def test_a_row_displaced_late_looks_on(spark):
    # the bare title would fit A's file by prefix, A only finds it by likeness and chooses first
    rows = [("A", None, "harbour freight lcads.pdf"), ("B", "harbour freight", None), ("B", "harbour freight", None), (None, "x", "y"), ("C", None, None)]
    paths = ["d/harbour freight loads.pdf", "e/harbour freight loads in the town.pdf"]
    got = claims(spark, rows, paths)
    assert got == one_after_the_other([r for r in rows if r[0]], paths) and ("B", paths[1], "title") in got and ("C", None, None) in got
    assert claims(spark, rows, []) == {("A", None, None), ("B", None, None), ("C", None, None)} and claims(spark, [], paths) == set()


@pytest.mark.parametrize("listed", [32, -22])
def test_many_rows_of_one_name_take_few_passes(spark, monkeypatch, listed):
    monkeypatch.setattr(library, "AT_ONCE", 0)
    monkeypatch.setattr(library, "FUZZY_LIST", listed, raising=False)  # -22: fewer files at a time than rows ask for
    calls, cut = [], library.cut_lineage
    monkeypatch.setattr(library, "cut_lineage", lambda df: calls.append(1) or cut(df))
    rows = [(f"K{i:02}", "harbour freight loads", None) for i in range(16)] + [(f"L{i:02}", None, "harbour freight lcads.pdf") for i in range(16)]
    paths = [f"d{i}/harbour freight loads {'x' * (i % 3)}.pdf" for i in range(24)]
    assert claims(spark, rows, paths) == one_after_the_other(rows, paths)
    assert listed < 0 or len(calls) <= 12


def test_likeness_of_pairs_at_once():
    rng = random.Random(7)
    for length in (1, 2, 3, 12, 63, 64, 65, 130):
        probes = ["".join(rng.choice("abcd1") for _ in range(length)) for _ in range(6)]
        names = [*probes, "", "a"] + ["".join(rng.choice("abcd1") if rng.random() < 0.2 else c for c in p)[: rng.randint(1, length)] + "zz" for p in probes for _ in range(4)]
        asked = pd.DataFrame({"probe": probes, "first": 5, "unlike": -2.0, "last": -1})
        files = pd.DataFrame({"fid": range(len(names)), "norm": names, "holder": [4 if i % 5 == 0 else 9 for i in range(len(names))]})
        want = {(i, f, s) for i, p in enumerate(probes) for f, x in enumerate(names) if f % 5 and x and (s := jaro_winkler(p, x[:length])) >= 0.88}
        assert {(i, int(f), float(s)) for i, scores, at in library._compared(asked, files, 0.88) for s, f in zip(scores, at)} == want and want


@pytest.mark.parametrize("block", [4096, 20])
def test_clusters_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(synthesis, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(60):
        v = centres[i % 6] * rng.uniform(0.5, 2) + 0.5 * rng.normal(size=16)
        rows.append((i * 3, i % 11, f"statement {'x' * int(rng.integers(1, 5))}", [float(x) for x in np.float32(v)], "t"))
    rows += [(7, 1, None, [1.0] * 16, "t"), (8, 1, " ", [1.0] * 16, "t"), (10, 2, "no vector", None, "t"), (11, 3, "zero", [0.0] * 16, "t"), (13, 3, "short vector", [1.0, 2.0], "t")]
    df = spark.createDataFrame(rows, "pos int, paper_id long, statement string, vector array<float>, theme string").repartition(5)
    told = sorted(r for r in rows if r[2] and r[2].strip() and r[3] is not None)
    want = []
    for members in synthesis.cluster_vectors([np.float32(r[3]) for r in told], 0.6):
        papers = list(dict.fromkeys(told[i][1] for i in members))
        if len(members) >= 2 and len(papers) >= 2:
            want.append((len(want), min((told[i][2] for i in members), key=len), papers, len(papers)))
    got = [(r.cluster, r.theme, list(r.paper_ids), r.paper_count) for r in synthesis.future_work_clusters(df, 0.6, 2).orderBy("cluster").collect()]
    assert got == want and len(want) > 3
    assert synthesis.future_work_clusters(df.limit(0)).count() == 0 and synthesis.future_work_clusters(df.where("pos = 0"), 0.6, 1).count() == 1


def test_constructs_in_blocks(spark, monkeypatch):
    from litloom.operators import coverage

    chunks = spark.createDataFrame([(1, "RESULTS", "Kerb access and slots"), (2, "METHOD", "kerb"), (3, None, "kerb"), (4, "RESULTS", None)], "paper_id long, canonical_section string, content string")
    names = spark.createDataFrame([("kerb",), ("Kerb Access",), ("slot",), ("none",), (None,)], "construct string")
    rows = []
    for block in (100, 2, 1):
        monkeypatch.setattr(coverage, "BLOCK", block)
        rows.append(sorted(tuple(r) for r in coverage.mentions(chunks, names).collect()))
    assert rows[0] == rows[1] == rows[2] == [(1, "RESULTS", "Kerb Access"), (1, "RESULTS", "kerb"), (1, "RESULTS", "slot"), (2, "METHOD", "kerb")]
    assert coverage.mentions(chunks, names.limit(0)).count() == 0
