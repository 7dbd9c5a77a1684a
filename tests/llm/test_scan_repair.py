"""Scan repair: single decisions, whole texts, both ways of looking up corrections, planted noise in clean text."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from litloom.llm import scan_repair as sr

CLEAN = [
    "The regional transport network delivers goods to the harbour districts every morning.", "Informal carriers share a micro-hub with the regional platform and the harbour.",
    "Every network needs a reliable warehouse near the harbour, and carriers know it.", "A reliable platform delivers goods to carriers in rural districts.",
    "The warehouse near the platform shares goods with informal carriers every morning.", "Short- and long-term contracts differ in rural districts, and carriers know it.",
] * 12


def frame(spark, texts):
    return spark.createDataFrame([("s", i, t, "extra", "x") for i, t in enumerate(texts)], "src string, row_id long, text string, kind string, paragraphs string")


def repair(spark, texts):
    rows = sr.repair_scans(frame(spark, CLEAN + texts), ["src", "row_id"], "text").where(F.col("row_id") >= len(CLEAN)).orderBy("row_id").collect()
    return [(list(r.paragraphs), {(f.kind, f.fixed) for f in r.found}) for r in rows]


NOISY = [
    "The regional trans-\nport network delivers\n42\ngoods to the har- \nbour districts, and the micro-\nhub is near.",
    "Short-\nand long-term contracts differ in rural dis¬\n\nREVIEW OF GOODS, Vol. 4, No. 2\ntricts every morning.",
    "The rcgional netw0rk delivers goods to inforrnal\ncarriers.",
    "A first para-\ngraph of the harbour, and it ends with the ware\xad\nhouse here today in town\nquickly now.\n\nThe second one of them starts here with the platform.",
    None, "", " \n ", "42", "One line only.",
]


def check(got):
    assert got[0] == (["The regional transport network delivers goods to the harbour districts, and the micro-hub is near."], {("hyphen", "transport"), ("hyphen", "harbour"), ("hyphen", "micro-hub"), ("line", "42")})
    assert got[1][1] == {("hyphen", "districts"), ("line", "REVIEW OF GOODS, Vol. 4, No. 2")} and got[1][0] == ["Short- and long-term contracts differ in rural districts every morning."]
    assert got[2] == (["The regional network delivers goods to informal carriers."], {("ocr", "regional"), ("ocr", "network"), ("ocr", "informal")})
    assert len(got[3][0]) == 2 and got[3][0][1].startswith("The second") and ("hyphen", "warehouse") in got[3][1]
    assert got[4:] == [([], set()), ([], set()), ([], set()), (["42"], set()), (["One line only."], set())]


def test_decisions(spark):
    check(repair(spark, NOISY))


def test_decisions_by_join(spark, monkeypatch):
    monkeypatch.setattr(sr, "MAX_FACTS", -1)
    check(repair(spark, NOISY))


def test_empty_table_and_repeated_rows(spark):
    assert sr.repair_scans(frame(spark, []), ["src", "row_id"], "text").count() == 0
    twice = frame(spark, CLEAN + NOISY[:1]).unionByName(frame(spark, CLEAN + NOISY[:1]))
    rows = sr.repair_scans(twice, ["src", "row_id"], "text").where(F.col("row_id") == len(CLEAN)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_names_keep_their_hyphen(spark):
    got = repair(spark, ["As Doe-\nRoe argues, the harbour is regional.", "A " + "very " * 3000 + "long\nline of the harbour net-\nwork."])
    assert ("hyphen", "Doe-Roe") in got[0][1] and ("hyphen", "network") in got[1][1]


def test_ligatures_and_furniture():
    lex = sr.Lexicon({"offset": 5}, {}, 100)
    assert sr._single(sr.Piece("oﬀset,", False, 0), lex)[1:] == ("offset,", "offset")
    lines = ["The harbour is", "– 12 –", "Doe et al. / Review of Loads 3 (2001)", "| 47  Running title: Does it", "46  DOE", "Page 4 of 9", "Archive of Loads 3 (2) 17", "near (see Doe,", "2013).", "IV"]
    assert [i for i, f in enumerate(sr.furniture(lines)) if f] == [1, 2, 3, 4, 5, 6]


def test_planted_noise_comes_back(spark):
    rng = random.Random(5)
    texts, truth = [], []
    for t in CLEAN[:6] * 4:
        words, lines, cut = t.split(), [[]], set()
        for w in words:
            if len(lines[-1]) >= 5:
                core = w.strip(".,")
                if len(core) >= 7 and "-" not in core:
                    k = rng.randint(3, len(core) - 3)
                    lines[-1].append(w[:k] + "-")
                    lines.append([w[k:]])
                    cut.add(("hyphen", core))
                    continue
                lines.append([])
            lines[-1].append(w)
        texts.append("\n".join(" ".join(x) for x in lines if x))
        truth.append((t, cut))
    got = repair(spark, texts)
    assert [(" ".join(p), f) for p, f in got] == truth


def test_words_printed_apart(spark, monkeypatch):
    known = ["A net of work.", "The work needs a net.", "All goods, over carriers."]
    texts = known + [
        "The regional net work delivers\ngoods to the harb our districts.", "The warehouse near the harb our is reliable.",
        "All goods go over all\nrural districts and the net, work goes on.", "The net work of carriers.",
    ]
    want = [
        "The regional network delivers goods to the harbour districts.", "The warehouse near the harbour is reliable.",
        "All goods go over all rural districts and the net, work goes on.", "The net work of carriers.",
    ]
    assert [p for p, _ in repair(spark, texts)][len(known) :] == [[w] for w in want]
    monkeypatch.setattr(sr, "MAX_FACTS", -1)
    monkeypatch.setattr(sr, "TOP_WORDS", 20)
    assert [p for p, _ in repair(spark, texts)][len(known) :] == [[w] for w in want]


def test_both_paths_know_what_a_correction_counts(spark, monkeypatch):
    texts = NOISY + ["The warehouse near the plat-\nforrn shares goods.", "A reliablc plat-\nforrn in the rura1 districts.", "Informal carriers share an oﬃce and a micro-\nhuh, near the inforrnal net-"]
    monkeypatch.setattr(sr, "TOP_WORDS", 0)
    at_once = repair(spark, texts)
    monkeypatch.setattr(sr, "MAX_FACTS", -1)
    by_join = repair(spark, texts)
    check(by_join[: len(NOISY)])
    assert by_join == at_once and ("hyphen", "platform") in by_join[len(NOISY)][1]


JOINT = {
    "thereg ional network": "the regional network", "car riersin rural": "carriers in rural", "ofthe regional": "of the regional", "inrural districts": "in rural districts", "re gio nal": "regional",
    "regionalnetworkdelivers": "regional network delivers", "regiona1network": "regional network", "inforrna1": "informal", "the trans-\np0rt network": "the transport network", "net work": "network",
    "trans-\nport- \nation": "trans-port-ation", "t0 the harbour": "to the harbour", "Morgardum Westgate": "Morgardum Westgate", "DELIVERS G00DS": "DELIVERS GOODS",
}


def _lexicon():
    counts = sr.Counter(sr.Piece(w, False, 0).core.lower() for t in [*CLEAN, *["most of the transport"] * 12] for w in t.split())
    return sr.Lexicon(dict(counts), {}, counts.total())


def test_splits_merges_and_confusions_are_decoded_together():
    lex = _lexicon()
    for text, want in JOINT.items():
        lines = text.split("\n")
        got = " ".join(w for w, _ in sr.decode(sr.stream(lines, [False] * len(lines)), lex)[0])
        assert got.replace("-", "") == want.replace("-", ""), (text, got)


def test_random_noise_is_read_back():
    """Words of a sentence run together, broken and misread at random come back where one reading is cheapest."""
    lex, rng = _lexicon(), random.Random(4)
    words = "reliable warehouse platform districts regional informal carriers morning network delivers".split()
    swap = {"m": "rn", "l": "1", "o": "0", "d": "cl", "h": "li", "i": "l"}
    for _ in range(300):
        want = [rng.choice(words) for _ in range(3)]
        text = ""
        for k, w in enumerate(want):
            at = rng.randrange(len(w))
            noisy = w[:at] + swap.get(w[at], w[at]) + w[at + 1 :]
            if k == 1 and rng.random() < 0.5:
                noisy = noisy[:4] + " " + noisy[4:]
            text += (" " if k and rng.random() < 0.7 else "") + noisy
        assert " ".join(w for w, _ in sr.decode(sr.stream([text], [False]), lex)[0]) == " ".join(want), text


def test_joint_repair_of_rows(spark, monkeypatch):
    texts = [f"The harbour, {k.replace(chr(10), chr(10))} of carriers." for k in ("regiona1network", "inforrna1 car riersin rural", "ofthe")]
    want = ["The harbour, regional network of carriers.", "The harbour, informal carriers in rural of carriers.", "The harbour, of the of carriers."]
    filler = ["Most of the goods"] * 12
    for most in (sr.MAX_FACTS, -1):
        monkeypatch.setattr(sr, "MAX_FACTS", most)
        rows = sr.repair_scans(frame(spark, CLEAN + filler + texts), ["src", "row_id"], "text").where(F.col("row_id") >= len(CLEAN) + 12).orderBy("row_id").collect()
        assert [" ".join(r.paragraphs) for r in rows] == want


def test_long_runs_breed_no_candidates():
    run = sr._candidates({4, 5, 8})
    import pyarrow as pa

    rows = [r for b in run([pa.record_batch({"word": ["m" * 3000, "rnore"], "total": [1, 1]})]) for r in b.to_pylist()]
    assert {r["word"] for r in rows} == {"rnore"} and "more" in {r["first"] for r in rows}


def test_packed_words_are_read_like_frequent_ones(spark, monkeypatch):
    texts = [f"The harbour, {k} of carriers." for k in JOINT] + NOISY
    want = repair(spark, texts)
    assert (["The harbour, informal carriers in rural of carriers."], {("ocr", "informal")}) in repair(spark, ["The harbour, inforrna1 car riersin rural of carriers."])
    for most, facts, opened in ((0, sr.MAX_FACTS, sr.OPENED), (9, sr.MAX_FACTS, 3), (9, -1, sr.OPENED)):
        monkeypatch.setattr(sr, "TOP_WORDS", most)
        monkeypatch.setattr(sr, "MAX_FACTS", facts)
        monkeypatch.setattr(sr, "OPENED", opened)
        assert repair(spark, texts) == want


def test_branches_hold_all_words():
    words = sorted({w for t in CLEAN for w in t.lower().split()} | {"a", "an", "ana", "é", "én", "网", "𝒳b"})
    counts = {w: len(w) + 8 for w in words}
    rest = sr.Rest(pa.array(words[::2], pa.string()), pa.array([counts[w] for w in words[::2]], pa.int64()))
    lex = sr.Lexicon({w: counts[w] for w in words[1::2]}, {}, 100, rest)
    for w in [*words, "none", "deliver"]:
        node = lex.trie()
        for c in w:
            node = {} if node is None else node.get(c)
        assert (None if node is None else node.get(sr.WORD_END)) == counts.get(w)
