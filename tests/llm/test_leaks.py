"""Leaked passages against a plain search."""

import random

import pytest

from litloom.llm import leaks
from litloom.llm.leaks import leaked_passages, without_leaks, words_of

DOCS, ITEMS = "doc_id long, text string, words int, item_id long", "item_id long, text string, doc_id long"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return leaked_passages(d, e, "doc_id", "text", "item_id", "text", **kw), d


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def noisy(rng, words, every, vocabulary):
    out = []
    for i, w in enumerate(words):
        if every and i % every == every - 1:
            kind = rng.choice("rda")
            if kind == "r":
                out.append(rng.choice(vocabulary) + "q")
            elif kind == "a":
                out += [w, rng.choice(vocabulary) + "q"]
        else:
            out.append(w)
    return out


def test_planted_passages(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(100 + i, [rng.choice(vocabulary) for _ in range(80)]) for i in range(12)]
    docs, truth = [], set()
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 200]))]
        kind = d % 6
        item, words = rng.choice(items)
        start = rng.randrange(0, 30)
        if kind == 1:
            body[5:5] = words[start : start + 25]
        elif kind == 2:
            body[5:5] = noisy(rng, words[start : start + 48], 9, vocabulary)
        elif kind == 3:
            body[5:5] = words[start : start + 17]  # too short
        elif kind == 4:
            body[5:5] = sorted(words[start : start + 40])  # another order
        elif kind == 5:
            body = [w.upper() + "," for w in words]
        if kind in (1, 2, 5):
            truth.add((item, d))
        docs.append((d, " ".join(body)))
    found, frame = run(spark, docs, [(i, " ".join(w)) for i, w in items])
    rows = found.collect()
    assert {(r.item_id, r.doc_id) for r in rows} == truth
    by_item, by_doc = dict(items), {i: words_of(t) for i, t in docs}
    for r in rows:
        part = by_item[r.item_id][r.item_start : r.item_start + r.words]
        near = by_doc[r.doc_id][max(0, r.doc_start - 8) : r.doc_start + r.words + 16]
        best = min(edits(part, near[i:j]) for i in range(0, 17) for j in range(max(i, len(part) - 8), min(len(near), len(part) + 24) + 1))
        assert r.words >= 25 and best <= r.words // 8
    clean = without_leaks(frame, found, "doc_id")
    assert clean.count() == len(docs) - len({d for _, d in truth})


def test_forms_and_edge_cases(spark):
    base = " ".join(f"word{i}" for i in range(30))
    wrapped = base.replace("word7 ", "wo-\nrd7 ").replace("word9", "Word-9!").replace(" word20", "\n\nword20")
    docs = [(1, wrapped), (2, None), (3, ""), (4, base[: len(base) // 2]), (1, wrapped), (5, "x " * 300_000 + base), (None, base)]
    found, _ = run(spark, docs, [(7, base), (8, None), (9, "too short"), (7, base)])
    assert sorted({(r.item_id, r.doc_id) for r in found.collect()}) == [(7, 1), (7, 5)]
    assert run(spark, [], [(7, base)])[0].count() == 0 and run(spark, docs, [])[0].count() == 0
    with pytest.raises(ValueError):
        run(spark, docs, [(7, base)], min_words=3)


def test_blocks_of_items_and_shards(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 40)
    monkeypatch.setattr(leaks, "SHARD_WORDS", 50)
    rng = random.Random(2)
    texts = [" ".join(f"t{rng.randrange(300)}" for _ in range(30)) for _ in range(5)]
    found, _ = run(spark, list(enumerate(texts)), [(10 + i, t) for i, t in enumerate(texts)])
    assert sorted((r.item_id, r.doc_id, r.words, r.edits) for r in found.collect()) == [(10 + i, i, 30, 0) for i in range(5)]


def test_edits_in_one_place(spark):
    words = [f"u{i}" for i in range(40)]
    other = [f"x{i}" for i in range(60)]
    docs = {
        1: words[:20] + other[:4] + words[20:],  # added
        2: words[:18] + words[22:],  # dropped
        3: words[:18] + other[:5] + words[23:],  # replaced
        4: words[:20] + other[:5] + words[20:],
        5: words[:20] + other[:6] + words[20:],  # one edit too many
        6: words[:14] + other[:5] + words[15:20] + other[5:] + words[22:36],  # too few words in each part
    }
    around = [(i, " ".join(other[20:40] + w + other[40:])) for i, w in docs.items()]
    found, _ = run(spark, around, [(7, " ".join(words))])
    assert sorted((r.doc_id, r.words, r.edits) for r in found.collect()) == [(1, 40, 4), (2, 40, 4), (3, 40, 5), (4, 40, 5)]


def test_ids_of_any_type_and_repeated_items_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 1)
    base = " ".join(f"word{i}" for i in range(30))
    d, e = spark.createDataFrame([("d1", base), ("d2", "x")], "doc_id string, text string"), spark.createDataFrame([("i", base), ("i", base + " more"), ("j", base)], "item_id string, text string")
    found = leaked_passages(d, e, "doc_id", "text", "item_id", "text")
    assert found.dtypes[:2] == [("item_id", "string"), ("doc_id", "string")]
    assert sorted((r.item_id, r.doc_id, r.words) for r in found.collect()) == [("i", "d1", 31), ("j", "d1", 30)]  # a word dropped at the end is within the edits


def test_repeated_words_are_taken_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PAIRS", 50)
    phrase, rest = [f"p{i}" for i in range(8)], [f"q{i}" for i in range(30)]
    docs = [(i, " ".join([*phrase, f"n{i}"] * 9 + (rest if i % 3 == 0 else []))) for i in range(12)]
    found, _ = run(spark, docs, [(1, " ".join([*phrase, *rest])), (2, " ".join([*phrase, "x1", *phrase, "x2", *phrase, "x3"]))])
    rows = {(r.item_id, r.doc_id) for r in found.collect()}
    assert {d for i, d in rows if i == 1} == {0, 3, 6, 9} and {d for i, d in rows if i == 2} == set(range(12))


def brute_holds(item, doc, min_words=25, per_edit=8):
    """Is there a passage? Every start in item and document, every length, by plain alignment."""
    for a in range(len(item)):
        for b in range(len(doc)):
            if item[a] != doc[b]:
                continue
            row = list(range(len(doc) - b + 1))
            for n, x in enumerate(item[a:], 1):
                prev, row = row, [n]
                for j, y in enumerate(doc[b:], 1):
                    row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
                if n >= min_words and min(row) * per_edit <= n:
                    return True
    return False


def test_clustered_edits_against_plain_alignment(spark):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        start, size = rng.randrange(0, 20), rng.randrange(22, 40)
        part = item[start : start + size]
        for _ in range(rng.choice([1, 1, 2])):
            at, n = rng.randrange(3, len(part) - 3), rng.randrange(1, 6)
            new = [f"e{rng.randrange(50)}" for _ in range(n)]
            part = rng.choice([part[:at] + new + part[at:], part[:at] + part[at + n :], part[:at] + new + part[at + n :]])
        docs.append((i, ["x"] * 3 + part + ["y"] * 3))
    found, _ = run(spark, [(i, " ".join(w)) for i, w in docs], [(1, " ".join(item))])
    assert {r.doc_id for r in found.collect()} == {i for i, w in docs if brute_holds(item, w)}
