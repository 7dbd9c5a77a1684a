"""Problem 4 - map free-entered values to a canonical list and report what matches nothing.

Values are normalised and made distinct first, so each spelling is scored once however often it was typed. The list's
names are cut into character n-grams; a table counts in how many names of a kind each n-gram stands and gives it its
inverse-document-frequency weight. An inverted index over the weighted n-grams of a block of names retrieves a value's
candidates and scores them by weighted cosine; every one that can still be accepted is tested for how far it is covered by
the value. A candidate is accepted if it reaches ``threshold`` and leads the next entry by ``margin``. Acronyms of
a name are compared whole; a word cut with a full stop is completed to the only word of the list that it begins.

All that is counted over the list (weights, common words, acronyms, completions) is counted over all of it, and lists
longer than ``BLOCK`` names are scored block by block with each block's best two entries kept, so the result doesn't
depend on the blocks. Nothing of the list or of the values passes through the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage

#: Names of the canonical list in one inverted index, and distinct values scored against it in one group.
BLOCK, VALUES = 20_000, 2_000
#: A word in this many names of a kind distinguishes little; a name is also known without such a last word.
COMMON = 3
#: Key under which the weight of n-grams that no name has travels with the others.
RAREST = ""

# Remarks around a value that carry no meaning, and placeholders for "no value".
REMARK = (
    r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|[,;]?\s*\bsee\s+(?:p|pp|page|pages|sect|section|ch|table|fig|app|appendix)\b\.?\s*\w*|"
    r"[,;]?\s*\bn\s*=\s*\d+|^\s*(?:(?:mainly|mostly|primarily|chiefly|partly|largely|the|an?|our|use\s+of|using|based\s+on|drawing\s+on|e\.g\.|i\.e\.|cf\.)\s+)+"
)
REMARK_TAIL = {"approach", "approaches", "based", "method", "methods"}
PLACEHOLDERS = {"", "n a", "na", "none", "none given", "not stated", "not given", "not available", "see text", "tbd", "unclear", "unknown", "unspecified", "null", "nil"}


def normalise(value: str) -> str:
    """Lower-case words of a value without remarks, punctuation and extra blanks; full stops behind cut words stay."""
    text = unicodedata.normalize("NFKC", value).casefold().replace("_", " ")
    previous = None
    while previous != text:
        previous, text = text, re.sub(REMARK, " ", text)
    if re.fullmatch(r"\s*(?:\w\.\s*){2,}\s*", text):
        return re.sub(r"[^\w]", "", text)
    text = re.sub(r"(?<=\w)\.(?=\s+\w)", "", text)
    return " ".join(re.sub(r"[^\w]+", " ", text).replace("", ".").split())


def _grams(words: list[str]) -> list[str]:
    return [g for w in words for p in [f" {w} "] for n in (2, 3) for g in (p[i : i + n] for i in range(len(p) - n + 1))]


@F.pandas_udf(T.StringType())
def _normalised(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normalise(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _gram_list(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: _grams(list(ws)))


def _initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")


class Index:
    """Inverted n-gram index over a block of names ``(term, words, common)``, under the weights of the whole list."""

    def __init__(self, names: list[dict], idf: dict[str, float], rare: float):
        self.names, self.idf, self.rare = names, idf, rare
        gathered: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for i, n in enumerate(names):
            for g, w in self.vector(n["words"]).items():
                at, weights = gathered[g]
                at.append(i)
                weights.append(w)
        self.postings = {g: (np.array(at), np.array(w)) for g, (at, w) in gathered.items()}

    def vector(self, words: list[str]) -> dict[str, float]:
        """N-grams by occurrences times inverse document frequency, of length one; what no name has weighs as the rarest."""
        v = {g: k * self.idf.get(g, self.rare) for g, k in Counter(_grams(words)).items()}
        norm = float(np.sqrt(sum(x * x for x in v.values()))) or 1.0
        return {g: x / norm for g, x in v.items()}

    def _covered(self, i: int, grams: set[str]) -> tuple[float, float]:
        """(least, mean) weighted share of n-grams present, over the name's telling words; its last word may be left out."""
        name, idf = self.names[i], self.idf
        words, common = name["words"], set(name["common"])
        shares = [sum(idf[g] for g in gs if g in grams) / sum(idf[g] for g in gs) for w in words for gs in [_grams([w])]]
        telling = [s for w, s in zip(words, shares) if w not in common and len(w) > 2] or shares
        if len(words) >= 3 and words[-1] not in common and shares[-1] < 0.3 and min(shares[:-1]) >= 0.6:
            telling = shares[:-1]
        return min(telling), sum(telling) / len(telling)

    def best(self, words: list[str], least_score: float) -> list[tuple[float, int]]:
        """The best two entries as ``(score, -term)``, of the names that reach ``least_score`` and are covered."""
        by_term: dict[int, float] = {}
        for variant in [words] + [words[:-1]] * (len(words) > 1 and words[-1] in REMARK_TAIL):
            weights = self.vector(variant)
            score = np.zeros(len(self.names))
            for g, w in weights.items():
                if (found := self.postings.get(g)) is not None:
                    score[found[0]] += found[1] * w
            grams = set(weights)
            for i in np.flatnonzero(score >= least_score - 1e-9):
                least, mean = self._covered(int(i), grams)
                if mean >= 0.4 and least >= 0.28 or mean >= 0.55 and least >= 0.2:
                    term = self.names[i]["term"]
                    by_term[term] = max(by_term.get(term, 0.0), float(score[i]))
        return sorted(((s, -t) for t, s in by_term.items()), reverse=True)[:2]


def _scored(least_score: float):
    """Scores the values of a group against its block of names; rows without a term carry the weights."""
    schema = pa.schema([("kind", pa.string()), ("norm", pa.string()), ("top", pa.list_(pa.struct([("s", pa.float64()), ("t", pa.int64())])))])

    def run(key, block: pa.Table, values: pa.Table) -> pa.Table:
        rows = block.select(["term", "words", "common", "gram", "idf"]).to_pylist()
        idf = {r["gram"]: r["idf"] for r in rows if r["term"] is None}
        names = [r for r in rows if r["term"] is not None]
        index = Index(names, idf, idf.pop(RAREST, 0.0)) if names and values.num_rows else None
        out = []
        for v in values.select(["kind", "norm", "words"]).to_pylist() if index else ():
            if top := index.best(v["words"], least_score):
                out.append({"kind": v["kind"], "norm": v["norm"], "top": [{"s": s, "t": -t} for s, t in top]})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _completed(values: DataFrame, words: DataFrame) -> DataFrame:
    """``(kind, norm, words)``: words ended by a full stop become the only word of the list that begins with them."""
    prefixes = words.select("kind", "word", F.explode(F.sequence(F.lit(3), F.length("word"))).alias("n")).where("length(word) >= 3")
    prefixes = prefixes.groupBy("kind", F.expr("substring(word, 1, n)").alias("stem")).agg(F.min("word").alias("full"), F.count("*").alias("n")).where("n = 1").drop("n")
    split = values.withColumn("words", F.split("norm", " "))
    cut = split.where(F.col("norm").contains("."))
    each = cut.select("kind", "norm", F.posexplode("words").alias("pos", "word")).withColumn("stem", F.when(F.col("word").endswith("."), F.rtrim("word", F.lit("."))))
    full = each.join(prefixes, ["kind", "stem"], "left").groupBy("kind", "norm").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("full", "stem", "word").alias("w")))).alias("ws"))
    return split.where(~F.col("norm").contains(".")).unionByName(full.select("kind", "norm", F.transform("ws", lambda x: x["w"]).alias("words")))


def map_values(
    values: DataFrame, terms: DataFrame, value_col: str, kind_col: str, term_id: str, term_kind: str, names: list[str], threshold: float = 0.44, margin: float = 0.03
) -> DataFrame:
    """Adds ``term_id`` (0: no entry of that kind), ``score`` and ``lead`` to the rows of ``values``.

    Null and blank values get null in all three, values without an acceptable candidate score and lead 0. Repeated values
    cost one scoring; rows keep their other columns and their number. Entries without id, kind or any name, and kinds
    without entries, match nothing. Each group scores at most about ``VALUES`` values against one block of names.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = terms.select(F.col(term_kind).alias("kind"), F.col(term_id).cast("long").alias("term"), F.explode(F.array(*names)).alias("name"))
    listed = flat.where("kind is not null and term is not null and name is not null").withColumn("norm", F.translate(_normalised("name"), ".", "")).where("norm <> ''")
    listed = cut_lineage(listed.select("kind", "term", "norm").distinct())
    forms = listed.select("kind", "norm").distinct().withColumn("words", F.split("norm", " "))
    sizes = listed.groupBy("kind").agg(F.count("*").alias("n_names"))  # one row a kind
    grams = forms.select("kind", F.explode(F.array_distinct(_gram_list("words"))).alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("n"))
    grams = grams.join(F.broadcast(sizes), "kind").select("kind", "gram", F.log1p(F.col("n_names") / F.col("n")).alias("idf"))
    grams = grams.unionByName(sizes.select("kind", F.lit(RAREST).alias("gram"), F.log1p("n_names").alias("idf")))
    each = listed.select("kind", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    words = each.groupBy("kind", "word").count()
    common = each.join(words.where(F.col("count") >= COMMON), ["kind", "word"]).groupBy("kind", "norm").agg(F.collect_set("word").alias("common"))
    acronyms = listed.where(F.col("norm").contains(" ")).groupBy("kind", _initials(F.col("norm")).alias("short")).agg(F.min("term").alias("term"), F.max("term").alias("other"))
    acronyms = acronyms.where("term = other").drop("other")
    nothing = F.array().cast("array<string>")
    full = listed.join(common, ["kind", "norm"], "left").select("kind", "term", "norm", F.split("norm", " ").alias("words"), F.coalesce("common", nothing).alias("common"))

    distinct = values.select(F.col(kind_col).alias("kind"), F.col(value_col).alias("value")).where(F.col("value").rlike(r"\S")).distinct().repartition(parts)
    distinct = cut_lineage(distinct.withColumn("norm", _normalised("value")))
    bare = F.translate("norm", ".", "")
    asked = distinct.where(~bare.isin(*PLACEHOLDERS)).select("kind", "norm").distinct().withColumn("short", F.translate("norm", ". ", ""))
    told = asked.join(acronyms, ["kind", "short"], "left")
    by_acronym = told.where("term is not null").select("kind", "norm", F.col("term").alias("t"), F.lit(1.0).alias("s"), F.lit(1.0).alias("l"))
    open_ = _completed(told.where("term is null").select("kind", "norm"), words)

    # groups of one kind: blocks of names times groups of values, so both sides of a group are bounded
    n_blocks = F.ceil(F.col("n_names") / BLOCK).cast("int")
    n_values = asked.groupBy("kind").agg(F.count("*").alias("n_values"))
    plan = F.broadcast(sizes.join(n_values, "kind").select("kind", n_blocks.alias("blocks"), F.greatest(F.ceil(F.col("n_values") / VALUES), F.lit(1)).cast("int").alias("groups")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_names = full.join(plan, "kind").select("kind", F.pmod(F.xxhash64("norm", "term"), "blocks").cast("int").alias("block"), every("groups").alias("grp"), "term", "words", "common", F.lit(None).cast("string").alias("gram"), F.lit(None).cast("double").alias("idf"))
    # the weights go to every group: n-grams of letters are few beside the values' own, and so the values travel without theirs
    of_grams = grams.join(plan, "kind").select("kind", "groups", every("blocks").alias("block"), "gram", "idf").select("kind", "block", every("groups").alias("grp"), F.lit(None).cast("long").alias("term"), nothing.alias("words"), nothing.alias("common"), "gram", "idf")
    to_block = of_names.unionByName(of_grams)
    to_group = open_.join(plan, "kind").select("kind", every("blocks").alias("block"), F.pmod(F.xxhash64("norm"), "groups").cast("int").alias("grp"), "norm", "words")
    by = ["kind", "block", "grp"]
    top = to_block.groupBy(*by).cogroup(to_group.groupBy(*by)).applyInArrow(_scored(threshold - margin), "kind string, norm string, top array<struct<s:double,t:long>>")
    merged = top.select("kind", "norm", F.explode("top").alias("x")).groupBy("kind", "norm", F.col("x.t").alias("t")).agg(F.max("x.s").alias("s"))
    # at most two entries a block and value, kept best first, equal scores by smaller id
    merged = merged.groupBy("kind", "norm").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", (-F.col("t")).alias("t"))), asc=False), 1, 2).alias("a"))
    scored = merged.select("kind", "norm", (-F.col("a")[0]["t"]).alias("t"), F.col("a")[0]["s"].alias("s"), (F.col("a")[0]["s"] - F.coalesce(F.get("a", F.lit(1))["s"], F.lit(0.0))).alias("l"))
    scored = scored.unionByName(by_acronym)
    good = (F.col("s") >= threshold) & (F.col("l") >= margin)
    mapped = distinct.join(scored, ["kind", "norm"], "left").select(
        F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.when(good, F.col("t")).otherwise(0).alias("term_id"), F.coalesce("s", F.lit(0.0)).alias("score"), F.coalesce("l", F.lit(0.0)).alias("lead")
    )
    kept = values.drop("term_id", "score", "lead")
    return kept.join(mapped, kept[kind_col].eqNullSafe(F.col("__kind")) & (kept[value_col] == F.col("__value")), "left").drop("__kind", "__value")
