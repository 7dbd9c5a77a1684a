"""Problem 7 - fill containers of fixed capacity with items, leaving little unused space.

Items enter the plan only as counts by length, a table of at most ``capacity`` rows. On it the driver computes a
packing plan: exact-complement hashing first (a length and its single, pair or triple complement that fill a container
exactly, taken as often as the counts allow), then best fit for what is left. A plan step says "n containers of this
combination of lengths"; each step uses up at least one length or ends the residue, so the plan is bounded by the
capacity as well. Items are then numbered within their length and find their container by arithmetic.

Items longer than the capacity are split into full containers and a rest; no other item is split.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: The pattern by which the byte-level tokenizer cuts text before merging (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LOADED: dict[str, object] = {}


def tokenizer(vocabulary: str):
    """The tokenizer of a rank file, loaded once per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text; 0 for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = tokenizer(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count.asNondeterministic()(text)  # else a filter on the count would tokenize twice


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Steps ``(containers, {length: items in each})`` that use every counted item once."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    steps: list[tuple[int, dict[int, int]]] = []

    def take(combo: dict[int, int]) -> bool:
        n = min(left[x] // k for x, k in combo.items())
        if n <= 0:
            return False
        for x, k in combo.items():
            left[x] -= n * k
            if not left[x]:
                del left[x]
        steps.append((n, combo))
        return True

    if capacity in left:
        take({capacity: 1})
    for a in sorted(left, reverse=True):
        while left.get(a):
            gap, found = capacity - a, False
            if gap in left and take(dict(Counter([a, gap]))):
                continue
            lengths = sorted(x for x in left if x <= gap)
            present = set(lengths)
            for b in reversed(lengths):  # pairs, then triples: the largest member first, so that small items stay for gaps
                if b * 2 < gap:
                    break
                if gap - b in present and take(dict(Counter([a, b, gap - b]))):
                    found = True
                    break
            if found:
                continue
            for b in reversed(lengths):
                if b * 3 < gap:
                    break
                rest = gap - b
                for c in lengths[: bisect_left(lengths, min(b, rest) + 1)][::-1]:
                    if c * 2 < rest:
                        break
                    if rest - c in present and take(dict(Counter([a, b, c, rest - c]))):
                        found = True
                        break
                if found:
                    break
            if not found:
                break
    # best fit of the residue, longest first: open containers by free space
    open_by_free: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
    free_sizes: list[int] = []

    def put(free: int, n: int, combo: Counter) -> None:
        if n > 0:
            if not open_by_free[free]:
                heapq.heappush(free_sizes, free)
            open_by_free[free].append((n, combo))

    for a in sorted(left, reverse=True):
        todo = left[a]
        while todo:
            fits = [f for f in free_sizes if f >= a and open_by_free[f]]
            if fits:
                free = min(fits)
                n, combo = open_by_free[free].pop()
                if not open_by_free[free]:
                    free_sizes.remove(free)
                    heapq.heapify(free_sizes)
                used = min(n, todo)
                put(free, n - used, combo)
                put(free - a, used, combo + Counter([a]))
                todo -= used
            else:
                each = max(1, capacity // a)
                full, rest = divmod(todo, each)
                put(capacity - a * each, full, Counter({a: each}))
                if rest:
                    put(capacity - a * rest, 1, Counter({a: rest}))
                todo = 0
    steps += [(n, dict(combo)) for groups in open_by_free.values() for n, combo in groups]
    return steps


def fill_containers(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY, buckets: int | None = None) -> DataFrame:
    """``(id, part, token_start, tokens, container, slot)``: every token of every non-blank text placed once.

    ``part`` numbers the parts of a split item from 0, ``slot`` orders the items of a container by length. Null and
    blank texts take no part; rows repeated in the input are items of their own. Numbering works by length and hash
    bucket (default: four per shuffle partition), so that a length that a third of all items share is spread.
    """
    spark = df.sparkSession
    real = df.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(
        F.col(id_col).alias("id"), token_count(F.col(text_col), vocabulary).alias("n"), F.xxhash64(text_col).alias("x")
    )
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")), lambda i: F.struct(
        i.alias("part"), (i * capacity).cast("long").alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("n") - i * capacity).alias("tokens")))
    b = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = real.where("n > 0").select("id", "x", F.explode(parts).alias("p")).select("id", "p.*", F.pmod(F.xxhash64("id", "p.part", "x"), F.lit(b)).alias("bucket"))
    items = cut_lineage(items)
    cells = items.groupBy("tokens", "bucket").count()
    offsets = cells.withColumn("before", F.sum("count").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = cut_lineage(offsets.select("tokens", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "count"))
    counts = {r.tokens: r.n for r in offsets.groupBy("tokens").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    slots, container, used = [], 0, Counter()
    for n, combo in plan_containers(counts, capacity):
        for i, (length, k) in enumerate(sorted(combo.items(), reverse=True)):
            slots.append((length, used[length], used[length] + n * k, container, k, i))
            used[length] += n * k
        container += n
    schema = "tokens long, first long, stop long, base long, each long, place int"
    runs = spark.createDataFrame(slots, schema).groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "base", "each", "place"))).alias("runs"))
    numbered = (
        items.withColumn("r", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "part")) - 1)
        .join(offsets.select("tokens", "bucket", "before"), ["tokens", "bucket"])
        .withColumn("rank", F.col("before") + F.col("r"))
    )
    run = F.filter("runs", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["stop"]))[0]
    placed = numbered.join(F.broadcast(runs), "tokens").withColumn("s", run)  # one row per length, bounded by the plan
    within = F.col("rank") - F.col("s.first")
    return placed.select(
        "id", "part", "token_start", "tokens",
        (F.col("s.base") + F.floor(within / F.col("s.each"))).alias("container"),
        (F.col("s.place") * capacity + within % F.col("s.each")).cast("long").alias("slot"),
    )
