"""Changes of the persistent relations over parquet, as new snapshots.

Plain parquet has no merge, so an upsert is a full outer join into a new snapshot; chunks lie in buckets by paper, so
that replacing papers' chunks overwrites their buckets only. A snapshot is written beside the old one and swapped in;
a path that is read is never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from ..schema import STATUSES


def upsert_papers(papers: DataFrame, metas: DataFrame, now: Column | None = None) -> DataFrame:
    """Papers after library rows ``(citekey, title, authors, year, venue, doi, pdf_path)`` arrived.

    Metadata is always refreshed; the state moves to METADATA_OK only from PENDING and FAILED, which clears the
    reason. New papers get ids above the largest; of rows with one citekey the first by title counts.
    """
    now = now if now is not None else F.current_timestamp()
    cols = ["title", "authors", "year", "venue", "doi", "pdf_path"]
    new = metas.groupBy("citekey").agg(F.min(F.struct(*cols)).alias("m")).select("citekey", *(F.col(f"m.{c}").alias(f"n_{c}") for c in cols))
    joined = papers.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), "citekey", "full_outer")
    touched, fresh = F.col("__new").isNotNull(), F.col("__old").isNull()
    moves = touched & (fresh | F.col("status").isin("PENDING", "FAILED"))
    top = papers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    merged = joined.select(
        "id", "citekey", fresh.alias("__fresh"),
        F.when(touched, F.col("n_doi")).otherwise(F.col("doi")).alias("doi"),
        F.when(touched, F.coalesce("n_title", "citekey")).otherwise(F.col("title")).alias("title"),
        F.when(touched, F.coalesce("n_authors", F.lit(""))).otherwise(F.col("authors")).alias("authors"),
        F.when(touched, F.col("n_year")).otherwise(F.col("year")).alias("year"),
        F.when(touched, F.col("n_venue")).otherwise(F.col("venue")).alias("venue"),
        F.when(touched, F.col("n_pdf_path")).otherwise(F.col("pdf_path")).alias("pdf_path"),
        F.when(moves, "METADATA_OK").otherwise(F.col("status")).alias("status"),
        F.when(~moves, F.col("failure_reason")).alias("failure_reason"),
        F.coalesce("created_at", now).alias("created_at"), F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    old = merged.where(~F.col("__fresh")).drop("__fresh")
    numbered = merged.where("__fresh").drop("__fresh", "id")
    keys = numbered.select("citekey").distinct()
    ids = with_ids(keys, "citekey").join(F.broadcast(top)).select("citekey", (F.col("rn") + F.col("top")).alias("id"))  # top is one row
    return old.unionByName(numbered.join(ids, "citekey").select(*old.columns))


def with_ids(keys: DataFrame, key: str) -> DataFrame:
    """``(key, rn)``: 1 to n in key order; numbered within ranges, offset by the counts of the ranges before."""
    from pyspark.sql import Window

    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written once: counts and numbers must see the same ranges
    ranged = cut_lineage(keys.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    within = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return within.join(F.broadcast(before.select("part", "before")), "part").select(key, (F.col("r") + F.col("before")).alias("rn"))


def upsert_extractions(extractions: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row a paper: a fresh row replaces the whole old one but keeps its id; null constructs become an empty list."""
    cols = [c for c in extractions.columns if c not in ("id", "paper_id")]
    latest = fresh.groupBy("paper_id").agg(F.max(F.struct("extracted_at", *[c for c in cols if c != "extracted_at"])).alias("n"))
    joined = extractions.join(latest, "paper_id", "full_outer")

    def pick(c: str) -> Column:
        value = F.col(f"n.{c}")
        return F.when(F.col("n").isNotNull(), F.coalesce(value, F.array().cast("array<string>")) if c == "constructs" else value).otherwise(F.col(c)).alias(c)

    return joined.select("id", "paper_id", *(pick(c) for c in cols)).select(*extractions.columns)


def set_status(papers: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Papers after stage outcomes ``(id, status, error)``: an error makes FAILED with its text, any other state clears the reason."""
    now = now if now is not None else F.current_timestamp()
    out = outcomes.groupBy("id").agg(F.max(F.struct(F.col("error").isNotNull().alias("bad"), F.col("error"), F.col("status").alias("to"))).alias("o"))
    joined = papers.join(out, "id", "left")
    moved = F.col("o").isNotNull()
    to = F.when(F.col("o.bad"), "FAILED").otherwise(F.col("o.to"))
    checked = F.when(to.isin(*STATUSES), to).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce(to, F.lit("null")))).cast("string"))
    return joined.withColumns(
        {
            "status": F.when(moved, checked).otherwise(F.col("status")),
            "failure_reason": F.when(moved, F.col("o.error")).otherwise(F.col("failure_reason")),
            "updated_at": F.when(moved, now).otherwise(F.col("updated_at")),
        }
    ).select(*papers.columns)


def pending(papers: DataFrame, force: bool = False) -> DataFrame:
    """Papers an ingest run has to work on: all but EMBEDDED and EXTRACTED ones, or all."""
    return papers if force else papers.where(~F.col("status").isin("EMBEDDED", "EXTRACTED"))


def review(contradictions: DataFrame, finding_id: int, verdict: str) -> DataFrame:
    """Findings with one reviewed; an unknown id is an error."""
    if not contradictions.where(F.col("id") == finding_id).limit(1).count():
        raise KeyError(f"no finding {finding_id}")
    here = F.col("id") == finding_id
    return contradictions.withColumns({"reviewed": F.when(here, True).otherwise(F.col("reviewed")), "verdict": F.when(here, F.lit(verdict)).otherwise(F.col("verdict"))})


#: Folders a chunk table is spread over by paper.
BUCKETS = 256


def _bucket(paper: Column | str = "paper_id") -> Column:
    return F.pmod(F.xxhash64(paper), F.lit(BUCKETS)).cast("int")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_chunks(chunks: DataFrame, path: str, emptied: list[int] | None = None) -> None:
    """Writes the chunks of the papers in ``chunks`` in place of their old ones; papers in ``emptied`` lose theirs.

    The table lies in at most ``BUCKETS`` folders by hash of the paper; those of the papers concerned are written anew,
    the others stay untouched. An empty vector is an error.
    """
    spark = chunks.sparkSession
    size = F.when(F.col("embedding").isNotNull() & (F.size("embedding") == 0), F.raise_error(F.lit("empty vector")).cast("array<float>")).otherwise(F.col("embedding"))
    fresh = cut_lineage(chunks.withColumns({"embedding": size, "bucket": _bucket()}))
    gone = spark.createDataFrame([(x,) for x in emptied or []], "paper_id long").withColumn("bucket", _bucket())
    papers = cut_lineage(fresh.select(F.col("paper_id").cast("long").alias("paper_id"), "bucket").distinct().unionByName(gone))
    touched = {r.bucket for r in papers.select("bucket").distinct().collect()}  # at most BUCKETS
    where, system = _path(spark, path)
    rows = fresh
    if touched and system.exists(where):
        old = spark.read.parquet(path).where(F.col("bucket").isin(sorted(touched)))
        rows = fresh.unionByName(cut_lineage(old.join(papers.select("paper_id").distinct(), "paper_id", "left_anti").select(*fresh.columns)))
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for bucket in touched - left:  # buckets that hold nothing any more
        system.delete(_path(spark, f"{path}/bucket={bucket}")[0], True)


def append(rows: DataFrame, path: str) -> bool:
    """Appends log rows; a failure to do so is told, not raised."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001 - the log must not stop the work it logs
        return False
    return True


def write_snapshot(df: DataFrame, root: str) -> str:
    """Writes a table's new snapshot under ``root`` and makes it the current one; returns its path.

    What is current stands in one small file that is renamed into its place, so a reader finds the old or the new one.
    """
    spark = df.sparkSession
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    (now, system), (place, _) = _path(spark, f"{root}/.next-{uuid.uuid4().hex}"), _path(spark, f"{root}/current")
    out = system.create(now)
    out.write(bytearray(path.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri()).rename(system.makeQualified(now), system.makeQualified(place), options)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{root}/current").first()[0])


def status_histogram(papers: DataFrame) -> DataFrame:
    """``(status, papers)`` of all states, those without papers too."""
    states = papers.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "pos int, status string")
    counts = papers.groupBy("status").agg(F.count("*").alias("papers"))
    return states.join(counts, "status", "left").select("pos", "status", F.coalesce("papers", F.lit(0)).alias("papers"))


def failures(papers: DataFrame) -> DataFrame:
    return papers.where("status = 'FAILED'").select("citekey", "title", F.col("failure_reason").alias("reason"))


def calls(log: DataFrame, call_type: str | None = None, paper_id: int | None = None) -> DataFrame:
    """Rows of the call log of one type or paper, or all."""
    for column, wanted in (("call_type", call_type), ("paper_id", paper_id)):
        if wanted is not None:
            log = log.where(F.col(column) == wanted)
    return log


def calls_by_type(log: DataFrame) -> DataFrame:
    """``(call_type, success, calls, papers)``."""
    return log.groupBy("call_type", "success").agg(F.count("*").alias("calls"), F.count_distinct("paper_id").alias("papers"))


def with_year(papers: DataFrame) -> DataFrame:
    """Papers that a chart over years can show."""
    return papers.where("year is not null")


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """``(failed, papers, citekeys)`` of ``(id, citekey, failed)``: counts, and the citekeys of the failed ones by id."""
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("id", "citekey")))), lambda x: x["citekey"])
    return outcomes.groupBy("failed").agg(F.count("*").alias("papers"), keys.alias("citekeys"))
