"""The whole pipeline over one folder of tables: ingest, search, extraction, synthesis.

``Engine`` keeps each relation as a snapshot under its root (chunks lie in buckets by paper) and offers what a user does
with the corpus, one method each. Outside services (document parser, embedder, language model) are plain callables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import DEFAULT, Config
from .functions.text import embedding_text, non_blank
from .operators import chunking, coverage, evidence, library, retrieval, search_index, store, synthesis
from .runtime import cut_lineage
from .sources import bibtex, clients, files, tei

TABLES = {
    "paper": schema.PAPER, "chunk": schema.CHUNK, "extraction": schema.EXTRACTION, "contradiction": schema.CONTRADICTION,
    "future_work_cluster": schema.FUTURE_WORK_CLUSTER, "api_call_log": schema.API_CALL_LOG,
}


@dataclass
class Engine:
    spark: SparkSession
    root: str
    embed: Callable[[list[str]], list[list[float]]] = clients.hashing_embedder
    chat: Callable[[object], str] | None = None
    model: str = "none"
    config: Config = field(default_factory=lambda: DEFAULT)

    # ---- tables -----------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """The current snapshot of a relation; empty before its first write."""
        path = f"{self.root}/{name}"
        if name == "chunk":
            if not self._there(path):
                return self.spark.createDataFrame([], schema.CHUNK)
            rows = self.spark.read.schema(schema.CHUNK).parquet(path)
            return rows.withColumn("id", F.xxhash64("paper_id", "ordinal"))
        if not self._there(f"{path}/current"):
            return self.spark.createDataFrame([], TABLES[name])
        return store.read_snapshot(self.spark, path)

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, name: str, rows: DataFrame) -> None:
        store.write_snapshot(rows.select(*TABLES[name].names), f"{self.root}/{name}")

    def _log(self, call_type: str, calls: DataFrame) -> None:
        """One row a call; ``calls(paper_id, error, tokens_in, tokens_out)``."""
        rows = calls.select(
            F.lit(None).cast("long").alias("id"), "paper_id", F.lit(call_type).alias("call_type"), F.lit(self.model).alias("model"), F.col("tokens_in").cast("int").alias("tokens_in"),
            F.col("tokens_out").cast("int").alias("tokens_out"), F.lit(None).cast("decimal(10,6)").alias("cost_usd"), F.col("error").isNull().alias("success"), F.col("error").alias("error_message"), F.current_timestamp().alias("called_at"),
        )
        store.append(rows, f"{self.root}/api_call_log_rows")

    def _log_one(self, call_type: str, error: str | None, tokens: tuple[int | None, int | None] = (None, None)) -> None:
        self._log(call_type, self.spark.createDataFrame([(None, error, *tokens)], "paper_id long, error string, tokens_in int, tokens_out int"))

    def call_log(self, call_type: str | None = None, paper_id: int | None = None) -> DataFrame:
        """Calls of outside services, of one type or paper or all."""
        path = f"{self.root}/api_call_log_rows"
        log = self.spark.read.parquet(path) if self._there(path) else self.spark.createDataFrame([], schema.API_CALL_LOG)
        return store.calls(log, call_type, paper_id)

    # ---- ingest -----------------------------------------------------------------------------------------------------

    def load_library(self, bib: str, pdf_root: str) -> tuple[DataFrame, DataFrame]:
        """(resolved library rows, report) of a bibliography and a folder of files."""
        entries = bibtex.read_bibtex(self.spark, files.resolve(bib))
        order = entries.groupBy("citekey").agg(F.min("pos").alias("pos"))
        metas = library.entries_to_meta(entries).join(order, "citekey")
        found = library.claim_files(metas, files.list_files(self.spark, pdf_root), self.config)
        resolved = cut_lineage(metas.drop("pdf_path").join(found.select("citekey", "pdf_path"), "citekey", "left").withColumn("readable", files.readable(F.col("pdf_path"))))
        return resolved.drop("readable"), library.report(resolved, "pos", F.col("readable"))

    def library_report(self, bib: str, pdf_root: str) -> DataFrame:
        """``(part, at, line)``: what a bibliography and a folder hold and lack, as text."""
        resolved, report = self.load_library(bib, pdf_root)
        listed = files.list_files(self.spark, pdf_root)
        return library.report_lines(report, "pos", library.unclaimed(listed, resolved))

    def ingest_run(self, bib: str, pdf_root: str, parse: Callable[[bytes], str], force: bool = False, only: str | None = None) -> dict:
        """Brings the library in: metadata, parsed texts (cached by content), chunks with vectors.

        Papers pass through the states GROBID_OK, CHUNKED and EMBEDDED; an error at any step makes FAILED. Connection
        errors of the parser are tried again. Returns counts and, as a DataFrame, the failed citekeys by id.
        """
        resolved, report = self.load_library(bib, pdf_root)
        valid = resolved.join(report.where("valid").select("citekey"), "citekey", "left_semi")
        if only is not None:
            valid = valid.where(F.col("citekey") == only)
            if not valid.limit(1).count():
                raise KeyError(f"no ingestable entry {only}")
        merged = cut_lineage(store.upsert_papers(self.table("paper"), valid))
        work = store.pending(merged, force).join(valid.select("citekey"), "citekey", "left_semi").where("pdf_path is not null")
        parsed = self._parsed(work, pdf_root, parse)
        documents = cut_lineage(parsed.select("id", tei.parsed(F.col("tei")).alias("d"), "error").select("id", F.coalesce("error", "d.error").alias("error"), "d.abstract", "d.sections"))
        paragraphs = tei.paragraph_rows(documents.where("error is null").withColumnRenamed("id", "paper_id"), "paper_id").withColumn("para_id", F.lit(0).cast("long"))
        sizes = documents.select("id", F.coalesce(F.size("sections") == 0, F.lit(True)).alias("none"), F.length(F.array_join(F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: p["text"]))), "\n\n")).alias("n"))
        empty = sizes.where(F.col("none") | (F.col("n") < self.config.empty_document_chars)).select("id", F.lit("document looks empty").alias("why"))
        outcome = cut_lineage(documents.join(empty, "id", "left").select("id", F.lit("GROBID_OK").alias("status"), F.coalesce("error", "why").alias("error")))
        papers = self._advance(merged, outcome)
        good = outcome.where("error is null").select(F.col("id").alias("paper_id"))
        abstracts = documents.select(F.col("id").alias("paper_id"), "abstract")
        chunks = cut_lineage(chunking.chunk_documents(chunking.sections_of(paragraphs), abstracts, self.config.chunking).join(good, "paper_id", "left_semi"))
        through = good.select(F.col("paper_id").alias("id"), F.lit("CHUNKED").alias("status"), F.lit(None).cast("string").alias("error"))
        papers = self._advance(papers, through)
        vectors = clients.embedded(embedding_text("section", "content"), self.embed, self.config.embedding_dim)
        full = chunks.withColumns({"embedding": vectors, "created_at": F.current_timestamp(), "id": F.xxhash64("paper_id", "ordinal")})
        why = None
        try:
            store.replace_chunks(full.select(*schema.CHUNK.names), f"{self.root}/chunk")
        except PySparkException as e:  # vectors are made for all papers together, so all fail with them
            why = f"embedding failed: {str(e).strip().splitlines()[-1][:300]}"
        papers = self._advance(papers, through.withColumns({"status": F.lit("EMBEDDED"), "error": F.lit(why)}))
        failed = papers.join(outcome.select("id"), "id", "left_semi").where("status = 'FAILED'")
        counts = outcome.join(papers.select("id", F.col("status").alias("now")), "id").groupBy("now").count().collect()  # two states
        by = {r.now: r["count"] for r in counts}
        return {"ingested": by.get("EMBEDDED", 0), "failed": by.get("FAILED", 0), "failed_citekeys": failed.orderBy("id").select("citekey"), "invalid": report.where("not valid").count()}

    def _advance(self, papers: DataFrame, outcome: DataFrame) -> DataFrame:
        """Papers after a step, saved."""
        moved = cut_lineage(store.set_status(papers, outcome))
        self.save("paper", moved)
        return moved

    @staticmethod
    def describe(ran: dict) -> str:
        """A run's outcome as text for people; names at most twenty of the failed papers and says if there are more."""
        some = [r.citekey for r in ran["failed_citekeys"].limit(20).collect()]
        named = f" ({', '.join(some)}{', and others' if ran['failed'] > len(some) else ''})" if some else ""
        return f"Ingest: {ran['ingested']} ingested, {ran['failed']} failed{named}, {ran['invalid']} rejected"

    def _parsed(self, work: DataFrame, pdf_root: str, parse: Callable[[bytes], str]) -> DataFrame:
        """``(id, tei, error)``: from the cache where the bytes were parsed before, else by the parser."""
        path = f"{self.root}/tei_cache"
        cache = self.spark.read.parquet(path) if self._there(path) else self.spark.createDataFrame([], "sha string, tei string")
        paths = work.select("id", F.col("pdf_path").alias("path"))
        content = files.read_bytes(self.spark, pdf_root, only=paths)
        # of a file only its hash travels: the bytes of what the cache lacks are read again where they are parsed
        wanted = cut_lineage(paths.join(content.select("path", "sha"), "path"))
        hits, misses = files.cached(wanted, cache)
        first = misses.groupBy("sha").agg(F.min("path").alias("path"))
        unread = files.read_bytes(self.spark, pdf_root, only=first)
        fresh = cut_lineage(clients.call_rows(unread.dropDuplicates(["sha"]) if "://" in pdf_root.removeprefix("file://") else unread, "sha", "content", clients.with_retries(parse, pause=self.config.retry_pause), "tei"))
        store.append(fresh.where("error is null").select("sha", "tei"), path)
        told = misses.select("id", "sha").join(fresh, "sha").select("id", "tei", "error")
        return hits.select("id", "tei", F.lit(None).cast("string").alias("error")).unionByName(told)

    def reingest(self, citekey: str, bib: str, pdf_root: str, parse: Callable[[bytes], str], force: bool = True) -> dict:
        return self.ingest_run(bib, pdf_root, parse, force, only=citekey)

    def ingest_status(self) -> dict:
        by = {r.status: r.papers for r in store.status_histogram(self.table("paper")).collect()}  # seven rows
        return {"by_status": by, "total": sum(by.values()), "failed": by["FAILED"]}

    def failures(self) -> DataFrame:
        return store.failures(self.table("paper"))

    # ---- search -----------------------------------------------------------------------------------------------------

    def search(self, query: str, top_k: int | None = None, sections: list[str] | None = None, paper_ids: list[int] | None = None) -> DataFrame:
        vector = self.embed([query or ""])[0]
        hits = retrieval.hybrid_search(self.table("chunk"), query, vector, top_k, sections, paper_ids, self.config.search)
        return retrieval.hydrate(hits, self.table("chunk"), self.table("paper"))

    def build_indexes(self) -> None:
        """Stores the search indexes of the chunks as they are now, for ``search_indexed``."""
        search_index.write_text_index(self.table("chunk"), f"{self.root}/index/text")
        search_index.write_vector_index(self.table("chunk"), f"{self.root}/index/vector")

    def search_indexed(self, query: str, top_k: int | None = None, probes: int = 16) -> DataFrame:
        """``search`` over all chunks by the stored indexes, which are read in part; chunks that came later aren't found."""
        hits = search_index.indexed_search(self.spark, f"{self.root}/index", self.table("chunk"), query, self.embed([query or ""])[0], top_k, self.config.search, probes)
        return retrieval.hydrate(hits, self.table("chunk"), self.table("paper"))

    def steelman(self, gap: str) -> dict:
        """The strongest counter-argument to a claimed gap, with the citekeys of the passages it rests on."""
        if not gap or not gap.strip():
            raise ValueError("the gap is blank")
        hits = cut_lineage(self.search(gap, self.config.search.steelman_top_k))
        row = retrieval.evidence_block(hits).first()
        try:
            answer = clients.steelman(row.evidence if row else "", gap, clients.under(clients.SYNTHESIS_POLICY, self._need_chat()))
        except Exception as e:
            self._log_one("steelman", str(e) or type(e).__name__)
            raise
        self._log_one("steelman", None, answer.pop("tokens"))
        return answer | {"gap": gap, "citekeys": sorted({r.citekey for r in hits.select("citekey").collect()})}  # at most top_k rows

    def _need_chat(self) -> Callable[[object], str]:
        if self.chat is None:
            raise RuntimeError("no language model is configured")
        return self.chat

    # ---- extraction -------------------------------------------------------------------------------------------------

    def extract_pending(self, citekey: str | None = None) -> int:
        """Extracts the concepts of all EMBEDDED papers, or of one paper in any state; returns how many succeeded."""
        papers = self.table("paper")
        work = papers.where(F.col("citekey") == citekey) if citekey is not None else papers.where("status = 'EMBEDDED'")
        texts = evidence.evidence(evidence.section_bodies(self.table("chunk")), self.config.synthesis.evidence_budget_chars).join(work.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
        prompts = evidence.extraction_prompts(texts, papers)
        answers = cut_lineage(clients.extract_concepts(prompts, clients.under(clients.EXTRACTION_POLICY, self._need_chat()), self.model))
        good = answers.where("error is null").drop("error", "tokens_in", "tokens_out").withColumn("extracted_at", F.current_timestamp())
        merged = store.upsert_extractions(self.table("extraction"), good)
        fresh = merged.where("id is null").select("paper_id").distinct()
        top = merged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
        ids = store.with_ids(fresh, "paper_id").select("paper_id", (F.col("rn") + top).alias("new_id"))
        self.save("extraction", merged.join(ids, "paper_id", "left").withColumn("id", F.coalesce("id", "new_id")))
        self.save("paper", store.set_status(papers, answers.select(F.col("paper_id").alias("id"), F.lit("EXTRACTED").alias("status"), "error")))
        self._log("extraction", answers)
        return answers.where("error is null").count()

    def extraction(self, citekey: str) -> DataFrame:
        return synthesis.with_citekeys(self.table("extraction"), self.table("paper").where(F.col("citekey") == citekey))

    def extractions(self, construct: str | None = None) -> DataFrame:
        rows = self.table("extraction")
        return rows if construct is None else synthesis.naming(rows, [construct])

    # ---- synthesis --------------------------------------------------------------------------------------------------

    def find_contradictions(self) -> DataFrame:
        """Asks the model for conflicting findings of every construct group, keeps the sound and new ones, returns those."""
        groups = cut_lineage(synthesis.construct_groups(self.table("extraction"), self.config.synthesis.min_papers_per_construct))
        papers = self.table("paper").select("id", "citekey")
        answers = cut_lineage(clients.call_rows(synthesis.findings_prompt(groups, self.table("paper")), "construct", "prompt", clients.under(clients.SYNTHESIS_POLICY, self._need_chat())))
        pair = "array<struct<paper_a:string,claim_a:string,paper_b:string,claim_b:string,possible_moderator:string>>"
        told = answers.select("construct", F.posexplode(F.from_json("answer", pair)).alias("k", "p")).select("construct", "k", "p.*")
        a, b = (papers.withColumnsRenamed({"id": f"paper_{x}_id", "citekey": f"paper_{x}"}) for x in "ab")
        reported = told.join(a, "paper_a").join(b, "paper_b").withColumn("pos", F.struct("construct", "k"))
        existing = self.table("contradiction")
        fresh = synthesis.guarded_findings(reported.select("pos", "construct", "paper_a_id", "claim_a", "paper_b_id", "claim_b", "possible_moderator"), groups, existing)
        top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
        ids = store.with_ids(fresh.select("pair_key"), "pair_key").select("pair_key", (F.col("rn") + top).alias("id"))
        new = cut_lineage(fresh.join(ids, "pair_key").withColumns({"reviewed": F.lit(False), "verdict": F.lit(None).cast("string"), "created_at": F.current_timestamp()}).select(*schema.CONTRADICTION.names))
        self.save("contradiction", existing.unionByName(new))
        self._log("contradiction", answers.select(F.lit(None).cast("long").alias("paper_id"), "error", F.lit(None).cast("int").alias("tokens_in"), F.lit(None).cast("int").alias("tokens_out")))
        return synthesis.contradiction_rows(new, self.table("paper"))

    def contradictions(self, unreviewed: bool = False, construct: str | None = None) -> DataFrame:
        """Findings, all or those not reviewed, of one construct in any letter case or of all."""
        rows = synthesis.on_construct(self.table("contradiction"), construct)
        return synthesis.contradiction_rows(rows.where("not reviewed") if unreviewed else rows, self.table("paper"))

    def review(self, finding_id: int, verdict: str) -> None:
        self.save("contradiction", store.review(self.table("contradiction"), finding_id, verdict))

    def mine_future_work(self) -> DataFrame:
        """Rebuilds the clusters of future-work statements; too few statements leave none."""
        e = self.table("extraction").where(non_blank("future_work_suggested"))
        vectors = clients.embedded(F.col("future_work_suggested"), self.embed, self.config.embedding_dim)
        told = e.select(F.col("id").alias("pos"), "paper_id", F.col("future_work_suggested").alias("statement"), vectors.alias("vector"))
        found = synthesis.future_work_clusters(told, self.config.synthesis.future_work_similarity, self.config.synthesis.min_papers_per_construct)
        self.save("future_work_cluster", found.withColumns({"id": F.col("cluster").cast("long"), "created_at": F.current_timestamp()}))
        return self.future_work()

    def future_work(self) -> DataFrame:
        return synthesis.cluster_citekeys(self.table("future_work_cluster").withColumnRenamed("id", "cluster"), self.table("paper"))

    def gap_grid(self) -> DataFrame:
        return coverage.gap_grid(self.table("chunk"), self.table("paper"), coverage.distinct_constructs(self.table("extraction")))

    def uncovered(self) -> DataFrame:
        return coverage.uncovered(self.gap_grid())

    def asserted_but_untested(self) -> DataFrame:
        return coverage.asserted_but_untested(self.gap_grid())
