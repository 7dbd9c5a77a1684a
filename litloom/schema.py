"""Declared schemas of the persistent relations, their enumerations and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, in order: the ingest states and the canonical section slots.
STATUSES = ("PENDING", "METADATA_OK", "GROBID_OK", "CHUNKED", "EMBEDDED", "EXTRACTED", "FAILED")
SECTIONS = ("ABSTRACT", "INTRODUCTION", "RELATED_WORK", "THEORY", "METHOD", "RESULTS", "DISCUSSION", "LIMITATIONS", "FUTURE_WORK", "CONCLUSION", "OTHER")
#: Slots of the coverage grid.
GRID_SECTIONS = tuple(s for s in SECTIONS if s not in ("ABSTRACT", "OTHER"))
#: Slots in descending value as evidence.
EVIDENCE_ORDER = ("ABSTRACT", "METHOD", "RESULTS", "DISCUSSION", "LIMITATIONS", "FUTURE_WORK", "CONCLUSION", "INTRODUCTION", "THEORY", "RELATED_WORK", "OTHER")


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "decimal": T.DecimalType(10, 6),
    "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()), "array<bigint>": T.ArrayType(T.LongType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from "name type [not null], ..."; unlike Spark's own parser it needs no session."""
    fields = [part.split(maxsplit=2) for part in text.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


PAPER = _schema(
    "id bigint, citekey string not null, doi string, title string not null, authors string not null, year int, venue string, "
    "pdf_path string, status string not null, failure_reason string, created_at timestamp not null, updated_at timestamp not null"
)
CHUNK = _schema(
    "id bigint, paper_id bigint not null, section string, canonical_section string, ordinal int not null, page int, "
    "content string not null, embedding array<float>, created_at timestamp not null"
)
EXTRACTION = _schema(
    "id bigint, paper_id bigint not null, research_question string, theoretical_lens string, method string, constructs array<string>, key_finding string, "
    "stated_limitation string, future_work_suggested string, context_sector string, supporting_quote string, quote_page string, model_used string, extracted_at timestamp not null"
)
CONTRADICTION = _schema(
    "id bigint, construct string not null, paper_a_id bigint not null, claim_a string not null, paper_b_id bigint not null, claim_b string not null, "
    "possible_moderator string, reviewed boolean not null, verdict string, created_at timestamp not null"
)
FUTURE_WORK_CLUSTER = _schema("id bigint, theme string not null, paper_ids array<bigint> not null, paper_count int not null, created_at timestamp not null")
API_CALL_LOG = _schema(
    "id bigint, paper_id bigint, call_type string not null, model string not null, tokens_in int, tokens_out int, cost_usd decimal, "
    "success boolean not null, error_message string, called_at timestamp not null"
)
PAPER_META = _schema("citekey string, entry_type string, title string, authors string, year int, venue string, doi string, abstract string, declared_file string, pdf_path string")

#: Foreign keys: table -> [(column, parent, on delete)].
REFERENCES = {
    "chunk": [("paper_id", "paper", "cascade")],
    "extraction": [("paper_id", "paper", "cascade")],
    "contradiction": [("paper_a_id", "paper", "restrict"), ("paper_b_id", "paper", "restrict")],
    "api_call_log": [("paper_id", "paper", "set null")],
}


def violations(df: DataFrame, schema: T.StructType, enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(rule, rows)``: rows that break a not-null or enumeration rule; rules nobody breaks are left out. One aggregation."""
    rules = [(f"{f.name} is null", F.col(f.name).isNull()) for f in schema if not f.nullable and f.name in df.columns]
    rules += [(f"{c} not allowed", F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in (enums or {}).items()]
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, rows long")
    counts = df.agg(*(F.count_if(broken).alias(f"r{i}") for i, (_, broken) in enumerate(rules)))
    listed = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, (name, _) in enumerate(rules)))
    return counts.select(F.explode(listed).alias("x")).select("x.*").where("rows > 0")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], parent_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after the papers in ``parent_ids(id)`` are deleted: cascades, nulls and, for restricted rows, an error."""
    gone = parent_ids.select("id").distinct()
    held = [
        orphan.select(F.lit(name).alias("t"))
        for name, keys in REFERENCES.items() if name in tables
        for column, _, rule in keys if rule == "restrict"
        for orphan in [tables[name].join(gone.withColumnRenamed("id", column), column, "left_semi")]
    ]
    if held and (kept := reduce(DataFrame.unionByName, held).limit(1).collect()):
        raise ValueError(f"papers are still referenced by {kept[0].t}")
    out = dict(tables)
    if "paper" in out:
        out["paper"] = out["paper"].join(gone, "id", "left_anti")
    for name, keys in REFERENCES.items():
        for column, _, rule in keys:
            if name in out and rule == "cascade":
                out[name] = out[name].join(gone.withColumnRenamed("id", column), column, "left_anti").select(*tables[name].columns)
            elif name in out and rule == "set null":
                mark = gone.select(F.col("id").alias("__gone"))
                joined = out[name].join(mark, F.col(column) == F.col("__gone"), "left")
                out[name] = joined.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*tables[name].columns)
    return out
