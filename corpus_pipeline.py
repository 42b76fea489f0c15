"""The training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written
as Parquet and read again as the next stage's ``docs``; all but the last
return the columns of ``docs``.

1. language: texts without a recognisable language (``und``: no letter) go.
2. lines: lines that three or more documents hold stay in one of them;
   ``n_chars`` follows the text.
3. near_duplicates: one document of each group of similarity 0.8 or more stays.
4. decontamination: documents that share ten consecutive words with a
   benchmark item go.
5. packing: every document gets its length bucket, batch and slot (lengths and
   the budget are tokens).

Cases: nulls in any column, empty and very long texts, repeated rows, rows
without an id and empty tables are handled by each stage as its operator
states; a null or empty text has no language and goes in the first stage.
Other columns pass through, also if they are named as a stage names its own;
names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from preflight.llm import decontaminate, language, line_dedup, minhash, packing
from preflight.session import delete_scratch, materialize, scratch_files

SIMILARITY_PERCENT = 80


def _aside(docs, *names):
    """``docs`` with columns of these names renamed, and the way back."""
    away = {c: f"__own_{c}" for c in docs.columns if c in names}
    back = {v: k for k, v in away.items()}
    return docs.withColumnsRenamed(away), lambda out: out.withColumnsRenamed(back).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def language_stage(spark, docs, sf_dir):
    model = language.train(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    plain, back = _aside(docs, "lang_pred", "score")
    found = language.identify(plain, model, text=True)
    return back(found.filter(F.col("lang_pred") != "und").drop("lang_pred", "score"))


def line_stage(spark, docs, sf_dir):
    plain, back = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.line_dedup(plain).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return back(out)


def near_duplicate_stage(spark, docs, sf_dir):
    return minhash.deduplicated(docs, SIMILARITY_PERCENT)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark, docs, sf_dir):
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Viterbi, Bloom filters and dynamic programming have no SQL form; the
#: pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """``documents`` through every stage.  Once a stage is written, what it
    read of the stage before and its own intermediate files are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(scratch_files(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        *done, _ = [p for p in scratch_files(spark) if p not in before]       # the last one is ``docs``
        delete_scratch(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
