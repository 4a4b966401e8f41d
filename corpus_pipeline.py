"""Preparation of a training corpus: five stages over the documents, each written before the next one reads it.

1. language: documents without letters, or without a clear language, go.
2. near duplicates: of documents whose five-word shingles are 80% alike, directly or through others, the one with
   the smallest id stays (null ids come last), and of its rows one; of equal rows without words, one.
3. benchmark: passages of benchmark items are cut out; a document left without words goes.
4. personal data: spans are replaced by their kind.
5. mix: blocks are apportioned to sources; the result has the documents that the mix takes, with the number of words.

Ids may be null and may have several texts: rows are decided on by a number of their own. Documents may have other
columns of any name; stages put those aside that are named like columns of their own work. Only the last stage adds
columns, size, target and taken, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.lineage import cut
from netloom.llm import decontaminate, jaccard, langid, mixing, pii
from netloom.llm.common import table
from netloom.llm.packed import small_enough

MIN_SCORE, ROW, PLANNED = 0.5, "row_number_in_stage", ("size", "target", "taken")


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """The documents with columns of these names, in any case, renamed; and the columns that name them back."""
    taken, new = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names:
            other = f"{c}_own"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            new[c] = other
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number, written so that it stays."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, columns = apart(docs, "lang_pred", "score")
    model = langid.fit(docs.where(~langid.held_out()))
    scored = langid.predict(docs, model)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, columns = apart(docs, ROW)
    rows = numbered(docs)
    found = jaccard.grouped(rows, k=5, percent=80, carried=(ROW,))
    alone = F.col("comp").isNull()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", ROW))
    kept = cut(found.groupBy("comp", F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("th")).alias("digest")).agg(first.alias("first")).select(f"first.{ROW}"), "kept")
    return rows.join(small_enough(kept, kept.count()), ROW, "left_semi").select(columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, columns = apart(docs, decontaminate.FOUND)
    return decontaminate.without_spans(docs, table(spark, sf_dir, "benchmark")).select(columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, columns = apart(docs.drop(*(c for c in docs.columns if c.lower() in PLANNED)), ROW)
    rows = numbered(docs)
    plan = cut(mixing.mix(rows, carried=(ROW,)).where("taken > 0").select(ROW, *PLANNED), "plan")
    return rows.join(small_enough(plan, plan.count()), ROW).select(*columns, *PLANNED)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("mix", mix)]

# models and similarity joins cannot be written as SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
