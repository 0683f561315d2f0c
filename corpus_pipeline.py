"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs; all but the last return the
columns of ``documents``.

1. language: documents without a letter (``und``) or without a clear language go (a table
   without any labelled row teaches no language, so all its documents stay);
2. lines: boilerplate lines go from the texts; a document whose words all lay in lines
   that stay elsewhere holds nothing of its own and goes, the others stay;
3. duplicates: one document of each near-duplicate group stays (its smallest id;
   documents without words stay);
4. benchmark: documents that hold a benchmark item go;
5. packing: what is left becomes token sequences.

Nulls, empty texts, repeated rows and other columns have the results that the
operators define; of rows equal in id and text stage 3 keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from vigil.llm.common import WORD, fresh, stored, table

#: a language is clear from this posterior on
CLEAR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.fit(docs, path, ~language_id.held_out())
    if not model:
        return docs
    (pred, score), kept = fresh(docs, "lang_pred", "lang_score"), docs.columns
    found = language_id.annotate(docs, model, path, "text", pred, score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= CLEAR)).select(*kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    had, = fresh(docs, "had_words")
    out = line_dedup.dedup_lines(docs.withColumn(had, worded))
    out = out.where(worded | ~F.col(had))         # emptied: every line of it stays in another place
    removed = out.columns[-1]                     # rows that lost no line keep their n_chars
    size = [F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*size)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col(out.columns[len(docs.columns)])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("duplicates", duplicates),
          ("benchmark", benchmark), ("packing", pack)]

#: language identification and tokenisation have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
