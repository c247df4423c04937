"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. language_id: documents without letters go, and those whose predicted language is clearly less probable than its own
   was for any row that calibrated the model (times `MARGIN`). The model learns from the rows' own labels, in the four
   fifths of documents that the operator sets aside for learning; without any label all documents with letters stay.
2. line_dedup: runs of two or more lines, and single lines of 50 or more words, that begin earlier are deleted; documents that lose all their lines go.
3. minhash: of each class of near-duplicates the document with the least id stays.
4. suffix_dedup: bytes of 100-byte strings that start earlier are removed; documents that lose all their words go.
5. packing: the pieces of what is left, by shard, bin and offset.

Documents that had no words before a stage are not judged by what it removes and stay. All stages but the last return
the columns of documents, n_chars being counted anew where the text changes. Rows that repeat an earlier row pass like
other documents until stage 3, which leaves one row of each (doc_id, text); rows without doc_id pass it. The defined results for nulls, empty tables
and long texts are those of the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritempo.llm import language_id, line_dedup, minhash, packing, suffix_dedup
from veritempo.llm.common import shared_folder, table

#: Part of the calibration rows' lowest probability that a document's language must have.
MARGIN = 0.9


def _has_words(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False))


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and row: all other columns, out of the way of the columns that operators add."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", "lang", F.struct(*rest).alias("row"))


def _wide(rows: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of documents again, with the given text; documents that a change has left without words go."""
    rows = rows.select("row", text.alias("text"), changed.alias("changed")).where(~F.col("changed") | _has_words(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _narrow(docs)
    model = language_id.train(rows.where(language_id.learned_here(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MARGIN * model["least"])
    return _wide(language_id.predict(rows, model).where(known), docs.columns, F.col("text"), F.lit(False))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.delete_repeated_runs(_narrow(docs).drop("lang"), long_words=line_dedup.LONG_WORDS)
    return _wide(rows, docs.columns, F.col("kept_text"), F.col("n_removed") > 0)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicates(docs.select("doc_id", "text"))
    found = classes.where("doc_id = class_id").select("doc_id").distinct()
    rows = _narrow(docs)
    kept = rows.join(found, "doc_id", "left_semi")  # the window below needs no other shuffle
    one = kept.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("row"))).where("copy = 1").drop("copy")
    return _wide(one.unionByName(rows.where("doc_id is null")), docs.columns, F.col("text"), F.lit(False))


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_narrow(docs).drop("lang"))
    return _wide(rows, docs.columns, F.col("kept_text"), F.col("n_removed") > 0)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", delete_repeated_lines),
    ("minhash", keep_one_of_each_class),
    ("suffix_dedup", remove_repeated_bytes),
    ("packing", pack_best_fit),
]

#: No stage but line_dedup can be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written to the shared folder and read again.

    A stage's rows are deleted once the next stage is written; those of the last but one stay, as the result reads them.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
