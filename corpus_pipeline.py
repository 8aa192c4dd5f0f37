"""The corpus pipeline: language ID, near-duplicates, repeats, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but
the last return the columns of documents; each stage's result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmstrip.llm import langid
from filmstrip.llm.common import staged, table
from filmstrip.llm.decontam import clean
from filmstrip.llm.minhash import near_duplicates
from filmstrip.llm.packing import pack_documents
from filmstrip.llm.queries import PIECES, tokenizer_path
from filmstrip.llm.suffixes import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go, and those that
    no language explains better than the others together. The model is fitted on the
    same rows as op4's. Each row is decided by its own text."""
    path = tokenizer_path(PIECES)
    langs, p = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), path, key=F.col("doc_id"))
    if not langs:
        return docs.select(*COLUMNS)
    return langid.identify(docs, langs, p, path, carry=COLUMNS).where("lang_pred != 'und' and score >= 0.5").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: runs
    of five words, a similarity of 0.8 or more. Rows with a null id or without words
    stay; rows that repeat an id are told apart by their texts, and of a group's rows
    with the smallest id one stays."""
    marked = docs.withColumn("_text", F.xxhash64("text"))
    found = staged(near_duplicates(marked, carry=["_text"]).where("kept").select("doc_id", "_text", "group_id"), "kept")
    one = found.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "_text")).alias("row"), F.count(F.lit(1)).alias("m"))
    rows = one.select(F.col("row.doc_id").alias("_id"), F.col("row._text").alias("_of"), "m").union(found.where("group_id is null").select("doc_id", "_text", F.lit(0).cast("long")).distinct())
    kept = marked.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")))
    if not one.where("m > 1").isEmpty():  # rows that repeat an id and a text
        alone = F.when(F.col("m") == 0, F.monotonically_increasing_id())
        kept = kept.withColumn("_row", alone).dropDuplicates(["doc_id", "_text", "_row"])
    return kept.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that documents with smaller ids have. A character
    that a cut leaves incomplete goes too; a document that nothing is left of goes. A
    null text is empty from here on; rows with a null id stay whole."""
    done = without_repeats(docs, carry=["lang", "source"])
    kept = F.col("kept").cast("string")
    text = F.coalesce(F.try_validate_utf8(kept), F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    done = done.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", text)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is decided by its own text."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its place in a sequence.
    Each row is a document of its own."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near), ("repeats", repeats), ("decontamination", decontaminated), ("packing", packed)]

#: No stage but the second can be said in SQL, so tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
