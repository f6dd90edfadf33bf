"""A training-corpus pipeline over documents: language ID, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlore.llm.common import free_name, materialize
from wattlore.llm.decontam import find_leaks
from wattlore.llm.langid import UNKNOWN, fit, identify
from wattlore.llm.ngram_join import ngram_jaccard_groups
from wattlore.llm.packing import pack_documents
from wattlore.llm.queries import table, tokenizer_file

#: A document whose best language has a smaller mean word probability is rejected; one of no letters always is.
LEAST_LANGUAGE = 0.4

def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(the rows, the column that tells them apart).

    That is doc_id where no row lacks it and no two rows share it. Else decisions about rows can't be applied by it, and rows
    get a key each, written so that the key stays the same for all that reads it.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not shared.head(1):
        return docs, "doc_id"
    key = free_name(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key


#: Rows to drop are sent to all tasks up to this number (16 bytes each); beyond it the rows are joined by a shuffle.
SENT_ROWS = 4_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in gone, a written table of keys. Below SENT_ROWS no text is shuffled for it."""
    few = gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the conditional random field knows; it is fitted on a bounded sample of them.

    Null texts and texts without a letter are rejected; rows that repeat are judged alike and all stay or go; an empty
    table stays empty; columns called lang_pred or lang_score are the input's own in the result.
    """
    own = {c: free_name(docs, f"input_{c}") for c in docs.columns if c.lower() in ("lang_pred", "lang_score")}
    found = identify(docs.withColumnsRenamed(own), fit(docs))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE))
    return kept.drop("lang_pred", "lang_score").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with five-word shingles alike to 0.8 or more; rows without a word are no copies of each other.

    The row with the smallest doc_id stays (nulls last, then the row's key). Rows that repeat and rows with null ids are
    copies like any other, and a row is not dropped for what another row of the same doc_id holds. Null texts have no word
    and stay; an empty table stays empty; other columns go along, whatever they are called.
    """
    rows, key = keyed(docs, "near-duplicate-input")
    groups = ngram_jaccard_groups(rows.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80)
    groups = materialize(groups.select(F.col("doc_id").alias("row"), "component_id"), "near-duplicates")
    many = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    alike = materialize(groups.join(many, "component_id").join(rows.select(F.col(key).alias("row"), "doc_id"), "row"), "near-duplicate-rows")
    first = alike.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = alike.join(first, "component_id").filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(key))
    return without(rows, materialize(gone, "near-duplicates-gone"), key).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item, whatever their doc_id.

    Null texts hold nothing and stay; rows that repeat are judged each; with no document or no item nothing is dropped;
    other columns go along, whatever they are called.
    """
    rows, key = keyed(docs, "decontamination-input")
    found = find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return without(rows, leaks, key).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left: pack_documents' columns.

    A null text is the end id alone, a null doc_id stays null, rows that repeat are packed each, an empty table gives an
    empty result, and documents over 4096 tokens are cut; other columns end here.
    """
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("decontamination", decontamination), ("packing", packing)]

#: The language model of the first stage and the tokenizer of the last can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
