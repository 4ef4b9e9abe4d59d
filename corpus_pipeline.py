"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.llm.common import held_out, spill, table
from thermograph.llm.jaccard import keep_one_of_each
from thermograph.llm.lines import SHORT_WORDS, drop_repeated_runs
from thermograph.llm.packing import packed_documents
from thermograph.llm.substrings import remove_repeats
from thermograph.llm.toxicity import labelled_sample, score, train

#: No SQL expresses a trained classifier or a tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject. Null texts stay."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    model = train(labelled_sample(docs, labels))
    return score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).filter("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out of the texts; every document stays."""
    return _recounted(drop_repeated_runs(docs, short_words=SHORT_WORDS), docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows are cut out; texts without any stay as they are."""
    return _recounted(remove_repeats(docs, layout=True), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard), ("substring dedup", substring_dedup), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
