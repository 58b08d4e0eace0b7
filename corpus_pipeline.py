"""The corpus pipeline: quality, near duplicates, decontamination, mixture, token ids.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before it
kept and returns a table; all but the last return the columns of ``documents``.

Cases, of every stage: an empty table stays empty, with its columns; columns beyond those of
``documents``, whatever their names, stay with their rows; a very long text is worked on whole.
What null ids, null, empty and blank texts, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonewright.llm import common, dac, decontaminate, jaccard, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling field predicts good. Null, empty and blank texts have no lines
    and stay if at least THRESHOLD of the labelled documents are good; a score equal to THRESHOLD stays;
    rows without id and repeated rows are judged each by their text."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the exact n-gram Jaccard join, that of the smallest id. Null, empty
    and blank texts are in no class and stay; of rows that repeat an id one stays; a row without id
    stays, once for each text, if its class has no row with one."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null, empty and blank texts hold none and stay; rows
    without id and repeated rows are judged each by their text; a similarity equal to the threshold
    is a match."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


#: The mixture: weights of domains and languages, and the budget as a share of the tokens at hand.
DOMAINS, LANGUAGES, SHARE = (("web", 5), ("books", 3), ("code", 2)), (("en", 5), ("de", 2), ("fr", 2), ("es", 1)), (4, 5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token prefix of every source, by target weights, in one epoch. Null, empty and blank texts have no
    tokens and go; a null lang or source is one of its own; rows equal in id and text are cut to the
    longest prefix that any of them is given; ties in the order go by id and text."""
    return mixing.select_texts(docs, share=SHARE, domains=DOMAINS, languages=LANGUAGES)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in their file format, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts
    give the end id alone; rows without id come first; equal ids go by text."""
    return dac.write_and_read(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: SQL can express neither the field nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
