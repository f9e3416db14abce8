"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results, for every stage: rows with a null key, language, source or length are rows like any
other; a null text stays null up to packing and counts as empty; texts of any length are taken whole;
rows that repeat are judged alike, near-duplicate removal leaves one of them; an empty table gives an
empty result; extra columns, whatever their names, are carried along by all but packing. What each stage
does with them beyond that stands in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm._util import materialize, table
from loomwright.llm.mixing import mix_documents
from loomwright.llm.ngram_join import keep_one
from loomwright.llm.packing import pack_documents
from loomwright.llm.quality import filter_documents
from loomwright.llm.secrets import redact

TOKENIZER = "word_bpe_49k.json"
#: Near duplicates: Jaccard similarity in percent of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 10): a text that is null or has fewer than ten words goes, a tie with a cutoff stays."""
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 5): that with the smallest id, null last, of rows that repeat one; texts without words stay."""
    return keep_one(docs, shingle=SHINGLE, threshold=SIMILARITY)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked (operator 4), n_chars renewed where the text changed; of overlapping finds one mark is left."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 8): whole, twice at most; those without words go; rows that repeat share evenly."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens (operator 6); a null or empty text is its end token."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scan", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the n-gram classes, the scan's battery and the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
