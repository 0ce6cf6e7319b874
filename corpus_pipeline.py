"""From raw documents to packed training sequences, in five stages.

Each stage takes (session, documents, folder of tables) and works on all documents that the
stage before kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import near_duplicates, packing, personal_data, quality, queries, toxicity, training
from graphloom.session import importable, stage, table


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity classifier does not call toxic.

    Null and empty texts have a score of their own and repeated rows the same one; an empty table stays empty."""
    model = queries.toxicity_model(spark, docs, table(spark, sf_dir, "labels"))
    return training.keep(docs, model, lambda score: score < 0.5)


def reject_bad(spark, docs, sf_dir):
    """Documents that the quality classifier calls good.

    Null and empty texts are one empty line and repeated rows have the same score; an empty table stays empty."""
    model = queries.quality_model(spark, docs, table(spark, sf_dir, "labels"))
    return training.keep(docs, model, lambda score: score >= 0.5)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of each group of near duplicates, repeated rows among them, the row with the smallest id, null ids last; ties
    go by the hashes of the text and of the row.  Null texts and texts without words all stay; an empty table stays empty."""
    return near_duplicates.keep_one(docs)


def mask_personal_data(spark, docs, sf_dir):
    """The same documents with personal data replaced by its kind, and n_chars counted again.

    Null texts stay null, with a null n_chars; repeated rows stay; an empty table stays empty."""
    masked = personal_data.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 ids.

    A null text is its end id alone; repeated rows and null ids are documents like others; an empty table gives no rows."""
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"), 1)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_bad),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifiers are trained: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark, sf_dir):
    importable(spark)
    rows = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        rows = stage(function(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
