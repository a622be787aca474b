"""A corpus pipeline of five stages over the documents table.

Toxic and low-quality documents go, boilerplate lines of a source go, one document of each
group of near-duplicates stays, and what is left is packed into token sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import cut, table, vocabulary_path
from threadloom.llm.line_dedup import drop_boilerplate
from threadloom.llm.near_dedup import near_duplicates
from threadloom.llm.packing import pack
from threadloom.llm.quality_rules import passing
from threadloom.llm.toxicity_crf import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger, learned from the labels of the corpus, doesn't call toxic."""
    labels, corpus = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return score_toxicity(docs, labels, threshold=0.3, train_docs=corpus, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; counts are made only where no earlier rule has rejected."""
    return passing(docs).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars is that of the new text."""
    done = drop_boilerplate(docs, host="source", text="text")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates (five-word shingles, 0.8).

    Rows that repeat an id are one document, of which each text stays once; rows without an id stay.
    """
    kept = near_duplicates(docs, shingle_words=5, percent=80).filter("kept").select("doc_id").distinct()
    copies = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    once = docs.join(kept, "doc_id", "left_semi").withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1")
    return once.select(*COLUMNS).union(docs.filter("doc_id is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096 tokens."""
    return pack(docs, vocabulary_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("line dedup", drop_boilerplate_lines),
    ("near dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The tagger is trained and the packing is a heuristic, so the rows aren't SQL's to give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written as Parquet and reread as the next one's."""
    docs = table(spark, sf_dir, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            if folder:
                docs.write.parquet(f"{folder}/{k}")
                docs = spark.read.parquet(f"{folder}/{k}")
            else:
                docs = cut(docs)
    return docs
