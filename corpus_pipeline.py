"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``, whatever further columns these have; an empty table gives an empty one,
a null text counts as empty, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.llm import mixing, ngram_join, packing, suffix, toxicity
from rillgrid.llm.common import long_rows, new_names, read, shared_folder
from rillgrid.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go.

    Equal texts, and so repeated rows, share their fate; a null text scores as an empty one.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    (name,) = new_names(docs, "score")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike to 0.8 or more in their word 5-grams, the one with the least id stays.

    Documents linked through others are one group; of repeated rows one stays, and a null id
    is above all others. Texts without a word are alike to none and all stay.
    """
    long_rows(spark)
    return ngram_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters go that lie in 50 bytes which a document with a smaller id has too.

    Every row stays, its text shorter or empty; rows of one id cut nothing from one another,
    and a null id is above all others. ``n_chars`` follows the text.
    """
    long_rows(spark)
    return suffix.deduplicated_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are sampled or repeated to their share of all words.

    A null source is a source; a row that is taken more than once comes as often, and one
    that is taken in part keeps its first words. Rows without words go.
    """
    long_rows(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens.

    Repeated rows are packed each for itself, with the same ``doc_id``, which may be null.
    """
    long_rows(spark)
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("suffix", cut_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenizing, shingle hashing and byte-level matching have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
