"""From raw documents to packed training sequences: five stages, each on what the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from windrow.llm.common import on_workers, read_table
from windrow.llm.exact_dedup import drop_copies
from windrow.llm.mixing import mixed
from windrow.llm.near_dedup import drop_near_copies
from windrow.llm.packing import pack_documents
from windrow.llm.queries import WORD_BPE
from windrow.llm.toxicity import drop_toxic
from windrow.storage import materialize

#: Pieces of words that the encoder of a worker remembers: few, as workers also hold what earlier stages left.
REMEMBERED = 60_000


@on_workers
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@on_workers
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_copies(docs)


@on_workers
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return drop_near_copies(docs)


@on_workers
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


@on_workers
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, *WORD_BPE, max_pieces=REMEMBERED)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer cannot be told in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
