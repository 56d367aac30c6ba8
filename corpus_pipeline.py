"""A corpus pipeline: five operators of ``splitforge.llm`` in a row, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitforge.llm import fair_mix, kk_sharding, nbsvm, simhash_bktree, winnowing
from splitforge.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the NB-SVM, fitted on labels.quality, scores below the threshold."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group.

    Candidates are found by SimHash fingerprints through BK-trees, within ten bits;
    they are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return simhash_bktree.representatives(docs, shingle=5, radius=10, blocks=9, agree=2, similarity=0.8, bands=0)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten consecutive words with a benchmark item."""
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source near its target; a document comes as often (0 to 2 times) as the mix takes it."""
    return fair_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-balanced shards and slots of the mixed rows."""
    return kk_sharding.shard(docs).drop("row")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: A fitted model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage_{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
