"""A corpus pipeline: quality, language, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage works on every row that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, jaccard, langid, packing, quality
from ledgerlens.llm.shared import Scratch

#: a text whose best language has a lower probability is rejected
LEAST_SCORE = 0.4
#: near duplicates: words of a shingle, and similarity as a fraction
SHINGLE, SIMILARITY = 5, (4, 5)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what importance resampling draws."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels, Scratch(spark, "quality"), one_kind="keep").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters and those of no language that the corpus is labelled with."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    net = langid.train(docs.where(~held))
    found = langid.predict(docs, net)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of similar ones, and a repeated row once."""
    scratch = Scratch(spark, "near")
    found = scratch.write(jaccard.similar_documents(docs, scratch, k=SHINGLE, threshold=SIMILARITY), "found")
    scratch.drop_all_but("found")
    return jaccard.one_of_each(docs, found)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that cover a test item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their places."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(Scratch(spark, "packed").write(cut, "pieces"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: the classifier, the network, the join and the search for packings have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop_all_but(name)
    return STAGES[-1][1](spark, docs, sf_dir)
