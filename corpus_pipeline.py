"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), calls one operator of textlake.llm on all rows that its
predecessor kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import new_path
from textlake.llm.minhash import drop_near_duplicates
from textlake.llm.mixing import mix
from textlake.llm.packing import pack
from textlake.llm.quality import keep_good
from textlake.llm.substring import drop_repeats

#: Jaccard of near copies in percent, as for lines; the op10 query has a contract value of its own, 85.
NEAR_PERCENT = 80
#: Documents of one file of the first stage's table; later tables follow its files, however many small ones
#: the input had.
FILE_ROWS = 8_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from their language reject go."""
    return keep_good(docs).coalesce(1 + docs.count() // FILE_ROWS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; near copies have word shingles at 0.8 or more."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that an earlier document has are cut out; n_chars follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled inside output shards."""
    return mix(docs).select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin and its place in the bin."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]

#: Sketches, the splitting tree and the bins' successor search are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
