"""The corpus pipeline: documents pass through the stages in order; each stage is written as Parquet and read again.

Every stage takes null ids and texts, empty and very long texts, repeated rows and further columns of any name; empty
documents give no rows. All but the last return the columns of documents as they are.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefield.llm import decontaminate, lines, minhash, mixing, quality
from scorefield.llm.common import materialize, read_table

#: Rows of an Arrow batch; Spark's default is 10,000.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of so few, for an executor and its Python workers share its memory, and both hold a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents below the threshold of scores learned from all labels. Null and empty texts are judged by features of
    zero, repeated rows alike; without labels all stay."""
    small_batches(spark)
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that resemble an earlier one; a document whose lines all go stays, with an empty text. Null texts stay null;
    of repeated rows each loses the same lines, and a null doc_id stands before all others. n_chars follows the text."""
    done = lines.dedup_lines(docs, counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: SimHash fingerprints of five-word shingles that differ in 4 bits
    at most, and what these miss of a Jaccard similarity of 0.8 or more. Of repeated rows one stays, and of null, empty and blank texts one; ties go to the smallest doc_id, null ones last."""
    small_batches(spark)
    return minhash.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark, repeated rows each for itself; null and empty texts are clean, and
    an empty benchmark drops nothing."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts none, repeated rows each for itself."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: A learned model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
