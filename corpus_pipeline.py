"""From raw documents to training sequences: quality, exact and near copies, mixture, packing.

Each stage reads its predecessor's rows from Parquet and writes its own; all but the last return the columns of
``documents``, whatever their names. Null texts count as empty: the classifier scores them as such, exact dedup keeps one,
the mixture leaves them out. An empty table gives an empty result. Rows that share an id are settled by the whole row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, jaccard_join, mixing, packing, quality
from graphloom.llm.queries import learn_quality, tokenizer_path
from graphloom.runtime import private
from graphloom.storage import scratch_path, table

#: Documents below this probability of being good go.
LEAST_QUALITY = 0.3
#: Parts of the training order that are packed one after the other, each by its own shares of sources.
SLICES = 64


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from the labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = learn_quality(docs.select("doc_id", "text"), labels)
    return docs.where(quality.score(docs, model) >= LEAST_QUALITY)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture uses them, in the order of their training positions: the files' numbers and
    the places in them carry that order on."""
    (position,) = private(docs.columns, "training_position")
    return mixing.mix(docs, position_col=position).drop(position)


def place(docs: DataFrame) -> Column | None:
    """The file part that a row was read from, in the order in which the parts were written; None if not from files."""
    try:
        file = docs.metadataColumn("_metadata")
        number = F.lpad(F.regexp_extract(file["file_name"], r"^part-(\d+)", 1), 12, "0")
        at = F.concat(number, F.lit(" "), file["file_name"], F.lit(" "), F.lpad(file["file_block_start"].cast("string"), 18, "0"))
        docs.select(at)
        return at
    except AnalysisException:
        return None


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a training sequence, sequences in the order of the curriculum: each has the proportions of
    sources that the mixture has at that time."""
    pieces = packing.pack(docs, tokenizer_path(), block=place(docs), slices=SLICES)
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Compression, word shingles and tokens aren't SQL's; the tests hold run() against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"pipeline": run}
