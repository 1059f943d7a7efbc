"""A training corpus from the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept. Its result is written as Parquet below the shared folder and read again.
All stages but the last return the columns of documents. The order that the
mixing stage gives the documents is the order of the files and rows it is written
in; the last stage reads it from there and carries it as a column.

Null and empty texts are clean, are copies of nothing, hold no personal data and
have no tokens. Rows of one doc_id are kept or dropped together. An empty table
gives empty results; further columns of documents pass through all stages but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm import bpe, mixing, near_copies, personal_data, toxicity
from breezeline.llm._memory import small_batches
from breezeline.session import work_dir

TOXIC_FROM = 0.7
BROADCAST_IDS = 2_000_000  # more ids than this are joined by a shuffle
PACK_BYTES = 2 << 20  # of text encoded at once, next to what the stages before have left in memory
ROW_BITS = 40  # of a position; the bits above are the file's part


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where(F.col("score") < TOXIC_FROM).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    groups = near_copies.near_copies(docs, size=5)
    path = work_dir(spark) + "/copies"
    groups.where(~F.col("kept")).select("doc_id").distinct().write.parquet(path)
    copies = spark.read.parquet(path)
    few = copies.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind, and n_chars to match."""
    found = personal_data.with_personal_data(docs, into="spans")
    text = personal_data.masked(F.col("text"), F.col("spans"))
    clean = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, range by range in the order that interleaves their sources to the target weights."""
    return mixing.in_order(mixing.mixed(docs)).select(*docs.columns)


def in_written_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, which grows in the order of the files' parts and their rows; null if read from no files."""
    if not docs.inputFiles():
        return docs.withColumn("position", F.lit(None).cast("long"))
    others = [c for c in docs.columns if c != "position"]
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("long")
    place = F.shiftleft(part, ROW_BITS) + F.col("_metadata.row_index")
    return docs.select(*others, place.alias("position"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, position, n_tokens, tokens, decoded_sha256) of every document; sorted by position they are in mixed order."""
    import public_tokenizers

    path = bpe.default_path(spark)
    placed = in_written_order(docs)
    coded = bpe.encode(placed, path, public_tokenizers.PATTERN, decoded=True, keep="position", pack_bytes=PACK_BYTES)
    return coded.select(
        "doc_id",
        "position",
        F.size("tokens").cast("long").alias("n_tokens"),
        "tokens",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", in_mixed_order),
    ("bpe", as_tokens),
]

#: SQL cannot express the trained, merged and scheduled stages; the tests check each stage's decisions on run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_dir(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
