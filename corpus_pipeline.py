"""A corpus pipeline over `documents`: language ID, line dedup, near-dedup, mixing and packing.

Each stage takes all rows that the one before kept and returns the columns of `documents`, the last one the packed pieces.
A row that the mix takes more than once is there more than once, under the same doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, line_dedup, minhash, mixing, packing
from marlstone.llm.common import checkpointed, shared_folder
from marlstone.llm.queries import tokenizer_path
from marlstone.sources.files import Files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose leading language has a smaller share of its words goes, as does one without a letter.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a leading language and sets lang to it."""
    names, table = langid.train(docs)
    carried = ("doc_id", "text", "source", "n_chars")
    out = langid.identify(docs, names, table, carry=carried)
    out = out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes common blocks of lines from later documents; documents of which nothing is left go."""
    out = line_dedup.remove_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that of smallest id, and of rows with that id one.

    Rows without an id are compared too and come after those with one; ties go by the hash of the text. Rows of one id that
    are not near-duplicates are different documents and stay.
    """
    rows = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    classes = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    first = rows.select("_row", place.alias("place")).join(classes, "_row").groupBy("class_id").agg(F.min("place").alias("place"))
    return rows.join(first.select(F.col("place._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; the last repeat may be cut to its first words."""
    rows = mixing.mix_sources(docs, carry=("text", "lang", "n_chars")).where("taken > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size"))
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, words.cast("int")), " ")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("minhash_near_dedup", near_dedup), ("mix_sources", mix), ("pack", pack)]

#: Trained models, sketches and token ids have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages, rows are written to the shared folder and read again.

    What a stage wrote is removed once the next has written its own; the last one's input stays for the result to be read from.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                Files(spark, folder).remove(str(k - 1))
    return docs
