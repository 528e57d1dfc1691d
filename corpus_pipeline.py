"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before has kept, and
returns a frame that is written and read again as the next one's docs. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, jaccard, langid, linededup, mixing
from palaver.llm.blocks import crc_remainder
from palaver.session import remove_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less probable than this is rejected.
LEAST_SCORE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language the network is not sure of.

    The network learns from the labelled rows outside the held-out fold; rows without a text or a lang
    are not learnt from. Null and empty texts go; repeated rows are judged alike; with no labelled row
    every text is rejected; an empty table gives an empty one.
    """
    learnt = docs.where(crc_remainder("doc_id", 5) != 0).select("text", "lang")
    found = langid.predict(docs.select(*COLUMNS), langid.fit(learnt))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; a text of which nothing but blanks is left by that goes.

    Null texts stay; a null source is a site; repeated rows are treated alike; an empty table gives an
    empty one.
    """
    done = linededup.dedup_lines(docs.select(*COLUMNS))
    done = done.where((F.col("lines_removed") == 0) | (F.trim("text", F.lit(" \t\r\n")) != ""))
    length = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8) one row, that of the smallest id.

    Texts without a word, and rows without an id, are no one's duplicates. Repeated rows are one
    another's; of rows that share an id each is judged by its own text.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS), width=5, p=80, q=100)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of any benchmark item.

    Null and word-less texts stay; repeated rows are judged alike; with no items nothing goes; an empty
    table gives an empty one.
    """
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as its text, with size, source_size, target and taken.

    The text holds the taken blocks only, a repeated document twice; it has ``taken`` words. Texts of
    which nothing is taken go, null and word-less ones among them; repeated rows are rows of their own;
    a null source is a source; an empty table gives an empty one.
    """
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("mix_taken > 0")
    text = mixing.taken_text(F.col("text"), F.col("mix_spans"))
    mixed = mixed.withColumn("_text", text).withColumn("n_chars", F.when(F.col("_text") == F.col("text"), F.col("n_chars")).otherwise(F.length("_text").cast("long")))
    return mixed.withColumn("text", F.col("_text")).select(*COLUMNS, *[F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: The learned first stage has no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    import uuid

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)  # only the last stage's input is still read
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

