"""From raw documents to packed training sequences, in stages that are each written and read again.

Every stage works on all documents that its predecessor kept, and returns the columns of documents (doc_id, text, lang,
source, n_chars), the last one the pieces of the packed sequences. Rows with a null doc_id are kept throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, near_dedup, packing, pii, suffix_dedup
from tidemark.llm.anchored import keyed
from tidemark.llm.common import read_table, written
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text that costs as many bits under the best language as bytes drawn at random would is of no language.
MOST_BITS = 8.0


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; those without a letter, or that no language explains better than random bytes, go."""
    docs = _documents(docs)
    found = langid.identify(docs, langid.train(docs), carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one with the smallest doc_id."""
    docs = _documents(docs)
    first = near_dedup.classes(docs).where("first").select("doc_id", "part").dropDuplicates(["doc_id", "part"])
    rows = _with_part(docs)
    on = rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["part"] == first["part"])
    return rows.join(first, on, "left_semi").dropDuplicates(["doc_id", "part"]).select(*COLUMNS)


def _with_part(docs: DataFrame) -> DataFrame:
    """docs and the key that tells rows of one doc_id apart, as the operators make it."""
    unique = keyed(docs).select("part").where("part <> 0").isEmpty()
    return docs.withColumn("part", F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit(""))))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes or more that starts at another place too, at whole characters."""
    found = suffix_dedup.deduplicate(_documents(docs), texts=True, carry=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the mark of its kind."""
    docs = _documents(docs)
    found = pii.redact(pii.spans(docs, pii.train(docs), carry=("lang", "source")), carry=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(_documents(docs), tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Models, sorting by suffix and packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
