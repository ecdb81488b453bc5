"""The registered queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fingerprint, html_text, langid, licenses, mtree, near_dedup, packing, pii, sql, substring_dedup, suffix_dedup, whitening
from .common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.digest(pii.spans(docs, pii.train(docs)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents")).drop("part")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


#: Phrases that the query's contract names; the operator's own list counts the bare word mit.
LICENSE_PHRASES = {"mit": ["under the mit license"], "apache-2": ["apache license version 2"], "cc-by-nc": ["cc by nc"]}


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), LICENSE_PHRASES)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_mtree_topk,
    op2_pii,
    op3_suffix_dedup,
    op4_fingerprint,
    op5_packing,
    op6_bpe,
    op7_langid,
    op8_minhash_dedup,
    op9_substring_dedup,
    op10_html_extract,
    op11_collocations,
    op12_license_scan,
    op13_whitening,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole result; tests hold the other operators against brute force."""
    known = licenses.templates(licenses.PHRASES, licenses.NOTICES)
    return {"op11_collocations": sql.OP11_COLLOCATIONS, "op12_license_scan": sql.op12_license_scan(known, licenses.BETWEEN, licenses.SLIP, licenses.SHARE)}
