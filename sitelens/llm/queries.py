"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import decontam, jaccard, langid, minhash, pack, pii, repeats, resample, secrets, shards, tokenalign, urlrules, warc
from sitelens.llm.common import inline_rows, table

TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"

# The URL rules of the contract.
URL_RULES = [{"host": "net", "path": "/", "verdict": "block"},
             {"host": "example.net", "path": "/en/", "verdict": "allow"},
             {"host": "example.com", "path": "/de/", "verdict": "block"},
             {"host": "org", "path": "/fr/", "verdict": "allow"}]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids by multiway differencing."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, by anchor expansion."""
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("found")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest URL rule for every page, by hash-prefix join."""
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), inline_rows(spark, URL_RULES))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, by q-gram bands and alignment."""
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    return jaccard.components_of(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, by script, n-gram scores and Viterbi spans."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).drop("spans")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of even counts, equal texts together where quotas allow."""
    return shards.shard_documents(table(spark, sf_dir, "documents")).drop("link")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text, its edited text and their likeness."""
    return minhash.neighbour_report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to a content-addressed archive and reads it back."""
    path = warc.archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).selectExpr(
        "record AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, over a trigram inverted index."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte that a repeated run of 200 bytes covers is taken out, by two-stage suffix sorting."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked tokens of two tokenizers in every document, scored through inverted pair bitmaps."""
    return tokenalign.alignment_report(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(OTHER_TOKENIZER))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words, ranked by a distributed radix sort."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pack, op2_pii, op3_url_rules, op4_contamination, op5_ngram_jaccard, op6_language, op7_shards, op8_order_minhash, op9_warc, op10_secrets,
        op11_repeats, op12_token_alignment, op13_resample)}
