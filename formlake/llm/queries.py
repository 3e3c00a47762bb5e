"""The registered corpus queries; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import DIVERGENCE_SQL
from .line_templates import LINES_SQL
from .merkle import MERKLE_SQL
from .mixture import mix_sql

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents among all documents."""
    from .minhash_forest import near_duplicates

    return near_duplicates(_t(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a smaller document holds."""
    from .passages import drop_repeated_passages

    return drop_repeated_passages(_t(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Simple-8b shards and read back."""
    from .token_files import token_digest

    return token_digest(_t(spark, sf_dir, "documents"), tokenizer_path())


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    from .katz import score_texts

    return score_texts(_t(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings."""
    from .vectors import near_vectors

    return near_vectors(_t(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract_main_text

    return extract_main_text(_t(spark, sf_dir, "pages"))


def op7_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    from .line_templates import drop_template_lines

    return drop_template_lines(_t(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used so that no source is repeated more than four times."""
    from .mixture import mix_sources

    return mix_sources(_t(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from .toxicity import score_toxicity

    return score_toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    from .decontaminate import decontaminate

    return decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of every document; documents whose id has an even CRC-32 are shown without line feeds."""
    from .merkle import merkle_manifest, proof_digests

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(_t(spark, sf_dir, "documents"), shown={"text": text}).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_digests(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each language's sources differ in their words."""
    from .divergence import source_divergences

    return source_divergences(_t(spark, sf_dir, "documents"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and what they decode to."""
    from .pieces import decode_ids, encode_texts

    model = tokenizer_path(PIECES)
    decoded = decode_ids(encode_texts(_t(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_repeated_passages, op3_token_files, op4_katz_scores, op5_near_vectors, op6_main_text,
    op7_template_lines, op8_mixture, op9_toxicity, op10_decontamination, op11_merkle_manifest, op12_source_divergence, op13_pieces)}

# The others hash, tokenize, fit models or follow links without end; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op7_template_lines": LINES_SQL, "op8_mixture": mix_sql(),
                              "op11_merkle_manifest": MERKLE_SQL, "op12_source_divergence": DIVERGENCE_SQL}
