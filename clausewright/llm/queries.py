"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, crf, exact, fingerprint, interpolation, jaccard, licenses, mixing, near, packing, substring, toxicity, trie
from .store import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir), keep_text=False)


ORACLE_SQL["op2_substring_dedup"] = substring.REPEATS_SQL.format(documents="documents", window=35)


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_table(spark, sf_dir), percent=85)


ORACLE_SQL["op3_near_dedup"] = near.GROUPS_SQL.format(documents="documents", width=5, percent=85, more=", doc_id = component_id as kept")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(_table(spark, sf_dir))


ORACLE_SQL["op4_exact_dedup"] = exact.COPIES_SQL.format(documents="documents")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), remembered=1 << 20)


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir))


ORACLE_SQL["op7_source_mix"] = mixing.MIX_SQL.format(documents="documents")


@query
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.scores(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


@query
def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(_table(spark, sf_dir))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(_table(spark, sf_dir))


ORACLE_SQL["op12_ngram_jaccard_join"] = near.GROUPS_SQL.format(documents="documents", width=5, percent=80, more="")


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"), family=5)


ORACLE_SQL["op13_conversation_trie"] = trie.TRIE_SQL.format(conversations="conversations", family=5, longest=8)


@query
def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op5, by its operator: places of the phrases (-1 where there is none)."""
    place = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return licenses.scan(_table(spark, sf_dir)).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


ORACLE_SQL["license_phrases"] = licenses.PHRASES_SQL.format(documents="documents")


@query
def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op10, by its operator: what follows from counts alone."""
    rows = interpolation.scores(_table(spark, sf_dir))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


ORACLE_SQL["lm_base_scores"] = interpolation.BASE_SQL.format(documents="documents", crc=trie.CRC_SQL.format(text="doc_id::varchar"))
