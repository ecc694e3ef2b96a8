"""The registered queries of this subpackage: thin, each through its operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, chat, htmltext, jaccardjoin, langid, linededup, mixing, packing, quality, resample, simhash, substrings, tokenalign
from leafmill.session import ship, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccardjoin.join(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.predictions(spark, table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.dedup(spark, table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return htmltext.extract(spark, table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.report(spark, table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return tokenalign.report(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_chat_format": op9_chat_format,
    "op10_simhash": op10_simhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op1_jaccard_join": jaccardjoin.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op13_importance_resampling": resample.ORACLE,
}
