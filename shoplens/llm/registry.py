"""Registered queries of the training-data operators, with production parameters.

Each ``opN_<name>`` applies its operator to the whole ``documents`` table (and
the tables it needs beside it) and derives the result columns from the
operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoplens.llm import bpe, chunks, decontam, langid, lm, phrases, pii, quality_rules, resample, rule_ensemble, simhash, suffix_dedup, token_files
from shoplens.llm.store import documents, picked, scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, model)


#: Appended to each document's ids in op3's files.
END_ID = 2


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, WORD_BPE, END_ID)
    return token_files.digests(token_files.read_tokens(spark, path))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.deduplicate(documents(spark, sf_dir)))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.digests(chunks.deduplicate(documents(spark, sf_dir)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = picked(documents(spark, sf_dir))
    lexicon = bpe.build_lexicon(docs, BYTE_BPE)
    return bpe.digests(bpe.encode(docs, BYTE_BPE, lexicon, decode=True))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.classify(docs, model)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digests(resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_token_files, op4_suffix_dedup, op5_substring, op6_simhash, op7_bpe, op8_language, op9_decontamination,
                                     op10_quality_classifier, op11_phrases, op12_lm, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": decontam.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op13_resample": resample.ORACLE_SQL}
