"""The corpus pipeline: ``documents`` through five stages, each written and reread.

1. quality classifier: documents with a score below the threshold go;
2. SimHash near-dedup: of each component one document stays, the one with the least doc_id;
3. benchmark decontamination: documents in which a benchmark item is found go;
4. personal data: all spans are replaced by a tag of their kind (``n_chars`` follows the text);
5. BPE: token ids of what is left, decoded again, with digests.

Each stage works on all that its predecessor kept, and all but the last return the
columns of ``documents``, whatever further columns there are. Models are fitted on the rows of the stage's
own input. Equal rows of one doc_id (or of none) are reduced to one by stage 2; rows that share a doc_id and
differ in text are removed together or not at all by it, and a NULL doc_id can't be named as another
document's duplicate. The other stages judge every row by itself. Empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import bpe, decontam, pii, rule_ensemble, simhash
from shoplens.llm.registry import BYTE_BPE
from shoplens.llm.store import documents, picked, stored, unwrapped, wrapped


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.keep(docs, rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    own = wrapped(docs).withColumn("id", F.col("row").getField("doc_id").cast("long"))
    left = own.join(gone, F.col("id") == F.col("gone"), "left_anti")
    again = own.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    if again.isEmpty():
        return unwrapped(left, docs.columns)
    # Only ids that occur again need a look at their texts.
    repeats = F.col("id").eqNullSafe(F.col("again"))
    many = left.join(again, repeats, "left_semi").withColumn("text", F.col("row").getField("text")).dropDuplicates(["id", "text"])
    return unwrapped(left.join(again, repeats, "left_anti").unionByName(many.drop("text")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = bpe.build_lexicon(docs, BYTE_BPE)
    return bpe.digests(bpe.encode(picked(docs), BYTE_BPE, lexicon, decode=True))


STAGES = [("quality_classifier", keep_good), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("pii_redaction", redact_personal_data), ("bpe_encode", encode_tokens)]

#: No SQL: the classifier, XXH64 and the tokenizer are beyond it; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
