"""A corpus pipeline: quality rules, language ID, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as
Parquet in the shared folder and hands what is read back to the next. All stages but the last
return the columns of `documents`.

- quality_rules drops documents that the rules reject.
- language_id drops documents whose language is not known with calibrated confidence. The model
  learns from a bounded sample of its input's labelled rows.
- minhash_near_dedup keeps the least id of each group at five words and a similarity of 0.8.
- secret_scan masks the secrets found; no document goes.
- best_fit_packing packs what is left into sequences of at most 4096 ids.

Null and empty texts are rejected by the first stage; null ids and repeated rows pass on, each row by
itself, but near-dedup drops rows whose id goes. Very long texts are read whole in each stage. An
empty table gives an empty table of the same columns. Other columns stay as they are (n_chars follows
a masked text), and names that stages need do not clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import langid, minhash, packing, quality, secrets
from skein.llm.common import scratch, written

#: Words that a worker remembers in the last stage: the stages before it leave it less memory than op3 has.
WORDS = 300_000
#: The stages' rows depend on a trained model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.language_filter(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, most_words=WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # a stage's own tables go when its rows are written
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return docs
