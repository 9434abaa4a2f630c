"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents. The first stage sets Arrow batches of 1000 rows at most
for the session: rows are whole texts, and Python workers share an executor's memory
with all that runs before and after them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm import bpe, decontaminate, jaccard, langid, secrets
from stratavox.llm.registry import TOKENIZER
from stratavox.llm.tables import settle
from stratavox.sources.tables import read_table, workers_find_package

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; without a letter, or without its n-grams, they go. A null ``lang`` is filled in."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(1000, int(spark.conf.get(name, "1000")) or 1000)))
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model).where("accepted").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of a coefficient of 0.8 on 5-word shingles join, the one with the smallest id.

    Null ids, null and empty texts stay. Of rows that repeat an id one stays, the first by their columns.
    """
    groups = jaccard.join_components(docs, n=5, percent=80)
    repeated = settle(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = groups.where("doc_id != component_id").select("doc_id").unionByName(repeated)
    kept = jaccard.without(docs, gone.distinct(), "doc_id")
    if repeated.isEmpty():
        return kept
    leaders = groups.where("doc_id = component_id").select("doc_id").join(repeated, "doc_id", "leftsemi").distinct()
    rows = docs.join(leaders, "doc_id", "leftsemi")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("first"))
    return kept.unionByName(first.select("first.*"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    items = read_table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items).where("n_hit = 0").select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark, and ``n_chars`` counted again."""
    ratios = secrets.train(secrets.training_sample(docs))
    clean = secrets.redact(secrets.scan(docs, ratios))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, their number, and the digest of the text decoded from them."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("secret scans", secret_spans),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    workers_find_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, "stage")
    return docs
