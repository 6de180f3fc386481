"""A corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns what goes on; ``run`` writes each result as Parquet to the cluster's
shared folder and rereads it, so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import bpe, decontamination, exact_dedup, simhash, toxicity
from codesift.llm.common import column, may_learn, spare_name, stored, table, without
from codesift.llm.queries import tokenizer_file

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts do. Held-out labels are not learned from."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(may_learn("doc_id")))
    return docs.filter(toxicity.score(docs, model) < toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows that repeat id and text as well, one."""
    names = [f"_doc_{place}" for place in range(len(docs.columns))]
    carry = {name: column(own) for name, own in zip(names, docs.columns, strict=True)}
    text, number = (names[docs.columns.index(own)] for own in ("text", "doc_id"))
    kept = exact_dedup.exact_dedup(docs, carry=carry).filter("kept")
    several = kept.filter("group_size > 1").withColumn("_text", F.coalesce(text, F.lit("")))
    several = several.dropDuplicates([number, "_text"])
    return kept.filter("group_size = 1").select(names).unionByName(several.select(names)).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest id, of equal ids any, without an id only if none has.

    Decided by row, so rows that share an id, or have none, stand for themselves. Null and empty texts are alike.
    """
    row = spare_name(docs.columns, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = stored(simhash.near_duplicates(numbered.select(row, column("text").alias("text")), row), "near-duplicates")
    several = found.filter(F.col(row) != F.col("component_id")).select("component_id").distinct()
    groups = found.join(several, "component_id", "left_semi").select(row, "component_id")
    members = groups.join(numbered.select(row, column("doc_id").alias("_id")), row)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.isnull("_id"), "_id", row)).alias("first"))
    dropped = groups.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti").select(row)
    return without(numbered, dropped, row).drop(row)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none. Each row is judged by its own text."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = spare_name(docs.columns, "_found")
    return decontamination.with_matches(docs, benchmark, found).filter(F.size(found) == 0).drop(found)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, their number and the text that the ids decode to; null and empty texts have none.

    The new columns get other names where the documents have columns of theirs.
    """
    path = tokenizer_file(TOKENIZER)
    ids, number, decoded = (spare_name(docs.columns, name) for name in ("token_ids", "n_tokens", "decoded"))
    return bpe.encode(docs, path, ids_col=ids, decoded_col=decoded).withColumn(number, F.size(ids).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenize),
]

#: Hashes, fitted models and a tokenizer's merges have no form in SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
