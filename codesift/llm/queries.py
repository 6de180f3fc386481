"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import (
    alignment, bpe, decontamination, exact_dedup, fill_in_middle, language_id, license_scan, sharding, simhash,
    substring_dedup, token_counts, toxicity, url_filter,
)
from codesift.llm.common import held_out, may_learn, sha256_text, table, text_of

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 1024
URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(may_learn("doc_id")))
    predicted = docs.select("doc_id", held_out("doc_id").alias("held_out"), language_id.predict(docs, model).alias("p"))
    return predicted.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, carry={"text_sha256": sha256_text(text_of("text"))})


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, decoded_col="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(may_learn("doc_id"))
    model = toxicity.learn(docs, labels)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept")).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = scanned.select("doc_id", "n_words", license_scan.base_places().alias("base"), license_scan.labelled().alias("all"))
    starts = F.transform("base", lambda place: place["first"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), license_scan.names(F.col("base")).alias("base_labels"),
        license_scan.names(F.col("all")).alias("labels"), license_scan.confidence(F.col("all")).alias("score"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_text(F.col("output")).alias("output_sha256"),
        sha256_text(again).alias("restored_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(sha256_text(F.col("groups")))
    return alignment.align(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), carry={"groups_sha256": digest},
    )


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_license_scan": op11_license_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS content
            FROM words, unnest(range(1, len(w) - 48)) AS r(i)
        ), firsts AS (
            SELECT content, min(doc_id) AS first FROM windows GROUP BY content
        ), covered AS (
            SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN firsts USING (content), range(0, 50) AS r(k)
            WHERE first < doc_id
        ), each_word AS (
            SELECT doc_id, place, w[place] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(place)
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
            FROM each_word ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op12_fill_in_middle": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
            FROM documents
        ), drawn AS (
            SELECT *, len(u) AS n, ('0x' || hex[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || hex[9:16])::BIGINT % (len(u) + 1) AS b,
                ('0x' || hex[17:24])::BIGINT % 100 AS c, ('0x' || hex[25:32])::BIGINT % 100 AS d
            FROM units
        ), cut AS (
            SELECT doc_id, n, text, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix,
                coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
                coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90
                    THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM cut
    """,
}
