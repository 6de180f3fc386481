"""Token counts without token ids: count the pieces of every distinct pre-token once, then join and sum.

The dictionary of distinct pre-tokens is made and counted by Spark. The most frequent entries, of which the number and the
length are bounded, go to all executors as a broadcast and cover most of every document; a document's other pre-tokens are
joined with the whole dictionary by an ordinary shuffle. Since the frequent ones never enter that shuffle, no key in it is
hot. Frequencies are per document, so a repeated pre-token travels once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import parts_of, stored, text_of
from codesift.llm.pretokens import pre_tokenizer

#: Entries of the broadcast part of the dictionary, and the longest one in characters.
FREQUENT = 1 << 17
FREQUENT_CHARS = 48
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000


def dictionary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(token, n, pieces): every distinct pre-token of all texts, how often it occurs, and its number of tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(tokenizer_path).split
        held: Counter[str] = Counter()
        for part in parts_of(batches):
            for text in part.column(0).to_pylist():
                held.update(split(text))
            if len(held) > HELD:
                yield _counts(held)
                held = Counter()
        yield _counts(held)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pre_tokenizer(tokenizer_path).ids
        for batch in batches:
            sizes = pa.array([len(ids(token)) for token in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], ["token", "n", "pieces"])

    texts = docs.select(text_of(text_col).alias("text"))
    return (
        texts.mapInArrow(counted, "token string, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
        .mapInArrow(measured, "token string, n long, pieces int")
    )


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"]
    )


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8) and n_tokens, as the file's tokenizer counts without adding any.

    Null texts count as empty: 0 bytes, 0 tokens. Ids may be null or repeat, every row is counted for itself; an empty
    table gives an empty result; other columns are not read. Whole texts are counted, without truncation.
    """
    spark = docs.sparkSession
    pieces = stored(dictionary(docs, tokenizer_path, text_col), "token-dictionary")
    short = pieces.filter(F.length("token") <= FREQUENT_CHARS).withColumn("class", F.floor(8 * F.log2("n")))
    least, held = math.inf, 0  # the classes of frequency from the top that fit
    for row in sorted(short.groupBy("class").count().collect(), reverse=True):  # a few hundred classes
        held += row["count"]
        if held > frequent:
            break
        least = row["class"]
    top = short.filter(F.col("class") >= least).select("token", "pieces").collect()  # at most ``frequent`` rows
    shared = spark.sparkContext.broadcast(dict(map(tuple, top)))

    @F.arrow_udf("struct<known: bigint, tokens: array<string>, numbers: array<int>>")
    def frequencies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, known = pre_tokenizer(tokenizer_path).split, shared.value
        for part in parts_of(batches):
            totals, tokens, numbers = [], [], []
            for text in part.to_pylist():
                total, rest, times = 0, [], []
                for token, n in Counter(split(text)).items():
                    size = known.get(token)
                    if size is None:
                        rest.append(token)
                        times.append(n)
                    else:
                        total += n * size
                totals.append(total)
                tokens.append(rest)
                numbers.append(times)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(totals, pa.int64()), pa.array(tokens, pa.list_(pa.string())),
                    pa.array(numbers, pa.list_(pa.int32())),
                ], ["known", "tokens", "numbers"],
            )

    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"),
        ).select(
            "_row", "_id", F.octet_length("_text").cast("long").alias("n_bytes"), frequencies("_text").alias("f"),
        ).select("_row", "_id", "n_bytes", "f.*"),
        "token-frequencies",
    )
    rare = (
        rows.select("_row", F.explode(F.arrays_zip("tokens", "numbers")).alias("f"))
        .select("_row", F.col("f.tokens").alias("token"), F.col("f.numbers").alias("times"))
        .join(pieces.select("token", "pieces"), "token")
        .groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    )
    return rows.drop("tokens", "numbers").join(rare, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes",
        (F.col("known") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_tokens"),
    )
