"""Exact deduplication by progressive refinement: length, then hash of a prefix, then hash of the whole.

Every level only looks at rows that an earlier one could not tell apart. Lengths and prefix hashes are written once, as a
narrow table, and counted there. What survives a level goes to the next as a bitmap of a fixed number of slots (hash
values), 8 MB at most whatever the input is, which may therefore be broadcast; two keys in one slot only cost a needless
look at the next level. Texts are never shuffled to be compared: the shuffles carry counts of lengths, 16-byte prefix keys
and digests. The last join is by digest and a hot group in it is split by adaptive execution, because it is a plain join of
rows with one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import sha256_text, stored, text_of

#: Slots of the bitmaps that are broadcast: 4 KB for each 32,768 of them.
SLOTS = 1 << 26
#: Characters of a text that the second level hashes.
PREFIX_CHARS = 256


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and the columns of ``carry``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest id is kept.
    Defined cases: a null id never wins against another one, and a group of null ids only keeps them all; rows that
    repeat both id and text count in group_size and share their group's fate, so all rows with the largest id are kept;
    an empty table gives an empty result; other columns of ``docs`` are neither read nor returned unless carried, and
    may have any name. ``carry`` maps names of result columns to expressions over ``docs``.
    """
    carry = carry or {}
    rows = docs.select(
        F.col(id_col).alias("_id"), text_of(text_col).alias("_text"),
        *[expression.alias(f"_carry_{name}") for name, expression in carry.items()],
    )
    carried = [f"_carry_{name}" for name in carry]
    length, prefix = F.octet_length("_text"), F.xxhash64(F.substring("_text", 1, prefix_chars))
    keys = stored(rows.select(length.alias("length"), prefix.alias("prefix")), "prefixes")
    by_length = _repeated(keys, ["length"], slots)
    by_prefix = _repeated(_marked(keys, by_length, ["length"], slots).filter("marked"), ["length", "prefix"], slots)
    sized = rows.withColumn("length", length).withColumn("prefix", prefix)
    marked = _marked(sized, by_prefix, ["length", "prefix"], slots)  # a slot of repeated lengths is in its keys already
    suspects = marked.filter("marked").select("_id", sha256_text(F.col("_text")).alias("digest"), *carried)
    groups = stored(  # a table of its own, so that the join below is one that adaptive execution may split
        suspects.groupBy("digest")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"), "copies",
    )
    judged = suspects.join(groups, "digest", "left").select(
        "_id", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), *carried,
    )
    single = marked.filter("NOT marked").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carried
    )
    judged = judged.unionByName(single)
    return judged.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col(f"_carry_{name}").alias(name) for name in carry],
    )


def _place(columns: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)) + 1


def _repeated(keys: DataFrame, columns: list[str], slots: int) -> DataFrame:
    """(bucket, map): a bit for every slot of a key that occurs more than once; at most ``slots`` / 32,768 rows of 4 KB."""
    several = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    place = _place(columns, slots)
    return stored(
        several.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")), "repeated",
    )


def _marked(rows: DataFrame, repeated: DataFrame, columns: list[str], slots: int) -> DataFrame:
    """``rows`` with ``marked``: whether the slot of their key is set."""
    place = _place(columns, slots)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("map"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    at = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(repeated), "bucket", "left")
    return at.withColumn("marked", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("map", "bucket")
