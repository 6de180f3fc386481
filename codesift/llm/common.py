"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import new_table_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_col: str) -> Column:
    """True for the quarter of ids kept from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(id_col: str) -> Column:
    """Rows that may be learned from: those with an id that is not held out."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def sha256_text(column: Column) -> Column:
    """Lowercase hex of the UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def slot(*columns: str, slots: int) -> Column:
    """Which of a fixed number of slots a key falls into; a table of slots has a known bound."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots))


def in_batches(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` characters, a longer text alone."""
    start, held = 0, 0
    for place, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, place
            start, held = place, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def parts(batch, rows: int = 256) -> Iterator:
    """An Arrow array or batch in slices of a few rows, so that little of it is held as Python objects at a time."""
    for first in range(0, len(batch) if isinstance(batch, pa.Array) else batch.num_rows, rows):
        yield batch.slice(first, rows)


def parts_of(batches: Iterator) -> Iterator:
    """The parts of all batches; at the end Arrow gives back what it holds, as a worker goes on to other tasks."""
    for batch in batches:
        yield from parts(batch)
    pa.default_memory_pool().release_unused()


def spare_name(columns: list[str], name: str) -> str:
    """A column name that ``columns`` don't have, whatever their case."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: computed once, and safe from lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a slot number in a bitmap: 8 MB on the driver and in every worker, whatever the input.
BITMAP_BITS = 26


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> bytes:
    """A bit for every slot that a long key of ``keys`` falls into. Its size is fixed; keys may share a slot."""
    place = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    rows = (
        keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()  # 4 KB for 32768 slots
    )
    whole = bytearray(1 << (bits - 3))
    for row in rows:
        first = (row["bucket"] - 1) * 4096
        whole[first : first + len(row["map"])] = row["map"]
    return bytes(whole)


def in_bitmap(whole: bytes, keys: np.ndarray) -> np.ndarray:
    """For every 64-bit key whether its slot's bit is set."""
    slots = keys.view(np.uint64) & np.uint64(len(whole) * 8 - 1)
    bits = np.frombuffer(whole, dtype=np.uint8)[(slots >> np.uint64(3)).astype(np.int64)]
    return (bits >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one column). Rows without id stay.

    Only rows whose id may be in the list, by a bitmap of fixed size, are joined with it; all others go straight through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(ids.columns[0]).alias("key")), "key"))

    @F.arrow_udf("boolean")
    def may_be(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, keys.to_numpy(zero_copy_only=False)))

    listed = may_be(F.xxhash64(column(id_col)))
    name = spare_name(docs.columns, "_listed")
    some = docs.filter(listed).join(ids.toDF(name), column(id_col) == F.col(name), "left_anti")
    return docs.filter(~listed).unionByName(some)
