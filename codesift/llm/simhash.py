"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, compared exactly in tiles.

Equal fingerprints are one node, whatever the number of their documents. The distinct fingerprints are dealt to tiles by
population count (and by hash within a count, so that tiles have a bounded size). Two fingerprints within ``radius`` bits
differ by at most ``radius`` in population count, so only tiles of such counts are paired; every such pair of tiles is
compared in full with numpy exclusive-or and bit counts. A pair of tiles returns a spanning forest of its links (at most one
link per fingerprint), so a large group of near copies does not yield all its pairs. Components of the forests are those of
all links.

The work of the comparison grows with the square of the number of distinct fingerprints, divided by what the population
counts exclude; that is the price of a method without a chance of a miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import parts_of, stored
from codesift.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a tile, about.
TILE = 1 << 14
#: Rows of one side that are compared with the other side at a time.
BLOCK = 1 << 8


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; 0 for texts without words, null included.

    Letters A to Z are lowered and words are what blanks (space, tab to carriage return) part; shingles of ``words``
    words count as often as they occur, and a shorter text is one shingle. A bit is 1 if more than half of the hashes
    have it.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)],
        dtype=np.uint64, count=len(starts),
    )
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed long column."""

    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            values = np.array([fingerprint_of(text, words, seed) for text in part.to_pylist()], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return made(F.col(text_col))


def spanning(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one found with it): a forest that connects what links within ``radius`` bits connect."""
    values = np.unique(np.concatenate([left, right]))
    left_at, right_at = np.searchsorted(values, left), np.searchsorted(values, right)
    root = np.arange(len(values))
    for first in range(0, len(left), BLOCK):
        rows = left[first : first + BLOCK]
        near = np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        _unite(root, left_at[first + i], right_at[j])
    joined = np.flatnonzero(root != np.arange(len(values)))
    return values[joined], values[root[joined]]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of every a[k] and b[k]; ``root`` names the smallest member and is flat before and after."""
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root[:] = further


def links_between(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``prints.fingerprint`` within ``radius`` bits.

    ``prints`` holds distinct fingerprints (signed longs).
    """
    spark = prints.sparkSession
    counted = prints.select("fingerprint", F.bit_count("fingerprint").alias("bits"))
    sizes = {row["bits"]: row["n"] for row in counted.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65
    parts = {bits: -(-n // tile) for bits, n in sizes.items()}
    tiles = (
        counted.withColumn("parts", _lookup("bits", parts))
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
        .groupBy("bits", "part").agg(F.collect_list("fingerprint").alias("prints"))  # about ``tile`` each
    )
    tiles = stored(tiles, "tiles")
    lefts = (  # every tile once for each tile it is compared with, by number
        tiles.withColumnRenamed("prints", "left")
        .withColumn("near", F.explode(F.sequence("bits", F.col("bits") + radius)))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), _lookup("near", parts) - 1)))
        .filter("near > bits OR partner >= part")
        .select("left", F.col("near").alias("bits"), F.col("partner").alias("part"))
    )
    pairs = lefts.join(tiles.withColumnRenamed("prints", "right"), ["bits", "part"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (
                    batch.column(place)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for place in (0, 1)
                )
                a, b = spanning(left, right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.select("left", "right").mapInArrow(compared, "a long, b long")


def _lookup(column: str, values: dict[int, int]) -> Column:
    """A small fixed table (at most 65 entries) as an expression."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None).cast("int")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Fingerprints link at ``radius`` or fewer differing bits. Texts without words (null, empty, blank) have fingerprint
    zero and are linked like any other. A null id has a fingerprint and a component but never names one; a component of
    null ids only has a null component_id. Rows may repeat; an empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    prints = stored(
        docs.select(F.col(id_col).alias("_id"), fingerprint(text_col, words).alias("fingerprint")), "fingerprints"
    )
    firsts = stored(prints.groupBy("fingerprint").agg(F.min("_id").alias("first")), "distinct-fingerprints")
    found = components(links_between(firsts.select("fingerprint"), radius, tile)).withColumnRenamed("node", "fingerprint")
    rooted = firsts.join(found, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id",
    )
