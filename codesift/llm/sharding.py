"""Sharding by minimax contiguous partition: the smallest feasible capacity, found by binary search, then greedy cuts.

Equal texts are one atomic group and groups are ordered by the digest of their text. Every group is given the number of
bytes up to its end (a running sum per block of digests plus the sums of earlier blocks). A capacity is feasible if greedily
filled shards reach the last byte; the binary search needs only the ends of groups near the cuts. The driver therefore
holds a bounded number of cells (least and greatest end, number of ends) instead of the groups: cells are wide at first,
which brackets the capacity, and are then cut finer near the possible cuts until no end there is unknown.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.common import sha256_text, stored, text_of

SHARDS = 8
#: Cells that the driver holds after each step, about.
CELLS = 1 << 15
#: Parts into which a group's rows are dealt, so that a hot group is numbered by many tasks.
SALTS = 256
#: Hexadecimal digits of the digest that name a block of the running sums.
BLOCK_DIGITS = 3


@dataclass(frozen=True)
class Cell:
    """Ends of groups between ``least`` and ``greatest``: exactly those two if ``known``, perhaps more otherwise."""

    least: int
    greatest: int
    known: bool


class Ends:
    """What the driver knows about the ordered ends of groups."""

    def __init__(self, cells: list[Cell]) -> None:
        self.cells = sorted(cells, key=lambda cell: cell.least)
        self.starts = [cell.least for cell in self.cells]

    def below(self, limit: int, hopeful: bool) -> int:
        """The greatest end up to ``limit``, 0 if none; where unknown the greatest that may be, or that surely is."""
        place = bisect_right(self.starts, limit) - 1
        if place < 0:
            return 0
        cell = self.cells[place]
        if limit >= cell.greatest:
            return cell.greatest
        return limit if hopeful and not cell.known else cell.least

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy ends of the shards under a capacity."""
        ends, end = [], 0
        for _ in range(shards):
            end = self.below(end + capacity, hopeful)
            ends.append(end)
        return ends

    def least_capacity(self, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity with which the shards hold everything."""
        total = self.cells[-1].greatest
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def spans(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of unknown cells that touch ``ranges``, with no other cell between."""
        found: list[tuple[int, int]] = []
        open_run = False
        for cell in self.cells:
            touched = not cell.known and any(cell.least <= high and low <= cell.greatest for low, high in ranges)
            if touched:
                found.append((found.pop()[0] if open_run else cell.least, cell.greatest))
            open_run = touched
        return found

    def refined(self, spans: list[tuple[int, int]], cells: list[Cell]) -> Ends:
        """With the cells inside ``spans`` replaced by ``cells``."""
        inside = lambda cell: any(low <= cell.least and cell.greatest <= high for low, high in spans)
        return Ends([cell for cell in self.cells if not inside(cell)] + cells)


def minimax_cuts(ends: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> list[int]:
    """Ends of the shards for ``ends.end`` (distinct positive longs): the smallest greatest shard, filled greedily.

    No ends give cuts of 0; if there are fewer groups than shards, or one group outweighs the rest, the last are empty.
    """
    total = ends.agg(F.max("end")).first()[0]
    if not total:
        return [0] * shards
    width = -(-total // cells)
    known = Ends(_cells(ends, width, []))
    while True:
        surely, perhaps = known.least_capacity(shards, False), known.least_capacity(shards, True)
        if perhaps == surely and known.cuts(surely, shards, True) == known.cuts(surely, shards, False):
            return known.cuts(surely, shards, False)
        lows, highs = known.cuts(perhaps, shards, False), known.cuts(surely, shards, True)
        ranges = [(low, high) for low, high in zip(lows, highs, strict=True)]
        spans = known.spans(ranges)
        if not spans:
            return known.cuts(surely, shards, False)
        widest = max(high - low + 1 for low, high in spans)
        width = max(1, min(width // 2, -(-widest // max(2, cells // len(spans)))))  # ever finer, so this ends
        known = known.refined(spans, _cells(ends, width, spans))


def _cells(ends: DataFrame, width: int, spans: list[tuple[int, int]]) -> list[Cell]:
    """Cells of ``width`` over the ends inside each of ``spans`` (everywhere if none are named)."""
    span = F.lit(0)
    if spans:
        span = F.coalesce(*[F.when(F.col("end").between(low, high), k) for k, (low, high) in enumerate(spans)])
    rows = (
        ends.withColumn("span", span).filter("span IS NOT NULL").groupBy("span", F.expr(f"end DIV {width}").alias("cell"))
        .agg(F.min("end").alias("least"), F.max("end").alias("greatest"), F.count(F.lit(1)).alias("n"))
    )
    return [Cell(row["least"], row["greatest"], row["n"] <= 2) for row in rows.collect()]


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, salts: int = SALTS,
    cells: int = CELLS,
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot and grown_shard (null under this law).

    The size of a row is the UTF-8 bytes of its text plus 1; shards have nearly equal sizes, and equal texts (a null text
    equals an empty one) stay together, which bounds how equal sizes can be. Slots number the rows of a shard from 0
    without gaps. Ids may be null or repeat; rows that repeat id and text get slots of their own in any order; an empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).select(
        "_id", (F.octet_length("_text") + F.lit(1).cast("long")).alias("size"),
        F.crc32(F.col("_text").cast("binary")).alias("text_crc32"), sha256_text(F.col("_text")).alias("digest"),
    ).withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    rows = stored(rows, "sized")
    parts = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    parts = parts.withColumn("block", F.substring("digest", 1, BLOCK_DIGITS))
    before = Window.partitionBy("block").orderBy("digest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = stored(
        parts.select(
            "*", F.coalesce(F.sum("n").over(before), zero).alias("rows_before"),
            F.coalesce(F.sum("bytes").over(before), zero).alias("bytes_before"),
        ), "running",
    )
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** BLOCK_DIGITS rows
    blocks = blocks.select(
        "block", F.coalesce(F.sum("n").over(earlier), zero).alias("block_rows"),
        F.coalesce(F.sum("bytes").over(earlier), zero).alias("block_bytes"),
    )
    placed = parts.join(F.broadcast(blocks), "block").select(
        "digest", "salt", "n", "bytes", (F.col("rows_before") + F.col("block_rows")).alias("row"),
        (F.col("bytes_before") + F.col("block_bytes")).alias("byte"),
    )
    groups = placed.groupBy("digest").agg(F.max(F.col("byte") + F.col("bytes")).alias("end"))
    groups = stored(groups, "group-ends")
    cuts = minimax_cuts(groups.select("end"), shards, cells)
    number = sum(((F.col("end") > cut).cast("int") for cut in cuts[:-1]), F.lit(0))
    placed = placed.join(groups.select("digest", number.alias("shard")), "digest")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row per shard
    placed = placed.join(F.broadcast(firsts), "shard").select(
        "digest", "salt", "shard", (F.col("row") - F.col("first")).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("_id", "size"))
    numbered = rows.withColumn("rank", rank)
    return numbered.join(placed, ["digest", "salt"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
