"""Fill-in-the-middle form of documents, with cuts located by content-defined chunks whose summaries are remembered.

A text is a sequence of units: runs of ASCII letters, and single other characters. A rolling hash over the last few
characters cuts it into chunks at places that depend on the content only, so copies and shared passages have the same
chunks. A chunk's summary (its units, and whether its first and last characters are letters) is remembered by the chunk's
own text, so a hit is verified by the content, never by the hash. Two neighbours have the sum of their units, less one if
a run of letters goes on from one to the other; running sums of that lead to the chunk that holds a cut, and only that
chunk is cut into units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import column, parts_of, spare_name, text_of

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Characters under the rolling hash (a power of two), chance of a cut as a power of two, and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 16, 7, 1024
#: Chunks that a task remembers before it starts afresh: at most some 100 characters each on average.
REMEMBERED = 1 << 16
#: Characters that are hashed at once; a longer text is hashed in blocks of this size.
BATCH_CHARS = 1 << 20


def chunk_ends(codes: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, given its code points. Equal passages get equal cuts after their first window."""
    size = len(codes)
    hashed = codes * np.uint32(0x9E3779B1)
    hashed ^= hashed >> np.uint32(15)
    width = 1
    while width < min(WINDOW, size):  # sums over twice as many characters, the older half shifted
        hashed[width:] = hashed[width:] + (hashed[: size - width] << np.uint32(width))
        width *= 2
    cuts = np.flatnonzero((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    cuts = np.concatenate([[0], cuts[(cuts >= WINDOW) & (cuts < size)], [size]])
    gaps = np.diff(cuts)
    if (gaps <= LONGEST).all():
        return cuts[1:]
    return np.concatenate(
        [np.append(np.arange(start + LONGEST, end, LONGEST), end) for start, end in zip(cuts[:-1], cuts[1:], strict=True)]
    )


class Chunks:
    """Summaries of chunks, remembered by their text: units, first and last character a letter (as bits 1 and 0)."""

    def __init__(self, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.known: dict[str, int] = {}

    def summary(self, chunk: str) -> int:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            found = (len(UNIT.findall(chunk)) << 2) | (_letter(chunk[0]) << 1) | _letter(chunk[-1])
            self.known[chunk] = found
        return found

    def measured(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ends of the chunks of a text in characters, and the number of units that begin up to each end."""
        ends: list[int] = []
        for start in range(0, len(text), BATCH_CHARS):
            block = text[start : start + BATCH_CHARS]
            codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ends.extend((chunk_ends(codes) + start).tolist())
        starts = [0, *ends[:-1]]
        summaries = np.array([self.summary(text[a:b]) for a, b in zip(starts, ends, strict=True)], dtype=np.int64)
        goes_on = (summaries[:-1] & 1) & (summaries[1:] >> 1 & 1)
        return ends, np.cumsum((summaries >> 2) - np.concatenate([[0], goes_on]))

    def cut(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """(units n, place after the smaller and after the larger of first % (n + 1) and second % (n + 1) units)."""
        if not text:
            return 0, 0, 0
        ends, units = self.measured(text)
        n = int(units[-1])
        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, self.place(text, ends, units, low), self.place(text, ends, units, high)

    @staticmethod
    def place(text: str, ends: list[int], units: np.ndarray, wanted: int) -> int:
        """Characters of the first ``wanted`` units."""
        if wanted >= units[-1]:
            return len(text)
        chunk = int(np.searchsorted(units, wanted, side="right"))  # where the unit after the cut begins
        before = int(units[chunk - 1]) if chunk else 0
        start = ends[chunk - 1] if chunk else 0
        goes_on = start > 0 and _letter(text[start - 1])  # letters here end a unit that began in an earlier chunk
        for place, unit in enumerate(UNIT.finditer(text, start, ends[chunk])):
            if place == 0 and goes_on and _letter(unit.group()[0]):
                before -= 1
                continue
            if before + place == wanted:
                return unit.start()
        raise AssertionError("the unit after a cut begins in its chunk")


def _letter(char: str) -> bool:
    return "a" <= char <= "z" or "A" <= char <= "Z"


def draws(id_col: str) -> list[Column]:
    """Four 32-bit numbers that depend on the id only; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(column(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    New columns replace columns of those names. Form ``psm`` is prefix, suffix, middle, each after its sentinel; ``spm``
    is suffix, prefix, middle; ``plain`` is the text as it is, with null sizes: for empty texts, texts that hold a
    sentinel, and ``plain_percent`` of the others. The draw depends on the id only, so repeated ids get the same draw (a
    null id that of an empty one) and a lost task repeats its result. A null text counts as empty. Whole texts are
    taken; a very long one is hashed in blocks, and its task holds some 100 bytes a chunk of 128 characters besides it.
    """

    @F.arrow_udf("struct<n: bigint, low: bigint, high: bigint>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        chunks = Chunks(remembered)  # what it remembers goes with the task
        for part in parts_of(pa.RecordBatch.from_arrays(list(batch), ["text", "first", "second"]) for batch in batches):
            found = [chunks.cut(*row) for row in zip(*(own.to_pylist() for own in part.columns), strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(values, pa.int64()) for values in zip(*found, strict=True)], ["n", "low", "high"]
            )

    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    own = [column(name) for name in docs.columns if name.lower() not in made]
    first, second, third, fourth = draws(id_col)
    text, found, form = (spare_name([*docs.columns, *made], name) for name in ("_text", "_cut", "_form"))
    low, high = F.col(f"{found}.low"), F.col(f"{found}.high")
    whole = F.col(text)
    sentinel = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | sentinel | (third % 100 >= 100 - plain_percent)
    formed = F.when(plain, F.lit("plain")).when(fourth % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    prefix, middle, suffix = (
        F.substring(whole, F.lit(1), low.cast("int")),
        F.substring(whole, (low + 1).cast("int"), (high - low).cast("int")),
        F.substring(whole, (high + 1).cast("int"), F.length(whole)),
    )
    output = (
        F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    with_text = docs.withColumn(text, text_of(text_col)).withColumn(form, formed)
    return with_text.withColumn(found, cut(whole, first, second)).select(
        *own, F.col(f"{found}.n").alias("n"), F.col(form).alias("form"),
        F.when(F.col(form) != "plain", low).alias("prefix_chars"),
        F.when(F.col(form) != "plain", high - low).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No sentinel can arise where parts meet, so each stands there once."""
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(
        F.substr(F.substring_index(front, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(front, SUFFIX, -1)
    )
    spm = F.concat(
        F.substring_index(front, PREFIX, -1), middle, F.substr(F.substring_index(front, PREFIX, 1), F.lit(len(SUFFIX) + 1))
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
