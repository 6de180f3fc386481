"""Substring deduplication: every word in a window of words that also starts in an earlier document is removed.

1. Every window has an anchor: the smallest hash among its shingles of ``SHINGLE`` words. Equal windows have equal anchors,
   so only windows whose anchor occurs in two documents can repeat. Spark counts anchors per document; the repeated ones go
   to the tasks as a bitmap of fixed size (a shared slot only adds a candidate).
2. Neighbouring windows with the same anchor are a run. Runs of candidates are counted without their words: of runs with the
   same words one is looked at, that of the smallest document.
3. These runs are dealt by anchor to shards of a bounded number of words. A shard builds a compressed FM-index (wavelet
   matrix over the Burrows-Wheeler transform) of its runs and streams them through backward search; a window whose matching
   statistic reaches the window's length gets the smallest document that has it. An anchor in very many documents would fill
   a shard alone; its windows count as runs of one window each, which are dealt by their words.
4. The results go back to all runs, from there as intervals to their documents. Only documents with intervals are shuffled.

Words of up to seven bytes are compared as they are, longer ones by XXH64, and runs by a 64-bit hash that mixes at every
step, so no arrangement of words cancels out. A task holds some 50 bytes a character of the text it works on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import bitmap, in_batches, in_bitmap, parts, parts_of, stored, text_of
from codesift.llm.fm_index import FMIndex, earliest_owners
from codesift.llm.words import mixed, words_of

WINDOW = 50
SHINGLE = 8
#: Windows of a run at most; a longer run is cut.
RUN = 128
#: Words of a shard, about.
SHARD_WORDS = 1 << 18
#: Occurrences from which an anchor's windows are dealt by their words.
HOT = 4096
#: Slots of the bitmap of such anchors, which are few.
CROWDED_BITS = 20
BATCH_CHARS = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(hashes: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """For every window of words the smallest hash of its shingles (windows may cross texts; callers leave those out)."""
    shingles = _folded(hashes, shingle, lambda left, right: mixed(left * _A + right * _B))
    return _folded(shingles, window - shingle + 1, np.minimum, overlap=True)


def _folded(values: np.ndarray, size: int, join, overlap: bool = False) -> np.ndarray:
    """``join`` over every stretch of ``size`` values, by doubling; ``overlap`` if values may count twice."""
    spans = {1: values}
    span = 1
    while span * 2 <= size:
        spans[span * 2] = join(spans[span][:-span], spans[span][span:])
        span *= 2
    if span == size:
        return spans[span]
    if overlap:
        return join(spans[span][: -(size - span)], spans[span][size - span :])
    rest = _folded(values, size - span, join)
    return join(spans[span][: len(values) - size + 1], rest[span : span + len(values) - size + 1])


class Runs:
    """The runs of windows with the same anchor in a batch of texts."""

    def __init__(self, texts: list[str], window: int, shingle: int, hot: bytes | None = None) -> None:
        words = words_of(texts)
        self.hashes, self.first = words.hashes, words.first
        empty = np.zeros(0, dtype=np.int64)
        self.text = self.start = self.windows = empty
        self.lengths = empty
        self.anchor = np.zeros(0, dtype=np.uint64)
        if len(self.hashes) < window:
            return
        least = anchors(self.hashes, window, shingle)
        text = words.text
        count = len(least)
        inside = text[:count] == text[window - 1 : window - 1 + count]
        changed = (least[1:] != least[:-1]) | (text[1:count] != text[: count - 1])
        fresh = np.concatenate([[True], changed])
        if hot is not None:
            fresh |= in_bitmap(hot, least)
        number = np.cumsum(fresh) - 1
        since = np.arange(count) - np.flatnonzero(fresh)[number]
        fresh |= since % RUN == 0
        begins = np.flatnonzero(fresh & inside)
        stops = np.append(np.flatnonzero(fresh | ~inside), count)
        self.windows = stops[np.searchsorted(stops, begins, side="right")] - begins
        self.anchor, self.text, self.start = least[begins], text[begins], begins
        self.lengths = self.windows + window - 1

    def keys(self, on: np.ndarray) -> np.ndarray:
        """A hash of all words of some runs, in order: two stretches of a power of two words that cover a run."""
        found = np.zeros(len(on), dtype=np.uint64)
        if not len(on):
            return found
        begins, lengths = self.start[on], self.lengths[on]
        level = np.frexp(lengths.astype(float))[1] - 1  # floor of the logarithm
        stretches, size = self.hashes, 1
        for power in range(int(level.max()) + 1):
            some = np.flatnonzero(level == power)
            left, right = stretches[begins[some]], stretches[begins[some] + lengths[some] - size]
            found[some] = mixed(mixed(left * _A + right * _B) + lengths[some].astype(np.uint64))
            if 2 * size > len(self.hashes):
                break
            stretches, size = mixed(stretches[:-size] * _A + mixed(stretches[size:]) * _B), 2 * size
        return found

    def place(self, on: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A hash of where some runs stand: document, text and word."""
        text = self.text[on]
        begins = (self.start[on] - self.first[text]).astype(np.uint64)
        return mixed(mixed(doc[text].view(np.uint64) * _A + key[text].view(np.uint64)) + begins).view(np.int64)


def removed_intervals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
    shard_words: int = SHARD_WORDS, hot: int = HOT,
) -> DataFrame:
    """(doc, text_key, intervals): the words to remove, from start to before end, for documents that have any.

    ``text_key`` is the hash of the text, which tells apart documents that share an id.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )

    def batches_of(batches: Iterator[pa.RecordBatch], hot_map: bytes | None = None):
        for batch in parts_of(batches):
            doc, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            strings = batch.column(2).to_pylist()
            for first, end in in_batches(strings, BATCH_CHARS):
                yield doc[first:end], key[first:end], Runs(strings[first:end], window, shingle, hot_map)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, runs in batches_of(batches):
            order, first = _grouped(runs.text, runs.anchor)
            once = order[first]  # one row per anchor and document
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.anchor[once].view(np.int64)), pa.array(doc[runs.text[once]])], ["anchor", "doc"]
            )

    seen = stored(
        texts.mapInArrow(anchored, "anchor long, doc long").groupBy("anchor")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
        .filter("least < most").select("anchor", "n"), "anchors",
    )
    repeated = context.broadcast(bitmap(seen, "anchor"))
    crowded = context.broadcast(bitmap(seen.filter(F.col("n") > hot), "anchor", CROWDED_BITS))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, key, found in batches_of(batches, crowded.value):
            on = np.flatnonzero(in_bitmap(repeated.value, found.anchor))
            keys = found.keys(on)
            order, first = _grouped(found.text[on], keys)
            on, keys = on[order], keys[order]  # equal runs of a document are one row with their starts
            text = found.text[on]
            starts = (found.start[on] - found.first[text]).astype(np.int32)
            one, run, text = on[first], keys[first], text[first]
            columns = [
                doc[text], key[text], run.view(np.int64), found.place(one, doc, key),
                found.windows[one].astype(np.int32),
            ]
            offsets = pa.array(np.append(first, len(on)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pa.array(starts))], RUN_COLUMNS
            )

    runs = stored(
        texts.mapInArrow(
            candidates, "doc long, text_key long, run long, place long, windows int, starts array<int>"
        ), "runs",
    )
    distinct = stored(
        runs.groupBy("run").agg(F.min("doc"), F.min_by("place", "doc").alias("place"), F.max("windows").alias("windows")),
        "distinct-runs",
    )
    size = distinct.agg(F.sum(F.col("windows") + F.lit(window - 1))).first()[0] or 0
    shards = max(1, -(-size // shard_words))
    wanted = context.broadcast(bitmap(distinct, "place"))

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, key, found in batches_of(batches, crowded.value):
            on = np.flatnonzero(in_bitmap(repeated.value, found.anchor))
            on = on[in_bitmap(wanted.value, found.place(on, doc, key))]
            lengths = found.windows[on] + window - 1
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.repeat(found.start[on] - offsets[:-1], lengths) + np.arange(offsets[-1])
            hot_here = in_bitmap(crowded.value, found.anchor[on])
            run = found.keys(on)
            dealt = mixed(np.where(hot_here, run, found.anchor[on])) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(dealt.astype(np.int32)), pa.array(run.view(np.int64)),
                    pa.array(doc[found.text[on]]),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(found.hashes[flat].view(np.int64))
                    ),
                ], ["shard", "run", "doc", "words"],
            )

    def indexed(rows: pa.Table) -> pa.Table:
        run, doc = (rows.column(name).to_numpy() for name in ("run", "doc"))
        order = np.lexsort((doc, run))
        order = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])]
        words, offsets = _flat(rows.column("words").combine_chunks())
        words = words.view(np.uint64)
        sequences = [words[offsets[k] : offsets[k + 1]] for k in order]
        found = earliest_owners(FMIndex(sequences, doc[order]), sequences, window)
        sizes = np.concatenate([[0], np.cumsum([len(owners) for owners in found])]).astype(np.int32)
        owners = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found)))
        return pa.Table.from_arrays([pa.array(run[order]), owners], ["run", "owners"])

    earliest = (
        texts.mapInArrow(worded, "shard int, run long, doc long, words array<long>")
        .groupBy("shard").applyInArrow(indexed, "run long, owners array<long>")
    )

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            (starts, start_of), (owners, owner_of) = (_flat(batch.column(k)) for k in (2, 3))
            low, high = owner_of[:-1], owner_of[1:]
            repeats = np.diff(start_of)
            row = np.repeat(np.arange(len(doc)), repeats)  # one for each start, then one for each of its windows
            sizes = (high - low)[row]
            each = np.repeat(np.arange(len(row)), sizes)
            offset = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            row = row[each]
            begins = starts[each] + offset
            on = np.flatnonzero(owners[low[row] + offset] < doc[row])
            on = on[np.lexsort((begins[on], row[on]))]
            fresh = np.concatenate([[True], (row[on][1:] != row[on][:-1]) | (begins[on][1:] > begins[on][:-1] + window)])
            opens = np.flatnonzero(fresh[: len(on)])
            closes = np.append(opens[1:], len(on))[: len(opens)] - 1
            picked = pa.array(row[on][opens])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(picked), batch.column(1).take(picked),
                    pa.array(begins[on][opens].astype(np.int32)), pa.array((begins[on][closes] + window).astype(np.int32)),
                ], ["doc", "text_key", "start", "end"],
            )

    return (
        runs.join(earliest, "run").select("doc", "text_key", "starts", "owners")
        .mapInArrow(covered, "doc long, text_key long, start int, end int")
        .groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("intervals"))
    )


RUN_COLUMNS = ["doc", "text_key", "run", "place", "windows", "starts"]


def _grouped(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by text and key that keeps equal ones as they come, and where each new pair begins in it."""
    order = np.lexsort((key, text))
    fresh = np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (key[order][1:] != key[order][:-1])])
    return order, np.flatnonzero(fresh[: len(order)])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, from 0."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
    shard_words: int = SHARD_WORDS, hot: int = HOT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed and kept (the words left, joined by one blank).

    A word is removed if a window of ``window`` consecutive words that covers it also starts in a document with a smaller
    id; windows are those of the input. Words are what blanks part, unchanged. Null, empty and blank texts have no words,
    texts shorter than a window lose none. A row without id, and rows that share an id, lose nothing to each other; an
    empty table gives an empty result; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    intervals = stored(removed_intervals(docs, id_col, text_col, window, shingle, shard_words, hot), "intervals")
    place = F.xxhash64("doc", "text_key")
    concerned = context.broadcast(bitmap(intervals.select(place.alias("place")), "place"))

    @F.arrow_udf("boolean")
    def has_intervals(places: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(concerned.value, places.to_numpy(zero_copy_only=False)))

    result = "struct<n_words: bigint, n_removed: bigint, kept: string>"

    @F.arrow_udf(result)
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            for text, own in zip(parts(texts), parts(spans), strict=True):
                yield _kept_words(text.to_pylist(), own.to_pylist())

    @F.arrow_udf(result)
    def untouched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Null for texts that may have intervals."""
        for texts, places in batches:
            for text, place in zip(parts(texts), parts(places), strict=True):
                left_out = in_bitmap(concerned.value, place.to_numpy(zero_copy_only=False)).tolist()
                strings = [None if out else own for own, out in zip(text.to_pylist(), left_out, strict=True)]
                yield _kept_words(strings, [None] * len(strings))

    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"),
        text_of(text_col).alias("_text"),
    )
    once = untouched.asNondeterministic()  # else the filter and the result would each compute it
    whole = rows.select("_id", once(F.col("_text"), place).alias("r")).filter("r IS NOT NULL")
    cut = rows.filter(has_intervals(place)).join(intervals, ["doc", "text_key"], "left").select(
        "_id", cleaned("_text", "intervals").alias("r")
    )
    return whole.unionByName(cut).select(F.col("_id").alias(id_col), "r.*")


def _kept_words(texts: list[str | None], spans: list[list[dict] | None]) -> pa.Array:
    rows: list[dict | None] = []
    for text, own in zip(texts, spans, strict=True):
        if text is None:
            rows.append(None)
            continue
        words = text.encode("utf-8").split()
        count = len(words)
        if own:
            stays = np.ones(count, dtype=bool)
            for span in own:
                stays[span["start"] : span["end"]] = False
            words = [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
        rows.append({"n_words": count, "n_removed": count - len(words), "kept": b" ".join(words).decode("utf-8")})
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))
