"""Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies are counted over all documents in a fixed number of hashed terms. The benchmark's passages
become TF-IDF rows, and a randomised singular value decomposition of that matrix, computed by Spark in passes over its rows
(partial products are added up per term), gives the latent space. Every document is cut into overlapping windows, as long
as the items they are compared with. A candidate is confirmed by the longest common subsequence of words around the window:
nearly the whole item, or most of it together with its answer (the item's last words), which is how paraphrases are told
from chance.

That rule says where it is of no use to look: an item of n words needs 0.6 n of them around a window, so of its rarest
0.4 n + t words at least t must stand there. Only windows that see so many marked words of some item are projected and
compared, with those items; however rare the foreign words are, no window that an item could be confirmed
at is passed over, and no item that it could not confirm is compared. Items of fewer words than the shortest window are found by their exact sequence of words.

The items are the query set, which all documents are searched for: executors hold a block of a bounded number at a time,
one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import column, in_batches, parts_of, spare_name, stored
from codesift.llm.words import PUNCTUATION, words_of

#: Hashed terms.
TERMS = 1 << 16
#: Dimensions of the latent space, and how many more the random projection uses.
RANK, EXTRA = 96, 8
#: Passes of the power iteration.
PASSES = 2
#: Window lengths in words; an item is compared with windows of the longest one that is not longer than itself.
LENGTHS = (4, 8, 16, 32, 64)
#: Least cosine in the latent space.
LEAST_COSINE = 0.5
#: Share of an item's words in the common subsequence that confirms it alone, or together with its answer.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Share of an item's last words that count as its answer.
ANSWER_SHARE = 0.25
#: Marked words of an item that must stand around a window (fewer for short items).
MARKS = 4
#: Items that executors hold at a time.
ITEMS = 20_000
#: Characters of text handled at a time, and pairs of windows and items compared at a time.
BATCH_CHARS = 1 << 18
WINDOWS = 1 << 9


def normal_words(texts: list[str | None]):
    """Words of lowered texts, parted by anything in ASCII but letters and digits."""
    return words_of([(text or "").lower() for text in texts], PUNCTUATION)


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log((documents + 1) / (documents with the term + 0.5)) for every term, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(TERMS, dtype=np.int64), 0
        for part in parts_of(batches):
            texts = [text or "" for text in part.column(0).to_pylist()]
            rows += len(texts)
            for first, end in in_batches(texts, BATCH_CHARS):
                words = normal_words(texts[first:end])
                pairs = np.unique(words.text * TERMS + terms_of(words.hashes))
                held += np.bincount(pairs % TERMS, minlength=TERMS)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(held[there], rows), pa.int64())], ["term", "n"]
        )

    rows = (
        docs.select(F.col(text_col)).mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        .collect()  # one row per term
    )
    counts, total = np.zeros(TERMS), 0
    for row in rows:
        if row["term"] < 0:
            total = row["n"]
        else:
            counts[row["term"]] = row["n"]
    return np.maximum(np.log((total + 1.0) / (counts + 0.5)), 0.05).astype(np.float32)


def svd(passages: DataFrame, rank: int = RANK, extra: int = EXTRA, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(terms, vectors): right singular vectors of the matrix whose sparse rows are ``passages`` (terms, weights).

    ``vectors`` has one row per term that occurs (at most ``TERMS``) and at most ``rank`` columns. Each pass multiplies
    the rows with the current basis where they are and adds up the products per term.
    """
    spark = passages.sparkSession
    width = rank + extra
    basis = np.random.default_rng(20).standard_normal((TERMS, width)).astype(np.float32)
    there = np.zeros(0, dtype=np.int64)
    for step in range(passes + 1):
        shared = spark.sparkContext.broadcast(basis)

        def product(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for terms, weights in zip(batch["terms"], batch["weights"], strict=True):
                    along = weights @ shared.value[terms]
                    for term, weight in zip(terms, weights, strict=True):
                        held[term] = held.get(term, 0.0) + weight * along
            if held:
                yield pd.DataFrame({"term": np.fromiter(held, dtype=np.int64, count=len(held)), "sums": list(held.values())})

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for term, sums in zip(batch["term"], batch["sums"], strict=True):
                    held[term] = held.get(term, 0.0) + sums
            if held:
                yield pd.DataFrame({"term": np.fromiter(held, dtype=np.int64, count=len(held)), "sums": list(held.values())})

        schema = "term long, sums array<double>"
        rows = passages.mapInPandas(product, schema).repartition("term").mapInPandas(added, schema).collect()
        if not rows:
            return there, np.zeros((0, 0), dtype=np.float32)
        there = np.array([row["term"] for row in rows])
        image = np.array([row["sums"] for row in rows], dtype=float)
        shared.unpersist()
        if step == passes:
            break
        basis = np.zeros((TERMS, width), dtype=np.float32)
        found = np.linalg.qr(image)[0]
        basis[there, : found.shape[1]] = found
    # image = (A'A) basis on the terms that occur; its projection on the basis has the squared singular values
    inner = basis[there].astype(float)
    values, turn = np.linalg.eigh((inner.T @ image + image.T @ inner) / 2)
    best = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-8 * max(values.max(), 1e-30)]
    return there, (inner @ turn[:, best]).astype(np.float32)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, word hashes, lengths of their windows, unit vectors in the latent space."""

    ids: np.ndarray
    words: list[np.ndarray]
    lengths: np.ndarray
    vectors: np.ndarray


@dataclass(frozen=True)
class Space:
    """Inverse frequencies, the rows of the latent space (by term; -1 for terms without one) and its vectors."""

    inverse: np.ndarray
    row: np.ndarray
    vectors: np.ndarray


def fit_space(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str) -> Space:
    inverse = inverse_frequencies(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(inverse)

    def weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            words = normal_words(list(batch[item_text_col]))
            for k in range(len(batch)):
                terms, times = np.unique(terms_of(words.hashes[words.first[k] : words.first[k + 1]]), return_counts=True)
                weights = times * shared.value[terms].astype(float)
                size = np.sqrt((weights**2).sum()) or 1.0
                rows.append((terms, weights / size))
            if rows:
                yield pd.DataFrame(rows, columns=["terms", "weights"])

    passages = benchmark.select(item_text_col).mapInPandas(weighted, "terms array<long>, weights array<double>")
    there, vectors = svd(stored(passages.filter(F.size("terms") > 0), "passages"))
    row = np.full(TERMS, -1, dtype=np.int32)
    row[there] = np.arange(len(there))
    return Space(inverse, row, vectors)


def item_blocks(benchmark: DataFrame, space: Space, id_col: str, text_col: str, size: int = ITEMS) -> Iterator[Items]:
    """The items in blocks of about ``size``; equal items are spread by a number of their own."""
    numbered = stored(
        benchmark.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("number")
        ).dropna(), "items",
    )
    blocks = max(1, -(-numbered.count() // size))
    for block in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        words = normal_words([row["text"] for row in rows])
        each = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
        usable = [k for k in range(len(rows)) if len(each[k])]
        if not usable:
            continue
        vectors = np.stack([_projected(each[k], space) for k in usable])
        lengths = [max((length for length in LENGTHS if length <= len(each[k])), default=0) for k in usable]
        yield Items(np.array([rows[k]["id"] for k in usable]), [each[k] for k in usable], np.array(lengths), vectors)


def _projected(hashes: np.ndarray, space: Space) -> np.ndarray:
    terms = terms_of(hashes)
    rows = space.row[terms]
    inside = rows >= 0
    vector = space.inverse[terms[inside]] @ space.vectors[rows[inside]]
    return vector / (np.linalg.norm(vector) or 1.0)


def common_subsequence(positions: dict[int, int], words: list[int]) -> int:
    """Bits of the item's words that a longest common subsequence with ``words`` can use (bit-parallel).

    ``positions`` maps a word to the bits at which it stands in the item. The number of set bits of the result within the
    first k bits is the length of the longest common subsequence with the item's first k words.
    """
    state = 0
    for word in words:
        match = positions.get(word)
        if match:
            joined = state | match
            state = joined & ~(joined - ((state << 1) | 1))
    return state


def _positions(words: np.ndarray) -> dict[int, int]:
    found: dict[int, int] = {}
    for place, word in enumerate(words.tolist()):
        found[word] = found.get(word, 0) | (1 << place)
    return found


class Searcher:
    """Searches texts for one block of items."""

    def __init__(self, space: Space, items: Items) -> None:
        self.space, self.items = space, items
        self.lengths = sorted(set(items.lengths.tolist()) - {0})
        self.vectors = items.vectors.astype(np.float32)
        self.positions = [_positions(words) for words in items.words]
        self.answers = [_positions(words[len(words) - self.answer_size(words) :]) for words in items.words]
        self.sizes = np.array([len(words) for words in items.words])
        self.needed = np.zeros(len(items.words), dtype=np.int64)
        self.exact: dict[tuple[int, ...], list[int]] = {}
        marks: list[tuple[int, int]] = []
        for item, words in enumerate(items.words):
            if not items.lengths[item]:
                self.exact.setdefault(tuple(words.tolist()), []).append(item)
                continue
            least = int(np.ceil(PARAPHRASE * len(words) - 1e-9))
            self.needed[item] = min(MARKS, least)
            rarest = np.argsort(-space.inverse[terms_of(words)], kind="stable")[: len(words) - least + self.needed[item]]
            marks.extend((word, item) for word in words[rarest].tolist())
        marks.sort()
        self.mark_items = np.array([item for _, item in marks], dtype=np.int64)
        self.mark_words, first = np.unique(np.array([word for word, _ in marks], dtype=np.uint64), return_index=True)
        self.mark_first = np.append(first, len(marks))
        self.mark_terms = np.zeros(TERMS, dtype=bool)
        self.mark_terms[terms_of(self.mark_words)] = True

    @staticmethod
    def answer_size(words: np.ndarray) -> int:
        return max(1, round(ANSWER_SHARE * len(words)))

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float]]]:
        """For every text the (item number, cosine, share of common words) of the items found in it."""
        found: list[list[tuple[int, float, float]]] = [[] for _ in texts]
        words = normal_words(texts)
        if not len(words.hashes):
            return found
        terms = terms_of(words.hashes)
        rows = self.space.row[terms]
        inside = np.concatenate([[0], np.cumsum(rows >= 0)])
        sizes = np.diff(words.first)
        self.find_exact(words, found)
        clusters = self.clusters(words, terms)
        for length in self.lengths:
            own = self.items.lengths[clusters[0]] == length
            if not own.any():
                continue
            step = max(1, length // 4)
            counts = np.where(sizes >= length // 2, 1 + np.maximum(sizes - length + step - 1, 0) // step, 0)
            text = np.repeat(np.arange(len(texts)), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = words.first[text] + np.minimum(place * step, np.maximum(sizes[text] - length, 0))
            ends = np.minimum(starts + length, words.first[text + 1])
            windows, items = self.pairs(words, starts, length, *(part[own] for part in clusters))
            around = self.around(words, inside, text[windows], starts[windows], ends[windows], self.sizes[items])
            enough = around / self.sizes[items] >= PARAPHRASE
            windows, items = windows[enough], items[enough]
            for low in range(0, len(windows), WINDOWS):
                some = slice(low, low + WINDOWS)
                self.compare(words, terms, rows, text, starts, ends, windows[some], items[some], found)
        return [self.best(hits) for hits in found]

    def find_exact(self, words, found) -> None:
        """Items shorter than every window, by their words in order."""
        for size in sorted({len(sequence) for sequence in self.exact}):
            there = np.flatnonzero(np.isin(words.hashes, [s[0] for s in self.exact if len(s) == size]))
            text = np.searchsorted(words.first, there, side="right") - 1
            for place, k in zip(there.tolist(), text.tolist(), strict=True):
                if place + size <= words.first[k + 1]:
                    for item in self.exact.get(tuple(words.hashes[place : place + size].tolist()), ()):
                        found[k].append((item, 1.0, 1.0))

    def clusters(self, words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first, last): stretches of words that hold as many marks of an item as the rule asks for."""
        places = np.flatnonzero(self.mark_terms[terms])
        which = np.searchsorted(self.mark_words, words.hashes[places])
        which[which == len(self.mark_words)] = 0
        hit = self.mark_words[which] == words.hashes[places] if len(self.mark_words) else np.zeros(len(places), dtype=bool)
        places, which = places[hit], which[hit]
        counts = self.mark_first[which + 1] - self.mark_first[which]
        places = np.repeat(places, counts)
        items = self.mark_items[
            np.arange(len(places)) + np.repeat(self.mark_first[which] - (np.cumsum(counts) - counts), counts)
        ]
        text = np.searchsorted(words.first, places, side="right") - 1
        order = np.lexsort((places, items, text))
        places, items, text = places[order], items[order], text[order]
        begin = np.arange(len(places))
        end = begin + self.needed[items] - 1
        begin = begin[end < len(places)]
        end = end[end < len(places)]
        reach = self.items.lengths[items[begin]] + 2 * self.sizes[items[begin]]
        near = (items[begin] == items[end]) & (text[begin] == text[end]) & (places[end] - places[begin] < reach)
        return items[begin[near]], places[begin[near]], places[end[near]]

    def pairs(
        self, words, starts: np.ndarray, length: int, items: np.ndarray, first: np.ndarray, last: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): windows, given by their ordered starts, with a cluster of an item in the item's reach of them."""
        size = self.sizes[items]
        text = np.searchsorted(words.first, first, side="right") - 1
        low = np.searchsorted(starts, np.maximum(words.first[text], last - size - length + 1))
        high = np.searchsorted(starts, np.minimum(words.first[text + 1] - 1, first + size), side="right")
        counts = np.maximum(high - low, 0)
        windows = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        both = np.unique(windows * len(self.sizes) + np.repeat(items, counts))
        return both // len(self.sizes), both % len(self.sizes)

    @staticmethod
    def around(words, inside, text, starts, ends, size):
        """How many benchmark words stand within ``size`` words of each window."""
        return (
            inside[np.minimum(ends + size, words.first[text + 1])] - inside[np.maximum(starts - size, words.first[text])]
        )

    def compare(self, words, terms, rows, text, starts, ends, windows, items, found) -> None:
        """Confirm those pairs of windows and items whose vectors are alike in the latent space."""
        distinct, which = np.unique(windows, return_inverse=True)
        vectors = np.zeros((len(distinct), self.space.vectors.shape[1]), dtype=np.float32)
        lengths = ends[distinct] - starts[distinct]
        each = np.repeat(np.arange(len(distinct)), lengths)
        places = np.arange(len(each)) + np.repeat(starts[distinct] - (np.cumsum(lengths) - lengths), lengths)
        each, places = each[rows[places] >= 0], places[rows[places] >= 0]
        if len(each):
            along = self.space.inverse[terms[places], None] * self.space.vectors[rows[places]]
            begins = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            vectors[each[begins]] = np.add.reduceat(along, begins, axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cosines = np.einsum("ij,ij->i", vectors[which], self.vectors[items])
        for k in np.flatnonzero(cosines >= LEAST_COSINE).tolist():
            window, item = int(windows[k]), int(items[k])
            share = self.share(words, int(text[window]), int(starts[window]), int(ends[window]), item)
            if share is not None:
                found[int(text[window])].append((item, float(cosines[k]), share))

    def share(self, words, text: int, start: int, end: int, item: int) -> float | None:
        """Share of the item's words found in order around a window, or None if that does not confirm it."""
        own = self.items.words[item]
        size = len(own)
        around = words.hashes[
            max(int(words.first[text]), start - size) : min(int(words.first[text + 1]), end + size)
        ].tolist()
        share = common_subsequence(self.positions[item], around).bit_count() / size
        if share >= COPY:
            return share
        if share >= PARAPHRASE:
            answer = common_subsequence(self.answers[item], around).bit_count() / self.answer_size(own)
            return share if answer >= ANSWER else None
        return None

    @staticmethod
    def best(hits: list[tuple[int, float, float]]) -> list[tuple[int, float, float]]:
        kept: dict[int, tuple[int, float, float]] = {}
        for hit in hits:
            if hit[0] not in kept or (hit[2], hit[1]) > (kept[hit[0]][2], kept[hit[0]][1]):
                kept[hit[0]] = hit
        return [kept[item] for item in sorted(kept)]


MATCHES = "array<struct<item_id: bigint, cosine: double, share: double>>"


def with_matches(
    docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", block: int = ITEMS,
) -> DataFrame:
    """``docs`` with a column ``name``: array of (item_id, cosine, share) of the benchmark items that a text contains.

    Null and empty texts contain none; null items, items without id and items without words match nothing; items that
    repeat are reported as often as they stand in the benchmark; an empty benchmark or table gives empty arrays or no
    rows. Rows of ``docs`` may repeat; its other columns stay as they are, whatever their names. Whole texts are searched;
    a task holds some 100 bytes a character of the longest. Executors hold the items of one block: with several, the
    documents are written between the passes.
    """
    space = fit_space(docs, benchmark, text_col, item_text_col)
    context = docs.sparkSession.sparkContext
    shared_space = context.broadcast(space)
    own = [column(each) for each in docs.columns]
    parts: list[str] = []
    for items in item_blocks(benchmark, space, item_id_col, item_text_col, block):
        if parts:
            docs = stored(docs, "searched")
        parts.append(spare_name([*docs.columns, name], "_found"))
        docs = docs.withColumn(parts[-1], _searched(MATCHES, shared_space, context.broadcast(items))(column(text_col)))
    found = F.concat(*map(column, parts)) if parts else F.array().cast(MATCHES)
    return docs.select(*own, found.alias(name))


def _searched(kind: str, space, items):
    @F.arrow_udf(kind)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(space.value, items.value)
        ids = items.value.ids.tolist()
        found = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64())]))
        for part in parts_of(batches):
            texts = [text or "" for text in part.to_pylist()]
            hits = []
            for first, end in in_batches(texts, BATCH_CHARS):
                hits.extend(searcher.search(texts[first:end]))
            yield pa.array([[{"item_id": ids[i], "cosine": c, "share": s} for i, c, s in one] for one in hits], found)

    return searched


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, contaminated, item_ids, share and cosine of the best match (null without one)."""
    found = with_matches(docs.select(F.col(id_col), F.col(text_col)), benchmark, "found", text_col)
    return found.select(
        id_col, (F.size("found") > 0).alias("contaminated"), F.col("found.item_id").alias("item_ids"),
        F.array_max("found.share").alias("share"), F.array_max("found.cosine").alias("cosine"),
    )
