"""Which tokens of one tokenizer cover which tokens of another, and how often each pair of ids does so in the corpus.

Both sides cut the same bytes (a blank and the text), so a token is a range of bytes. Texts are worked on in batches: all
tokens of a batch form two frames (document, start), and ``pandas.merge_asof`` by document finds for every token start
the token of the other side that covers it. Two ranges overlap exactly if one of the two starts lies in the other range,
so the union of both directions has every overlap; a pair that starts together is found twice and counted once. Where a
token of each side ends at the same byte, a group ends.

Pairs of ids are counted by Spark over the whole corpus. The most frequent pairs, a bounded number, go to all executors
and settle most of every document; the other pairs of a document are joined with the whole table of counts. As the
frequent ones never enter that join, no key in it is hot.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codesift.llm.common import in_batches, parts_of, stored, text_of
from codesift.llm.pretokens import BYTE_LEVEL_PATTERN

#: Pairs of ids whose counts every executor holds: 17 bytes each.
FREQUENT = 1 << 18
#: Characters of texts whose tokens are matched at once; a longer text alone.
BATCH_CHARS = 1 << 19
#: Texts with other characters, or with a longer unsplit run, are left to the slower library.
_OTHER = re.compile("[^\x00-\x1b\x20-˿]")
_LONG_BLANKS = re.compile(r"\s{512}")
_LONG_WORD = 4096


class ByteLevelSide:
    """A byte-level file of the ``tokenizers`` library. Strings of special tokens in a text are plain text.

    Merging by rank gives the same tokens faster if ids follow the order of the merges and every token is what its own
    bytes are merged to: then no pair can make a token by another way. Both are checked; else the library does it all.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or spec.get("normalizer") is not None or split["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level files without a normaliser align by bytes")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = _byte_alphabet()
        special = {token["content"] for token in spec.get("added_tokens") or []}
        bytes_of = {number: bytes(alphabet[c] for c in token) for token, number in vocabulary.items() if token not in special}
        self.pieces = [bytes_of.get(number, b"") for number in range(max(self.library.get_vocab(True).values()) + 1)]
        self.quick = None
        pairs = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in merges]
        if (
            split["use_regex"] and not spec["model"].get("ignore_merges")
            and all(vocabulary[a + b] == 256 + rank for rank, (a, b) in enumerate(pairs))
            and all([t.id for t in self.library.model.tokenize(token)] == [number]
                    for token, number in vocabulary.items() if token not in special)
        ):
            ranks = {piece: number for number, piece in bytes_of.items()}
            self.quick = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(" " + text) for text in texts]

    def _ids(self, text: str) -> list[int]:
        if (
            self.quick is None or _OTHER.search(text) or _LONG_BLANKS.search(text)
            or max(map(len, text.split()), default=0) > _LONG_WORD
        ):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


class PieceSide:
    """A file of the ``sentencepiece`` library, which puts the blank before a text itself."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self._bytes(number) for number in range(self.library.get_piece_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self.library.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.library.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def side(path: str) -> ByteLevelSide | PieceSide:
    """One for each file and worker process."""
    return PieceSide(path) if path.endswith(".model") else ByteLevelSide(path)


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level files write for each byte: itself if it can be seen, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [byte for byte in range(256) if byte not in set(seen)]
    return {chr(byte): byte for byte in seen} | {chr(0x100 + place): byte for place, byte in enumerate(unseen)}


def tokens_of(own: ByteLevelSide | PieceSide, texts: list[str], whole: list[bytes]) -> list[list[int]]:
    """The ids of each text, or none where their bytes are not those of ``whole``."""
    pieces = own.pieces
    return [
        ids if b"".join(map(pieces.__getitem__, ids)) == expected else []
        for ids, expected in zip(own.encode(texts), whole, strict=True)
    ]


class Tokens:
    """The tokens of a batch of documents in one row: ``doc``, ``ids``, and where each starts and ends in all bytes."""

    def __init__(self, lists: list[list[int]], pieces: list[bytes]) -> None:
        self.vocabulary = len(pieces)
        self.per_doc = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.doc = np.repeat(np.arange(len(lists)), self.per_doc)
        self.ids = np.concatenate([np.array(ids, dtype=np.int64) for ids in lists] or [np.zeros(0, np.int64)])
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))[self.ids]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def covering(self, other: Tokens) -> np.ndarray:
        """For every token the token of ``other`` that covers its start."""
        own = pd.DataFrame({"doc": self.doc, "start": self.starts})
        found = pd.merge_asof(
            own, pd.DataFrame({"doc": other.doc, "start": other.starts, "token": np.arange(len(other.ids))}),
            on="start", by="doc",
        )
        return found["token"].to_numpy(dtype=np.int64)


def links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of a, token of b) that share a byte, each once. Both sides have the same bytes."""
    over, under = a.covering(b), b.covering(a)
    later = a.starts[under] != b.starts  # those that start together are in the first direction already
    return (
        np.concatenate([np.arange(len(a.ids)), under[later]]),
        np.concatenate([over, np.flatnonzero(later)]),
    )


def group_of(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered through the batch, and the number of groups of each document."""
    last = np.isin(a.ends, b.ends)  # equal ends, also at the end of a document, where both sides stop
    before = np.concatenate([[0], np.cumsum(last)])
    return before[:-1], before[np.searchsorted(a.ends, b.starts, side="right")], np.bincount(
        a.doc[last], minlength=len(a.per_doc)
    )


@lru_cache(maxsize=8)
def _names(vocabulary: int, sign: str) -> np.ndarray:
    """Every id in decimal digits, with a sign after it."""
    return np.char.add(np.arange(vocabulary).astype("S"), sign.encode())


def written(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    if not len(a.ids):
        return [""] * len(a.per_doc)
    groups = group_a[-1] + 1
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(a.ids)) + np.concatenate([[0], np.cumsum(in_b)])[group_a]
    place_b = np.arange(len(b.ids)) + np.cumsum(in_a)[group_b]
    text = np.empty(len(a.ids) + len(b.ids), dtype=f"S{len(str(max(a.vocabulary, b.vocabulary))) + 1}")

    def put(places: np.ndarray, tokens: Tokens, of_group: np.ndarray, between: str, after: str) -> None:
        ends = np.concatenate([of_group[1:] != of_group[:-1], [True]])
        for sign, chosen in ((between, ~ends), (after, ends)):
            text[places[chosen]] = _names(tokens.vocabulary, sign)[tokens.ids[chosen]]

    put(place_a, a, group_a, ",", "|")
    put(place_b, b, group_b, ",", ";")
    cuts = np.concatenate([[0], np.cumsum(a.per_doc + b.per_doc)])
    return [
        text[start:end].tobytes().replace(b"\0", b"")[:-1].decode() if end > start else ""
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    ]


ALIGNED = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups: string, pairs: array<bigint>, times: array<int>>"


def align_texts(texts: list[str], first: ByteLevelSide | PieceSide, second: ByteLevelSide | PieceSide) -> pa.StructArray:
    """The rows of ``ALIGNED`` for a batch of texts. A pair is the number a * (ids of the second side) + b."""
    whole = [(" " + text).encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    lists_a, lists_b = tokens_of(first, texts, whole), tokens_of(second, texts, whole)
    both = [bool(x) and bool(y) for x, y in zip(lists_a, lists_b, strict=True)]
    a = Tokens([ids if ok else [] for ids, ok in zip(lists_a, both, strict=True)], first.pieces)
    b = Tokens([ids if ok else [] for ids, ok in zip(lists_b, both, strict=True)], second.pieces)
    group_a, group_b, n_groups = group_of(a, b)
    link_a, link_b = links(a, b)
    docs, span = len(texts), len(first.pieces) * len(second.pieces)
    keys, times = np.unique(
        a.doc[link_a] * span + a.ids[link_a] * len(second.pieces) + b.ids[link_b], return_counts=True
    )
    offsets = pa.array(np.searchsorted(keys, np.arange(docs + 1) * span).astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(a.per_doc), pa.array(b.per_doc), pa.array(n_groups.astype(np.int64)),
            pa.array(np.bincount(a.doc[link_a], minlength=docs).astype(np.int64)),
            pa.array(written(a, b, group_a, group_b), pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(keys % span)),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        ],
        ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
    )


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    carry: dict[str, Column] | None = None, frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and what ``carry`` names.

    ``carry`` holds columns made of ``groups`` (``a1,a2|b1;a3|b2,b3``: ids in order), by default that text itself. A
    link is a pair of tokens that share a byte; the count of a pair of ids is the number of links of the whole table that
    have it. ``n_best`` are the links whose count is the highest of their second id, ties included; ``count_sum`` adds
    the counts of all links.

    Texts are whole. Null and empty texts, and texts that a side changes (so that its tokens' bytes differ from a blank
    and the text), have no tokens: zeros and an empty text. Ids may be null or repeat: every row counts for itself. An
    empty table gives an empty result; other columns are not read. A task holds the tokens of ``BATCH_CHARS`` characters,
    or of one longer text, at about 300 bytes a token.
    """
    spark = docs.sparkSession
    carry = {"groups": F.col("groups")} if carry is None else carry

    @F.arrow_udf(ALIGNED)
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first, second = side(path_a), side(path_b)
        for part in parts_of(batches):
            texts = part.to_pylist()
            yield pa.concat_arrays(
                [align_texts(texts[start:end], first, second) for start, end in in_batches(texts, BATCH_CHARS)]
            )

    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
            aligned(text_of(text_col)).alias("f"),
        ).select("_row", "_id", "f.*").select(
            "_row", "_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times",
            *[made.alias(f"_c{place}") for place, made in enumerate(carry.values())],
        ),
        "aligned",
    )
    second_ids = F.lit(len(side(path_b).pieces))
    counts = stored(
        rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")),
        "pair-counts",
    ).withColumn("b", F.pmod("pair", second_ids))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # at most one row for each id of the second side
    pairs = stored(
        counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs"
    )
    shared = spark.sparkContext.broadcast(_most_frequent(pairs, frequent))

    @F.arrow_udf("struct<best: bigint, total: bigint, pairs: array<bigint>, times: array<int>>")
    def settled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, times in batches:
            yield _settle(keys, times, *shared.value)

    known = rows.withColumn("s", settled("pairs", "times")).drop("pairs", "times")
    known = stored(known.select(*[c for c in known.columns if c != "s"], "s.*"), "aligned-known")
    rare = (
        known.filter(F.size("pairs") > 0).select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(pairs, "pair")
        .groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_total"),
        )
    )
    zero = F.lit(0).cast("long")
    return known.join(rare, "_row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("total") + F.coalesce("more_total", zero)).alias("count_sum"),
        *[F.col(f"_c{place}").alias(name) for place, name in enumerate(carry)],
    )


def _most_frequent(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n, best) of the highest classes of frequency that together have at most ``limit`` pairs, ordered by pair."""
    classed = pairs.withColumn("class", F.floor(8 * F.log2("n")))
    least, held = math.inf, 0
    for row in sorted(classed.groupBy("class").count().collect(), reverse=True):  # a few hundred classes
        held += row["count"]
        if held > limit:
            break
        least = row["class"]
    top = classed.filter(F.col("class") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    return top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy()


def _settle(
    lists: pa.ListArray, times: pa.ListArray, pairs: np.ndarray, n: np.ndarray, best: np.ndarray,
) -> pa.StructArray:
    """What the known pairs give each row, and the pairs that are left."""
    keys, weights = (part.flatten().to_numpy().astype(np.int64) for part in (lists, times))
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    place = np.searchsorted(pairs, keys)
    there = np.zeros(len(keys), dtype=bool)
    inside = place < len(pairs)
    there[inside] = pairs[place[inside]] == keys[inside]
    found = place[there]
    values = np.zeros((2, len(keys)), dtype=np.int64)
    values[0, there] = best[found] * weights[there]
    values[1, there] = n[found] * weights[there]
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values, axis=1)], axis=1)
    left = np.concatenate([[0], np.cumsum(~there)])
    offsets = pa.array(left[cuts].astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            *[pa.array(total[cuts[1:]] - total[cuts[:-1]]) for total in sums],
            pa.ListArray.from_arrays(offsets, pa.array(keys[~there])),
            pa.ListArray.from_arrays(offsets, pa.array(weights[~there].astype(np.int32))),
        ],
        ["best", "total", "pairs", "times"],
    )
