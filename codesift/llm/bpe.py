"""Byte-pair encoding and decoding, with long unsplit text encoded as a tree of concatenations.

Ordinary texts are encoded where they are: every distinct pre-token once per task, then looked up. A long text is cut up:
its pre-tokens become rows of their own, and a pre-token longer than a leaf (text without a place to split) is halved until
it consists of leaves. All of these rows are spread over the executors and encoded in parallel. Two neighbouring halves are
joined by encoding again the text of the last tokens of the left and the first of the right one, in a growing window, until
the new tokens begin as the left half's window and end as the right half's. Then all neighbours are tokens that the merges
leave apart, inside the window and at its edges, which makes the sequence the one that the whole text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from codesift.llm.common import column, parts_of, spare_name, stored, text_of
from codesift.llm.pretokens import PreTokenizer, pre_tokenizer

#: Texts of more characters are cut up.
LONG_CHARS = 1 << 16
#: Characters of whole pre-tokens in one row of a long text.
PIECE_CHARS = 1 << 14
#: Symbols (bytes) of a pre-token that are encoded at once; longer ones are halved.
LEAF = 1 << 10
#: Pre-tokens that a task remembers before it starts afresh.
REMEMBERED = 1 << 17


class Encoder:
    """Encodes by one tokenizer file; remembers the pre-tokens it has met."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.base: PreTokenizer = pre_tokenizer(path)
        self.leaf = leaf
        self.known: dict[str, bytes] = {}
        model = self.base.spec["model"]
        if model["type"] != "BPE":
            raise ValueError("only byte-pair encoding is supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self._inner: models.BPE | None = None
        self._strings: dict[int, str] | None = None

    @property
    def inner(self):
        """The same merges for a part of a word that does not hold its end."""
        if not self.suffix:
            return self.base.tokenizer.model
        if self._inner is None:
            self._inner = models.BPE(self.base.tokenizer.get_vocab(False), self.base.merges())
        return self._inner

    @property
    def strings(self) -> dict[int, str]:
        if self._strings is None:
            self._strings = {number: token for token, number in self.base.tokenizer.get_vocab(True).items()}
        return self._strings

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        texts_pieces = list(map(self.base.split, texts))
        fresh = set(chain.from_iterable(texts_pieces)).difference(known)
        odd = {piece for piece in fresh if 4 * len(piece) > self.leaf or piece in self.base.special}
        known.update((piece, np.array(self.whole(piece), dtype=np.int32).tobytes()) for piece in odd)
        if plain := list(fresh - odd):
            known.update(zip(plain, self.base.packed_ids(plain), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in texts_pieces]

    def whole(self, piece: str) -> tuple[int, ...]:
        """A pre-token; a long one as a tree."""
        if piece in self.base.special:
            return self.base.ids(piece)
        leaves = self.leaves(piece)
        if len(leaves) == 1:
            return self.base.ids(piece)
        return tuple(self.joined([self.part(leaf, last) for leaf, last in leaves]))

    def leaves(self, piece: str) -> list[tuple[str, bool]]:
        """Halves of halves of a pre-token in the merges' alphabet, up to a leaf; and whether each is the last."""
        if piece in self.base.special:
            return [(piece, True)]
        mapped = self.base.mapped(piece)

        def halved(part: str) -> list[str]:
            if len(part) <= self.leaf:
                return [part]
            return halved(part[: len(part) // 2]) + halved(part[len(part) // 2 :])

        parts = halved(mapped)
        return [(part, place == len(parts) - 1) for place, part in enumerate(parts)]

    def part(self, mapped: str, last: bool) -> list[int]:
        """A part of a pre-token; ``last`` if it holds the end."""
        model = self.base.tokenizer.model if last else self.inner
        return [token.id for token in model.tokenize(mapped)]

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Parts of one pre-token, in order, as the tokens of the whole."""
        while len(parts) > 1:
            pairs = [self.join(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Two neighbouring parts: a window around the join grows until its new tokens agree with both sides."""
        size = 1
        while True:
            before, after = left[max(0, len(left) - size) :], right[:size]
            symbols = "".join(self.strings[number] for number in chain(before, after))
            last = bool(self.suffix) and len(after) == len(right) and symbols.endswith(self.suffix)
            if last:
                symbols = symbols[: -len(self.suffix)]
            again = self.part(symbols, last)
            all_left, all_right = len(before) == len(left), len(after) == len(right)
            if (all_left or again[0] == before[0]) and (all_right or again[-1] == after[-1]):
                return left[: len(left) - len(before)] + again + right[len(after) :]
            size *= 2


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """One for each file and worker process."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = Encoder(path, leaf)
    return _encoders[path, leaf]


def _id_lists(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(row) // 4 for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def encode(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None,
    long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS, leaf: int = LEAF,
) -> DataFrame:
    """``docs`` with the token ids of each text (array<int>) as ``ids_col``, which replaces a column of that name.

    With a ``decoded_col`` the ids are also decoded, as ``decode`` does, by the same Python worker.

    Ids are those of the file's tokenizer without added begin or end tokens, truncation or padding; strings of added
    tokens in a text become those tokens. A null or empty text has no ids (an empty list); rows may repeat; an empty
    table gives an empty result; all other columns stay as they are, whatever their names.
    """

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(tokenizer_path, leaf)  # what it remembers goes with the task
        back = Decoder(own.base) if decoded_col else None
        for part in parts_of(batches):
            yield _both(_id_lists(own.encode(part.to_pylist())), back)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer_path, leaf)
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                for seq, (words, part) in enumerate(_cut(own, text, piece_chars)):
                    yield pd.DataFrame({"row": [row], "seq": [seq], "part": [part], "words": [words]})

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer_path, leaf)
        for batch in batches:
            ids = [
                list(chain.from_iterable(map(own.whole, words))) if part == WHOLE else own.part(words[0], part == LAST)
                for part, words in zip(batch["part"], batch["words"], strict=True)
            ]
            yield batch[["row", "seq", "part"]].assign(ids=ids)

    def assembled(pieces: pd.DataFrame) -> pd.DataFrame:
        own = encoder(tokenizer_path, leaf)
        found: list[int] = []
        open_parts: list[list[int]] = []
        pieces = pieces.sort_values("seq")
        for part, ids in zip(pieces["part"], pieces["ids"], strict=True):
            if part == WHOLE:
                found.extend(ids)
                continue
            open_parts.append(list(ids))
            if part == LAST:
                found.extend(own.joined(open_parts))
                open_parts = []
        return pd.DataFrame({"row": pieces["row"].iloc[:1].to_list(), "found": [found]})

    made = [ids_col] + [decoded_col] * bool(decoded_col)
    columns = [column(name) for name in docs.columns if name.lower() not in {new.lower() for new in made}]
    row, text = spare_name(docs.columns, "_row"), text_of(text_col)
    both = spare_name(docs.columns, "_both")
    is_long = F.length(text) > long_chars
    short = docs.filter(~is_long).withColumn(both, encoded(text)).select(
        *columns, *[F.col(f"{both}.{part}").alias(new) for part, new in zip(("ids", "decoded"), made, strict=False)]
    )
    kept = stored(docs.filter(is_long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    found = (
        kept.select(F.col(row).alias("row"), text.alias("text"))
        .mapInPandas(cut, "row long, seq int, part int, words array<string>")
        .repartition("row", "seq")
        .mapInPandas(worked, "row long, seq int, part int, ids array<int>")
        .groupBy("row").applyInPandas(assembled, "row long, found array<int>")
    )
    found_ids = spare_name([*docs.columns, row], "_found")
    long = (
        kept.join(found.select(F.col("row").alias(row), F.col("found").alias(found_ids)), row, "left")
        .select(*columns, F.coalesce(found_ids, F.array().cast("array<int>")).alias(ids_col))
    )
    return short.unionByName(decode(long, tokenizer_path, ids_col, decoded_col) if decoded_col else long)


#: Kinds of rows of a long text: whole pre-tokens, a part of a long one, the last part of it.
WHOLE, PART, LAST = 0, 1, 2


def _cut(own: Encoder, text: str, piece_chars: int) -> Iterator[tuple[list[str], int]]:
    words: list[str] = []
    held = 0
    for piece in own.base.split(text):
        if len(piece) * 4 > own.leaf and len(leaves := own.leaves(piece)) > 1:
            if words:
                yield words, WHOLE
                words, held = [], 0
            for leaf, last in leaves:
                yield [leaf], LAST if last else PART
            continue
        words.append(piece)
        held += len(piece)
        if held >= piece_chars:
            yield words, WHOLE
            words, held = [], 0
    if words:
        yield words, WHOLE


def decode(
    rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded",
) -> DataFrame:
    """``rows`` with the text of the ids as ``text_col``, special tokens included, as the file's decoder makes it.

    No ids (null or empty) give an empty text; an id that the vocabulary lacks gives nothing, as in the library.
    """

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        back = Decoder(pre_tokenizer(tokenizer_path))
        for part in parts_of(batches):
            yield back.texts(part)

    return rows.withColumn(text_col, decoded(F.col(ids_col)))


class Decoder:
    """Texts of ids by one tokenizer file."""

    def __init__(self, base: PreTokenizer) -> None:
        self.tokenizer = base.tokenizer
        strings = {number: token for token, number in base.tokenizer.get_vocab(True).items()}
        size = max(strings, default=-1) + 1
        self.names = np.array([strings.get(number, "") for number in range(size)], dtype=object)
        self.there = np.array([number in strings for number in range(size)], dtype=bool)
        self.plain = base.spec.get("decoder") is None  # then the library puts a blank between the tokens' strings

    def texts(self, lists: pa.ListArray) -> pa.Array:
        return pa.array([self.text(ids) for ids in _lists(lists)], pa.string())

    def text(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.names))]
        ids = ids[self.there[ids]]
        if self.plain:
            return " ".join(self.names[ids].tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def _both(ids: pa.ListArray, back: Decoder | None) -> pa.Array:
    return pa.StructArray.from_arrays([ids, back.texts(ids) if back else pa.nulls(len(ids), pa.string())], ["ids", "decoded"])


def _lists(batch: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none for a null row."""
    ids = batch.values.to_numpy(zero_copy_only=False)
    offsets, there = batch.offsets.to_numpy(), batch.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(batch)):
        yield ids[offsets[k] : offsets[k + 1]] if there[k] else ids[:0]
