"""Words of many texts at once as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Bytes that part words: space and tab to carriage return.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part normalised words: ASCII that is neither letter nor digit.
PUNCTUATION = np.array([code < 128 and not chr(code).isalnum() for code in range(256)])

#: Bytes of a word that fit into a number together with its length.
_SHORT = 7


@dataclass(frozen=True)
class Words:
    """``hashes`` of all words in order; words ``first[k]`` to ``first[k + 1]`` are those of text ``k``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words_of(texts: list[str], parting: np.ndarray = BLANKS) -> Words:
    """Words are what bytes marked in ``parting`` part; equal words have equal hashes wherever they stand.

    Words of up to seven bytes are numbers of their own, turned about one to one; longer ones are told apart by XXH64.
    """
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(text) + 1 for text in encoded), dtype=np.int64, count=len(encoded)))
    blank = parting[data]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sizes = ends - starts
    numbers = np.minimum(sizes, _SHORT + 1).astype(np.uint64) << np.uint64(56)
    for place in range(_SHORT):
        there = np.flatnonzero(sizes > place)
        numbers[there] |= data[starts[there] + place].astype(np.uint64) << np.uint64(8 * place)
    hashes = mixed(numbers)
    long = np.flatnonzero(sizes > _SHORT)
    if len(long):
        view = memoryview(data)
        hashes[long] = [
            xxhash.xxh64_intdigest(view[start:end])
            for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        ]
    first = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
    return Words(hashes, first.astype(np.int64))
