"""Splitting texts into pre-tokens exactly as a tokenizer file of the ``tokenizers`` library does.

A pre-token is what the byte-pair merges work on; equal pre-tokens have equal tokens wherever they stand. Strings of added
tokens are cut out first, as the library does. Texts whose characters are all below U+0300 take a quick way with the
file's own pattern (tests compare it with the library over that whole range); any other text is split by the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The pattern that byte-level files use without naming it. Fixed value: public pattern of that scheme.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile("[^\x00-\x1b\x20-˿]")  # also without U+001C to U+001F, of which libraries differ on blanks
_BYTES = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)


class PreTokenizer:
    """Splits by one tokenizer file. ``special`` are the strings of added tokens; ``mapped`` is the alphabet of merges."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        added = self.spec.get("added_tokens") or []
        if any(token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"] for token in added):
            raise ValueError("added tokens that look at their neighbours or at normalised text are not supported")
        self.special = {token["content"]: token["id"] for token in added}
        self.path = path
        for large in ("merges", "vocab"):
            self.spec["model"].pop(large, None)
        names = sorted(self.special, key=lambda name: (-len(name), name))
        self._cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._lower, pattern = self._quick_way()
        self._pattern = regex.compile(pattern) if pattern else None

    def _quick_way(self) -> tuple[bool, str | None]:
        """(lower-case first, pattern), or no pattern if only the library can split by this file."""
        before, split = self.spec.get("normalizer"), self.spec.get("pre_tokenizer") or {}
        if before is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            return False, BYTE_LEVEL_PATTERN
        kinds = [step["type"] for step in (before or {}).get("normalizers", [])]
        steps = split.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [step["type"] for step in steps] == ["Split", "ByteLevel"]:
            first, last = steps
            blanks = before["normalizers"][1]
            if (
                (blanks["pattern"], blanks["content"]) == ({"Regex": r"\s+"}, " ") and first["invert"]
                and first["behavior"] == "Removed" and not last["use_regex"] and not last["add_prefix_space"]
            ):
                return True, first["pattern"]["Regex"]
        return False, None

    def split(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of a text, in order. A pre-token is raw text where the file has a quick way."""
        if self._cut is None:
            return self._pieces(text)
        parts = self._cut.split(text)
        if len(parts) == 1:
            return self._pieces(text)
        found: list[str] = []
        for place, part in enumerate(parts):
            if place % 2:
                found.append(part)
            elif part:
                found.extend(self._pieces(part))
        return found

    def _pieces(self, text: str) -> list[str]:
        if self._pattern is not None and _OTHER.search(text) is None:
            return self._pattern.findall(text.lower() if self._lower else text)
        library = self.tokenizer
        if library.normalizer is not None:
            text = library.normalizer.normalize_str(text)
        pieces = library.pre_tokenizer.pre_tokenize_str(text)
        return [text[start:end] for _, (start, end) in pieces] if self._pattern is not None else [p for p, _ in pieces]

    def mapped(self, piece: str) -> str:
        """A pre-token in the alphabet of the merges."""
        if self._pattern is None:
            return piece
        return "".join(part for part, _ in _BYTES.pre_tokenize_str(piece))

    def ids(self, piece: str) -> tuple[int, ...]:
        """Token ids of a pre-token or added token."""
        number = self.special.get(piece)
        if number is not None:
            return (number,)
        return tuple(token.id for token in self.tokenizer.model.tokenize(self.mapped(piece)))

    def packed_ids(self, pieces: list[str]) -> list[bytes]:
        """Token ids of many pre-tokens, none of them an added token, as packed 32-bit numbers, by one library call."""
        if self._pattern is None:
            return [np.array(self.ids(piece), dtype=np.int32).tobytes() for piece in pieces]
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, place, each = np.array(found.ids, dtype=np.int32).tobytes(), 0, []
        for size in np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(pieces)).tolist():
            each.append(ids[4 * place : 4 * (place + size)])
            place += size
        return each

    def merges(self) -> list[tuple[str, str]]:
        with open(self.path, encoding="utf-8") as file:
            pairs = json.load(file)["model"]["merges"]
        return [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in pairs]


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    """One for each file and worker process."""
    return PreTokenizer(path)
