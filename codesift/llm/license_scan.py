"""License scan by ordered signature rules.

A text becomes its normalised words (ASCII lower case, punctuation gone) with single blanks between them. A rule has
keywords that every match of its pattern holds; only rules whose keywords all stand in the text are run, so a text
without such words costs no pattern at all. Of overlapping detections the stronger kind wins; of the same kind, one that
lies within another goes, and of equal ones the first rule's stays. Lookalikes ("license plate") win and then yield no
label. Places of base rules are reported whatever overlaps them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import column, parts_of, text_of
from codesift.llm.license_rules import KINDS, RULES, Rule

#: Bytes of normalised words as they are, A to Z in lower case, all other ASCII as blanks.
_NORMAL = bytes(
    byte | 0x20 if 0x41 <= byte <= 0x5A else byte if byte > 0x7F or chr(byte).isalnum() else 0x20 for byte in range(256)
)
DETECTIONS = "array<struct<label: string, kind: string, rule: int, first: bigint, last: bigint, kept: boolean>>"


class Scanner:
    """Rules compiled behind their keywords. A rule's rank is its place in the list."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = rules
        self.strength = {kind: place for place, kind in enumerate(KINDS)}
        self.patterns = [re.compile(f"(?<![^ ])(?:{rule.pattern})(?![^ ])".encode()) for rule in rules]
        self.needs = [frozenset(word.encode() for word in rule.keywords) for rule in rules]
        self.keywords = frozenset().union(*self.needs) if rules else frozenset()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int, bool]]]:
        """Number of words, and (rule, first word, last word, kept) of every detection, by place and rule."""
        words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
        there = self.keywords.intersection(words)
        gated = [rank for rank, needs in enumerate(self.needs) if needs <= there] if there else []
        if not gated:
            return len(words), []
        joined = b" ".join(words)
        starts = np.cumsum([0] + [len(word) + 1 for word in words])
        spans = [
            (rank, *match.span()) for rank in gated for match in self.patterns[rank].finditer(joined)
        ]
        first = np.searchsorted(starts, [span[1] for span in spans]).tolist()
        last = (np.searchsorted(starts, [span[2] for span in spans]) - 1).tolist()
        found = [(span[0], a, b) for span, a, b in zip(spans, first, last, strict=True)]
        return len(words), sorted((*each, keep) for each, keep in zip(found, self.kept(found), strict=True))

    def kept(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Which detections stay, in the time of sorting them."""
        stays = [False] * len(found)
        taken: list[tuple[int, int]] = []  # what stronger kinds cover, as ranges apart from each other, in order
        by_kind: dict[int, list[int]] = {}
        for place, (rank, _, _) in enumerate(found):
            by_kind.setdefault(self.strength[self.rules[rank].kind], []).append(place)
        for strength in sorted(by_kind, reverse=True):
            starts, reached = [start for start, _ in taken], -1
            own = []
            # from left to right, the longest first: one that ends no later than an earlier one lies within it
            for place in sorted(by_kind[strength], key=lambda k: (found[k][1], -found[k][2], found[k][0])):
                _, first, last = found[place]
                before = bisect_right(starts, last) - 1
                if last <= reached or (before >= 0 and taken[before][1] >= first):
                    continue
                stays[place], reached = True, last
                own.append((first, last))
            taken = _merged(sorted(taken + own))
        return stays


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in ranges:
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One for each list of rules and worker process."""
    return Scanner(rules)


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``, which replace columns of those names.

    A detection has its label, kind, rule (place in ``rules``), first and last word (from 0), and whether it is kept. A
    null text counts as empty: no words, no detections. Every row is scanned for itself and whole, without an exchange;
    ids are not read; an empty table gives an empty result. A task holds the words of one text, some 100 bytes each.
    """
    rules = tuple(rules)

    @F.arrow_udf(f"struct<n_words: bigint, detections: {DETECTIONS}>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = scanner(rules)
        for part in parts_of(batches):
            counts, offsets, flat = [], [0], []
            for text in part.to_pylist():
                n_words, found = own.scan(text)
                counts.append(n_words)
                flat.extend(found)
                offsets.append(len(flat))
            yield _as_arrow(rules, counts, offsets, flat)

    made = ("n_words", "detections")
    others = [column(name) for name in docs.columns if name.lower() not in made]
    found = scanned(text_of(text_col))
    return docs.select(*others, found.alias("_found")).select(
        *others, F.col("_found.n_words").alias("n_words"), F.col("_found.detections").alias("detections")
    )


def _as_arrow(
    rules: Sequence[Rule], counts: list[int], offsets: list[int], flat: list[tuple[int, int, int, bool]]
) -> pa.StructArray:
    names = ["label", "kind", "rule", "first", "last", "kept"]
    rows = pa.StructArray.from_arrays(
        [
            pa.array([rules[rank].label for rank, *_ in flat], pa.string()),
            pa.array([rules[rank].kind for rank, *_ in flat], pa.string()),
            pa.array([rank for rank, *_ in flat], pa.int32()),
            pa.array([first for _, first, _, _ in flat], pa.int64()),
            pa.array([last for _, _, last, _ in flat], pa.int64()),
            pa.array([kept for *_, kept in flat], pa.bool_()),
        ],
        names,
    )
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)],
        ["n_words", "detections"],
    )


def base_places(detections: str = "detections", rules: Sequence[Rule] = RULES) -> Column:
    """The detections of base rules, suppressed or not."""
    ranks = [rank for rank, rule in enumerate(rules) if rule.base]
    return F.filter(detections, lambda found: found["rule"].isin(ranks))


def labelled(detections: str = "detections", rules: Sequence[Rule] = RULES) -> Column:
    """The detections that give labels: kept ones but lookalikes, and all of base rules."""
    ranks = [rank for rank, rule in enumerate(rules) if rule.base]
    return F.filter(
        detections, lambda found: (found["kept"] & (found["kind"] != "lookalike")) | found["rule"].isin(ranks)
    )


def names(found: Column) -> Column:
    """Distinct labels of detections, sorted and joined by commas; empty without any."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda each: each["label"]))), ",")


def confidence(found: Column) -> Column:
    """The confidence of the strongest kind among detections; 0 without any."""
    weights = F.create_map(*[F.lit(part) for pair in KINDS.items() for part in pair])
    return F.coalesce(F.array_max(F.transform(found, lambda each: weights[each["kind"]])), F.lit(0.0))
