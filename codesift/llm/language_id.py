"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning reads every row it may learn from once: a task adds up its n-gram counts per language and bucket, and the sums
of all tasks are added by Spark. The matrix of log-probabilities has (buckets x languages) numbers whatever the corpus
is, is checked against a limit and broadcast; scoring is numpy over the flat list of bucket numbers of many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters of text handled at a time in a task.
PIECE = 1 << 19
#: Pseudo-count of every bucket in every language.
ALPHA = 0.5
#: The matrix may not be larger than this.
MAX_MODEL_BYTES = 256 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """``log_probs[k]`` are the log-probabilities of the buckets in language ``k``; ``priors`` those of the languages."""

    languages: tuple[str, ...]
    log_probs: np.ndarray
    priors: np.ndarray


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def pieces(texts: list[str | None], piece: int = PIECE) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """(text numbers, joined text, starts): whole texts together, a long one in parts that overlap by two characters.

    A part owns the n-grams that start in it, so that the parts of a text hold all of its n-grams exactly once.
    """
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for number, text in enumerate(texts):
        if not text:
            continue
        text = f" {text.lower()} "
        for start in range(0, len(text), piece):
            part = text[start : start + piece + 2]
            owners.append(number)
            parts.append(part if start + piece < len(text) else part + "  ")
            held += len(part)
            if held >= piece:
                yield _joined(owners, parts)
                owners, parts, held = [], [], 0
    if parts:
        yield _joined(owners, parts)


def _joined(owners: list[int], parts: list[str]) -> tuple[np.ndarray, str, np.ndarray]:
    lengths = np.array([len(part) for part in parts])
    return np.array(owners), "".join(parts), np.cumsum(lengths) - lengths


def grams(joined: str, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part number, bucket) of every n-gram, ordered by part; and for every part whether it has a letter.

    Anything but a letter counts as a blank; an n-gram needs a letter. The last two characters of a part start none.
    """
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    part = np.zeros(len(codes), dtype=np.int32)
    part[starts[1:]] = 1
    part = np.cumsum(part, dtype=np.int32)
    own = np.ones(len(codes), dtype=bool)
    ends = np.append(starts[1:], len(codes))
    own[ends - 1] = own[ends - 2] = False
    places = np.flatnonzero(own)
    at, found = [], []
    mixed, has = np.zeros(len(places), dtype=np.uint32), np.zeros(len(places), dtype=bool)
    for order in range(max(ORDERS)):
        mixed = (mixed ^ codes[places + order]) * _MULTIPLIERS[order]
        mixed ^= mixed >> np.uint32(15)
        has |= letter[places + order]
        if order + 1 in ORDERS:
            at.append(places[has])
            found.append((mixed[has] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (buckets.bit_length() - 1)))
    parts = np.concatenate([part[a] for a in at])
    return parts, np.concatenate(found), np.bincount(part, weights=letter, minlength=len(starts)) > 0


def learn(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS,
) -> LanguageModel:
    """Counts over all ``rows`` with a language. Rows without language or letters teach nothing; none gives an empty model."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for language, texts in batch.groupby("lang")["text"]:
                held = sums.setdefault(language, np.zeros(buckets, dtype=np.int64))
                seen[language] = seen.get(language, 0) + len(texts)
                for _, joined, starts in pieces(list(texts)):
                    held += np.bincount(grams(joined, starts, buckets)[1], minlength=buckets)
        for language, held in sums.items():
            there = np.flatnonzero(held)
            yield pd.DataFrame({"lang": language, "bucket": there.astype("int32"), "n": held[there]})
            yield pd.DataFrame({"lang": [language], "bucket": np.array([-1], dtype="int32"), "n": [seen[language]]})

    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = stored(
        labelled.mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")),
        "language-counts",
    )
    languages = counts.filter("bucket = -1").count()
    if 4 * buckets * languages > MAX_MODEL_BYTES:
        raise ValueError(f"{languages} languages x {buckets} buckets are more than {MAX_MODEL_BYTES} bytes")
    sums = (
        counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("sums"))  # at most buckets + 1 each
        .orderBy("lang").collect()
    )
    log_probs = np.zeros((len(sums), buckets), dtype=np.float32)
    priors = np.zeros(len(sums))
    for k, row in enumerate(sums):
        counts = np.zeros(buckets)
        for bucket, n in row["sums"]:
            if bucket < 0:
                priors[k] = n
            else:
                counts[bucket] = n
        log_probs[k] = np.log((counts + ALPHA) / (counts.sum() + ALPHA * buckets))
    priors = np.log(priors / priors.sum()) if len(sums) else priors
    return LanguageModel(tuple(row["lang"] for row in sums), log_probs, priors)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and probability of every text; ``und`` and 0 without text, letters or model. Ties go to the first language."""
    count, languages = len(texts), len(model.languages)
    totals = np.zeros((languages, count))
    lettered = np.zeros(count, dtype=bool)
    if languages:
        buckets = model.log_probs.shape[1]
        for owners, joined, starts in pieces(texts):
            parts, found, has = grams(joined, starts, buckets)
            lettered[owners[has]] = True
            for k in range(languages):
                sums = np.bincount(parts, weights=model.log_probs[k][found], minlength=len(starts))
                np.add.at(totals[k], owners, sums)
    # every character is in an n-gram of each order, so the evidence is divided by their number
    logits = totals / len(ORDERS) + model.priors[:, None]
    if not languages:
        return [UNKNOWN] * count, np.zeros(count)
    best = logits.argmax(axis=0)
    score = 1.0 / np.exp(logits - logits.max(axis=0)).sum(axis=0)
    names = [model.languages[k] if has else UNKNOWN for k, has in zip(best, lettered, strict=True)]
    return names, np.where(lettered, score, 0.0)


def predict(rows: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct column (lang, score) for the texts of ``rows``; the model goes to the executors as a broadcast.

    Every row is judged by its whole text alone: ids may be null or repeat, repeated rows get the same answer, and other
    columns are not read. Null, empty and letterless texts, and all texts without a model, are ``und`` with score 0.
    Of languages that tie, the first in alphabetical order is named.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, score = score_texts(list(batch), shared.value)
            yield pd.DataFrame({"lang": names, "score": score})

    return scored(F.col(text_col))
