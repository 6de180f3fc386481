"""Language identification against a plain reading of the same rules."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codesift.llm import language_id as L

BUCKETS = 1 << 10


def plain_grams(text):
    """Buckets of the n-grams of a text, one character at a time."""
    shown = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "] + [32, 32]
    out = Counter()
    for start in range(len(shown) - 2):
        mixed = 0
        for order in range(max(L.ORDERS)):
            mixed = ((mixed ^ shown[start + order]) * int(L._MULTIPLIERS[order])) % 2**32
            mixed ^= mixed >> 15
            if order + 1 in L.ORDERS and any(code != 32 for code in shown[start : start + order + 1]):
                out[((mixed * 0x27D4EB2F) % 2**32) >> (32 - (BUCKETS.bit_length() - 1))] += 1
    return out


def plain_answers(learned, texts):
    sums, seen = defaultdict(Counter), Counter()
    for lang, text in learned:
        if lang is not None and text is not None:
            sums[lang] += plain_grams(text)
            seen[lang] += 1
    answers = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            answers.append(("und", 0.0))
            continue
        grams, logits = plain_grams(text), {}
        for lang in sorted(seen):
            total = sum(sums[lang].values()) + L.ALPHA * BUCKETS
            evidence = sum(n * math.log((sums[lang][bucket] + L.ALPHA) / total) for bucket, n in grams.items())
            logits[lang] = evidence / len(L.ORDERS) + math.log(seen[lang] / sum(seen.values()))
        best = max(logits, key=logits.get)
        answers.append((best, 1 / sum(math.exp(value - logits[best]) for value in logits.values())))
    return answers


def test_answers_of_a_plain_reading(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdeé ", "bb": "cdefgß ", "cc": "xyzабв "}
    made = lambda lang, size: "".join(rng.choice(letters[lang]) for _ in range(size))
    rows = [(n, made(lang, rng.randrange(1, 60)), lang, "x") for n, lang in enumerate(rng.choices(list(letters), k=60))]
    rows += [(60, None, "aa", "x"), (61, "", "bb", "x"), (62, "12 !?", "cc", "x"), (63, made("aa", 30), None, "x")]
    rows += [(None, rows[0][1], None, "x"), (7, rows[7][1], rows[7][2], "x"), (64, made("bb", 40_000), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.learn(docs, buckets=BUCKETS)
    answered = docs.select("text", L.predict(docs, model).alias("p"), "score").collect()
    expected = plain_answers([(lang, text) for _, text, lang, _ in rows], [row.text for row in answered])
    assert len(answered) == len(rows)
    for row, (lang, score) in zip(answered, expected, strict=True):
        assert row.p.lang == lang and row.p.score == pytest.approx(score, abs=1e-4)


def test_ties_empty_tables_and_too_many_languages(spark):
    twins = spark.createDataFrame([("same words", "bb"), ("same words", "aa")], "text string, lang string")
    assert twins.select(L.predict(twins, L.learn(twins)).lang.alias("l")).distinct().collect() == [("aa",)]
    none = L.learn(twins.limit(0))
    assert none.languages == () and {row.p.lang for row in twins.select(L.predict(twins, none).alias("p")).collect()} == {"und"}
    assert twins.limit(0).select(L.predict(twins, none)).count() == 0
    many = spark.range(20).select(F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="20 languages"):
        L.learn(many, buckets=1 << 22)
