"""Lines, windows and words against plain Python."""

import random

from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import (
    normalize_newlines, rstrip, split_lines, strip, window_text, word_search, words,
)

PIECES = ["a", "b c", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85",
          "\u2028", "\u2029", "\u00e9", "\u00a0", "\t", ""]


def _texts(count=300):
    rng = random.Random(7)
    return [""] + ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(count)]


def test_split_lines_is_splitlines(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "t string")
    for row in rows.select("t", split_lines(F.col("t")).alias("lines")).collect():
        assert row["lines"] == row["t"].splitlines(), repr(row["t"])


def test_newlines_are_normalized(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\nd",), ("plain",)], "t string")
    got = [r[0] for r in rows.select(normalize_newlines(F.col("t"))).collect()]
    assert got == ["a\nb\nc\nd", "plain"]


def test_strip_removes_unicode_space(spark):
    texts = ["  a b\t ", "\u00a0 x\u3000", "y\u2028 ", "", "\x0bz\x0c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", strip(F.col("t")), rstrip(F.col("t"))).collect():
        assert row[1] == row[0].strip()
        assert row[2] == row[0].rstrip()


def test_windows_are_clipped_slices(spark):
    lines = [f"line {i}" for i in range(9)]
    frame = spark.createDataFrame([(lines, i) for i in range(9)], "lines array<string>, at int")
    for before, after in [(0, 0), (5, 0), (4, 2), (2, 3), (-1, 20), (14, -1), (0, 29), (60, 9), (-1, 1)]:
        for row in frame.select(
            "at", window_text(F.col("lines"), F.col("at"), before, after).alias("w")
        ).collect():
            at = row["at"]
            expected = lines[max(0, at - before) : max(0, at + after + 1)]
            assert row["w"] == "\n".join(expected), (before, after, at)


def test_words_are_unicode(spark):
    rows = spark.createDataFrame([("über_1 = naïve(x)",)], "t string")
    assert rows.select(words(F.col("t"))).first()[0] == ["über_1", "naïve", "x"]


def test_word_search_finds_every_word(spark):
    pattern = word_search(P.AUTH_HINTS)
    texts = [f"x{w.upper()}y" for w in P.AUTH_HINTS] + ["nothing here", "aut h"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(F.col("t").rlike(pattern)).collect()]
    assert got == [True] * len(P.AUTH_HINTS) + [False, False]
