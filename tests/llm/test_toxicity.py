"""The clause grammar of the toxicity operator, and the operator on rows that are null, long, repeated or clash."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesift.llm import toxicity as T


def marks(text, stems=None):
    scorer = T.Scorer(stems or {})
    return [event for clause in T.CLAUSE.findall(text.lower()) for event, _ in scorer.events(clause)]


@pytest.mark.parametrize("text, expected", [
    ("what an idiot", ["insult+noun"]),
    ("the stupid clown of town", ["insult+noun", "insult+noun+heaped"]),
    ("that is really pathetic", ["insult+predicate"]),
    ("this was an idiot", ["insult+predicate"]),
    ("idiot, go home", ["insult+address"]),
    ("go home, idiot", ["insult+address"]),
    ("go home idiot", ["insult+address"]),
    ("you big clown man", ["insult+target"]),
    ("green idiot green garbage green", ["insult+heaped"]),
    ("go kill them", ["threat+object"]),
    ("kill, them", []),
    ("you beat green", ["threat+target"]),
    ("kill time", []),
    ("green idiot green", []),  # an isolated word
    ("green. idiot green. green", ["insult+address"]),
    ("he is not an idiot man", ["insult+negated+target+predicate"]),
    ("they said idiot man", ["insult+reported+target"]),
    ("never kill them", []),
    ("", []),
])
def test_clause_patterns(text, expected):
    assert marks(text) == expected


def test_every_event_names_a_pattern_and_marked_ones_weigh_less():
    machine = T.grammar()
    weighted = {(output, weight) for _, output, weight in machine.moves.values() if weight}
    assert weighted
    for output, weight in weighted:
        kind, *own = output.split("+")
        assert set(own) & set(T.PATTERNS[kind])
        assert weight == (T.MARKED_WEIGHT if {"negated", "reported"} & set(own) else T.PLAIN_WEIGHT)


def plain_events(kinds):
    """The grammar said without transducers, for clauses without speech verbs or negations."""
    out, heaped, opener, left, target, reach, pending = [], False, None, 0, 0, 0, False
    for kind in kinds:
        event = None
        if kind == T.INSULT:
            own = ["target"] * (target > 0) + [opener] * (opener is not None) + ["heaped"] * heaped
            event = "+".join([kind, *own]) if own else None
            heaped, pending = True, pending or not own
        elif kind == T.THREAT and target:
            event = "threat+target"
        elif kind == T.TARGET and reach:
            event = "threat+object"
        elif kind == T.EDGE and pending:
            event = "insult+address"
        pending = pending and kind == T.INSULT
        if kind == T.THREAT and not target:
            reach = T.OBJECT_WORDS
        elif kind in (T.EDGE, T.TARGET):
            reach = 0
        else:
            reach = max(reach - 1, 0)
        if kind == T.TARGET:
            target = T.TARGET_WORDS
        elif kind != T.EDGE:
            target = max(target - 1, 0)
        if kind == T.EDGE:
            opener, left = "address", 1
        elif kind == T.COPULA:
            opener, left = "predicate", T.COPULA_WORDS
        elif kind == T.LINKER and opener != "predicate":
            opener, left = "noun", T.LINKER_WORDS
        elif kind != T.INSULT and opener:
            left -= 1
            opener = opener if left else None
        if event:
            out.append(event)
    return out


def test_composed_machine_equals_the_plain_reading():
    machine = T.grammar()
    kinds = (T.INSULT, T.THREAT, T.TARGET, T.LINKER, T.COPULA, T.EDGE, T.OTHER)
    for size in range(1, 7):
        for word in itertools.product(kinds, repeat=size):
            state, found = 0, []
            for kind in word:
                state, output, weight = machine.step(state, kind)
                if weight:
                    found.append(output)
            assert found == plain_events(word), word


def test_learned_stems_are_words_not_events():
    assert marks("green grumbler green", {"grumb": 4.0}) == []
    assert marks("the grumbler", {"grumb": 4.0}) == ["insult+noun"]
    scorer = T.Scorer({"grumb": 4.0})
    assert scorer.events("the grumbler") == [("insult+noun", 4.0)]


def test_marks_never_add():
    rng = np.random.default_rng(3)
    values = np.zeros((400, len(T.FEATURES)))
    values[:, T.FEATURES.index("negated")] = rng.integers(0, 2, 400)
    toxic = values[:, T.FEATURES.index("negated")].copy()
    toxic[:40] = 1 - toxic[:40]
    weights = T.fit(values, toxic, np.ones(400))
    assert all(weights[place] <= 0 for place in T.NEVER_ADD)


def test_rows_of_every_kind(spark):
    long = "green word " * 300_000
    rows = [
        (1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c"), (None, "you idiot", "d"),
        (4, long + ". you idiot. you pathetic clown", "e"), (5, long, "f"), (6, "!!! ,,, ...", "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(3, 1, "x"), (5, 0, "y"), (None, 1, "z")], "doc_id long, toxic int, text string")
    for model in (T.learn(docs, labels), T.ToxicityModel({}, T.FEATURES, T.seed_weights())):
        scored = docs.select("doc_id", F.length("text").alias("n"), T.score(docs, model).alias("score")).collect()
        assert len(scored) == len(rows) and all(0 <= row.score <= 1 for row in scored)
        same = {row.score for row in scored if row.n == len("you idiot")}
        assert len(same) == 1  # repeated rows and null ids are scored by their text
        by_id = {row.doc_id: row.score for row in scored}
        assert by_id[1] == by_id[2] == by_id[5] == by_id[6]
        assert by_id[4] > by_id[5]  # whole texts are read
    assert docs.limit(0).select(T.score(docs, model)).count() == 0


def test_counting_stems_holds_a_bounded_number():
    """Counts are handed on in small batches before a task has read all its texts, and add up to the whole."""
    texts = [f"word{'abcdefghij'[k % 10]}{chr(97 + k // 26)}{chr(97 + k % 26)} shared" for k in range(260)]
    flags = [k % 3 == 0 for k in range(260)]
    read = []

    def batches():
        for first in range(0, 260, 20):
            read.append(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts[first : first + 20]), pa.array(flags[first : first + 20])], ["_text", "_toxic"])

    whole, seen_at_first = Counter(), None
    for batch in T.count_stems(batches(), held_stems=100):
        seen_at_first = seen_at_first or len(read)
        assert batch.num_rows <= 150
        for stem, toxic, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            whole[stem, toxic] += n
    assert seen_at_first < 4
    expected = Counter()
    for text, toxic in zip(texts, flags, strict=True):
        stems = {stem for word in T.WORD.findall(text) for stem in T.stems_of(word)}
        expected.update((stem, toxic) for stem in stems | {""})
    assert whole == expected
