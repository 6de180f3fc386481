"""Toxicity by a weighted finite-state grammar over clauses.

Words are classed as insult, threat, target (who is addressed), negation, report (speech verbs), linker (determiners and
prepositions), copula or other, and commas, brackets and quotes are edges. Small transducers are composed into one: reported
speech marks what a speech verb introduces, negation what follows a negating word, target what stands near an addressed
person, and the insult and threat transducers mark how an insult or a threat stands in its clause. Only the clause patterns
in ``PATTERNS`` are events; an insult word that stands in none of them is not scored. Negated and reported events weigh less.
A document's score is a logistic function of its events, whose weights are learned; a negation or a speech verb never adds.

The seed vocabulary is part of the grammar. Insult stems of other vocabularies are learned from labelled rows: a stem (the
first letters of a word, or a whole word) is taken if even a cautious estimate of its odds is far above those of clean rows.
Learned stems are words of the insult transducer, not events. Function words of other languages are learned as linkers: words
that stand in at least ``LINKER_SHARE`` of the clean rows. Learning uses at most ``LEARN_ROWS`` labelled rows, those with
the smallest hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import parts_of, stored

#: Labelled rows that are learned from, at most. Fitting a classifier on a bounded sample is allowed; scoring reads all.
LEARN_ROWS = 24_000
#: Stems tried as insults: first letters of a word, and words as they are (marked by a final dollar).
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Stems the learned vocabulary holds at most, those with most evidence first.
MAX_STEMS = 20_000
#: Least cautious log-odds and least number of toxic rows for a stem.
LEAST_LOG_ODDS, LEAST_ROWS = 2.5, 4
#: Share of the clean rows in which a word stands that counts as a linker, and the number of learned linkers at most.
LINKER_SHARE, MAX_LINKERS = 0.1, 200
#: A score from which a document counts as toxic.
THRESHOLD = 0.3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
LINKER, COPULA, EDGE = "linker", "copula", "edge"

#: Clause patterns: an insult aimed at a person, said of something, inside a noun phrase, that begins or ends a phrase,
#: that follows another one in its clause; a threat whose subject, or whose object, is a person.
AIMED, PREDICATE, NOUN, ADDRESS, HEAPED, OBJECT = "target", "predicate", "noun", "address", "heaped", "object"
PATTERNS = {INSULT: (AIMED, PREDICATE, NOUN, ADDRESS, HEAPED), THREAT: (AIMED, OBJECT)}
#: Weight of an event, and of one that is negated or reported.
PLAIN_WEIGHT, MARKED_WEIGHT = 1.0, 0.25

#: Seed vocabulary of the grammar, in English, French, German and Spanish. A later class takes a word from an earlier one.
SEEDS: dict[str, str] = {
    LINKER: (
        "the a an this that these those my of to in for with from by at on and or as such "
        "le la les un une des ce cet cette ces de à dans pour avec par sur et ou comme "
        "der die das den dem ein eine einen einem dieser diese mit von zu für auf an und oder als "
        "el la los las un una unos unas este esta estos estas de a en para con por y o como"
    ),
    COPULA: (
        "is are was were be been am it's that's est sont était étaient être suis es sommes êtes "
        "ist sind war waren sein bin bist seid es son era eran ser soy eres está están"
    ),
    INSULT: (
        "idiot idiots moron morons stupid dumb trash garbage scum loser losers clown clowns pathetic worthless disgusting "
        "imbecile scumbag creep dimwit crétin abruti débile ordure minable dégoûtant bouffon "
        "trottel depp dummkopf abschaum widerlich wertlos erbärmlich versager "
        "idiota imbécil estúpido estúpida basura escoria payaso patético asqueroso inútil"
    ),
    THREAT: (
        "kill murder hurt destroy beat stab shoot burn tuer frapper détruire poignarder brûler "
        "töten schlagen vernichten erschießen verbrennen matar golpear destruir apuñalar quemar"
    ),
    TARGET: (
        "you your yourself he him she her they them people tu toi vous ton votre il elle ils eux "
        "du dich dir euch ihr sie er tú usted ustedes vosotros él ella ellos"
    ),
    NEGATION: "not no never none nor n't isn't aren't ne pas jamais aucun non nicht kein keine nie niemals nunca jamás ninguno",
    REPORT: (
        "said says say told tells called quoted wrote claimed dit disait raconte écrit "
        "sagte sagt erzählte schrieb dijo dice contó escribió"
    ),
}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[^.!?;:\n\r|]+")
#: Words of a clause, and what separates its phrases.
TOKEN = re.compile(WORD.pattern + r"""|[,()\[\]{}"“”«»—–]""")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, output symbol, weight); state 0 begins.

    A missing pair keeps the state and passes the symbol on with weight 0.
    """

    moves: dict[tuple[int, str], tuple[int, str, float]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.moves.get((state, symbol), (state, symbol, 0.0))

    @property
    def states(self) -> set[int]:
        return {0} | {state for state, _ in self.moves} | {state for state, _, _ in self.moves.values()}


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; weights add up."""
    alphabet = list(alphabet)
    numbers: dict[tuple[int, int], int] = {(0, 0): 0}
    waiting = [(0, 0)]
    moves: dict[tuple[int, str], tuple[int, str, float]] = {}
    while waiting:
        pair = waiting.pop()
        for symbol in alphabet:
            left, middle, first_weight = first.step(pair[0], symbol)
            right, output, second_weight = second.step(pair[1], middle)
            if (left, right) not in numbers:
                numbers[left, right] = len(numbers)
                waiting.append((left, right))
            moves[numbers[pair], symbol] = (numbers[left, right], output, first_weight + second_weight)
    return Transducer(moves)


def scope(opens: str, words: int, mark: str, marked: Iterable[str], alphabet: Iterable[str]) -> Transducer:
    """``opens`` starts a scope of ``words`` words in which the symbols ``marked`` get ``mark`` added."""
    marked = set(marked)
    moves = {(0, opens): (words, opens, 0.0)}
    for left in range(1, words + 1):
        for symbol in alphabet:
            if symbol == opens:
                moves[left, symbol] = (words, symbol, 0.0)
            else:
                moves[left, symbol] = (left - 1, f"{symbol}+{mark}" if symbol in marked else symbol, 0.0)
    return Transducer(moves)


#: Words that a mark reaches: after a speech verb, a negation, an addressed person, a copula, a linker, a threat.
REPORT_WORDS, NEGATION_WORDS, TARGET_WORDS, COPULA_WORDS, LINKER_WORDS, OBJECT_WORDS = 8, 3, 5, 3, 2, 3
CLASSES = (INSULT, THREAT, TARGET, NEGATION, REPORT, LINKER, COPULA, EDGE, OTHER)


def base(symbol: str) -> str:
    """The class of a marked symbol."""
    return symbol.split("+")[0]


def standing(alphabet: Iterable[str]) -> Transducer:
    """Marks an insult by what opened its phrase last: an edge, a linker or a copula; a run of insults stands alike.

    A linker inside the reach of a copula changes nothing ("is an idiot"), an edge ends every reach.
    """
    opened = {PREDICATE: COPULA_WORDS, NOUN: LINKER_WORDS, ADDRESS: 1}
    numbers: dict[tuple[str, int], int] = {}
    for pattern, words in opened.items():
        for left in range(1, words + 1):
            numbers[pattern, left] = len(numbers) + 1
    states = [(0, None, 0)] + [(number, pattern, left) for (pattern, left), number in numbers.items()]
    moves = {}
    for number, pattern, left in states:
        for symbol in alphabet:
            kind = base(symbol)
            if kind == EDGE:
                moves[number, symbol] = (numbers[ADDRESS, 1], symbol, 0.0)
            elif kind == COPULA:
                moves[number, symbol] = (numbers[PREDICATE, COPULA_WORDS], symbol, 0.0)
            elif kind == LINKER and pattern != PREDICATE:
                moves[number, symbol] = (numbers[NOUN, LINKER_WORDS], symbol, 0.0)
            elif kind == INSULT and pattern:
                moves[number, symbol] = (number, f"{symbol}+{pattern}", 0.0)
            elif pattern:
                moves[number, symbol] = (numbers.get((pattern, left - 1), 0), symbol, 0.0)
    return Transducer(moves)


def heaping(alphabet: Iterable[str]) -> Transducer:
    """Marks the insults of a clause that follow its first one."""
    moves = {}
    for symbol in alphabet:
        if base(symbol) == INSULT:
            moves[0, symbol] = (1, symbol, 0.0)
            moves[1, symbol] = (1, f"{symbol}+{HEAPED}", 0.0)
    return Transducer(moves)


def objects(alphabet: Iterable[str]) -> Transducer:
    """A person soon after a plain threat completes it: the person's symbol becomes the event. An edge ends the reach."""
    moves = {(0, THREAT): (OBJECT_WORDS, THREAT, 0.0)}
    for left in range(1, OBJECT_WORDS + 1):
        for symbol in alphabet:
            after = OBJECT_WORDS if symbol == THREAT else 0 if symbol in (EDGE, TARGET) else left - 1
            moves[left, symbol] = (after, f"{THREAT}+{OBJECT}" if symbol == TARGET else symbol, 0.0)
    return Transducer(moves)


def closing(alphabet: Iterable[str]) -> Transducer:
    """A run of insults that begins without a mark and ends its phrase is an address: the edge's symbol becomes the event."""
    moves = {(0, INSULT): (1, INSULT, 0.0), (1, EDGE): (0, f"{INSULT}+{ADDRESS}", 0.0)}
    for symbol in alphabet:
        if base(symbol) not in (INSULT, EDGE):
            moves[1, symbol] = (0, symbol, 0.0)
    return Transducer(moves)


def event_weight(symbol: str) -> float:
    """Weight of an output of the marking transducers; 0 for what is no clause pattern."""
    kind, *marks = symbol.split("+")
    if not set(marks) & set(PATTERNS.get(kind, ())):
        return 0.0
    return MARKED_WEIGHT if {"negated", "reported"} & set(marks) else PLAIN_WEIGHT


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Reported speech, negation, target, insult and threat transducers, composed. Outputs with a weight are events."""
    machine = Transducer({})
    for opens, words, mark in (
        (REPORT, REPORT_WORDS, "reported"), (NEGATION, NEGATION_WORDS, "negated"), (TARGET, TARGET_WORDS, AIMED),
    ):
        inner = _outputs(machine, CLASSES)
        hits = [symbol for symbol in inner if base(symbol) in (INSULT, THREAT)]
        machine = compose(machine, scope(opens, words, mark, hits, [symbol for symbol in inner if symbol != EDGE]), CLASSES)
    for made in (standing, heaping, objects, closing):
        machine = compose(machine, made(_outputs(machine, CLASSES)), CLASSES)
    weights = {symbol: event_weight(symbol) for symbol in _outputs(machine, CLASSES)}
    return compose(
        machine, Transducer({(0, symbol): (0, symbol, weight) for symbol, weight in weights.items() if weight}), CLASSES
    )


def _outputs(machine: Transducer, alphabet: Iterable[str]) -> list[str]:
    return sorted({machine.step(state, symbol)[1] for state in machine.states for symbol in alphabet})


@dataclass(frozen=True)
class ToxicityModel:
    """Learned insult stems (with log-odds), features, the weights of the logistic function (bias last), and linkers."""

    stems: dict[str, float]
    features: tuple[str, ...]
    weights: np.ndarray
    linkers: tuple[str, ...] = ()


FEATURES = ("matched clauses", "log matched", "evidence", "strongest", "rate", "target", "negated", "reported", "threat")


#: Class and evidence of words without a learned stem.
_PLAIN = {kind: (kind, 1.0 if kind in (INSULT, THREAT) else 0.0) for kind in CLASSES}
#: Words that a task remembers.
REMEMBERED = 1 << 17


class Scorer:
    """Reads texts with the composed machine; remembers the classes of words it has met."""

    def __init__(self, stems: dict[str, float], linkers: Iterable[str] = ()) -> None:
        self.stems = stems
        self.machine = grammar()
        self.classes = dict.fromkeys(linkers, LINKER)
        self.classes.update({word: kind for kind, words in SEEDS.items() for word in words.split()})
        self.known: dict[str, tuple[str, float]] = {}

    def kind(self, word: str) -> tuple[str, float]:
        """Class and evidence of a word."""
        evidence = max((self.stems.get(stem, 0.0) for stem in stems_of(word)), default=0.0)
        if evidence > 0:
            return INSULT, evidence
        return _PLAIN[self.classes.get(word, OTHER)]

    def events(self, clause: str) -> list[tuple[str, float]]:
        """(event, evidence) of a clause, lower-cased: every event names its pattern, such as ``insult+noun``."""
        known, step = self.known, self.machine.step
        kinds = [_PLAIN[EDGE]]
        for word in TOKEN.findall(clause):
            found = known.get(word)
            if found is None:
                found = _PLAIN[EDGE] if not word[0].isalpha() else self.kind(word)
            kinds.append(found)
        kinds.append(_PLAIN[EDGE])
        if not any(own for _, own in kinds):
            return []
        state, events, last = 0, [], 1.0
        for kind, own in kinds:
            state, event, weight = step(state, kind)
            last = own or last  # an edge or a person completes what the last insult or threat began
            if weight:
                events.append((event, weight * last))
        return events

    def features(self, text: str | None) -> list[float]:
        """``FEATURES`` of a text; all zero without a matched clause, so also for null and empty texts."""
        values = [0.0] * len(FEATURES)
        if not text:
            return values
        lowered = text.lower()
        words = WORD.findall(lowered)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        hit = False
        for word in set(words):
            found = known.get(word)
            if found is None:
                found = known[word] = self.kind(word)
            hit |= found[1] > 0
        if not hit:
            return values
        matched, evidence, strongest = 0, 0.0, 0.0
        for clause in CLAUSE.findall(lowered):
            events = self.events(clause)
            if not events:
                continue
            matched += 1
            for event, own in events:
                evidence += own
                strongest = max(strongest, own)
            for place, mark in enumerate((AIMED, "negated", "reported", THREAT), start=5):
                values[place] += sum(mark in event.split("+") for event, _ in events)
        values[0] = min(matched, 3)
        values[1] = math.log1p(matched)
        values[2] = math.log1p(evidence)
        values[3] = strongest
        values[4] = math.log1p(1000.0 * evidence / max(len(words), 1)) if matched else 0.0
        for place in range(5, 9):
            values[place] = math.log1p(values[place])
        return values


def stems_of(word: str) -> list[str]:
    return [word + "$", *(word[:size] for size in STEM_LETTERS if len(word) >= size)]


#: Stems that a task holds before it hands their counts on, and rows of a batch of counts.
HELD_STEMS, COUNT_ROWS = 1 << 16, 1 << 13
STEM_COUNTS = "stem string, toxic boolean, n long"


def count_stems(batches: Iterator[pa.RecordBatch], held_stems: int = HELD_STEMS) -> Iterator[pa.RecordBatch]:
    """Partial counts (``STEM_COUNTS``) of the texts, by flag, in which a stem stands; the empty stem counts texts.

    A task holds about ``held_stems`` stems and one text's, whatever its number of texts. A stem may be handed on several
    times; the counts add up.
    """
    held = (Counter(), Counter())

    def handed() -> Iterator[pa.RecordBatch]:
        for toxic, counts in zip((False, True), held, strict=True):
            items = iter(counts.items())
            while some := list(islice(items, COUNT_ROWS)):
                stems, numbers = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stems, pa.string()), pa.array([toxic] * len(some), pa.bool_()), pa.array(numbers, pa.int64())],
                    ["stem", "toxic", "n"],
                )
            counts.clear()

    for part in parts_of(batches):
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            held[toxic].update({stem for word in words for stem in stems_of(word)})
            held[toxic][""] += 1  # rows
            if len(held[False]) + len(held[True]) >= held_stems:
                yield from handed()
    yield from handed()


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = LEARN_ROWS,
) -> ToxicityModel:
    """Stems and weights from ``docs`` joined with ``labels`` on the id; rows without label or text teach nothing.

    The rows with the smallest hash of the id are used, whatever their label, ``rows`` at most: three fifths give the
    stems, two fifths the weights, so that weights are fitted on rows that the stems have not seen. An id that repeats
    teaches with each of its rows. Without rows of both kinds the model knows the seed vocabulary only.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("_toxic"))
        .orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(rows)
    )
    chosen = F.broadcast(chosen)  # at most ``rows`` rows of an id and a flag
    texts = stored(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
        .join(chosen, "_id")
        .withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(5))),
        "toxicity-sample",
    )

    counts = stored(
        texts.filter("_part < 3").select("_text", "_toxic").mapInArrow(count_stems, STEM_COUNTS)
        .groupBy("stem").agg(
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("clean"),
        ),
        "toxicity-stems",
    )
    total = counts.filter("stem = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return ToxicityModel({}, FEATURES, seed_weights())
    cautious = F.log((F.col("toxic") - 0.5 * F.sqrt("toxic")) / float(total["toxic"])) - F.log(
        (F.col("clean") + F.sqrt("clean") + 0.5) / float(total["clean"])
    )
    stems = (
        counts.filter((F.col("stem") != "") & (F.col("toxic") >= LEAST_ROWS))
        .select("stem", "toxic", cautious.alias("odds")).filter(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "stem").limit(MAX_STEMS).collect()
    )
    vocabulary = {row["stem"]: float(row["odds"]) for row in stems}
    common = (
        counts.filter(F.col("stem").endswith("$") & (F.col("clean") >= LINKER_SHARE * total["clean"]))
        .orderBy(F.desc("clean"), "stem").limit(MAX_LINKERS).collect()
    )
    linkers = tuple(row["stem"].removesuffix("$") for row in common)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, linkers))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for part in parts_of(batches):
            values = [scorer.features(text) for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(values, pa.list_(pa.float64()))], ["toxic", "values"]
            )

    fitted = texts.filter("_part >= 3").select("_text", "_toxic").mapInArrow(measured, "toxic boolean, values array<double>")
    sample = fitted.groupBy("toxic", "values").count().collect()  # at most two fifths of ``rows`` short rows
    return ToxicityModel(vocabulary, FEATURES, fit(
        np.array([row["values"] for row in sample], dtype=float).reshape(len(sample), len(FEATURES)),
        np.array([row["toxic"] for row in sample], dtype=float), np.array([row["count"] for row in sample], dtype=float),
    ), linkers)


def seed_weights() -> np.ndarray:
    """Weights without labels: two clauses with an insult, or one that is aimed at somebody, are toxic.

    One untargeted word, however short the text, and one that is negated or reported stay below the threshold.
    """
    return np.array([0.6, 0.3, 0.3, 0.0, 0.05, 2.0, -2.0, -2.0, 0.4, -2.5])


#: Features whose weight is never above zero.
NEVER_ADD = (FEATURES.index("negated"), FEATURES.index("reported"))


def fit(values: np.ndarray, toxic: np.ndarray, times: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge that also holds separable data at finite weights.

    A feature of ``NEVER_ADD`` that would add is left out: its weight is 0.
    """
    if not len(values) or not 0 < (toxic * times).sum() < times.sum():
        return seed_weights()
    values = np.column_stack([values, np.ones(len(values))])
    used = np.ones(values.shape[1], dtype=bool)
    while True:
        weights = np.zeros(values.shape[1])
        weights[used] = _newton(values[:, used], toxic, times, ridge, rounds)
        wrong = [place for place in NEVER_ADD if weights[place] > 0]
        if not wrong:
            return weights
        used[wrong] = False


def _newton(values: np.ndarray, toxic: np.ndarray, times: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Weights of the columns of ``values``, of which the last is constant and hardly held by the ridge."""
    penalty = np.full(values.shape[1], ridge)
    penalty[-1] = 1e-3
    weights = np.zeros(values.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(values @ weights, -30, 30)))
        slope = values.T @ (times * (toxic - chance)) - penalty * weights
        curve = (values * (times * chance * (1 - chance))[:, None]).T @ values + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        weights = weights + move
        if np.abs(move).max() < 1e-6:
            break
    return weights


def score_texts(texts: Iterable[str | None], scorer: Scorer, model: ToxicityModel) -> np.ndarray:
    values = np.array([scorer.features(text) for text in texts], dtype=float).reshape(-1, len(model.features))
    return 1 / (1 + np.exp(-np.clip(values @ model.weights[:-1] + model.weights[-1], -30, 30)))


def score(rows: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """A column (double, 0 to 1) for the texts of ``rows``: higher is more toxic; null and empty texts get the base rate.

    Whole texts are read. Ids, ties and repeated rows don't matter, every row is scored by its own text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value.stems, shared.value.linkers)
        for part in parts_of(batches):
            yield pa.array(score_texts(part.to_pylist(), scorer, shared.value))

    return scored(F.col(text_col))
