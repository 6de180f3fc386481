"""Words that a weak hash would confuse, and the decontamination rule against brute force at every window."""

import random

import numpy as np
import pytest

from codesift.llm import decontamination, substring_dedup, words


def thue_morse(size, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(size))


def test_words_are_told_apart():
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    found = words.words_of([f"{one} x {two}", f"{two} {one}", "abcdefg abcdefgh \x00 \x00\x00 aaaaaaa aaaaaaaa"])
    assert found.hashes[0] != found.hashes[2] and found.hashes[:5:4].tolist() == [found.hashes[0], found.hashes[4]]
    assert found.hashes[0] == found.hashes[4] and len(set(found.hashes[5:].tolist())) == 6


def test_documents_that_differ_in_one_such_word_lose_nothing(spark):
    frame = " ".join(f"w{k}" for k in range(30))
    rows = [(k, f"{frame} {word} {frame}") for k, word in enumerate((thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")))]
    rows.append((2, rows[0][1]))
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((row.doc_id, row.n_removed) for row in found) == [(0, 0), (1, 0), (2, 61)]


def test_run_keys_depend_on_order_and_words():
    rng = np.random.default_rng(3)
    runs = substring_dedup.Runs.__new__(substring_dedup.Runs)
    a, b = (int(x) for x in rng.integers(1, 2**63, 2))
    sequence = [(a, b)[bin(k).count("1") & 1] for k in range(128)]
    other = [(b, a)[bin(k).count("1") & 1] for k in range(128)]
    runs.hashes = np.array(sequence + other + sequence + [a], dtype=np.uint64)
    runs.start = np.array([0, 128, 256, 256, 0, 1])
    runs.lengths = np.array([128, 128, 128, 129, 127, 127])
    keys = runs.keys(np.arange(6)).tolist()
    assert keys[0] == keys[2] and len(set(keys)) == 5


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, kept = row, [0]
        for j, y in enumerate(b):
            kept.append(last[j] + 1 if x == y else max(last[j + 1], kept[j]))
        row = kept
    return row[-1]


def plainly_found(text, item):
    """The confirming rule at every window of the item's length class, whatever the latent space says."""
    size = len(item)
    if size < decontamination.LENGTHS[0]:
        return any(text[k : k + size] == item for k in range(len(text) - size + 1))
    length = max(length for length in decontamination.LENGTHS if length <= size)
    tail = max(1, round(decontamination.ANSWER_SHARE * size))
    for start in range(max(1, len(text) - length + 1)):
        around = text[max(0, start - size) : start + length + size]
        share = longest(item, around) / size
        answer = longest(item[-tail:], around) / tail
        if share >= decontamination.COPY or (share >= decontamination.PARAPHRASE and answer >= decontamination.ANSWER):
            return True
    return False


class EveryPair(decontamination.Searcher):
    """The same search without marks: every window is compared with every item of its length."""

    def clusters(self, words, terms):
        items = np.arange(len(self.sizes))
        return items, 0 * items, 0 * items

    def pairs(self, words, starts, length, items, first, last):
        return np.repeat(np.arange(len(starts)), len(items)), np.tile(items, len(starts))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(17)
    weights = [1 / (k + 1) for k in range(400)]
    made = lambda n: [f"c{k}" for k in rng.choices(range(400), weights, k=n)]
    items = [made(rng.choice([1, 2, 3, 4, 5, 9, 20, 40])) for _ in range(60)]
    items += [["c1", "c1", "c1", "c2", "c2", "c1"], items[7], made(90)]
    rows = []
    for number in range(120):
        text = made(rng.randrange(0, 90))
        own = list(rng.choice(items))
        for k in rng.sample(range(len(own)), int(rng.choice([0, 0.2, 0.45, 0.7]) * len(own))):
            own[k] = rng.choice([f"odd{number}", "c0"])
        at = rng.randrange(len(text) + 1)
        text[at:at] = own
        rows.append((number, " ".join(text)))
    rows += [(0, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in enumerate(items)], "item_id long, text string")
    return items, rows, docs, bench


@pytest.mark.parametrize("marks", [1, 4, 100])
def test_marked_words_lose_nothing(leaks, marks, monkeypatch):
    monkeypatch.setattr(decontamination, "MARKS", marks)
    _, rows, docs, bench = leaks
    space = decontamination.fit_space(docs, bench, "text", "text")
    block = next(decontamination.item_blocks(bench, space, "item_id", "text"))
    texts = [text for _, text in rows]
    every = EveryPair(space, block).search(texts)
    found = decontamination.Searcher(space, block).search(texts)
    assert [[item for item, *_ in own] for own in found] == [[item for item, *_ in own] for own in every]
    assert sum(map(len, found)) > 300


def test_decontamination_against_the_rule_at_every_window(leaks):
    items, rows, docs, bench = leaks
    found = {row.text: {each.item_id for each in row.found} for row in
             decontamination.with_matches(docs, bench, "found", block=25).collect()}
    wanted = {text: {n for n, own in enumerate(items) if plainly_found(text.split(), own)} for _, text in rows}
    assert all(found[text] <= wanted[text] for text in found)
    short = {n for n, own in enumerate(items) if len(own) < 4}
    whole = {text: {n for n, own in enumerate(items) if " ".join(own) in text and len(own) > 8} for text in found}
    assert all(found[text] & short == wanted[text] & short and whole[text] <= found[text] for text in found)
    assert sum(map(len, whole.values())) > 20
    counted = decontamination.contaminated(docs, bench)
    assert counted.count() == len(rows) and counted.filter("doc_id = 0").count() == 2


@pytest.mark.parametrize("count", [3000])
def test_recall_with_many_items_and_long_texts(spark, count):
    rng = random.Random(32)
    weights = [1 / (k + 1) for k in range(8000)]
    made = lambda n: [f"z{k}z" for k in rng.choices(range(8000), weights, k=n)]
    items = [made(rng.randrange(15, 60)) for _ in range(count)]
    rows, expected = [], {}
    for number in range(300):
        text = made(150)
        own = list(items[number * (count // 300)])
        answer = decontamination.Searcher.answer_size(np.array(own))
        for k in rng.sample(range(len(own) - answer), min(len(own) - answer, int(rng.uniform(0.25, 0.4) * len(own)))):
            own[k] = f"rare{number}x{k}"
        text[70:70] = own
        rows.append((number, " ".join(text)))
        expected[number] = number * (count // 300)
    long = made(60_000)
    long[30_000:30_000] = items[5]
    rows += [(1000, " ".join(long)), (1001, "y" * 200_000), (1002, " ".join(made(150)))]
    expected[1000] = 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in enumerate(items)], "item_id long, text string")
    found = {row.doc_id: row.item_ids for row in decontamination.contaminated(docs, bench).collect()}
    recall = sum(item in found[number] for number, item in expected.items()) / len(expected)
    assert recall >= 0.99, recall
    assert not found[1001] and not found[1002]
