"""The ten operators against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codesift.llm import (
    bpe, components, decontamination, exact_dedup, fm_index, language_id, sharding, simhash, substring_dedup,
    token_counts, toxicity, url_filter, words,
)
from codesift.llm.pretokens import PreTokenizer

SCHEMA = "doc_id long, text string, lang string, kept string, size string, shard string, ids string, score string"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def prose(rng, count, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(count))


@pytest.fixture(scope="module")
def texts():
    """(id, text): nulls, blanks, copies, near copies, repeated rows, shared passages, a very long and an unsplit text."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "One"), (None, "no id"), (5, "é" * 40)]
    for number in range(10, 40):
        text = prose(rng, rng.randrange(1, 120))
        if number % 3 == 0:
            text = f"{prose(rng, 20)} {passage} {prose(rng, 15)}"
        rows.append((number, text))
        if number % 5 == 0:
            rows.append((number + 100, text))
    rows += [(200, prose(rng, 30_000)), (201, "ab" * 40_000), (202, "It's <|endoftext|> they'll  2024!<|startoftext|>"),
             (203, "line line line " * 300), (204, "line line line " * 290), (205, "Ünïcode ẞ 漢字 İ ﬁ e\u0301 'S")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d", "e") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((value is None, value) for value in row)


def test_exact_dedup(docs, empty, texts):
    groups = {}
    for number, text in texts:
        groups.setdefault(text or "", []).append(number)
    largest = {text: max((n for n in numbers if n is not None), default=None) for text, numbers in groups.items()}
    expected = sorted(((i, largest[t or ""], len(groups[t or ""]), i == largest[t or ""]) for i, t in texts), key=key)
    found = exact_dedup.exact_dedup(docs, slots=8, prefix_chars=3)  # few slots, short prefixes: nearly all are suspects
    assert sorted(map(tuple, found.collect()), key=key) == expected
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=key) == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_language_model_learns_and_names_unknown(spark, empty):
    rng = random.Random(3)
    syllables = {"aa": ["the", "ing", "tion", "er"], "bb": ["eau", "oué", "ère", "que"], "cc": ["sch", "keit", "ung", "ä"]}
    made = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30))
    rows = [(n, made(lang), lang) for n, lang in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    odd = [None, "", "123 !?", rows[0][1] * 2000]
    names, scores = language_id.score_texts([made("aa"), made("bb"), made("cc"), *odd], model)
    assert names == ["aa", "bb", "cc", "und", "und", "und", "aa"]
    assert scores[3:6].tolist() == [0, 0, 0] and (scores >= 0).all() and (scores <= 1).all()
    predicted = docs.select("lang", language_id.predict(docs, model).alias("p")).collect()
    assert all(row.lang == row.p.lang for row in predicted)
    nothing = language_id.learn(empty)
    assert language_id.score_texts(["some text"], nothing)[0] == ["und"]
    assert empty.select(language_id.predict(empty, nothing)).count() == 0


def test_long_text_is_scored_as_its_parts():
    text = "der die und " * 500
    whole = [np.sort(language_id.grams(j, s, 1 << 10)[1]) for _, j, s in language_id.pieces([text], 1 << 20)]
    parted = np.sort(np.concatenate([language_id.grams(j, s, 1 << 10)[1] for _, j, s in language_id.pieces([text], 64)]))
    assert np.array_equal(whole[0], parted)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pretokens_are_those_of_the_library(path):
    own = PreTokenizer(path)
    rng = random.Random(1)
    alphabet = "ab'slldtE1 2\n\t  .,éßÀ\u0300Ω漢"
    cases = [chr(code) + "a" + chr(code) for code in range(0x300)]
    cases += ["".join(rng.choices(alphabet, k=rng.randrange(20))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(500)]
    for text in cases:
        assert [i for p in own.split(text) for i in own.ids(p)] == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip_against_library(docs, empty, texts):
    library = Tokenizer.from_file(WORD_BPE)
    found = bpe.encode(docs, WORD_BPE, decoded_col="decoded", long_chars=2000, piece_chars=300, leaf=64)
    assert found.columns.count("ids") == 1
    expected = []
    for number, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((number, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, found.select("doc_id", "ids", "decoded").collect()), key=key) == sorted(expected, key=key)
    assert bpe.encode(empty, WORD_BPE).count() == 0


def test_tree_concatenation_is_exact():
    library = Tokenizer.from_file(WORD_BPE)
    own = bpe.Encoder(WORD_BPE, leaf=4)
    rng = random.Random(2)
    for size in (5, 17, 64, 333):
        for alphabet in ("ab", "thenasi", "abcdefghijklmnopqrstuvwxyz", "é"):
            word = "".join(rng.choices(alphabet, k=size))
            assert list(own.whole(word)) == library.encode(word, add_special_tokens=False).ids


def test_token_counts(docs, empty, texts):
    library = Tokenizer.from_file(BYTE_BPE)
    expected = sorted(
        ((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts), key=key
    )
    for frequent in (5, 1 << 17):
        found = token_counts.count_tokens(docs, BYTE_BPE, frequent=frequent)
        assert sorted(map(tuple, found.collect()), key=key) == expected
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(parts[k : k + 3]) for k in range(len(parts) - 2)] or [" ".join(parts)] * bool(parts)
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_components_against_all_pairs(spark, docs, empty, texts):
    rng = random.Random(9)
    base = prose(rng, 400).split()
    near = []
    for number in range(300, 330):
        changed = list(base)
        changed[rng.randrange(400)] = "other"
        near.append((number, " ".join(changed)))
    rows = texts + near
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).collect()
    prints = [plain_fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[b] for b in range(len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 2) for a in range(len(rows))]
    first = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    expected = [(rows[k][0], f"{prints[k]:016x}", first[group[k]]) for k in range(len(rows))]
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(n, n + 1) for n in range(20, 60)] + [(5, n) for n in range(100, 150)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[n] for n in range(20, 61)} == {20} and {found[n] for n in range(100, 150)} == {5} and found[7] == 7


def plain_minimax(sizes, shards):
    def used(capacity):
        count, held = 1, 0
        for size in sizes:
            if held + size > capacity:
                count, held = count + 1, 0
            held += size
        return count

    return min(c for c in range(max(sizes), sum(sizes) + 1) if used(c) <= shards)


@pytest.mark.parametrize("cells", [4, 1 << 15])
def test_minimax_capacity(spark, cells):
    rng = random.Random(4)
    for sizes in ([rng.randrange(1, 50) for _ in range(200)], [3, 3, 900, 1, 1, 1, 1, 1, 1], [7], [1] * 8):
        ends = np.cumsum(sizes).tolist()
        cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), 8, cells)
        assert set(cuts) <= {0, *ends} and cuts[-1] == ends[-1]
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == plain_minimax(sizes, 8)


def test_shards(docs, empty, texts):
    rows = sharding.shard(docs, salts=4).collect()
    assert len(rows) == len(texts)
    by_text, slots, size_of = {}, {}, {}
    own = sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in rows)
    import zlib
    assert own == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for row in rows:
        by_text.setdefault(row.text_crc32, set()).add(row.shard)
        slots.setdefault(row.shard, []).append(row.slot)
        size_of[row.shard] = size_of.get(row.shard, 0) + row["size"]
    assert all(len(shards) == 1 for shards in by_text.values())
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert sharding.shard(empty).count() == 0


def test_url_rules_and_templates(spark):
    rules = (url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"))
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/1?x#y"), (4, "http://a.com"), (5, "http://notexample.com/en/1"),
            (6, "x://É.org/A/B?q"), (None, "http://b.com/x"), (7, ""), (7, "")]
    rows += [(100 + n, f"http://farm.org/spam/{n}") for n in range(30)] + [(200 + n, f"http://farm.org/blog/post-{n}-words") for n in range(40)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    labelled = spark.createDataFrame(
        [(f"http://farm.org/spam/{n}", 1) for n in range(1000, 1030)] + [(f"http://farm.org/blog/p{n}", 0) for n in range(30)],
        "url string, bad int",
    )
    found = {}
    for row in url_filter.judge_urls(pages, rules, labelled=labelled).collect():
        found.setdefault(row.page_id, row)
    plain = lambda number: (found[number].host, found[number].path, found[number].rule, found[number].verdict)
    assert plain(1) == ("", "", None, "allow") == plain(2) == plain(7)
    assert plain(3) == ("www.example.com", "/en/1", "example.com/en/", "block")
    assert plain(4) == ("a.com", "", None, "allow")
    assert plain(5) == ("notexample.com", "/en/1", "com/", "allow")
    assert plain(6) == ("É.org", "/A/B", None, "allow")
    assert {found[100 + n].verdict for n in range(30)} == {"block"}
    assert {found[200 + n].verdict for n in range(40)} == {"allow"}
    assert {found[200 + n].template for n in range(40)} == {"/blog/*"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_urls_without_labels_of_their_own_are_allowed(spark):
    rules = (url_filter.Rule("net", "/es/", "block"), url_filter.Rule("com", "/", "allow"))
    urls = [f"http://big.net/es/{n}" for n in range(90)] + [f"http://a.com/{n}" for n in range(10)]
    free = [None, "", "http://clean.org/a/b", "http://big.net/de/1", "http://other.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    found = {row.page_id: row for row in url_filter.judge_urls(pages, rules).collect()}
    assert {found[n].verdict for n in range(90)} == {"block"} and len(found) == 105
    assert {(found[n].verdict, found[n].purity) for n in range(100, 105)} == {("allow", None)}


def test_url_trees_go_down_to_the_end_of_a_path(spark):
    deep = "/".join("abcdefghij")
    labelled = spark.createDataFrame(
        [(f"http://h.org/{deep}/spam/{n}", 1) for n in range(30)] + [(f"http://h.org/{deep}/blog/{n}", 0) for n in range(30)],
        "url string, bad int",
    )
    urls = [f"http://h.org/{deep}/spam/77", f"http://h.org/{deep}/blog/77", f"http://h.org/z/{deep}/only/1", "http://h.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {row.page_id: (row.verdict, row.template) for row in url_filter.judge_urls(pages, (), labelled=labelled).collect()}
    assert found == {0: ("block", f"/{deep}/spam/<n>"), 1: ("allow", f"/{deep}/blog/<n>"),
                     2: ("allow", f"/z/{deep}/only/<n>"), 3: ("allow", "/a")}


def test_grammar_marks_what_stands_around():
    scorer = toxicity.Scorer({"grumb": 4.0})
    place = dict(zip(toxicity.FEATURES, range(9), strict=True))
    values = lambda text: scorer.features(text)
    assert values(None) == values("") == values("fine words only") == [0.0] * 9
    assert values("you grumbler")[place["target"]] > 0 and values("a grumbler")[place["target"]] == 0
    assert values("he is not a grumbler")[place["negated"]] > 0
    assert values("they said grumbler")[place["reported"]] > 0 and values("they said. grumbler")[place["reported"]] == 0
    assert values("you kill")[place["threat"]] > 0 and values("kill time")[place["matched clauses"]] == 0


def test_toxicity_learns_other_words(spark, empty):
    rng = random.Random(8)
    rows = []
    for number in range(400):
        toxic = number % 4 == 0
        text = prose(rng, 40).split()
        for _ in range(3 * toxic):
            text[rng.randrange(40)] = rng.choice(["blargen", "blargig", "snoobat"])
        rows.append((number, " ".join(text), int(toxic)))
    rows += [(900, None, 0), (901, "", 0), (902, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.select("doc_id", F.col("score").alias("toxic"), F.lit("x").alias("text"))
    model = toxicity.learn(docs, labels)
    scored = docs.select("doc_id", F.col("score").alias("toxic"), toxicity.score(docs, model).alias("p")).collect()
    assert all((row.p >= toxicity.THRESHOLD) == (row.toxic == 1) for row in scored if row.toxic is not None)
    assert all(0 <= row.p <= 1 for row in scored)
    seeds = toxicity.learn(empty, labels.limit(0))
    assert toxicity.score_texts(["you pathetic idiot, you worthless scum", "hello"], toxicity.Scorer({}), seeds).round()[0] == 1


def test_one_untargeted_word_is_not_toxic_without_labels():
    model = toxicity.ToxicityModel({}, toxicity.FEATURES, toxicity.seed_weights())
    below = ["garbage", "stupid", "the garbage truck", "garbage " + "word " * 2000, "he is not an idiot", "they said idiot"]
    above = ["you idiot", "you idiot " + "word " * 2000, "pathetic. worthless", "you kill"]
    scores = toxicity.score_texts(below + above, toxicity.Scorer({}), model) >= toxicity.THRESHOLD
    assert scores.tolist() == [False] * len(below) + [True] * len(above)


def plain_removed(rows, window):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for number, own in split:
        for k in range(len(own) - window + 1 if number is not None else 0):
            content = tuple(own[k : k + window])
            first[content] = min(first.get(content, number), number)
    for number, own in split:
        gone = [False] * len(own)
        for k in range(len(own) - window + 1 if number is not None else 0):
            if first[tuple(own[k : k + window])] < number:
                gone[k : k + window] = [True] * window
        out.append((number, len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g).decode()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("hot", "shard_words"), [(4096, 1 << 18), (3, 500)])
def test_substring_dedup(docs, empty, texts, hot, shard_words):
    found = substring_dedup.remove_repeats(docs, hot=hot, shard_words=shard_words)
    assert sorted(map(tuple, found.collect()), key=key) == plain_removed(texts, 50)
    if hot == 3:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_fm_index_finds_earliest_owner_of_any_text():
    rng = np.random.default_rng(6)
    made = [rng.integers(1, 4, size).astype(np.uint64) for size in (80, 40, 300, 50)]
    made.append(np.concatenate([made[0][10:70], made[2][:60]]))
    index = fm_index.FMIndex(made, np.array([5, 4, 9, 2, 7]))
    strange = np.concatenate([made[2][20:90], rng.integers(1, 6, 30).astype(np.uint64), made[0][:55]])
    for own, found in zip([*made, strange], fm_index.earliest_owners(index, [*made, strange], 50), strict=True):
        for k, owner in enumerate(found):
            there = [n for n, text in zip([5, 4, 9, 2, 7], made) if any(
                np.array_equal(text[j : j + 50], own[k : k + 50]) for j in range(len(text) - 49))]
            assert owner == min(there, default=np.iinfo(np.int64).max)


def test_word_hashes_depend_on_the_word_alone():
    one, two = words.words_of(["b a", "", "a  c\x0bb"]), words.words_of(["a", "b", "c"])
    assert one.hashes.tolist() == [two.hashes[k] for k in (1, 0, 0, 2, 1)] and one.first.tolist() == [0, 2, 2, 5]


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(12)
    items = [(n, " ".join(f"q{rng.randrange(4000)}z" for _ in range(rng.randrange(12, 60)))) for n in range(60)]
    rows, expected = [], {}
    for number in range(300):
        text = prose(rng, 300, 5000).split()
        if number % 10 == 0:
            item, own = items[number % 60][0], items[number % 60][1].split()
            if number % 20 == 0:  # a paraphrase: one word in six replaced, the answer kept
                answer = len(own) - decontamination.Searcher.answer_size(np.array(own))
                own = [w if k >= answer or k % 6 != 2 else "zzz" for k, w in enumerate(own)]
            at = rng.randrange(300)
            text[at:at] = [w.upper() + "," for w in own]
            expected[number] = item
        rows.append((number, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, items[1][1] + " " + items[2][1]), (1003, "x"), (None, items[3][1])]
    docs = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id long, text string, item_ids array<int>")
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (72, "too short"), (None, "no id at all here")], "item_id long, text string")
    found = {row.doc_id: row for row in decontamination.contaminated(docs, bench).collect()}
    hits = sum(item in found[number].item_ids for number, item in expected.items())
    assert hits >= 0.9 * len(expected)
    assert all(number in expected for number, row in found.items() if row.contaminated and number not in (1002, None))
    assert sorted(found[1002].item_ids) == [1, 2] and found[None].item_ids == [3] and not found[1000].contaminated
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert not any(row.contaminated for row in decontamination.contaminated(docs, bench.limit(0)).collect())


def test_decontamination_finds_paraphrases_with_rare_words(spark):
    """More items than the latent space has dimensions; 25 to 40 % of the words replaced by rare ones, the answer kept."""
    rng = random.Random(31)
    weights = [1 / (k + 1) for k in range(5000)]
    made = lambda n: [f"z{k}z" for k in rng.choices(range(5000), weights, k=n)]
    items = [(n, made(rng.randrange(15, 60))) for n in range(200)]
    rows, expected = [], {}
    for number in range(300):
        text = made(200)
        if number < 200:
            own = list(items[number][1])
            answer = decontamination.Searcher.answer_size(np.array(own))
            gone = rng.sample(range(len(own) - answer), min(len(own) - answer, int(rng.uniform(0.25, 0.4) * len(own))))
            for k in gone:
                own[k] = f"rare{number}x{k}"
            text[100:100] = own
            expected[number] = number
        rows.append((number, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in items], "item_id long, text string")
    found = {row.doc_id: row.item_ids for row in decontamination.contaminated(docs, bench).collect()}
    recall = sum(item in found[number] for number, item in expected.items()) / len(expected)
    assert recall >= 0.99, recall
    assert not any(found[number] for number in range(200, 300))


def test_bit_parallel_subsequence():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(decontamination._positions(np.array(a)), b).bit_count() == table[-1][-1]


