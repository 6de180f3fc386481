"""License scan, fill-in-the-middle and cross-tokenizer alignment against brute force, and on odd rows."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codesift.llm import alignment, fill_in_middle, license_scan, queries
from codesift.llm.license_rules import BASE, KINDS, RULES, Rule

SCHEMA = "doc_id long, text string, n string, form string, detections string, groups string, _text string, `a.b` string"
BYTE_BPE, PIECE_BPE = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def prose(rng, count):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 8))) for _ in range(count))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    phrases = [phrase for _, phrase in BASE]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "One, two"), (None, None), (5, "漢字 ▁ 12"),
            (6, "a<P>b"), (7, "x <M>"), (8, "<S"), (9, "it's <|endoftext|> plain </s> text\r\n  é é \x00 \x1c"),
            (10, "Licensed under the Apache License, Version 2.0."), (11, "My MIT license plates! Apache License MIT License"),
            (12, "This work is licensed under the GNU General Public License, version 3, CC BY-NC 4.0; cc by cc by"),
            (13, "a" * 9000 + " " * 700 + "-" * 5000)]
    for number in range(20, 60):
        words = prose(rng, rng.randrange(1, 150)).split(" ")
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(phrases).title().replace(" ", rng.choice([" ", "-", ", "])))
        rows.append((number, rng.choice(["", "\n"]) + " ".join(words)))
        if number % 4 == 0:
            rows.append((number + 100, rows[-1][1]))
    rows += [(200, prose(rng, 20_000)), (201, "ab" * 40_000), (202, "mit license " * 3_000), (203, "Z" * 5_000 + "1" * 5_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", "f", "d", "g", "x", "y") for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((value is None, str(value)) for value in row)


def same(frame, expected):
    assert sorted(map(tuple, frame.collect()), key=key) == sorted(expected, key=key)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# License scan

def test_keywords_are_in_every_match():
    @settings(max_examples=4, database=None, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.data())
    def check(data):
        for rule in RULES:
            text = data.draw(st.from_regex(re.compile(rule.pattern), fullmatch=True, alphabet=st.characters(codec="ascii")))
            assert set(rule.keywords) <= set(text.split(" ")), (rule, text)

    assert len(RULES) > 300 and {rule.kind for rule in RULES} == set(KINDS)
    check()


def test_base_places_and_words(docs, empty, texts):
    expected = []
    for number, text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [
            (start, label) for label, phrase in BASE for start in range(len(words))
            if words[start : start + len(phrase.split())] == phrase.split()
        ]
        starts = [start for start, _ in places]
        expected.append((number, len(words), len(places), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({label for _, label in places}))))
    found = license_scan.scan_licenses(docs)
    assert found.columns.count("detections") == 1 and "a.b" in found.columns
    starts = F.transform("base", lambda place: place["first"])
    same(
        found.withColumn("base", license_scan.base_places()).select(
            "doc_id", "n_words", F.size("base"), F.array_min(starts), F.array_max(starts), license_scan.names(F.col("base"))
        ), expected,
    )
    assert license_scan.scan_licenses(empty).count() == 0


def plainly_kept(scanner, found):
    """The rule as it is defined: kind by kind from the strongest, each detection against all others."""
    kept = set()
    for kind in reversed(list(KINDS)):
        stronger = [found[place] for place in kept]
        own = [p for p, each in enumerate(found) if scanner.rules[each[0]].kind == kind]
        own = [p for p in own if not any(a <= found[p][2] and found[p][1] <= b for _, a, b in stronger)]
        for p in own:
            rank, a, b = found[p]
            holders = [q for q in own if q != p and found[q][1] <= a and b <= found[q][2]]
            if not any((found[q][1:] != (a, b)) or found[q][0] < rank for q in holders):
                kept.add(p)
    return [place in kept for place in range(len(found))]


def test_suppression_against_brute_force():
    rng = random.Random(4)
    rules = [Rule(f"l{n}", rng.choice(list(KINDS)), ("k",), f"k{n}") for n in range(12)]
    scanner = license_scan.Scanner(rules)
    for _ in range(400):
        found = set()
        for _ in range(rng.randrange(1, 14)):
            first = rng.randrange(25)
            found.add((rng.randrange(12), first, first + rng.randrange(7)))
        found = list(found)
        assert scanner.kept(found) == plainly_kept(scanner, found)


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Released under the MIT license.", "mit"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("she bought new license plates", ""),
    ("not licensed under the Apache License", "apache"),
    ("Copyright (c) 2019-2021. All rights reserved.", "all-rights-reserved,copyright"),
    ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public Licence as published by "
     "the Free Software Foundation, either version 3 of the Licence, or (at your option) any later version.",
     "lgpl-3.0-or-later"),
    ("BSD 3-Clause License; no relation", "bsd-3-clause"),
    ("nothing of that kind", ""),
])
def test_labels(spark, text, labels):
    found = license_scan.scan_licenses(spark.createDataFrame([(text,)], "text string"))
    row = found.select(license_scan.names(license_scan.labelled()), license_scan.confidence(license_scan.labelled())).first()
    assert row[0] == labels and 0 <= row[1] <= 1 and (row[1] > 0) == bool(labels)


# Fill-in-the-middle

def test_chunks_follow_the_content():
    rng = random.Random(2)
    passage = "".join(rng.choices("abc dEF.1é漢", k=6000))
    cuts = []
    for before in ("", "x" * 777, prose(rng, 90)):
        codes = fill_in_middle.np.frombuffer((before + passage).encode("utf-32-le"), dtype="uint32")
        cuts.append({int(end) - len(before) for end in fill_in_middle.chunk_ends(codes) if end > len(before) + 1500})
    assert cuts[0] and cuts[0] == cuts[1] == cuts[2]
    for size in (1, 2, 3, 15, 16, 17, 40_000):
        ends = fill_in_middle.chunk_ends(fill_in_middle.np.full(size, 97, dtype="uint32")).tolist()
        assert ends[-1] == size and max(b - a for a, b in zip([0, *ends], ends)) <= fill_in_middle.LONGEST


@settings(max_examples=200, database=None, deadline=None, derandomize=True)
@given(st.text(alphabet="abZ .é漢\n", max_size=80), st.integers(1, 9), st.integers(0, 99), st.integers(0, 99))
def test_cuts_against_whole_split(text, repeat, first, second):
    text = text * repeat * 7
    units = fill_in_middle.UNIT.findall(text)
    low, high = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    expected = len(units), len("".join(units[:low])), len("".join(units[:high]))
    assert fill_in_middle.Chunks(remembered=3).cut(text, first, second) == expected


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH_CHARS", 37)
    text = "abc d" * 200
    units = fill_in_middle.UNIT.findall(text)
    for low in range(0, len(units) + 1, 7):
        assert fill_in_middle.Chunks().cut(text, low, low)[:2] == (len(units), len("".join(units[:low])))


def plain_form(number, text, percent=10):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - percent:
        return number, len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return number, len(units), "spm", a and len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return number, len(units), "psm", a and len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fill_in_middle(docs, empty, texts):
    formed = fill_in_middle.fill_in_middle(docs)
    assert formed.columns.count("n") == 1 and {"a.b", "_text"} <= set(formed.columns)
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    expected = [plain_form(number, text) for number, text in texts]
    assert {row[2] for row in expected} == {"plain", "psm", "spm"}
    same(formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", again), expected)
    assert fill_in_middle.fill_in_middle(empty).count() == 0


# Alignment

def plain_alignment(texts):
    """Every token of both sides as a byte range, and all pairs of ranges compared."""
    byte_bpe = Tokenizer.from_file(BYTE_BPE)
    byte_bpe.encode_special_tokens = True
    piece_bpe = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    back = alignment._byte_alphabet()
    found, counts = [], {}
    for number, text in texts:
        whole = (" " + (text or "")).encode()
        a = [(t.id, bytes(back[c] for c in t.value)) for t in byte_bpe.model.tokenize("")] if not text else []
        if text:
            encoded = byte_bpe.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(back[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
        b = []
        for i in piece_bpe.encode(text or ""):
            piece = piece_bpe.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        if not text or b"".join(p for _, p in a) != whole or b"".join(p for _, p in b) != whole:
            found.append((number, [], [], [], ""))
            continue
        spans = []
        for tokens in (a, b):
            place, own = 0, []
            for i, piece in tokens:
                own.append((i, place, place + len(piece)))
                place += len(piece)
            spans.append(own)
        links, k = [], 0
        for i, start, end in spans[0]:
            while spans[1][k][2] <= start:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < end:
                links.append((i, spans[1][j][0]))
                j += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        at = [0, 0]
        for end in ends:
            sides = []
            for side in (0, 1):
                own = []
                while at[side] < len(spans[side]) and spans[side][at[side]][2] <= end:
                    own.append(str(spans[side][at[side]][0]))
                    at[side] += 1
                sides.append(",".join(own))
            groups.append("|".join(sides))
        found.append((number, a, b, links, ";".join(groups)))
        for link in links:
            counts[link] = counts.get(link, 0) + 1
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (number, len(a), len(b), groups.count(";") + bool(groups), len(links),
         sum(counts[link] == best[link[1]] for link in links), sum(counts[link] for link in links), groups)
        for number, a, b, links, groups in found
    ]


@pytest.mark.parametrize("frequent", [0, 60, 1 << 18])
def test_alignment(docs, texts, frequent):
    expected = plain_alignment(texts)
    assert any(row[1] == 0 and text for row, (_, text) in zip(expected, texts)) and max(row[4] for row in expected) > 20_000
    same(alignment.align(docs, BYTE_BPE, PIECE_BPE, frequent=frequent), expected)


def test_alignment_of_nothing(spark, empty):
    assert alignment.align(empty, BYTE_BPE, PIECE_BPE).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    same(alignment.align(none, BYTE_BPE, PIECE_BPE), [(n, 0, 0, 0, 0, 0, 0, "") for n in (1, 2)])


def test_ranks_give_the_library_s_tokens():
    side = alignment.side(BYTE_BPE)
    assert side.quick is not None
    rng = random.Random(9)
    cases = [chr(code) + "a" + chr(code) * 2 for code in range(0x300)] + ["a" * 5000, " " * 600, "\n" * 600, "'s 'S'll"]
    cases += ["".join(rng.choices("ab'slldtE1 2\n\t  .,éßÀ̀Ω漢<|endoftext|>", k=rng.randrange(40))) for _ in range(800)]
    for text in cases:
        assert side.encode([text]) == [side.library.encode(" " + text, add_special_tokens=False).ids]


def test_registered_queries(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    formed = [plain_form(*row) for row in rows]
    same(queries.op12_fill_in_middle(spark, sf_dir), [(*row[:5], sha(row[5]), sha(row[6])) for row in formed])
    aligned = plain_alignment(rows)
    same(
        queries.op13_alignment(spark, sf_dir).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
        ), [(*row[:7], sha(row[7]) if row[7] else "") for row in aligned],
    )
    scanned = queries.op11_license_scan(spark, sf_dir).collect()
    assert len(scanned) == len(rows)
    for row in scanned:
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) or not row.base_labels
        assert 0 <= row.score <= 1 and (row.n_base > 0) == bool(row.base_labels) == (row.first_word is not None)
