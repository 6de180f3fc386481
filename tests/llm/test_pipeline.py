"""The pipeline against a plain version of its stages, and on an odd table."""

import random

import pytest

import corpus_pipeline
from codesift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    made = lambda n: " ".join(f"v{rng.randrange(900)}k" for _ in range(n))
    item = " ".join(f"item{rng.randrange(900)}" for _ in range(30))
    rows = [(n, made(200)) for n in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1])]  # exact copies, and a repeated row
    near = rows[5][1].split()
    near[100] = "changed"
    rows += [(102, " ".join(near * 30)), (103, " ".join(near * 29 + rows[5][1].split()))]  # near copies of each other
    rows += [(104, f"{made(50)} {item} {made(50)}"), (105, "you pathetic idiot. you worthless scum. you moron")]
    rows += [(106, None), (None, "kept without an id")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, kept string, `a.b` long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "bpe"]
    assert found.columns == ["doc_id", "text", "kept", "a.b", "token_ids", "decoded", "n_tokens"]
    rows = found.collect()
    left = sorted(-1 if row.doc_id is None else row.doc_id for row in rows)
    assert left == sorted([n for n in range(60) if n != 3] + [101, 102, 106, -1])
    assert all(row.n_tokens == len(row.token_ids) for row in rows)


def test_near_copies_are_dropped_by_row(spark, folder):
    rng = random.Random(8)
    text = " ".join(f"v{rng.randrange(900)}k" for _ in range(4000))
    near, other = text.replace(text.split()[50], "changed", 1), " ".join(f"u{rng.randrange(900)}k" for _ in range(300))
    rows = [(7, near, 1), (7, other, 2), (3, text, 3), (None, near, 4), (None, other[:200], 5), (None, other[:200], 6),
            (9, None, 7), (8, "", 8), (8, other + " more", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert left.columns == docs.columns
    kept = {row["_row"] for row in left.collect()}
    assert len(kept & {1, 3, 4}) == 1 and 3 in kept  # the near copies: the smallest id
    assert 2 in kept and 9 in kept and len(kept & {5, 6}) == 1 and kept & {7, 8} == {8}


def test_stages_keep_odd_rows(spark, folder):
    odd = spark.createDataFrame(
        [(None, None, "a"), (None, "", "b"), (5, "", "c"), (5, "word", "d"), (5, "word", "e")],
        "doc_id long, text string, token_ids string",
    )
    assert corpus_pipeline.drop_benchmark_leaks(spark, odd, folder).count() == 5
    coded = corpus_pipeline.tokenize(spark, odd, folder)
    assert coded.columns == ["doc_id", "text", "token_ids", "token_ids_", "decoded", "n_tokens"]
    assert sorted(row.n_tokens for row in coded.collect()) == [0, 0, 0, 1, 1]


def test_every_stage_takes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_queries_are_named_by_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
